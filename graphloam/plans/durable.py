"""Tables written to the cluster's shared folder to cut a lineage; they outlive a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own_base: list[str] = []


class Tables:
    """write() gives a table that is read from the shared folder; close() deletes all, and the end of the process what is
    left. As a context manager it closes at its end: what was planned on its tables has to be done by then."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.live = spark, []
        self.base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not self.base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            if not _own_base:
                _own_base.append("file://" + tempfile.mkdtemp(prefix="graphloam-"))
            self.base = _own_base[0]
        atexit.register(self.close)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def folder(self) -> str:
        """A path of its own in the shared folder, deleted with the tables."""
        path = f"{self.base}/graphloam/{uuid.uuid4().hex}"
        self.live.append(path)
        return path

    def write(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        try:
            while self.live:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.live.pop())
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  at the end of the process the session may be gone
            return
