"""Several tables that change together: a manifest says which directories hold their rows, and a new one takes its place by one
rename. Readers see the tables of one version, whatever a writer has begun or left behind."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Versions:
    """Tables below a path. A version is a file `_commits/<number>.json`: for each table the directories of its rows, oldest
    first, and notes. Data is written to directories of new names before; those of no version are garbage, which vacuum()
    removes."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]) -> None:
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at = self._path(f"{self.path}/_commits")
        if not self.fs.exists(at):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(at))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The number of the last version; 0 before the first."""
        return max(self.numbers(), default=0)

    def manifest(self, number: int | None = None) -> dict:
        """{"tables": {table: directories}, "notes": {...}} of a version, the last one by default."""
        number = self.latest() if number is None else number
        if not number:
            return {"tables": {}, "notes": {}}
        stream = self.fs.open(self._path(f"{self.path}/_commits/{number:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table's rows, of the last version by default. The plan keeps to that version."""
        found = self.manifest(number)["tables"].get(table, [])
        if not found:
            return self.spark.createDataFrame([], self.schemas[table])
        columns = self.spark.createDataFrame([], self.schemas[table]).columns
        return self.spark.read.schema(self.schemas[table]).option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{d}" for d in found)).select(*columns)

    def begin(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 2) -> None:
        """Removes what only versions before the last `keep` need, and what writers that failed have left. No writer may be
        at work."""
        numbers = self.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        used = {d for n in kept for dirs in self.manifest(n)["tables"].values() for d in dirs}
        for table in self.schemas:
            at = self._path(f"{self.path}/{table}")
            for s in self.fs.listStatus(at) if self.fs.exists(at) else []:
                if f"{table}/{s.getPath().getName()}" not in used:
                    self.fs.delete(s.getPath(), True)
        for n in old:
            self.fs.delete(self._path(f"{self.path}/_commits/{n:08d}.json"), False)


class Change:
    """A version in the making: add() and replace() write rows, commit() makes them the next version."""

    def __init__(self, versions: Versions) -> None:
        self.versions, self.base = versions, versions.latest()
        before = versions.manifest(self.base)
        self.number, self.tables, self.notes = self.base + 1, {t: list(d) for t, d in before["tables"].items()}, dict(before["notes"])
        self.written: dict[str, DataFrame] = {}

    def _write(self, table: str, rows: DataFrame, by: str | None) -> str:
        directory = f"{table}/written={uuid.uuid4().hex}"
        columns = self.versions.spark.createDataFrame([], self.versions.schemas[table]).columns
        writer = rows.select(*columns).write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.versions.path}/{directory}")
        return directory

    def add(self, table: str, rows: DataFrame, by: str | None = None) -> None:
        """rows besides those that are there; by: a column whose values get directories of their own."""
        self.tables.setdefault(table, []).append(self._write(table, rows, by))

    def replace(self, table: str, rows: DataFrame, by: str | None = None) -> None:
        self.tables[table] = [self._write(table, rows, by)]

    def commit(self) -> int:
        """The new version's number. Raises Conflict if there is one of that number already."""
        v = self.versions
        target, temporary = (v._path(f"{v.path}/_commits/{n}") for n in (f"{self.number:08d}.json", f".{uuid.uuid4().hex}"))
        stream = v.fs.create(temporary, True)
        stream.write(bytearray(json.dumps({"tables": self.tables, "notes": self.notes}).encode()))
        stream.close()
        jvm, gateway = v.spark._jvm, v.spark.sparkContext._gateway
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: an existing target is an error
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(v.fs.getUri(), v.spark._jsc.hadoopConfiguration()).rename(v.fs.makeQualified(temporary), v.fs.makeQualified(target), options)
        except Exception as e:
            v.fs.delete(temporary, False)
            if v.fs.exists(target):
                raise Conflict(f"version {self.number} of {v.path} is there already") from e
            raise
        return self.number
