"""The corpus pipeline: documents in, token ids out.

Five stages, each one operator of graphloam.llm over all that its predecessor kept. A stage returns the columns of
documents (and any others that came in), the last one the token ids. Decisions are taken row by row: rows are told apart by
an internal id (columns __id, __odd and __gone are reserved), so a missing or repeated doc_id shields no row and condemns no other. Null texts count as empty, very long ones
are read whole; an empty table gives an empty result.

1. quality: documents that the quality classifier rejects (low quality or toxic) go. A column lang stands for the path, if
   there is one.
2. near_duplicates: of each group of documents that link at a similarity of 0.8 of five-word shingles, the one with the
   smallest doc_id stays; rows without a doc_id of their own come after those with one. Of equal rows one stays.
3. substring_dedup: words covered by 13-word windows of an earlier document are cut; n_chars follows. A document that loses
   all its words stays, with an empty text. Rows that share a doc_id don't cut each other, and rows without one are no
   reference and lose nothing.
4. decontamination: documents that contain a benchmark item (0.8 of its five-word shingles) go.
5. sentencepiece: the ids of every text, and whether they decode to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.llm import decontaminate, jaccard_join, quality, sentencepiece_codec, substring_dedup
from graphloam.llm.common import Durable

NEAR_SHINGLE, NEAR_NUMERATOR, NEAR_DENOMINATOR = 5, 80, 100
#: Internal ids from here on belong to rows without a doc_id of their own.
SPARE = 1 << 62
#: Repeated doc_ids that may be broadcast.
FEW = 100_000


def _identified(docs: DataFrame, keep: Durable) -> tuple[DataFrame, bool]:
    """docs with __id: the doc_id where it is a row's own, else a number from SPARE on that the whole row gives (62 bits of a
    hash), so that only equal rows share one; and whether there are rows of the second kind."""
    spare = F.lit(SPARE) + F.shiftrightunsigned(F.xxhash64(*(docs[c] for c in docs.columns)), 2)
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    odd = keep.keep(counted.select(F.col("doc_id").alias("__odd")))
    n = odd.count()
    if not n:
        return docs.withColumn("__id", docs["doc_id"].cast("long")), False
    odd = odd.where("__odd is not null")
    marked = docs.join(F.broadcast(odd) if n <= FEW else odd, docs["doc_id"] == odd["__odd"], "left")
    own = docs["doc_id"].isNotNull() & F.col("__odd").isNull()
    return marked.select(*docs.columns, F.when(own, docs["doc_id"].cast("long")).otherwise(spare).alias("__id")), True


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without those whose __id is among gone; a join on the id, so neither side has to be small."""
    return docs.join(gone.select(F.col("__id").alias("__gone")).distinct(), F.col("__id") == F.col("__gone"), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = _identified(docs, Durable(spark))
    scored = quality.score(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), key="__id", label_key="doc_id", path=F.col("lang") if "lang" in docs.columns else None)
    return _without(rows, scored.where("not keep")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, odd = _identified(docs, Durable(spark))
    groups = jaccard_join.jaccard_components(rows, key="__id", shingle=NEAR_SHINGLE, num=NEAR_NUMERATOR, den=NEAR_DENOMINATOR)
    stay = _without(rows, groups.where("__id <> component_id"))
    if odd:
        stay = stay.where(F.col("__id") < SPARE).unionByName(stay.where(F.col("__id") >= SPARE).dropDuplicates(docs.columns))
    return stay.select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(docs)
    changed = F.col("__n_removed") > 0
    text = F.when(changed, F.col("__kept")).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(changed, F.length("__kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return cut.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The classifier of the first stage can't be expressed in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next, and what a stage
    has written on its way is dropped with its end."""
    keep, docs = Durable(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        with Durable.scope():
            docs = keep.keep(stage(spark, docs, sf_dir))
        if before is not None:
            keep.drop(before)
        before = docs
    return docs
