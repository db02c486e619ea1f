"""Fill-in-middle transformation: DuckDB inside mapInArrow.

Every Arrow batch of documents is registered with a DuckDB connection of the worker's own, one SQL statement cuts the texts,
deals the forms and writes the outputs, and its Arrow result goes back; Python touches no row. What decides about a document
is the SHA-256 of a seed and its key, so a document gets the same form and the same cuts in every run and partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloam.llm.common import documents, small_batches, spread

SEED = 42
#: Of 100 documents, those that are transformed; of 100 of these, those that get the suffix first.
RATE, SUFFIX_FIRST = 50, 80
# The marks of prefix, suffix and middle, and the units that a text is cut into.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What the operator can return for a document, besides its key.
COLUMNS = {
    "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long",
    "output": "string", "restored": "string", "output_sha256": "string", "restored_sha256": "string",
}
#: Memory of a worker's DuckDB; it never spills, as its folder would be the machine's own.
MEMORY = "1GB"


def _number(group: int) -> str:
    """A group of eight hex digits of the document's hash, as an integer."""
    return f"('0x' || substr(hash, {8 * group - 7}, 8))::BIGINT"


def statement(columns: list[str], seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> str:
    """The SQL over a table `batch` (key, text)."""
    return f"""
WITH cut AS (SELECT key, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units,
    sha256('{seed}:' || coalesce(key::VARCHAR, '')) AS hash FROM batch),
dealt AS (SELECT key, text, units, len(units) AS n, {_number(1)} % (len(units) + 1) AS x, {_number(2)} % (len(units) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_number(3)} % 100 >= {rate} THEN 'plain'
         WHEN {_number(4)} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT key, text, n, form,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, least(x, y)), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, least(x, y) + 1, greatest(x, y)), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, greatest(x, y) + 1, n), '') END AS suffix FROM dealt),
written AS (SELECT key, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM parts),
back AS (SELECT *, {restoring('output', 'form')} AS restored FROM written)
SELECT key, {', '.join(f'sha256({c[:-7]}) AS {c}' if c.endswith('_sha256') else c for c in columns)} FROM back"""


def restoring(output: str, form: str) -> str:
    """SQL for the text that an output of a form was made from. The marks are not in the text, so each is found where it was
    put."""
    first = f"CASE {form} WHEN 'psm' THEN split_part({output}, '{SUFFIX}', 1) ELSE split_part({output}, '{PREFIX}', 1) END"
    second = f"CASE {form} WHEN 'psm' THEN split_part({output}, '{SUFFIX}', 2) ELSE split_part({output}, '{PREFIX}', 2) END"
    one, two = f"substr({first}, {len(PREFIX) + 1})", f"split_part({second}, '{MIDDLE}', 1)"
    middle = f"split_part({second}, '{MIDDLE}', 2)"
    return f"CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN {one} || {middle} || {two} ELSE {two} || {middle} || {one} END"


def _connection() -> duckdb.DuckDBPyConnection:
    """One for a worker."""
    if not _connections:
        _connections.append(duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": True}))
    return _connections[0]


_connections: list[duckdb.DuckDBPyConnection] = []


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"), seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(key, *columns) for every row, without a shuffle; columns are of COLUMNS.

    n: units of the text. form: plain (the text as it is), psm or spm; output: what is trained on; restored: the text rebuilt
    from output and form. Null texts count as empty, and empty ones are plain; texts that hold one of the marks are plain. Very
    long texts are cut whole. A null key is hashed as no digits; rows that repeat a key are dealt alike, each by its own units.
    Ties (both cuts at one place) give an empty middle. An empty table gives no rows. Other columns, of whatever name, are not
    read.
    """
    sql, kind = statement(list(columns), seed, rate, suffix_first), dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _connection()
        for batch in batches:
            db.register("batch", pa.Table.from_batches([pa.RecordBatch.from_arrays(batch.columns, names=["key", "text"])]))
            try:
                yield from db.sql(sql).to_arrow_table().rename_columns([key, *columns]).to_batches()
            finally:
                db.unregister("batch")

    small_batches(docs.sparkSession)
    return spread(docs.select(key, text)).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{c} {COLUMNS[c]}" for c in columns)]))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of the output and of the text rebuilt from it, for every document."""
    return fill_in_middle(documents(spark, sf_dir), columns=("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"))


# the same rows by code points: units by their lengths, cuts as substrings
ORACLES = {
    "op12_fill_in_middle": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda u: length(u)) AS sizes, sha256('42:' || doc_id) AS h FROM documents),
e AS (SELECT doc_id, t, sizes, len(sizes) AS n, list_transform([1, 9, 17, 25], lambda i: list_reduce(list_transform(range(8), lambda j: strpos('0123456789abcdef', substr(h, (i + j)::BIGINT, 1)) - 1), lambda a, b: 16 * a + b)) AS v FROM d),
f AS (SELECT doc_id, t, n, coalesce(list_sum(sizes[1:least(v[1] % (n + 1), v[2] % (n + 1))]), 0)::BIGINT AS p, coalesce(list_sum(sizes[1:greatest(v[1] % (n + 1), v[2] % (n + 1))]), 0)::BIGINT AS q,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR v[3] % 100 >= 50 THEN 'plain' WHEN v[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', substr(t, 1, p), '<S>', substr(t, q + 1), '<M>', substr(t, p + 1, q - p)) ELSE concat('<S>', substr(t, q + 1), '<P>', substr(t, 1, p), '<M>', substr(t, p + 1, q - p)) END AS o FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars, sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM g"""
}
