"""Source files over the test tables: every part is a file in one of four languages, with a few shared files that have neither
classes nor functions. SQL knows the same files, so what the parsers find can be compared with what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.functions import text

# @k: the part's number; @b: the number of a shared file.
TYPESCRIPT = """import { Injectable } from '@nestjs/common'
import { Base } from './base@b.ts'
const tick = /[`{]/
export class Part@k extends Base implements Kind, Sized {
  async price(q: number): Promise<number> {
    return q
  }
  size() { return `s ${`t ${tick}`}` }
}
export function make@k(x: number): Part@k {
  return new Part@k()
}
"""
JAVASCRIPT = """import express from 'express'
import { shared } from '../src/base@b.ts'
function helper@k(a, b) {
  return a / b / 2
}
export default function main@k() {
  return <p>it's {"}"} in part</p>
}
"""
JAVA = """package parts;
import org.springframework.stereotype.Service;
@Service
public abstract class Part@k extends Base implements Kind {
  public int price(int q, String s) {
    return q;
  }
}
"""
PYTHON = """import os
from .base@b import Base as B
class Part@k(Base, Kind):
    def price(self, q) -> int:
        return q

async def make@k(x, *rest):
    return x
"""
SHARED = "export const base@b = @b\nexport const other = 1\n"
#: What a file of pieces may hold: source, and its facts (what, owner, name, first and last line within the piece).
PIECES = [
    ("function cond@k(x) { if (x) /`/.test(x) }\n", [("function", "", "cond@k", 1, 1)]),
    ("export const same@k = <T extends unknown>(x: T) => x\n", [("export", "", "same@k", 0, 0)]),
    ("export class Box@k<T,> extends Base<T> {\n  held = /['\"]/\n  get(a: number) { return this.a / 2 / a }\n}\n", [("export", "", "Box@k", 0, 0), ("class", "", "Box@k", 1, 4), ("method", "Box@k", "get", 3, 3)]),
    ("export function View@k() {\n  return <Row<string> icon={<B />} text=\"it's\">{/* ` */}{a / b}</Row>\n}\n", [("export", "", "View@k", 0, 0), ("function", "", "View@k", 1, 3)]),
    ("const t@k = `a ${`b ${ {c: \"}\"}.c }`} {`\n", []),
    ("import x@k, { y as z } from './m@k'\n", [("import", "", "./m@k", 0, 0)]),
    ("switch (q) {\n  case /{/: { break }\n  default: { go() } /`/.test(q)\n}\n", []),
    ("export abstract class Last@k { m(): void { for (const a of /[}]/g.exec(s)!) a++ / 2 } }\n", [("export", "", "Last@k", 0, 0), ("class", "", "Last@k", 1, 1), ("method", "Last@k", "m", 1, 1)]),
    ("export async function run@k<T>(x: T): Promise<T> {\n  return x\n}\n", [("export", "", "run@k", 0, 0), ("function", "", "run@k", 1, 3)]),
    ("let u@k = v! / 2, w = (a) / `/`.length\n", []),
]
PATHS = ["src/part@k.service.ts", "src/part@k.js", "src/Part@k.java", "src/part@k.py", "src/base@b.ts"]
SOURCES = [TYPESCRIPT, JAVASCRIPT, JAVA, PYTHON, SHARED]
REPOSITORIES, BASES = 5, 7


def _choose(kind: Column, texts: list[str], k: Column, b: Column) -> Column:
    chosen = F.element_at(F.array(*map(F.lit, texts)), (kind + 1).cast("int"))
    return F.replace(F.replace(chosen, F.lit("@k"), k.cast("string")), F.lit("@b"), b.cast("string"))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' numbers, dealt over the shuffle partitions: a few MB of them stand for gigabytes of files, which would be read
    and parsed in the few tasks that a table of such a size is cut into."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repositoryId, path, content, contentHash) of all files."""
    k = F.col("p_partkey")
    parts = _dealt(spark, sf_dir).select(k.alias("k"), (k % 4).alias("kind"), (k % BASES).alias("b"), F.concat(F.lit("r"), (k % REPOSITORIES).cast("string")).alias("repositoryId"))
    shared = parts.select("repositoryId").distinct().withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BASES - 1).cast("long")))).select(F.lit(0).cast("long").alias("k"), F.lit(4).cast("long").alias("kind"), "b", "repositoryId")
    rows = parts.unionByName(shared)
    content = _choose(F.col("kind"), SOURCES, F.col("k"), F.col("b"))
    return rows.select("repositoryId", _choose(F.col("kind"), PATHS, F.col("k"), F.col("b")).alias("path"), content.alias("content"), text.content_hash(content).alias("contentHash"))


def _holds(k: Column, i: int) -> Column:
    return F.floor(k * 7919 / 2**i) % 2 == 1


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repositoryId, path, content, contentHash): a file for every part, of those pieces that its number chooses."""
    k = F.col("p_partkey")
    content = F.concat(*(F.when(_holds(k, i), F.replace(F.lit(t), F.lit("@k"), k.cast("string"))).otherwise("") for i, (t, _) in enumerate(PIECES)))
    return _dealt(spark, sf_dir).select(F.lit("r").alias("repositoryId"), F.concat(F.lit("src/p"), k.cast("string"), F.lit(".tsx")).alias("path"), content.alias("content"), text.content_hash(content).alias("contentHash"))


def _sql_text(texts: list[str]) -> str:
    quoted = ", ".join("'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for t in texts)
    return f"replace(replace(([{quoted}])[(kind + 1)::INTEGER], '@k', k::VARCHAR), '@b', b::VARCHAR)"


#: (repo, kind, k, b, path, content) of the same files, as the beginning of a statement.
SOURCES_SQL = f"""WITH RECURSIVE part0 AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, p_partkey % {BASES} AS b, 'r' || (p_partkey % {REPOSITORIES}) AS repo FROM part),
src AS (SELECT *, repo || ':' || path AS fid FROM (SELECT repo, kind, k, b, {_sql_text(PATHS)} AS path, {_sql_text(SOURCES)} AS content
  FROM (SELECT * FROM part0 UNION ALL SELECT 0, 4, b, repo FROM (SELECT DISTINCT repo FROM part0), (SELECT unnest(range({BASES})) AS b))))"""

#: The facts of the files of pieces.
PIECES_SQL = f"""SELECT 'src/p' || p_partkey || '.tsx' AS path, what, replace(owner, '@k', p_partkey::VARCHAR) AS owner, replace(name, '@k', p_partkey::VARCHAR) AS name,
  (CASE WHEN first > 0 THEN first + above ELSE 0 END)::INTEGER AS first, (CASE WHEN first > 0 THEN last + above ELSE 0 END)::INTEGER AS last
FROM (SELECT p_partkey, i, sum(lines) OVER (PARTITION BY p_partkey ORDER BY i) - lines AS above
  FROM part, (VALUES {", ".join(f"({i}, {t.count(chr(10))})" for i, (t, _) in enumerate(PIECES))}) AS piece(i, lines) WHERE (p_partkey * 7919 // (1 << i)) % 2 = 1)
JOIN (VALUES {", ".join(f"({i}, '{what}', '{owner}', '{name}', {first}, {last})" for i, (_, facts) in enumerate(PIECES) for what, owner, name, first, last in facts)}) AS fact(i, what, owner, name, first, last) USING (i)"""
