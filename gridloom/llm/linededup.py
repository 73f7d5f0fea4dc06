"""Line dedup by the spread over distinct sites.

A line with a word that stands on at least ``SITES`` distinct sites is
boilerplate: it stays where it comes first, by document and then by line, and goes everywhere
else. Lines that come too seldom, or from one site, are told by plain counts.
For the rest a HyperLogLog sketch of the sites is built for each line hash
and merged by aggregation; only lines whose estimate is within ``NEAR`` of the
threshold get an exact count.

A line is what stands between line feeds, byte for byte. A null text stays null
and has no lines; null sites are one site, of no name. ``doc_id`` tells documents
apart: rows with a null id keep their text, and repeated rows lose the same lines.
A document of any length is cut within its task. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table, written

SITES = 5
#: Part of the threshold within which an estimate isn't trusted; four standard errors at 2**12 registers are 0.065.
NEAR = 0.25
REGISTERS_LOG2 = 12
#: Boilerplate lines, of four numbers each, that are sent to all executors; beyond it they are joined by a shuffle.
BROADCAST_LINES = 200_000
_WORD = r"[^\x20\x09-\x0D]"


def _near(lines: DataFrame) -> DataFrame:
    """Broadcast where the lines are few, which is counted, so that their many places aren't shuffled to find them."""
    return F.broadcast(lines) if lines.count() <= BROADCAST_LINES else lines


def boilerplate(docs: DataFrame, sites: int = SITES, id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(id, gone): the positions, from 0, of the lines that a document loses."""
    # The scan can't hold what a column of the input is called, so names are of our own from here.
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("t"), F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit(""))).alias("site")).where("id IS NOT NULL AND t IS NOT NULL")
    lines = rows.select("id", "site", F.posexplode(F.split("t", "\n", -1)).alias("no", "line")).where(F.col("line").rlike(_WORD))
    lines = lines.select("id", "site", "no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(9), "line").alias("g"))
    often = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi")).where((F.col("n") >= sites) & (F.col("lo") != F.col("hi"))).select("h", "g")
    # A table of its own, so that a line of very many rows is broadcast to, or else dealt anew by the join.
    often = written(often, "often")
    lines = written(lines.join(_near(often), ["h", "g"]), "lines")
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", REGISTERS_LOG2).alias("sketch")).select("h", "g", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = written(spread.where(F.col("estimate") >= sites * (1 - NEAR)), "spread")
    close = spread.where(F.col("estimate") <= sites * (1 + NEAR)).select("h", "g")
    exact = lines.join(_near(written(close, "close")), ["h", "g"]).select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h", "g")
    wide = written(spread.where(F.col("estimate") > sites * (1 + NEAR)).select("h", "g").unionByName(exact), "wide")
    found = lines.join(_near(wide), ["h", "g"])
    # The first place of each line in two plain minima, which are summed up before they are dealt out.
    first = written(found.groupBy("h", "g").agg(F.min(F.struct("id", "no")).alias("first")), "first")
    gone = found.join(_near(first), ["h", "g"]).where((F.col("id") != F.col("first.id")) | (F.col("no") != F.col("first.no")))
    return gone.groupBy("id").agg(F.collect_set("no").alias("gone"))


def dedup_lines(docs: DataFrame, sites: int = SITES, id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` without the boilerplate lines in ``text``; with them go their line feeds."""
    gone = boilerplate(docs, sites, id, text, site).select(F.col("id").alias("_line_id"), F.col("gone").alias("_line_gone"))
    joined = docs.join(gone, docs[id] == gone["_line_id"], "left")
    new = F.when(F.col("_line_gone").isNull(), docs[text]).otherwise(F.array_join(F.filter(F.split(docs[text], "\n", -1), lambda x, i: ~F.array_contains("_line_gone", i)), "\n"))
    return joined.select(*(new.alias(c) if c == text else docs[c] for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    gone = boilerplate(docs).withColumnRenamed("id", "doc_id")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(gone, "doc_id", "left")
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept), 256).alias("kept_sha256"))


ORACLE_OP3 = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM d
), b AS (
  SELECT line, min(struct_pack(d := doc_id, n := no)) AS first FROM l
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY line HAVING count(DISTINCT site) >= {SITES}
), m AS (
  SELECT l.doc_id, l.no, l.line, (b.line IS NOT NULL AND struct_pack(d := l.doc_id, n := l.no) <> b.first) AS gone
  FROM l LEFT JOIN b ON l.line = b.line
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
