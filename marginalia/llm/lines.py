"""Line dedup by distinct-site spread (operator 7); DataFrame functions only.

A line's spread is the number of distinct sites (``source``) that carry it.  One
HyperLogLog sketch per line hash, merged by aggregation, estimates every line's
spread; a line whose estimate lies near the threshold gets an exact distinct
count, so the decision is exact.  Lines of at least ``min_sites`` sites are
boilerplate and leave every document.  Only a document that would be left without any
text stays whole: it has nothing of its own, and is a copy for near-duplicate removal.

Lines are what newline characters separate, compared as they stand.  A blank line
(empty, or spaces only; a line of tabs or carriage returns is text) is never boilerplate.  A null site counts for no site; a null text stays null, with
no lines; an empty one has one blank line.  Repeated rows are one site like any
other rows of their source, and each is cleaned.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_SITES = 10
#: log2 of the sketch's registers, and how far an estimate may be off (its error at 4096 registers is
#: 1.6 %, and counts of this size are kept almost exactly) before an exact count decides.
LG_K, NEAR = 12, 0.2
#: Up to so many boilerplate hashes (8 bytes each) travel inside the plan; beyond, by a join.
IN_PLAN = 20_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _hashed(docs: DataFrame) -> DataFrame:
    """(line hash, site) of every line that isn't blank."""
    line = F.explode(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")).alias("line")
    return docs.where(F.col("source").isNotNull()).select("source", line).select(_hash(F.col("line")).alias("h"), "source")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h): hashes of the lines found on at least ``min_sites`` distinct sites."""
    sites = _hashed(docs)
    spread = sites.groupBy("h").agg(F.hll_sketch_agg("source", LG_K).alias("sketch")).select("h", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = C.staged(docs.sparkSession, spread.where(F.col("sites") >= min_sites * (1 - NEAR)), "line-spread")
    near = likely.where(F.col("sites") <= min_sites * (1 + NEAR))
    exact = sites.join(near.select("h"), "h", "left_semi").groupBy("h").agg(F.countDistinct("source").alias("sites"))
    sure = likely.where(F.col("sites") > min_sites * (1 + NEAR)).select("h")
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h"))


def _cleaned(flagged: Column, lines: Column) -> list[Column]:
    """Kept text and counts from parallel arrays of lines and boilerplate flags."""
    pairs = F.arrays_zip(lines.alias("line"), flagged.alias("flag"))
    gone = F.filter(pairs, lambda p: p["flag"])
    own = F.exists(pairs, lambda p: ~p["flag"] & (F.trim(p["line"]) != ""))
    out = F.array_join(F.transform(F.filter(pairs, lambda p: ~p["flag"]), lambda p: p["line"]), "\n")
    return [F.when(own, out).otherwise(F.col("text")), F.size(lines).cast("long"), F.when(own, F.size(gone)).otherwise(0).cast("long")]


def remove(docs: DataFrame, lines: DataFrame, in_plan: int = IN_PLAN) -> DataFrame:
    """``docs`` with columns ``__text, __n_lines, __n_removed`` after the boilerplate ``lines`` (h) have gone.

    Few hashes (their number is checked) are looked up in place, without moving a text.  More are
    joined by hash as (row, position, hash), and only the positions to remove meet the texts again.
    """
    spark = docs.sparkSession
    lines = C.staged(spark, lines, "boilerplate")
    names = ["__text", "__n_lines", "__n_removed"]
    if lines.limit(in_plan + 1).count() <= in_plan:
        known = [r["h"] for r in lines.collect()]
        flag = (lambda x: (F.trim(x) != "") & _hash(x).isin(known)) if known else (lambda x: F.lit(False))
        own = docs.withColumn("__lines", _lines(F.col("text")))
        cols = _cleaned(F.transform("__lines", flag), F.col("__lines"))
    else:
        rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
        at = rows.select("__row", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where(F.trim("line") != "").select("__row", "pos", _hash(F.col("line")).alias("h"))
        found = at.join(lines, "h", "left_semi").groupBy("__row").agg(F.collect_set("pos").alias("__gone"))  # a document's own lines: no group is larger
        own = rows.join(found, "__row", "left").withColumn("__lines", _lines(F.col("text"))).withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
        cols = _cleaned(F.transform("__lines", lambda _, i: F.array_contains("__gone", i)), F.col("__lines"))
    empty = F.col("text").isNull()
    made = [F.when(empty, F.lit(None).cast("string")).otherwise(cols[0]), *(F.when(empty, F.lit(0).cast("long")).otherwise(c) for c in cols[1:])]
    return own.select(*docs.columns, *(c.alias(n) for c, n in zip(made, names, strict=True)))


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, in_plan: int = IN_PLAN) -> DataFrame:
    """doc_id, text without boilerplate lines, n_lines, n_removed."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    out = remove(own, boilerplate(own, min_sites), in_plan)
    return out.select("doc_id", F.col("__text").alias("text"), F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def rewritten(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of ``docs``, with the text cleaned and its length in ``n_chars`` brought up to date."""
    out = remove(docs, boilerplate(docs.select("text", "source"), min_sites))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(C.table(spark, sf_dir, "documents"))


def _sql() -> str:
    """DuckDB SQL of the query, from exact counts."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT r, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE text IS NOT NULL
), b AS (
  SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), f AS (
  SELECT l.r, l.i, l.line, b.line IS NOT NULL AS gone, trim(l.line, ' ') = '' AS blank FROM l LEFT JOIN b ON l.line = b.line
), a AS (
  SELECT r, count(*) AS n, count(*) FILTER (gone) AS g, count(*) FILTER (NOT gone AND NOT blank) AS own,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept
  FROM f GROUP BY r
)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL WHEN a.own > 0 THEN a.kept ELSE d.text END AS text,
       CAST(coalesce(a.n, 0) AS BIGINT) AS n_lines,
       CAST(CASE WHEN d.text IS NOT NULL AND a.own > 0 THEN a.g ELSE 0 END AS BIGINT) AS n_removed
FROM d LEFT JOIN a ON d.r = a.r
"""


OP7_SQL = _sql()
