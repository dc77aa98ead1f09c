"""What the query modules share: tables, incidence views and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incidence as I
from ..operators.rounds import written
from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Ratios and logarithms are rounded where a result leaves the library (PRJ-11)."""
    return df.withColumns({n: F.round(n, digits) for n in names})


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all lines, tokenised once and read back as often as a query needs them."""
    return written(I.line_words(table(spark, sf_dir, "documents")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common words of all lines (the vocabulary cut, FIL-3), tokenised once."""
    return written(I.lines(table(spark, sf_dir, "documents")))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.baskets(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.brand_baskets(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_days(table(spark, sf_dir, "events"))


_LINES = f"""
raw_ AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
line_ AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM raw_),
split_ AS (SELECT doc_id, doc_id * {I.LINES} + line_no AS unit_seq, string_split_regex(lower(line), '[^\\p{{L}}]+') AS ws FROM line_),
word_ AS (SELECT doc_id AS group_id, unit_seq, unnest(ws) AS item, unnest(range(1, len(ws) + 1)) AS pos FROM split_),
first_ AS MATERIALIZED (SELECT group_id, unit_seq, item, min(pos) AS pos FROM word_ WHERE length(item) >= 2 GROUP BY ALL),
voc_ AS (SELECT item FROM first_ GROUP BY item HAVING count(*) >= 0.004::DOUBLE * (SELECT count(DISTINCT unit_seq) FROM first_)),
inc AS MATERIALIZED (SELECT f.* FROM first_ f JOIN voc_ USING (item))"""
_WORDS = _LINES[: _LINES.index("voc_ AS")] + "inc AS MATERIALIZED (SELECT * FROM first_)"
_BASKETS = """
inc AS MATERIALIZED (SELECT o_custkey AS group_id, l_orderkey AS unit_seq, CAST(l_suppkey AS VARCHAR) AS item, min(l_linenumber)::BIGINT AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
_BRANDS = """
inc AS MATERIALIZED (SELECT o_custkey AS group_id, l_orderkey AS unit_seq, p_brand AS item, min(l_linenumber)::BIGINT AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
_DAYS = """
inc AS MATERIALIZED (SELECT user_id AS group_id, user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS unit_seq, event_type AS item, min(epoch_us(ts)) AS pos
  FROM events GROUP BY ALL)"""
_COUNTS = """,
m AS MATERIALIZED (SELECT item, count(*) AS c FROM inc GROUP BY item),
nn AS MATERIALIZED (SELECT count(DISTINCT unit_seq) AS n FROM inc),
pr AS MATERIALIZED (SELECT x.item AS a, y.item AS b, count(*) AS k, sum((x.pos < y.pos)::INT)::BIGINT AS ab, sum((x.pos > y.pos)::INT)::BIGINT AS ba
  FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item < y.item GROUP BY 1, 2),
pm AS MATERIALIZED (SELECT pr.*, x.c AS ca, y.c AS cb, n FROM pr JOIN m x ON x.item = a JOIN m y ON y.item = b, nn),
orn AS MATERIALIZED (SELECT a AS src, b AS tgt, k, ca AS c_src, cb AS c_tgt, n FROM pm UNION ALL SELECT b, a, k, cb, ca, n FROM pm)"""
#: Pairs of words are asked for with a support of 5 at least, which rarer words can't reach.
_FREQUENT = _COUNTS.replace("pr AS MATERIALIZED", "fr AS MATERIALIZED (SELECT i.* FROM inc i SEMI JOIN (SELECT item FROM m WHERE c >= 5) USING (item)),\npr AS MATERIALIZED").replace("FROM inc x JOIN inc y", "FROM fr x JOIN fr y")
_CTE = {"words": _WORDS, "lines": _LINES, "baskets": _BASKETS, "brands": _BRANDS, "days": _DAYS}


def sql(source: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """SQL over an incidence view with its counts: ``inc, m, nn, pr, pm, orn``; of ``words``, pairs of words in five units at least."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{_CTE[source].strip()}{_FREQUENT if source == 'words' else _COUNTS}{',' if extra else ''}{extra}\n{body}"
