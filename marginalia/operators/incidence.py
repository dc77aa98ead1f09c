"""Incidence tables: (group_id, unit_seq, item, pos), one row for each item of a unit.

``unit`` is a basket, line or day; ``group`` an ordered partition that holds units;
``pos`` the item's earliest place in its unit.  Every relation, graph and null model
reads this schema, so each adapter below makes all of them apply to its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of one document are numbered below this.
LINES = 1_000_000


def vocabulary_cut(inc: DataFrame, min_share: float) -> DataFrame:
    """Keep the items found in at least ``min_share`` of all units (FIL-3): a count, a threshold, a semi join."""
    units = inc.agg(F.count_distinct("unit_seq").alias("n"))
    common = inc.groupBy("item").count().join(F.broadcast(units)).where(F.col("count") >= min_share * F.col("n"))  # one row is broadcast
    return inc.join(common.select("item"), "item", "left_semi").select("group_id", "unit_seq", "item", "pos")


def line_words(documents: DataFrame, min_length: int = 2) -> DataFrame:
    """Words of each line of each document: letters only, in lower case, of at least ``min_length``."""
    lines = documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select(F.col("doc_id").alias("group_id"), (F.col("doc_id") * LINES + F.col("line_no") + 1).alias("unit_seq"), "line").repartition("unit_seq")  # lines are dealt whole, so their words need no exchange
    words = lines.select("group_id", "unit_seq", F.posexplode(F.split(F.lower("line"), r"[^\p{L}]+", -1)).alias("at", "item"))
    return words.where(F.length("item") >= min_length).groupBy("group_id", "unit_seq", "item").agg(F.min(F.col("at") + 1).cast("long").alias("pos"))


def line_items(documents: DataFrame, min_length: int = 2) -> DataFrame:
    """(group_id, unit_seq, items): the words of ``line_words``, one row for each line that has any, without their places."""
    lines = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("group_id"), "text").repartition("group_id")  # dealt whole, so lines under one number meet without an exchange
    lines = lines.select("group_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select("group_id", (F.col("group_id") * LINES + F.col("line_no") + 1).alias("unit_seq"), "line")
    lines = lines.groupBy("group_id", "unit_seq").agg(F.concat_ws("\n", F.collect_list("line")).alias("line"))
    words = F.filter(F.split(F.lower("line"), r"[^\p{L}]+", -1), lambda w: F.length(w) >= min_length)
    return lines.select("group_id", "unit_seq", F.array_distinct(words).alias("items")).where(F.size("items") > 0)


def lines(documents: DataFrame, min_share: float = 0.004) -> DataFrame:
    """Incidence of a text corpus: a document's lines hold the corpus's common words."""
    return vocabulary_cut(line_words(documents), min_share)


def baskets(lineitem: DataFrame, orders: DataFrame, item: str = "l_suppkey") -> DataFrame:
    """Incidence of orders: a customer's orders hold suppliers (or another column of their lines)."""
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("group_id"), F.col("l_orderkey").alias("unit_seq"), F.col(item).cast("string").alias("item")).agg(F.min("l_linenumber").cast("long").alias("pos"))


def brand_baskets(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Incidence of orders by brand."""
    return baskets(lineitem.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")), orders, "p_brand")


def user_days(events: DataFrame) -> DataFrame:
    """Incidence of events: a user's days hold event types, in order of their first time."""
    day = events.select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"), F.col("event_type").alias("item"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return day.groupBy(F.col("user_id").alias("group_id"), (F.col("user_id") * 100_000 + F.col("day")).alias("unit_seq"), "item").agg(F.min("at").alias("pos"))
