"""Directed flow over a small vocabulary: order within units, adjacency between units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import relations as R


def within(inc: DataFrame) -> DataFrame:
    """(src, tgt, k): items of a unit in the order of their positions; ties say nothing."""
    a = inc.select("unit_seq", F.col("item").alias("src"), F.col("pos").alias("p"))
    b = inc.select("unit_seq", F.col("item").alias("tgt"), F.col("pos").alias("q"))
    return a.join(b, "unit_seq").where("src <> tgt and p < q").groupBy("src", "tgt").agg(F.count("*").alias("k"))


def across(inc: DataFrame, raw_step: int | None = None) -> DataFrame:
    """(src, tgt, k): items of one unit and of the next: next among units that hold anything (FLO-1), or ``raw_step``
    further in the unit number itself (FLO-2); always of one group."""
    if raw_step is None:
        at = inc.select("group_id", "unit_seq", "item").join(R.numbered_units(inc), ["group_id", "unit_seq"]).select("group_id", F.col("rn").alias("t"), "item")
        step = 1
    else:
        at, step = inc.select("group_id", F.col("unit_seq").alias("t"), "item"), raw_step
    return at.select("group_id", (F.col("t") + step).alias("t"), F.col("item").alias("src")).join(at.select("group_id", "t", F.col("item").alias("tgt")), ["group_id", "t"]).where("src <> tgt").groupBy("src", "tgt").agg(F.count("*").alias("k"))


def flow(inc: DataFrame, raw_step: int | None = None) -> DataFrame:
    """(src, tgt, k): both kinds together."""
    return within(inc).unionByName(across(inc, raw_step)).groupBy("src", "tgt").agg(F.sum("k").alias("k"))


def oriented(flows: DataFrame, min_support: int = 8) -> DataFrame:
    """FLO-3: (src, tgt, total, direction): each pair the way it mostly goes; an even pair by name."""
    pair = flows.groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.sum(F.when(F.col("src") < F.col("tgt"), F.col("k")).otherwise(0)).alias("f"), F.sum(F.when(F.col("src") > F.col("tgt"), F.col("k")).otherwise(0)).alias("g"))
    ahead = F.col("f") >= F.col("g")
    rows = pair.withColumn("total", F.col("f") + F.col("g")).where(F.col("total") >= min_support)
    return rows.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("tgt"), "total", (F.greatest("f", "g") / F.col("total")).alias("direction"))


def net_outflow(flows: DataFrame) -> DataFrame:
    """FLO-4: (node, out, into, net)."""
    ends = flows.select(F.col("src").alias("node"), F.col("k").alias("out"), F.lit(0).cast("long").alias("into")).unionByName(flows.select(F.col("tgt").alias("node"), F.lit(0).cast("long").alias("out"), F.col("k").alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).withColumn("net", F.col("out") - F.col("into"))


def into_classes(flows: DataFrame, classes: DataFrame) -> DataFrame:
    """FLO-5: (src, class, k): flow into pseudo-nodes, each a set of items (class, item)."""
    return flows.join(classes.select(F.col("item").alias("tgt"), "class"), "tgt").join(classes.select(F.col("item").alias("src"), F.col("class").alias("own")), "src", "left").where("own is null or own <> class").groupBy("src", "class").agg(F.sum("k").alias("k"))


def stable(first: DataFrame, second: DataFrame, margin: float = 0.6) -> DataFrame:
    """FLO-8: (src, tgt, d1, d2, kept): whether an edge goes the same way in both halves, and clearly so."""
    a, b = oriented(first), oriented(second)
    back = b.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), (1 - F.col("direction")).alias("d2"))
    both = b.select("src", "tgt", F.col("direction").alias("d2")).unionByName(back)
    return a.select("src", "tgt", F.col("direction").alias("d1")).join(both, ["src", "tgt"]).select("src", "tgt", "d1", "d2", ((F.col("d1") >= margin) & (F.col("d2") >= margin)).alias("kept"))
