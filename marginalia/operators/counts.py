"""Counts that the relations read: marginals, pairs, ordered pairs, triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairing
from .rounds import written


def marginals(inc: DataFrame) -> DataFrame:
    """(item, c): units that hold an item (AGG-1)."""
    return inc.groupBy("item").agg(F.count("*").alias("c"))


def unit_count(inc: DataFrame) -> DataFrame:
    """(n): units that hold anything; one row."""
    return inc.agg(F.count_distinct("unit_seq").alias("n"))


def pair_rows(inc: DataFrame) -> DataFrame:
    """(group_id, unit_seq, a, b, pa, pb) with a < b (JOI-9): a self-join by unit, so its size follows the
    squares of unit sizes and no item's frequency; the pairs are counted on the map side."""
    left = inc.select("group_id", "unit_seq", F.col("item").alias("a"), F.col("pos").alias("pa"))
    right = inc.select("unit_seq", F.col("item").alias("b"), F.col("pos").alias("pb"))
    return left.join(right, "unit_seq").where("a < b")


def frequent(inc: DataFrame, least: int) -> DataFrame:
    """The rows of items that at least ``least`` units hold: no other can be in a pair of that support."""
    return inc if least <= 1 else inc.join(marginals(inc).where(F.col("c") >= least).select("item"), "item", "left_semi").select("group_id", "unit_seq", "item", "pos")


def pairs(inc: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, k, ab, ba): units that hold both, and how often each comes first; of pairs of at least that support all are here."""
    if least > 1:
        return numbered_pairs(inc, least).select("a", "b", "k", "ab", "ba")
    return pair_rows(inc).groupBy("a", "b").agg(F.count("*").alias("k"), F.sum((F.col("pa") < F.col("pb")).cast("long")).alias("ab"), F.sum((F.col("pa") > F.col("pb")).cast("long")).alias("ba"))


#: So many items at most are sent to all executors; more are joined.
SENT = 1_000_000


def numbered_pairs(inc: DataFrame, least: int, tag: Column | None = None, tags: int = 1) -> DataFrame:
    """(a, b, tag, k, ab, ba, ca, cb), a < b: pairs that at least ``least`` units hold under a tag of the unit (0 up to
    ``tags``), counted by item numbers: only items that can be in one are numbered, by name."""
    often = marginals(inc).where(F.col("c") >= least)
    known = written(often.select("item", "c", (F.row_number().over(Window.orderBy("item")) - 1).cast("int").alias("id")))  # a vocabulary; written, so that a number stays
    v = known.count()
    sent = F.broadcast if v <= SENT else lambda d: d
    rows = inc.withColumn("tag", F.lit(0) if tag is None else tag).join(sent(known.select("item", "id")), "item")
    units = written(rows.groupBy("unit_seq", "tag").agg(F.array_sort(F.collect_list(F.struct("id", "pos"))).alias("xs")).where(F.size("xs") > 1).select("tag", "xs"))  # the items of one unit, whose pairs come next
    end = lambda of, to, c: sent(known.select(F.col("id").cast("long").alias(of), F.col("item").alias(to), F.col("c").alias(c)))
    named = pairing.counted(units, v, least, tags).join(end("x", "a", "ca"), "x").join(end("y", "b", "cb"), "y")
    return named.select("a", "b", "tag", "k", F.col("xy").alias("ab"), F.col("yx").alias("ba"), "ca", "cb")


def unit_items(inc: DataFrame) -> DataFrame:
    """(group_id, unit_seq, items): one row for each unit of an incidence; units with their items already stay as they are."""
    return inc if "items" in inc.columns else inc.where(F.col("item").isNotNull()).groupBy("group_id", "unit_seq").agg(F.collect_list("item").alias("items"))


def profiles(inc: DataFrame, min_share: float = 0.0) -> DataFrame:
    """(a, b, k, span, dot, ca, cb, na, nb, n), a < b: pairs of items that a group holds, of those found in at least ``min_share`` of
    all units: units and groups whose units hold both, products of the groups' counts, marginals, norms of the groups' counts, and
    the number of units that hold such an item.  ``inc`` may be an incidence or units with their items (``unit_items``)."""
    units = written(unit_items(inc))
    c = units.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"))
    often = c.join(F.broadcast(unit_count(units))).where(F.col("c") >= min_share * F.col("n"))  # one row is broadcast
    known = written(often.select("item", "c", (F.row_number().over(Window.orderBy("item")) - 1).cast("int").alias("id")))  # a vocabulary; written, so that a number stays
    v = known.count()
    sent = F.broadcast if v <= SENT else lambda d: d
    if v <= SENT:
        ids = pairing.looked_up(units, [r["item"] for r in known.orderBy("id").collect()])
    else:
        ids = units.select("group_id", "unit_seq", F.explode("items").alias("item")).join(known, "item").groupBy("group_id", "unit_seq").agg(F.collect_list("id").alias("ids"))
    cells = written(pairing.profiled(ids, v))
    norm = cells.where("x = y and x >= 0").select(F.col("x").alias("id"), F.sqrt(F.col("dot").cast("double")).alias("norm"))
    ends = known.join(sent(norm), "id")
    end = lambda of, to: sent(ends.select(F.col("id").cast("long").alias(of), F.col("item").alias(to), F.col("c").alias(f"c{to}"), F.col("norm").alias(f"n{to}")))
    rows = cells.where("x >= 0 and x < y").join(end("x", "a"), "x").join(end("y", "b"), "y")
    return rows.join(F.broadcast(cells.where("x < 0").select(F.col("k").alias("n")))).select("a", "b", "k", "span", "dot", "ca", "cb", "na", "nb", "n")


def with_marginals(rows: DataFrame, inc: DataFrame) -> DataFrame:
    """Pair rows with ca, cb and n.  The marginals are the vocabulary: small after a cut, and left to the planner's
    own size check rather than forced to be broadcast."""
    m = marginals(inc)
    return rows.join(m.select(F.col("item").alias("a"), F.col("c").alias("ca")), "a").join(m.select(F.col("item").alias("b"), F.col("c").alias("cb")), "b").join(F.broadcast(unit_count(inc)))


def full_pairs(inc: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, k, ab, ba, ca, cb, n): pairs of at least that support with their marginals and the number of units."""
    if least > 1:
        return numbered_pairs(inc, least).drop("tag").join(F.broadcast(unit_count(inc)))
    return with_marginals(pairs(inc), inc)


def triples(inc: DataFrame, min_pair: int = 3, min_triple: int = 3) -> DataFrame:
    """(a, b, c, k): triples whose three pairs are frequent (JOI-10): frequent pairs first, then the third item."""
    often = pairs(inc).where(F.col("k") >= min_pair).select("a", "b")
    two = pair_rows(inc).select("unit_seq", "a", "b").join(often, ["a", "b"], "left_semi")
    third = two.join(inc.select("unit_seq", F.col("item").alias("c")), "unit_seq").where("b < c")
    ac, bc = often.withColumnRenamed("b", "c"), often.select(F.col("a").alias("b"), F.col("b").alias("c"))
    kept = third.join(ac, ["a", "c"], "left_semi").join(bc, ["b", "c"], "left_semi")
    return kept.groupBy("a", "b", "c").agg(F.count("*").alias("k")).where(F.col("k") >= min_triple)
