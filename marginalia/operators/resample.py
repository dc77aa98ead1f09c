"""Resampling without generators: every draw is read off an md5 of (seed, repetition, key), so a result is the
same however rows are dealt, and SQL elsewhere gives the same one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column | int | str) -> Column:
    """A whole number of 32 bits from the md5 of the parts, joined by |."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def order_key(*parts: Column | int | str) -> Column:
    """A hexadecimal key to order by."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def repetitions(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def numbered(units: DataFrame, key: str, group: str) -> DataFrame:
    """Units with their number from 0 and the size of their group."""
    w = Window.partitionBy(group)
    return units.withColumn("i", (F.row_number().over(w.orderBy(key)) - 1).cast("long")).withColumn("n", F.count("*").over(w))


def bootstrap(units: DataFrame, key: str, group: str, reps: int, seed: int = 1) -> DataFrame:
    """RES-1: (rep, group, key): as many units of each group as it has, drawn with replacement: each place draws a number and joins it."""
    own = numbered(units.select(group, key), key, group)
    places = repetitions(own.select(group, "i", "n"), reps).select("rep", group, (draw(seed, F.col("rep"), F.col(group), F.col("i")) % F.col("n")).alias("i"))
    return places.join(own.select(group, "i", key), [group, "i"]).select("rep", group, key)


def subsample(units: DataFrame, key: str, group: str, share: float, reps: int, seed: int = 1) -> DataFrame:
    """RES-2: (rep, group, key): a share of each group's units, without replacement: the first by hashed order."""
    w = Window.partitionBy("rep", group)
    rows = repetitions(units.select(group, key), reps).withColumn("r", F.row_number().over(w.orderBy(order_key(seed, F.col("rep"), F.col(key)), key))).withColumn("n", F.count("*").over(w))
    return rows.where(F.col("r") <= F.floor(share * F.col("n"))).select("rep", group, key)


def shuffled_in_unit(inc: DataFrame, seed: int = 1) -> DataFrame:
    """RES-7: positions within each unit dealt anew."""
    w = Window.partitionBy("unit_seq").orderBy(order_key(seed, F.col("unit_seq"), F.col("item")), "item")
    return inc.select("group_id", "unit_seq", "item", F.row_number().over(w).cast("long").alias("pos"))


def shuffled_units(inc: DataFrame, seed: int = 1) -> DataFrame:
    """RES-7: each group's units keep their content and deal their places anew; after ``shuffled_in_unit``, the joint null."""
    w = Window.partitionBy("group_id")
    units = inc.select("group_id", "unit_seq").distinct()
    places = units.select("group_id", F.col("unit_seq").alias("place"), F.row_number().over(w.orderBy("unit_seq")).alias("i"))
    dealt = units.select("group_id", "unit_seq", F.row_number().over(w.orderBy(order_key(seed, F.col("unit_seq")), "unit_seq")).alias("i"))
    return inc.join(dealt.join(places, ["group_id", "i"]).drop("i"), ["group_id", "unit_seq"]).select("group_id", F.col("place").alias("unit_seq"), "item", "pos")


def shuffled_labels(rows: DataFrame, key: str, label: str, group: str, seed: int = 1) -> DataFrame:
    """RES-10: labels of each group dealt anew among its keys: numbers by key meet numbers by hash."""
    w = Window.partitionBy(group)
    a = rows.select(group, key, F.row_number().over(w.orderBy(key)).alias("i"))
    b = rows.select(group, label, F.row_number().over(w.orderBy(order_key(seed, F.col(key)), key)).alias("i"))
    return a.join(b, [group, "i"]).select(group, key, label)


def stride_drop(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """RES-14: every k-th row of each group left out: a fixed perturbation."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("i", F.row_number().over(w) - 1).where(F.col("i") % k != 0).drop("i")


def shuffled_tokens(inc: DataFrame, seed: int = 1) -> DataFrame:
    """RES-3: all (unit, item) tokens of a group in hashed order, dealt to the places of its units; an item twice
    in a unit counts once, so frequencies are kept up to those meetings."""
    w = Window.partitionBy("group_id")
    places = inc.select("group_id", "unit_seq", F.row_number().over(w.orderBy("unit_seq", "item")).alias("i"))
    tokens = inc.select("group_id", "item", F.row_number().over(w.orderBy(order_key(seed, F.col("unit_seq"), F.col("item")), "unit_seq", "item")).alias("i"))
    return places.join(tokens, ["group_id", "i"]).groupBy("group_id", "unit_seq", "item").agg(F.min("i").cast("long").alias("pos"))


def noisy_edges(edges: DataFrame, share: float, reps: int, seed: int = 1) -> DataFrame:
    """RES-6: each edge stays with probability 1 - share."""
    limit = int((1 << 32) * share)
    return repetitions(edges, reps).where(draw(seed, F.col("rep"), F.col("src"), F.col("tgt")) >= limit)


def rewired_edges(edges: DataFrame, share: float, reps: int, seed: int = 1, buckets: int = 16) -> DataFrame:
    """RES-6: (rep, src, tgt): about ``share`` of all edges meet in twos and exchange their targets.

    An exchange that would make a loop, an edge of the graph, or an edge that another exchange makes too is left
    undone, so every node keeps its in- and out-degree and no edge is found twice.  Edges meet within ``buckets``
    hashed parts of a repetition: raise it with the graph.
    """
    limit = int((1 << 32) * share)
    own = edges.select("src", "tgt").distinct()
    rows = repetitions(own, reps)
    key = order_key(seed, F.col("rep"), F.col("src"), F.col("tgt"))
    part = rows.where(draw(seed, F.col("rep"), F.col("src"), F.col("tgt")) < limit).withColumn("bucket", draw(seed, "bucket", F.col("rep"), F.col("src"), F.col("tgt")) % buckets)
    at = part.withColumn("r", F.row_number().over(Window.partitionBy("rep", "bucket").orderBy(key, "src", "tgt")) - 1).withColumn("duo", F.floor(F.col("r") / 2))
    end = lambda c, n: F.max(F.when(F.col("r") % 2 == n, F.col(c)))
    duos = at.groupBy("rep", "bucket", "duo").agg(end("src", 0).alias("a"), end("tgt", 0).alias("b"), end("src", 1).alias("c"), end("tgt", 1).alias("d"))
    duos = duos.where((F.col("a") != F.col("c")) & (F.col("b") != F.col("d")) & (F.col("a") != F.col("d")) & (F.col("c") != F.col("b")) & (F.col("a") != F.col("b")) & (F.col("c") != F.col("d")))
    id_ = ["rep", "bucket", "duo"]
    ends = lambda d, *of: d.select(*id_, F.explode(F.array(*(F.struct(F.col(x).alias("src"), F.col(y).alias("tgt")) for x, y in of))).alias("e")).select(*id_, "e.src", "e.tgt")
    made = ends(duos, ("a", "d"), ("c", "b"))
    twice = made.groupBy("rep", "src", "tgt").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    void = made.join(own, ["src", "tgt"], "left_semi").select(*id_).unionByName(made.join(twice, ["rep", "src", "tgt"], "left_semi").select(*id_)).distinct()
    done = duos.join(void, id_, "left_anti")
    gone = ends(done, ("a", "b"), ("c", "d")).select("rep", "src", "tgt")
    return rows.select("rep", "src", "tgt").join(gone, ["rep", "src", "tgt"], "left_anti").unionByName(ends(done, ("a", "d"), ("c", "b")).select("rep", "src", "tgt"))


def random_windows(units: DataFrame, key: str, group: str, share: float, samples: int, seed: int = 1) -> DataFrame:
    """RES-16: (sample, group, key): runs of a share of each group's units from hashed starts."""
    own = numbered(units.select(group, key), key, group).withColumn("size", F.greatest(F.lit(1), F.floor(share * F.col("n"))).cast("long"))
    starts = own.where("i = 0").select(group, "n", "size", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).select(group, "sample", (draw(seed, F.col("sample"), F.col(group)) % (F.col("n") - F.col("size") + 1)).alias("start"))
    return own.join(starts, group).where("i >= start and i < start + size").select("sample", group, key)


def weighted_units(sizes: DataFrame, weights: DataFrame, seed: int = 1) -> DataFrame:
    """RES-8: (unit_seq, item): as many draws for each unit as its size, each item by its weight; repeats fall together.

    ``weights`` (item, w) is a vocabulary: its running sums make an array that a draw is searched in.
    """
    w = Window.orderBy("item")
    run = weights.select("item", (F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(Window.partitionBy())).alias("hi"))
    table = run.agg(F.array_sort(F.collect_list(F.struct("hi", "item"))).alias("t"))
    places = sizes.select("unit_seq", F.explode(F.sequence(F.lit(1), F.col("size").cast("int"))).alias("place"))
    u = places.withColumn("u", draw(seed, F.col("unit_seq"), F.col("place")) / float(1 << 32)).join(F.broadcast(table))  # one row: the vocabulary
    at = F.filter("t", lambda x: x["hi"] > F.col("u"))
    return u.select("unit_seq", F.coalesce(F.try_element_at(at, F.lit(1)), F.element_at("t", -1))["item"].alias("item")).distinct()
