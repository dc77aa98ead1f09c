"""Window-style queries: contexts, ranks, running sums, folds and curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .base import brands, query, rounded, sql, table


@query("event_contexts", """SELECT event_id, user_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' ') AS before,
  array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ' ') AS after FROM events""")
def event_contexts(spark, sf_dir):
    """WIN-1: the three events before and after, never of another user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    side = lambda a, b: F.nullif(F.array_join(F.collect_list("event_type").over(w.rowsBetween(a, b)), " "), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", "user_id", side(-3, -1).alias("before"), side(1, 3).alias("after"))


@query("top_orders", "SELECT o_custkey, o_orderkey, r::INT AS r, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders(spark, sf_dir):
    """WIN-2, WIN-3: a top list is the feature; its limit reaches below the sort."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "r", "o_totalprice")


@query("order_shares", "SELECT o_custkey, o_orderkey, round(o_totalprice / nullif(sum(o_totalprice) OVER (PARTITION BY o_custkey), 0), 6) AS share FROM orders")
def order_shares(spark, sf_dir):
    """WIN-4."""
    total = F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / F.nullif(total, F.lit(0.0)), 6).alias("share"))


@query("share_cutoffs", """WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(q) OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey ROWS UNBOUNDED PRECEDING) / sum(q) OVER (PARTITION BY l_suppkey) AS cum, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS r FROM s)
SELECT l_suppkey, min(CASE WHEN cum >= 0.8 THEN r END)::INT AS parts_80, max(r)::INT AS parts FROM c GROUP BY 1""")
def share_cutoffs(spark, sf_dir):
    """WIN-5, GRA-24: how many parts make up 80 % of a supplier's quantity."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey")
    c = s.withColumn("r", F.row_number().over(w)).withColumn("cum", F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("q").over(Window.partitionBy("l_suppkey")))
    return c.groupBy("l_suppkey").agg(F.min(F.when(F.col("cum") >= 0.8, F.col("r"))).alias("parts_80"), F.max("r").alias("parts"))


@query("largest_jumps", """WITH m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1, 2),
d AS (SELECT *, n - lag(n) OVER (PARTITION BY p ORDER BY month) AS delta FROM m) SELECT p, strftime(arg_max(month, (abs(delta), -epoch(month))), '%Y-%m') AS month, max(abs(delta)) AS jump FROM d WHERE delta IS NOT NULL GROUP BY 1""")
def largest_jumps(spark, sf_dir):
    """WIN-6, INF-18: the largest change from month to month, the first among equals."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    d = m.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("p").orderBy("month"))).where("delta is not null")
    return d.groupBy("p").agg(F.min_by("month", F.struct(-F.abs("delta"), "month")).alias("month"), F.max(F.abs("delta")).alias("jump"))


@query("sliding_windows", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT user_id, unnest(CASE WHEN i < 25 THEN [i - i % 25] ELSE [i - i % 25, i - i % 25 - 25] END) AS start, value, n FROM r)
SELECT user_id, start, count(*) AS size, round(sum(value), 2) AS total FROM w WHERE n - start >= 25 GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    """WIN-7: windows of 50 events every 25, while 25 are left.  Each event names its two windows: no range join."""
    w = Window.partitionBy("user_id")
    r = table(spark, sf_dir, "events").select("user_id", "value", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))
    base = F.col("i") - F.col("i") % 25
    starts = F.explode(F.when(F.col("i") < 25, F.array(base)).otherwise(F.array(base, base - 25)))
    return r.select("user_id", "value", "n", starts.alias("start")).where("n - start >= 25").groupBy("user_id", "start").agg(F.count("*").alias("size"), F.round(F.sum("value"), 2).alias("total"))


@query("cumulative_snapshots", """WITH g AS (SELECT o_custkey AS g, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY g ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER () AS share FROM g),
t AS (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS t), p AS (SELECT t, min(g) FILTER (share >= t - 1e-12) AS last FROM c, t GROUP BY 1)
SELECT t AS threshold, count(*) AS groups, sum(n)::BIGINT AS units FROM c, p WHERE g <= last GROUP BY 1""")
def cumulative_snapshots(spark, sf_dir):
    """WIN-8: the shortest run of whole groups that holds each share of units.  Groups' running sums go by ranges of groups."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.count("*").alias("n"))
    cell = F.floor(F.col("g") / 1000)
    inner = g.withColumn("cell", cell).withColumn("run", F.sum("n").over(Window.partitionBy("cell").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)))
    sizes = g.groupBy(cell.alias("cell")).agg(F.sum("n").alias("size"))
    before = sizes.select("cell", (F.sum("size").over(Window.orderBy("cell")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("all"))  # one row for a thousand groups
    c = inner.join(before, "cell").select("g", "n", ((F.col("run") + F.col("before")) / F.col("all")).alias("share"))
    level = F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75, 1.0)))).alias("threshold")
    last = c.select("g", "share", level).where("share >= threshold - 1e-12").groupBy("threshold").agg(F.min("g").alias("last"))
    return c.join(F.broadcast(last), F.col("g") <= F.col("last")).groupBy("threshold").agg(F.count("*").alias("groups"), F.sum("n").alias("units"))


@query("min_max_scores", "SELECT s_suppkey, round(CASE WHEN max(s_acctbal) OVER () = min(s_acctbal) OVER () THEN 1.0 ELSE (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) END, 6) AS score FROM supplier")
def min_max_scores(spark, sf_dir):
    """WIN-10: by a one-row aggregate, not a window over everything."""
    s = table(spark, sf_dir, "supplier")
    one = s.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return s.join(F.broadcast(one)).select("s_suppkey", F.round(F.when(span == 0, 1.0).otherwise((F.col("s_acctbal") - F.col("lo")) / F.nullif(span, F.lit(0.0))), 6).alias("score"))


@query("first_last_events", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last, count(*) AS n FROM events GROUP BY 1")
def first_last_events(spark, sf_dir):
    """WIN-11."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first"), F.max_by("event_type", at).alias("last"), F.count("*").alias("n"))


@query("ranks_in_units", sql("brands", "SELECT unit_seq, item, row_number() OVER (PARTITION BY unit_seq ORDER BY pos, item)::INT AS r FROM inc"))
def ranks_in_units(spark, sf_dir):
    """WIN-12."""
    return brands(spark, sf_dir).select("unit_seq", "item", F.row_number().over(Window.partitionBy("unit_seq").orderBy("pos", "item")).alias("r"))


@query("gap_segments", """WITH s AS (SELECT p_type, p_brand, avg(p_retailprice) AS x FROM part GROUP BY 1, 2), g AS (SELECT *, x - lag(x) OVER (PARTITION BY p_type ORDER BY x, p_brand) AS gap FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY coalesce(gap, -1) DESC, x, p_brand) AS gr FROM g)
SELECT p_type, p_brand, 1 + sum((gap IS NOT NULL AND gr <= 3)::INT) OVER (PARTITION BY p_type ORDER BY x, p_brand ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM k""")
def gap_segments(spark, sf_dir):
    """WIN-13: ordered scores cut at the three largest gaps."""
    s = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("x"))
    along = Window.partitionBy("p_type").orderBy("x", "p_brand")
    g = s.withColumn("gap", F.col("x") - F.lag("x").over(along))
    g = g.withColumn("gr", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc(F.coalesce("gap", F.lit(-1.0))), "x", "p_brand")))
    cut = (F.col("gap").isNotNull() & (F.col("gr") <= 3)).cast("long")
    return g.select("p_type", "p_brand", (1 + F.sum(cut).over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("segment"))


@query("folds", sql("brands", """SELECT group_id, unit_seq, (i * 5 // n)::BIGINT AS block, ((i * 10 >= n * 7)::INT) AS forward, ((row_number() OVER (PARTITION BY group_id ORDER BY len DESC, unit_seq) - 1) % 5)::BIGINT AS balanced FROM fu""", """
fu AS (SELECT group_id, unit_seq, count(*) AS len, row_number() OVER (PARTITION BY group_id ORDER BY unit_seq) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS n FROM inc GROUP BY 1, 2)"""))
def folds(spark, sf_dir):
    """WIN-14: contiguous blocks, a forward split, and a round robin by length, within each group."""
    w = Window.partitionBy("group_id")
    u = brands(spark, sf_dir).groupBy("group_id", "unit_seq").agg(F.count("*").alias("len"))
    u = u.withColumn("i", (F.row_number().over(w.orderBy("unit_seq")) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    return u.select("group_id", "unit_seq", F.floor(F.col("i") * 5 / F.col("n")).cast("long").alias("block"), (F.col("i") * 10 >= F.col("n") * 7).cast("int").alias("forward"), ((F.row_number().over(w.orderBy(F.desc("len"), "unit_seq")) - 1) % 5).cast("long").alias("balanced"))


@query("curve_knees", """WITH s AS (SELECT l_suppkey AS g, sum(l_quantity) AS q, l_partkey FROM lineitem GROUP BY 1, 3), c AS (SELECT g, row_number() OVER w AS k, sum(q) OVER (PARTITION BY g ORDER BY q DESC, l_partkey ROWS UNBOUNDED PRECEDING) / sum(q) OVER (PARTITION BY g) AS y, count(*) OVER (PARTITION BY g) AS n FROM s WINDOW w AS (PARTITION BY g ORDER BY q DESC, l_partkey)),
d AS (SELECT *, k::DOUBLE / n AS x, round(y - k::DOUBLE / n, 9) AS over_, coalesce(lag(y) OVER (PARTITION BY g ORDER BY k), 0) AS y0 FROM c)
SELECT g, arg_max(k, (over_, -k)) AS knee, round(sum((y + y0) / 2 / n), 6) AS auc FROM d GROUP BY 1""")
def curve_knees(spark, sf_dir):
    """WIN-15: the place furthest above the chord, and the area below the curve by trapezoids."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("g"), "l_partkey").agg(F.sum("l_quantity").alias("q"))
    w, whole = Window.partitionBy("g").orderBy(F.desc("q"), "l_partkey"), Window.partitionBy("g")
    c = s.select("g", F.row_number().over(w).cast("long").alias("k"), (F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("q").over(whole)).alias("y"), F.count("*").over(whole).alias("n"))
    d = c.withColumn("over", F.round(F.col("y") - F.col("k") / F.col("n"), 9)).withColumn("y0", F.coalesce(F.lag("y").over(whole.orderBy("k")), F.lit(0.0)))
    return d.groupBy("g").agg(F.min_by("k", F.struct(-F.col("over"), "k")).alias("knee"), F.round(F.sum((F.col("y") + F.col("y0")) / 2 / F.col("n")), 6).alias("auc"))


@query("min_ranks", "SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)::INT AS r FROM part")
def min_ranks(spark, sf_dir):
    """WIN-16: one more than the number of strictly larger values."""
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).alias("r"))


@query("first_contexts", """WITH u AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, event_type, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY r) AS events FROM u WHERE r <= 3 GROUP BY 1, 2""")
def first_contexts(spark, sf_dir):
    """WIN-9: the first three occurrences, joined in order."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    u = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 3")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("event_id").cast("string").alias("e")))), lambda x: x["e"])
    return u.groupBy("user_id", "event_type").agg(F.array_join(ordered, " ").alias("events"))
