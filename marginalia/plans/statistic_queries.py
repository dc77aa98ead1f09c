"""Aggregates, distributions and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special
from ..functions import statistics as S
from .base import baskets, brands, query, rounded, sql, table

_SP = """
gc AS (SELECT item, group_id, count(*) AS n FROM inc GROUP BY 1, 2),
sp AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY item) AS p, row_number() OVER (PARTITION BY item ORDER BY n) AS i, count(*) OVER (PARTITION BY item) AS size FROM gc),
ag AS (SELECT item, sum(n)::BIGINT AS total, count(*) AS k, -sum(p * log2(p)) AS entropy, max(p) AS top_share,
  sum((2 * i - size - 1) * n)::DOUBLE / (count(*) * sum(n)) AS gini, (sum(n) * sum(n))::DOUBLE / sum(n * n) AS participation, sum(p * p) AS hhi FROM sp GROUP BY item)"""


@query("group_spread", sql("baskets", """SELECT item, total, k, round(entropy, 6) AS entropy, round(top_share, 6) AS top_share, round(gini, 6) AS gini, round(participation, 6) AS participation, round(hhi, 6) AS hhi,
  round(CASE WHEN k > 1 THEN entropy / log2(k) ELSE 0 END, 6) AS evenness, round(k::DOUBLE / (SELECT count(DISTINCT group_id) FROM inc), 6) AS coverage,
  CASE WHEN hhi >= 0.25 THEN 'concentrated' WHEN hhi >= 0.1 THEN 'moderate' ELSE 'spread' END AS tier FROM ag""", _SP))
def group_spread(spark, sf_dir):
    """AGG-2, AGG-7, AGG-12 to AGG-15: how an item's units spread over groups."""
    inc = baskets(spark, sf_dir)
    groups = inc.select("group_id").distinct().count()
    counts = inc.groupBy("item", "group_id").agg(F.count("*").alias("n"))
    return rounded(S.spread(counts, "item", "n", groups), "entropy", "top_share", "gini", "participation", "hhi", "evenness", "coverage")


@query("conditional_sums", """SELECT o_orderpriority, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS n_a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS n_n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n_r,
  round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 2) AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def conditional_sums(spark, sf_dir):
    """AGG-8."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    return rows.groupBy("o_orderpriority").agg(n("A").alias("n_a"), n("N").alias("n_n"), n("R").alias("n_r"), F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)), 2).alias("returned"))


@query("favourite_brand", sql("brands", "SELECT group_id, arg_max(item, (n, -r)) AS item, max(n) AS n FROM (SELECT group_id, item, count(*) AS n, rank() OVER (ORDER BY item) AS r FROM inc GROUP BY 1, 2) GROUP BY 1"))
def favourite_brand(spark, sf_dir):
    """AGG-9: the most frequent item, the first by name among equals."""
    counts = brands(spark, sf_dir).groupBy("group_id", "item").agg(F.count("*").alias("n"))
    return counts.groupBy("group_id").agg(F.min_by("item", F.struct(-F.col("n"), "item")).alias("item"), F.max("n").alias("n"))


@query("price_summary", """SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std, round(quantile_cont(l_extendedprice, 0.025), 6) AS p_low, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.975), 6) AS p_high, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1""")
def price_summary(spark, sf_dir):
    """AGG-10."""
    return rounded(S.summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"), "mean", "std", "p_low", "median", "p_high")


@query("price_p95", "SELECT l_suppkey, l_extendedprice AS value FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL) WHERE r = least(n, floor(0.95::DOUBLE * n) + 1)")
def price_p95(spark, sf_dir):
    """AGG-11."""
    return S.nearest_rank(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", 0.95)


@query("supplier_scores", """WITH r AS (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1), s AS (SELECT avg(revenue) AS mean, stddev_pop(revenue) AS std FROM r)
SELECT l_suppkey, round(revenue, 2) AS revenue, round(CASE WHEN std > 1e-9 THEN (revenue - mean) / std END, 6) AS z, round(CASE WHEN revenue > 0 THEN greatest(0, (revenue - mean) / revenue) ELSE 0 END, 6) AS fraction FROM r, s""")
def supplier_scores(spark, sf_dir):
    """AGG-16, AGG-17."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    s = r.agg(F.avg("revenue").alias("mean"), F.stddev_pop("revenue").alias("std"))
    x = F.col("revenue")
    return r.join(F.broadcast(s)).select("l_suppkey", F.round(x, 2).alias("revenue"), F.round(S.z_score(x, F.col("mean"), F.col("std")), 6).alias("z"), F.round(S.structure_fraction(x, F.col("mean")), 6).alias("fraction"))


@query("balance_rank_correlation", """WITH c AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
k AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS x, row_number() OVER (ORDER BY n, c_custkey) AS y FROM c)
SELECT round(1 - 6 * sum((x - y) * (x - y)) / (count(*) * (count(*) * count(*) - 1))::DOUBLE, 6) AS rho, count(*) AS n FROM k""")
def balance_rank_correlation(spark, sf_dir):
    """AGG-18."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(n, "c_custkey", "left").fillna(0, ["n"])
    return rounded(S.spearman(c, "c_acctbal", "n", "c_custkey"), "rho")


@query("segment_agreement", """WITH d AS (SELECT c_mktsegment AS x, n_regionkey AS y FROM customer JOIN nation ON c_nationkey = n_nationkey), c AS (SELECT x, y, count(*)::DOUBLE AS c FROM d GROUP BY 1, 2),
a AS (SELECT x, sum(c) AS a FROM c GROUP BY 1), b AS (SELECT y, sum(c) AS b FROM c GROUP BY 1),
t AS (SELECT (SELECT sum(c) FROM c) AS n, (SELECT sum(c * (c - 1) / 2) FROM c) AS s, (SELECT sum(a * (a - 1) / 2) FROM a) AS sa, (SELECT sum(b * (b - 1) / 2) FROM b) AS sb),
h AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM a, t) AS hx, (SELECT -sum(b / n * ln(b / n)) FROM b, t) AS hy, (SELECT sum(c / n * ln(c * n / (a * b))) FROM c JOIN a USING (x) JOIN b USING (y), t) AS mi)
SELECT round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari, round(2 * mi / (hx + hy), 6) AS nmi FROM t, h""")
def segment_agreement(spark, sf_dir):
    """AGG-21, AGG-22."""
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("x"), F.col("n_regionkey").alias("y"))
    return rounded(S.agreement(d, "x", "y"), "ari", "nmi")


_NUM = "SELECT o_orderstatus AS name, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders"


def _numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("name"), F.floor("o_totalprice").cast("long").alias("v"))


@query("residues", f"""WITH v AS ({_NUM}), d AS (SELECT unnest(range(2, 61))::INT AS divisor), c AS (SELECT name, divisor, ((v % divisor) + divisor) % divisor AS r, count(*) AS c FROM v, d GROUP BY ALL)
SELECT name, divisor, sum(c)::BIGINT AS n, round(sum(c * c)::DOUBLE * divisor / sum(c) - sum(c), 6) AS chi2 FROM c GROUP BY name, divisor""")
def residues(spark, sf_dir):
    """AGG-23, INF-19: how evenly the residues of whole prices are hit, for every divisor."""
    return rounded(S.residue_chi2(_numbers(spark, sf_dir), "name", "v", (2, 60)), "chi2")


@query("residue_tests")
def residue_tests(spark, sf_dir):
    """AGG-24, AGG-25: chi-square survival, Bonferroni and Benjamini-Hochberg.  The incomplete gamma function has no SQL."""
    rows = S.residue_chi2(_numbers(spark, sf_dir), "name", "v", (2, 60))
    rows = rows.withColumn("p", special.chi2_survival("chi2", F.col("divisor") - 1))
    return rounded(S.step_up(rows, "p", ["name", "divisor"]), "chi2", "p")


@query("residue_hits")
def residue_hits(spark, sf_dir):
    """AGG-24: binomial survival of the multiples of each divisor."""
    rows = _numbers(spark, sf_dir).select("name", "v", F.explode(F.sequence(F.lit(2), F.lit(60))).alias("divisor"))
    hits = rows.groupBy("name", "divisor").agg(F.count("*").alias("n"), F.count_if(F.pmod("v", "divisor") == 0).alias("k"))
    return hits.withColumn("p", F.round(special.binomial_survival("k", "n", 1 / F.col("divisor")), 6))


@query("step_up_decisions", f"""WITH v AS ({_NUM}), d AS (SELECT unnest(range(2, 61))::INT AS divisor), c AS (SELECT name, divisor, ((v % divisor) + divisor) % divisor AS r, count(*) AS c FROM v, d GROUP BY ALL),
x AS (SELECT name, divisor, round(exp(-greatest(0, (sum(c * c)::DOUBLE * divisor / sum(c) - sum(c)) / divisor)), 9) AS p FROM c GROUP BY name, divisor),
k AS (SELECT *, row_number() OVER (ORDER BY p, name, divisor) AS rank, count(*) OVER () AS m FROM x)
SELECT name, divisor, p, rank::INT AS rank, m, p <= 0.05::DOUBLE / m AS bonferroni, coalesce(rank <= (SELECT max(rank) FROM k WHERE p <= 0.05::DOUBLE * rank / m), false) AS bh FROM k""")
def step_up_decisions(spark, sf_dir):
    """AGG-25 over a score that SQL can state as well."""
    rows = S.residue_chi2(_numbers(spark, sf_dir), "name", "v", (2, 60))
    rows = rows.select("name", "divisor", F.round(F.exp(-F.greatest(F.lit(0.0), F.col("chi2") / F.col("divisor"))), 9).alias("p"))
    return S.step_up(rows, "p", ["name", "divisor"])


@query("brand_cosine", sql("brands", """SELECT x.item AS a, y.item AS b, round(sum(x.n * y.n) / (any_value(p.n) * any_value(q.n)), 6) AS cos FROM gc x JOIN gc y ON x.group_id = y.group_id AND x.item < y.item JOIN gn p ON p.item = x.item JOIN gn q ON q.item = y.item GROUP BY 1, 2""", """
gc AS (SELECT item, group_id, count(*)::DOUBLE AS n FROM inc GROUP BY 1, 2), gn AS (SELECT item, sqrt(sum(n * n)) AS n FROM gc GROUP BY 1)"""))
def brand_cosine(spark, sf_dir):
    """AGG-20 of customer profiles."""
    counts = brands(spark, sf_dir).groupBy("item", "group_id").agg(F.count("*").cast("double").alias("n"))
    return rounded(S.cosine_of(counts, "item", "group_id", "n"), "cos")


@query("brand_jaccard", """WITH d AS (SELECT DISTINCT p_brand AS g, l_suppkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT g, count(*) AS n FROM d GROUP BY 1)
SELECT x.g AS a, y.g AS b, round(count(*)::DOUBLE / (any_value(p.n) + any_value(q.n) - count(*)), 6) AS jaccard FROM d x JOIN d y ON x.k = y.k AND x.g < y.g JOIN s p ON p.g = x.g JOIN s q ON q.g = y.g GROUP BY 1, 2""")
def brand_jaccard(spark, sf_dir):
    """AGG-19."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("g"), F.col("l_suppkey").alias("k"))
    return rounded(S.jaccard_of(d, "g", "k"), "jaccard")


@query("brand_tf_idf", sql("baskets", """SELECT group_id, item, round(tf * ln(n::DOUBLE / df), 6) AS tf_idf FROM tf JOIN (SELECT item, count(DISTINCT group_id) AS df FROM tf GROUP BY 1) USING (item), (SELECT count(DISTINCT group_id) AS n FROM tf)""", """
tf AS MATERIALIZED (SELECT group_id, item, count(*) AS tf FROM inc GROUP BY 1, 2)"""))
def brand_tf_idf(spark, sf_dir):
    """AGG-31: suppliers that mark a customer."""
    tf = baskets(spark, sf_dir).groupBy("group_id", "item").agg(F.count("*").alias("tf"))
    return rounded(S.tf_idf(tf, "group_id", "item", "tf"), "tf_idf")


@query("group_profiles", sql("baskets", """SELECT group_id, units, items, round(k::DOUBLE / units, 6) AS density, round((s * s)::DOUBLE / q, 6) AS participation, round(s::DOUBLE / (units * items), 6) AS fill FROM gp""", """
gc AS (SELECT group_id, item, count(*) AS c FROM inc GROUP BY 1, 2),
gp AS (SELECT group_id, count(*) AS items, sum(c)::BIGINT AS k, sum(c)::BIGINT AS s, sum(c * c)::BIGINT AS q, any_value(u.units) AS units FROM gc JOIN (SELECT group_id, count(DISTINCT unit_seq) AS units FROM inc GROUP BY 1) u USING (group_id) GROUP BY 1)"""))
def group_profiles(spark, sf_dir):
    """AGG-32: density and participation of each group."""
    inc = baskets(spark, sf_dir)
    gc = inc.groupBy("group_id", "item").agg(F.count("*").alias("c"))
    units = inc.groupBy("group_id").agg(F.count_distinct("unit_seq").alias("units"))
    gp = gc.groupBy("group_id").agg(F.count("*").alias("items"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).join(units, "group_id")
    return gp.select("group_id", "units", "items", F.round(F.col("s") / F.col("units"), 6).alias("density"), F.round(F.col("s") * F.col("s") / F.col("q"), 6).alias("participation"), F.round(F.col("s") / (F.col("units") * F.col("items")), 6).alias("fill"))


@query("flag_roles", """WITH s AS (SELECT l_suppkey, count(*) AS n, avg((l_returnflag = 'A')::INT) AS a, avg((l_returnflag = 'N')::INT) AS b, avg((l_returnflag = 'R')::INT) AS c FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, round(a, 6) AS share_a, round(b, 6) AS share_n, round(c, 6) AS share_r, CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'N' ELSE 'R' END AS role FROM s""")
def flag_roles(spark, sf_dir):
    """AGG-28: class shares and the largest, in a fixed order among equals."""
    share = lambda f: F.avg((F.col("l_returnflag") == f).cast("int"))
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), share("A").alias("a"), share("N").alias("b"), share("R").alias("c"))
    role = F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), "A").when(F.col("b") >= F.col("c"), "N").otherwise("R")
    return s.select("l_suppkey", "n", F.round("a", 6).alias("share_a"), F.round("b", 6).alias("share_n"), F.round("c", 6).alias("share_r"), role.alias("role"))


@query("event_census", "SELECT count(*) AS n, round(avg((event_type = 'purchase')::INT), 6) AS buys, round(count(*) FILTER (event_type = 'error')::DOUBLE / nullif(count(*) FILTER (event_type = 'click'), 0), 6) AS errors_per_click, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most FROM events")
def event_census(spark, sf_dir):
    """AGG-5, AGG-29."""
    is_ = lambda t: F.col("event_type") == t
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.round(F.avg(is_("purchase").cast("int")), 6).alias("buys"), F.round(S.safe(F.count_if(is_("error")), F.count_if(is_("click"))), 6).alias("errors_per_click"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("supplier_composite", """WITH s AS (SELECT l_suppkey, avg(l_discount) AS d, count(*) AS n, avg((l_returnflag = 'R')::INT) AS r FROM lineitem GROUP BY 1)
SELECT l_suppkey, round((0.5::DOUBLE * d * 10 + 0.5::DOUBLE * (1 - r)), 6) AS score, CASE WHEN 0.5::DOUBLE * d * 10 + 0.5::DOUBLE * (1 - r) >= 0.6 THEN 'high' WHEN 0.5::DOUBLE * d * 10 + 0.5::DOUBLE * (1 - r) >= 0.5 THEN 'middle' ELSE 'low' END AS tier FROM s""")
def supplier_composite(spark, sf_dir):
    """AGG-33, REL-25: a weighted composite and its tiers."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("d"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    score = F.round(0.5 * F.col("d") * 10 + 0.5 * (1 - F.col("r")), 12)  # sums of floats end some 1e-15 beside a tie of the last digit: the tie itself goes up
    return s.select("l_suppkey", F.round(score, 6).alias("score"), F.when(score >= 0.6, "high").when(score >= 0.5, "middle").otherwise("low").alias("tier"))
