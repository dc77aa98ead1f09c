"""Queries on concepts, nulls of flow, folds and closed forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import statistics as S
from ..operators import concepts as Z
from ..operators import counts as K
from ..operators import flow as L
from ..operators import graph as G
from ..operators import information as N
from ..operators import kernels
from ..operators import relations as R
from ..operators import resample as M
from ..operators.rounds import written
from .base import baskets, brands, days, lines, query, rounded, sql, table
from .information_queries import _FOLD, _split
from .relation_queries import _NEAR, EDGES, NPMI, PPMI

#: Brands by the last digit of their number: an inline vocabulary by a rule (SRC-5).
_OF = "of_ AS MATERIALIZED (SELECT item, 'C' || (CAST(substr(item, 7) AS INT) % 5) AS concept FROM m)"


def _of(inc):
    return inc.select("item").distinct().select("item", F.concat(F.lit("C"), (F.substring("item", 7, 9).cast("int") % 5).cast("string")).alias("concept"))


_TP = _OF + ", tp AS MATERIALIZED (SELECT pr.*, x.concept AS x, y.concept AS y FROM pr JOIN of_ x ON x.item = a JOIN of_ y ON y.item = b)"


@query("concept_density", sql("brands", """SELECT o.concept, members, internal, incident, round(internal::DOUBLE / incident, 6) AS cohesion FROM (SELECT concept, count(*) AS members FROM of_ GROUP BY 1) o
JOIN (SELECT concept, sum(CASE WHEN x = y THEN k ELSE 0 END)::BIGINT AS internal, sum(k)::BIGINT AS incident FROM (SELECT x AS concept, x, y, k FROM tp UNION ALL SELECT y, x, y, k FROM tp WHERE x <> y) GROUP BY 1) USING (concept)""", _TP))
def concept_density(spark, sf_dir):
    """GRA-13, GRA-25."""
    inc = brands(spark, sf_dir)
    return rounded(Z.density(K.pairs(inc), _of(inc)), "cohesion")


@query("concept_graph", sql("brands", """SELECT a, b, round(0.5::DOUBLE * k / (p.n + q.n - k) + 0.5::DOUBLE * least(1, coalesce(cr.c::DOUBLE / nullif(least(coalesce(po.own, 0), coalesce(qo.own, 0)), 0), 0)), 6) AS weight FROM bo
JOIN sz p ON p.concept = a JOIN sz q ON q.concept = b LEFT JOIN ow po ON po.c = a LEFT JOIN ow qo ON qo.c = b LEFT JOIN cr USING (a, b)""", _TP + """,
un AS MATERIALIZED (SELECT DISTINCT concept, unit_seq FROM inc JOIN of_ USING (item)), sz AS (SELECT concept, count(*) AS n FROM un GROUP BY 1),
bo AS (SELECT p.concept AS a, q.concept AS b, count(*) AS k FROM un p JOIN un q ON p.unit_seq = q.unit_seq AND p.concept < q.concept GROUP BY 1, 2),
ow AS (SELECT x AS c, sum(k) AS own FROM tp WHERE x = y GROUP BY 1), cr AS (SELECT least(x, y) AS a, greatest(x, y) AS b, sum(k) AS c FROM tp WHERE x <> y GROUP BY 1, 2)"""))
def concept_graph(spark, sf_dir):
    """GRA-14."""
    inc = brands(spark, sf_dir)
    return rounded(Z.concept_graph(inc, _of(inc)), "weight")


@query("concept_attachment", sql("brands", f"""SELECT item, concept, round(c, 6) AS confidence FROM (SELECT i.item, i.concept, 0.5::DOUBLE * s / t + 0.5::DOUBLE * (h.concept = i.concept)::INT AS c FROM (
  SELECT src AS item, o.concept, sum(w) AS s FROM pw JOIN of_ o ON o.item = tgt GROUP BY 1, 2) i JOIN (SELECT src AS item, sum(w) AS t FROM pw GROUP BY 1) USING (item) JOIN of_ h ON h.item = i.item) WHERE c >= 0.3""", _OF + f""",
pw AS MATERIALIZED (SELECT src, tgt, {PPMI} AS w FROM orn WHERE {PPMI} > 0)"""))
def concept_attachment(spark, sf_dir):
    """REL-27."""
    inc = brands(spark, sf_dir)
    return rounded(Z.attachment(inc, _of(inc)), "confidence")


@query("anchor_residual", sql("brands", """SELECT item, round(s::DOUBLE / ts, 6) AS centrality, round(c::DOUBLE / tc, 6) AS expected, round(s::DOUBLE / ts - c::DOUBLE / tc, 6) AS residual FROM m JOIN sp USING (item), (SELECT sum(s) AS ts FROM sp), (SELECT sum(c) AS tc FROM m)""", """
sp AS MATERIALIZED (SELECT item, sum(k) AS s FROM (SELECT a AS item, k FROM pr UNION ALL SELECT b, k FROM pr) GROUP BY 1)"""))
def anchor_residual(spark, sf_dir):
    """REL-31."""
    return rounded(Z.anchor_residual(brands(spark, sf_dir)), "centrality", "expected", "residual")


@query("conditioned_themes", """WITH t AS (SELECT p_brand, l_returnflag AS f, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY f) AS share FROM t)
SELECT p_brand, sum(CASE WHEN f = 'R' THEN n ELSE 0 END)::BIGINT AS returned, sum(CASE WHEN f = 'A' THEN n ELSE 0 END)::BIGINT AS accepted, round(sum(CASE WHEN f = 'R' THEN share WHEN f = 'A' THEN -share ELSE 0 END), 6) AS lean FROM s GROUP BY 1""")
def conditioned_themes(spark, sf_dir):
    """REL-26: what marks one state of lines against another."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", F.col("l_returnflag").alias("f")).agg(F.count("*").alias("n"))
    s = t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("f")))
    n = lambda f: F.sum(F.when(F.col("f") == f, F.col("n")).otherwise(0))
    return s.groupBy("p_brand").agg(n("R").alias("returned"), n("A").alias("accepted"), F.round(F.sum(F.when(F.col("f") == "R", F.col("share")).when(F.col("f") == "A", -F.col("share")).otherwise(0.0)), 6).alias("lean"))


@query("ordered_ppmi", sql("lines", """SELECT src, tgt, k, round(log2((k::DOUBLE / n) / ((p.c::DOUBLE / n) * (q.c::DOUBLE / n))), 6) AS w FROM (SELECT a AS src, b AS tgt, ab AS k FROM pr UNION ALL SELECT b, a, ba FROM pr) JOIN m p ON p.item = src JOIN m q ON q.item = tgt, nn
WHERE k > 0 AND log2((k::DOUBLE / n) / ((p.c::DOUBLE / n) * (q.c::DOUBLE / n))) > 0"""))
def ordered_ppmi(spark, sf_dir):
    """INF-4."""
    return rounded(Z.ordered_ppmi(lines(spark, sf_dir)), "w")


@query("fold_stability", sql("brands", """SELECT x.f AS a, y.f AS b, round(sum(x.n * y.n) / (any_value(p.n) * any_value(q.n)), 6) AS cos FROM fc x JOIN fc y ON x.item = y.item AND x.f < y.f JOIN fn p ON p.f = x.f JOIN fn q ON q.f = y.f GROUP BY 1, 2""", """
fu AS (SELECT unit_seq, (row_number() OVER (PARTITION BY group_id ORDER BY unit_seq) - 1) % 5 AS f FROM (SELECT DISTINCT group_id, unit_seq FROM inc)),
fc AS MATERIALIZED (SELECT f, item, count(*)::DOUBLE AS n FROM inc JOIN fu USING (unit_seq) GROUP BY 1, 2), fn AS (SELECT f, sqrt(sum(n * n)) AS n FROM fc GROUP BY 1)"""))
def fold_stability(spark, sf_dir):
    """INF-7: likeness of item frequencies between folds."""
    inc = brands(spark, sf_dir)
    fold = M.numbered(inc.select("group_id", "unit_seq").distinct(), "unit_seq", "group_id").select("unit_seq", (F.col("i") % 5).alias("f"))
    return rounded(S.cosine_of(inc.join(fold, "unit_seq").groupBy("f", "item").agg(F.count("*").cast("double").alias("n")), "f", "item", "n"), "cos")


@query("representations", """WITH u AS (SELECT 'brand' AS r, p_brand AS item, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT 'type', p_type, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT 'supplier', CAST(l_suppkey AS VARCHAR), l_orderkey FROM lineitem),
m AS (SELECT r, item, count(*) AS c FROM u GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c) AS i, count(*) OVER (PARTITION BY r) AS n, c::DOUBLE / sum(c) OVER (PARTITION BY r) AS p FROM m)
SELECT r AS representation, count(*) AS items, round(sum((2 * i - n - 1) * c)::DOUBLE / (count(*) * sum(c)), 6) AS gini, round(-sum(p * log2(p)) / log2(count(*)), 6) AS residual, round(sum(c) * -sum(p * log2(p)), 3) AS typical_bits FROM k GROUP BY 1""")
def representations(spark, sf_dir):
    """INF-12, INF-14: invariants over three representations, and the size of the typical set in bits."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("r"), c.cast("string").alias("item")) for n, c in (("brand", F.col("p_brand")), ("type", F.col("p_type")), ("supplier", F.col("l_suppkey")))))).alias("x")
    u = li.select("l_orderkey", kinds).select("x.r", "x.item", "l_orderkey").distinct()
    s = S.spread(u.groupBy("r", "item").agg(F.count("*").alias("c")), "r", "c", 1)
    return s.select(F.col("r").alias("representation"), F.col("k").alias("items"), F.round("gini", 6).alias("gini"), F.round("evenness", 6).alias("residual"), F.round(F.col("total") * F.col("entropy"), 3).alias("typical_bits"))


@query("survivor_tiers", sql("baskets", """SELECT a, b, k, round((k - ca::DOUBLE * cb / n) / sqrt(ca::DOUBLE * cb / n), 6) AS z, CASE WHEN (k - ca::DOUBLE * cb / n) / sqrt(ca::DOUBLE * cb / n) >= 3 THEN 'strong' WHEN (k - ca::DOUBLE * cb / n) / sqrt(ca::DOUBLE * cb / n) >= 1.645 THEN 'weak'
  WHEN (k - ca::DOUBLE * cb / n) / sqrt(ca::DOUBLE * cb / n) <= -1.645 THEN 'avoided' ELSE 'chance' END AS tier FROM pm"""))
def survivor_tiers(spark, sf_dir):
    """INF-17."""
    inc = baskets(spark, sf_dir)
    return rounded(Z.tiers(K.with_marginals(K.pairs(inc), inc)), "z")


@query("definitions", sql("lines", "SELECT item, string_agg(neighbour, '+' ORDER BY rank) AS definition, CASE WHEN max(w) >= 3 THEN 'clear' WHEN max(w) >= 1 THEN 'partial' ELSE 'vague' END AS clarity FROM nb WHERE rank <= 3 GROUP BY 1", _NEAR))
def definitions(spark, sf_dir):
    """REL-30."""
    return Z.definitions(lines(spark, sf_dir))


@query("foundations", sql("lines", """SELECT node, round((CASE WHEN max(o) OVER () = min(o) OVER () THEN 1 ELSE (o - min(o) OVER ())::DOUBLE / (max(o) OVER () - min(o) OVER ()) END + CASE WHEN max(i) OVER () = min(i) OVER () THEN 1 ELSE (i - min(i) OVER ())::DOUBLE / (max(i) OVER () - min(i) OVER ()) END
  + CASE WHEN max(t) OVER () = min(t) OVER () THEN 1 ELSE (t - min(t) OVER ())::DOUBLE / (max(t) OVER () - min(t) OVER ()) END) / 3, 6) AS score FROM fd""", EDGES + """,
fd AS (SELECT node, sum(o) AS o, sum(i) AS i, count(DISTINCT type) AS t FROM (SELECT src AS node, type, 1 AS o, 0 AS i FROM ed UNION ALL SELECT tgt, type, 0, 1 FROM ed) GROUP BY 1)"""))
def foundations(spark, sf_dir):
    """GRA-22."""
    return rounded(Z.foundations(R.typed_edges(lines(spark, sf_dir))), "score")


@query("transition_roles", sql("lines", """SELECT node, sum(o)::BIGINT AS out, sum(i)::BIGINT AS into, any_value(coalesce(mu, 0)) AS mutual, CASE WHEN sum(o) = 0 THEN 'sink' WHEN sum(i) = 0 THEN 'initiator' WHEN sum(o) > sum(i) THEN 'source' ELSE 'relay' END AS role FROM (SELECT src AS node, 1 AS o, 0 AS i FROM te UNION ALL SELECT tgt, 0, 1 FROM te)
LEFT JOIN (SELECT x.src AS node, count(*) AS mu FROM te x JOIN te y ON x.src = y.tgt AND x.tgt = y.src GROUP BY 1) USING (node) GROUP BY 1""", """
un AS (SELECT group_id, unit_seq, row_number() OVER (PARTITION BY group_id ORDER BY unit_seq) AS rn FROM (SELECT DISTINCT group_id, unit_seq FROM inc)),
at_ AS MATERIALIZED (SELECT i.group_id, i.item, u.rn FROM inc i JOIN un u USING (group_id, unit_seq)),
st AS MATERIALIZED (SELECT x.item AS src, x.group_id, x.rn + 1 AS rn FROM at_ x JOIN un u ON u.group_id = x.group_id AND u.rn = x.rn + 1), bs AS (SELECT src, count(*) AS f FROM st GROUP BY 1),
mt AS (SELECT s.src, y.item AS tgt, count(*) AS k FROM st s JOIN at_ y ON y.group_id = s.group_id AND y.rn = s.rn WHERE s.src <> y.item GROUP BY 1, 2),
te AS MATERIALIZED (SELECT CASE WHEN ab > ba THEN a ELSE b END AS src, CASE WHEN ab > ba THEN b ELSE a END AS tgt FROM pr WHERE ab + ba >= 10 AND abs((ab - ba)::DOUBLE / (ab + ba)) >= 0.5
  UNION SELECT src, tgt FROM mt JOIN bs USING (src) JOIN m ON m.item = tgt, nn WHERE k >= 5 AND k::DOUBLE / f >= 0.2 AND (k::DOUBLE / f) / (c::DOUBLE / n) >= 1.5)"""))
def transition_roles(spark, sf_dir):
    """GRA-28."""
    inc = lines(spark, sf_dir)
    return Z.transition_roles(R.precedes(inc, min_asym=0.5).where("relation = 'PRECEDES'"), R.predicts(inc, (1,)))


@query("evidence_graph", sql("brands", "SELECT 'concept:' || concept AS src, 'item:' || item AS tgt, 'HAS' AS type FROM of_ UNION ALL SELECT 'item:' || item, 'unit:' || unit_seq, 'SHOWN_IN' FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY unit_seq) AS r FROM inc) WHERE r <= 3", _OF))
def evidence_graph(spark, sf_dir):
    """GRA-29."""
    inc = brands(spark, sf_dir)
    return Z.evidence_graph(inc, _of(inc))


@query("exclusions_by_half", sql("lines", """SELECT h, count(*) AS exclusions FROM (SELECT x.h, x.item AS a, y.item AS b FROM hm x JOIN hm y ON x.h = y.h AND x.item < y.item AND x.c >= 30 AND y.c >= 30 ANTI JOIN hp ON hp.h = x.h AND hp.a = x.item AND hp.b = y.item) GROUP BY 1""", """
hi AS MATERIALIZED (SELECT *, group_id % 2 AS h FROM inc), hm AS MATERIALIZED (SELECT h, item, count(*) AS c FROM hi GROUP BY 1, 2),
hp AS MATERIALIZED (SELECT DISTINCT x.h, x.item AS a, y.item AS b FROM hi x JOIN hi y ON x.unit_seq = y.unit_seq AND x.item < y.item)"""))
def exclusions_by_half(spark, sf_dir):
    """REL-29: exclusions in each of two subsets of units; the split is the operator."""
    inc = lines(spark, sf_dir)
    parts = [R.excludes(inc.where(F.col("group_id") % 2 == h)).agg(F.count("*").alias("exclusions")).select(F.lit(h).cast("long").alias("h"), "exclusions") for h in (0, 1)]
    return parts[0].unionByName(parts[1])


_NULLFLOW = """
fw AS (SELECT least(x.item, y.item) AS a, greatest(x.item, y.item) AS b, sum((x.item < y.item)::INT)::BIGINT AS f, sum((x.item > y.item)::INT)::BIGINT AS g FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item <> y.item AND x.pos < y.pos GROUP BY 1, 2),
ni AS MATERIALIZED (SELECT rep, unit_seq, item, row_number() OVER (PARTITION BY rep, unit_seq ORDER BY md5(rep || '|' || unit_seq || '|' || item), item) AS pos FROM inc, (SELECT unnest(range(0, 20))::INT AS rep)),
nf AS (SELECT rep, least(x.item, y.item) AS a, greatest(x.item, y.item) AS b, sum((x.item < y.item)::INT)::DOUBLE AS f, sum((x.item > y.item)::INT)::DOUBLE AS g FROM ni x JOIN ni y USING (rep, unit_seq) WHERE x.item <> y.item AND x.pos < y.pos GROUP BY 1, 2, 3),
nq AS (SELECT a, b, d FROM (SELECT a, b, round(greatest(f, g) / (f + g), 9) AS d, row_number() OVER (PARTITION BY a, b ORDER BY round(greatest(f, g) / (f + g), 9)) AS r, count(*) OVER (PARTITION BY a, b) AS n FROM nf) WHERE r = least(n, floor(0.95::DOUBLE * n) + 1)),
ve AS (SELECT fw.a, fw.b, f + g AS total, greatest(f, g)::DOUBLE / (f + g) AS direction, d AS p95 FROM fw JOIN nq USING (a, b) WHERE f + g >= 8)"""


def _falsified(inc):
    """FLO-6: each pair's direction against the 95th percentile of twenty order nulls, all in one job by a rep column."""
    pair = lambda rows, *by: rows.groupBy(*by, F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.sum(F.when(F.col("src") < F.col("tgt"), F.col("k")).otherwise(0)).alias("f"), F.sum(F.when(F.col("src") > F.col("tgt"), F.col("k")).otherwise(0)).alias("g"))
    seen = pair(L.within(inc))
    reps = M.repetitions(inc.select("unit_seq", "item"), 20)
    w = Window.partitionBy("rep", "unit_seq").orderBy(F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col("unit_seq").cast("string"), "item")), "item")
    null = reps.withColumn("pos", F.row_number().over(w))
    x, y = null.select("rep", "unit_seq", F.col("item").alias("src"), F.col("pos").alias("p")), null.select("rep", "unit_seq", F.col("item").alias("tgt"), F.col("pos").alias("q"))
    met = pair(x.join(y, ["rep", "unit_seq"]).where("src <> tgt and p < q").groupBy("rep", "src", "tgt").agg(F.count("*").alias("k")), "rep")
    d = met.select(F.concat_ws("|", "a", "b").alias("ab"), F.round(F.greatest("f", "g") / (F.col("f") + F.col("g")), 9).alias("d"))
    q = S.nearest_rank(d, "ab", "d", 0.95)
    total = F.col("f") + F.col("g")
    return seen.withColumn("ab", F.concat_ws("|", "a", "b")).join(q, "ab").where(total >= 8).select("a", "b", total.alias("total"), (F.greatest("f", "g") / total).alias("direction"), F.col("value").alias("p95"))


@query("flow_falsification", sql("days", "SELECT a, b, total, round(direction, 6) AS direction, round(p95, 6) AS p95, direction > p95 AS survives FROM ve", _NULLFLOW))
def flow_falsification(spark, sf_dir):
    """FLO-6, RES-7, AGG-11."""
    return _falsified(days(spark, sf_dir)).select("a", "b", "total", F.round("direction", 6).alias("direction"), F.round("p95", 6).alias("p95"), (F.col("direction") > F.col("p95")).alias("survives"))


@query("flow_verdict", sql("days", "SELECT count(*) AS edges, count(*) FILTER (direction > p95) AS survivors, CASE WHEN count(*) FILTER (direction > p95) >= 0.5 * count(*) THEN 'YES' WHEN count(*) FILTER (direction > p95) > 0 THEN 'PARTIAL' ELSE 'NO' END AS verdict FROM ve", _NULLFLOW))
def flow_verdict(spark, sf_dir):
    """FLO-7."""
    v = _falsified(days(spark, sf_dir)).agg(F.count("*").alias("edges"), F.count_if(F.col("direction") > F.col("p95")).alias("survivors"))
    return v.withColumn("verdict", F.when(F.col("survivors") >= 0.5 * F.col("edges"), "YES").when(F.col("survivors") > 0, "PARTIAL").otherwise("NO"))


@query("action_inventory", "SELECT event_type, hour(ts) // 6 AS part, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def action_inventory(spark, sf_dir):
    """FLO-10: actions by a state of their time."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.hour("ts") / 6).cast("long").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("random_partitions", """WITH g AS (SELECT o_custkey AS g, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT g, n, ('0x' || substr(md5('1|' || g || '|' || i), 1, 8))::BIGINT % (n + 1) AS cut, i FROM g, (SELECT unnest(range(0, 4))::INT AS i)),
e AS (SELECT g, n, cut FROM c UNION ALL SELECT g, n, 0 FROM g UNION ALL SELECT g, n, n FROM g) SELECT g, part::INT AS part, size FROM (SELECT g, row_number() OVER (PARTITION BY g ORDER BY cut) AS part, lead(cut) OVER (PARTITION BY g ORDER BY cut) - cut AS size FROM e) WHERE size IS NOT NULL""")
def random_partitions(spark, sf_dir):
    """RES-9: each customer's orders cut at four hashed places into five parts that sum up again."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.count("*").alias("n"))
    cuts = g.select("g", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("g", (M.draw(1, F.col("g"), F.col("i")) % (F.col("n") + 1)).alias("cut"))
    ends = g.select("g", F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("cut"))
    w = Window.partitionBy("g").orderBy("cut")
    return cuts.unionByName(ends).select("g", F.row_number().over(w).alias("part"), (F.lead("cut").over(w) - F.col("cut")).alias("size")).where("size is not null")


@query("value_resample", """WITH v AS (SELECT n_nationkey AS g, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY n_nationkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT rep, g, ('0x' || substr(md5('1|' || rep || '|' || g || '|' || i), 1, 8))::BIGINT % n AS j FROM v, (SELECT unnest(range(0, 10))::INT AS rep)) SELECT rep, d.g, count(*) AS n, round(avg(s_acctbal), 6) AS mean FROM d JOIN v ON v.g = d.g AND v.i = d.j GROUP BY 1, 2""")
def value_resample(spark, sf_dir):
    """RES-11: values drawn anew within each nation."""
    v = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("g"), "s_suppkey", "s_acctbal")
    return M.bootstrap(v, "s_suppkey", "g", 10).join(v.select("s_suppkey", "s_acctbal"), "s_suppkey").groupBy("rep", "g").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 6).alias("mean"))


@query("corruption_curve", sql("brands", "SELECT rate, floor(n * rate)::BIGINT AS broken, round(floor(n * rate) / n, 6) AS share, round(pow(1 - rate, 2), 6) AS expected FROM (SELECT count(*) AS n FROM pr WHERE k >= 5), (SELECT unnest([0.01, 0.05, 0.1, 0.2])::DOUBLE AS rate)"))
def corruption_curve(spark, sf_dir):
    """RES-15, RES-14: in closed form."""
    n = K.pairs(brands(spark, sf_dir)).where("k >= 5").agg(F.count("*").alias("n"))
    rate = F.explode(F.array(*map(F.lit, (0.01, 0.05, 0.1, 0.2)))).alias("rate")
    return n.select("n", rate).select("rate", F.floor(F.col("n") * F.col("rate")).cast("long").alias("broken"), F.round(F.floor(F.col("n") * F.col("rate")) / F.col("n"), 6).alias("share"), F.round(F.pow(1 - F.col("rate"), 2), 6).alias("expected"))


@query("units_with_any", sql("days", "SELECT unit_seq, count(*) AS items FROM inc WHERE unit_seq IN (SELECT unit_seq FROM inc WHERE item IN ('purchase', 'signup')) AND pos IS NOT NULL GROUP BY 1"))
def units_with_any(spark, sf_dir):
    """FIL-1, FIL-2: units that hold any item of a set."""
    inc = days(spark, sf_dir).where(F.col("pos").isNotNull())
    return inc.join(inc.where(F.col("item").isin("purchase", "signup")).select("unit_seq").distinct(), "unit_seq", "left_semi").groupBy("unit_seq").agg(F.count("*").alias("items"))


@query("semantic_fields", sql("lines", "SELECT node, min(other) AS field FROM (SELECT src AS node, tgt AS other FROM r UNION SELECT src, src FROM e2) GROUP BY 1", f"""
a1 AS MATERIALIZED (SELECT a AS src, b AS tgt FROM pm WHERE k >= 5 AND {NPMI} >= 0.4 AND substr(a, 1, 1) = substr(b, 1, 1)), e2 AS MATERIALIZED (SELECT src, tgt FROM a1 UNION ALL SELECT tgt, src FROM a1),
r AS (SELECT src, tgt FROM e2 UNION SELECT r.src, e2.tgt FROM r JOIN e2 ON r.tgt = e2.src)""", recursive=True))
def semantic_fields(spark, sf_dir):
    """REL-24: connected parts within a concept (here: words of one first letter)."""
    e = R.associates(lines(spark, sf_dir), min_npmi=0.4).where("substring(a, 1, 1) = substring(b, 1, 1)")
    return G.components(written(e.select(F.col("a").alias("src"), F.col("b").alias("tgt")))).select("node", F.col("component").alias("field"))


@query("state_gradient", sql("days", """SELECT node, net, 1 + sum(cut) OVER (ORDER BY net DESC, node ROWS UNBOUNDED PRECEDING)::BIGINT AS stage FROM (
  SELECT node, net, (gap IS NOT NULL AND row_number() OVER (ORDER BY coalesce(gap, -1) DESC, net DESC, node) <= 2)::INT AS cut FROM (SELECT node, net, lag(net) OVER (ORDER BY net DESC, node) - net AS gap FROM (
    SELECT node, sum(d)::BIGINT AS net FROM (SELECT x.item AS src, y.item AS tgt, count(*) AS k FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item <> y.item AND x.pos < y.pos GROUP BY 1, 2) f, LATERAL (VALUES (f.src, f.k), (f.tgt, -f.k)) v(node, d) GROUP BY 1)))"""))
def state_gradient(spark, sf_dir):
    """FLO-9, WIN-13: states by net outflow, cut into stages at the largest gaps."""
    net = L.net_outflow(L.within(days(spark, sf_dir))).select("node", "net")  # one row a state
    down = Window.orderBy(F.desc("net"), "node")
    g = net.withColumn("gap", F.lag("net").over(down) - F.col("net"))
    g = g.withColumn("r", F.row_number().over(Window.orderBy(F.desc(F.coalesce("gap", F.lit(-1))), F.desc("net"), "node")))
    cut = (F.col("gap").isNotNull() & (F.col("r") <= 2)).cast("long")
    return g.select("node", "net", (1 + F.sum(cut).over(down.rowsBetween(Window.unboundedPreceding, 0))).alias("stage"))


@query("structure_hits", sql("brands", """SELECT count(*) AS n, count(rk) AS with_evidence, round(avg(coalesce((rk <= 10)::INT, 0)), 6) AS hits10 FROM kn LEFT JOIN (SELECT unit_seq, target, rk FROM (SELECT *, rank() OVER (PARTITION BY unit_seq, target ORDER BY round(ev, 9) DESC) AS rk FROM ev) WHERE item = target) s ON s.unit_seq = kn.unit_seq AND s.target = kn.item""", _FOLD))
def structure_hits(spark, sf_dir):
    """INF-11: reconstruction from structure alone."""
    r = N.structure_ranks(*_split(brands(spark, sf_dir)))
    return r.agg(F.count("*").alias("n"), F.count("rank").alias("with_evidence"), F.round(F.avg(F.coalesce((F.col("rank") <= 10).cast("int"), F.lit(0))), 6).alias("hits10"))


@query("triad_coverage", sql("baskets", """SELECT kind, count(*) AS edges, round(count(*)::DOUBLE / (SELECT count(*) FROM e), 6) AS share FROM hit JOIN (SELECT least(src, tgt) AS p, greatest(src, tgt) AS q FROM e) b USING (p, q) GROUP BY 1""", """
e AS MATERIALIZED (SELECT DISTINCT CASE WHEN ab > ba THEN a ELSE b END AS src, CASE WHEN ab > ba THEN b ELSE a END AS tgt FROM pr WHERE ab + ba >= 10 AND abs((ab - ba)::DOUBLE / (ab + ba)) >= 0.3),
u AS MATERIALIZED (SELECT src, tgt FROM e UNION SELECT tgt, src FROM e),
wd AS (SELECT x.src AS m, x.tgt AS x, y.tgt AS y, CASE WHEN c.src IS NULL THEN 'open' ELSE 'closed' END AS kind FROM u x JOIN u y ON x.src = y.src AND x.tgt < y.tgt LEFT JOIN u c ON c.src = x.tgt AND c.tgt = y.tgt),
hit AS (SELECT DISTINCT kind, least(m, v) AS p, greatest(m, v) AS q FROM (SELECT kind, m, x AS v FROM wd UNION ALL SELECT kind, m, y FROM wd))"""))
def triad_coverage(spark, sf_dir):
    """GRA-26."""
    e = R.precedes(baskets(spark, sf_dir)).where("relation = 'PRECEDES'").select("src", "tgt")
    return rounded(G.triad_edges(written(e)), "share")


@query("split_communities")
def split_communities(spark, sf_dir):
    """GRA-10: large communities percolated again at higher thresholds.  Tested on cliques."""
    e = R.associates(lines(spark, sf_dir), min_npmi=0.5).select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.col("npmi").alias("weight"))
    return G.split_communities(written(e), 0.5)


@query("capped_graph")
def capped_graph(spark, sf_dir):
    """REL-15: order-dependent, so a sequential kernel."""
    e = R.associates(lines(spark, sf_dir), min_npmi=0.5).select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.round("npmi", 9).alias("weight"))
    return rounded(kernels.capped_graph(e), "weight")


@query("null_band")
def null_band(spark, sf_dir):
    """INF-5, INF-6: the gain of structure over frequency, and that of three token nulls of the training units."""
    train, test = map(written, _split(written(brands(spark, sf_dir))))
    cells = [("observed", train)] + [(f"null{s}", written(M.shuffled_tokens(train, seed=s))) for s in (1, 2, 3)]
    rows = [N.scoreboard(N.masked_scores(t, test)).select(F.lit(name).alias("cell"), F.round("gain", 6).alias("gain"), F.round("mrr", 6).alias("mrr"), "n") for name, t in cells]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
