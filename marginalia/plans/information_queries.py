"""Information, prediction, flow and resampling queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import statistics as S
from ..operators import counts as K
from ..operators import flow as L
from ..operators import information as N
from ..operators import kernels
from ..operators import relations as R
from ..operators import resample as M
from ..operators.rounds import written
from .base import baskets, brands, days, query, rounded, sql, table, words
from .relation_queries import _PRE


@query("item_budget", sql("baskets", "SELECT round(log2(count(*)), 6) AS uniform, round(sum(-(c::DOUBLE / t) * log2(c::DOUBLE / t)), 6) AS frequency, count(*) AS items, round(1 - sum(-(c::DOUBLE / t) * log2(c::DOUBLE / t)) / log2(count(*)), 6) AS redundancy FROM m, (SELECT sum(c) AS t FROM m)"))
def item_budget(spark, sf_dir):
    """INF-8, INF-16."""
    return rounded(N.budget(baskets(spark, sf_dir)), "uniform", "frequency", "redundancy")


@query("group_nll", sql("baskets", """SELECT count(*) AS n, round(avg(-log2((n_gi - 1 + 0.5::DOUBLE) / (t_g - u + 0.5::DOUBLE * v))), 6) AS nll, round(avg(-log2((c + 0.5::DOUBLE) / (t + 0.5::DOUBLE * v))), 6) AS base FROM lo JOIN m USING (item), (SELECT count(*) AS v, sum(c) AS t FROM m)""", """
lo AS (SELECT item, count(*) OVER (PARTITION BY group_id, item) AS n_gi, count(*) OVER (PARTITION BY group_id) AS t_g, count(*) OVER (PARTITION BY unit_seq) AS u FROM inc)"""))
def group_nll(spark, sf_dir):
    """INF-9."""
    return rounded(N.leave_one_out(baskets(spark, sf_dir)), "nll", "base")


@query("unit_coherence", sql("brands", """SELECT x.group_id, x.unit_seq, count(*) AS pairs, round(avg(greatest(0, log2((k::DOUBLE / n) / ((ca::DOUBLE / n) * (cb::DOUBLE / n))))), 6) AS mean_ppmi FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item < y.item JOIN pm ON a = x.item AND b = y.item GROUP BY 1, 2"""))
def unit_coherence(spark, sf_dir):
    """INF-13."""
    return rounded(N.coherence(brands(spark, sf_dir)), "mean_ppmi")


_UN = """
un AS MATERIALIZED (SELECT group_id, unit_seq, row_number() OVER (PARTITION BY group_id ORDER BY unit_seq) AS rn FROM (SELECT DISTINCT group_id, unit_seq FROM inc)),
at_ AS MATERIALIZED (SELECT i.group_id, i.unit_seq, i.item, i.pos, u.rn FROM inc i JOIN un u USING (group_id, unit_seq))"""


@query("recurrence", sql("brands", "SELECT d, count(*) AS pairs, round(count(h.rn) / sum(c::DOUBLE / n), 6) AS lift FROM va LEFT JOIN at_ h ON h.group_id = va.group_id AND h.rn = va.rn AND h.item = va.item JOIN m ON m.item = va.item, nn GROUP BY 1", _UN + """,
va AS (SELECT x.group_id, x.item, d, x.rn + d AS rn FROM at_ x, (SELECT unnest(range(1, 21))::INT AS d) t JOIN un u ON u.group_id = x.group_id AND u.rn = x.rn + d)"""))
def recurrence(spark, sf_dir):
    """INF-10, JOI-12."""
    return rounded(N.recurrence(brands(spark, sf_dir)), "lift")


@query("mirror_likeness", sql("brands", """SELECT u.group_id, count(*) AS pairs, round(avg(coalesce(k, 0)::DOUBLE / (a.s + b.s - coalesce(k, 0))), 6) AS mean_jaccard FROM uu u JOIN sz a ON a.group_id = u.group_id AND a.rn = u.rn JOIN sz b ON b.group_id = u.group_id AND b.rn = u.n + 1 - u.rn
LEFT JOIN cm ON cm.group_id = u.group_id AND cm.rn = u.rn WHERE u.rn < u.n + 1 - u.rn GROUP BY 1""", _UN + """,
uu AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM un), sz AS (SELECT group_id, rn, count(*) AS s FROM at_ GROUP BY 1, 2),
cm AS (SELECT x.group_id, x.rn, count(*) AS k FROM at_ x JOIN uu u ON u.group_id = x.group_id AND u.rn = x.rn JOIN at_ y ON y.group_id = x.group_id AND y.rn = u.n + 1 - x.rn AND y.item = x.item WHERE x.rn < u.n + 1 - x.rn GROUP BY 1, 2)"""))
def mirror_likeness(spark, sf_dir):
    """JOI-17, INF-15."""
    return rounded(N.mirror(brands(spark, sf_dir)), "mean_jaccard")


_TRAINED = """
fu AS (SELECT unit_seq, (row_number() OVER (PARTITION BY group_id ORDER BY unit_seq) - 1) * 5 // count(*) OVER (PARTITION BY group_id) AS fold FROM (SELECT DISTINCT group_id, unit_seq FROM inc)),
te AS MATERIALIZED (SELECT inc.* FROM inc JOIN fu USING (unit_seq) WHERE fold = 4), tn AS MATERIALIZED (SELECT inc.* FROM inc JOIN fu USING (unit_seq) WHERE fold < 4),
tm AS MATERIALIZED (SELECT item, count(*) AS c FROM tn GROUP BY 1), tv AS (SELECT count(*) AS v, sum(c) AS t FROM tm), tc AS (SELECT count(DISTINCT unit_seq) AS n FROM tn),
p0 AS MATERIALIZED (SELECT item, (c + 0.5::DOUBLE) / (t + 0.5::DOUBLE * v) AS p0 FROM tm, tv),
tp AS (SELECT x.item AS a, y.item AS b, count(*) AS k FROM tn x JOIN tn y ON x.unit_seq = y.unit_seq AND x.item <> y.item GROUP BY 1, 2),
tw AS MATERIALIZED (SELECT a, b, log2((k::DOUBLE / n) / ((x.c::DOUBLE / n) * (y.c::DOUBLE / n))) AS w FROM tp JOIN tm x ON x.item = a JOIN tm y ON y.item = b, tc WHERE log2((k::DOUBLE / n) / ((x.c::DOUBLE / n) * (y.c::DOUBLE / n))) > 0),
dg AS (SELECT p0.item, rank() OVER (ORDER BY count(tp.b) DESC) AS degree_rank FROM p0 LEFT JOIN tp ON tp.a = p0.item GROUP BY 1),
al_ AS MATERIALIZED (SELECT * FROM (SELECT te.unit_seq, te.item, count(*) OVER (PARTITION BY te.unit_seq) AS n, row_number() OVER (PARTITION BY te.unit_seq ORDER BY md5('1|' || te.unit_seq || '|' || te.item), te.item) AS r FROM te SEMI JOIN p0 ON p0.item = te.item) WHERE n >= 2),
"""
_SCORED = """
ev AS (SELECT x.unit_seq, x.item AS target, tw.a AS item, sum(tw.w) AS ev FROM kn x JOIN gv y ON x.unit_seq = y.unit_seq AND x.item <> y.item JOIN tw ON tw.b = y.item GROUP BY 1, 2, 3),
al AS MATERIALIZED (SELECT x.unit_seq, x.item AS target, p0.item, p0.p0, p0.p0 * pow(2, coalesce(ev.ev, 0)) AS s FROM kn x, p0 LEFT JOIN ev ON ev.unit_seq = x.unit_seq AND ev.target = x.item AND ev.item = p0.item),
ow AS (SELECT unit_seq, target, s AS own_s, p0 AS q0 FROM al WHERE item = target),
sc AS MATERIALIZED (SELECT al.unit_seq, al.target AS item, any_value(degree_rank) AS degree_rank, (SELECT v FROM tv) AS vocabulary, -log2(any_value(own_s) / sum(al.s)) AS nll, -log2(any_value(q0)) AS base_nll, 1 + count(*) FILTER (round(al.s, 12) > round(own_s, 12)) AS rank, 1 + count(*) FILTER (round(al.p0, 12) > round(q0, 12)) AS base_rank
  FROM al JOIN ow ON ow.unit_seq = al.unit_seq AND ow.target = al.target JOIN dg ON dg.item = al.target GROUP BY 1, 2)"""


def _fold(masked: str = "true", given: str = "true") -> str:
    """Scores of the masked items (``kn``) from the given ones (``gv``)."""
    return f"{_TRAINED}gv AS MATERIALIZED (SELECT unit_seq, item FROM al_ WHERE {given}), kn AS MATERIALIZED (SELECT unit_seq, item FROM al_ WHERE {masked} AND unit_seq IN (SELECT unit_seq FROM gv)),{_SCORED}"


_FOLD = _fold()


def _split(inc):
    """The last fifth of each group's units is for testing (WIN-14)."""
    u = M.numbered(inc.select("group_id", "unit_seq").distinct(), "unit_seq", "group_id").select("unit_seq", F.floor(F.col("i") * 5 / F.col("n")).alias("fold"))
    rows = inc.join(u, "unit_seq")
    cols = inc.columns
    return rows.where("fold < 4").select(*cols), rows.where("fold = 4").select(*cols)


def _halves(spark, sf_dir):
    """Training and test units of orders by brand, written once: the models read them many times."""
    return map(written, _split(written(brands(spark, sf_dir))))


@query("masked_items", sql("brands", "SELECT unit_seq, item, round(nll, 6) AS nll, round(base_nll, 6) AS base_nll, rank, base_rank FROM sc", _FOLD))
def masked_items(spark, sf_dir):
    """INF-1 to INF-3, WIN-16, FIL-4, FIL-5: every held-out item from the rest of its unit."""
    return rounded(N.masked_scores(*_halves(spark, sf_dir)).drop("degree_rank", "vocabulary"), "nll", "base_nll")


_MEANS = {"nll": "nll", "base_nll": "base_nll", "mrr": "1.0::DOUBLE / rank", "base_mrr": "1.0::DOUBLE / base_rank", "degree_mrr": "1.0::DOUBLE / degree_rank", "gain": "base_nll - nll", "mrr_gain": "1.0::DOUBLE / rank - 1.0::DOUBLE / base_rank"}
_MEANS |= {f"{p}hits{k}": f"({p}rank <= {k})::INT" for k in (1, 5, 10) for p in ("", "base_", "degree_")}
_BOARD = f"""SELECT count(*) AS n, {", ".join(f"round(avg({e}), 6) AS {n}" for n, e in _MEANS.items())}, round(avg(rank) / any_value(vocabulary), 6) AS rank_share, round(avg(base_rank) / any_value(vocabulary), 6) AS base_rank_share,
  round(1.96::DOUBLE * stddev_samp(base_nll - nll) / sqrt(count(*)), 6) AS half_width, round(1.96::DOUBLE * stddev_samp(1.0::DOUBLE / rank - 1.0::DOUBLE / base_rank) / sqrt(count(*)), 6) AS mrr_half_width, round(pow(2, avg(nll)), 4) AS perplexity, round(pow(2, avg(base_nll)), 4) AS base_perplexity,
  CASE WHEN avg(base_nll - nll) - 1.96 * stddev_samp(base_nll - nll) / sqrt(count(*)) > 0 THEN 'YES' WHEN avg(base_nll - nll) + 1.96 * stddev_samp(base_nll - nll) / sqrt(count(*)) > 0 THEN 'PARTIAL' ELSE 'NO' END AS verdict FROM sc"""


def _board(spark, sf_dir, share=None):
    out = N.scoreboard(N.masked_scores(*_halves(spark, sf_dir), share=share))
    return rounded(rounded(out, *_MEANS, "rank_share", "base_rank_share", "half_width", "mrr_half_width"), "perplexity", "base_perplexity", digits=4)


@query("prediction_scoreboard", sql("brands", _BOARD, _FOLD))
def prediction_scoreboard(spark, sf_dir):
    """AGG-26, INF-6."""
    return _board(spark, sf_dir)


def _masked(share: float) -> str:
    masked = f"r <= greatest(1, round_even({share} * n, 0))"
    return _fold(masked, f"NOT ({masked})")


@query("prediction_quarter_masked", sql("brands", _BOARD, _masked(0.25)))
def prediction_quarter_masked(spark, sf_dir):
    """INF-2, AGG-26: a quarter of each unit masked at once."""
    return _board(spark, sf_dir, 0.25)


@query("prediction_half_masked", sql("brands", _BOARD, _masked(0.5)))
def prediction_half_masked(spark, sf_dir):
    """INF-2, AGG-26: half of each unit masked at once."""
    return _board(spark, sf_dir, 0.5)


#: The least gain in bits and in hits at 10 that count as an effect.
MIN_GAIN, MIN_HITS = 0.05, 0.02


@query("prediction_verdict")
def prediction_verdict(spark, sf_dir):
    """INF-5, INF-6: the five criteria over three masks and three token nulls."""
    train, test = _halves(spark, sf_dir)
    boards = [written(N.scoreboard(N.masked_scores(train, test, share=share))) for share in (None, 0.25, 0.5)]
    nulls = [N.scoreboard(N.masked_scores(written(M.shuffled_tokens(train, seed=seed)), test)).select("mrr") for seed in (1, 2, 3)]
    out = N.decision(boards[0], nulls[0].unionByName(nulls[1]).unionByName(nulls[2]), boards[0].unionByName(boards[1]).unionByName(boards[2]), MIN_GAIN, MIN_HITS)
    return rounded(out, "gain", "mrr", "base_mrr", "degree_mrr", "null_top")


_FLOW = _UN + """,
wi AS (SELECT x.item AS src, y.item AS tgt, count(*) AS k FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item <> y.item AND x.pos < y.pos GROUP BY 1, 2),
ac AS (SELECT x.item AS src, y.item AS tgt, count(*) AS k FROM at_ x JOIN at_ y ON x.group_id = y.group_id AND y.rn = x.rn + 1 AND x.item <> y.item GROUP BY 1, 2),
fl AS MATERIALIZED (SELECT src, tgt, sum(k)::BIGINT AS k FROM (SELECT * FROM wi UNION ALL SELECT * FROM ac) GROUP BY 1, 2)"""


@query("event_flow", sql("days", "SELECT src, tgt, k FROM fl", _FLOW))
def event_flow(spark, sf_dir):
    """FLO-1."""
    return L.flow(days(spark, sf_dir))


@query("event_flow_raw", sql("days", """SELECT src, tgt, sum(k)::BIGINT AS k FROM (SELECT * FROM wi UNION ALL SELECT x.item, y.item, count(*) FROM inc x JOIN inc y ON x.group_id = y.group_id AND y.unit_seq = x.unit_seq + 1 AND x.item <> y.item GROUP BY 1, 2) GROUP BY 1, 2""", """
wi AS (SELECT x.item AS src, y.item AS tgt, count(*) AS k FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item <> y.item AND x.pos < y.pos GROUP BY 1, 2)"""))
def event_flow_raw(spark, sf_dir):
    """FLO-2: the next calendar day, not the next active one."""
    return L.flow(days(spark, sf_dir), raw_step=1)


_ORI = """,
of_ AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, sum(CASE WHEN src < tgt THEN k ELSE 0 END)::BIGINT AS f, sum(CASE WHEN src > tgt THEN k ELSE 0 END)::BIGINT AS g FROM fl GROUP BY 1, 2)"""


@query("oriented_flow", sql("days", "SELECT CASE WHEN f >= g THEN a ELSE b END AS src, CASE WHEN f >= g THEN b ELSE a END AS tgt, f + g AS total, round(greatest(f, g)::DOUBLE / (f + g), 6) AS direction FROM of_ WHERE f + g >= 8", _FLOW + _ORI))
def oriented_flow(spark, sf_dir):
    """FLO-3."""
    return rounded(L.oriented(L.flow(days(spark, sf_dir))), "direction")


@query("net_outflow", sql("days", "SELECT node, sum(o)::BIGINT AS out, sum(i)::BIGINT AS into, sum(o - i)::BIGINT AS net FROM (SELECT src AS node, k AS o, 0 AS i FROM fl UNION ALL SELECT tgt, 0, k FROM fl) GROUP BY 1", _FLOW))
def net_outflow(spark, sf_dir):
    """FLO-4."""
    return L.net_outflow(L.flow(days(spark, sf_dir)))


@query("flow_into_classes", sql("days", "SELECT src, class, sum(k)::BIGINT AS k FROM fl JOIN cl c ON c.item = tgt WHERE NOT EXISTS (SELECT 1 FROM cl d WHERE d.item = src AND d.class = c.class) GROUP BY 1, 2", _FLOW + ", cl(class, item) AS (VALUES ('act', 'purchase'), ('act', 'signup'), ('look', 'view'), ('look', 'click'))"))
def flow_into_classes(spark, sf_dir):
    """FLO-5, FLO-11."""
    cl = spark.createDataFrame([("act", "purchase"), ("act", "signup"), ("look", "view"), ("look", "click")], "class string, item string")
    return L.into_classes(L.flow(days(spark, sf_dir)), cl)


def _half(n: int) -> str:
    return f"""
h{n} AS MATERIALIZED (SELECT * FROM inc WHERE (group_id % 2) = {n}),
u{n} AS (SELECT group_id, unit_seq, row_number() OVER (PARTITION BY group_id ORDER BY unit_seq) AS rn FROM (SELECT DISTINCT group_id, unit_seq FROM h{n})),
t{n} AS (SELECT i.group_id, i.item, u.rn FROM h{n} i JOIN u{n} u USING (group_id, unit_seq)),
f{n} AS (SELECT src, tgt, sum(k)::BIGINT AS k FROM (SELECT x.item AS src, y.item AS tgt, count(*) AS k FROM h{n} x JOIN h{n} y ON x.unit_seq = y.unit_seq AND x.item <> y.item AND x.pos < y.pos GROUP BY 1, 2
  UNION ALL SELECT x.item, y.item, count(*) FROM t{n} x JOIN t{n} y ON x.group_id = y.group_id AND y.rn = x.rn + 1 AND x.item <> y.item GROUP BY 1, 2) GROUP BY 1, 2),
p{n} AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, sum(CASE WHEN src < tgt THEN k ELSE 0 END)::DOUBLE AS f, sum(CASE WHEN src > tgt THEN k ELSE 0 END)::DOUBLE AS g FROM f{n} GROUP BY 1, 2 HAVING sum(k) >= 8)"""


@query("stable_flow", sql("days", """SELECT CASE WHEN x.f >= x.g THEN a ELSE b END AS src, CASE WHEN x.f >= x.g THEN b ELSE a END AS tgt, round(greatest(x.f, x.g) / (x.f + x.g), 6) AS d1, round(CASE WHEN x.f >= x.g THEN y.f ELSE y.g END / (y.f + y.g), 6) AS d2,
  greatest(x.f, x.g) / (x.f + x.g) >= 0.6 AND CASE WHEN x.f >= x.g THEN y.f ELSE y.g END / (y.f + y.g) >= 0.6 AS kept FROM p0 x JOIN p1 y USING (a, b)""", _half(0) + "," + _half(1)))
def stable_flow(spark, sf_dir):
    """FLO-8: users of even and of odd number as halves; a split is the operator."""
    inc = days(spark, sf_dir)
    half = lambda n: L.flow(inc.where(F.col("group_id") % 2 == n))
    return rounded(L.stable(half(0), half(1)), "d1", "d2")


# --------------------------------------------------------------------------- resampling

_OWN = """
ow AS MATERIALIZED (SELECT group_id, unit_seq, row_number() OVER (PARTITION BY group_id ORDER BY unit_seq) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS n FROM (SELECT DISTINCT group_id, unit_seq FROM inc))"""


@query("bootstrap_sizes", sql("brands", """SELECT rep, count(*) AS units, round(avg(size), 6) AS mean_size FROM (
  SELECT p.rep, o.unit_seq FROM (SELECT rep, group_id, ('0x' || substr(md5('1|' || rep || '|' || group_id || '|' || i), 1, 8))::BIGINT % n AS j FROM ow, (SELECT unnest(range(0, 20))::INT AS rep)) p JOIN ow o ON o.group_id = p.group_id AND o.i = p.j) JOIN sz USING (unit_seq) GROUP BY 1""", _OWN + ", sz AS (SELECT unit_seq, count(*) AS size FROM inc GROUP BY 1)"))
def bootstrap_sizes(spark, sf_dir):
    """RES-1, AGG-27: twenty resamples of units within groups."""
    inc = brands(spark, sf_dir)
    size = inc.groupBy("unit_seq").agg(F.count("*").alias("size"))
    reps = M.bootstrap(inc.select("group_id", "unit_seq").distinct(), "unit_seq", "group_id", 20)
    return reps.join(size, "unit_seq").groupBy("rep").agg(F.count("*").alias("units"), F.round(F.avg("size"), 6).alias("mean_size"))


@query("bootstrap_interval", sql("brands", """SELECT round(avg(m), 6) AS mean, round(max(m) FILTER (r = 6), 6) AS low, round(max(m) FILTER (r = 195), 6) AS high FROM (SELECT m, row_number() OVER (ORDER BY m, rep) AS r FROM (SELECT rep, avg(size) AS m FROM (
  SELECT p.rep, o.unit_seq FROM (SELECT rep, group_id, ('0x' || substr(md5('1|' || rep || '|' || group_id || '|' || i), 1, 8))::BIGINT % n AS j FROM ow, (SELECT unnest(range(0, 200))::INT AS rep)) p JOIN ow o ON o.group_id = p.group_id AND o.i = p.j) JOIN sz USING (unit_seq) GROUP BY 1))""", _OWN + ", sz AS (SELECT unit_seq, count(*) AS size FROM inc GROUP BY 1)"))
def bootstrap_interval(spark, sf_dir):
    """AGG-27: nearest-rank 2.5 and 97.5 percentiles of 200 means."""
    inc = brands(spark, sf_dir)
    size = inc.groupBy("unit_seq").agg(F.count("*").alias("size"))
    reps = M.bootstrap(inc.select("group_id", "unit_seq").distinct(), "unit_seq", "group_id", 200)
    means = reps.join(size, "unit_seq").groupBy("rep").agg(F.avg("size").alias("m")).withColumn("g", F.lit(0))
    low, high = S.nearest_rank(means, "g", "m", 0.025), S.nearest_rank(means, "g", "m", 0.97)
    return means.groupBy("g").agg(F.avg("m").alias("mean")).join(low.withColumnRenamed("value", "low"), "g").join(high.withColumnRenamed("value", "high"), "g").select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("subsample_pairs", sql("brands", """SELECT rep, count(*) AS pairs, sum(k)::BIGINT AS support FROM (SELECT rep, x.item AS a, y.item AS b, count(*) AS k FROM ss JOIN inc x USING (unit_seq) JOIN inc y ON y.unit_seq = x.unit_seq AND x.item < y.item GROUP BY 1, 2, 3) GROUP BY 1""", """
ss AS (SELECT rep, unit_seq FROM (SELECT rep, unit_seq, row_number() OVER (PARTITION BY rep, group_id ORDER BY md5('1|' || rep || '|' || unit_seq), unit_seq) AS r, count(*) OVER (PARTITION BY rep, group_id) AS n
  FROM (SELECT DISTINCT group_id, unit_seq FROM inc), (SELECT unnest(range(0, 5))::INT AS rep)) WHERE r <= floor(0.5::DOUBLE * n))"""))
def subsample_pairs(spark, sf_dir):
    """RES-2: pair counts of halves of each group's units."""
    inc = brands(spark, sf_dir)
    half = M.subsample(inc.select("group_id", "unit_seq").distinct(), "unit_seq", "group_id", 0.5, 5).select("rep", "unit_seq")
    rows = half.join(K.pair_rows(inc).select("unit_seq", "a", "b"), "unit_seq").groupBy("rep", "a", "b").agg(F.count("*").alias("k"))
    return rows.groupBy("rep").agg(F.count("*").alias("pairs"), F.sum("k").alias("support"))


@query("order_null", sql("brands", "SELECT relation, src, tgt, total, round(asymmetry, 6) AS asymmetry FROM (SELECT 'PRECEDES' AS relation, CASE WHEN ab > ba THEN a ELSE b END AS src, CASE WHEN ab > ba THEN b ELSE a END AS tgt, ab + ba AS total, abs((ab - ba)::DOUBLE / (ab + ba)) AS asymmetry FROM np WHERE ab + ba >= 10 AND abs((ab - ba)::DOUBLE / (ab + ba)) >= 0.05)", """
ni AS MATERIALIZED (SELECT group_id, unit_seq, item, row_number() OVER (PARTITION BY unit_seq ORDER BY md5('1|' || unit_seq || '|' || item), item) AS pos FROM inc),
np AS (SELECT x.item AS a, y.item AS b, sum((x.pos < y.pos)::INT)::BIGINT AS ab, sum((x.pos > y.pos)::INT)::BIGINT AS ba FROM ni x JOIN ni y ON x.unit_seq = y.unit_seq AND x.item < y.item GROUP BY 1, 2)"""))
def order_null(spark, sf_dir):
    """RES-7: what order within units is left when it is dealt anew."""
    return rounded(R.precedes(M.shuffled_in_unit(brands(spark, sf_dir)), min_asym=0.05).where("relation = 'PRECEDES'"), "asymmetry")


@query("label_null", """WITH a AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
b AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('1|' || c_custkey), c_custkey) AS i FROM customer) SELECT a.c_custkey, b.c_mktsegment FROM a JOIN b USING (c_nationkey, i)""")
def label_null(spark, sf_dir):
    """RES-10."""
    return M.shuffled_labels(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", "c_nationkey").select("c_custkey", "c_mktsegment")


@query("stride_perturbation", sql("brands", "SELECT unit_seq, item FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY unit_seq, item) - 1 AS i FROM inc) WHERE i % 10 <> 0"))
def stride_perturbation(spark, sf_dir):
    """RES-14: the operator leaves every tenth row out."""
    return M.stride_drop(brands(spark, sf_dir), "group_id", ["unit_seq", "item"], 10).select("unit_seq", "item")


@query("token_null", sql("brands", """SELECT p.unit_seq, t.item, min(p.i)::BIGINT AS pos FROM (SELECT group_id, unit_seq, row_number() OVER (PARTITION BY group_id ORDER BY unit_seq, item) AS i FROM inc) p
JOIN (SELECT group_id, item, row_number() OVER (PARTITION BY group_id ORDER BY md5('1|' || unit_seq || '|' || item), unit_seq, item) AS i FROM inc) t USING (group_id, i) GROUP BY 1, 2"""))
def token_null(spark, sf_dir):
    """RES-3: tokens dealt anew to unit places within a group."""
    return M.shuffled_tokens(brands(spark, sf_dir)).select("unit_seq", "item", "pos")


@query("window_profiles", sql("brands", """SELECT sample, count(*) AS tokens, count(DISTINCT item) AS items FROM (SELECT sample, o.unit_seq FROM ow o JOIN (SELECT group_id, sample, size, ('0x' || substr(md5('1|' || sample || '|' || group_id), 1, 8))::BIGINT % (n - size + 1) AS start
  FROM (SELECT DISTINCT group_id, n, greatest(1, floor(0.3::DOUBLE * n)::BIGINT) AS size FROM ow), (SELECT unnest(range(0, 10))::INT AS sample)) s ON s.group_id = o.group_id AND o.i >= start AND o.i < start + size) JOIN inc USING (unit_seq) GROUP BY 1""", _OWN))
def window_profiles(spark, sf_dir):
    """RES-16: runs of 30 % of each group's units from hashed starts."""
    inc = brands(spark, sf_dir)
    w = M.random_windows(inc.select("group_id", "unit_seq").distinct(), "unit_seq", "group_id", 0.3, 10)
    return w.select("sample", "unit_seq").join(inc.select("unit_seq", "item"), "unit_seq").groupBy("sample").agg(F.count("*").alias("tokens"), F.count_distinct("item").alias("items"))


@query("edge_noise", sql("brands", "SELECT rep, count(*) AS edges FROM (SELECT a, b, rep FROM pr, (SELECT unnest(range(0, 10))::INT AS rep) WHERE k >= 5) WHERE ('0x' || substr(md5('1|' || rep || '|' || a || '|' || b), 1, 8))::BIGINT >= 858993459 GROUP BY 1"))
def edge_noise(spark, sf_dir):
    """RES-6: each edge is lost with probability 0.2."""
    edges = K.pairs(brands(spark, sf_dir)).where("k >= 5").select(F.col("a").alias("src"), F.col("b").alias("tgt"))
    return M.noisy_edges(edges, 0.2, 10).groupBy("rep").agg(F.count("*").alias("edges"))


@query("edge_rewiring", sql("words", """SELECT rep, count(*) AS edges, count(*) FILTER (g.src IS NULL) AS moved FROM (
  SELECT rep, src, tgt FROM rw WHERE (rep, src, tgt) NOT IN (SELECT (rep, a, b) FROM dn UNION ALL SELECT (rep, c, d) FROM dn) UNION ALL SELECT rep, a, d FROM dn UNION ALL SELECT rep, c, b FROM dn) f LEFT JOIN pe g USING (src, tgt) GROUP BY 1""", _PRE[1:] + """,
pe AS MATERIALIZED (SELECT DISTINCT src, tgt FROM pre), rw AS MATERIALIZED (SELECT rep, src, tgt FROM pe, (SELECT unnest(range(0, 5))::INT AS rep)),
ch AS (SELECT *, ('0x' || substr(md5('1|bucket|' || rep || '|' || src || '|' || tgt), 1, 8))::BIGINT % 16 AS bucket FROM rw WHERE ('0x' || substr(md5('1|' || rep || '|' || src || '|' || tgt), 1, 8))::BIGINT < 858993459),
at2 AS (SELECT *, row_number() OVER (PARTITION BY rep, bucket ORDER BY md5('1|' || rep || '|' || src || '|' || tgt), src, tgt) - 1 AS r FROM ch),
du AS MATERIALIZED (SELECT * FROM (SELECT rep, bucket, r // 2 AS duo, max(src) FILTER (r % 2 = 0) AS a, max(tgt) FILTER (r % 2 = 0) AS b, max(src) FILTER (r % 2 = 1) AS c, max(tgt) FILTER (r % 2 = 1) AS d FROM at2 GROUP BY 1, 2, 3)
  WHERE a <> c AND b <> d AND a <> d AND c <> b AND a <> b AND c <> d),
mk2 AS MATERIALIZED (SELECT rep, bucket, duo, a AS src, d AS tgt FROM du UNION ALL SELECT rep, bucket, duo, c, b FROM du),
vo AS (SELECT rep, bucket, duo FROM mk2 SEMI JOIN pe USING (src, tgt) UNION SELECT rep, bucket, duo FROM (SELECT *, count(*) OVER (PARTITION BY rep, src, tgt) AS n FROM mk2) WHERE n > 1),
dn AS MATERIALIZED (SELECT * FROM du ANTI JOIN vo USING (rep, bucket, duo))"""))
def edge_rewiring(spark, sf_dir):
    """RES-6: order edges of words with exchanged targets; degrees stay."""
    edges = written(R.precedes(words(spark, sf_dir)).where("relation = 'PRECEDES'").select("src", "tgt").distinct())
    after = M.rewired_edges(edges, 0.2, 5)
    return after.join(edges.withColumn("old", F.lit(1)), ["src", "tgt"], "left").groupBy("rep").agg(F.count("*").alias("edges"), F.count_if(F.col("old").isNull()).alias("moved"))


@query("order_nulls", sql("brands", """SELECT sample, coalesce(recurring, 0) AS recurring, coalesce(ordered, 0) AS ordered FROM (SELECT DISTINCT sample FROM cell)
  LEFT JOIN (SELECT x.sample, count(*) AS recurring FROM cell x JOIN cell y ON x.sample = y.sample AND x.group_id = y.group_id AND x.item = y.item AND y.rn = x.rn + 1 GROUP BY 1) USING (sample)
  LEFT JOIN (SELECT sample, count(*) AS ordered FROM (SELECT x.sample, x.item AS a, y.item AS b, sum((x.pos < y.pos)::INT) AS ab, sum((x.pos > y.pos)::INT) AS ba FROM cell x JOIN cell y ON x.sample = y.sample AND x.group_id = y.group_id AND x.rn = y.rn AND x.item < y.item GROUP BY 1, 2, 3) WHERE ab + ba >= 10 AND abs((ab - ba)::DOUBLE / (ab + ba)) >= 0.1 GROUP BY 1) USING (sample)""", """
un AS MATERIALIZED (SELECT group_id, unit_seq, row_number() OVER (PARTITION BY group_id ORDER BY unit_seq) AS i, row_number() OVER (PARTITION BY group_id ORDER BY md5('1|' || unit_seq), unit_seq) AS h FROM (SELECT DISTINCT group_id, unit_seq FROM inc)),
wo AS (SELECT group_id, unit_seq, item, row_number() OVER (PARTITION BY unit_seq ORDER BY md5('1|' || unit_seq || '|' || item), item) AS pos FROM inc),
cell AS MATERIALIZED (SELECT 'observed' AS sample, group_id, i AS rn, item, pos FROM inc JOIN un USING (group_id, unit_seq) UNION ALL SELECT 'items', group_id, i, item, pos FROM wo JOIN un USING (group_id, unit_seq)
  UNION ALL SELECT 'units', group_id, h, item, pos FROM inc JOIN un USING (group_id, unit_seq) UNION ALL SELECT 'both', group_id, h, item, pos FROM wo JOIN un USING (group_id, unit_seq))"""))
def order_nulls(spark, sf_dir):
    """RES-7: items found again in the next unit, and pairs of a firm order, as observed and with the order of items, of units and of both dealt anew."""
    inc = written(brands(spark, sf_dir))
    parts = []
    for name, d in (("observed", inc), ("items", M.shuffled_in_unit(inc)), ("units", M.shuffled_units(inc)), ("both", M.shuffled_units(M.shuffled_in_unit(inc)))):
        here = d.join(R.numbered_units(d), ["group_id", "unit_seq"]).select("group_id", "item", "rn")
        again = here.join(here.select("group_id", "item", (F.col("rn") - 1).alias("rn")), ["group_id", "item", "rn"]).agg(F.count("*").alias("recurring"))
        firm = R.precedes(d, min_asym=0.1).where("relation = 'PRECEDES'").agg(F.count("*").alias("ordered"))
        parts.append(again.join(firm).select(F.lit(name).alias("sample"), "recurring", "ordered"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("support_sweep", sql("baskets", "SELECT t AS threshold, count(*) FILTER (k >= t) AS pairs FROM pr, (SELECT unnest([1, 2, 5, 10, 20, 40])::INT AS t) GROUP BY 1"))
def support_sweep(spark, sf_dir):
    """RES-17."""
    at = F.explode(F.array(*map(F.lit, (1, 2, 5, 10, 20, 40)))).alias("threshold")
    return K.pairs(baskets(spark, sf_dir)).select("k", at).groupBy("threshold").agg(F.count_if(F.col("k") >= F.col("threshold")).alias("pairs"))


@query("generated_units")
def generated_units(spark, sf_dir):
    """RES-8: units of the same sizes with items by frequency; tested against its definition."""
    inc = brands(spark, sf_dir)
    sizes = inc.groupBy("unit_seq").agg(F.count("*").alias("size"))
    return M.weighted_units(sizes, K.marginals(inc).select("item", F.col("c").cast("double").alias("w")))


@query("curveball_null")
def curveball_null(spark, sf_dir):
    """RES-4: pair counts of days under trades that keep unit sizes and frequencies; a pair that a repetition lacks counts as 0 there."""
    inc, reps = days(spark, sf_dir), 10
    null = kernels.traded_pairs(inc.select("unit_seq", "item"), reps)
    lists = null.groupBy("a", "b").agg(F.collect_list(F.col("k").cast("double")).alias("ks"))  # one number a repetition
    mean = F.aggregate("ks", F.lit(0.0), lambda x, k: x + k) / reps
    spread = lambda m: F.aggregate("ks", (reps - F.size("ks")) * m * m, lambda x, k: x + (k - m) * (k - m))
    stats = lists.withColumn("mean", mean).select("a", "b", "mean", F.sqrt(spread(F.col("mean")) / reps).alias("std"))
    seen = K.pairs(inc).select("a", "b", "k")
    return seen.join(stats, ["a", "b"], "left").fillna(0.0, ["mean", "std"]).select("a", "b", "k", F.round("mean", 6).alias("mean"), F.round(S.z_score(F.col("k"), F.col("mean"), F.col("std")), 6).alias("z"))


@query("swap_null")
def swap_null(spark, sf_dir):
    """RES-5: mutual pairs of the supplier order graph under degree-preserving swaps."""
    edges = R.precedes(baskets(spark, sf_dir)).where("relation = 'PRECEDES'").select("src", "tgt")

    def one(pdf: pd.DataFrame, rng) -> pd.DataFrame:
        e = kernels.swap_edges(list(zip(pdf["src"], pdf["tgt"], strict=True)), 3 * len(pdf), rng)
        have = set(e)
        return pd.DataFrame([(len(e), sum((b, a) in have for a, b in e) // 2)], columns=["edges", "mutual"])

    return kernels.repeated(edges, 10, one, "edges long, mutual long")


@query("growth_fit")
def growth_fit(spark, sf_dir):
    """RES-12, RES-13: mutual share of grown graphs over a grid of rules; each cell a kernel."""
    grid = spark.createDataFrame([(b, c, g) for b in (0.0, 0.2, 0.4) for c in (0.0, 0.2) for g in (0.0, 1.0)], "back double, close double, gamma double")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        back, close, gamma = (float(pdf[c].iloc[0]) for c in ("back", "close", "gamma"))
        e = kernels.grown(60, 300, back, close, gamma, np.random.default_rng([1, int(10 * back), int(10 * close), int(gamma)]))
        into = np.bincount([t for _, t in e], minlength=60)
        return pd.DataFrame([(back, close, gamma, len(e), sum((b, a) in e for a, b in e) / max(1, len(e)), float(np.sort(into)[-6:].sum() / max(1, len(e))))], columns=["back", "close", "gamma", "edges", "reciprocity", "hub_share"])

    return rounded(grid.groupBy("back", "close", "gamma").applyInPandas(one, "back double, close double, gamma double, edges long, reciprocity double, hub_share double"), "reciprocity", "hub_share")
