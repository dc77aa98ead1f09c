"""Association and relation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import counts as K
from ..operators import incidence as I
from ..operators import relations as R
from ..operators.rounds import written
from .base import baskets, brands, days, lines, query, rounded, sql, table, words

NPMI = "CASE WHEN k >= n THEN 1.0::DOUBLE ELSE ln((k::DOUBLE / n) / ((ca::DOUBLE / n) * (cb::DOUBLE / n))) / -ln(k::DOUBLE / n) END"
PMI = "ln((k::DOUBLE / n) / ((ca::DOUBLE / n) * (cb::DOUBLE / n)))"
PPMI = "log2((k::DOUBLE / n) / ((c_src::DOUBLE / n) * (c_tgt::DOUBLE / n)))"


def _co(where: str = "") -> str:
    return f"""SELECT a, b, k, ca, cb, round(least(k::DOUBLE / ca, k::DOUBLE / cb), 6) AS confidence, round({PMI}, 6) AS pmi, round({NPMI}, 6) AS npmi,
  ((k >= 4)::INT + (k >= 6)::INT) / 2.0::DOUBLE AS stability FROM pm WHERE k >= 5 {where}"""


@query("associations", sql("words", _co(f"AND {NPMI} >= 0.2")))
def associations(spark, sf_dir):
    """AGG-1, JOI-9, REL-1..4, REL-11 over all words of lines: the flagship."""
    return rounded(R.associates(words(spark, sf_dir)), "confidence", "pmi", "npmi")


@query("co_occurrence_brands", sql("brands", _co()))
def co_occurrence_brands(spark, sf_dir):
    """REL-3 over orders by brand."""
    return rounded(R.co_occurs(brands(spark, sf_dir)), "confidence", "pmi", "npmi")


@query("co_occurrence_suppliers", sql("baskets", _co()))
def co_occurrence_suppliers(spark, sf_dir):
    """REL-3 over orders by supplier."""
    return rounded(R.co_occurs(baskets(spark, sf_dir)), "confidence", "pmi", "npmi")


@query("document_frequency", sql("words", "SELECT item, c AS df FROM m"))
def document_frequency(spark, sf_dir):
    """AGG-1."""
    return K.marginals(words(spark, sf_dir)).withColumnRenamed("c", "df")


@query("common_words", sql("lines", "SELECT group_id, unit_seq, item, pos FROM inc"))
def common_words(spark, sf_dir):
    """FIL-3: the vocabulary cut, which graph, vector and null-model queries over lines start from."""
    return lines(spark, sf_dir)


@query("depends_on", sql("words", "SELECT src, tgt, k, round(k::DOUBLE / c_tgt, 6) AS confidence, round((k::DOUBLE / c_tgt) / (c_src::DOUBLE / n), 6) AS lift, ((k >= 4)::INT + (k >= 6)::INT) / 2.0::DOUBLE AS stability FROM orn WHERE k >= 5 AND k::DOUBLE / c_tgt >= 0.3 AND (k::DOUBLE / c_tgt) / (c_src::DOUBLE / n) >= 2"))
def depends_on(spark, sf_dir):
    """REL-5."""
    return rounded(R.depends_on(words(spark, sf_dir)), "confidence", "lift")


@query("requires", sql("words", "SELECT src, tgt, k, round(k::DOUBLE / c_src, 6) AS confidence FROM orn WHERE k >= 5 AND k::DOUBLE / c_src >= 0.9"))
def requires(spark, sf_dir):
    """REL-6."""
    return rounded(R.requires(words(spark, sf_dir)), "confidence")


_PRE = """,
pre AS (SELECT CASE WHEN ab > ba THEN a ELSE b END AS src, CASE WHEN ab > ba THEN b ELSE a END AS tgt, ab + ba AS total, abs((ab - ba)::DOUBLE / (ab + ba)) AS asymmetry
  FROM pr WHERE ab + ba >= 10 AND abs((ab - ba)::DOUBLE / (ab + ba)) >= 0.3)"""
_PRE_ROWS = "SELECT 'PRECEDES' AS relation, src, tgt, total, round(asymmetry, 6) AS asymmetry FROM pre UNION ALL SELECT 'FOLLOWS', tgt, src, total, round(asymmetry, 6) FROM pre"


@query("precedes", sql("words", _PRE_ROWS, _PRE[1:]))
def precedes(spark, sf_dir):
    """REL-7: PRECEDES and its mirror FOLLOWS."""
    return rounded(R.precedes(words(spark, sf_dir)), "asymmetry")


@query("precedes_suppliers", sql("baskets", _PRE_ROWS, _PRE[1:]))
def precedes_suppliers(spark, sf_dir):
    """REL-7 over orders, with ties in position."""
    return rounded(R.precedes(baskets(spark, sf_dir)), "asymmetry")


def _predicts(conf: float, lift: float) -> str:
    return f"""SELECT w, src, tgt, k, round(k::DOUBLE / f, 6) AS confidence, round((k::DOUBLE / f) / (c::DOUBLE / n), 6) AS lift FROM met JOIN base USING (w, src) JOIN m ON m.item = tgt, nn
WHERE k >= 5 AND k::DOUBLE / f >= {conf} AND (k::DOUBLE / f) / (c::DOUBLE / n) >= {lift}"""


_OFFSET = """
un AS (SELECT group_id, unit_seq, row_number() OVER (PARTITION BY group_id ORDER BY unit_seq) AS rn FROM (SELECT DISTINCT group_id, unit_seq FROM inc)),
at_ AS MATERIALIZED (SELECT i.group_id, i.item, u.rn FROM inc i JOIN un u USING (group_id, unit_seq)),
st AS MATERIALIZED (SELECT t.w, x.item AS src, x.group_id, x.rn + t.w AS rn FROM at_ x, (SELECT unnest([1, 2, 3])::INT AS w) t JOIN un u ON u.group_id = x.group_id AND u.rn = x.rn + t.w),
base AS (SELECT w, src, count(*) AS f FROM st GROUP BY 1, 2),
met AS (SELECT s.w, s.src, y.item AS tgt, count(*) AS k FROM st s JOIN at_ y ON y.group_id = s.group_id AND y.rn = s.rn WHERE s.src <> y.item GROUP BY 1, 2, 3)"""


@query("predicts", sql("lines", _predicts(0.2, 1.5), _OFFSET))
def predicts(spark, sf_dir):
    """REL-8, JOI-12: items one to three units ahead."""
    return rounded(R.predicts(lines(spark, sf_dir)), "confidence", "lift")


@query("predicts_days", sql("days", _predicts(0.0, 0.0), _OFFSET))
def predicts_days(spark, sf_dir):
    """REL-8 over a user's days, at thresholds that keep everything."""
    return rounded(R.predicts(days(spark, sf_dir), min_conf=0.0, min_lift=0.0), "confidence", "lift")


_TRIPLES = """
of AS MATERIALIZED (SELECT a, b FROM pr WHERE k >= 3),
tr AS MATERIALIZED (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS k FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item < y.item JOIN inc z ON z.unit_seq = y.unit_seq AND y.item < z.item
  SEMI JOIN of p ON p.a = x.item AND p.b = y.item SEMI JOIN of q ON q.a = x.item AND q.b = z.item SEMI JOIN of r ON r.a = y.item AND r.b = z.item GROUP BY 1, 2, 3 HAVING count(*) >= 3),
tu AS MATERIALIZED (SELECT a AS x, b AS y, c AS z, k FROM tr UNION ALL SELECT a, c, b, k FROM tr UNION ALL SELECT b, c, a, k FROM tr)"""


@query("triples_brands", sql("brands", "SELECT a, b, c, k FROM tr", _TRIPLES))
def triples_brands(spark, sf_dir):
    """JOI-10: frequent triples through frequent pairs."""
    return K.triples(brands(spark, sf_dir))


@query("mediates_brands", sql("brands", "SELECT x AS a, y AS d, z AS m, tu.k, pr.k AS pair, round(tu.k::DOUBLE / pr.k, 6) AS confidence, round(tu.k::DOUBLE / pr.k, 6) AS isolation FROM tu JOIN pr ON pr.a = x AND pr.b = y WHERE tu.k >= 5 AND pr.k >= 5 AND tu.k::DOUBLE / pr.k >= 0.2", _TRIPLES))
def mediates_brands(spark, sf_dir):
    """REL-9, at a threshold that independent baskets reach."""
    inc = brands(spark, sf_dir)
    return rounded(R.mediates(inc, K.triples(inc), min_conf=0.2), "confidence", "isolation")


_EMERGES = _TRIPLES + """,
cp AS (SELECT a AS x, b AS e, k FROM pr UNION ALL SELECT b, a, k FROM pr),
cd AS MATERIALIZED (SELECT x, e, k::DOUBLE / c AS p FROM cp JOIN m ON m.item = x),
em AS (SELECT tu.x AS a, tu.y AS b, tu.z AS e, tu.k, pr.k AS pair, tu.k::DOUBLE / pr.k - greatest(coalesce(p.p, 0), coalesce(q.p, 0)) AS synergy
  FROM tu JOIN pr ON pr.a = tu.x AND pr.b = tu.y LEFT JOIN cd p ON p.x = tu.x AND p.e = tu.z LEFT JOIN cd q ON q.x = tu.y AND q.e = tu.z WHERE tu.k >= 5 AND pr.k >= 5)"""


@query("emerges_brands", sql("brands", "SELECT a, b, e, k, pair, round(synergy, 6) AS synergy FROM em WHERE synergy >= 0.02", _EMERGES))
def emerges_brands(spark, sf_dir):
    """REL-10, at a threshold that independent baskets reach."""
    inc = brands(spark, sf_dir)
    return rounded(R.emerges(inc, K.triples(inc), min_synergy=0.02), "synergy")


_EXC = "SELECT x.item AS a, x.c AS ca, y.item AS b, y.c AS cb FROM m x JOIN m y ON x.item < y.item AND x.c >= 30 AND y.c >= 30 ANTI JOIN pr ON pr.a = x.item AND pr.b = y.item"


@query("excludes", sql("lines", _EXC))
def excludes(spark, sf_dir):
    """REL-12, JOI-14."""
    return R.excludes(lines(spark, sf_dir)).select("a", "ca", "b", "cb")


_PP = f"""
pe AS MATERIALIZED (SELECT src AS item, tgt AS dim, {PPMI} AS w, k, c_src AS df FROM orn WHERE {PPMI} > 0)"""
_VEC = _PP + """,
vec AS MATERIALIZED (SELECT item, dim, w FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(w, 9) DESC, dim) AS r FROM pe) WHERE r <= 100)"""


@query("ppmi_vectors_brands", sql("brands", "SELECT item, dim, round(w, 6) AS w FROM vec", _VEC))
def ppmi_vectors_brands(spark, sf_dir):
    """REL-1, WIN-2."""
    return rounded(R.ppmi_vectors(brands(spark, sf_dir)), "w")


_NEAR = _PP + """,
fl AS (SELECT *, (k >= greatest(2, least(6, round_even(df * 0.02::DOUBLE, 0)::INT)))::INT AS ok FROM pe),
fm AS (SELECT *, max(ok) OVER (PARTITION BY item) AS any_ok FROM fl),
nb AS MATERIALIZED (SELECT item, dim AS neighbour, row_number() OVER (PARTITION BY item ORDER BY round(w, 9) DESC, k DESC, dim) AS rank, w, k FROM fm WHERE ok = 1 OR any_ok = 0)"""


@query("neighbours", sql("lines", "SELECT item, neighbour, rank::INT AS rank, round(w, 6) AS w, k FROM nb WHERE rank <= 20", _NEAR))
def neighbours(spark, sf_dir):
    """REL-13: top twenty by PPMI above a floor that follows frequency."""
    return rounded(R.neighbours(lines(spark, sf_dir)), "w")


_COS = _VEC + """,
nr AS (SELECT item, sqrt(sum(w * w)) AS n FROM vec GROUP BY item),
cs AS MATERIALIZED (SELECT x.item AS a, y.item AS b, sum(x.w * y.w) / (any_value(p.n) * any_value(q.n)) AS cos FROM vec x JOIN vec y ON x.dim = y.dim AND x.item < y.item JOIN nr p ON p.item = x.item JOIN nr q ON q.item = y.item GROUP BY 1, 2)"""
_SIM = _COS + """,
gp AS MATERIALIZED (SELECT item, group_id, count(*)::DOUBLE AS w FROM inc GROUP BY 1, 2),
gn AS (SELECT item, sqrt(sum(w * w)) AS n FROM gp GROUP BY 1),
gd AS (SELECT x.item AS a, y.item AS b, sum(x.w * y.w) AS d FROM gp x JOIN gp y ON x.group_id = y.group_id AND x.item < y.item GROUP BY 1, 2),
bl AS (SELECT cs.a, cs.b, cos, coalesce(d, 0) / (p.n * q.n) AS g FROM cs JOIN gn p ON p.item = cs.a JOIN gn q ON q.item = cs.b LEFT JOIN gd ON gd.a = cs.a AND gd.b = cs.b)"""


@query("similar_words", sql("lines", "SELECT a, b, round(cos, 6) AS cos_ppmi, round(g, 6) AS cos_groups, round(0.7::DOUBLE * cos + (1 - 0.7::DOUBLE) * g, 6) AS score FROM bl WHERE 0.7::DOUBLE * cos + (1 - 0.7::DOUBLE) * g >= 0.05", _SIM))
def similar_words(spark, sf_dir):
    """REL-14, JOI-11, AGG-20."""
    return rounded(R.similar(I.line_items(table(spark, sf_dir, "documents")), min_share=0.004), "cos_ppmi", "cos_groups", "score")


@query("mutual_neighbours", sql("lines", "SELECT x.item AS a, x.neighbour AS b, round(least(x.w, y.w), 6) AS weight FROM nb x JOIN nb y ON y.item = x.neighbour AND y.neighbour = x.item AND x.item < y.item WHERE x.rank <= 20 AND y.rank <= 20", _NEAR))
def mutual_neighbours(spark, sf_dir):
    """JOI-15: an edge where each is the other's neighbour."""
    e = R.neighbours(lines(spark, sf_dir)).select("item", "neighbour", "w")
    back = e.select(F.col("neighbour").alias("item"), F.col("item").alias("neighbour"), F.col("w").alias("w2"))
    return e.join(back, ["item", "neighbour"]).where("item < neighbour").select(F.col("item").alias("a"), F.col("neighbour").alias("b"), F.round(F.least("w", "w2"), 6).alias("weight"))


@query("pair_spans", sql("lines", "SELECT a, b, k, span, CASE WHEN span >= 100 THEN 'global' WHEN span <= 3 THEN 'local' ELSE 'between' END AS kind FROM sp", """
sp AS (SELECT x.item AS a, y.item AS b, count(*) AS k, count(DISTINCT x.group_id) AS span FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item < y.item GROUP BY 1, 2)"""))
def pair_spans(spark, sf_dir):
    """REL-17, SET-3."""
    return R.spans(I.line_items(table(spark, sf_dir, "documents")), wide=100, min_share=0.004)


@query("pair_evidence", sql("brands", "SELECT a, b, unit_seq, r::INT AS r, k FROM ev JOIN pr USING (a, b) WHERE r <= 5 AND k >= 5", """
ev AS (SELECT x.item AS a, y.item AS b, x.unit_seq, row_number() OVER (PARTITION BY x.item, y.item ORDER BY x.unit_seq) AS r FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item < y.item)"""))
def pair_evidence(spark, sf_dir):
    """AGG-4, WIN-9: the first five units of each pair."""
    return R.evidence(brands(spark, sf_dir))


EDGES = _PRE[1:] + f""",
ass AS (SELECT a, b, {NPMI} AS weight, k FROM pm WHERE k >= 5 AND {NPMI} >= 0.2),
ed AS MATERIALIZED (
  SELECT a AS src, b AS tgt, 'ASSOCIATES_WITH' AS type, weight, k AS support FROM ass UNION ALL SELECT b, a, 'ASSOCIATES_WITH', weight, k FROM ass
  UNION ALL SELECT src, tgt, 'DEPENDS_ON', k::DOUBLE / c_tgt, k FROM orn WHERE k >= 5 AND k::DOUBLE / c_tgt >= 0.3 AND (k::DOUBLE / c_tgt) / (c_src::DOUBLE / n) >= 2
  UNION ALL SELECT src, tgt, 'REQUIRES', k::DOUBLE / c_src, k FROM orn WHERE k >= 5 AND k::DOUBLE / c_src >= 0.9
  UNION ALL SELECT src, tgt, 'PRECEDES', asymmetry, total FROM pre)"""


@query("typed_edges", sql("words", "SELECT src, tgt, type, round(weight, 6) AS weight, support FROM ed", EDGES))
def typed_edges(spark, sf_dir):
    """REL-16, SET-1, SET-6."""
    return rounded(R.typed_edges(words(spark, sf_dir)), "weight")


@query("incident_relations", sql("words", "SELECT item, type, count(*) AS n, count(DISTINCT other) AS partners, round(max(weight), 6) AS strongest FROM (SELECT src AS item, tgt AS other, type, weight FROM ed UNION ALL SELECT tgt, src, type, weight FROM ed) GROUP BY 1, 2", EDGES))
def incident_relations(spark, sf_dir):
    """REL-23: relations by participant."""
    e = R.typed_edges(words(spark, sf_dir))
    ends = e.select(F.col("src").alias("item"), F.col("tgt").alias("other"), "type", "weight").unionByName(e.select(F.col("tgt").alias("item"), F.col("src").alias("other"), "type", "weight"))
    return ends.groupBy("item", "type").agg(F.count("*").alias("n"), F.count_distinct("other").alias("partners"), F.round(F.max("weight"), 6).alias("strongest"))


@query("causal_pairs", sql("words", "SELECT src, tgt FROM pre SEMI JOIN (SELECT src AS s, tgt AS t FROM orn WHERE k >= 5 AND k::DOUBLE / c_tgt >= 0.3 AND (k::DOUBLE / c_tgt) / (c_src::DOUBLE / n) >= 2) d ON pre.src = d.s AND pre.tgt = d.t", _PRE[1:]))
def causal_pairs(spark, sf_dir):
    """JOI-20, REL-18: an order that is a dependency too."""
    inc = words(spark, sf_dir)
    full = written(K.full_pairs(inc, 5))
    return R.precedes(inc, full=full).where("relation = 'PRECEDES'").select("src", "tgt").join(R.depends_on(inc, full=full).select("src", "tgt"), ["src", "tgt"], "left_semi")


@query("drift", sql("lines", """SELECT item, round(coalesce(xy / nullif(sqrt(xx::DOUBLE * yy::DOUBLE), 0), 0), 6) AS cos, coalesce(xy / nullif(sqrt(xx::DOUBLE * yy::DOUBLE), 0), 0) >= 0.5 AS stable FROM (
  SELECT item, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, sum(x + y) AS support FROM wd GROUP BY item) WHERE support >= 5""", """
mid AS (SELECT quantile_disc(unit_seq, 0.5) AS q FROM (SELECT DISTINCT unit_seq FROM inc)),
hp AS (SELECT (x.unit_seq > q)::INT AS h, x.item AS a, y.item AS b, count(*) AS k FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item < y.item, mid GROUP BY 1, 2, 3),
hb AS (SELECT h, a AS item, b AS dim, k FROM hp UNION ALL SELECT h, b, a, k FROM hp),
wd AS (SELECT item, dim, sum(CASE WHEN h = 0 THEN k ELSE 0 END)::BIGINT AS x, sum(CASE WHEN h = 1 THEN k ELSE 0 END)::BIGINT AS y FROM hb GROUP BY 1, 2)"""))
def drift(spark, sf_dir):
    """REL-32: neighbour profiles of the first and the second half of all units."""
    inc = lines(spark, sf_dir)
    units = inc.select("unit_seq").distinct()
    mid = units.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unit_seq)").cast("long").alias("q"))
    halves = units.join(F.broadcast(mid)).select("unit_seq", (F.col("unit_seq") > F.col("q")).cast("int").alias("half"))
    return rounded(R.drift(inc, halves), "cos")


_STRICT = "CASE WHEN {0} < 0.95 THEN 'weak_order_cycle' ELSE '{1}' END AS rule, {0} >= 0.95 AS genuine"


@query("contradictions", sql("lines", f"""SELECT 'C1_needs_what_it_excludes' AS rule, true AS genuine, src AS a, tgt AS b, NULL::VARCHAR AS c, NULL::VARCHAR AS d FROM rq SEMI JOIN ex ON ex.a = least(src, tgt) AND ex.b = greatest(src, tgt)
UNION ALL SELECT 'C2_needs_exclusive_items', true, x.src, x.tgt, y.tgt, NULL FROM rq x JOIN rq y ON x.src = y.src AND x.tgt < y.tgt SEMI JOIN ex ON ex.a = x.tgt AND ex.b = y.tgt
UNION ALL SELECT 'depends_on_exclusive_items', false, x.src, x.tgt, y.tgt, NULL FROM dp x JOIN dp y ON x.src = y.src AND x.tgt < y.tgt SEMI JOIN ex ON ex.a = x.tgt AND ex.b = y.tgt
UNION ALL SELECT 'C5_exclusive_mutual_dependency', true, x.src, x.tgt, NULL, NULL FROM dp x JOIN dp y ON x.src = y.tgt AND x.tgt = y.src AND x.src < x.tgt SEMI JOIN ex ON ex.a = x.src AND ex.b = x.tgt
UNION ALL SELECT {_STRICT.format("least(x.asymmetry, y.asymmetry)", "C3_strict_order_both_ways")}, x.src, x.tgt, NULL, NULL FROM oe x JOIN oe y ON x.src = y.tgt AND x.tgt = y.src WHERE x.src < x.tgt
UNION ALL SELECT {_STRICT.format("least(x.asymmetry, y.asymmetry, z.asymmetry)", "C4_strict_order_cycle")}, x.src, y.src, z.src, NULL FROM oe x JOIN oe y ON y.src = x.tgt JOIN oe z ON z.src = y.tgt AND z.tgt = x.src WHERE x.src < y.src AND x.src < z.src
UNION ALL SELECT {_STRICT.format("least(x.asymmetry, y.asymmetry, z.asymmetry, t.asymmetry)", "C4_strict_order_cycle")}, x.src, y.src, z.src, t.src FROM oe x JOIN oe y ON y.src = x.tgt JOIN oe z ON z.src = y.tgt JOIN oe t ON t.src = z.tgt AND t.tgt = x.src WHERE x.src < y.src AND x.src < z.src AND x.src < t.src AND y.src <> t.src""", _PRE[1:] + f""",
oe AS MATERIALIZED (SELECT src, tgt, asymmetry FROM pre WHERE src <> tgt),
dp AS MATERIALIZED (SELECT src, tgt FROM orn WHERE k >= 5 AND k::DOUBLE / c_tgt >= 0.3 AND (k::DOUBLE / c_tgt) / (c_src::DOUBLE / n) >= 2),
rq AS MATERIALIZED (SELECT src, tgt FROM orn WHERE k >= 5 AND k::DOUBLE / c_src >= 0.9), ex AS MATERIALIZED ({_EXC})"""))
def contradictions(spark, sf_dir):
    """REL-28, C1 to C5."""
    inc = lines(spark, sf_dir)
    return R.contradictions(R.requires(inc), R.depends_on(inc), R.excludes(inc), R.precedes(inc).where("relation = 'PRECEDES'"))


@query("identity_checks", """WITH an AS (SELECT p_brand AS concept, p_type AS anchor FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) = 1),
ac AS (SELECT concept, anchor, l_orderkey AS unit, bool_or(p_type = anchor) AS hit FROM lineitem JOIN part ON l_partkey = p_partkey JOIN an ON concept = p_brand GROUP BY 1, 2, 3),
ct AS (SELECT concept, anchor, count(*) AS units, count(*) FILTER (hit) AS held FROM ac GROUP BY 1, 2)
SELECT concept, anchor, units, held, round(held::DOUBLE / units, 6) AS share, CASE WHEN held = 0 THEN 'C6_identity_inversion' WHEN 2 * held < units THEN 'identity_instability' ELSE 'consistent' END AS verdict FROM ct""")
def identity_checks(spark, sf_dir):
    """REL-28, C6: brands by their commonest type in the catalogue, in the orders that hold the brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("concept"), F.col("p_type").alias("item"))
    first = Window.partitionBy("concept").orderBy(F.desc("n"), "item")
    anchors = part.groupBy("concept", "item").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(first)).where("r = 1").select("concept", F.col("item").alias("anchor"))
    active = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select("concept", "unit", "item")
    return rounded(R.identity_checks(active, anchors), "share")


@query("concept_groups", sql("brands", "\nUNION ALL ".join(f"SELECT item, '{by}' AS by, r::INT AS r, group_id, units, density, share, lift FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY {by} DESC, group_id) AS r FROM cg) WHERE r <= 10" for by in ("units", "density", "lift")), """
gs AS (SELECT group_id, count(DISTINCT unit_seq) AS size FROM inc GROUP BY 1), gi AS (SELECT item, group_id, count(*) AS units FROM inc GROUP BY 1, 2),
cg AS MATERIALIZED (SELECT item, group_id, units, round(units::DOUBLE / size, 6) AS density, round(units::DOUBLE / c, 6) AS share, round((units::DOUBLE / size) / (c::DOUBLE / n), 6) AS lift FROM gi JOIN gs USING (group_id) JOIN m USING (item), nn)"""))
def concept_groups(spark, sf_dir):
    """REL-22: customers that mark a brand, in three orders."""
    return R.concept_groups(brands(spark, sf_dir))


@query("marker_lift", sql("words", "SELECT mk.item, mk.k, m.c, round((mk.k::DOUBLE / nm) / (m.c::DOUBLE / n), 6) AS lift FROM mk JOIN m USING (item), nn, (SELECT count(DISTINCT unit_seq) AS nm FROM md) WHERE m.c >= 5", """
md AS MATERIALIZED (SELECT i.* FROM inc i SEMI JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = i.group_id),
mk AS (SELECT item, count(*) AS k FROM md GROUP BY item)"""))
def marker_lift(spark, sf_dir):
    """AGG-30: words of lines in documents marked toxic."""
    inc = words(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("group_id"))
    return rounded(R.marker_lift(inc, inc.join(toxic, "group_id", "left_semi").select("unit_seq").distinct()), "lift")


_KINDS = (("buy", ("purchase", "cart")), ("look", ("view", "click")), ("other", ("login", "logout", "signup", "search")))
_CLASS = ", ".join(f"('{c}', '{i}')" for c, items in _KINDS for i in items)


@query("laws", sql("days", """SELECT antecedent, consequent, hits, witnesses, a - hits AS counterexamples, round((hits::DOUBLE / a) / (c::DOUBLE / n), 6) AS lift,
  ((hits::DOUBLE / a) / (c::DOUBLE / n) > 1 AND witnesses >= 3 AND hits >= 5) AS law FROM ht JOIN sz USING (antecedent) JOIN bs USING (consequent), (SELECT count(*) AS n FROM un)""", f"""
cl(class, item) AS (VALUES {_CLASS}),
un AS MATERIALIZED (SELECT group_id, unit_seq, row_number() OVER (PARTITION BY group_id ORDER BY unit_seq) AS rn FROM (SELECT DISTINCT group_id, unit_seq FROM inc)),
an AS MATERIALIZED (SELECT DISTINCT class AS antecedent, group_id, rn FROM inc JOIN un USING (group_id, unit_seq) JOIN cl USING (item)),
va AS MATERIALIZED (SELECT DISTINCT c.antecedent AS consequent, u.group_id, u.rn FROM an c JOIN un u ON u.group_id = c.group_id AND u.rn BETWEEN c.rn - 1 AND c.rn + 1),
sz AS (SELECT antecedent, count(*) AS a FROM an GROUP BY 1), bs AS (SELECT consequent, count(*) AS c FROM va GROUP BY 1),
ht AS (SELECT antecedent, consequent, count(*) AS hits, count(DISTINCT group_id) AS witnesses FROM an JOIN va USING (group_id, rn) WHERE antecedent <> consequent GROUP BY 1, 2)"""))
def laws(spark, sf_dir):
    """REL-33, JOI-13, SRC-5: classes of events that are followed or preceded by others within a unit."""
    inc = days(spark, sf_dir)
    kinds = spark.createDataFrame([(c, i) for c, items in _KINDS for i in items], "class string, item string")
    return rounded(R.laws(inc, kinds, kinds), "lift")


@query("relation_snapshots", sql("words", "SELECT half, count(*) AS edges, sum(k)::BIGINT AS support FROM hk WHERE k >= 5 GROUP BY half", """
mid AS (SELECT quantile_disc(unit_seq, 0.5) AS q FROM (SELECT DISTINCT unit_seq FROM inc)),
hk AS (SELECT (x.unit_seq > q)::INT AS half, x.item AS a, y.item AS b, count(*) AS k FROM inc x JOIN inc y ON x.unit_seq = y.unit_seq AND x.item < y.item, mid GROUP BY 1, 2, 3)"""))
def relation_snapshots(spark, sf_dir):
    """GRA-27: relations of each half by a snapshot column."""
    inc = words(spark, sf_dir)
    mid = inc.select("unit_seq").distinct().agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unit_seq)").cast("long").alias("q"))
    rows = K.numbered_pairs(inc.join(F.broadcast(mid)), 5, (F.col("unit_seq") > F.col("q")).cast("int"), 2)
    return rows.groupBy(F.col("tag").alias("half")).agg(F.count("*").alias("edges"), F.sum("k").alias("support"))
