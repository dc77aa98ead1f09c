"""Graph queries over the relations of orders and lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import kernels
from ..operators import relations as R
from ..operators.rounds import written
from .base import baskets, lines, query, rounded, sql
from .relation_queries import EDGES, _PRE

#: A directed graph of some thousand edges: which supplier comes first in orders.
_D = _PRE[1:] + ", e AS MATERIALIZED (SELECT DISTINCT src, tgt FROM pre)"
#: A sparse undirected graph: strong associations between words.
NPMI_MIN = 0.55
_U = EDGES + f""",
a1 AS MATERIALIZED (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, max(weight) AS weight FROM ed WHERE type = 'ASSOCIATES_WITH' AND weight >= {NPMI_MIN} GROUP BY 1, 2),
e2 AS MATERIALIZED (SELECT src, tgt FROM a1 UNION ALL SELECT tgt, src FROM a1)"""


def directed(spark, sf_dir):
    return R.precedes(baskets(spark, sf_dir)).where("relation = 'PRECEDES'").select("src", "tgt")


def sparse(spark, sf_dir):
    return R.associates(lines(spark, sf_dir), min_npmi=NPMI_MIN).select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.col("npmi").alias("weight"))


@query("components", sql("lines", "SELECT node, min(other) AS component FROM (SELECT src AS node, tgt AS other FROM r UNION SELECT src, src FROM e2) GROUP BY 1", _U + ", r AS (SELECT src, tgt FROM e2 UNION SELECT r.src, e2.tgt FROM r JOIN e2 ON r.tgt = e2.src)", recursive=True))
def components(spark, sf_dir):
    """GRA-1."""
    return G.components(sparse(spark, sf_dir))


@query("reachable", sql("baskets", "SELECT src, count(*) AS n FROM r GROUP BY 1", _D + ", r AS (SELECT src, tgt FROM e UNION SELECT r.src, e.tgt FROM r JOIN e ON r.tgt = e.src)", recursive=True))
def reachable(spark, sf_dir):
    """GRA-2."""
    return G.reach(written(directed(spark, sf_dir))).groupBy("src").agg(F.count("*").alias("n"))


_SCC = _D + """, r AS (SELECT src, tgt FROM e UNION SELECT r.src, e.tgt FROM r JOIN e ON r.tgt = e.src),
nd AS (SELECT src AS node FROM e UNION SELECT tgt FROM e),
sc AS MATERIALIZED (SELECT node, least(node, coalesce(min(x.tgt), node)) AS scc FROM nd LEFT JOIN (SELECT x.src, x.tgt FROM r x JOIN r y ON x.src = y.tgt AND x.tgt = y.src) x ON x.src = node GROUP BY node)"""


@query("strong_components", sql("baskets", "SELECT node, scc FROM sc", _SCC, recursive=True))
def strong_components(spark, sf_dir):
    """GRA-3: closure and its transpose."""
    return G.strong_components(written(directed(spark, sf_dir)))


@query("condensation_levels", sql("baskets", "SELECT scc, coalesce(max(d), 0)::BIGINT AS level FROM (SELECT DISTINCT scc FROM sc) LEFT JOIN lp ON a = scc GROUP BY 1", _SCC + """,
dag AS MATERIALIZED (SELECT DISTINCT x.scc AS a, y.scc AS b FROM e JOIN sc x ON x.node = src JOIN sc y ON y.node = tgt WHERE x.scc <> y.scc),
lp AS (SELECT a, b, 1 AS d FROM dag UNION SELECT dag.a, lp.b, d + 1 FROM dag JOIN lp ON dag.b = lp.a)""", recursive=True))
def condensation_levels(spark, sf_dir):
    """GRA-4: longest path to a sink."""
    e = written(directed(spark, sf_dir))
    return G.levels(e, written(G.strong_components(e)))


@query("dyads", sql("lines", "SELECT CASE WHEN k = 2 THEN 'mutual' ELSE 'asymmetric' END AS kind, count(*) AS n FROM (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, count(*) AS k FROM (SELECT DISTINCT src, tgt FROM ed) GROUP BY 1, 2) GROUP BY 1", EDGES))
def dyads(spark, sf_dir):
    """GRA-16."""
    return G.dyads(R.typed_edges(lines(spark, sf_dir)))


_PERMS = ["012", "021", "102", "120", "201", "210"]
_BITS = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
_CODE = "least(" + ", ".join(" + ".join(f"{1 << (5 - n)} * f{p[i]}{p[j]}" for n, (i, j) in enumerate(_BITS)) for p in _PERMS) + ")"
_FLAGS = ", ".join(f"(EXISTS (SELECT 1 FROM e x WHERE x.src = p{i} AND x.tgt = p{j}))::INT AS f{i}{j}" for i, j in _BITS)
_TRI = _D + f""",
u AS MATERIALIZED (SELECT src, tgt FROM e UNION SELECT tgt, src FROM e),
wd AS (SELECT DISTINCT list_sort([x.src, x.tgt, y.tgt]) AS t FROM u x JOIN u y ON x.src = y.src AND x.tgt < y.tgt),
tp AS (SELECT t[1] AS p0, t[2] AS p1, t[3] AS p2 FROM wd),
fl AS (SELECT {_FLAGS} FROM tp)"""


@query("triad_census", sql("baskets", f"SELECT lpad(bin({_CODE}), 6, '0') AS code, count(*) AS n FROM fl GROUP BY 1", _TRI))
def triad_census(spark, sf_dir):
    """GRA-17."""
    return G.triads(written(directed(spark, sf_dir)))


@query("triad_kinds", sql("baskets", f"""SELECT code, n, length(replace(code, '0', ''))::INT AS edges, ((substr(code, 1, 1) || substr(code, 3, 1) = '11')::INT + (substr(code, 2, 1) || substr(code, 5, 1) = '11')::INT + (substr(code, 4, 1) || substr(code, 6, 1) = '11')::INT) AS mutual
FROM (SELECT lpad(bin({_CODE}), 6, '0') AS code, count(*) AS n FROM fl GROUP BY 1)""", _TRI))
def triad_kinds(spark, sf_dir):
    """GRA-18: descriptors from a table of 64 codes."""
    kinds = spark.createDataFrame(G.describe_triads(), "code string, edges int, mutual int, linked int")
    return G.triads(written(directed(spark, sf_dir))).join(F.broadcast(kinds), "code").select("code", "n", "edges", "mutual")


@query("transitivity", sql("baskets", """SELECT (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e x JOIN e y ON x.src = y.tgt AND x.tgt = y.src)::DOUBLE / (SELECT count(*) FROM e), 6) AS reciprocity,
  count(*) AS paths, round(avg((z.src IS NOT NULL)::INT), 6) AS transitivity FROM e x JOIN e y ON x.tgt = y.src AND x.src <> y.tgt LEFT JOIN e z ON z.src = x.src AND z.tgt = y.tgt""", _D))
def transitivity(spark, sf_dir):
    """GRA-19, JOI-16."""
    return rounded(G.transitivity(written(directed(spark, sf_dir))), "reciprocity", "transitivity")


@query("cycles", sql("lines", """SELECT x.src || '>' || x.tgt AS cycle, 2 AS size FROM rq x JOIN rq y ON y.src = x.tgt AND y.tgt = x.src WHERE x.src < x.tgt
UNION ALL SELECT x.src || '>' || x.tgt || '>' || y.tgt, 3 FROM rq x JOIN rq y ON y.src = x.tgt AND y.tgt > x.src AND y.tgt <> x.tgt JOIN rq z ON z.src = y.tgt AND z.tgt = x.src WHERE x.src < x.tgt
UNION ALL SELECT x.src || '>' || x.tgt || '>' || y.tgt || '>' || v.tgt, 4 FROM rq x JOIN rq y ON y.src = x.tgt AND y.tgt > x.src AND y.tgt <> x.tgt JOIN rq v ON v.src = y.tgt AND v.tgt > x.src AND v.tgt NOT IN (x.tgt, y.tgt) JOIN rq z ON z.src = v.tgt AND z.tgt = x.src WHERE x.src < x.tgt""", """
rq AS MATERIALIZED (SELECT src, tgt FROM orn WHERE k >= 5 AND k::DOUBLE / c_src >= 0.6)"""))
def cycles(spark, sf_dir):
    """GRA-15: cycles of up to four needs."""
    return G.cycles(written(R.requires(lines(spark, sf_dir), min_conf=0.6).select("src", "tgt")), 4)


@query("degrees", sql("lines", """SELECT node, coalesce(o.d, 0) AS out_degree, coalesce(i.d, 0) AS in_degree, kinds, strongest FROM (
  SELECT node, count(DISTINCT type) AS kinds, arg_min(other, (-round(weight, 9), other)) AS strongest FROM (SELECT src AS node, tgt AS other, type, weight FROM ed UNION ALL SELECT tgt, src, type, weight FROM ed) GROUP BY 1)
LEFT JOIN (SELECT src AS node, count(DISTINCT tgt) AS d FROM ed GROUP BY 1) o USING (node) LEFT JOIN (SELECT tgt AS node, count(DISTINCT src) AS d FROM ed GROUP BY 1) i USING (node)""", EDGES))
def degrees(spark, sf_dir):
    """GRA-20."""
    return G.degrees(written(R.typed_edges(lines(spark, sf_dir))))


_RANK = """,
dg AS (SELECT node, row_number() OVER (ORDER BY d DESC, node) AS rank FROM (SELECT node, count(*) AS d FROM (SELECT src AS node FROM ed UNION ALL SELECT tgt FROM ed) GROUP BY 1))"""


def _by_degree(edges):
    d = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("tgt").alias("node"))).groupBy("node").agg(F.count("*").alias("d"))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("d"), "node"))).select("node", "rank")  # one row a node: a vocabulary


@query("hub_ablation", sql("lines", """SELECT top::INT AS top, count(*) FILTER (least(coalesce(x.rank, 4611686018427387904), coalesce(y.rank, 4611686018427387904)) > top) AS edges FROM ed LEFT JOIN dg x ON x.node = src LEFT JOIN dg y ON y.node = tgt, (SELECT unnest([1, 3, 5, 10, 20, 30, 50]) AS top) GROUP BY 1""", EDGES + _RANK))
def hub_ablation(spark, sf_dir):
    """GRA-21, JOI-19: what is left without the strongest nodes."""
    e = written(R.typed_edges(lines(spark, sf_dir)))
    return G.ablation(e, _by_degree(e), (1, 3, 5, 10, 20, 30, 50))


@query("coverage_curve", sql("lines", """SELECT k, sum(new) OVER (ORDER BY k)::BIGINT AS covered, round(sum(new) OVER (ORDER BY k)::DOUBLE / sum(new) OVER (), 6) AS share FROM (
  SELECT greatest(x.rank, y.rank) AS k, count(*) AS new FROM ed JOIN dg x ON x.node = src JOIN dg y ON y.node = tgt GROUP BY 1)""", EDGES + _RANK))
def coverage_curve(spark, sf_dir):
    """GRA-24, JOI-18, WIN-15: relations covered by the first k nodes."""
    e = written(R.typed_edges(lines(spark, sf_dir)))
    rel = F.concat_ws("|", "type", "src", "tgt")
    members = e.select(rel.alias("rel"), F.explode(F.array("src", "tgt")).alias("node"))
    return rounded(G.coverage(members, _by_degree(e)), "share")


_CORE = "".join(f""",
k{i + 1} AS MATERIALIZED (SELECT x.* FROM k{i} x SEMI JOIN (SELECT src FROM k{i} GROUP BY 1 HAVING count(*) >= 3) y ON x.src = y.src SEMI JOIN (SELECT src FROM k{i} GROUP BY 1 HAVING count(*) >= 3) z ON x.tgt = z.src)""" for i in range(24))


@query("k_core", sql("lines", "SELECT DISTINCT src AS node FROM k24", _U + ", k0 AS (SELECT * FROM e2)" + _CORE))
def k_core(spark, sf_dir):
    """GRA-12 at k = 3."""
    return G.k_core(sparse(spark, sf_dir), 3)


@query("four_cliques", sql("lines", """SELECT w.src AS a, w.tgt AS b, x.tgt AS c, y.tgt AS d FROM a1 w JOIN a1 x ON x.src = w.tgt JOIN a1 y ON y.src = x.tgt
SEMI JOIN a1 p ON p.src = w.src AND p.tgt = x.tgt SEMI JOIN a1 q ON q.src = w.src AND q.tgt = y.tgt SEMI JOIN a1 r ON r.src = w.tgt AND r.tgt = y.tgt""", _U))
def four_cliques(spark, sf_dir):
    """GRA-9: the cliques."""
    return G.cliques4(sparse(spark, sf_dir))


@query("clique_communities")
def clique_communities(spark, sf_dir):
    """GRA-9: percolation; overlapping communities.  Tested against brute force."""
    return G.percolation(written(sparse(spark, sf_dir)))


@query("label_communities")
def label_communities(spark, sf_dir):
    """GRA-8, synchronous.  Tested against brute force."""
    return G.label_propagation(written(sparse(spark, sf_dir)))


@query("node_centrality")
def node_centrality(spark, sf_dir):
    """GRA-5, GRA-6, GRA-7: betweenness (plain and weighted) and eigenvector centrality of the word graph."""
    return rounded(kernels.centrality(written(sparse(spark, sf_dir))), "betweenness", "weighted_betweenness", "eigenvector")


@query("modules")
def modules(spark, sf_dir):
    """GRA-11: greedy modularity."""
    return kernels.greedy_modules(sparse(spark, sf_dir))


@query("greedy_cover")
def greedy_cover(spark, sf_dir):
    """GRA-23: the order in which nodes cover most further relations, with the relations covered by then."""
    return kernels.greedy_cover(R.requires(lines(spark, sf_dir), min_conf=0.6).select("src", "tgt"))
