"""Operators on items that belong to concepts (item, concept), over an incidence table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import counts as K
from . import relations as R


def typed_pairs(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """(a, b, k, x, y): pairs with the concepts of both ends."""
    return pairs.join(of.select(F.col("item").alias("a"), F.col("concept").alias("x")), "a").join(of.select(F.col("item").alias("b"), F.col("concept").alias("y")), "b")


def density(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """GRA-13, GRA-25: (concept, members, internal, incident, cohesion): support within a concept, and of all pairs that touch it."""
    t = typed_pairs(pairs, of)
    ends = F.explode(F.array_distinct(F.array("x", "y"))).alias("concept")
    s = t.select(ends, "k", (F.col("x") == F.col("y")).alias("own")).groupBy("concept").agg(F.sum(F.when(F.col("own"), F.col("k")).otherwise(0)).alias("internal"), F.sum("k").alias("incident"))
    return of.groupBy("concept").agg(F.count("*").alias("members")).join(s, "concept", "left").select("concept", "members", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("incident", F.lit(0)).alias("incident"), F.coalesce(F.col("internal") / F.nullif(F.col("incident"), F.lit(0)), F.lit(0.0)).alias("cohesion"))


def concept_graph(inc: DataFrame, of: DataFrame, least: float = 0.02) -> DataFrame:
    """GRA-14: (a, b, weight): half the Jaccard similarity of concepts' units, half how their cross links compare with their own."""
    units = inc.join(of, "item").select("concept", "unit_seq").distinct()
    size = units.groupBy("concept").agg(F.count("*").alias("n"))
    both = units.select(F.col("concept").alias("a"), "unit_seq").join(units.select(F.col("concept").alias("b"), "unit_seq"), "unit_seq").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    t = typed_pairs(K.pairs(inc), of)
    own = t.where("x = y").groupBy(F.col("x").alias("c")).agg(F.sum("k").alias("own"))
    cross = t.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("k").alias("cross"))
    side = lambda c: size.select(F.col("concept").alias(c), F.col("n").alias(f"n_{c}")).join(own.select(F.col("c").alias(c), F.col("own").alias(f"own_{c}")), c, "left")
    rows = both.join(side("a"), "a").join(side("b"), "b").join(cross, ["a", "b"], "left")
    jaccard = F.col("k") / (F.col("n_a") + F.col("n_b") - F.col("k"))
    ratio = F.coalesce(F.col("cross") / F.nullif(F.least(F.coalesce("own_a", F.lit(0)), F.coalesce("own_b", F.lit(0))), F.lit(0)), F.lit(0.0))
    weight = 0.5 * jaccard + 0.5 * F.least(F.lit(1.0), ratio)
    return rows.select("a", "b", weight.alias("weight")).where(F.col("weight") >= least)


def attachment(inc: DataFrame, of: DataFrame, least: float = 0.3) -> DataFrame:
    """REL-27: (item, concept, confidence): half the share of an item's neighbour weight in a concept, half whether it is its own."""
    e = R.ppmi_edges(inc).select("item", F.col("dim"), "w")
    total = e.groupBy("item").agg(F.sum("w").alias("t"))
    into = e.join(of.select(F.col("item").alias("dim"), "concept"), "dim").groupBy("item", "concept").agg(F.sum("w").alias("s"))
    own = of.select("item", F.col("concept").alias("home"))
    rows = into.join(total, "item").join(own, "item", "left")
    conf = 0.5 * F.col("s") / F.col("t") + 0.5 * F.coalesce((F.col("home") == F.col("concept")).cast("double"), F.lit(0.0))
    return rows.select("item", "concept", conf.alias("confidence")).where(F.col("confidence") >= least)


def anchor_residual(inc: DataFrame) -> DataFrame:
    """REL-31: (item, centrality, expected, residual): share of pair support less share of frequency."""
    p = K.pairs(inc)
    s = p.select(F.col("a").alias("item"), "k").unionByName(p.select(F.col("b").alias("item"), "k")).groupBy("item").agg(F.sum("k").alias("s"))
    m = K.marginals(inc)
    total = s.agg(F.sum("s").alias("ts")).join(m.agg(F.sum("c").alias("tc")))
    rows = m.join(s, "item", "left").join(F.broadcast(total))
    centrality, expected = F.coalesce(F.col("s"), F.lit(0)) / F.col("ts"), F.col("c") / F.col("tc")
    return rows.select("item", centrality.alias("centrality"), expected.alias("expected"), (centrality - expected).alias("residual"))


def ordered_ppmi(inc: DataFrame) -> DataFrame:
    """INF-4: (src, tgt, k, w): positive PMI in bits of a before b."""
    p = K.pairs(inc)
    d = p.select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.col("ab").alias("k")).unionByName(p.select(F.col("b").alias("src"), F.col("a").alias("tgt"), F.col("ba").alias("k"))).where("k > 0")
    m, n = K.marginals(inc), K.unit_count(inc)
    rows = d.join(m.select(F.col("item").alias("src"), F.col("c").alias("cs")), "src").join(m.select(F.col("item").alias("tgt"), F.col("c").alias("ct")), "tgt").join(F.broadcast(n))
    return rows.select("src", "tgt", "k", R.pmi(F.col("k"), F.col("cs"), F.col("ct"), F.col("n"), base2=True).alias("w")).where("w > 0")


def tiers(pairs: DataFrame) -> DataFrame:
    """INF-17: (a, b, k, z, tier) of pairs (a, b, k, ca, cb, n) against independence."""
    expected = F.col("ca") * F.col("cb") / F.col("n")
    z = (F.col("k") - expected) / F.sqrt(expected)
    return pairs.select("a", "b", "k", z.alias("z"), F.when(z >= 3, "strong").when(z >= 1.645, "weak").when(z <= -1.645, "avoided").otherwise("chance").alias("tier"))


def definitions(inc: DataFrame, top: int = 3) -> DataFrame:
    """REL-30: (item, definition, clarity): the nearest neighbours, and how well they tell the item apart."""
    n = R.neighbours(inc, top)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]), "+")
    return n.groupBy("item").agg(ordered.alias("definition"), F.max("w").alias("w")).select("item", "definition", F.when(F.col("w") >= 3, "clear").when(F.col("w") >= 1, "partial").otherwise("vague").alias("clarity"))


def foundations(edges: DataFrame) -> DataFrame:
    """GRA-22, WIN-10: (node, score): out-degree, in-degree and kinds of typed edges, each from 0 to 1, averaged."""
    ends = edges.select(F.col("src").alias("node"), "type", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("tgt").alias("node"), "type", F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.count_distinct("type").alias("t"))
    one = d.agg(*(f(c).alias(f"{n}_{c}") for c in ("o", "i", "t") for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 1.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0)))
    return d.join(F.broadcast(one)).select("node", ((scaled("o") + scaled("i") + scaled("t")) / 3).alias("score"))


def transition_roles(precedes: DataFrame, predicts: DataFrame) -> DataFrame:
    """GRA-28: (node, out, into, mutual, role) in the union of order and prediction."""
    e = precedes.select("src", "tgt").unionByName(predicts.select("src", "tgt")).where("src <> tgt").distinct()
    back = e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    m = e.join(back, ["src", "tgt"], "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("mutual"))
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("tgt").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = ends.groupBy("node").agg(F.sum("o").alias("out"), F.sum("i").alias("into")).join(m, "node", "left")
    role = F.when(F.col("out") == 0, "sink").when(F.col("into") == 0, "initiator").when(F.col("out") > F.col("into"), "source").otherwise("relay")
    return d.select("node", "out", "into", F.coalesce("mutual", F.lit(0)).alias("mutual"), role.alias("role"))


def evidence_graph(inc: DataFrame, of: DataFrame, top: int = 3) -> DataFrame:
    """GRA-29: (src, tgt, type): concepts to items, and items to the first units that show them."""
    first = inc.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("unit_seq"))).where(F.col("r") <= top)
    a = of.select(F.concat(F.lit("concept:"), "concept").alias("src"), F.concat(F.lit("item:"), "item").alias("tgt"), F.lit("HAS").alias("type"))
    b = first.select(F.concat(F.lit("item:"), "item").alias("src"), F.concat(F.lit("unit:"), F.col("unit_seq").cast("string")).alias("tgt"), F.lit("SHOWN_IN").alias("type"))
    return a.unionByName(b)
