"""Association and relation mining over an incidence table.  N is the number of units that hold anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import counts as K
from .rounds import written


def pmi(k: Column, ca: Column, cb: Column, n: Column, base2: bool = False) -> Column:
    """Pointwise mutual information from counts (REL-1: base 2, REL-2: natural)."""
    x = (k / n) / ((ca / n) * (cb / n))
    return F.log2(x) if base2 else F.log(x)


def npmi(k: Column, ca: Column, cb: Column, n: Column) -> Column:
    """Normalised to -1..1; 1 where every unit holds the pair."""
    return F.when(k >= n, 1.0).otherwise(pmi(k, ca, cb, n) / -F.log(k / n))


def stability(k: Column, threshold: int) -> Column:
    """Mean of whether support survives a threshold one lower and one higher (REL-11)."""
    return ((k >= threshold - 1).cast("double") + (k >= threshold + 1).cast("double")) / 2


def co_occurs(inc: DataFrame, min_support: int = 5, full: DataFrame | None = None) -> DataFrame:
    """REL-3: pairs of enough support, with confidence, PMI and NPMI.  ``full``, here and below: ``K.full_pairs`` of that support or less, counted once for several relations."""
    k, ca, cb, n = (F.col(x) for x in ("k", "ca", "cb", "n"))
    rows = (K.full_pairs(inc, min_support) if full is None else full).where(k >= min_support)
    return rows.select("a", "b", "k", "ca", "cb", F.least(k / ca, k / cb).alias("confidence"), pmi(k, ca, cb, n).alias("pmi"), npmi(k, ca, cb, n).alias("npmi"), stability(k, min_support).alias("stability"))


def associates(inc: DataFrame, min_support: int = 5, min_npmi: float = 0.2, full: DataFrame | None = None) -> DataFrame:
    """REL-4: co-occurrence with an NPMI bound."""
    return co_occurs(inc, min_support, full).where(F.col("npmi") >= min_npmi)


def oriented(inc: DataFrame, min_support: int, full: DataFrame | None = None) -> DataFrame:
    """(src, tgt, k, c_src, c_tgt, n): both orientations of each pair of enough support (SET-1)."""
    rows = (K.full_pairs(inc, min_support) if full is None else full).where(F.col("k") >= min_support)
    one = rows.select(F.col("a").alias("src"), F.col("b").alias("tgt"), "k", F.col("ca").alias("c_src"), F.col("cb").alias("c_tgt"), "n")
    two = rows.select(F.col("b").alias("src"), F.col("a").alias("tgt"), "k", F.col("cb").alias("c_src"), F.col("ca").alias("c_tgt"), "n")
    return one.unionByName(two)


def depends_on(inc: DataFrame, min_support: int = 5, min_conf: float = 0.3, min_lift: float = 2.0, full: DataFrame | None = None) -> DataFrame:
    """REL-5: P(src | tgt) and its lift over P(src)."""
    conf = F.col("k") / F.col("c_tgt")
    lift = conf / (F.col("c_src") / F.col("n"))
    return oriented(inc, min_support, full).where((conf >= min_conf) & (lift >= min_lift)).select("src", "tgt", "k", conf.alias("confidence"), lift.alias("lift"), stability(F.col("k"), min_support).alias("stability"))


def requires(inc: DataFrame, min_support: int = 5, min_conf: float = 0.9, full: DataFrame | None = None) -> DataFrame:
    """REL-6: P(tgt | src)."""
    conf = F.col("k") / F.col("c_src")
    return oriented(inc, min_support, full).where(conf >= min_conf).select("src", "tgt", "k", conf.alias("confidence"))


def precedes(inc: DataFrame, min_support: int = 10, min_asym: float = 0.3, full: DataFrame | None = None) -> DataFrame:
    """REL-7: (relation, src, tgt, total, asymmetry): order within units, ties skipped; FOLLOWS mirrors PRECEDES."""
    total = F.col("ab") + F.col("ba")
    asym = (F.col("ab") - F.col("ba")) / F.when(total > 0, total)
    rows = (K.pairs(inc, min_support) if full is None else full).withColumn("total", total).withColumn("asym", asym).where((F.col("total") >= min_support) & (F.abs("asym") >= min_asym))
    first, last = F.when(F.col("asym") > 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("asym") > 0, F.col("b")).otherwise(F.col("a"))
    pre = rows.select(F.lit("PRECEDES").alias("relation"), first.alias("src"), last.alias("tgt"), "total", F.abs("asym").alias("asymmetry"))
    return pre.unionByName(pre.select(F.lit("FOLLOWS").alias("relation"), F.col("tgt").alias("src"), F.col("src").alias("tgt"), "total", "asymmetry"))


def numbered_units(inc: DataFrame) -> DataFrame:
    """(group_id, unit_seq, rn): units that hold anything, in order within their group."""
    w = Window.partitionBy("group_id").orderBy("unit_seq")
    return inc.select("group_id", "unit_seq").distinct().withColumn("rn", F.row_number().over(w))


def predicts(inc: DataFrame, windows: tuple[int, ...] = (1, 2, 3), min_support: int = 5, min_conf: float = 0.2, min_lift: float = 1.5) -> DataFrame:
    """REL-8: item a in a unit, item b a few units later in the same group (JOI-12); never across groups."""
    units = numbered_units(inc)
    here = K.frequent(inc, min_support).select("group_id", "unit_seq", "item").join(units, ["group_id", "unit_seq"])
    starts = here.select("group_id", F.col("item").alias("a"), F.explode(F.array(*map(F.lit, windows))).alias("w"), "rn").withColumn("rn", F.col("rn") + F.col("w"))
    followed = starts.join(units.select("group_id", "rn"), ["group_id", "rn"])
    base = followed.groupBy("w", "a").agg(F.count("*").alias("first"))
    later = here.select("group_id", F.col("item").alias("b"), "rn")
    met = followed.join(later, ["group_id", "rn"]).where("a <> b").groupBy("w", "a", "b").agg(F.count("*").alias("k")).where(F.col("k") >= min_support)
    m = K.marginals(inc).select(F.col("item").alias("b"), F.col("c").alias("cb"))
    rows = met.join(base, ["w", "a"]).join(m, "b").join(F.broadcast(K.unit_count(inc)))
    conf = F.col("k") / F.col("first")
    lift = conf / (F.col("cb") / F.col("n"))
    return rows.where((conf >= min_conf) & (lift >= min_lift)).select("w", F.col("a").alias("src"), F.col("b").alias("tgt"), "k", conf.alias("confidence"), lift.alias("lift"))


def _roles(triples: DataFrame, x: str, y: str, m: str) -> DataFrame:
    """Each triple three times: every item once in the middle."""
    turns = [("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a")]
    parts = [triples.select(F.col(p).alias(x), F.col(q).alias(y), F.col(r).alias(m), "k") for p, q, r in turns]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mediates(inc: DataFrame, triples: DataFrame, min_support: int = 5, min_conf: float = 0.7) -> DataFrame:
    """REL-9: m is found with most of the units that hold a and d."""
    pair = K.pairs(inc).select(F.col("a"), F.col("b").alias("d"), F.col("k").alias("pair"))
    rows = _roles(triples, "a", "d", "m").where(F.col("k") >= min_support).join(pair, ["a", "d"]).where(F.col("pair") >= min_support)
    conf = F.col("k") / F.col("pair")
    return rows.where(conf >= min_conf).select("a", "d", "m", "k", "pair", conf.alias("confidence"), conf.alias("isolation"))


def emerges(inc: DataFrame, triples: DataFrame, min_support: int = 5, min_synergy: float = 0.15) -> DataFrame:
    """REL-10: e is likelier with both a and b than with either."""
    p = K.pairs(inc)
    both = p.select("a", "b", F.col("k").alias("pair"))
    each = p.select(F.col("a").alias("x"), F.col("b").alias("e"), F.col("k").alias("kx")).unionByName(p.select(F.col("b").alias("x"), F.col("a").alias("e"), F.col("k").alias("kx")))
    m = K.marginals(inc).select(F.col("item").alias("x"), "c")
    cond = each.join(m, "x").select("x", "e", (F.col("kx") / F.col("c")).alias("p"))
    rows = _roles(triples, "a", "b", "e").where(F.col("k") >= min_support).join(both, ["a", "b"]).where(F.col("pair") >= min_support)
    rows = rows.join(cond.select(F.col("x").alias("a"), "e", F.col("p").alias("p_a")), ["a", "e"], "left").join(cond.select(F.col("x").alias("b"), "e", F.col("p").alias("p_b")), ["b", "e"], "left")
    synergy = F.col("k") / F.col("pair") - F.greatest(F.coalesce("p_a", F.lit(0.0)), F.coalesce("p_b", F.lit(0.0)))
    return rows.where(synergy >= min_synergy).select("a", "b", "e", "k", "pair", synergy.alias("synergy"))


def excludes(inc: DataFrame, min_count: int = 30) -> DataFrame:
    """REL-12, JOI-14: pairs of frequent items that no unit holds together.

    The frequent items are a vocabulary, of a size that the threshold bounds; pairs found together are taken off by an anti join.
    """
    often = K.marginals(inc).where(F.col("c") >= min_count)
    two = often.select(F.col("item").alias("a"), F.col("c").alias("ca")).join(often.select(F.col("item").alias("b"), F.col("c").alias("cb")), F.col("a") < F.col("b"))
    return two.join(K.pairs(inc).select("a", "b"), ["a", "b"], "left_anti")


def ppmi_edges(inc: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """(item, dim, w, k, df): positive PMI in bits, both ways (REL-1)."""
    rows = oriented(inc, 1, full)
    w = pmi(F.col("k"), F.col("c_src"), F.col("c_tgt"), F.col("n"), base2=True)
    return rows.select(F.col("src").alias("item"), F.col("tgt").alias("dim"), w.alias("w"), "k", F.col("c_src").alias("df")).where("w > 0")


def ppmi_vectors(inc: DataFrame, top: int = 100, full: DataFrame | None = None) -> DataFrame:
    """(item, dim, w): each item's strongest dimensions (WIN-2)."""
    w = Window.partitionBy("item").orderBy(F.desc(F.round("w", 9)), "dim")  # equal weights, however they were summed, go by name
    return ppmi_edges(inc, full).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("item", "dim", "w")


def neighbours(inc: DataFrame, top: int = 20) -> DataFrame:
    """REL-13: neighbours by PPMI above a support floor that follows frequency; without any, the floor is waived."""
    e = ppmi_edges(inc)
    floor = F.greatest(F.lit(2), F.least(F.lit(6), F.bround(F.col("df") * 0.02).cast("int")))
    e = e.withColumn("ok", (F.col("k") >= floor).cast("int"))
    e = e.withColumn("any_ok", F.max("ok").over(Window.partitionBy("item"))).where((F.col("ok") == 1) | (F.col("any_ok") == 0))
    w = Window.partitionBy("item").orderBy(F.desc(F.round("w", 9)), F.desc("k"), "dim")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("item", F.col("dim").alias("neighbour"), "rank", "w", "k")


def cosine(vectors: DataFrame) -> DataFrame:
    """(a, b, cos) of sparse vectors (item, dim, w) that share a dimension, a < b (JOI-11, AGG-20)."""
    norm = vectors.groupBy("item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    left, right = vectors.select(F.col("item").alias("a"), "dim", F.col("w").alias("wa")), vectors.select(F.col("item").alias("b"), "dim", F.col("w").alias("wb"))
    dot = left.join(right, "dim").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    n = lambda x: norm.select(F.col("item").alias(x), F.col("norm").alias(f"n{x}"))
    return dot.join(n("a"), "a").join(n("b"), "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cos"))


def similar(inc: DataFrame, top_dims: int = 100, share: float = 0.7, least: float = 0.05, min_share: float = 0.0) -> DataFrame:
    """REL-14: a blend of PPMI cosine and group-profile cosine for pairs that share a dimension."""
    prof = K.profiles(inc, min_share)
    near = cosine(ppmi_vectors(inc, top_dims, full=prof.where("k > 0")))
    rows = near.join(prof.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("met")), ["a", "b"], "left")
    groups = F.coalesce(F.col("met"), F.lit(0.0))
    score = share * F.col("cos") + (1 - share) * groups
    return rows.select("a", "b", F.col("cos").alias("cos_ppmi"), groups.alias("cos_groups"), score.alias("score")).where(F.col("score") >= least)


def spans(inc: DataFrame, wide: int, narrow: int = 3, min_share: float = 0.0) -> DataFrame:
    """REL-17, SET-3: in how many groups a pair is found together; global, local or between."""
    rows = K.profiles(inc, min_share).where("k > 0").select("a", "b", "k", "span")
    return rows.withColumn("kind", F.when(F.col("span") >= wide, "global").when(F.col("span") <= narrow, "local").otherwise("between"))


def evidence(inc: DataFrame, min_support: int = 5, first: int = 5) -> DataFrame:
    """AGG-4: the first units of each pair, one row each: a window with a limit, no list of a pair's units."""
    w = Window.partitionBy("a", "b").orderBy("unit_seq")
    rows = K.pair_rows(inc).select("a", "b", "unit_seq").withColumn("r", F.row_number().over(w)).where(F.col("r") <= first)
    return rows.join(K.pairs(inc).where(F.col("k") >= min_support).select("a", "b", "k"), ["a", "b"])


def typed_edges(inc: DataFrame) -> DataFrame:
    """REL-16: one edge list of all relations: directed ones once, mutual ones both ways (SET-6)."""
    full = written(K.full_pairs(inc, 5))
    mutual = associates(inc, full=full).select("a", "b", F.col("npmi").alias("weight"), F.col("k").alias("support"))
    both = mutual.select(F.col("a").alias("src"), F.col("b").alias("tgt"), "weight", "support").unionByName(mutual.select(F.col("b").alias("src"), F.col("a").alias("tgt"), "weight", "support"))
    dep = depends_on(inc, full=full).select("src", "tgt", F.col("confidence").alias("weight"), F.col("k").alias("support"))
    req = requires(inc, full=full).select("src", "tgt", F.col("confidence").alias("weight"), F.col("k").alias("support"))
    pre = precedes(inc, full=full).where("relation = 'PRECEDES'").select("src", "tgt", F.col("asymmetry").alias("weight"), F.col("total").alias("support"))
    kinds = (("ASSOCIATES_WITH", both), ("DEPENDS_ON", dep), ("REQUIRES", req), ("PRECEDES", pre))
    parts = [d.select("src", "tgt", F.lit(t).alias("type"), "weight", "support") for t, d in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def drift(inc: DataFrame, halves: DataFrame, min_support: int = 5) -> DataFrame:
    """REL-32: cosine of an item's neighbour counts between two halves (unit_seq, half)."""
    rows = K.pair_rows(inc).join(halves, "unit_seq").groupBy("half", "a", "b").agg(F.count("*").alias("k"))
    both = rows.select("half", F.col("a").alias("item"), F.col("b").alias("dim"), "k").unionByName(rows.select("half", F.col("b").alias("item"), F.col("a").alias("dim"), "k"))
    wide = both.groupBy("item", "dim").agg(F.sum(F.when(F.col("half") == 0, F.col("k")).otherwise(0)).alias("x"), F.sum(F.when(F.col("half") == 1, F.col("k")).otherwise(0)).alias("y"))
    out = wide.groupBy("item").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") + F.col("y")).alias("support"))
    cos = F.col("xy") / F.nullif(F.sqrt(F.col("xx").cast("double") * F.col("yy").cast("double")), F.lit(0.0))
    return out.where(F.col("support") >= min_support).select("item", F.coalesce(cos, F.lit(0.0)).alias("cos"), (F.coalesce(cos, F.lit(0.0)) >= 0.5).alias("stable"))


def order_cycles(pre: DataFrame, longest: int = 4) -> DataFrame:
    """(a, b, c, d, asymmetry): elementary cycles of two to ``longest`` (4 at most) order edges, each from its least item, with their weakest edge."""
    e = pre.select("src", "tgt", "asymmetry").where("src <> tgt")
    path = e.select(F.col("src").alias("a"), F.col("tgt").alias("b"), "asymmetry").where("a < b")
    out = None
    for at, after in zip("bcd"[: longest - 1], "cd_", strict=False):
        step = e.select(F.col("src").alias(at), F.col("tgt").alias("__next"), F.col("asymmetry").alias("__asym"))
        longer = path.join(step, at).withColumn("asymmetry", F.least("asymmetry", "__asym")).drop("__asym")
        items = [x for x in "abcd" if x <= at]
        closed = longer.where("__next = a").select(*items, *(F.lit(None).cast("string").alias(x) for x in "abcd" if x > at), "asymmetry")
        out = closed if out is None else out.unionByName(closed)
        if after != "_":
            path = longer.where(F.col("__next") > F.col("a"))
            for x in items[1:]:
                path = path.where(F.col("__next") != F.col(x))
            path = path.withColumnRenamed("__next", after)
    return out


def contradictions(req: DataFrame, dep: DataFrame, exc: DataFrame, pre: DataFrame, strict: float = 0.95) -> DataFrame:
    """REL-28: (rule, genuine, a, b, c, d): rules C1 to C5 over need (src, tgt), dependency (src, tgt), exclusion
    (a < b) and order (src, tgt, asymmetry).

    C1: a needs b, which excludes it.  C2: a needs b and c, which exclude each other.  C3, C4: strict order both
    ways, or in a circle of three or four.  C5: a and b depend on each other and exclude each other.  The same
    patterns of mere tendencies (dependency for need, weaker order) are told apart: they are not genuine.
    Relations counted from one incidence table can't break C1, C3 and C5; relations from elsewhere can.
    """
    shut = exc.select("a", "b")
    back = shut.select(F.col("b").alias("a"), F.col("a").alias("b"))
    none = F.lit(None).cast("string")

    def found(d: DataFrame, rule: str | Column, genuine: bool | Column) -> DataFrame:
        have = [F.col(x) if x in d.columns else none.alias(x) for x in "abcd"]
        return d.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), (F.lit(genuine) if isinstance(genuine, bool) else genuine).alias("genuine"), *have)

    def forced(d: DataFrame) -> DataFrame:
        x, y = d.select(F.col("src").alias("a"), F.col("tgt").alias("b")), d.select(F.col("src").alias("a"), F.col("tgt").alias("c"))
        return x.join(y, "a").where("b < c").join(shut.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"], "left_semi")

    need, lean = req.select("src", "tgt").distinct(), dep.select("src", "tgt").distinct()
    edge = lambda d: d.select(F.col("src").alias("a"), F.col("tgt").alias("b"))
    c5 = edge(lean).where("a < b").join(edge(lean).select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").join(shut, ["a", "b"], "left_semi")
    loops = order_cycles(pre)
    firm = F.col("asymmetry") >= strict
    named = F.when(~firm, "weak_order_cycle").when(F.col("c").isNull(), "C3_strict_order_both_ways").otherwise("C4_strict_order_cycle")
    parts = [
        found(edge(need).join(shut.unionByName(back), ["a", "b"], "left_semi"), "C1_needs_what_it_excludes", True),
        found(forced(need), "C2_needs_exclusive_items", True),
        found(forced(lean), "depends_on_exclusive_items", False),
        found(loops, named, firm),
        found(c5, "C5_exclusive_mutual_dependency", True),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def identity_checks(active: DataFrame, anchors: DataFrame) -> DataFrame:
    """REL-28, C6: (concept, anchor, units, held, share, verdict): how many of the units (concept, unit, item) that
    activate a concept hold its anchor (concept, anchor): none is an inversion, a minority an instability."""
    rows = active.join(anchors, "concept").groupBy("concept", "anchor", "unit").agg(F.bool_or(F.col("item") == F.col("anchor")).alias("hit"))
    out = rows.groupBy("concept", "anchor").agg(F.count("*").alias("units"), F.count_if("hit").alias("held"))
    verdict = F.when(F.col("held") == 0, "C6_identity_inversion").when(2 * F.col("held") < F.col("units"), "identity_instability").otherwise("consistent")
    return out.select("concept", "anchor", "units", "held", (F.col("held") / F.col("units")).alias("share"), verdict.alias("verdict"))


def concept_groups(inc: DataFrame, top: int = 10) -> DataFrame:
    """REL-22: an item's ``top`` groups by units, by density and by lift: (item, by, r, group_id, units, density, share, lift).

    Density is the share of the group's units that hold the item, share the group's part of the item's units, lift
    the density over the item's rate in all units.  Equal values go by group.
    """
    size = inc.groupBy("group_id").agg(F.count_distinct("unit_seq").alias("size"))
    rows = inc.groupBy("item", "group_id").agg(F.count("*").alias("units")).join(size, "group_id").join(K.marginals(inc), "item").join(F.broadcast(K.unit_count(inc)))
    density = F.col("units") / F.col("size")
    rows = rows.select("item", "group_id", "units", F.round(density, 6).alias("density"), F.round(F.col("units") / F.col("c"), 6).alias("share"), F.round(density / (F.col("c") / F.col("n")), 6).alias("lift"))
    parts = []
    for by in ("units", "density", "lift"):
        w = Window.partitionBy("item").orderBy(F.desc(by), "group_id")
        parts.append(rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("item", F.lit(by).alias("by"), "r", "group_id", "units", "density", "share", "lift"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def marker_lift(inc: DataFrame, marked: DataFrame, min_df: int = 5) -> DataFrame:
    """AGG-30: how much likelier an item is in marked units (unit_seq) than overall."""
    m = inc.join(marked, "unit_seq", "left_semi")
    rows = m.groupBy("item").agg(F.count("*").alias("k")).join(K.marginals(inc), "item").where(F.col("c") >= min_df)
    one = m.agg(F.count_distinct("unit_seq").alias("nm"))
    return rows.join(F.broadcast(one)).join(F.broadcast(K.unit_count(inc))).select("item", "k", "c", ((F.col("k") / F.col("nm")) / (F.col("c") / F.col("n"))).alias("lift"))


def laws(inc: DataFrame, antecedents: DataFrame, consequents: DataFrame, window: int = 1) -> DataFrame:
    """REL-33, JOI-13: of units that hold an item of a class, how many have one of another class within the window of units.

    ``antecedents`` and ``consequents`` are (class, item).  A unit's window is spread over its neighbours by number,
    so the band is an equi-join.
    """
    units = numbered_units(inc)
    at = inc.select("group_id", "unit_seq", "item").join(units, ["group_id", "unit_seq"])
    a = at.join(antecedents, "item").select(F.col("class").alias("antecedent"), "group_id", "rn").distinct()
    near = F.explode(F.array(*(F.lit(d) for d in range(-window, window + 1))))
    c = at.join(consequents, "item").select(F.col("class").alias("consequent"), "group_id", "rn", near.alias("d")).select("consequent", "group_id", (F.col("rn") + F.col("d")).alias("rn")).distinct()
    valid = c.join(units.select("group_id", "rn"), ["group_id", "rn"])
    base = valid.groupBy("consequent").agg(F.count("*").alias("c"))
    size = a.groupBy("antecedent").agg(F.count("*").alias("a"))
    hits = a.join(valid, ["group_id", "rn"]).where("antecedent <> consequent").groupBy("antecedent", "consequent").agg(F.count("*").alias("hits"), F.count_distinct("group_id").alias("witnesses"))
    rows = hits.join(size, "antecedent").join(base, "consequent").join(F.broadcast(units.agg(F.count("*").alias("n"))))
    lift = (F.col("hits") / F.col("a")) / (F.col("c") / F.col("n"))
    return rows.select("antecedent", "consequent", "hits", "witnesses", (F.col("a") - F.col("hits")).alias("counterexamples"), lift.alias("lift"), ((lift > 1) & (F.col("witnesses") >= 3) & (F.col("hits") >= 5)).alias("law"))
