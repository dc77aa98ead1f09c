"""Information and prediction over an incidence table: likelihood budgets, masked items, recurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import counts as K
from . import relations as R
from .resample import order_key


def budget(inc: DataFrame) -> DataFrame:
    """INF-8, INF-16: bits an item under a uniform and under a frequency model, entropy redundancy; one row."""
    m = K.marginals(inc)
    v = m.agg(F.count("*").alias("v"), F.sum("c").alias("t"))
    p = F.col("c") / F.col("t")
    return m.join(F.broadcast(v)).agg(F.max(F.log2("v")).alias("uniform"), F.sum(-p * F.log2(p)).alias("frequency"), F.max("v").alias("items")).withColumn("redundancy", 1 - F.col("frequency") / F.nullif(F.col("uniform"), F.lit(0.0)))


def leave_one_out(inc: DataFrame, smooth: float = 0.5) -> DataFrame:
    """INF-9: (n, nll, base): mean bits of an item given its group, the item's own unit left out, smoothed; and under the
    smoothed frequency of all."""
    in_group = Window.partitionBy("group_id")
    rows = inc.select("group_id", "unit_seq", "item").withColumn("n_gi", F.count("*").over(Window.partitionBy("group_id", "item"))).withColumn("t_g", F.count("*").over(in_group)).withColumn("u", F.count("*").over(Window.partitionBy("unit_seq")))
    m = K.marginals(inc)
    v = m.agg(F.count("*").alias("v"), F.sum("c").alias("t"))
    rows = rows.join(m, "item").join(F.broadcast(v))
    own = -F.log2((F.col("n_gi") - 1 + smooth) / (F.col("t_g") - F.col("u") + smooth * F.col("v")))
    base = -F.log2((F.col("c") + smooth) / (F.col("t") + smooth * F.col("v")))
    return rows.agg(F.count("*").alias("n"), F.avg(own).alias("nll"), F.avg(base).alias("base"))


def coherence(inc: DataFrame) -> DataFrame:
    """INF-13: (group_id, unit_seq, pairs, mean_ppmi): mean positive PMI of a unit's pairs."""
    rows = K.with_marginals(K.pairs(inc), inc)
    w = F.greatest(F.lit(0.0), R.pmi(F.col("k"), F.col("ca"), F.col("cb"), F.col("n"), base2=True))
    ppmi = rows.select("a", "b", w.alias("w"))
    return K.pair_rows(inc).join(ppmi, ["a", "b"]).groupBy("group_id", "unit_seq").agg(F.count("*").alias("pairs"), F.avg("w").alias("mean_ppmi"))


def recurrence(inc: DataFrame, distances: int = 20) -> DataFrame:
    """INF-10: (d, pairs, lift): how much likelier an item is d units after it was seen than overall."""
    units = R.numbered_units(inc)
    here = inc.select("group_id", "unit_seq", "item").join(units, ["group_id", "unit_seq"]).select("group_id", "item", "rn")
    ahead = here.select("group_id", "item", F.explode(F.sequence(F.lit(1), F.lit(distances))).alias("d"), "rn").withColumn("rn", F.col("rn") + F.col("d"))
    valid = ahead.join(units.select("group_id", "rn"), ["group_id", "rn"])
    m = K.marginals(inc)
    n = K.unit_count(inc)
    expected = valid.join(m, "item").join(F.broadcast(n)).groupBy("d").agg(F.count("*").alias("pairs"), F.sum(F.col("c") / F.col("n")).alias("expected"))
    hits = valid.join(here, ["group_id", "rn", "item"], "left_semi").groupBy("d").agg(F.count("*").alias("hits"))
    return expected.join(hits, "d", "left").select("d", "pairs", (F.coalesce("hits", F.lit(0)) / F.col("expected")).alias("lift"))


def masked_scores(train: DataFrame, test: DataFrame, smooth: float = 0.5, share: float | None = None, seed: int = 1) -> DataFrame:
    """INF-1, INF-2, INF-3: (unit_seq, item, nll, base_nll, rank, base_rank, degree_rank, vocabulary).

    Without ``share`` each item of a unit is masked in turn and all others are its context; with it, that share of
    a unit's items (one at least, the first by hashed order) is masked at once and only the others are context.
    An item's evidence is the sum of its training PPMI with its context.  Its probability is the smoothed
    frequency times 2 to the evidence, over Z = 1 - sum of P0 + sum of P0 2^ev of the items with evidence: only
    those are ever made.  Its rank counts the items of strictly larger score: those with evidence one by one, the
    others by their place in the frequency order.  The rank by degree counts the items with more distinct partners
    in training.  Vocabulary is the number of training items.
    """
    m = K.marginals(train)
    v = m.agg(F.count("*").alias("v"), F.sum("c").alias("t"))
    prior = m.join(F.broadcast(v)).select("item", ((F.col("c") + smooth) / (F.col("t") + smooth * F.col("v"))).alias("p0"))
    prior = prior.withColumn("prior_rank", F.rank().over(Window.orderBy(F.desc(F.round("p0", 12)))))  # a vocabulary
    ppmi = R.ppmi_edges(train).select("item", "dim", "w")
    known = test.join(prior.select("item"), "item", "left_semi").select("unit_seq", "item")  # unseen items score under no model (FIL-4)
    long = known.withColumn("n", F.count("*").over(Window.partitionBy("unit_seq"))).where("n >= 2").drop("n")
    given = long
    if share is not None:
        numbered = known.withColumn("n", F.count("*").over(Window.partitionBy("unit_seq"))).where("n >= 2").withColumn("r", F.row_number().over(Window.partitionBy("unit_seq").orderBy(order_key(seed, F.col("unit_seq"), F.col("item")), "item")))
        masked = F.col("r") <= F.greatest(F.lit(1.0), F.bround(share * F.col("n")))
        long, given = numbered.where(masked).select("unit_seq", "item"), numbered.where(~masked).select("unit_seq", "item")
        long = long.join(given, "unit_seq", "left_semi")  # a unit masked as a whole has no context
    context = long.join(given.select("unit_seq", F.col("item").alias("dim")), "unit_seq").where("item <> dim").select("unit_seq", F.col("item").alias("target"), "dim")
    evidence = context.join(ppmi, "dim").groupBy("unit_seq", "target", "item").agg(F.sum("w").alias("ev"))
    q0 = prior.select(F.col("item").alias("target"), F.col("p0").alias("q0"), "prior_rank")
    scored = evidence.join(prior.select("item", "p0"), "item").withColumn("s", F.col("p0") * F.pow(F.lit(2.0), F.col("ev")))
    # an own score and those it is compared with come from one pass: sums made twice may differ in their last bit, and a rank with them
    one = Window.partitionBy("unit_seq", "target")
    scored = scored.withColumn("own_s", F.max(F.when(F.col("target") == F.col("item"), F.col("s"))).over(one)).join(q0, "target").withColumn("own_s", F.coalesce("own_s", "q0"))
    ahead = scored.groupBy("unit_seq", "target").agg((1 - F.sum("p0") + F.sum("s")).alias("z"), F.first("own_s").alias("own_s"), F.count_if(F.round("s", 12) > F.round("own_s", 12)).alias("ahead"), F.count_if(F.round("p0", 12) > F.round("own_s", 12)).alias("moved"))
    own = long.withColumnRenamed("item", "target").join(q0, "target").join(ahead, ["unit_seq", "target"], "left").withColumn("own_s", F.coalesce("own_s", "q0"))
    # items without evidence keep their prior: those above the own score are the prior's head, less the ones that moved
    head = own.withColumn("os", F.round("own_s", 12))
    steps = prior.groupBy(F.round("p0", 12).alias("p")).agg(F.count("*").alias("c"))
    curve = steps.withColumn("above", F.sum("c").over(Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)))
    ladder = curve.agg(F.array_sort(F.collect_list(F.struct("p", "above"))).alias("ladder"))
    place = head.join(F.broadcast(ladder)).withColumn("head", F.coalesce(F.try_element_at(F.filter("ladder", lambda x: x["p"] > F.col("os")), F.lit(1))["above"], F.lit(0))).drop("ladder", "os")
    partners = R.oriented(train, 1).groupBy("src").agg(F.count("*").alias("degree"))
    degrees = prior.join(partners, prior["item"] == partners["src"], "left").select(F.col("item").alias("target"), F.rank().over(Window.orderBy(F.desc(F.coalesce("degree", F.lit(0))))).alias("degree_rank"))  # a vocabulary
    out = place.join(degrees, "target").join(F.broadcast(v.select(F.col("v").alias("vocabulary"))))
    rank = 1 + F.coalesce("ahead", F.lit(0)) + F.col("head") - F.coalesce("moved", F.lit(0))
    return out.select("unit_seq", F.col("target").alias("item"), (-F.log2(F.col("own_s") / F.coalesce("z", F.lit(1.0)))).alias("nll"), (-F.log2("q0")).alias("base_nll"), rank.cast("long").alias("rank"), F.col("prior_rank").cast("long").alias("base_rank"), F.col("degree_rank").cast("long").alias("degree_rank"), "vocabulary")


def scoreboard(scores: DataFrame) -> DataFrame:
    """AGG-26, INF-6: perplexities, reciprocal ranks, hits, rank shares and the gains with their intervals; one row."""
    gain = F.col("base_nll") - F.col("nll")
    better = 1 / F.col("rank") - 1 / F.col("base_rank")
    hits = [F.avg((F.col(r) <= k).cast("int")).alias(f"{p}hits{k}") for k in (1, 5, 10) for p, r in (("", "rank"), ("base_", "base_rank"), ("degree_", "degree_rank"))]
    a = scores.agg(
        F.count("*").alias("n"),
        F.avg("nll").alias("nll"),
        F.avg("base_nll").alias("base_nll"),
        F.avg(1 / F.col("rank")).alias("mrr"),
        F.avg(1 / F.col("base_rank")).alias("base_mrr"),
        F.avg(1 / F.col("degree_rank")).alias("degree_mrr"),
        *hits,
        (F.avg("rank") / F.avg("vocabulary")).alias("rank_share"),
        (F.avg("base_rank") / F.avg("vocabulary")).alias("base_rank_share"),
        F.avg(better).alias("mrr_gain"),
        (1.96 * F.stddev_samp(better) / F.sqrt(F.count("*"))).alias("mrr_half_width"),
        F.avg(gain).alias("gain"),
        (1.96 * F.stddev_samp(gain) / F.sqrt(F.count("*"))).alias("half_width"),
    )
    verdict = F.when(F.col("gain") - F.col("half_width") > 0, "YES").when(F.col("gain") + F.col("half_width") > 0, "PARTIAL").otherwise("NO")
    return a.withColumn("perplexity", F.pow(F.lit(2.0), F.col("nll"))).withColumn("base_perplexity", F.pow(F.lit(2.0), F.col("base_nll"))).withColumn("verdict", verdict)


def decision(board: DataFrame, nulls: DataFrame, regimes: DataFrame, min_gain: float, min_hits: float, min_regimes: int = 3) -> DataFrame:
    """INF-6: one row of five criteria and a verdict, from the scoreboard of the main regime, the mean reciprocal
    ranks (mrr) of the null models, and the scoreboards of all regimes.

    c1: the gain and its interval are above 0, and the perplexity and reciprocal rank better than by frequency.
    c2: the reciprocal rank is above the nulls' mean and their value of rank 97.5 % (of few nulls, the largest).
    c3: it is above that by degree.  c4: gain and hits at 10 rise by the least effects asked for.  c5: so many
    regimes gain in bits and in reciprocal rank.  Without nulls c2 is false.
    """
    order = nulls.agg(F.array_sort(F.collect_list("mrr")).alias("ms"))  # one value a null model
    top = order.select("ms", F.when(F.size("ms") > 0, F.element_at("ms", F.least(F.size("ms"), 1 + F.floor(0.975 * F.size("ms")).cast("int")))).alias("null_top"), F.aggregate("ms", F.lit(0.0), lambda a, x: a + x).alias("null_sum"))
    passing = regimes.agg(F.count_if((F.col("gain") > 0) & (F.col("mrr") > F.col("base_mrr"))).alias("regimes_passing"))
    d = board.join(F.broadcast(top)).join(F.broadcast(passing))
    c = F.col
    rules = {
        "c1": (c("gain") > 0) & (c("gain") - c("half_width") > 0) & (c("perplexity") < c("base_perplexity")) & (c("mrr") > c("base_mrr")),
        "c2": F.coalesce((c("mrr") > c("null_top")) & (c("mrr") > c("null_sum") / F.nullif(F.size("ms"), F.lit(0))), F.lit(False)),
        "c3": c("mrr") > c("degree_mrr"),
        "c4": (c("gain") >= min_gain) & (c("hits10") - c("base_hits10") >= min_hits),
        "c5": c("regimes_passing") >= min_regimes,
    }
    d = d.select("gain", "mrr", "base_mrr", "degree_mrr", "null_top", "regimes_passing", *(F.coalesce(x, F.lit(False)).alias(n) for n, x in rules.items()))
    return d.withColumn("verdict", F.when(~c("c1"), "NON_PREDICTIVE").when(c("c2") & c("c3") & c("c4") & c("c5"), "GENUINE_STRUCTURE").otherwise("FREQUENCY_SHAPED"))


def mirror(inc: DataFrame) -> DataFrame:
    """JOI-17, INF-15: (group_id, pairs, mean_jaccard): likeness of unit i and unit n - 1 - i of a group."""
    units = R.numbered_units(inc).withColumn("n", F.count("*").over(Window.partitionBy("group_id")))
    at = inc.select("group_id", "unit_seq", "item").join(units, ["group_id", "unit_seq"])
    size = at.groupBy("group_id", "rn").agg(F.count("*").alias("s"))
    pairs = units.select("group_id", "rn", (F.col("n") + 1 - F.col("rn")).alias("other")).where("rn < other")
    common = at.select("group_id", "item", "rn", (F.col("n") + 1 - F.col("rn")).alias("other")).where("rn < other").join(at.select("group_id", "item", F.col("rn").alias("other")), ["group_id", "item", "other"]).groupBy("group_id", "rn").agg(F.count("*").alias("k"))
    rows = pairs.join(size, ["group_id", "rn"]).join(size.select("group_id", F.col("rn").alias("other"), F.col("s").alias("s2")), ["group_id", "other"]).join(common, ["group_id", "rn"], "left")
    k = F.coalesce("k", F.lit(0))
    return rows.groupBy("group_id").agg(F.count("*").alias("pairs"), F.avg(k / (F.col("s") + F.col("s2") - k)).alias("mean_jaccard"))


def structure_ranks(train: DataFrame, test: DataFrame) -> DataFrame:
    """INF-11: (unit_seq, item, rank): a held-out item's rank by evidence alone, among the items that have any;
    an item without evidence has none (null)."""
    ppmi = R.ppmi_edges(train).select("item", "dim", "w")
    seen = train.select("item").distinct()
    known = test.join(seen, "item", "left_semi").select("unit_seq", "item")
    long = known.withColumn("n", F.count("*").over(Window.partitionBy("unit_seq"))).where("n >= 2").drop("n")
    context = long.join(long.select("unit_seq", F.col("item").alias("dim")), "unit_seq").where("item <> dim").select("unit_seq", F.col("item").alias("target"), "dim")
    ev = context.join(ppmi, "dim").groupBy("unit_seq", "target", "item").agg(F.round(F.sum("w"), 9).alias("ev"))
    ranked = ev.withColumn("rank", F.rank().over(Window.partitionBy("unit_seq", "target").orderBy(F.desc("ev")))).where("item = target").select("unit_seq", "target", "rank")
    return long.join(ranked.withColumnRenamed("target", "item"), ["unit_seq", "item"], "left").select("unit_seq", "item", F.col("rank").cast("long").alias("rank"))
