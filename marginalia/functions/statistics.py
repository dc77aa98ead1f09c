"""Statistics as column expressions and grouped aggregates.  Every ratio is guarded: an empty or constant
group gives 0 or null as stated, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe(x: Column, y: Column) -> Column:
    """x / y, and null where y is 0 or null."""
    return x / F.nullif(y.cast("double"), F.lit(0.0))


def spread(counts: DataFrame, by: str, n: str, groups: int | Column) -> DataFrame:
    """Of positive counts (by, ..., n): total, k, entropy in bits, evenness, top share, coverage, Gini,
    participation ratio and concentration (AGG-7, 12, 13, 14, 15)."""
    w = Window.partitionBy(by)
    p = F.col(n) / F.sum(n).over(w)
    rows = counts.withColumn("p", p).withColumn("i", F.row_number().over(w.orderBy(n))).withColumn("size", F.count("*").over(w))
    out = rows.groupBy(by).agg(
        F.sum(n).alias("total"),
        F.count("*").alias("k"),
        (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"),
        F.max("p").alias("top_share"),
        (F.sum((2 * F.col("i") - F.col("size") - 1) * F.col(n)) / (F.count("*") * F.sum(n))).alias("gini"),
        (F.sum(n) * F.sum(n) / F.sum(F.col(n) * F.col(n))).alias("participation"),
        F.sum(F.col("p") * F.col("p")).alias("hhi"),
    )
    size = groups if isinstance(groups, Column) else F.lit(groups)
    return out.withColumn("evenness", F.when(F.col("k") > 1, F.col("entropy") / F.log2("k")).otherwise(0.0)).withColumn("coverage", F.col("k") / size).withColumn("tier", F.when(F.col("hhi") >= 0.25, "concentrated").when(F.col("hhi") >= 0.1, "moderate").otherwise("spread"))


def summary(df: DataFrame, by: str, x: str) -> DataFrame:
    """AGG-10: mean, median, population deviation, 2.5 and 97.5 percentiles by straight lines, least and most."""
    q = F.percentile(x, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return df.groupBy(by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), q.alias("q"), F.min(x).alias("least"), F.max(x).alias("most")).select(by, "mean", "std", F.col("q")[0].alias("p_low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p_high"), "least", "most")


def nearest_rank(df: DataFrame, by: str, x: str, q: float) -> DataFrame:
    """AGG-11: the value at place floor(q n) of the sorted values, counted from 0; by rank, without a list."""
    w = Window.partitionBy(by)
    rows = df.where(F.col(x).isNotNull()).withColumn("r", F.row_number().over(w.orderBy(x))).withColumn("n", F.count("*").over(w))
    return rows.where(F.col("r") == F.least(F.col("n"), F.floor(q * F.col("n")) + 1)).select(by, F.col(x).alias("value"))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """AGG-16: null where the deviation vanishes."""
    return F.when(std > 1e-9, (x - mean) / std)


def structure_fraction(observed: Column, null: Column) -> Column:
    """AGG-17: what a null model leaves unexplained, from 0; 0 for nothing observed."""
    return F.when(observed > 0, F.greatest(F.lit(0.0), (observed - null) / F.nullif(observed, F.lit(0.0)))).otherwise(0.0)


def spearman(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """AGG-18: rank correlation with ordinal ranks, ties by ``tie``; one row.

    Ranks come from a global sort by range, numbered within ranges whose offsets are a small table, so no
    single task ranks all rows.
    """
    a = ranked(df, x, tie, "rx")
    b = ranked(df, y, tie, "ry")
    d = F.sum((F.col("rx") - F.col("ry")) * (F.col("rx") - F.col("ry")))
    n = F.count("*")
    return a.select(tie, "rx").join(b.select(tie, "ry"), tie).agg(F.when(n > 1, 1 - 6 * d / F.nullif((n * (n * n - 1)).cast("double"), F.lit(0.0))).alias("rho"), n.alias("n"))


def ranked(df: DataFrame, x: str, tie: str, name: str, descending: bool = False) -> DataFrame:
    """Global ordinal ranks 1..n by (x, tie) without a single-partition window: a coarse cell of x first, ranks
    within cells, and the counts of the cells before."""
    n_cells = 256
    cuts = df.agg(F.percentile_approx(x, F.array(*(F.lit(i / n_cells) for i in range(1, n_cells))), 1000).alias("cuts"))
    cell = F.size(F.filter("cuts", lambda c: c < F.col(x)))
    rows = df.join(F.broadcast(cuts)).withColumn("cell", cell).drop("cuts")  # one row is broadcast
    order = [F.desc(x) if descending else F.asc(x), F.asc(tie)]
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(*order)))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("size"))
    earlier = sizes.alias("s").join(sizes.alias("t"), (F.col("t.cell") > F.col("s.cell")) if descending else (F.col("t.cell") < F.col("s.cell")), "left").groupBy(F.col("s.cell").alias("cell")).agg(F.coalesce(F.sum("t.size"), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(earlier), "cell").withColumn(name, F.col("r") + F.col("before")).drop("cell", "r", "before")  # at most 256 rows are broadcast


def agreement(df: DataFrame, x: str, y: str) -> DataFrame:
    """AGG-21, AGG-22: adjusted Rand index and normalised mutual information of two labelings; one row.

    Both come from the contingency table, whose size is that of the labels.
    """
    cells = df.groupBy(x, y).agg(F.count("*").cast("double").alias("c"))
    two = lambda c: c * (c - 1) / 2
    rows, cols = cells.groupBy(x).agg(F.sum("c").alias("a")), cells.groupBy(y).agg(F.sum("c").alias("b"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(two(F.col("c"))).alias("s"))
    ra = rows.agg(F.sum(two(F.col("a"))).alias("sa"))
    rb = cols.agg(F.sum(two(F.col("b"))).alias("sb"))
    n = total.select("n")
    hx = rows.join(F.broadcast(n)).agg((-F.sum(F.col("a") / F.col("n") * F.log(F.col("a") / F.col("n")))).alias("hx"))
    hy = cols.join(F.broadcast(n)).agg((-F.sum(F.col("b") / F.col("n") * F.log(F.col("b") / F.col("n")))).alias("hy"))
    mi = cells.join(rows, x).join(cols, y).join(F.broadcast(n)).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"))
    one = total.join(ra).join(rb).join(hx).join(hy).join(mi)
    expected = F.col("sa") * F.col("sb") / F.nullif(two(F.col("n")), F.lit(0.0))
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / F.nullif(most - expected, F.lit(0.0)))
    nmi = F.when(F.col("hx") + F.col("hy") == 0, 1.0).otherwise(2 * F.col("mi") / F.nullif(F.col("hx") + F.col("hy"), F.lit(0.0)))
    return one.select(ari.alias("ari"), nmi.alias("nmi"))


def residue_chi2(values: DataFrame, name: str, value: str, divisors: tuple[int, int]) -> DataFrame:
    """AGG-23: (name, divisor, n, chi2) of how evenly residues are hit, empty residues included.

    The sum of squares over hit residues gives the statistic in closed form, so no empty cell is made.
    """
    d = F.explode(F.sequence(F.lit(divisors[0]), F.lit(divisors[1]))).alias("divisor")
    cells = values.select(name, value, d).groupBy(name, "divisor", F.pmod(F.col(value), F.col("divisor")).alias("r")).agg(F.count("*").alias("c"))
    out = cells.groupBy(name, "divisor").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    return out.select(name, "divisor", "n", (F.col("sq") * F.col("divisor") / F.col("n") - F.col("n")).alias("chi2"))


def step_up(df: DataFrame, p: str, tie: list[str], alpha: float = 0.05) -> DataFrame:
    """AGG-25: Bonferroni and Benjamini-Hochberg decisions for a table of tests (one row each)."""
    w = Window.orderBy(p, *tie)  # tests are few: divisors by sequences
    rows = df.withColumn("rank", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy()))
    good = F.when(F.col(p) <= alpha * F.col("rank") / F.col("m"), F.col("rank"))
    rows = rows.withColumn("last", F.max(good).over(Window.partitionBy()))
    return rows.withColumn("bonferroni", F.col(p) <= alpha / F.col("m")).withColumn("bh", F.coalesce(F.col("rank") <= F.col("last"), F.lit(False))).drop("last")


def cosine_of(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """AGG-20: cosine of the count vectors of two groups that share keys, a < b."""
    norm = df.groupBy(group).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    l, r = df.select(F.col(group).alias("a"), key, F.col(value).alias("x")), df.select(F.col(group).alias("b"), key, F.col(value).alias("y"))
    dot = l.join(r, key).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dot.join(norm.select(F.col(group).alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col(group).alias("b"), F.col("norm").alias("nb")), "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cos"))


def jaccard_of(df: DataFrame, group: str, key: str) -> DataFrame:
    """AGG-19: Jaccard similarity of the key sets of two groups that share any, a < b."""
    d = df.select(group, key).distinct()
    size = d.groupBy(group).agg(F.count("*").alias("n"))
    both = d.select(F.col(group).alias("a"), key).join(d.select(F.col(group).alias("b"), key), key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    out = both.join(size.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))


def tf_idf(counts: DataFrame, group: str, item: str, tf: str) -> DataFrame:
    """AGG-31: tf ln(n / df) of (group, item, tf)."""
    df_ = counts.groupBy(item).agg(F.count_distinct(group).alias("df"))
    n = counts.agg(F.count_distinct(group).alias("n"))
    return counts.join(df_, item).join(F.broadcast(n)).select(group, item, (F.col(tf) * F.log(F.col("n") / F.col("df"))).alias("tf_idf"))
