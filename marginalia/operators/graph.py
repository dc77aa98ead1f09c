"""Graph operators on edge tables (src, tgt), as joins and aggregates.

Loops run on the driver only as control: each round is a Spark job over the whole edge table, its result
written to the shared folder, and only a count comes back.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rounds


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once each way, without loops."""
    e = edges.where("src <> tgt").select("src", "tgt")
    return e.unionByName(e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) by least reachable name (GRA-1): each node takes its neighbours' least label, and labels
    jump along the labels they name, so that long paths take few rounds."""
    both = undirected(edges)
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min("tgt").alias("m")).select("node", F.least("node", "m").alias("label"))

    def step(now: DataFrame) -> DataFrame:
        near = both.join(now.select(F.col("node").alias("tgt"), F.col("label").alias("l")), "tgt").groupBy("src").agg(F.min("l").alias("l"))
        one = now.join(near, F.col("node") == F.col("src")).select("node", F.least("label", "l").alias("label"))
        jump = one.select(F.col("node").alias("label"), F.col("label").alias("next"))
        return one.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"))

    out = rounds.until_stable(labels, step, ["node", "label"])
    return out.select("node", F.col("label").alias("component"))


def reach(edges: DataFrame) -> DataFrame:
    """(src, tgt): every node reachable from another or itself by a path of at least one edge (GRA-2): path lengths double in each round."""
    e = edges.select("src", "tgt").distinct()

    def step(now: DataFrame) -> DataFrame:
        two = now.join(now.select(F.col("src").alias("tgt"), F.col("tgt").alias("end")), "tgt").select("src", F.col("end").alias("tgt"))
        return now.unionByName(two).distinct()

    return rounds.until_stable(e, step, ["src", "tgt"])


def strong_components(edges: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(node, scc): nodes that reach each other, by least name (GRA-3)."""
    r = closure if closure is not None else reach(edges)
    mutual = r.join(r.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), ["src", "tgt"])
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("tgt").alias("node"))).distinct()
    low = mutual.groupBy(F.col("src").alias("node")).agg(F.min("tgt").alias("m"))
    return nodes.join(low, "node", "left").select("node", F.least("node", F.coalesce("m", "node")).alias("scc"))


def levels(edges: DataFrame, scc: DataFrame, to_sink: bool = True) -> DataFrame:
    """(scc, level): the longest path to a sink, or from a source, in the condensation (GRA-4)."""
    s = scc.select(F.col("node").alias("src"), F.col("scc").alias("a"))
    t = scc.select(F.col("node").alias("tgt"), F.col("scc").alias("b"))
    dag = edges.join(s, "src").join(t, "tgt").where("a <> b").select("a", "b").distinct()
    if not to_sink:
        dag = dag.select(F.col("b").alias("a"), F.col("a").alias("b"))
    start = scc.select("scc").distinct().withColumn("level", F.lit(0).cast("long"))

    def step(now: DataFrame) -> DataFrame:
        up = dag.join(now.select(F.col("scc").alias("b"), "level"), "b").groupBy("a").agg((F.max("level") + 1).alias("up"))
        return now.join(up, F.col("scc") == F.col("a"), "left").select("scc", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"))

    return rounds.until_stable(start, step, ["scc", "level"])


def two_paths(edges: DataFrame) -> DataFrame:
    """(a, b, c, closed): directed paths of two edges, and whether an edge closes them (JOI-16)."""
    e = edges.where("src <> tgt").select("src", "tgt").distinct()
    p = e.select(F.col("src").alias("a"), F.col("tgt").alias("b")).join(e.select(F.col("src").alias("b"), F.col("tgt").alias("c")), "b").where("a <> c")
    return p.join(e.select(F.col("src").alias("a"), F.col("tgt").alias("c"), F.lit(True).alias("closed")), ["a", "c"], "left").select("a", "b", "c", F.coalesce("closed", F.lit(False)).alias("closed"))


def transitivity(edges: DataFrame) -> DataFrame:
    """One row: edges, mutual share, two-paths, closed share (GRA-19)."""
    e = edges.where("src <> tgt").select("src", "tgt").distinct()
    back = e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    n = e.agg(F.count("*").alias("edges"))
    m = e.join(back, ["src", "tgt"], "left_semi").agg(F.count("*").alias("mutual"))
    p = two_paths(e).agg(F.count("*").alias("paths"), F.count_if("closed").alias("shut"))
    return n.join(m).join(p).select("edges", (F.col("mutual") / F.nullif(F.col("edges"), F.lit(0))).alias("reciprocity"), "paths", (F.col("shut") / F.nullif(F.col("paths"), F.lit(0))).alias("transitivity"))


def dyads(edges: DataFrame) -> DataFrame:
    """(kind, n): mutual and one-way pairs (GRA-16)."""
    e = edges.where("src <> tgt").select("src", "tgt").distinct()
    pair = e.groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.count("*").alias("k"))
    return pair.groupBy(F.when(F.col("k") == 2, "mutual").otherwise("asymmetric").alias("kind")).agg(F.count("*").alias("n"))


def triads(edges: DataFrame) -> DataFrame:
    """(code, n): connected triples of nodes by their least 6-bit code over all orders (GRA-17).

    Each connected triple is found from the pairs of neighbours of its nodes and kept once; six edge flags
    follow by joins, and the code is the least over the six permutations.
    """
    e = edges.where("src <> tgt").select("src", "tgt").distinct()
    u = undirected(e)
    wedge = u.select(F.col("src").alias("m"), F.col("tgt").alias("x")).join(u.select(F.col("src").alias("m"), F.col("tgt").alias("y")), "m").where("x < y")
    tri = wedge.select(F.array_sort(F.array("m", "x", "y")).alias("t")).distinct().select(F.col("t")[0].alias("p0"), F.col("t")[1].alias("p1"), F.col("t")[2].alias("p2"))
    flags = tri
    for i in range(3):
        for j in range(3):
            if i != j:
                have = e.select(F.col("src").alias(f"p{i}"), F.col("tgt").alias(f"p{j}"), F.lit(1).alias(f"e{i}{j}"))
                flags = flags.join(have, [f"p{i}", f"p{j}"], "left")
    bits = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]

    def code(order: tuple[int, int, int]):
        out = F.lit(0)
        for n, (i, j) in enumerate(bits):
            out = out + F.coalesce(F.col(f"e{order[i]}{order[j]}"), F.lit(0)) * (1 << (5 - n))
        return out

    least = F.least(*(code(p) for p in permutations(range(3))))
    return flags.groupBy(F.lpad(F.bin(least), 6, "0").alias("code")).agg(F.count("*").alias("n"))


def describe_triads() -> list[tuple[str, int, int, int]]:
    """Of each of the 64 codes: edges, mutual pairs, connected pairs (GRA-18), by a rule."""
    bits = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    out = []
    for c in range(64):
        has = {p for n, p in enumerate(bits) if c >> (5 - n) & 1}
        mutual = sum((j, i) in has for i, j in has) // 2
        out.append((f"{c:06b}", len(has), mutual, len(has) - mutual))
    return out


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """Directed cycles of 3 or up to ``length`` edges, from their least node on (GRA-15): one row a cycle, as a path."""
    e = edges.where("src <> tgt").select("src", "tgt").distinct()
    paths = e.where("src < tgt").select(F.array("src", "tgt").alias("path"), F.col("src").alias("start"), F.col("tgt").alias("end"))
    found = None
    for _ in range(2, length + 1):
        back = paths.join(e.select(F.col("src").alias("end"), F.col("tgt").alias("start")), ["start", "end"], "left_semi").select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("size"))
        found = back if found is None else found.unionByName(back)
        paths = paths.join(e.select(F.col("src").alias("end"), F.col("tgt").alias("next")), "end").where((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path"), "start", F.col("next").alias("end"))
    return found


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, kinds, strongest) of typed edges (GRA-20)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("tgt").alias("out_degree"))
    into = edges.groupBy(F.col("tgt").alias("node")).agg(F.count_distinct("src").alias("in_degree"))
    ends = edges.select(F.col("src").alias("node"), F.col("tgt").alias("other"), "type", "weight").unionByName(edges.select(F.col("tgt").alias("node"), F.col("src").alias("other"), "type", "weight"))
    best = ends.groupBy("node").agg(F.count_distinct("type").alias("kinds"), F.min_by("other", F.struct(-F.round("weight", 9), "other")).alias("strongest"))
    return best.join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), "kinds", "strongest")


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """(node): nodes left when those of fewer than k neighbours are taken off again and again (GRA-12)."""
    both = undirected(edges)

    def step(now: DataFrame) -> DataFrame:
        enough = now.groupBy("src").agg(F.count("*").alias("d")).where(F.col("d") >= k).select("src")
        return now.join(enough, "src", "left_semi").join(enough.select(F.col("src").alias("tgt")), "tgt", "left_semi").select("src", "tgt")

    return rounds.until_stable(both, step, ["src", "tgt"]).select(F.col("src").alias("node")).distinct()


def ablation(edges: DataFrame, ranked: DataFrame, tops: tuple[int, ...]) -> DataFrame:
    """(top, edges): edges left after the ``top`` highest of ``ranked`` (node, rank) are taken off, for every top
    (GRA-21, JOI-19): an edge falls at its better end's rank, so all ablations are one pass."""
    r = lambda c: ranked.select(F.col("node").alias(c), F.col("rank").alias(f"r_{c}"))
    e = edges.join(r("src"), "src", "left").join(r("tgt"), "tgt", "left").select(F.least(F.coalesce("r_src", F.lit(1 << 62)), F.coalesce("r_tgt", F.lit(1 << 62))).alias("falls"))
    at = F.explode(F.array(*map(F.lit, tops))).alias("top")
    return e.select("falls", at).groupBy("top").agg(F.count_if(F.col("falls") > F.col("top")).alias("edges"))


def coverage(members: DataFrame, ranked: DataFrame) -> DataFrame:
    """(k, covered, share): relations all of whose members (rel, node) are among the first k of ``ranked`` (GRA-24, JOI-18):
    a relation is covered at its last member's rank."""
    at = members.join(ranked, "node").groupBy("rel").agg(F.max("rank").alias("k"))
    n = members.agg(F.count_distinct("rel").alias("n"))
    steps = at.groupBy("k").agg(F.count("*").alias("new"))
    run = steps.alias("s").join(steps.alias("t"), F.col("t.k") <= F.col("s.k")).groupBy(F.col("s.k").alias("k")).agg(F.sum("t.new").alias("covered"))
    return run.join(F.broadcast(n)).select("k", "covered", (F.col("covered") / F.col("n")).alias("share"))


def label_propagation(edges: DataFrame, sweeps: int = 20) -> DataFrame:
    """(node, label): synchronous weighted label propagation of (src, tgt, weight), ties to the least label (GRA-8)."""
    w = edges.where("src <> tgt").select("src", "tgt", "weight")
    both = w.unionByName(w.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "weight"))
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))

    def step(now: DataFrame) -> DataFrame:
        votes = both.join(now.select(F.col("node").alias("tgt"), "label"), "tgt").groupBy("src", "label").agg(F.round(F.sum("weight"), 9).alias("v"))
        return votes.groupBy(F.col("src").alias("node")).agg(F.min_by("label", F.struct(-F.col("v"), "label")).alias("label"))

    return rounds.until_stable(labels, step, ["node", "label"], most=sweeps)


def cliques4(edges: DataFrame) -> DataFrame:
    """(a, b, c, d): sets of four nodes all linked (GRA-9), smallest first: each join closes one more node."""
    e = edges.where("src <> tgt").select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
    ren = lambda x, y: e.select(F.col("a").alias(x), F.col("b").alias(y))
    tri = e.join(ren("b", "c"), "b").join(ren("a", "c"), ["a", "c"], "left_semi").select("a", "b", "c")
    return tri.join(ren("c", "d"), "c").join(ren("a", "d"), ["a", "d"], "left_semi").join(ren("b", "d"), ["b", "d"], "left_semi").select("a", "b", "c", "d")


def percolation(edges: DataFrame) -> DataFrame:
    """(node, community): k-clique percolation at k = 4: cliques that share three nodes are one community; a node may be in several (GRA-9)."""
    q = cliques4(edges).withColumn("clique", F.concat_ws("|", "a", "b", "c", "d"))
    sides = [("a", "b", "c"), ("a", "b", "d"), ("a", "c", "d"), ("b", "c", "d")]
    faces = None
    for s in sides:
        f = q.select("clique", F.concat_ws("|", *s).alias("face"))
        faces = f if faces is None else faces.unionByName(f)
    least = faces.groupBy("face").agg(F.min("clique").alias("tgt"))  # a star to each face's least clique, not all pairs
    linked = components(faces.join(least, "face").select(F.col("clique").alias("src"), "tgt"))
    of = q.select("clique", F.explode(F.array("a", "b", "c", "d")).alias("node"))
    return of.join(linked.select(F.col("node").alias("clique"), "component"), "clique", "left").select("node", F.coalesce("component", "clique").alias("community")).distinct()


def split_communities(edges: DataFrame, start: float, step: float = 0.03, largest: int = 40, cap: float = 0.6) -> DataFrame:
    """(node, community, threshold): percolation communities; those of more than ``largest`` nodes are percolated
    again, within themselves, at thresholds higher by ``step``, up to ``cap`` (GRA-10)."""
    found, todo, level = None, edges.where(F.col("weight") >= start), start
    while True:
        own = rounds.written(percolation(todo))
        size = own.groupBy("community").agg(F.count("*").alias("n"))
        big = size.where(F.col("n") > largest).select("community") if level + step <= cap else size.where(F.lit(False)).select("community")
        done = own.join(big, "community", "left_anti").select("node", "community", F.lit(level).alias("threshold"))
        found = done if found is None else found.unionByName(done)
        rest = rounds.written(own.join(big, "community", "left_semi"))
        if rest.isEmpty():
            return found
        level = round(level + step, 9)
        a, b = rest.select(F.col("node").alias("src"), "community"), rest.select(F.col("node").alias("tgt"), "community")
        todo = rounds.written(edges.where(F.col("weight") >= level).join(a, "src").join(b, ["tgt", "community"]).select("src", "tgt", "weight").distinct())


def triad_edges(edges: DataFrame) -> DataFrame:
    """(code, edges, share): edges that are part of some connected triple with so many links among its three pairs (GRA-26)."""
    e = edges.where("src <> tgt").select("src", "tgt").distinct()
    u = undirected(e)
    wedge = u.select(F.col("src").alias("m"), F.col("tgt").alias("x")).join(u.select(F.col("src").alias("m"), F.col("tgt").alias("y")), "m").where("x < y")
    closed = wedge.join(u.select(F.col("src").alias("x"), F.col("tgt").alias("y"), F.lit(True).alias("c")), ["x", "y"], "left")
    kind = F.when(F.col("c"), "closed").otherwise("open").alias("kind")
    sides = closed.select(kind, F.explode(F.array(F.struct(F.col("m").alias("p"), F.col("x").alias("q")), F.struct(F.col("m").alias("p"), F.col("y").alias("q")))).alias("s")).select("kind", "s.p", "s.q").distinct()
    both = e.select(F.least("src", "tgt").alias("p"), F.greatest("src", "tgt").alias("q"))
    n = e.agg(F.count("*").alias("n"))
    hit = sides.select("kind", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct().join(both, ["p", "q"])
    return hit.groupBy("kind").agg(F.count("*").alias("edges")).join(F.broadcast(n)).select("kind", "edges", (F.col("edges") / F.col("n")).alias("share"))
