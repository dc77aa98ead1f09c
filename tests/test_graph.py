import itertools
import random

import numpy as np
import pytest

from marginalia.operators import graph as G
from marginalia.operators import kernels as N


def edges(spark, pairs, weight=1.0):
    return spark.createDataFrame([(a, b, weight) for a, b in pairs], "src string, tgt string, weight double")


def random_edges(n, m, seed):
    r = random.Random(seed)
    return sorted({(a, b) for a, b in ((f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)) if a != b})


def closure(pairs):
    reach = set(pairs)
    while True:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} | reach
        if more == reach:
            return reach
        reach = more


def test_components(spark):
    e = random_edges(40, 25, 1) + [(f"p{i:02}", f"p{i + 1:02}") for i in range(20)]
    got = {r.node: r.component for r in G.components(edges(spark, e)).collect()}
    both = closure(set(e) | {(b, a) for a, b in e})
    assert got == {x: min([x] + [b for a, b in both if a == x]) for x in {y for p in e for y in p}}


def test_reach_and_strong_components(spark):
    e = random_edges(15, 24, 2)
    r = closure(set(e))
    df = edges(spark, e)
    assert {tuple(x) for x in G.reach(df).collect()} == r
    scc = {x.node: x.scc for x in G.strong_components(df).collect()}
    nodes = {y for p in e for y in p}
    assert scc == {x: min([x] + [y for y in nodes if (x, y) in r and (y, x) in r]) for x in nodes}


def test_levels_are_longest_paths(spark):
    df = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("b", "e")])
    scc = G.strong_components(df)
    assert {r.scc: r.level for r in G.levels(df, scc).collect()} == {"a": 2, "b": 1, "c": 0, "d": 1, "e": 0}
    assert {r.scc: r.level for r in G.levels(df, scc, to_sink=False).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 2}


def census(pairs):
    bits = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    out = {}
    for t in itertools.combinations(sorted({y for p in pairs for y in p}), 3):
        links = sum((t[i], t[j]) in pairs or (t[j], t[i]) in pairs for i, j in ((0, 1), (0, 2), (1, 2)))
        if links >= 2:
            code = min(sum(((t[p[i]], t[p[j]]) in pairs) << (5 - n) for n, (i, j) in enumerate(bits)) for p in itertools.permutations(range(3)))
            out[f"{code:06b}"] = out.get(f"{code:06b}", 0) + 1
    return out


#: The least codes of the thirteen connected triad classes.
CLASSES = "000011 000110 000111 001010 001011 001111 010101 010111 011001 011011 011110 011111 111111".split()


@pytest.mark.parametrize("seed", [1, 2])
def test_triads(spark, seed):
    e = random_edges(14, 60, seed)
    got = {r.code: r.n for r in G.triads(edges(spark, e)).collect()}
    assert got == census(set(e)) and set(got) <= set(CLASSES)


def test_triad_descriptions():
    kinds = {c: (e, m) for c, e, m, _ in G.describe_triads()}
    assert kinds["111111"] == (6, 3) and kinds["000000"] == (0, 0) and kinds["101000"] == (2, 1)


def test_cycles_once_each(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("d", "a")]
    assert {r.cycle for r in G.cycles(edges(spark, e), 4).collect()} == {"a>b", "a>b>c", "a>b>c>d"}


def test_cliques_and_percolation(spark):
    k4 = lambda xs: list(itertools.combinations(xs, 2))
    sharing3 = {r.community for r in G.percolation(edges(spark, sorted(set(k4("abcd") + k4("bcde"))))).collect()}
    assert len(sharing3) == 1
    rows = G.percolation(edges(spark, sorted(set(k4("abcd") + k4("cdef"))))).collect()
    assert len({r.community for r in rows}) == 2 and sum(r.node == "c" for r in rows) == 2


def test_k_core(spark):
    e = list(itertools.combinations("abcd", 2)) + [("d", "e"), ("e", "f")]
    assert {r.node for r in G.k_core(edges(spark, e), 3).collect()} == set("abcd")


def test_label_propagation_is_synchronous(spark):
    e = random_edges(20, 30, 3)
    near = {}
    for a, b in e:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    labels = {x: x for x in near}
    for _ in range(20):
        new = {}
        for x, ys in near.items():
            votes = {}
            for y in ys:
                votes[labels[y]] = votes.get(labels[y], 0) + 1
            new[x] = min(votes, key=lambda v: (-votes[v], v))
        if new == labels:
            break
        labels = new
    assert {r.node: r.label for r in G.label_propagation(edges(spark, e)).collect()} == labels


def test_betweenness_of_a_path_and_brute_force(spark):
    got = {r.node: r.betweenness for r in N.centrality(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])).collect()}
    assert got == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}
    e = random_edges(12, 18, 4)
    nodes, near = N.adjacency(edges(spark, e).toPandas())
    n = len(nodes)
    hops = np.full((n, n), np.inf)
    ways = np.zeros((n, n))
    for s in range(n):
        hops[s, s], ways[s, s], front = 0, 1, [s]
        while front:
            nxt = []
            for v in front:
                for w in near[v]:
                    if hops[s, w] == np.inf:
                        hops[s, w] = hops[s, v] + 1
                        nxt.append(w)
                    if hops[s, w] == hops[s, v] + 1:
                        ways[s, w] += ways[s, v]
            front = nxt
    want = [sum(ways[s, v] * ways[v, t] / ways[s, t] for s in range(n) for t in range(s + 1, n) if v not in (s, t) and np.isfinite(hops[s, t]) and hops[s, v] + hops[v, t] == hops[s, t]) for v in range(n)]
    got = {r.node: r.betweenness for r in N.centrality(edges(spark, e)).collect()}
    assert np.allclose([got[x] for x in nodes], want)


def test_eigenvector():
    near = {0: {1: 1.0, 2: 1.0}, 1: {0: 1.0, 2: 1.0}, 2: {0: 1.0, 1: 1.0, 3: 1.0}, 3: {2: 1.0}}
    m = np.array([[near[i].get(j, 0) for j in range(4)] for i in range(4)])
    v = np.linalg.eigh(m)[1][:, -1]
    assert np.allclose(N.power(near), np.abs(v), atol=1e-6)


def test_modules_of_two_cliques(spark):
    e = list(itertools.combinations("abcd", 2)) + list(itertools.combinations("wxyz", 2)) + [("d", "w")]
    rows = {r.node: r.module for r in N.greedy_modules(edges(spark, e), link_share=1.0).collect()}
    assert {rows[x] for x in "abcd"} == {1} and {rows[x] for x in "wxyz"} == {2}


def test_ablation_and_coverage(spark):
    e = [("a", "b"), ("b", "c"), ("c", "d")]
    rank = spark.createDataFrame([("b", 1), ("c", 2), ("a", 3), ("d", 4)], "node string, rank long")
    assert {r.top: r.edges for r in G.ablation(edges(spark, e), rank, (0, 1, 2)).collect()} == {0: 3, 1: 1, 2: 0}
    members = spark.createDataFrame([(f"{a}{b}", x) for a, b in e for x in (a, b)], "rel string, node string")
    assert {r.k: r.covered for r in G.coverage(members, rank).collect()} == {2: 1, 3: 2, 4: 3}


def test_nulls_keep_what_they_promise():
    rng = np.random.default_rng(1)
    units = [set(rng.choice(12, rng.integers(1, 6), replace=False).tolist()) for _ in range(30)]
    traded = N.curveball(units, 200, rng)
    count = lambda us: sorted(x for u in us for x in u)
    assert [len(u) for u in traded] == [len(u) for u in units] and count(traded) == count(units) and traded != units
    e = random_edges(15, 50, 5)
    s = N.swap_edges(e, 300, rng)
    assert sorted(a for a, _ in s) == sorted(a for a, _ in e) and sorted(b for _, b in s) == sorted(b for _, b in e) and len(set(s)) == len(e) and all(a != b for a, b in s)


def test_greedy_cover_ends_covered(spark):
    e = random_edges(10, 20, 6)
    rows = sorted(N.greedy_cover(edges(spark, e)).collect())
    assert rows[-1].covered == len(e) and [r.covered for r in rows] == sorted(r.covered for r in rows)


@pytest.mark.parametrize("f", [G.components, G.reach, G.triads, G.dyads, G.percolation, G.label_propagation, lambda e: G.k_core(e, 3)])
def test_empty_graph(spark, f):
    assert f(edges(spark, [])).count() == 0


def test_large_communities_split(spark):
    strong = [(a, b, 0.9) for c in ("abcd", "wxyz") for a, b in itertools.combinations(c, 2)]
    weak = [(a, b, 0.51) for a in "abcd" for b in "wxyz"]
    df = spark.createDataFrame(strong + weak, "src string, tgt string, weight double")
    rows = G.split_communities(df, 0.5, largest=5).collect()
    assert {frozenset(r.node for r in rows if r.community == c) for c in {r.community for r in rows}} == {frozenset("abcd"), frozenset("wxyz")}
    assert len({r.community for r in G.split_communities(df, 0.5, largest=50).collect()}) == 1


def test_capped_graph_passes_over_taken_edges(spark):
    df = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.7), ("c", "d", 0.6)], "src string, tgt string, weight double")
    got = [(r.src, r.tgt) for r in N.capped_graph(df, 1).collect()]
    assert got == [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")]


def test_trades_of_all_units_at_any_size(spark, monkeypatch):
    """More rows than a sequential kernel takes, in many blocks: sizes and frequencies stay, pairs come near independence."""
    monkeypatch.setattr(N, "LARGEST", 100)
    rng = np.random.default_rng(1)
    units = np.repeat(np.arange(301), 5)[rng.random(1505) < 0.6]
    items = np.concatenate([rng.permutation(8)[:c] for c in np.bincount(units, minlength=301)])
    units = np.unique(units, return_inverse=True)[1]
    after = N.all_trade(units, items, rng)
    assert len(set(zip(after, items, strict=True))) == len(units) and (np.bincount(after) == np.bincount(units)).all() and (after != units).any()
    d = spark.createDataFrame([(int(u), "abcdefgh"[i]) for u, i in zip(units, items, strict=True)], "unit_seq long, item string")
    got = N.traded_pairs(d, 3, block=200).collect()
    want = sum(c * (c - 1) // 2 for c in np.bincount(units))
    assert [sum(r.k for r in got if r.rep == i) for i in range(3)] == [want] * 3 and all(r.a < r.b for r in got)
    assert len({tuple(sorted((r.a, r.b, r.k) for r in got if r.rep == i)) for i in range(3)}) > 1
