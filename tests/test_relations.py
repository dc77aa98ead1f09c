"""Relations, counts and flows on tiny incidences with known answers."""

import itertools
import math
from collections import Counter

import pytest

from marginalia.operators import counts as K
from marginalia.operators import flow as L
from marginalia.operators import incidence as I
from marginalia.operators import relations as R

INC = "group_id long, unit_seq long, item string, pos long"


def inc(spark, units, groups=None):
    rows = [((groups or {}).get(u, 1), u, x, p) for u, items in units.items() for p, x in enumerate(items, 1)]
    return spark.createDataFrame(rows, INC)


UNITS = {1: "abc", 2: "ab", 3: "bac", 4: "ad", 5: "abd", 6: "c", 7: "dcba", 8: "ab"}


def brute_pairs():
    k, ab, ba = Counter(), Counter(), Counter()
    for items in UNITS.values():
        for x, y in itertools.combinations(sorted(items), 2):
            k[x, y] += 1
            (ab if items.index(x) < items.index(y) else ba)[x, y] += 1
    return {p: (k[p], ab[p], ba[p]) for p in k}


def test_pairs_and_orders(spark):
    got = {(r.a, r.b): (r.k, r.ab, r.ba) for r in K.pairs(inc(spark, UNITS)).collect()}
    assert got == brute_pairs()


def test_pairs_of_a_support(spark):
    got = {(r.a, r.b): (r.k, r.ab, r.ba) for r in K.pairs(inc(spark, UNITS), 2).collect()}
    assert got == {p: v for p, v in brute_pairs().items() if v[0] >= 2}


def test_marginals_sum_to_tokens(spark):
    i = inc(spark, UNITS)
    assert sum(r.c for r in K.marginals(i).collect()) == i.count()


def test_npmi_is_one_where_every_unit_holds_the_pair(spark):
    i = inc(spark, dict.fromkeys(range(6), "xy"))
    r = R.co_occurs(i).collect()
    assert len(r) == 1 and r[0].npmi == 1.0 and r[0].confidence == 1.0 and r[0].stability == 1.0


def test_npmi_of_known_counts(spark):
    k, _, _ = brute_pairs()["a", "b"]
    ca, cb = (sum(x in u for u in UNITS.values()) for x in "ab")
    r = [r for r in R.co_occurs(inc(spark, UNITS), 3).collect() if (r.a, r.b) == ("a", "b")][0]
    want = math.log((k / 8) / (ca / 8 * cb / 8))
    assert math.isclose(r.pmi, want) and math.isclose(r.npmi, want / -math.log(k / 8))


def test_order_skips_ties(spark):
    rows = [(1, u, x, 1) for u in range(12) for x in "ab"] + [(1, 100 + u, x, p) for u in range(10) for p, x in enumerate("cd")]
    got = {(r.relation, r.src, r.tgt) for r in R.precedes(spark.createDataFrame(rows, INC)).collect()}
    assert got == {("PRECEDES", "c", "d"), ("FOLLOWS", "d", "c")}


def test_offsets_stay_in_groups(spark):
    groups = {u: 1 if u <= 4 else 2 for u in range(1, 9)}
    units = {1: "x", 2: "y", 3: "x", 4: "z", 5: "y", 6: "x", 7: "y", 8: "x"}
    got = {(r.w, r.src, r.tgt): r.k for r in R.predicts(inc(spark, units, groups), (1,), 1, 0.0, 0.0).collect()}
    assert got == {(1, "x", "y"): 2, (1, "y", "x"): 3, (1, "x", "z"): 1}


def test_triples_need_frequent_pairs(spark):
    units = dict(enumerate(["abc"] * 3 + ["abd", "bd"]))
    assert [tuple(r) for r in K.triples(inc(spark, units)).select("a", "b", "c", "k").collect()] == [("a", "b", "c", 3)]


def test_mediation_and_synergy(spark):
    units = dict(enumerate(["abm"] * 6 + ["a", "b"] * 6 + ["m"]))
    i = inc(spark, units)
    t = K.triples(i)
    assert ("a", "b", "m") in {(r.a, r.d, r.m) for r in R.mediates(i, t).collect()}
    got = {(r.a, r.b, r.e): r.synergy for r in R.emerges(i, t).collect()}
    assert math.isclose(got["a", "b", "m"], 0.5)


def test_exclusion_is_never_together(spark):
    units = dict(enumerate(["a"] * 30 + ["b"] * 30 + ["ac"] * 5))
    assert {(r.a, r.b) for r in R.excludes(inc(spark, units)).collect()} == {("a", "b")}


def test_neighbour_floor_is_waived_when_nothing_reaches_it(spark):
    units = dict(enumerate(["xy"] + ["ab"] * 5 + ["c"] * 4))
    got = {r.item: r.k for r in R.neighbours(inc(spark, units)).collect()}
    assert got["x"] == 1 and got["a"] == 5


def test_vocabulary_cut(spark):
    i = inc(spark, {**{u: "ab" for u in range(10)}, 20: "z"})
    assert {r.item for r in I.vocabulary_cut(i, 0.5).select("item").distinct().collect()} == {"a", "b"}


def test_flow_counts(spark):
    i = inc(spark, {1: "ab", 3: "b", 4: "a"})
    assert {(r.src, r.tgt): r.k for r in L.flow(i).collect()} == {("a", "b"): 2, ("b", "a"): 1}
    assert {(r.src, r.tgt): r.k for r in L.flow(i, raw_step=1).collect()} == {("a", "b"): 1, ("b", "a"): 1}
    net = {r.node: r.net for r in L.net_outflow(L.flow(i)).collect()}
    assert net == {"a": 1, "b": -1} and sum(net.values()) == 0


@pytest.mark.parametrize("f", [R.co_occurs, R.depends_on, R.requires, R.precedes, R.predicts, R.neighbours, R.similar, R.excludes, R.typed_edges, K.pairs, K.triples, L.flow])
def test_empty_input(spark, f):
    assert f(spark.createDataFrame([], INC)).count() == 0


def brute_cycles(edges, longest=4):
    out = set()
    for n in range(2, longest + 1):
        for p in itertools.permutations(sorted({x for e in edges for x in e}), n):
            if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in edges for i in range(n)):
                out.add((p + (None,) * (4 - n), min(edges[p[i], p[(i + 1) % n]] for i in range(n))))
    return out


def test_order_cycles_against_all_permutations(spark):
    edges = {("a", "b"): 1.0, ("b", "c"): 0.97, ("c", "a"): 0.99, ("c", "d"): 0.5, ("d", "a"): 1.0, ("d", "b"): 0.4, ("b", "a"): 0.96, ("d", "c"): 0.8, ("e", "e"): 1.0, ("d", "e"): 1.0}
    pre = spark.createDataFrame([(*k, v) for k, v in edges.items()], "src string, tgt string, asymmetry double")
    got = [((r.a, r.b, r.c, r.d), r.asymmetry) for r in R.order_cycles(pre).collect()]
    want = brute_cycles({k: v for k, v in edges.items() if k[0] != k[1]})
    assert len(got) == len(want) and set(got) == want and len(want) >= 5


def test_every_contradiction_rule_fires(spark):
    edge = "src string, tgt string"
    req = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "a"), ("d", "a")], edge)
    dep = spark.createDataFrame([("b", "c"), ("c", "b"), ("e", "b"), ("e", "c"), ("e", "a")], edge)
    exc = spark.createDataFrame([("b", "c"), ("a", "d")], "a string, b string")
    pre = spark.createDataFrame([("a", "b", 0.96), ("b", "a", 0.97), ("c", "d", 1.0), ("d", "e", 1.0), ("e", "c", 0.95), ("a", "f", 1.0), ("f", "g", 0.5), ("g", "a", 1.0)], "src string, tgt string, asymmetry double")
    got = sorted(tuple(r) for r in R.contradictions(req, dep, exc, pre).collect())
    assert got == sorted([
        ("C1_needs_what_it_excludes", True, "d", "a", None, None),
        ("C2_needs_exclusive_items", True, "a", "b", "c", None),
        ("depends_on_exclusive_items", False, "e", "b", "c", None),
        ("C3_strict_order_both_ways", True, "a", "b", None, None),
        ("C4_strict_order_cycle", True, "c", "d", "e", None),
        ("weak_order_cycle", False, "a", "f", "g", None),
        ("C5_exclusive_mutual_dependency", True, "b", "c", None, None),
    ])
    assert R.contradictions(req.limit(0), dep.limit(0), exc.limit(0), pre.limit(0)).count() == 0


def test_identity_checks(spark):
    active = spark.createDataFrame([("x", 1, "p"), ("x", 1, "q"), ("x", 2, "q"), ("x", 3, "q"), ("y", 1, "q"), ("z", 1, "p"), ("z", 2, None)], "concept string, unit long, item string")
    anchors = spark.createDataFrame([("x", "p"), ("y", "p"), ("z", "p")], "concept string, anchor string")
    got = {r.concept: (r.units, r.held, r.verdict) for r in R.identity_checks(active, anchors).collect()}
    assert got == {"x": (3, 1, "identity_instability"), "y": (1, 0, "C6_identity_inversion"), "z": (2, 1, "consistent")}


def test_concept_groups_in_three_orders(spark):
    d = inc(spark, {1: "a", 2: "a", 3: "b", 4: "b", 5: "a", 6: "a", 7: "a"}, {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 3, 7: 3})
    got = {(r.item, r.by): [] for r in R.concept_groups(d).collect()}
    for r in sorted(R.concept_groups(d).collect(), key=lambda r: r.r):
        got[r.item, r.by].append((r.group_id, r.units, r.density, r.share, r.lift))
    rows = {1: (1, 2, 0.5, 0.4, 0.7), 2: (2, 1, 1.0, 0.2, 1.4), 3: (3, 2, 1.0, 0.4, 1.4)}
    assert got["a", "units"] == [rows[1], rows[3], rows[2]] and got["a", "density"] == got["a", "lift"] == [rows[2], rows[3], rows[1]]


def brute_masked(train, test, share):
    """Scores by the definition: every item of the vocabulary gets its own score."""
    import hashlib

    m = Counter(x for u in train.values() for x in set(u))
    t, n = sum(m.values()), len(train)
    p0 = {x: (c + 0.5) / (t + 0.5 * len(m)) for x, c in m.items()}
    k = Counter(p for u in train.values() for p in itertools.permutations(sorted(set(u)), 2))
    w = {p: max(0.0, math.log2((c / n) / ((m[p[0]] / n) * (m[p[1]] / n)))) for p, c in k.items()}
    degree = Counter(a for a, _ in k)
    out = {}
    for unit, items in test.items():
        known = sorted((x for x in set(items) if x in m), key=lambda x: (hashlib.md5(f"1|{unit}|{x}".encode()).hexdigest(), x))
        if len(known) < 2:
            continue
        some = len(known) if share is None else max(1, round(share * len(known)))
        for target in known[:some]:
            context = [x for x in known if x != target] if share is None else known[some:]
            s = {x: p0[x] * 2 ** sum(w.get((x, y), 0.0) for y in context) for x in m}
            above = lambda f: 1 + sum(round(f[x], 12) > round(f[target], 12) for x in m)
            out[unit, target] = (round(-math.log2(s[target] / sum(s.values())), 9), above(s), above(p0), above({x: degree[x] for x in m}), len(m))
    return out


@pytest.mark.parametrize("share", [None, 0.25, 0.5])
def test_masked_scores_against_the_whole_vocabulary(spark, share):
    from marginalia.operators import information as N

    test = {11: "abcd", 12: "ab", 13: "dcz", 14: "a", 15: "zy", 16: "bcdez"}
    train = UNITS | {9: "e", 10: "ce"}
    got = {(r.unit_seq, r.item): (round(r.nll, 9), r["rank"], r.base_rank, r.degree_rank, r.vocabulary) for r in N.masked_scores(inc(spark, train), inc(spark, test), share=share).collect()}
    assert got == brute_masked(train, test, share)


def test_items_that_never_meet_score_as_their_frequency(spark):
    from marginalia.operators import information as N

    d = N.masked_scores(inc(spark, {1: "a", 2: "b", 3: "a", 4: "c"}), inc(spark, {5: "ab", 6: "bc"}))
    rows = d.collect()
    assert len(rows) == 4 and all(abs(r.nll - r.base_nll) < 1e-12 and r["rank"] == r.base_rank for r in rows)
    board = N.scoreboard(d).first()
    assert board.gain == 0 and board.mrr_gain == 0 and board.rank_share == board.base_rank_share and board.verdict == "NO"


def test_evidence_is_summed_once(spark):
    """An own score and those it is compared with are of one pass, so that no last bit puts an item before itself."""
    from marginalia.operators import information as N

    d = N.masked_scores(inc(spark, UNITS), inc(spark, {11: "abcd", 12: "ab"}))
    assert d._jdf.queryExecution().optimizedPlan().toString().count(" AS ev#") == 1


@pytest.mark.parametrize("piece,step,block", [(6_000_000, 500_000, 6_000_000), (50, 7, 30)])
def test_numbered_pairs_against_all_pairs(spark, monkeypatch, piece, step, block):
    """Counts and orders, ties and tags included, in one piece and in many."""
    import random

    from marginalia.operators import pairing

    for name, x in (("PIECE", piece), ("STEP", step), ("BLOCK", block)):
        monkeypatch.setattr(pairing, name, x)
    g = random.Random(1)
    rows = [(u % 7, u, w, g.randrange(4)) for u in range(60) for w in sorted({g.choice("abcdefghijklmnopqéß") + g.choice("xyz") * g.randrange(2) for _ in range(g.randrange(14))})]
    units = {}
    for _, u, w, p in rows:
        units.setdefault(u, []).append((w, p))
    want, c = {}, Counter(w for _, _, w, _ in rows)
    for u, xs in units.items():
        for (a, p), (b, q) in itertools.combinations(sorted(xs), 2):
            k = want.setdefault((a, b, u % 2), [0, 0, 0])
            k[0] += 1
            k[1] += p < q
            k[2] += p > q
    d = spark.createDataFrame(rows, "group_id long, unit_seq long, item string, pos long")
    got = {tuple(r) for r in K.numbered_pairs(d, 3, (d.unit_seq % 2).cast("int"), 2).collect()}
    assert got == {(*p, *k, c[p[0]], c[p[1]]) for p, k in want.items() if k[0] >= 3} and got


def test_pairs_travel_as_runs_and_words_by_line(spark):
    d = spark.createDataFrame([(1, "a b c\nb c"), (1, "c a"), (2, None)], "doc_id long, text string")
    words = I.line_words(d)
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(group_id" not in plan
    assert K.pairs(inc(spark, UNITS), 2)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(block") == 1


def brute_profiles(rows, min_share=0.0):
    """Units and groups of pairs, and products of group counts, by their definitions; null units and groups meet nothing."""
    c, units = Counter(r[2] for r in rows), {r[1] for r in rows if r[1] is not None}
    rows = [r for r in rows if c[r[2]] >= min_share * len(units)]
    held, counts = {}, {}
    for g, u, x in rows:
        counts.setdefault(g, Counter())[x] += 1
        if u is not None:
            held.setdefault((g, u), set()).add(x)
    out = {}
    for g, n in counts.items():
        for p in itertools.combinations(sorted(n), 2):
            both = sum(h == g and {*p} <= xs for (h, _), xs in held.items())
            if both or g is not None:
                r = out.setdefault(p, [0, 0, 0])
                r[0] += both
                r[1] += g is not None and both > 0
                r[2] += n[p[0]] * n[p[1]] if g is not None else 0
    norm = lambda x: math.sqrt(sum(n[x] ** 2 for n in counts.values()))
    return {p: (*r, c[p[0]], c[p[1]], round(norm(p[0]), 9), round(norm(p[1]), 9), len({u for _, u, _ in rows if u is not None})) for p, r in out.items()}


@pytest.mark.parametrize("matrix,cells,share,sent", [(2_048, 1_000_000, 0.0, 1_000_000), (0, 40, 0.0, 3), (2_048, 40, 0.25, 3)])
def test_profiles_against_all_pairs(spark, monkeypatch, matrix, cells, share, sent):
    import random

    from marginalia.operators import pairing

    monkeypatch.setattr(pairing, "MATRIX", matrix)
    monkeypatch.setattr(pairing, "CELLS", cells)
    monkeypatch.setattr(K, "SENT", sent)
    g = random.Random(2)
    group = lambda u: None if u % 11 == 0 else u % 5
    rows = [(group(u), None if u % 7 == 0 and u < 8 else u, x) for u in range(1, 50) for x in sorted({g.choice("abcdefghé") for _ in range(g.randrange(6))})]
    d = spark.createDataFrame([(*r, 1) for r in rows], INC)
    got = {(r.a, r.b): (r.k, r.span, r.dot, r.ca, r.cb, round(r.na, 9), round(r.nb, 9), r.n) for r in K.profiles(d, share).collect()}
    assert got == brute_profiles(rows, share) and got


def test_together_in_pieces(monkeypatch):
    import numpy as np

    from marginalia.operators import pairing

    known, sizes, at = np.array([True, False, True, True]), np.array([3, 2, 0, 4]), np.array([0, 2, 4, 1, 2, 0, 1, 2, 4])
    x = np.zeros((4, 5))
    x[np.repeat(np.arange(4), sizes), at] = 1
    want = (x * known[:, None]).T @ x
    for within in (1, 7, 10, 1_000):
        monkeypatch.setattr(pairing, "WITHIN", within)
        parts = list(pairing.together(known, sizes, at, 5))
        assert [i for i, _, _ in parts] == [0, *(j for _, j, _ in parts[:-1])] and parts[-1][1] == 5
        assert all((out == want[i:j, i:]).all() for i, j, out in parts)


def test_spans_count_pairs_within_groups(spark):
    """The pairs of a group are summed where its units are: no join by unit makes rows of them, and none travels."""
    rows = [(u % 3, u, x, 1) for u in range(12) for x in ("ab" if u % 2 else "abc")]
    d = R.spans(spark.createDataFrame(rows, INC), wide=3, narrow=1)
    assert {(r.a, r.b): (r.k, r.span, r.kind) for r in d.collect()} == {("a", "b"): (12, 3, "global"), ("a", "c"): (6, 3, "global"), ("b", "c"): (6, 3, "global")}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "unit_seq" not in plan and "group_id" not in plan  # only sums are read


def test_items_of_lines_are_their_words(spark):
    """Repeated and null numbers, null and empty texts; the text is dealt once and no word travels."""
    d = spark.createDataFrame([(1, "a Bcd éF\n\nbcd, bcd x"), (1, "zz bcd\nno"), (2, None), (3, ""), (4, "12 ß"), (None, "null words\nof none"), (None, "null")], "doc_id long, text string")
    items = I.line_items(d)
    assert items._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {(r.group_id, r.unit_seq, r.item) for r in I.line_words(d).collect()}
    got = [(r.group_id, r.unit_seq, x) for r in items.collect() for x in r["items"]]
    assert len(got) == len(set(got)) and set(got) == want and len({r[:2] for r in got}) == items.count()


def brute_similar(rows, share, least):
    """Both cosines by their definitions, of whole vectors."""
    m, n, units, groups = Counter(x for _, _, x, _ in rows), len({u for _, u, _, _ in rows}), {}, {}
    for g, u, x, _ in rows:
        units.setdefault(u, set()).add(x)
        groups.setdefault(x, Counter())[g] += 1
    k = Counter(p for xs in units.values() for p in itertools.permutations(sorted(xs), 2))
    vec = {}
    for (a, b), c in k.items():
        if (w := math.log2((c / n) / ((m[a] / n) * (m[b] / n)))) > 0:
            vec.setdefault(a, {})[b] = w
    cos = lambda x, y: sum(x[d] * y[d] for d in x if d in y) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    out = {}
    for a, b in itertools.combinations(sorted(vec), 2):
        if vec[a].keys() & vec[b].keys():
            c, g = cos(vec[a], vec[b]), cos(groups[a], groups[b])
            if share * c + (1 - share) * g >= least:
                out[a, b] = (round(c, 9), round(g, 9))
    return out


def test_similar_against_whole_vectors(spark):
    """Pairs that no group holds together are there, with nothing from groups; profiles are summed by group, not joined by pair."""
    import random

    g = random.Random(3)
    rows = [(u // 5, u, x, 1) for u in range(60) for x in sorted({g.choice("abcdefgh" if u < 40 else "ghijk") for _ in range(g.randrange(1, 6))})]
    rows += [(20 + u // 2, 60 + u, x, 1) for u, xs in enumerate(["xq", "xq", "yq", "yq"]) for x in xs]
    d = R.similar(spark.createDataFrame(rows, INC), share=0.7, least=0.05)
    plan = d._jdf.queryExecution().executedPlan().toString()
    got = {(r.a, r.b): (round(r.cos_ppmi, 9), round(r.cos_groups, 9)) for r in d.collect()}
    assert got == brute_similar(rows, 0.7, 0.05) and any(y == 0 for _, y in got.values()) and any(y > 0 for _, y in got.values())
    assert "unit_seq" not in plan and "group_id" not in plan
