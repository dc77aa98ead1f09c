"""Order nulls, rewiring and the decision over held-out predictions."""

import random
from collections import Counter

from marginalia.operators import information as N
from marginalia.operators import resample as M

INC = "group_id long, unit_seq long, item string, pos long"


def contents(rows):
    units = {}
    for r in rows:
        units.setdefault((r.group_id, r.unit_seq), []).append((r.pos, r.item))
    return units


def test_units_keep_their_content_and_change_places(spark):
    rng = random.Random(3)
    rows = [(g, 100 * g + u, x, p) for g in (1, 2) for u in range(12) for p, x in enumerate(rng.sample("abcdef", 3), 1)] + [(3, 300, "a", 1)]
    d = spark.createDataFrame(rows, INC)
    before, after = contents(d.collect()), contents(M.shuffled_units(d).collect())
    assert set(before) == set(after) and before != after
    for g in (1, 2, 3):
        of = lambda units: Counter(tuple(sorted(v)) for k, v in units.items() if k[0] == g)
        assert of(before) == of(after)
    assert sorted(map(tuple, M.shuffled_units(d.repartition(7)).collect())) == sorted(map(tuple, M.shuffled_units(d).collect()))
    both = contents(M.shuffled_units(M.shuffled_in_unit(d)).collect())
    items = lambda units: Counter((k[0], "".join(sorted(x for _, x in v))) for k, v in units.items())
    assert items(both) == items(before) and both != after
    assert M.shuffled_units(d.limit(0)).count() == 0


def test_rewiring_keeps_degrees_and_makes_a_simple_graph(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(300)})
    edges = [(a, b) for a, b in edges if a != b]
    d = spark.createDataFrame(edges + edges[:5], "src long, tgt long")  # repeated rows are one edge
    for rep, rows in _by_rep(M.rewired_edges(d, 0.5, 3, buckets=2).collect()).items():
        assert len(rows) == len(set(rows)) == len(edges) and all(a != b for a, b in rows), rep
        assert Counter(a for a, _ in rows) == Counter(a for a, _ in edges) and Counter(b for _, b in rows) == Counter(b for _, b in edges)
        assert 20 <= len(set(rows) - set(edges)) <= 150
    assert {(r.src, r.tgt) for r in M.rewired_edges(d, 0.0, 1).collect()} == set(edges)
    assert M.rewired_edges(d.limit(0), 0.5, 2).count() == 0


def _by_rep(rows):
    out = {}
    for r in rows:
        out.setdefault(r.rep, []).append((r.src, r.tgt))
    return out


BOARD = {"gain": 0.2, "half_width": 0.1, "perplexity": 20.0, "base_perplexity": 24.0, "mrr": 0.3, "base_mrr": 0.2, "degree_mrr": 0.25, "hits10": 0.5, "base_hits10": 0.4}


def decide(spark, nulls=(0.2, 0.25, 0.1), regimes=((0.1, 0.3, 0.2),) * 3, **change):
    b = BOARD | change
    board = spark.createDataFrame([tuple(b.values())], ", ".join(f"{k} double" for k in b))
    n = spark.createDataFrame([(float(x),) for x in nulls], "mrr double")
    r = spark.createDataFrame(list(regimes), "gain double, mrr double, base_mrr double")
    got = N.decision(board, n, r, 0.05, 0.02).collect()
    assert len(got) == 1
    return got[0].verdict, "".join(str(int(got[0][c])) for c in ("c1", "c2", "c3", "c4", "c5"))


def test_decision_by_each_criterion(spark):
    assert decide(spark) == ("GENUINE_STRUCTURE", "11111")
    assert decide(spark, half_width=0.2) == ("NON_PREDICTIVE", "01111")
    assert decide(spark, nulls=(0.1, 0.35)) == ("FREQUENCY_SHAPED", "10111")
    assert decide(spark, nulls=()) == ("FREQUENCY_SHAPED", "10111")
    assert decide(spark, degree_mrr=0.3) == ("FREQUENCY_SHAPED", "11011")
    assert decide(spark, base_hits10=0.49) == ("FREQUENCY_SHAPED", "11101")
    assert decide(spark, regimes=((0.1, 0.3, 0.2), (0.1, 0.1, 0.2), (-0.1, 0.3, 0.2))) == ("FREQUENCY_SHAPED", "11110")


def test_the_null_value_of_rank_is_the_largest_of_few_and_not_of_many(spark):
    many = [i / 1000 for i in range(200)]  # the place 195 of 0 to 199
    assert decide(spark, nulls=[*many[:195], 0.29, 0.31, 0.31, 0.31, 0.31]) == ("GENUINE_STRUCTURE", "11111")
    assert decide(spark, nulls=[*many[:194], 0.29, 0.31, 0.31, 0.31, 0.31, 0.31]) == ("FREQUENCY_SHAPED", "10111")
