import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import common as C
from marginalia.llm import components as G
from marginalia.llm import jaccard as J

DDL = "doc_id long, text string, lang string, source string, n_chars long, component_id long, node long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, 6) for i, t in rows], DDL)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 5, 8, 12, 40, 200]))] for _ in range(14)]
    rows = []
    for i in range(n):
        t = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            k = rnd.randrange(len(t))
            t[k : k + 1] = rnd.choice([[], [rnd.choice(words)], [t[k], rnd.choice(words)]])
            if not t:
                t = ["x"]
        rows.append((i * 3 + 1, rnd.choice([" ", "\n", "\t "]).join(t).upper() if rnd.random() < 0.2 else " ".join(t)))
    return rows + [(900, ""), (901, None), (902, " \n\t"), (903, "É \xa0 x"), (904, "é \xa0 x"), (0, rows[3][1])]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_components_equal_brute_force(spark, seed, n, percent):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(frame(spark, rows), n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(J, "BLOCK_MAPS", 4)
    rows = corpus(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(frame(spark, rows)).collect()}
    assert got == brute(rows, 4, 85)


def test_unrelated_sets_stay_apart(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(str(rnd.random()) for _ in range(n))) for i, n in enumerate([600] * 3000 + [200] * 3000)]
    found = J.clusters(frame(spark, rows), 5, 80).groupBy("component").count().collect()
    assert max([r["count"] for r in found], default=0) <= 5 and sum(r["count"] for r in found) < 100


def test_leaders_settle_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(J, "BLOCK_MAPS", 8)
    rnd = random.Random(11)
    rows = []
    for base in range(3):  # a tight group, a looser one, and one whose members link by chains only
        words = [str(rnd.random()) for _ in range(120)]
        for i in range(60):
            w = list(words)
            for _ in range((1, 3, 0)[base]):
                w[rnd.randrange(len(w))] = str(rnd.random())
            rows.append((100 * base + i, " ".join(w if base < 2 else words[i : i + 60] + [f"x{j}" for j in range(i)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(frame(spark, rows)).collect()}
    assert got == brute(rows, 4, 85)


def test_linked_sets_share_a_signature():
    rnd, bands, h = random.Random(1), J.Bands(85), C.Words()
    for turn in range(300):
        usual = np.random.default_rng(turn).random(1 << 10) < (0.3, 0.7, 0.95)[turn % 3]
        base = [str(rnd.random()) for _ in range(rnd.randint(1, 300))]
        other = list(base)
        for _ in range(rnd.randint(0, max(1, len(base) // 40))):
            other[rnd.randrange(len(other))] = str(rnd.random())
        a, b = J.gram_sets([" ".join(base), " ".join(other[: len(other) - rnd.randint(0, len(other) // 20)])], 4, h)
        k = len(np.intersect1d(a, b))
        if len(b) and 100 * k >= 85 * (len(a) + len(b) - k):
            for common in (None, usual):  # whatever counts as usual, even nearly all
                sa, na = J.signatures([a], np.array([J.class_of(a)]), bands, common)
                sb, nb = J.signatures([b], np.array([J.class_of(b)]), bands, common)
                assert J.class_of(a) == J.class_of(b) or set(sa.tolist()) & set(sb.tolist())
            top = max(bands.of(len(a)), bands.of(len(b)))  # the band where the two meet
            x, y = (np.frombuffer(J.bitmap(g, bands.top(top)), np.uint64) for g in (a, b))
            assert int(np.bitwise_count(x ^ y).sum()) * 185 <= 15 * (len(a) + len(b))


def test_intersections_by_both_ways():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for common in (0, 3, 10**6):
        assert (J.intersections(sets, sets, width=64, common=common) == want).all()


def test_packed_grams_come_back():
    g = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 50).astype(np.uint64))
    assert (J._unpacked(J._packed(g)) == g).all()


def test_filtered_sets_are_all_that_a_join_keeps(spark):
    sets = spark.range(20_000).select(F.xxhash64("id").alias("node"), F.col("id").cast("string").alias("payload"))
    nodes = spark.range(0, 20_000, 100).select(F.xxhash64("id").alias("node"))
    kept = J.among(sets, nodes)
    assert kept.join(nodes, "node").count() == 200
    assert kept.count() < 400
    assert J.among(sets, nodes.limit(0)).count() == 0 and J.among(sets.limit(0), nodes).count() == 0


def test_star_rounds_equal_one_task(spark):
    rnd = random.Random(7)
    e = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    links = spark.createDataFrame(e, "u long, v long")
    small = {tuple(r) for r in G.components(links).collect()}
    large = {tuple(r) for r in G.components(links, one_task=10).collect()}
    assert small == large and (360, 300) in small


def test_stage_keeps_one_of_each(spark):
    rows = corpus(5) + [(None, "no id at all here")]
    kept = J.one_of_each(frame(spark, rows), 5, 80)
    comp = brute([r for r in rows if r[0] is not None], 5, 80)
    assert kept.columns == [c.split()[0] for c in DDL.split(", ")]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in comp.items() if i == c)
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(spark):
    assert J.classes(frame(spark, [])).count() == 0


def test_word_hashes_tell_words_apart():
    texts = ["a b\tc\x0bd", "", " \n ", "AB ab aB", "x" * 5000, "é \xa0 É", "ab ba abab a a"]
    h, n = C.Words().of(texts)
    words = [t.encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(h) == len(flat) and len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(h)) for j in range(i))
