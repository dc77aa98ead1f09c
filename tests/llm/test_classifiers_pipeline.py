import random

import numpy as np
import pytest

import corpus_pipeline
from marginalia.llm import quality, registry, toxicity
from marginalia.llm.labelled import fold

DOC = "doc_id long, text string, lang string, source string, n_chars long, label int, score double"


def corpus(n=700, seed=2):
    rnd = random.Random(seed)
    syl = "an the ing on er ou ha re st tion nd ly".split()
    insults = ["idiot", "stupid", "loser", "moron"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice(syl) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(30, 90))]
        toxic, good = int(rnd.random() < 0.25), int(rnd.random() < 0.75)
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), rnd.choice(insults))
        text = ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8))
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 2 else " ".join([words[0]] * 80)
            toxic = 0
        docs.append((i, text, "en", "s", len(text), 3, 0.5))
        labels.append((i, good, toxic))
    return docs + [(5000, "", "en", "s", 0, 0, 0.0), (5001, None, "en", "s", 0, 0, 0.0), (None, "no id", "en", "s", 0, 0, 0.0), docs[4]], labels + [(None, 1, 0), (6000, None, None), (7000, 1, 0)]


@pytest.fixture(scope="module")
def tables(spark):
    d, l = corpus()
    return spark.createDataFrame(d, DOC).cache(), spark.createDataFrame(l, "doc_id long, quality int, toxic int").cache()


@pytest.mark.parametrize(("module", "label", "parts", "held"), [(quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)])
def test_held_out_accuracy(spark, tables, module, label, parts, held):
    docs, labels = tables
    out = module.score(docs, module.fit(docs, labels))
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held_rows = [r for r in rows if r.held_out and r.doc_id in truth]
    right = np.mean([r.predicted == truth[r.doc_id] for r in held_rows])
    assert len(held_rows) > 50 and right >= 0.95


def test_held_out_labels_change_nothing(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", (1 - labels.toxic)).withColumn("quality", (1 - labels.quality)).where(fold(labels.doc_id, 20) % 20 == 10)  # 10 mod 4 = 2 and 10 mod 5 = 0
    keep = labels.join(turned.select("doc_id"), "doc_id", "left_anti")
    other = keep.unionByName(turned.select(*keep.columns))
    for module in (quality, toxicity):
        a = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels)).collect()}
        b = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, other)).collect()}
        assert a == b


def test_without_labels(spark, tables):
    docs, labels = tables
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {1.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    empty = docs.where("doc_id < 0")
    assert quality.score(empty, quality.fit(docs, labels)).count() == 0


def test_kernel_is_the_subsequence_kernel():
    def plain(a, b):
        def weights(x):
            n, out = len(x), {}
            for i in range(n):
                for j in range(i + 1, n):
                    for k in range(j + 1, n):
                        if k - i < toxicity.SPAN:
                            key = (x[i], x[j], x[k])
                            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
            return out, sum(toxicity.DECAY ** (2 * (k - i - 2)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n) if k - i < toxicity.SPAN) ** 0.5

        (p, m), (q, n) = weights(a), weights(b)
        return sum(v * q.get(k, 0) for k, v in p.items()) / (m * n)

    words = ["idiot", "idioot", "stupid", "banana", "xyz"]
    k = toxicity.kernel(words, words)
    assert np.allclose(k, [[plain(a, b) for b in words] for a in words], atol=1e-5)
    assert k[0, 1] > 0.6 and k[0, 3] < 0.1


def test_gapped_insults(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(model)
    p = lambda t: float(model.probability(scorer.worst([t]))[0])
    assert min(p("the on i.d.i.o.t ing"), p("the stupiid on"), p("so s t u p i d on"), p("IDIOT!!")) > 0.5
    assert max(p("the onthan ing"), p(""), p("the " * 50)) < 0.5


def test_folded_weights_equal_landmark_sum():
    pos, neg = [("idiot", 1.0), ("stupid", 2.0), ("moron", 1.0)], [("thing", 1.0), ("station", 1.0), ("onthe", 1.0), ("inger", 1.0)]
    m = toxicity.machine(pos, neg)
    v = m.words(["idiot", "stupid", "moron", "thing", "station", "ab"])
    assert (v[:3] > 0.5).all() and (v[3:5] < -0.5).all() and v[5] == m.bias


def test_terms_are_of_unit_length():
    for t in ("", "a", "Hello, world!", "x " * 100, "É" * 10):
        n = float((quality.terms(t) ** 2).sum())
        assert abs(n - (1 if t else 0)) < 1e-4  # an empty text has no terms


def test_pipeline_stages_do_their_work(spark, tables, tmp_path):
    docs, labels = tables
    base = docs.drop("label", "score")
    copies = [(8000 + i, "first own words of a page that somebody wrote and others copied over and over again with love " + "end " * (i % 2), "en", f"s{i}", 90) for i in range(4)]
    sites = [(8100 + i, f"unlike words number {i} stand here {i * i}\nAll rights reserved by us\nand {i} more of them follow {i * 7}", "en", f"site{i}", 80) for i in range(12)]
    extra = spark.createDataFrame(copies + sites, "doc_id long, text string, lang string, source string, n_chars long")
    base.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        now = spark.read.parquet(f"{tmp_path}/out-{name}")
        if name != "packing":
            assert now.columns == base.columns
        seen.append((name, now))
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen}
    want = {r.doc_id for r in quality.score(base.unionByName(extra), quality.fit(base.unionByName(extra), labels)).where("predicted = 1").collect()}
    assert ids["quality_classifier"] == want
    assert ids["toxicity"] <= ids["quality_classifier"] and len(ids["toxicity"]) < len(ids["quality_classifier"])
    assert ids["line_dedup"] == ids["toxicity"]
    cleaned = dict(seen)["line_dedup"].where("doc_id >= 8100 and doc_id < 8200").collect()
    assert not cleaned or all("rights reserved" not in r.text for r in cleaned) or len(cleaned) < 10
    assert len(ids["ngram_jaccard_join"] & {8000, 8001, 8002, 8003}) <= 1
    assert ids["packing"] == ids["ngram_jaccard_join"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg({"length": "sum"}).first()[0] == dict(seen)["packing"].agg({"length": "sum"}).first()[0]


def test_registry_names():
    names = registry.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == []
    assert set(registry.oracle_sql()) <= set(names)
