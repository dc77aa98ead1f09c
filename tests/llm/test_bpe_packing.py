import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bpe, packing

ODD = ["", " ", "  ", "a", "\n\n a", "It's 'S 'll ''re", "<|endoftext|>x <|endoftext|>  \n y'll ", "a" * 400, "日本語 ١٢٣ ½² \x1c\x85\xa0q", "🎉🎉 ok", "ab" * 300, "a \nb", "a\n b", "x\t\ty", "ÉCOLE ñandú über ß", "\x00a1<|endoftext|>"]
ROWS = [(i, t) for i, t in enumerate([*ODD, None, ODD[3]])] + [(0, ""), (None, "null id")]
DDL = "doc_id long, text string, lang string, source string, n_tokens int, ids string"


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(bpe.default_path(), "rb").read())


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", "s", 7, "clash") for i, t in rows], DDL)


def test_ids_equal_the_library(encoder, reference):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("aeiou thsn'.,!?\n\t0123éüñßABCあ中²\xa0_-*") for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    for t, got in zip(texts, encoder.encode_batch(texts), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == reference.encode(t, add_special_tokens=False).ids, t
        assert encoder.decode(ids).decode() == reference.decode(ids, skip_special_tokens=False)


def test_pair_check_agrees_with_merging(encoder):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 20_000, 4000), rng.integers(0, 20_000, 4000)
    ok = encoder.compatible(a, b)
    for x, y, fit in zip(a.tolist(), b.tolist(), ok.tolist(), strict=True):
        assert fit == (encoder.merge(encoder.bytes_of[x] + encoder.bytes_of[y]) == [x, y])


def test_long_words_merge_alike(encoder):
    word = b"thon" * 40
    toks = [encoder.byte_ids[c] for c in word]
    assert encoder._merge_long(list(toks)) == encoder.merge(word)


def test_forgetting_words_changes_nothing(reference):
    small = bpe.Encoder(open(bpe.default_path(), "rb").read())
    small.cache_limit, small.table.limit = 5, 20
    texts = [f"word{i} thonan{i % 7} zz" for i in range(60)]
    for t, got in zip(texts, small.encode_batch(texts, block=40), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids


def test_digests_of_a_table(spark, reference):
    got = bpe.digests(docs(spark), bpe.default_path()).collect()
    assert len(got) == len(ROWS)
    want = defaultdict(list)
    for i, t in ROWS:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want[i].append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((reference.decode(ids, skip_special_tokens=False)).encode()).hexdigest()))
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id]


@pytest.mark.parametrize("size", [8, 64, 2048])
def test_packing_holds_every_id_once(spark, reference, size):
    rows = packing.pack(docs(spark), bpe.default_path(), size=size).collect()
    tokens = {}
    for i, t in ROWS:
        tokens.setdefault(i, []).append(reference.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert sum(r.length for r in rows) == sum(len(x) for v in tokens.values() for x in v)
    for i, variants in tokens.items():
        if len(variants) == 1:
            ids = np.array(variants[0], "<u4")
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size and at & (at - 1) == 0  # full, or a power of two: nothing to pad


def test_empty_table(spark):
    assert packing.pack(docs(spark, []), bpe.default_path()).count() == 0
    assert bpe.digests(docs(spark, []), bpe.default_path()).count() == 0


def test_hilbert_neighbours_are_adjacent_cells():
    bits, dims = 3, 3
    n = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(n)] * dims, indexing="ij"), -1).reshape(-1, dims)
    order = np.argsort(packing.hilbert((cells + 0.5) / n, bits))
    steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
    assert len(set(packing.hilbert((cells + 0.5) / n, bits).tolist())) == n**dims and (steps == 1).all()
