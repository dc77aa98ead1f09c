"""Byte-level BPE by speculation and verification (operator 6).

For each pre-token the vocabulary's greedy longest match *proposes* tokens.  A
sequence of tokens is the BPE encoding exactly if no merge rule crosses any
boundary between neighbours, so one vectorised check of all distinct adjacent
pairs *verifies* the proposals of a whole batch; only where a pair fails are
bytes merged exactly.  Encoded words are remembered up to a bound.

Contract: ids equal those of the ``tokenizers`` library with
``add_special_tokens=False``; an added token's own string in a text becomes its
id, as there.  A null text counts as empty, and an empty text has no tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: White space of the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the split of byte-level BPE into pre-tokens, with \s spelled out.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Letters of the blocks up to U+024F, for texts of nothing beyond (the fast path).
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_LATIN_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[{_LATIN_DIGITS}]+| ?[^{WHITE}{_LATIN}{_LATIN_DIGITS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Mark of added tokens among pre-tokens: no pre-token holds both a letter and a digit.
ADDED = "a1"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words:
    """Encoded words by a 64-bit hash: an open-addressing table of arrays, asked and filled for whole batches at once."""

    def __init__(self, bits: int = 21):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.start, self.length, self.pool, self.n, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4"), 0, 0
        self.limit = (1 << bits) // 2

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words; -1 for unknown ones.  No hash is 0."""
        out, left, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), h & self.mask
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """New words; no hash twice, none known."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        fresh = np.frombuffer(b"".join(ids), "<u4")
        while len(self.start) < self.n + len(ids):
            self.start, self.length = (np.concatenate([x, np.empty(max(1 << 16, len(x)), np.int64)]) for x in (self.start, self.length))
        while len(self.pool) < self.used + len(fresh):
            self.pool = np.concatenate([self.pool, np.empty(max(1 << 18, len(self.pool)), "<u4")])
        own = slice(self.n, self.n + len(ids))
        self.start[own], self.length[own] = self.used + np.cumsum(size) - size, size
        self.pool[self.used : self.used + len(fresh)] = fresh
        number, slot = np.arange(self.n, self.n + len(ids)), h & self.mask
        self.n, self.used = self.n + len(ids), self.used + len(fresh)
        while len(h):
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.at[slot[won]] = h[won], number[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, number, slot = h[rest], number[rest], (slot[rest] + np.uint64(1)) & self.mask

    def ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and where each word's end."""
        n = self.length[which]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.start[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


#: Kinds of characters up to U+024F: letter, number, other, space, other white space; and what parts two texts.
LETTER, NUMBER, OTHER, SPACE, BLANK, BETWEEN = range(6)
PART = "\U0010ffff"
_TOP = 0x250


def _kinds() -> np.ndarray:
    out = np.full(_TOP + 1, OTHER, np.int8)
    for kind, chars in ((LETTER, _LATIN), (NUMBER, _LATIN_DIGITS), (BLANK, WHITE)):
        out[[ord(c) for c in map(chr, range(_TOP)) if re.match(f"[{chars}]", c)]] = kind
    out[32], out[_TOP] = SPACE, BETWEEN
    return out


class Cutter:
    """Pre-tokens of texts of characters up to U+024F without apostrophes, found and hashed by array operations.

    A token starts where the kind of character changes, save that one space goes with what follows it; the last
    of several white-space characters before a word stands apart from the others.  Hashes are polynomials over
    random numbers of the characters, mixed with the length: 64 bits, so two words of one hash are not to be met.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.kind = _kinds()
        self.number = C.mix64(np.arange(_TOP + 1, dtype=np.uint64) + np.uint64(77))
        self.power = self.inverse = np.empty(0, np.uint64)

    def cut(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each token, and how many tokens come before each part's end."""
        cp = np.minimum(np.frombuffer(joined.encode("utf-32-le"), "<u4"), _TOP)
        kind = self.kind[cp]
        n = len(kind)
        if n > len(self.power):
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.full(n, self.BASE, np.uint64))
                self.inverse = np.cumprod(np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64))
        word, blank = kind <= OTHER, (kind == SPACE) | (kind == BLANK)
        start = np.empty(n, bool)
        start[0:1] = True
        before, here = kind[:-1], kind[1:]
        start[1:] = ((before != here) & (before != SPACE) & word[1:]) | (blank[1:] & ~blank[:-1]) | (here == BETWEEN) | (before == BETWEEN)
        start[:-1] |= blank[:-1] & word[1:]
        first = np.flatnonzero(start)
        end = np.append(first[1:], n)
        own = kind[first] != BETWEEN
        counts = np.append(np.cumsum(own)[~own], own.sum())
        first, end = first[own], end[own]
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.number[cp] * self.power[:n])))
            h = (total[end] - total[first]) * self.inverse[first]
            return first, end, C.mix64(h ^ ((end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) | np.uint64(1), counts


class Encoder:
    """One vocabulary, its merge ranks and the words encoded so far."""

    cache_limit = 200_000

    def __init__(self, spec: bytes):
        doc = json.loads(spec)
        model, letters = doc["model"], byte_letters()
        if model["type"] != "BPE" or (doc.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or doc.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without a normalizer is expected")
        self.added = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.added}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.decimal = [str(i).encode() for i in range(size)]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.packed = [int(i).to_bytes(4, "little") for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.rank: dict[tuple[int, int], int] = {}
        self.whole: list[int] = []
        parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, whole = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.rank[pair] = r
            self.whole.append(whole)
            parts.setdefault(whole, (r, *pair))
        self._spines(parts, size)
        keys = np.fromiter((a * size + b for a, b in self.rank), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        self.size = size
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.seen_pairs, self.seen_fit = np.array([-1]), np.array([True])
        self.mended: dict[tuple[int, int], list[int]] = {}
        self.marked = {ADDED + t: self.packed[i] for t, i in self.added.items()}
        self.known: dict[str, bytes] = dict(self.marked)
        self.counts = {"proposed": 0, "merged": 0}
        self._fast, self._full = re.compile(_LATIN_SPLIT), regex.compile(SPLIT)
        self._beyond = re.compile("[^\x00-\u024f]")
        self._slow = re.compile("[^\x00-\u024f]|'")
        self.cutter, self.table = Cutter(), Words()
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _spines(self, parts: dict, size: int) -> None:
        """The symbols at each token's right and left end while it is being merged.

        Row t of ``right``: t, its last part, that part's last part, and so on;
        ``right_until``: the rank of the merge that takes the symbol up (none for t itself).
        """
        never = np.iinfo(np.int32).max

        def spine(t: int, side: int) -> list[tuple[int, int]]:
            out = [(t, never)]
            while t in parts:
                r, *ab = parts[t]
                t = ab[side]
                out.append((t, r))
            return out
        both = [[spine(t, side) for t in range(size)] for side in (1, 0)]
        for name, spines in zip(("right", "left"), both, strict=True):
            deep = max(map(len, spines))
            symbols, until = np.full((size, deep), -1, np.int32), np.full((size, deep), -1, np.int32)
            for t, s in enumerate(spines):
                symbols[t, : len(s)], until[t, : len(s)] = zip(*s, strict=True)
            setattr(self, name, symbols)
            setattr(self, f"{name}_until", until)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a[i], b[i] side by side stay two tokens: no merge crosses their boundary.

        A merge of the symbols x | y at the boundary would happen if its rank comes
        before x is taken up leftwards (equal ranks: the left one goes first) and not
        after y is taken up rightwards.
        """
        ok, never = np.ones(len(a), bool), 1 << 40
        for i in range(self.right.shape[1]):
            x, xu = self.right[a, i], self.right_until[a, i]
            if not (x >= 0).any():
                break
            for j in range(self.left.shape[1]):
                y, yu = self.left[b, j], self.left_until[b, j]
                here = np.flatnonzero(ok & (x >= 0) & (y >= 0))
                if not len(here):
                    if not (y >= 0).any():
                        break
                    continue
                key = x[here].astype(np.int64) * self.size + y[here]
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], never)
                ok[here[(rank < xu[here]) & (rank <= yu[here]) & (rank < never)]] = False
        return ok

    def propose(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words, one after another, and the word of each token.

        Every byte is a token, so the matches leave no gap; what stands between two words is in no token.
        """
        joined = "\uffff".join([b.decode("latin-1") for b in raws])
        ids = np.fromiter(map(itemgetter(1), self.automaton.iter_long(joined)), np.int64)
        word_ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        return ids, np.searchsorted(word_ends, np.cumsum(self.length[ids]))

    def broken(self, ids: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places i where tokens i, i+1 of one word don't fit; each distinct pair is checked once."""
        at = np.flatnonzero(word[1:] == word[:-1])
        keys, back = np.unique(ids[at] * self.size + ids[at + 1], return_inverse=True)
        where = np.minimum(np.searchsorted(self.seen_pairs, keys), len(self.seen_pairs) - 1)
        known = self.seen_pairs[where] == keys
        fit = np.where(known, self.seen_fit[where], True)
        if not known.all():
            new = keys[~known]
            fit[~known] = self.compatible(new // self.size, new % self.size)
            if len(self.seen_pairs) > 8 * self.cache_limit:
                self.seen_pairs, self.seen_fit = np.array([-1]), np.array([True])
            all_keys = np.concatenate([self.seen_pairs, new])
            order = np.argsort(all_keys, kind="stable")
            self.seen_pairs, self.seen_fit = all_keys[order], np.concatenate([self.seen_fit, fit[~known]])[order]
        return at[~fit[back]]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest-ranked pair first, the leftmost among equals."""
        toks = list(map(self.byte_ids.__getitem__, word))
        if len(toks) > 48:
            return self._merge_long(toks)
        get, whole, none = self.rank.get, self.whole, 1 << 62
        ranks = [get(p, none) for p in zip(toks, toks[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            toks[i] = t = whole[r]
            del toks[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((t, toks[i + 1]), none)
            if i:
                ranks[i - 1] = get((toks[i - 1], t), none)
        return toks

    def _merge_long(self, toks: list[int]) -> list[int]:
        """The same by a linked list and a heap: n log n for words of any length."""
        n, get = len(toks), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, toks[i], toks[i + 1]) for i in range(n - 1) if (r := get((toks[i], toks[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or toks[i] != a or toks[j] != b:
                continue
            toks[i], alive[j] = self.whole[r], False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((toks[i], toks[k]))) is not None:
                    heapq.heappush(heap, (r, i, toks[i], toks[k]))
            if (h := before[i]) >= 0 and (r := get((toks[h], toks[i]))) is not None:
                heapq.heappush(heap, (r, h, toks[h], toks[i]))
        return [t for t, x in zip(toks, alive, strict=True) if x]

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens: propose, check all pairs, and mend or merge those that fail.

        A failing pair is first replaced by the exact encoding of its two tokens' bytes, which many
        words share, and the word is checked again; what still fails is merged from its bytes.
        """
        out: dict[str, bytes] = {}
        order = list(words)
        raws = [w.encode() for w in order]
        self.counts["proposed"] += len(order)
        ids, word = self.propose(raws)
        names = np.arange(len(order))
        for _ in range(4):
            bad = self.broken(ids, word)
            start = np.searchsorted(word, np.arange(len(names)))
            end = np.append(start[1:], len(ids))
            fails = np.zeros(len(names), bool)
            fails[word[bad]] = True
            packed, good = ids.astype("<u4").tobytes(), np.flatnonzero(~fails)
            out.update((order[n], packed[4 * a : 4 * b]) for n, a, b in zip(names[good].tolist(), start[good].tolist(), end[good].tolist(), strict=True))
            if not len(bad):
                return out
            failing, first = np.unique(word[bad], return_index=True)
            flat, fixed, sizes = ids.tolist(), [], []
            for a, b, i in zip(start[failing].tolist(), end[failing].tolist(), bad[first].tolist(), strict=True):
                pair = (flat[i], flat[i + 1])
                mended = self.mended.get(pair)
                if mended is None:
                    if len(self.mended) > self.cache_limit:
                        self.mended.clear()
                    mended = self.mended[pair] = self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])
                fixed += flat[a:i]
                fixed += mended
                fixed += flat[i + 2 : b]
                sizes.append(i - a + len(mended) + b - i - 2)
            ids, word, names = np.array(fixed, np.int64), np.repeat(np.arange(len(sizes)), sizes), names[failing]
        for n in names.tolist():
            self.counts["merged"] += 1
            out[order[n]] = b"".join(map(self.packed.__getitem__, self.merge(raws[n])))
        return out

    def split(self, text: str) -> list[str]:
        """Pre-tokens."""
        return self._full.findall(text) if self._beyond.search(text) else self._fast.findall(text)

    def keys(self, text: str) -> list[str]:
        """Pre-tokens, and marked added tokens between them."""
        if self._added is None or not self._added.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self._added.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(ADDED + m[0])
            at = m.end()
        return out + self.split(text[at:])

    def encode_batch(self, texts: list[str], block: int = 1 << 19):
        """Packed little-endian unsigned 32-bit ids of each text, in turn."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= block):
                chars += len(texts[end])
                end += 1
            part = texts[at:end]
            slow = [bool(self._slow.search(t)) or (self._added is not None and self._added.search(t) is not None) for t in part]
            fast = iter(self._encode_fast([t for t, x in zip(part, slow, strict=True) if not x]))
            rest = iter(self._encode_slow([t for t, x in zip(part, slow, strict=True) if x]))
            yield from (next(rest if x else fast) for x in slow)
            at = end

    def _encode_fast(self, texts: list[str]) -> list[bytes]:
        """By arrays: cut, hash, look up; only words not met before become strings."""
        if not texts:
            return []
        joined = PART.join(texts)
        first, end, h, counts = self.cutter.cut(joined)
        which = self.table.find(h)
        lost = np.flatnonzero(which < 0)
        if len(lost):
            new, place = np.unique(h[lost], return_index=True)
            if self.table.n + len(new) > self.table.limit:  # begin anew; this block's words are all learnt again
                self.table = Words(int(self.table.mask).bit_length())
                lost = np.arange(len(h))
                new, place = np.unique(h, return_index=True)
            words = [joined[a:b] for a, b in zip(first[lost][place].tolist(), end[lost][place].tolist(), strict=True)]
            ids = self.encode_words(set(words))
            self.table.add(new, [ids[w] for w in words])
            which[lost] = self.table.find(h[lost])
        ids, ends = self.table.ids(which)
        stops = np.concatenate(([0], ends))[counts].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _encode_slow(self, texts: list[str]) -> list[bytes]:
        """By the pattern itself: texts of any characters, with apostrophes or added tokens."""
        if len(self.known) > self.cache_limit:
            self.known = dict(self.marked)
        keys = [self.keys(t) for t in texts]
        new = set().union(*keys) - self.known.keys()
        if new:
            self.known.update(self.encode_words(new))
        return [b"".join(map(self.known.__getitem__, ks)) for ks in keys]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; what is no UTF-8 becomes U+FFFD, as the library's decode does."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: bytes) -> Encoder:
    """One encoder a process and vocabulary."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def spec_of(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver and broadcast (its size is fixed: some 2 MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


OUT = "doc_id long, ids binary, n_tokens long"


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids as packed little-endian uint32, n_tokens) of every whole text.

    Null text: no ids.  Repeated rows stay repeated; an empty table gives an empty one.
    """
    spec = spec_of(docs.sparkSession, tokenizer_path)

    def run(batches):
        enc = encoder(spec.value)
        for batch in batches:
            out = list(enc.encode_batch(C.texts_of(batch.column("text"))))
            yield pa.record_batch([batch.column("doc_id"), C.binary_column(out), pa.array([len(x) // 4 for x in out], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return C.map_arrow(C.docs_of(docs), run, OUT)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode, decode the ids again, and give digests of both: the round trip over whole texts."""
    spec = spec_of(docs.sparkSession, tokenizer_path)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoder(spec.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for packed in enc.encode_batch(C.texts_of(batch.column("text"))):
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                a.append(sha(b",".join(map(enc.decimal.__getitem__, ids))))
                b.append(sha(enc.decode(ids)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return C.map_arrow(C.docs_of(docs), run, ddl)


def default_path() -> str:
    """The vocabulary that the production queries name; any other is a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"), default_path())
