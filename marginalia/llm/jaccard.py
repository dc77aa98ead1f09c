"""N-gram Jaccard join by PartEnum signatures, and its components (operator 10).

Two texts link when the Jaccard similarity of their sets of word n-grams reaches a
bound.  Equal sets are one *class*, however many documents share it.

Signatures (exact: no link is lost).  Sizes fall into bands; sets that link lie in
the same band or neighbouring ones, and at most k grams belong to only one of them,
with k fixed by the band.  The gram domain is dealt into n1 groups of n2 partitions.
At most k partitions can differ, so in all but k / (k2 + 1) groups at most k2 do, and
there two linked sets agree on n2 - k2 partitions: each subset of that size is one
signature, a hash of the grams it holds.  Each set signs in its own band and the
next, so linked sets share a signature.

Weak signatures, which hold no gram or only grams that many texts share, would make
candidates of sets that have nothing in common.  So there are w groups more than that:
two linked sets share signatures in w + 1 groups at least, and if one of them has no
more than w groups with a weak one, a strong one is among these.  A set with more weak
groups signs again by another dealing of the domain, as every other such set does; only
after ``DEALS`` dealings does it give its weak signatures too.

Verification.  Sharing a signature only makes two sets *candidates*.  Connected
candidates of one band form a cluster.  The sets of a cluster beyond one block first
meet its leader, block by block: what links with it, and is nearer to it than
anything that doesn't can bear, is done, so a large group of near copies costs one
comparison a set.  The pairs of what is left are compared twice, each time in pairs of
blocks of bounded size that give back a spanning forest, never all pairs: first by
small parity bitmaps (the bits that differ are a lower bound of the grams
that differ, so no link is lost), which breaks clusters up; then, within what is left,
by the intersections of the sets themselves.  Grams travel as 48 bits of their hash,
which tell the grams of two documents apart.

Empty and null texts have no grams and link with nothing; a text of fewer words than
n is one gram.  Repeated rows and equal texts fall into one class.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components, contract, least_of

SIZE, PERCENT = 4, 85
#: Grams that a signature should hold on average, and dealings of a set whose groups turn out weak.
CONTENT, DEALS = 4.5, 6
#: The fit of usual grams: one text in SAMPLED, some SAMPLE texts at most; this share of them must hold a gram (but
#: USUAL_LEAST texts). Which grams count as usual changes the number of candidates only, never a link.
SAMPLED, SAMPLE, USUAL, USUAL_LEAST, USUAL_BITS = 16, 20_000, 0.002, 4, 22
#: Grams of all classes of a block, and classes of a block, at most on average.
BLOCK_GRAMS, BLOCK_CLASSES = 600_000, 768
#: The same of blocks of bitmaps, by bytes.
BLOCK_BYTES, BLOCK_MAPS = 8_000_000, 8192
#: Rounds of leaders that clusters beyond one block go through, and places where a large cluster's nodes meet its size.
LEADERS, SALTS = 3, 16
#: Grams worked on at once.
AT_ONCE = 150_000


def gram_sets(texts: list[str], n: int, words: C.Words) -> list[np.ndarray]:
    """Sorted distinct 48-bit hashes of each text's word n-grams; A-Z in lower case, words split at ASCII space."""
    h, lens = words.of(texts)
    ends = np.cumsum(lens)
    whole = _windows(h, n) if len(h) >= n else np.empty(0, np.uint64)
    out = []
    for size, end in zip(lens.tolist(), ends.tolist(), strict=True):
        g = whole[end - size : end - n + 1] if size >= n else _windows(h[end - size : end], size) if size else h[:0]
        g = np.sort(g)
        out.append(g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) else g)
    return out


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words."""
    top = len(h) - n + 1
    with np.errstate(over="ignore"):
        out = h[:top]
        for i in range(1, n):
            out = C.mix64(out) + h[i : top + i]
        return C.mix64(out + np.uint64(n)) >> np.uint64(16)


def blocks_of(batches, column: str = "text"):
    """(batch, first row, texts) in blocks of bounded length."""
    for batch in batches:
        texts = C.texts_of(batch.column(column))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= 6 * AT_ONCE):
                size += len(texts[end])
                end += 1
            yield batch, at, texts[at:end]
            at = end


def class_of(g: np.ndarray) -> int:
    """A 63-bit name of a set of grams; -1 for the empty set."""
    if not len(g):
        return -1
    with np.errstate(over="ignore"):
        return int(C.mix64(np.array([(g * np.uint64(0x9E3779B97F4A7C15) ^ (g >> np.uint64(29))).sum() + np.uint64(len(g))]))[0] >> np.uint64(1))


class Plan(NamedTuple):
    """How the sets of a band sign: groups, partitions of a group, partitions left out of a signature, weak groups."""

    groups: int
    parts: int
    left_out: int
    weak: int


class Bands:
    """Size bands: [edge[b], edge[b+1]); sets that link differ by one band at most."""

    def __init__(self, percent: int):
        self.percent, self.edges, self.plans = percent, [1], {}

    def of(self, n: int) -> int:
        while self.edges[-1] <= n:  # the largest size that can link with the band's least one, and one more
            self.edges.append(self.edges[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def differing(self, b: int) -> int:
        """Most grams that can belong to one only of two linked sets of which the larger is in band b.

        Of sizes s and t the intersection is at least p (s + t) / (100 + p), so at most
        (100 - p) (s + t) / (100 + p) grams differ.
        """
        return (100 - self.percent) * 2 * self.top(b) // (100 + self.percent)

    def top(self, b: int) -> int:
        """The largest size of band b."""
        while len(self.edges) <= b + 1:
            self.of(self.edges[-1])
        return self.edges[b + 1] - 1

    def plan(self, b: int) -> Plan:
        """The cheapest plan whose signatures hold enough grams; ``weak`` is 1.5 deviations above what chance leaves empty."""
        if b not in self.plans:
            k, size, found = self.differing(b), self.edges[b], []
            for left_out in (1, 2, 3):
                for parts in range(left_out + 1, 9):
                    subsets = comb(parts, left_out)
                    for weak in range(3 + k // 8):
                        groups = k // (left_out + 1) + 1 + weak  # more groups hold fewer grams each, so more of them are weak
                        empty = min(1.0, subsets * (1 - (parts - left_out) / (groups * parts)) ** size)
                        if weak >= groups * empty + 1.5 * (groups * empty * (1 - empty)) ** 0.5 - 0.1:
                            break
                    content = size * (parts - left_out) / (groups * parts)
                    found.append((content < min(CONTENT, 0.6 * size), empty > 0.3, groups * subsets, Plan(groups, parts, left_out, weak)))
            self.plans[b] = min(found)[-1]
        return self.plans[b]


def node_of(names: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """One name for a class in a band."""
    with np.errstate(over="ignore"):
        return (C.mix64(names.astype(np.int64).view(np.uint64) + (bands.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).view(np.int64)


def bitmap(g: np.ndarray, top: int) -> bytes:
    """Parity bitmap of a set; its length follows the largest size ``top`` of the band."""
    bits = max(64, 1 << (2 * top - 1).bit_length())
    return np.packbits(np.bincount((C.mix64(g) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def signatures(sets: list[np.ndarray], names: np.ndarray, bands: Bands, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets, each for its own band and the one above, and the nodes they belong to.

    Linked sets of one band meet there; those of neighbouring bands meet in the upper one.
    """
    size = np.array([len(s) for s in sets])
    g = np.concatenate(sets)
    usual = np.zeros(len(g), bool) if common is None else common[(g & np.uint64(len(common) - 1)).astype(np.int64)]
    own = np.array([bands.of(n) for n in size.tolist()])
    sigs, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for band in (own, own + 1):
        node = node_of(names, band)
        plans = [bands.plan(b) if bands.differing(b) else None for b in band.tolist()]  # where nothing may differ only equal sets link, and they are one class
        for parts, left_out in sorted({(p.parts, p.left_out) for p in plans if p}):
            todo = np.array([p is not None and (p.parts, p.left_out) == (parts, left_out) for p in plans])
            for deal in range(DEALS):
                if not todo.any():
                    break
                at = np.flatnonzero(todo)
                grams = np.repeat(todo, size)
                again = _deal(g[grams], usual[grams], size[at], band[at], node[at], [plans[i] for i in at.tolist()], deal, sigs, nodes)
                todo[at] = again
    return np.concatenate(sigs), np.concatenate(nodes)


def _deal(g, usual, size, band, node, plans: list[Plan], deal: int, sigs: list, nodes: list) -> np.ndarray:
    """Adds the signatures of one dealing of sets whose plans leave out as many of as many partitions.

    Returns which sets have too many weak groups, and so need another dealing.
    """
    parts, left_out = plans[0].parts, plans[0].left_out
    n1, weak = np.array([p.groups for p in plans]), np.array([p.weak for p in plans])
    base = np.cumsum(n1 * parts) - n1 * parts
    of = np.repeat(np.arange(len(size)), size)
    part = (C.mix64(g + np.uint64(deal)) % (n1 * parts)[of].astype(np.uint64)).astype(np.int64) + base[of] if deal else (g % (n1 * parts)[of].astype(np.uint64)).astype(np.int64) + base[of]
    mixed, total = C.mix64(g), int((n1 * parts).sum())
    low, high = (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), (mixed >> np.uint64(32)).astype(np.float64)
    with np.errstate(over="ignore"):
        sums = (np.bincount(part, low, total).astype(np.uint64) + (np.bincount(part, high, total).astype(np.uint64) << np.uint64(32))).reshape(-1, parts)
        own = np.bincount(part, ~usual, total).reshape(-1, parts) > 0
        doc = np.repeat(np.arange(len(size)), n1)
        group = np.arange(len(doc)) - (np.cumsum(n1) - n1)[doc]
        subsets = [list(s) for s in combinations(range(parts), parts - left_out)]
        strong = np.stack([own[:, s].any(axis=1) for s in subsets], 1)
        many = np.bincount(doc, ~strong.all(axis=1), len(size)) > weak
        tag = ((band[doc].astype(np.uint64) << np.uint64(32)) + group.astype(np.uint64)) * np.uint64(len(subsets)) + (np.uint64(deal) << np.uint64(56))
        last = many[doc] & (deal == DEALS - 1)
        for i, s in enumerate(subsets):
            ok = strong[:, i] | last
            sigs.append(C.mix64(C.mix64(sums[ok][:, s].sum(axis=1)) ^ C.mix64(tag[ok] + np.uint64(i))))
            nodes.append(node[doc[ok]])
    return many


def usual_grams(docs: DataFrame, n: int) -> np.ndarray:
    """A table of bits by the lowest bits of a gram: set for the grams that many sampled texts hold."""

    def run(batches):
        hashes, seen = C.Words(), np.empty(0, np.uint64)
        for _, _, texts in blocks_of(batches):
            seen = np.concatenate([seen, *gram_sets(texts, n, hashes)])
        g, count = np.unique(seen, return_counts=True)
        g, count = g[count > 1], count[count > 1]  # a gram in two tasks once each is no usual one
        yield pa.record_batch([pa.array(g.astype(np.int64)), pa.array(count)], names=["g", "n"])

    texts = docs.where("text is not null").select("text")
    size = docs.count()
    share = max(SAMPLED, -(-size // SAMPLE))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    found = C.map_arrow(some.coalesce(8), run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= max(USUAL_LEAST, USUAL * size / share)).orderBy(F.desc("n"), "g").limit(1 << (USUAL_BITS - 4)).select("g").toArrow()
    out = np.zeros(1 << USUAL_BITS, bool)
    out[found["g"].to_numpy() & (len(out) - 1)] = True
    return out


def signed(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, keys, nodes): signatures dealt into buckets as packed numbers.

    A key is 48 bits of a signature and the place of its node in ``nodes`` (16 bits).  Before anything
    is shuffled, a class signs once in each task, and of the nodes of one batch that share a signature
    only the least goes on; the others come as finished links (keys null, nodes u0 v0 u1 v1 ...).
    """

    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(usual_grams(docs, n)))  # of fixed size

    def run(batches):
        hashes, bands, done, usual = C.Words(), Bands(percent), set(), np.unpackbits(shared.value).astype(bool)
        for _, _, texts in blocks_of(batches):
            sets, names = [], []
            for g in gram_sets(texts, n, hashes):
                c = class_of(g)
                if c >= 0 and c not in done:
                    if len(done) < 1 << 20:
                        done.add(c)
                    sets.append(g), names.append(c)
            if not sets:
                continue
            for at in range(0, len(sets), 20_000):  # 16 bits number the nodes
                sig, node = signatures(sets[at : at + 20_000], np.array(names[at : at + 20_000]), bands, usual)
                if not len(sig):
                    continue
                sig >>= np.uint64(16)
                order = np.lexsort((node, sig))
                sig, node = sig[order], node[order]
                first = np.concatenate(([True], sig[1:] != sig[:-1]))
                least = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
                rest = ~first & (least != node)
                bucket, keys, packed = [], [], []
                if rest.any():
                    uv = np.unique(np.stack([node[rest], least[rest]], 1), axis=0)
                    bucket.append(int(uv[0, 0] % buckets)), keys.append(None), packed.append(uv.astype("<i8").tobytes())
                sig, node = sig[first], node[first]
                b = (sig % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                b, sig, node = b[order], sig[order], node[order]
                for lo, hi in zip(*C.runs(b), strict=True):
                    names_here, place = np.unique(node[lo:hi], return_inverse=True)
                    bucket.append(int(b[lo])), keys.append(((sig[lo:hi] << np.uint64(16)) | place.astype(np.uint64)).astype("<u8").tobytes()), packed.append(names_here.astype("<i8").tobytes())
                yield pa.record_batch([pa.array(bucket, pa.int64()), C.binary_column(keys), C.binary_column(packed)], names=["bucket", "keys", "nodes"])

    return C.map_arrow(docs.select("text"), run, "bucket long, keys binary, nodes binary")


def _stars(batches):
    """Links of the nodes that share a signature to the least of them, bucket by bucket."""
    for t in C.sorted_runs(batches, "bucket"):
        bucket = t["bucket"].to_numpy()
        for lo, hi in zip(*C.runs(bucket), strict=True):
            sig, node, links = [], [], []
            for keys, names in zip(t["keys"][int(lo) : int(hi)].to_pylist(), t["nodes"][int(lo) : int(hi)].to_pylist(), strict=True):
                names = np.frombuffer(names, "<i8")
                if keys is None:
                    links.append(names.reshape(-1, 2))
                else:
                    k = np.frombuffer(keys, "<u8")
                    sig.append(k >> np.uint64(16)), node.append(names[(k & np.uint64(0xFFFF)).astype(np.int64)])
            if sig:
                sig, node = np.concatenate(sig), np.concatenate(node)
                order = np.lexsort((node, sig))
                sig, node = sig[order], node[order]
                first = np.concatenate(([True], sig[1:] != sig[:-1]))
                least = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
                keep = least != node
                if keep.any():
                    links.append(np.stack([node[keep], least[keep]], 1))
            if links:
                uv = np.unique(np.concatenate(links), axis=0)
                yield pa.record_batch([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])


def clusters(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component): classes in a band, connected by shared signatures."""
    parts = C.shuffle_partitions(docs.sparkSession)
    along = signed(docs, n, percent, 4 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return components(C.map_arrow(along, lambda batches: contract(_stars(batches)), "u long, v long"), contracted=True)


# A fixed-size filter over class names: whatever the input, 2^25 bits (4 MB) are broadcast.
FILTER_BITS = 25


def _positions(names: np.ndarray) -> np.ndarray:
    h = C.mix64(names.view(np.uint64) if names.dtype == np.int64 else names)
    return np.concatenate([h >> np.uint64(64 - FILTER_BITS), (h & np.uint64((1 << FILTER_BITS) - 1))]).astype(np.int64)


def _passes(names: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which names the filter lets pass: all that are in it, and few others."""
    where = _positions(names).reshape(2, -1)
    return ((bits[where >> 6] >> (where & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)


def class_filter(names: DataFrame) -> np.ndarray:
    """Bits set for the classes in ``names``; of fixed size, so more classes only let more others pass."""

    def run(batches):
        for b in batches:
            at = np.unique(_positions(b.column("node").to_numpy()))
            yield pa.record_batch([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    words = C.map_arrow(names.select("node"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    if words.num_rows:
        out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def among(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` that a join with ``nodes`` can keep, and few others: no other payload is shuffled for it."""
    shared = sets.sparkSession.sparkContext.broadcast(class_filter(nodes))  # of fixed size

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_passes(b.column("node").to_numpy(), shared.value)))

    return C.map_arrow(sets, run, sets.schema)


def _packed(g: np.ndarray) -> bytes:
    """Sorted 48-bit hashes as their upper 16 bits, which compress well, and their lower 32 bits."""
    return (g >> np.uint64(32)).astype("<u2").tobytes() + g.astype("<u4").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return (np.frombuffer(b, "<u2", n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(b, "<u4", n, 2 * n)


def described(docs: DataFrame, n: int, percent: int, wanted: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, class, nodes, maps, grams): nodes with their bitmaps, and grams, only where one
    of the class's nodes passes the filter, and once a task for each class."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # of fixed size

    def run(batches):
        hashes, given, bands, bits = C.Words(), set(), Bands(percent), shared.value
        for batch, at, texts in blocks_of(batches):
            sets = gram_sets(texts, n, hashes)
            names = [class_of(g) for g in sets]
            size = np.array([len(g) for g in sets])
            own = np.array([bands.of(int(x)) for x in size])
            nodes = np.stack([node_of(np.array(names), own + i) for i in (0, 1)], 1)
            hit = _passes(nodes.ravel(), bits).reshape(nodes.shape)
            of, maps, packed = [], [], []
            for g, c, b, ns, ok in zip(sets, names, own.tolist(), nodes, hit, strict=True):
                if c < 0 or c in given or not ok.any():
                    of.append(None), maps.append(None), packed.append(None)
                    continue
                if len(given) < 1 << 20:
                    given.add(c)
                of.append(ns[ok]), maps.append([bitmap(g, bands.top(b + i)) for i in np.flatnonzero(ok).tolist()]), packed.append(_packed(g))
            ids = batch.column("doc_id").slice(at, len(texts))
            yield pa.record_batch([ids, pa.array(size, pa.int64()), pa.array(names, pa.int64()), pa.array(of, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.binary())), C.binary_column(packed)], names=["doc_id", "n_shingles", "class", "nodes", "maps", "grams"])

    return C.map_arrow(C.docs_of(docs), run, "doc_id long, n_shingles long, class long, nodes array<long>, maps array<binary>, grams binary")


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096, common: int = 48) -> np.ndarray:
    """Sizes of the intersections of all sets in a with all in b.

    Grams that many sets hold count by products of 0/1 matrices, a slice at a time; for the others
    the few pairs that hold each are counted one by one.
    """
    ga, gb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ga, gb)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out
    sides = []
    for g, sets in ((ga, a), (gb, b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, g), len(both) - 1)
        ok = both[at] == g
        order = np.argsort(at[ok], kind="stable")
        sides.append((row[ok][order], at[ok][order]))
    counts = [np.bincount(at, minlength=len(both)) for _, at in sides]
    dense = counts[0].astype(np.int64) * counts[1] > common * common
    place = np.cumsum(dense) - 1
    n_dense = int(dense.sum())
    slim = [(row[~dense[at]], at[~dense[at]]) for row, at in sides]
    wide = [(row[dense[at]], place[at[dense[at]]]) for row, at in sides]
    for s in range(0, n_dense, width):
        m = []
        for (row, at), sets in zip(wide, (a, b), strict=True):
            lo, hi = np.searchsorted(at, [s, s + width])
            x = np.zeros((len(sets), min(width, n_dense - s)), np.float32)
            x[row[lo:hi], at[lo:hi] - s] = 1
            m.append(x)
        out += m[0] @ m[1].T
    (ra, pa_), (rb, pb) = slim
    if len(pa_):
        start, end = np.searchsorted(pb, pa_, "left"), np.searchsorted(pb, pa_, "right")
        many = end - start
        cuts = np.searchsorted(np.cumsum(many), np.arange(1_000_000, int(many.sum()) + 1_000_000, 1_000_000)) + 1  # some million pairs at once
        for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            m = many[lo:hi]
            i = np.repeat(ra[lo:hi], m)
            j = rb[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[lo:hi], m)]
            out += np.bincount(i * len(b) + j, minlength=out.size).reshape(out.shape)
    return out


def _near_maps(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray, percent: int):
    """Pairs whose bitmaps differ in no more bits than grams may differ, some rows at a time."""
    # nodes of different bands are in one cluster only by chance, and then don't link here
    la, lb = np.array([len(m) for m in a]), np.array([len(m) for m in b])
    for size in np.intersect1d(la, lb).tolist():
        ia, ib = np.flatnonzero(la == size), np.flatnonzero(lb == size)
        x, y = (np.frombuffer(b"".join([m[i] for i in ix.tolist()]), np.uint64).reshape(len(ix), -1) for m, ix in ((a, ia), (b, ib)))
        step = max(1, 2_000_000 // y.size)
        for lo in range(0, len(x), step):
            differ = np.bitwise_count(x[lo : lo + step, None, :] ^ y[None]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero(differ * (100 + percent) <= (100 - percent) * (na[ia[lo : lo + step], None] + nb[None, ib]))
            yield ia[i + lo], ib[j]


def _near_sets(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray, percent: int):
    """Pairs that link."""
    left = [_unpacked(g) for g in a]
    common = intersections(left, left if b is a else [_unpacked(g) for g in b])
    for lo in range(0, len(a), 256):
        c = common[lo : lo + 256].astype(np.int64)
        i, j = np.nonzero(100 * c >= percent * (na[lo : lo + 256, None] + nb[None] - c))
        yield i + lo, j


def _compared(near, percent: int):
    """The spanning forest of the pairs that ``near`` finds in each task, by ``name``."""

    def run(batches):
        for t in C.sorted_runs(batches, "task"):
            task, name, side, size = (t[c].to_numpy() for c in ("task", "name", "side", "n"))
            for lo, hi in zip(*C.runs(task), strict=True):
                seen, at = set(), ([], [])
                for i in range(lo, hi):  # a class may come from several tasks
                    if (name[i], side[i]) not in seen:
                        seen.add((name[i], side[i]))
                        at[side[i]].append(i)
                if not at[0] or len(at[0]) + len(at[1]) < 2:
                    continue
                a = [t["payload"][int(i)].as_py() for i in at[0]]
                right = at[1] or at[0]
                b = [t["payload"][int(i)].as_py() for i in at[1]] if at[1] else a
                left_names, right_names = name[at[0]], name[right]
                forest = np.empty((0, 2), np.int64)
                for i, j in near(a, b, size[at[0]], size[right], percent):
                    u, v = np.append(left_names[i], forest[:, 0]), np.append(right_names[j], forest[:, 1])
                    nodes, root = least_of(u, v)
                    keep = nodes != root
                    forest = np.stack([nodes[keep], root[keep]], 1)
                if len(forest):
                    yield pa.record_batch([pa.array(forest[:, 0]), pa.array(forest[:, 1])], names=["u", "v"])

    return run


def large(sets: DataFrame, cluster: DataFrame, block: int, most: int) -> DataFrame:
    """(component, salt, leader, blocks): clusters of more than ``block`` weight or ``most`` nodes, a row for each salt."""
    each = sets.select("node", "weight").distinct().join(cluster, "node").groupBy("component")
    found = each.agg(F.min("node").alias("leader"), F.greatest(F.ceil(F.sum("weight") / block), F.ceil(F.count("*") / most)).cast("int").alias("blocks")).where("blocks > 1")
    return found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("component", "salt", "leader", "blocks")


def salted(cluster: DataFrame, many: DataFrame, how: str) -> DataFrame:
    """Nodes with what is known of their clusters: a cluster's nodes meet it in SALTS places."""
    return cluster.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int")).join(many, ["component", "salt"], how)


def compared(sets: DataFrame, cluster: DataFrame, near, percent: int, block: int, most: int) -> DataFrame:
    """(u, v) among the rows (node, name, n, weight, payload) of each cluster (node, component), in blocks of
    at most ``block`` weight and ``most`` nodes on average."""
    placed = salted(cluster, large(sets, cluster, block, most), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block i meets blocks 0..blocks-1: task (i, j), i <= j, with i on the left side and j on the right
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = placed.select("node", "component", "block", other).select(
        "node",
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    dealt = among(sets, cluster).join(tasks, "node").select("task", "side", "name", "n", "payload")
    along = dealt.repartition(C.shuffle_partitions(sets.sparkSession), "task").sortWithinPartitions("task", "side", "name")
    return C.map_arrow(along, lambda batches, fn=_compared(near, percent): contract(fn(batches)), "u long, v long")


def _led(batches):
    """The similarity of each node of a task to the leader, on the left side."""
    for t in C.sorted_runs(batches, "task"):
        task, side, size = (t[c].to_numpy() for c in ("task", "side", "n"))
        for lo, hi in zip(*C.runs(task), strict=True):
            first = int(lo + side[lo:hi].sum())  # the leader may come from several tasks
            if first == lo or first == hi:
                continue
            leader, name = _unpacked(t["payload"][int(lo)].as_py()), t["name"][int(lo)].as_py()
            common = np.array([len(np.intersect1d(_unpacked(t["payload"][i].as_py()), leader, assume_unique=True)) for i in range(first, hi)])
            rest = t.slice(first, int(hi - first))
            yield pa.record_batch([rest["node"].combine_chunks(), rest["component"].combine_chunks(), rest["name"].combine_chunks(), pa.array(np.full(hi - first, name)), pa.array(common), pa.array(size[first:hi] + size[lo] - common)], names=["node", "component", "u", "v", "common", "both"])


def led(sets: DataFrame, cluster: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of the nodes of large clusters to their leaders, and what is left to compare of all clusters.

    One less the similarity is a distance.  So a node that links with the leader can link with one that doesn't only
    if their distances to the leader differ by no more than a link's; the others that link have no more to find.
    """
    spark = sets.sparkSession
    many = C.staged(spark, large(sets, cluster, BLOCK_GRAMS, BLOCK_CLASSES), "jaccard-large")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    ways = salted(cluster, many, "inner").where("node <> leader").select("node", "component", block.alias("block"), F.lit(0).alias("side"))
    leaders = many.where("salt = 0").select(F.col("leader").alias("node"), "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"))
    tasks = ways.unionByName(leaders).select("node", "component", F.xxhash64("component", "block").alias("task"), "side")
    dealt = among(sets, ways.select("node").unionByName(leaders.select("node"))).join(tasks, "node").select("task", "side", "node", "component", "name", "n", "payload")
    along = dealt.repartition(C.shuffle_partitions(spark), "task").sortWithinPartitions("task", F.desc("side"), "node")
    seen = C.staged(spark, C.map_arrow(along, _led, "node long, component long, u long, v long, common long, both long").distinct(), "jaccard-led")
    links = F.col("common") * 100 >= percent * F.col("both")
    apart = 1 - F.col("common") / F.col("both")
    nearest = seen.where(~links).groupBy("component").agg(F.min(apart).alias("nearest"))
    spread = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = salted(seen, spread, "inner").where(~links | (apart + (1 - percent / 100) + 1e-9 >= F.col("nearest"))).select("node", "component")
    small = salted(cluster, many, "left_anti").select("node", "component")
    return seen.where(links).select("u", "v"), C.staged(spark, small.unionByName(left), "jaccard-left")


def links(known: DataFrame, cluster: DataFrame, percent: int) -> DataFrame:
    """(u, v): a spanning forest of the true links, by class, within the clusters (node, component)."""
    spark = known.sparkSession
    held = known.where("grams is not null").withColumnRenamed("n_shingles", "n")
    sets = held.select(F.explode("nodes").alias("node"), F.col("class").alias("name"), "n", F.col("n").alias("weight"), F.col("grams").alias("payload"))
    found = None
    for _ in range(LEADERS):
        if large(sets, cluster, BLOCK_GRAMS, BLOCK_CLASSES).isEmpty():
            break
        own, cluster = led(sets, cluster, percent)
        found = own if found is None else found.unionByName(own)
    pair = F.explode(F.arrays_zip("nodes", "maps")).alias("pair")
    maps = held.select(pair, "n").select(F.col("pair.nodes").alias("node"), F.col("pair.nodes").alias("name"), "n", F.length("pair.maps").alias("weight"), F.col("pair.maps").alias("payload"))
    closer = C.staged(spark, components(compared(maps, cluster, _near_maps, percent, BLOCK_BYTES, BLOCK_MAPS), contracted=True), "jaccard-closer")
    rest = compared(sets, closer, _near_sets, percent, BLOCK_GRAMS, BLOCK_CLASSES)
    return rest if found is None else rest.unionByName(C.map_arrow(found, contract, "u long, v long"))


def classes(docs: DataFrame, n: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): each document with the least doc_id it reaches by links.

    A document without grams, or of null id, is its own component.
    """
    spark = docs.sparkSession
    cluster = C.staged(spark, clusters(docs, n, percent), "jaccard-clusters")
    known = C.staged(spark, described(docs, n, percent, class_filter(cluster)), "jaccard-documents")
    found = components(links(known, cluster, percent), contracted=True).withColumnRenamed("node", "class")
    own = known.select("doc_id", "n_shingles", "class")
    least = own.where("class >= 0").groupBy("class").agg(F.min("doc_id").alias("least"))  # a group of copies is one row from each task
    named = least.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.select("class", "component").join(first, "component").select("class", "component_id")
    out = own.join(of_class, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("class") >= 0, F.col("component_id")), F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose doc_id is the least of its component.

    A row without grams stays; of rows repeated with one doc_id all stay.
    """
    stay = classes(docs, n, percent).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.table(spark, sf_dir, "documents"))


def _sql(n: int = SIZE, percent: int = PERCENT) -> str:
    """DuckDB SQL of the query: all sets, all intersections, all reachable ids."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {words} AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + {n - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), s AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT u, v FROM p JOIN s x ON x.doc_id = u JOIN s y ON y.doc_id = v WHERE 100 * c >= {percent} * (x.n + y.n - c)
), r AS (
  SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), m AS (
  SELECT u, min(v) AS least FROM r GROUP BY u
)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, coalesce(m.least, w.doc_id)) AS BIGINT) AS component_id
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN m ON m.u = w.doc_id
"""


OP10_SQL = _sql()
