"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 4).

Equal vectors are one *node*.  A first graph comes from small leaves around sampled
pivots; then NN-descent improves it: in every round each node introduces its
neighbours (and those it is a neighbour of) to each other, in Spark joins of the
graph with itself, and each keeps its nearest.  Queries walk the graph greedily: a
beam starts at the query's own neighbours, and the best nodes not yet visited are
expanded until none of them leads to a better one.  The best of the beam are scored
again on the original vectors in double precision.

Inner products favour long vectors, which would leave the graph with few hubs; so the
graph is built on vectors made equally long by one more component, and a query has 0
there: its products, and so its order of neighbours, are the original ones.  That
component is never rounded with the others: each node carries its ``rise`` in floats,
from which scores (half the squared distance, below zero) follow without cancellation,
however long the longest vector is.  Beams also start at the best of the ``ENTRIES``
longest vectors, which are near to no short one but may have large products with it.

The graph is held in blocks (bucket, nodes, coarse vectors, neighbours), dealt by a
hash of the node; what blocks tell each other travels as packed arrays, so that no
vector is sent to one block more than once by the same sender.  Coarse vectors are
8-bit; they steer the search only.

Measured recall at 20 of inner-product neighbours is in the README.  Rows whose vector
is null, zero, or holds a null or non-finite component take no part; nor do rows of
null id, nor vectors of another length than most (distinct) vectors have.  The graph's
scores are of vectors in parts of the longest one's length, so large components don't
overflow; only exact scores beyond the largest double are infinite, and tie.  Ties go to the smaller id.  An empty table gives an empty result.  Bound of
the fit: ``PIVOTS`` pivots and ``ENTRIES`` entries; every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

K, TOP, DIVISOR = 48, 20, 20
LEAF, LEAVES, PIVOTS = 512, 4, 4096
REVERSE, ROUNDS, KEEP = 48, 8, 20
#: Rounds end when one adds less than this share to the sum of all scores, each taken in its node's own length.
SETTLED = 0.015
BEAM, EXPAND, HOPS, EXACT = 128, 96, 6, 56
#: The longest vectors, scored against every query at its start, and how many of them its beam takes in.
ENTRIES, ENTERED = 1024, 16
#: Nodes of a block: some 2 MB of graph, whatever the number of partitions.
BLOCK = 2000
PACKET = "bucket long, kind int, a binary, b binary, c binary, d binary"
NAMES = ["bucket", "kind", "a", "b", "c", "d"]


# --------------------------------------------------------------------------- arrays

def coarse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit vectors and their scales."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    return np.round(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def stored(x: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """8-bit vectors, and (scale, rise) of each."""
    v, scale = coarse(x)
    return v, np.stack([scale, rises(x, length)], 1)


def pack_vectors(v: np.ndarray, scale: np.ndarray) -> bytes:
    return scale.astype("<f4").tobytes() + v.tobytes()


def unpack_vectors(b: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b, "i1", offset=8 * n).reshape(n, -1) if n else np.empty((0, 1), np.int8), np.frombuffer(b, "<f4", 2 * n).reshape(n, 2)


def floats(v: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return v.astype(np.float32) * scale[:, :1]


def bucket_of(nodes: np.ndarray, buckets: int) -> np.ndarray:
    return (C.mix64(nodes.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def best(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best distinct v of each u, sorted by u, then score, then v; with the place of each in its list."""
    order = np.lexsort((-s, v, u))
    u, v, s = u[order], v[order], s[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s = u[first], v[first], s[first]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    start, end = C.runs(u)
    place = np.arange(len(u)) - np.repeat(start, end - start)
    keep = place < k
    return u[keep], v[keep], s[keep], place[keep]


def table_of(u: np.ndarray, v: np.ndarray, s: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of the k best of u = 0..n-1 as arrays (n, k), filled up with -1."""
    ids, scores = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
    u, v, s, place = best(u, v, s, k)
    ids[u, place], scores[u, place] = v, s
    return ids, scores


def i8(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i8")


def f4(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<f4")


class Sender:
    """Rows of packets."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, bucket: int, kind: int, *parts: bytes) -> None:
        self.rows.append((int(bucket), kind, *parts, *[None] * (4 - len(parts))))

    def edges(self, to: np.ndarray, kind: int, buckets: int, *cols: np.ndarray) -> None:
        """Arrays that belong together, dealt by the bucket of ``to``."""
        b = bucket_of(to, buckets)
        order = np.argsort(b, kind="stable")
        b, cols = b[order], [c[order] for c in cols]
        for lo, hi in zip(*C.runs(b), strict=True):
            self.add(b[lo], kind, *(c[lo:hi].tobytes() for c in cols))

    def vectors(self, to: np.ndarray, kind: int, buckets: int, member: np.ndarray, nodes: np.ndarray, vectors: np.ndarray, scale: np.ndarray, limit: np.ndarray) -> None:
        """(to, node) pairs; each node's vector and limit goes to a bucket once."""
        b = bucket_of(to, buckets)
        order = np.argsort(b, kind="stable")
        b, to, member = b[order], to[order], member[order]
        for lo, hi in zip(*C.runs(b), strict=True):
            own, at = np.unique(member[lo:hi], return_inverse=True)
            self.add(b[lo], kind, to[lo:hi].tobytes() + at.astype("<i4").tobytes(), nodes[own].tobytes(), pack_vectors(vectors[own], scale[own]), limit[own].astype("<f4").tobytes())

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[]] * 6
        self.rows = []
        return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=NAMES)


def by_bucket(batches):
    """(bucket, rows by kind) of bucket-sorted packets."""
    for t in C.sorted_runs(batches, "bucket"):
        bucket = t["bucket"].to_numpy()
        for lo, hi in zip(*C.runs(bucket), strict=True):
            part = t.slice(int(lo), int(hi - lo))
            kinds: dict[int, list[tuple]] = {}
            for kind, *cols in zip(*(part[n].to_pylist() for n in NAMES[1:]), strict=True):
                kinds.setdefault(kind, []).append(cols)
            yield int(bucket[lo]), kinds


def joined(rows: list) -> tuple[np.ndarray, ...]:
    """All packets of (to, node) pairs as one: to, place of the node, and the distinct nodes with vectors, scales and limits."""
    to, who, nodes, vectors, scale, limit, base = [], [], [], [], [], [], 0
    for pairs, own, packed, limits in rows:
        n = len(pairs) // 12
        to.append(i8(pairs[: 8 * n])), who.append(np.frombuffer(pairs, "<i4", n, 8 * n).astype(np.int64) + base)
        v, s = unpack_vectors(packed, len(own) // 8)
        nodes.append(i8(own)), vectors.append(v), scale.append(s), limit.append(f4(limits))
        base += len(own) // 8
    to, who, nodes, vectors, scale, limit = (np.concatenate(x) for x in (to, who, nodes, vectors, scale, limit))
    nodes, first, back = np.unique(nodes, return_index=True, return_inverse=True)
    return to, back[who], nodes, vectors[first], scale[first], limit[first]


def exchanged(df: DataFrame) -> DataFrame:
    return df.repartition(C.shuffle_partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")


STATE, REVERSED, MEMBERS, OFFERS, QUERIES, VISITS, ASKS, ANSWERS = range(8)


class Block:
    """The nodes of a bucket: ids, coarse vectors, neighbours and their scores."""

    def __init__(self, cols: list):
        self.nodes = i8(cols[0])
        n = len(self.nodes)
        self.vectors, self.scale = unpack_vectors(cols[1], n)
        self.ids, self.scores = i8(cols[2]).reshape(n, -1), f4(cols[3]).reshape(n, -1)

    def parts(self) -> tuple[bytes, ...]:
        return self.nodes.tobytes(), pack_vectors(self.vectors, self.scale), self.ids.astype("<i8").tobytes(), self.scores.astype("<f4").tobytes()

    def at(self, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, nodes)  # nodes are sorted and all here


# --------------------------------------------------------------------------- nodes

def nodes_of(vectors: DataFrame, id_col: str, vec_col: str, keep: int) -> DataFrame:
    """(node, vec, ids): distinct vectors by their least id, with their ``keep`` least ids."""

    def run(batches):
        own: dict[int, list] = {}
        out = lambda: pa.record_batch([pa.array([h >> 1 for h in own], pa.int64()), C.binary_column([x[0] for x in own.values()]), pa.array([sorted(x[1])[:keep] for x in own.values()], pa.list_(pa.int64()))], names=["h", "vec", "ids"])
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), vector_bytes(batch.column("vec")), strict=True):
                if v is not None and i is not None:
                    ids = own.setdefault(xxhash.xxh64_intdigest(v), [v, set()])[1]
                    ids.add(i)
                    if len(ids) > 4 * keep:
                        ids.difference_update(sorted(ids)[keep:])
            if len(own) > 50_000:
                yield out()
                own.clear()
        yield out()

    rows = C.map_arrow(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), run, "h long, vec binary, ids array<long>")
    merged = rows.groupBy("h").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))  # ``keep`` ids from a task at most
    return merged.select(F.col("ids")[0].alias("node"), "vec", "ids", "h")


def vector_bytes(column: pa.Array) -> list[bytes | None]:
    """Little-endian doubles of each usable vector, else None."""
    out: list[bytes | None] = []
    for v in column:
        if not v.is_valid:
            out.append(None)
            continue
        x = v.values
        a = None if x.null_count else x.to_numpy(zero_copy_only=False).astype("<f8")
        out.append(a.tobytes() if a is not None and len(a) and np.isfinite(a).all() and a.any() else None)
    return out


def matrix(column) -> np.ndarray:
    """Vectors of one length as rows."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.empty((0, 1))


def of_one_length(nodes: DataFrame) -> DataFrame:
    """The nodes whose vectors have the length that most nodes have (of equally many, the shorter)."""
    usual = nodes.groupBy(F.length("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return nodes if usual is None else nodes.where(F.length("vec") == usual["size"])


def unit(column, length: float) -> np.ndarray:
    """Vectors as parts of the longest one's length, so that no square overflows."""
    return matrix(column) / (length or 1.0)


# --------------------------------------------------------------------------- graph

def longest(nodes: DataFrame, count: int = ENTRIES) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``count`` longest vectors: nodes, vectors as parts of the longest one's length, and that length."""

    def run(batches):
        ids, x, n = np.empty(0, np.int64), None, np.empty(0)
        for b in batches:
            if b.num_rows:
                own = matrix(b.column("vec"))
                ids, x = np.append(ids, b.column("node").to_numpy()), own if x is None else np.concatenate([x, own])
                most = np.maximum(np.abs(own).max(axis=1), 1e-300)
                n = np.append(n, most * np.sqrt(((own / most[:, None]) ** 2).sum(axis=1)))
                top = np.lexsort((ids, -n))[:count]
                ids, x, n = ids[top], x[top], n[top]
        yield pa.record_batch([pa.array(ids), C.binary_column([] if x is None else [v.astype("<f8").tobytes() for v in x]), pa.array(n)], names=["node", "vec", "n"])

    got = C.map_arrow(nodes.select("node", "vec"), run, "node long, vec binary, n double").orderBy(F.desc("n"), "node").limit(count).toArrow()  # at most ``count`` vectors
    length = float(got["n"][0].as_py()) if got.num_rows else 1.0
    return got["node"].to_numpy(), unit(got["vec"], length), length


def rises(x: np.ndarray, length: float) -> np.ndarray:
    """``length * (length - r)`` of each vector, r being the component that brings it to that length."""
    own = (x * x).sum(axis=1)
    return (own * length / np.maximum(length + np.sqrt(np.maximum(0.0, length * length - own)), 1e-300)).astype(np.float32)


def scores_of(x: np.ndarray, rise: np.ndarray, y: np.ndarray, other: np.ndarray, length: float) -> np.ndarray:
    """Products of equally long vectors less their squared length, from the original components and the rises."""
    s = x @ y.T
    s += (rise / np.float32(length))[:, None] * (other / np.float32(length))[None, :]
    s -= rise[:, None]
    s -= other[None, :]
    return s


def first_graph(nodes: DataFrame, buckets: int, size: int, longest_of_all: float, length: float = 1.0) -> DataFrame:
    """Neighbours within leaves: each node joins the leaves of its nearest pivots; a large leaf is cut at random."""
    spark = nodes.sparkSession
    count = max(1, min(PIVOTS, size // (LEAF // 2)))
    scaled = lambda column: unit(column, longest_of_all)
    pivots = scaled(nodes.orderBy(F.xxhash64("node"), "node").limit(count).select("vec").toArrow()["vec"])
    shared = spark.sparkContext.broadcast((pivots.astype(np.float32), rises(pivots, length)))  # at most PIVOTS vectors

    def nearest(x: np.ndarray) -> np.ndarray:
        s = scores_of(x.astype(np.float32), rises(x, length), *shared.value, length)
        m = min(LEAVES, s.shape[1])
        return np.argpartition(-s, m - 1, axis=1)[:, :m]

    def counts(batches):
        total = np.zeros(count, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(nearest(scaled(b.column("vec"))).ravel(), minlength=count)
        yield pa.record_batch([pa.array(np.arange(count)), pa.array(total)], names=["pivot", "n"])

    found = C.map_arrow(nodes.select("vec"), counts, "pivot long, n long").groupBy("pivot").agg(F.sum("n").alias("n")).toArrow()
    cuts = np.ones(count, np.int64)
    if found.num_rows:
        cuts[found["pivot"].to_numpy()] = np.maximum(1, -(-found["n"].to_numpy() // LEAF))
    offset = np.cumsum(cuts) - cuts

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column("node").to_numpy(), scaled(b.column("vec"))
            v, scale = stored(x, length)
            near = nearest(x)
            leaf = offset[near] + (C.mix64(ids.view(np.uint64) + np.uint64(5))[:, None] % cuts[near].astype(np.uint64)).astype(np.int64)
            out, member = Sender(), np.repeat(np.arange(len(ids)), near.shape[1])
            flat = leaf.ravel()
            order = np.argsort(flat, kind="stable")
            for lo, hi in zip(*C.runs(flat[order]), strict=True):
                own = member[order[lo:hi]]
                out.add(flat[order[lo]], MEMBERS, ids[own].tobytes(), pack_vectors(v[own], scale[own]))
            yield out.batch()

    def leaves(batches):
        out = Sender()
        for _, kinds in by_bucket(batches):
            ids = np.concatenate([i8(c[0]) for c in kinds[MEMBERS]])
            packed = [unpack_vectors(c[1], len(c[0]) // 8) for c in kinds[MEMBERS]]
            x, rise = np.concatenate([floats(*p) for p in packed]), np.concatenate([p[1][:, 1] for p in packed])
            order = np.argsort(C.mix64(ids.view(np.uint64)))
            for part in np.array_split(order, -(-len(order) // (2 * LEAF))):
                s = scores_of(x[part], rise[part], x[part], rise[part], length)
                np.fill_diagonal(s, -np.inf)
                m = min(K, len(part) - 1)
                if m < 1:
                    continue
                near = np.argpartition(-s, m - 1, axis=1)[:, :m]
                u = np.repeat(ids[part], m)
                out.edges(u, OFFERS, buckets, u, ids[part][near].ravel(), np.take_along_axis(s, near, 1).ravel().astype("<f4"))
            if len(out.rows) > 500:
                yield out.batch()
        yield out.batch()

    def vectors(batches):
        for b in batches:
            if b.num_rows:
                ids = b.column("node").to_numpy()
                v, scale = stored(scaled(b.column("vec")), length)
                out, at = Sender(), bucket_of(ids, buckets)
                order = np.argsort(at, kind="stable")
                for lo, hi in zip(*C.runs(at[order]), strict=True):
                    own = order[lo:hi]
                    out.add(at[own[0]], STATE, ids[own].tobytes(), pack_vectors(v[own], scale[own]), np.full(len(own) * K, -1, "<i8").tobytes(), np.full(len(own) * K, -np.inf, "<f4").tobytes())
                yield out.batch()

    offers = C.map_arrow(exchanged(C.map_arrow(nodes.select("node", "vec"), assign, PACKET)), leaves, PACKET)
    return merged(C.map_arrow(nodes.select("node", "vec"), vectors, PACKET), offers)


def merged(state: DataFrame, offers: DataFrame) -> DataFrame:
    """Blocks whose lists have taken in the offers: one row a bucket."""

    def run(batches):
        for bucket, kinds in by_bucket(batches):
            blocks = [Block(c) for c in kinds.get(STATE, [])]
            if not blocks:
                continue
            nodes = np.concatenate([b.nodes for b in blocks])
            order = np.argsort(nodes)
            whole = blocks[0]
            whole.nodes, whole.vectors, whole.scale = nodes[order], np.concatenate([b.vectors for b in blocks])[order], np.concatenate([b.scale for b in blocks])[order]
            ids, scores = np.concatenate([b.ids for b in blocks])[order], np.concatenate([b.scores for b in blocks])[order]
            old = ids.ravel() >= 0
            u = [np.repeat(np.arange(len(nodes)), ids.shape[1])[old], *(whole.at(i8(c[0])) for c in kinds.get(OFFERS, []))]
            v = [ids.ravel()[old], *(i8(c[1]) for c in kinds.get(OFFERS, []))]
            s = [scores.ravel()[old], *(f4(c[2]) for c in kinds.get(OFFERS, []))]
            whole.ids, whole.scores = table_of(np.concatenate(u), np.concatenate(v), np.concatenate(s), len(nodes), K)
            out = Sender()
            out.add(bucket, STATE, *whole.parts())
            yield out.batch()

    return C.map_arrow(exchanged(state.unionByName(offers)), run, PACKET)


def reversed_edges(state: DataFrame, buckets: int) -> DataFrame:
    """Each node tells its neighbours that it counts them as such; a popular one hears of its best only."""

    def run(batches):
        for b in batches:
            for cols in zip(*(b.column(n).to_pylist() for n in NAMES[2:]), strict=True):
                block = Block(cols)
                ok = block.ids.ravel() >= 0
                to, back, s, _ = best(block.ids.ravel()[ok], np.repeat(block.nodes, block.ids.shape[1])[ok], block.scores.ravel()[ok], REVERSE)
                out = Sender()
                out.edges(to, REVERSED, buckets, to, back, s.astype("<f4"))
                yield out.batch()

    return C.map_arrow(state, run, PACKET)


def introduced(state: DataFrame, buckets: int, length: float = 1.0) -> DataFrame:
    """One round's offers: neighbours of neighbours, found where lists meet."""

    def members(batches):
        for _, kinds in by_bucket(batches):
            if STATE not in kinds:
                continue
            block = Block(kinds[STATE][0])
            rev = kinds.get(REVERSED, [])
            ok = block.ids.ravel() >= 0
            u, v = [np.repeat(np.arange(len(block.nodes)), block.ids.shape[1])[ok]], [block.ids.ravel()[ok]]
            if rev:
                ru, rv, _, _ = best(block.at(np.concatenate([i8(c[0]) for c in rev])), np.concatenate([i8(c[1]) for c in rev]), np.concatenate([f4(c[2]) for c in rev]), REVERSE)
                u.append(ru), v.append(rv)
            u, v = np.concatenate(u), np.concatenate(v)
            pairs = np.unique(np.stack([u, v], 1), axis=0)
            out = Sender()
            out.vectors(np.ascontiguousarray(pairs[:, 1]), MEMBERS, buckets, pairs[:, 0], block.nodes, block.vectors, block.scale, block.scores[:, -1])
            yield out.batch()

    def meet(batches):
        for _, kinds in by_bucket(batches):
            if MEMBERS not in kinds:
                continue
            center, member, nodes, vectors, scale, limit = joined(kinds[MEMBERS])
            x, rise = floats(vectors, scale), scale[:, 1]
            order = np.argsort(center, kind="stable")
            center, member = center[order], member[order]
            us, vs, ss, held, out = [], [], [], 0, Sender()

            def flush():
                u, v, s, _ = best(np.concatenate(us), np.concatenate(vs), np.concatenate(ss), KEEP)
                us[:], vs[:], ss[:] = [u], [v], [s]
                return len(u)

            for lo, hi in zip(*C.runs(center), strict=True):
                m = member[lo:hi]
                s = scores_of(x[m], rise[m], x[m], rise[m], length)
                np.fill_diagonal(s, -np.inf)
                i, j = np.nonzero(s > limit[m][:, None])
                if len(i):
                    us.append(nodes[m[i]]), vs.append(nodes[m[j]]), ss.append(s[i, j])
                    held += len(i)
                    if held > 1_500_000:
                        held = flush()
            if us:
                flush()
                out.edges(us[0], OFFERS, buckets, us[0], vs[0], ss[0].astype("<f4"))
                yield out.batch()

    known = exchanged(state.unionByName(reversed_edges(state, buckets)))
    return C.map_arrow(exchanged(C.map_arrow(known, members, PACKET)), meet, PACKET)


def graph(nodes: DataFrame, buckets: int, length: float, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph in blocks, of vectors as parts of the longest one's ``length``."""
    spark = nodes.sparkSession
    size = nodes.count()
    state = C.staged(spark, first_graph(nodes, buckets, size, length), "ann-graph")
    reached = _reached(state)
    for _ in range(rounds if size > K + 1 else 0):
        new = C.staged(spark, merged(state, introduced(state, buckets)), "ann-graph")
        C.drop(spark, state)
        state, before, reached = new, reached, _reached(new)
        spark.sparkContext._jvm.System.gc()  # lets Spark clear the shuffle files of the round that is over
        if reached - before < SETTLED * abs(reached):
            break
    return state


def _reached(state: DataFrame) -> float:
    """The sum of all neighbours' scores, each against its node's squared length: 1 at the node itself, 0 from its
    own length on (for vectors of one length, the cosine).  So no long vector outweighs the others."""

    def scores(batches):
        total = 0.0
        for b in batches:
            for cols in zip(*(b.column(n).to_pylist() for n in NAMES[2:]), strict=True):
                block = Block(cols)
                x = floats(block.vectors, block.scale)
                s = 1 + block.scores / np.maximum((x * x).sum(axis=1), np.float32(1e-30))[:, None]
                total += float(np.maximum(s, 0).sum(dtype=np.float64))
        yield pa.record_batch([pa.array([total])], names=["s"])

    return C.map_arrow(state, scores, "s double").agg(F.sum("s")).first()[0] or 0.0


# --------------------------------------------------------------------------- search

class Beam(Block):
    """Queries of a bucket with their beams; ``open`` marks what isn't expanded yet."""

    def __init__(self, cols: list):
        super().__init__(cols[:4])
        self.open = self.scores > -np.inf

    @staticmethod
    def split(b: bytes) -> tuple[bytes, bytes]:
        n = len(b) * 4 // 5
        return b[:n], b[n:]

    @classmethod
    def read(cls, cols: list) -> Beam:
        scores, flags = cls.split(cols[3])
        out = cls([*cols[:3], scores])
        out.open = np.frombuffer(flags, "u1").reshape(out.scores.shape).astype(bool)
        return out

    def parts(self) -> tuple[bytes, ...]:
        a, b, c, d = super().parts()
        return a, b, c, d + self.open.astype("u1").tobytes()


def search(state: DataFrame, queries: DataFrame, buckets: int, entries: tuple[np.ndarray, np.ndarray], beam: int = BEAM, hops: int = HOPS) -> DataFrame:
    """(query, node, score): the best of each query node's beam, by coarse vectors."""
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast(entries)  # at most ENTRIES vectors

    def start(batches):
        doors, door = shared.value
        for bucket, kinds in by_bucket(batches):
            if QUERIES not in kinds or STATE not in kinds:
                continue
            block = Block(kinds[STATE][0])
            at = block.at(np.unique(np.concatenate([i8(c[0]) for c in kinds[QUERIES]])))
            block.nodes, block.vectors, block.scale = block.nodes[at], block.vectors[at], block.scale[at]
            # the graph's scores hold the added component: neighbours are scored anew when they are visited
            near = np.where(block.ids[at] >= 0, np.float32(-1e30), -np.inf).astype(np.float32)
            s = floats(block.vectors, block.scale) @ door.T
            s[block.nodes[:, None] == doors[None, :]] = -np.inf
            m = min(ENTERED, len(doors))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            score = np.take_along_axis(s, top, 1)
            ids, scores = np.hstack([np.where(score > -np.inf, doors[top], -1), block.ids[at]]), np.hstack([score, near])
            pad = max(0, beam - ids.shape[1])
            block.ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
            block.scores = np.pad(scores.astype(np.float32), ((0, 0), (0, pad)), constant_values=-np.inf)
            first, out = Beam(list(block.parts())), Sender()
            out.add(bucket, QUERIES, *first.parts())
            yield out.batch()

    def visits(batches):
        """Queries go to the best nodes of their beams that aren't expanded yet."""
        for b in batches:
            for cols in zip(*(b.column(n).to_pylist() for n in NAMES[2:]), strict=True):
                q, out = Beam.read(cols), Sender()
                i, j = np.nonzero(q.open[:, :EXPAND])
                out.vectors(q.ids[i, j], VISITS, buckets, i, q.nodes, q.vectors, q.scale, q.scores[:, -1])
                yield out.batch()

    def spread(batches):
        """A visited node sends the query on to its neighbours, and to itself to be scored."""
        for _, kinds in by_bucket(batches):
            if STATE not in kinds or VISITS not in kinds:
                continue
            block, out = Block(kinds[STATE][0]), Sender()
            to, who, nodes, vectors, scale, limit = joined(kinds[VISITS])
            at = block.at(to)
            onward, back = np.append(block.ids[at].ravel(), to), np.append(np.repeat(who, block.ids.shape[1]), who)
            ok = (onward >= 0) & (onward != nodes[back])
            pair = np.unique(np.stack([onward[ok], back[ok]], 1), axis=0)
            out.vectors(np.ascontiguousarray(pair[:, 0]), ASKS, buckets, pair[:, 1], nodes, vectors, scale, limit)
            yield out.batch()

    def answers(batches):
        """Nodes that come nearer than a query's beam does answer it."""
        for _, kinds in by_bucket(batches):
            if STATE not in kinds or ASKS not in kinds:
                continue
            block, out = Block(kinds[STATE][0]), Sender()
            x = floats(block.vectors, block.scale)
            to, who, nodes, vectors, scale, limit = joined(kinds[ASKS])
            q, at = floats(vectors, scale), block.at(to)
            s = np.concatenate([np.einsum("ij,ij->i", x[at[a : a + 65536]], q[who[a : a + 65536]]) for a in range(0, len(at), 65536)])
            ok = s > limit[who]
            out.edges(nodes[who[ok]], ANSWERS, buckets, nodes[who[ok]], block.nodes[at[ok]], s[ok].astype("<f4"))
            yield out.batch()

    def take(batches):
        for bucket, kinds in by_bucket(batches):
            if QUERIES not in kinds:
                continue
            q, out = Beam.read(kinds[QUERIES][0]), Sender()
            tried = q.open.copy()
            tried[:, EXPAND:] = False
            q.open &= ~tried
            old = q.ids.ravel() >= 0
            u, v, s = [np.repeat(np.arange(len(q.nodes)), q.ids.shape[1])[old]], [q.ids.ravel()[old]], [q.scores.ravel()[old]]
            for c in kinds.get(ANSWERS, []):
                u.append(q.at(i8(c[0]))), v.append(i8(c[1])), s.append(f4(c[2]))
            shut_row, shut = np.nonzero(~q.open & (q.ids >= 0))[0], q.ids[~q.open & (q.ids >= 0)]
            q.ids, q.scores = table_of(np.concatenate(u), np.concatenate(v), np.concatenate(s), len(q.nodes), q.ids.shape[1])
            known = np.unique(shut)
            place = np.searchsorted(known, q.ids)
            seen = (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == q.ids) if len(known) else np.zeros(q.ids.shape, bool)
            code = np.arange(len(q.ids))[:, None] * (len(known) + 1) + place
            q.open = (q.ids >= 0) & ~(seen & np.isin(code, shut_row * (len(known) + 1) + np.searchsorted(known, shut)))
            out.add(bucket, QUERIES, *q.parts())
            yield out.batch()

    asked = C.map_arrow(queries.select("node"), lambda bs: _asked(bs, buckets), PACKET)
    now = C.staged(spark, C.map_arrow(exchanged(state.unionByName(asked)), start, PACKET), "ann-beams")
    for _ in range(hops):
        sent = C.map_arrow(exchanged(state.unionByName(C.map_arrow(now, visits, PACKET))), spread, PACKET)
        heard = C.map_arrow(exchanged(state.unionByName(sent)), answers, PACKET)
        new = C.staged(spark, C.map_arrow(exchanged(now.unionByName(heard)), take, PACKET), "ann-beams")
        C.drop(spark, now)
        now = new
        spark.sparkContext._jvm.System.gc()
        if C.map_arrow(now, _open, "n long").agg(F.sum("n")).first()[0] in (0, None):
            break

    def found(batches):
        for b in batches:
            for cols in zip(*(b.column(n).to_pylist() for n in NAMES[2:]), strict=True):
                q = Beam.read(cols)
                i, j = np.nonzero(q.ids[:, :EXACT] >= 0)
                yield pa.record_batch([pa.array(q.nodes[i]), pa.array(q.ids[i, j])], names=["query", "node"])
                yield pa.record_batch([pa.array(q.nodes), pa.array(q.nodes)], names=["query", "node"])  # its own node: other ids may share the vector

    return C.map_arrow(now, found, "query long, node long")


def _asked(batches, buckets: int):
    for b in batches:
        out, ids = Sender(), b.column("node").to_numpy()
        out.edges(ids, QUERIES, buckets, ids)
        yield out.batch()


def _open(batches):
    for b in batches:
        n = 0
        for cols in zip(*(b.column(n).to_pylist() for n in NAMES[2:]), strict=True):
            n += int(Beam.read(cols).open[:, :EXPAND].sum())
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", divisor: int = DIVISOR, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each id divisible by ``divisor``."""
    spark = vectors.sparkSession
    known = of_one_length(C.staged(spark, nodes_of(vectors, id_col, vec_col, top + 1), "ann-nodes"))
    buckets = max(8, -(-known.count() // BLOCK))
    asked = vectors.where(F.col(id_col) % divisor == 0).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))

    def hashed(batches):
        for b in batches:
            got = [(i, xxhash.xxh64_intdigest(v) >> 1) for i, v in zip(b.column("id").to_pylist(), vector_bytes(b.column("vec")), strict=True) if v is not None]
            yield pa.record_batch([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["query_id", "h"])

    of_query = C.map_arrow(asked, hashed, "query_id long, h long").distinct().join(known.select("h", "node"), "h").select("query_id", F.col("node").alias("query"))
    of_query = C.staged(spark, of_query, "ann-queries")
    doors, door, length = longest(known)
    state = graph(known.select("node", "vec"), buckets, length)
    pairs = search(state, of_query.select(F.col("query").alias("node")).distinct(), buckets, (doors, door.astype(np.float32)))

    def exact(batches):
        for b in batches:
            if b.num_rows:
                s = np.einsum("ij,ij->i", matrix(b.column("vec")), matrix(b.column("own")))
                yield pa.record_batch([b.column("query"), b.column("node"), b.column("ids"), pa.array(s)], names=["query", "node", "ids", "score"])

    met = pairs.join(known.select("node", "vec", "ids"), "node").join(known.select(F.col("node").alias("query"), F.col("vec").alias("own")), "query")
    scored = C.map_arrow(met.select("query", "node", "ids", "vec", "own"), exact, "query long, node long, ids array<long>, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    near = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1)  # no node further off can be among a query's ``top`` rows
    rows = of_query.join(near, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(C.table(spark, sf_dir, "embeddings"))
