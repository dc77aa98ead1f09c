"""Packing token sequences along a space-filling curve (operator 9).

Each document's token counts are hashed into a fixed number of features, the
hashed vector is projected to a few dimensions, and the point's place on a
Hilbert curve becomes its sort key.  A range sort by (key, doc_id) puts alike
documents next to each other; each range is then cut into sequences as one
stream, so neighbours on the curve share sequences and a document is cut only
where a sequence is full.  The last tokens of a range go to sequences whose
lengths are powers of two, which need no padding.

Null text: the document is its end token alone.  Repeated rows are packed as
often as they occur.  Ties on the curve are broken by doc_id.  An empty table
gives an empty one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import common as C

FEATURES, DIMS, BITS = 1024, 3, 16
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection(features: int = FEATURES, dims: int = DIMS) -> np.ndarray:
    """A fixed random projection of signs."""
    bits = C.mix64(np.arange(features * dims, dtype=np.uint64) + np.uint64(1)) >> np.uint64(63)
    return (bits.astype(np.float64) * 2 - 1).reshape(features, dims)


def place(ids: np.ndarray, buckets: np.ndarray, proj: np.ndarray) -> np.ndarray:
    """The point of a document: its hashed, square-root damped and normalised counts, projected.

    Each coordinate is about a standard normal variable; the logistic squash spreads it over 0..1.
    """
    v = np.sqrt(np.bincount(buckets[ids], minlength=len(proj)))
    z = v @ proj / max(np.sqrt((v * v).sum()), 1e-12)
    return 1 / (1 + np.exp(-1.7 * z))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index (int64) of points in the unit cube, row by row.

    Gray-code form of the curve: per bit plane the axes are exchanged or inverted so
    that consecutive indices are neighbouring cells.
    """
    n, dims = points.shape
    x = np.clip((points * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix, q = np.zeros(n, np.int64), 1 << (bits - 1)
    while q > 1:
        fix ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= fix
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, key, n, ids): each document's tokens with the end token, and its place on the curve."""
    spec = bpe.spec_of(docs.sparkSession, tokenizer_path)

    def run(batches):
        enc, proj = bpe.encoder(spec.value), projection()
        buckets = (C.mix64(np.arange(max(enc.size, end_id + 1), dtype=np.uint64)) % np.uint64(FEATURES)).astype(np.int64)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            ids, points = [], []
            for packed in enc.encode_batch(C.texts_of(batch.column("text"))):
                points.append(place(np.frombuffer(packed, "<u4"), buckets, proj))
                ids.append(packed + end)
            keys = hilbert(np.array(points)) if points else np.empty(0, np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), C.binary_column([_narrow(x) for x in ids])], names=["doc_id", "key", "n", "ids"])

    return C.map_arrow(C.docs_of(docs), run, "doc_id long, key long, n long, ids binary")


def _narrow(packed: bytes) -> bytes:
    """Two bytes an id where they suffice (a leading byte tells), for less to store and shuffle."""
    ids = np.frombuffer(packed, "<u4")
    return b"\2" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\4" + packed


def _wide(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, f"<u{stored[0]}", offset=1).astype("<u4")


def cut(lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents of these lengths, laid end to end and cut into sequences.

    Returns document index, start in it, length, sequence number and offset of each piece.
    Full sequences of ``size`` come first; the rest of the stream is cut at descending powers of two.
    """
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    bounds = np.arange(0, total - total % size + 1, size, dtype=np.int64)
    rest = total % size
    tail = [bounds[-1]]
    for p in range(size.bit_length(), -1, -1):
        if rest >> p & 1:
            tail.append(tail[-1] + (1 << p))
    bounds = np.concatenate([bounds, np.array(tail[1:], np.int64)])
    marks = np.unique(np.concatenate([bounds, ends]))
    begin, end = marks[:-1], marks[1:]
    doc = np.searchsorted(ends, begin, side="right")
    seq = np.searchsorted(bounds, begin, side="right") - 1
    return doc, begin - (ends - lengths)[doc], end - begin, seq, begin - bounds[seq]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of ``size`` tokens (a power of two).

    The tokens are written once to the shared folder; the range sort reads them from there, so
    its sampling pass does not encode anything again, nor does a lost executor.
    """
    spark = docs.sparkSession
    tokens = C.staged(spark, tokenised(docs, tokenizer_path, end_id), "packing-tokens")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, min(1 << 20, -(-total // 3_000_000)))  # some 6 MB of ids in each, at any size of the input

    def run(batches):
        part, seq0 = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[int, int, np.ndarray]] = []  # what is left of the documents of the open sequence: id, start, ids

        def emit(upto: int | None):
            """Cut what is held into full sequences, or all of it at the end."""
            nonlocal held, seq0
            lengths = np.array([len(x[2]) for x in held], np.int64)
            whole = int(lengths.sum()) if upto is None else upto
            ends = np.cumsum(lengths)
            last = int(np.searchsorted(ends, whole)) + 1
            use = lengths[:last].copy()
            use[-1] -= ends[last - 1] - whole
            doc, start, length, seq, offset = cut(use, size)
            rows = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for d, s, n, q, o in zip(doc.tolist(), start.tolist(), length.tolist(), seq.tolist(), offset.tolist(), strict=True):
                i, begin, ids, of = held[d]
                for c, v in zip(rows, (i, begin + s, n, zlib.crc32(ids[s : s + n].tobytes()), of, part + seq0 + q, o), strict=True):
                    rows[c].append(v)
            seq0 += int(seq[-1]) + 1
            i, begin, ids, of = held[last - 1]
            left = [(i, begin + int(use[-1]), ids[int(use[-1]) :], of)] if use[-1] < len(ids) else []
            held = left + held[last:]
            return pa.record_batch([pa.array(v, pa.int64()) for v in rows.values()], names=list(rows))

        tokens_held = 0
        for batch in batches:
            for i, stored in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = _wide(stored)
                held.append((i, 0, ids, len(ids)))
                tokens_held += len(ids)
                if tokens_held >= 1 << 20:
                    full = tokens_held - tokens_held % size
                    yield emit(full)
                    tokens_held -= full
        if tokens_held:
            yield emit(None)

    along = tokens.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "ids")
    return C.map_arrow(along, run, OUT)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"), bpe.default_path())
