"""Chroma audio fingerprints of a media column (operator 5).

A recording (a WAV file, or raw 16-bit mono samples) becomes frames of twelve pitch
classes.  An integral image over those frames gives the sum of any rectangle in four
look-ups; sixteen fixed filters compare rectangles at every frame, and each filter's
two bits make up one packed 32-bit number a frame.  Two recordings are aligned by the
offset at which most of their numbers agree (a histogram of offsets), and judged by
the share of bits that differ over the whole overlap at that offset.

Searches take blocks of queries, of bounded size, against all fingerprints: each
block's numbers are sorted once, and every recording looks its own up there, so no
list of common numbers is ever joined with itself.

Null, empty, unreadable and wholly silent recordings, and those shorter than the
widest filter, have an empty fingerprint and match nothing.  Silence at the ends is
no part of a fingerprint.  Equal recordings match at offset 0 without a differing
bit.  Ties between offsets go to the least shift.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RATE, FRAME, HOP = 4000, 1024, 256
LOWEST, HIGHEST, SILENCE = 60.0, 1900.0, 1e-4
#: Fixed values: (kind, first pitch class, pitch classes, frames) of each filter.  Kinds: 0 all against
#: the mean, 1 upper against lower half, 2 earlier against later half, 3 crosswise quarters, 4 middle
#: against outer thirds in pitch, 5 the same in time.
FILTERS = ((0, 0, 3, 12), (0, 4, 3, 12), (0, 8, 3, 12), (1, 0, 4, 10), (1, 3, 4, 10), (1, 6, 4, 10), (1, 8, 4, 10), (2, 0, 4, 12), (2, 4, 4, 12), (2, 8, 4, 12), (3, 0, 6, 12), (3, 6, 6, 12), (4, 0, 6, 12), (4, 5, 6, 12), (5, 1, 5, 12), (5, 7, 5, 12))
WIDEST = 12
LEVELS = (-0.35, 0.0, 0.35)
QUERIES, MIN_HITS, MIN_OVERLAP, MAX_ERROR = 4096, 4, 48, 0.3


def samples(media: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and their rate."""
    if not media:
        return np.empty(0), RATE
    if media[:4] == b"RIFF":
        try:
            with wave.open(io.BytesIO(media)) as w:
                if w.getsampwidth() != 2:
                    return np.empty(0), RATE
                raw, channels, rate = w.readframes(w.getnframes()), w.getnchannels(), w.getframerate()
        except (wave.Error, EOFError):
            return np.empty(0), RATE
    else:
        raw, channels, rate = media, 1, RATE
    x = np.frombuffer(raw[: len(raw) - len(raw) % (2 * channels)], "<i2").reshape(-1, channels).mean(axis=1) / 32768
    return x, rate


def resampled(x: np.ndarray, rate: int) -> np.ndarray:
    """At RATE samples a second, by straight lines between samples (after a mean over each new one's span)."""
    if rate == RATE or not len(x):
        return x
    if rate > RATE:
        span = max(1, rate // RATE)
        x = np.convolve(x, np.full(span, 1 / span), "same")
    return np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)


def _classes() -> tuple[slice, list[np.ndarray]]:
    """The spectral bins that count, and which of them count for each pitch class."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    at = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    of = np.round(12 * np.log2(f[at] / 440)).astype(int) % 12
    return slice(at[0], at[-1] + 1), [np.flatnonzero(of == k) for k in range(12)]


_BINS, _OF_CLASS = _classes()
_WINDOW = np.hanning(FRAME)


def chroma(x: np.ndarray) -> np.ndarray:
    """Pitch-class frames of unit length, smoothed in time; silent ones are zero, those at the ends left out."""
    if len(x) < FRAME:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    loud = np.sqrt((frames * frames).mean(axis=1)) > SILENCE
    if not loud.any():
        return np.empty((0, 12))
    first, last = np.flatnonzero(loud)[[0, -1]]
    spectrum = np.fft.rfft(frames[first : last + 1] * _WINDOW, axis=1)[:, _BINS]
    power = spectrum.real**2 + spectrum.imag**2
    c = np.zeros((len(power), 12))
    for k in range(12):  # sums over the bins of a class, without a matrix product's threads
        c[:, k] = power[:, _OF_CLASS[k]].sum(axis=1)
    c[~loud[first : last + 1]] = 0
    padded = np.pad(c, ((2, 2), (0, 0)))
    c = sum(w * padded[i : i + len(c)] for i, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-12, c / np.maximum(norm, 1e-12), 0)


def fingerprint(media: bytes | None) -> np.ndarray:
    """Packed numbers (uint32), one a frame that the widest filter fits after."""
    c = chroma(resampled(*samples(media)))
    n = len(c) - WIDEST + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t: int, w: int, y: int, h: int) -> np.ndarray:
        """Mean over frames t..t+w after each frame, classes y..y+h."""
        return (image[at + t + w, y + h] - image[at + t, y + h] - image[at + t + w, y] + image[at + t, y]) / (w * h)

    out = np.zeros(n, np.uint32)
    for k, (kind, y, h, w) in enumerate(FILTERS):
        if kind == 0:
            a, b = area(0, w, y, h), area(0, w, 0, 12)
        elif kind == 1:
            a, b = area(0, w, y, h // 2), area(0, w, y + h // 2, h - h // 2)
        elif kind == 2:
            a, b = area(0, w // 2, y, h), area(w // 2, w - w // 2, y, h)
        elif kind == 3:
            a = area(0, w // 2, y, h // 2) + area(w // 2, w // 2, y + h // 2, h // 2)
            b = area(0, w // 2, y + h // 2, h // 2) + area(w // 2, w // 2, y, h // 2)
        elif kind == 4:
            a, b = area(0, w, y + h // 3, h // 3), (area(0, w, y, h // 3) + area(0, w, y + 2 * (h // 3), h // 3)) / 2
        else:
            a, b = area(w // 3, w // 3, y, h), (area(0, w // 3, y, h) + area(2 * (w // 3), w // 3, y, h)) / 2
        level = np.searchsorted(LEVELS, np.log((np.maximum(a, 0) + 0.02) / (np.maximum(b, 0) + 0.02)))
        out = (out << np.uint32(2)) | np.array([0, 1, 3, 2], np.uint32)[level]  # neighbouring levels differ in one bit
    return out


def _printed(batches):
    for b in batches:
        yield pa.record_batch([b.column("id"), C.binary_column([fingerprint(m).astype("<u4").tobytes() for m in b.column("media").to_pylist()])], names=["id", "fingerprint"])


def fingerprints(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, fingerprint as packed little-endian uint32) of every recording."""
    return C.map_arrow(media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")), _printed, "id long, fingerprint binary")


class Queries:
    """A block of fingerprints, indexed by their numbers."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in rows]
        self.prints = [np.frombuffer(p, "<u4") for _, p in rows]
        number = np.concatenate([*self.prints, np.empty(0, np.uint32)])
        which = np.repeat(np.arange(len(rows)), [len(p) for p in self.prints])
        place = np.concatenate([*(np.arange(len(p)) for p in self.prints), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(number, kind="stable")
        self.number, self.which, self.place = number[order], which[order], place[order]

    def aligned(self, own: int, p: np.ndarray, block: int = 1_000_000):
        """(query id, offset, hits, overlap, bit error) of the queries that align with a fingerprint."""
        lo, hi = np.searchsorted(self.number, p, "left"), np.searchsorted(self.number, p, "right")
        if not (hi > lo).any():
            return
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        cuts = np.searchsorted(np.cumsum(hi - lo), np.arange(block, int((hi - lo).sum()) + block, block)) + 1
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            n = (hi - lo)[a:b]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:b], n)
            offset = np.repeat(np.arange(a, min(b, len(p))), n) - self.place[at]
            key, count = np.unique((self.which[at] << 32) + offset + (1 << 31), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, count]), len(keys)).astype(np.int64)
        offset = (keys & 0xFFFFFFFF) - (1 << 31)
        order = np.lexsort((offset, np.abs(offset), -counts, keys >> 32))
        start, _ = C.runs((keys >> 32)[order])
        for o in order[start].tolist():
            if counts[o] < MIN_HITS or self.ids[q := int(keys[o] >> 32)] == own:
                continue
            shift, query = int(offset[o]), self.prints[q]
            first, last = max(0, shift), min(len(p), shift + len(query))
            overlap = last - first
            if overlap < MIN_OVERLAP:
                continue
            error = float(np.bitwise_count(p[first:last] ^ query[first - shift : last - shift]).sum() / (32 * overlap))
            if error <= MAX_ERROR:
                yield self.ids[q], shift, int(counts[o]), overlap, error


def query_blocks(queries: DataFrame, block: int):
    """The queries' (id, fingerprint), some ``block`` at a time: what the driver holds doesn't grow with their number."""
    asked = queries.where("id is not null and length(fingerprint) > 0").select("id", "fingerprint").distinct()
    n = max(1, -(-asked.count() // block))
    for b in range(n):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).orderBy("id").collect()
        if rows:
            yield [(r["id"], bytes(r["fingerprint"])) for r in rows]


def align(prints: DataFrame, queries: DataFrame, block: int = QUERIES) -> DataFrame:
    """query_id, match_id, offset_frames, hits, overlap, bit_error: recordings that align with a query."""
    spark = prints.sparkSession
    ddl = "query_id long, match_id long, offset_frames int, hits int, overlap int, bit_error double"
    out = spark.createDataFrame([], ddl)
    for rows in query_blocks(queries, block):
        shared = spark.sparkContext.broadcast(rows)  # some ``block`` fingerprints

        def run(batches, shared=shared):
            known = Queries(shared.value)
            for batch in batches:
                got = [(q, i, *rest) for i, p in zip(batch.column("id").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True) if p and i is not None for q, *rest in known.aligned(i, np.frombuffer(p, "<u4"))]
                cols = list(zip(*got, strict=True)) or [[]] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["query_id", "match_id", "offset_frames", "hits", "overlap", "bit_error"])

        out = out.unionByName(C.map_arrow(prints.select("id", "fingerprint"), run, ddl))
    return out


def linked(prints: DataFrame, queries: DataFrame, block: int = QUERIES) -> DataFrame:
    """id, n_frames, n_links, best_query, offset_frames, overlap, bit_error: every recording with the number of
    queries that align with it, and the best of them (least bit error, then least query id).

    A recording's alignments are summed up where they are found, so a group of copies makes one row a
    recording and block of queries, not all its pairs.
    """
    spark = prints.sparkSession
    ddl = "id long, n_links long, bit_error double, best_query long, offset_frames int, overlap int"
    size = prints.select("id", (F.length("fingerprint") / 4).cast("int").alias("n_frames"))
    each = None
    for rows in query_blocks(queries, block):
        shared = spark.sparkContext.broadcast(rows)  # some ``block`` fingerprints

        def run(batches, shared=shared):
            known = Queries(shared.value)
            for batch in batches:
                got = []
                for i, p in zip(batch.column("id").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                    found = sorted((e, q, shift, overlap) for q, shift, _, overlap, e in known.aligned(i, np.frombuffer(p, "<u4"))) if p and i is not None else []
                    if found:
                        e, q, shift, overlap = found[0]
                        got.append((i, len(found), e, q, shift, overlap))
                cols = list(zip(*got, strict=True)) or [[]] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "n_links", "bit_error", "best_query", "offset_frames", "overlap"])

        part = C.map_arrow(prints.select("id", "fingerprint"), run, ddl)
        each = part if each is None else each.unionByName(part)
    if each is None:
        each = spark.createDataFrame([], ddl)
    best = F.min(F.struct("bit_error", "best_query", "offset_frames", "overlap")).alias("b")
    found = each.distinct().groupBy("id").agg(F.sum("n_links").alias("n_links"), best)
    return size.join(found, "id", "left").select("id", "n_frames", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("b.best_query").alias("best_query"), F.col("b.offset_frames").alias("offset_frames"), F.col("b.overlap").alias("overlap"), F.round("b.bit_error", 9).alias("bit_error"))


def searched(prints: DataFrame, divisor: int = 50, block: int = QUERIES) -> DataFrame:
    """id, n_frames, class_id, query_class, offset_frames, hits, overlap, bit_error: every recording with its class of
    equal fingerprints (named by its least id), and every alignment of a class that holds a query (an id divisible
    by ``divisor``) with another class.

    Alignments stand at the class's least id, a row each, and hold for all its members; other recordings have one row
    and nulls.  Members of one class align at offset 0 without a differing bit.  A recording without a fingerprint has
    no class.  So copies are never expanded into pairs, and no link between different recordings goes.
    """
    heard = prints.where("id is not null and length(fingerprint) > 0")
    classes = heard.groupBy("fingerprint").agg(F.min("id").alias("class_id"), F.max(F.col("id") % divisor == 0).alias("asked"))
    classes = C.staged(prints.sparkSession, classes, "fingerprint-classes")
    each = classes.select(F.col("class_id").alias("id"), "fingerprint", "asked")
    found = align(each, each.where("asked"), block).select(F.col("match_id").alias("class_id"), F.col("match_id").alias("id"), F.col("query_id").alias("query_class"), "offset_frames", "hits", "overlap", F.round("bit_error", 9).alias("bit_error"))
    members = prints.join(classes.select("fingerprint", "class_id"), "fingerprint", "left").select("id", (F.length("fingerprint") / 4).cast("int").alias("n_frames"), "class_id").distinct()
    return members.join(found, ["class_id", "id"], "left").select("id", "n_frames", "class_id", "query_class", "offset_frames", "hits", "overlap", "bit_error")


# --------------------------------------------------------------------------- recordings for tables without media

NOTE = 512


def tune(steps: np.ndarray) -> bytes:
    """A tune of three-semitone steps as 16-bit samples: two partials a note, with a soft start and end."""
    t = np.arange(NOTE) / RATE
    shape = np.minimum(1, np.minimum(np.arange(NOTE), NOTE - 1 - np.arange(NOTE)) / 40)
    notes, which = np.unique(np.clip(steps, -4, 9), return_inverse=True)  # a note sounds alike wherever it stands
    f = 110 * 2.0 ** (notes * 3 / 12)[:, None]
    x = (np.sin(2 * np.pi * f * t) + 0.4 * np.sin(4 * np.pi * f * t)) * shape
    return (x * 12000).astype("<i2")[which].tobytes()


def tune_of(i: int | None, v: list | None) -> bytes | None:
    """The recording of one vector; None for an unusable one."""
    if not v or any(x is None or x != x or abs(x) == float("inf") for x in v):
        return None
    x = np.array(v, np.float64)
    scale = np.sqrt((x * x).mean()) or 1.0
    lead = (np.arange((i or 0) % 4) * 5 + 2) % 11 - 3
    return tune(np.concatenate([lead, 2 + np.round(2 * x / scale)]))


def _played(batches):
    for b in batches:
        ids, vectors = b.column("id").to_pylist(), b.column("vec").to_pylist()
        for at in range(0, len(ids), 200):  # recordings are large
            part = slice(at, at + 200)
            yield pa.record_batch([pa.array(ids[part], pa.int64()), C.binary_column([tune_of(i, v) for i, v in zip(ids[part], vectors[part], strict=True)])], names=["id", "media"])


def played(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, media): each vector played as a tune, a note a component, after a few notes that depend on the id.

    The tables hold no recordings; this gives each row one, alike for alike vectors and shifted
    against each other.  Unusable vectors give a null.
    """
    return C.map_arrow(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), _played, "id long, media binary")


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    # played and printed in one pass: the recordings are never stored
    prints = C.staged(spark, C.map_arrow(vectors, lambda batches: _printed(_played(batches)), "id long, fingerprint binary"), "fingerprints")
    return searched(prints).withColumnRenamed("id", "vec_id")
