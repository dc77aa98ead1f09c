"""Quality classifier: nearest-neighbour voting in a latent-semantic space (operator 3).

A document's terms are trigrams of character classes (letter case, digits, the
kinds of punctuation) and how often words repeat, so they hold for any language.
A singular value decomposition of the labelled documents' term matrix gives the
latent space.  The labelled vectors, at most ``2 * per_class`` of them, are
broadcast; every document's exact cosine products with all of them are computed
block by block, and the nearest labels vote, weighted by similarity.

Bound of the fit: ``per_class`` labelled rows of each class.  Everything else
covers all rows.  Null text counts as empty; an empty text gets a score as any
other.  Without labels of both classes, nothing speaks against a document: the
score is then the only known label, or 1.0.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .labelled import in_fold, sample

PARTS, HELD, THRESHOLD = 4, 2, 0.7
CLASSES, RATIOS = 16, 24
WIDTH = CLASSES**3 + 2 * RATIOS
OUT = "doc_id long, held_out boolean, score double, predicted int"


def _class_of_bytes() -> np.ndarray:
    of = np.full(256, 13, np.int64)  # other punctuation and control characters
    for c, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".", ",;:", "!", "?", "|", "*", "#$%&@", "-_'\"")):
        of[list(chars.encode())] = c
    of[128:192], of[192:] = 14, 15
    return of


CLASS_OF = _class_of_bytes()


def terms(text: str) -> np.ndarray:
    """Term weights of a text, of unit length (zero for an empty one): square roots of shares, so that
    a product of two texts' weights measures how alike their distributions are."""
    out = np.zeros(WIDTH, np.float32)
    c = CLASS_OF[np.frombuffer(f" {text} ".encode(), np.uint8)]
    code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    if len(code):
        out[: CLASSES**3] = np.sqrt(np.bincount(code, minlength=CLASSES**3) / len(code))
    words = text.split()
    if len(words) > 1:
        again = sum(map(eq, words, words[1:])) / (len(words) - 1)
        few = len(set(words)) / len(words)
        for i, x in enumerate((again, 1 - few)):
            at = min(int(np.sqrt(x) * (RATIOS - 2)), RATIOS - 3) + 1  # in the middle of three neighbouring bins
            base = CLASSES**3 + i * RATIOS
            out[base + at - 1 : base + at + 2] += (0.25, 0.45, 0.25)
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def _packed(v: np.ndarray) -> bytes:
    at = np.flatnonzero(v).astype("<u2")
    return at.tobytes() + v[at].astype("<f4").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    n, out = len(b) // 6, np.zeros(WIDTH, np.float32)
    out[np.frombuffer(b, "<u2", n)] = np.frombuffer(b, "<f4", n, 2 * n)
    return out


class Model:
    """Latent axes, labelled vectors, their labels and the weight of a vote of each class."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, counts: dict[int, int], dims: int, neighbours: int):
        self.mean = rows.mean(axis=0)
        self.axes = self._axes(rows - self.mean, min(dims, *rows.shape))
        self.points = self._unit((rows - self.mean) @ self.axes)
        share = np.array([max(1, counts.get(c, 0)) / max(1, (labels == c).sum()) for c in (0, 1)])
        self.labels, self.weight, self.neighbours = labels.astype(np.float32), (share / share.max())[labels].astype(np.float32), min(neighbours, len(labels))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)

    @staticmethod
    def _axes(rows: np.ndarray, dims: int) -> np.ndarray:
        """Leading right singular vectors, by subspace iteration from a fixed start."""
        basis = np.random.default_rng(7).standard_normal((rows.shape[1], dims + 8)).astype(np.float32)
        for _ in range(5):
            basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
        _, _, v = np.linalg.svd(rows @ basis, full_matrices=False)
        return (basis @ v.T)[:, :dims].astype(np.float32)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors of each row."""
        sims = self._unit((rows - self.mean) @ self.axes) @ self.points.T
        k = self.neighbours
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), (len(rows), k))
        w = np.maximum(np.take_along_axis(sims, near, 1), 1e-3) ** 4 * self.weight[near]
        return (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, dims: int = 48, neighbours: int = 15) -> Model | float:
    """The model, or one score for all where a class has no labelled document."""
    rows, counts = sample(C.docs_of(docs), labels, "quality", PARTS, HELD, per_class)

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column("label"), C.binary_column([_packed(terms(t)) for t in C.texts_of(b.column("text"))])], names=["label", "terms"])

    got = C.map_arrow(rows.select("text", "label"), run, "label int, terms binary").toArrow()
    y = np.array(got["label"].to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 1.0
    x = np.array([_unpacked(b) for b in got["terms"].to_pylist()])
    order = np.lexsort((x @ np.linspace(0, 1, WIDTH, dtype=np.float32), y))  # one order, however the rows came
    return Model(x[order], y[order], counts, dims, neighbours)


def score(docs: DataFrame, model: Model | float, block: int = 512) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * per_class vectors of ``dims`` numbers, and the axes

    def run(batches):
        m = shared.value
        for b in batches:
            texts, out = C.texts_of(b.column("text")), []
            for i in range(0, len(texts), block):
                part = texts[i : i + block]
                out += [m] * len(part) if isinstance(m, float) else m.scores(np.array([terms(t) for t in part])).tolist()
            s = np.clip(np.round(np.array(out, np.float64), 6), 0, 1)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return C.map_arrow(C.docs_of(docs).select("doc_id", in_fold(F.col("doc_id"), PARTS, HELD).alias("held_out"), "text"), run, OUT)


def keep_good(docs: DataFrame, model: Model | float) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text is not rejected."""
    C.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts, out = C.texts_of(b.column("text")), []
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                out += [m] * len(part) if isinstance(m, float) else m.scores(np.array([terms(t) for t in part])).tolist()
            yield b.filter(pa.array(np.round(np.array(out, np.float64), 6) >= THRESHOLD))

    return C.map_arrow(docs, run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
