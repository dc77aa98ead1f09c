"""Toxicity: a subsequence string-kernel machine with Nyström landmarks (operator 8).

The kernel compares two strings by the three-letter subsequences they share, each
weighted by a power of the span it takes up, so gaps and inserted characters only
dampen a match.  Sentences carry their document's label; the words that stand out
in the sentences of one label are the examples.  Kernel values to a bounded set of
landmark words, whitened (Nyström), are the features of a linear support vector
machine.  As the kernel is a product of explicit subsequence weights, the machine's
sum over landmarks folds into one weight a subsequence, and a word costs a few
table look-ups.  A document scores by its worst word, through a logistic curve.

Bounds of the fit: ``per_class`` labelled documents of each class, ``MAX_WORDS``
example words, ``LANDMARKS`` landmarks.  All words of all whole texts are scored.
Null text counts as empty; an empty text gets the score of a harmless word.
Without labels of both classes the score is the only known label, or 0.0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .labelled import in_fold, sample

PARTS, HELD, THRESHOLD = 5, 0, 0.5
LANDMARKS, MAX_WORDS = 256, 12_000
LETTERS, SPAN, DECAY, WINDOW = 48, 6, 0.7, 24
OUT = "doc_id long, held_out boolean, score double, predicted int"
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t.\-_]+){3,}\S(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+\s*")


def letters(word: str) -> np.ndarray:
    """Letter numbers: a to z, then other letters by a rule, digits, and all else as one."""
    out = np.empty(len(word), np.int64)
    for i, c in enumerate(word):
        o = ord(c)
        out[i] = o - 97 if 97 <= o <= 122 else 46 if c.isdigit() else 26 + o % 20 if c.isalpha() else 47
    return out


def strings_of(text: str) -> set[str]:
    """The distinct tokens of a text, and runs of spaced-out single characters drawn together."""
    low = text.lower()
    out = set(low.split())
    for m in _SPACED.finditer(low):
        out.add("".join(x for x in m[0] if x.isalnum()))
    return out


def windows(token: str) -> list[str]:
    """A token without outer punctuation; a very long one as overlapping windows, none left out."""
    w = token.strip(".,;:!?\"'()[]{}*#$%&|<>-_=+/\\`~")
    return [w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]


def _shape(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index triples i < j < k within SPAN of a string of n letters, with weights scaled by the string's own size."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN - 1)) for k in range(j + 1, min(n, i + SPAN))]
    i, j, k = (np.array(x, np.int64) for x in zip(*at, strict=True))
    w = DECAY ** (k - i - 2.0)
    return i, j, k, w / np.sqrt((w * w).sum())


_SHAPES: dict[int, tuple] = {}


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes (a row a word) and their weights, for words of one length of at least 3."""
    n = len(words[0])
    if n not in _SHAPES:
        _SHAPES[n] = _shape(n)
    i, j, k, w = _SHAPES[n]
    c = np.concatenate([letters(x) for x in words]).reshape(len(words), n)
    return (c[:, i] * LETTERS + c[:, j]) * LETTERS + c[:, k], w


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= 3:
            out.setdefault(len(w), []).append(i)
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The string kernel of words by landmarks."""
    used: dict[int, int] = {}
    rows = []
    for m, ix in enumerate(landmarks):
        if len(ix) >= 3:
            c, w = codes([ix])
            rows += [(used.setdefault(int(a), len(used)), m, b) for a, b in zip(c[0], w, strict=True)]
    table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for a, m, b in rows:
        table[a, m] += b
    index = np.full(LETTERS**3, len(used), np.int64)
    index[list(used)] = list(used.values())
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in _by_length(words).values():
        for s in range(0, len(at), 256):
            part = at[s : s + 256]
            c, w = codes([words[i] for i in part])
            rows_of = index[c]
            for f in range(c.shape[1]):
                out[part] += w[f] * table[rows_of[:, f]]
    return out


class Model:
    """One weight a subsequence, the bias, and the logistic curve."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 4.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def words(self, words: list[str]) -> np.ndarray:
        """Decision values; a string of fewer than three letters has no subsequence and gets the bias."""
        out = np.full(len(words), self.bias)
        for at in _by_length(words).values():
            for s in range(0, len(at), 2048):
                part = at[s : s + 2048]
                c, w = codes([words[i] for i in part])
                out[part] = self.weights[c] @ w + self.bias
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -60, 60)))


class Scorer:
    """Worst decision value of texts; tokens seen before are remembered up to a bound."""

    limit = 120_000

    def __init__(self, model: Model):
        self.model, self.known, self.older = model, {}, {}

    def learn(self, tokens: set[str]) -> None:
        order = list(tokens)
        parts = [windows(t) for t in order]
        values = self.model.words([p for ps in parts for p in ps]).tolist()
        at = 0
        for t, ps in zip(order, parts, strict=True):
            self.known[t] = max(values[at : at + len(ps)]) if len(ps) != 1 else values[at]
            at += len(ps)

    def worst(self, texts: list[str], block: int = 256) -> np.ndarray:
        out = []
        for i in range(0, len(texts), block):
            sets = [strings_of(t) for t in texts[i : i + block]]
            seen = set().union(*sets)
            new = seen - self.known.keys()
            if len(self.known) + len(new) > self.limit:
                self.older, self.known, new = self.known, {}, seen
            back = new & self.older.keys()
            self.known.update((t, self.older[t]) for t in back)
            if len(new) > len(back):
                self.learn(new - back)
            out += [max(map(self.known.__getitem__, s), default=self.model.bias) for s in sets]
        return np.array(out)


def _newton(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps on the active rows."""
    w = np.zeros(x.shape[1])
    objective = lambda v: (cost * np.maximum(0, 1 - y * (x @ v)) ** 2).sum() + ridge * v @ v
    for _ in range(25):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xa, ca = x[on], cost[on]
        grad = -2 * xa.T @ (ca * y[on] * slack[on]) + 2 * ridge * w
        if np.abs(grad).max() < 1e-6:
            break
        step = np.linalg.solve(2 * (xa * ca[:, None]).T @ xa + 2 * ridge * np.eye(len(w)), grad)
        t, here = 1.0, objective(w)
        while t > 1e-4 and objective(w - t * step) > here:
            t /= 2
        w = w - t * step
    return w


def machine(positive: list[tuple[str, float]], negative: list[tuple[str, float]], ridge: float = 1e-3) -> Model:
    """Nyström features from landmarks of both classes, the machine, and its weights by subsequence."""
    half = LANDMARKS // 2
    marks = sorted({w for w, _ in positive[:half]} | {w for w, _ in negative[: LANDMARKS - half]})
    words = [w for w, _ in positive] + [w for w, _ in negative]
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.concatenate([np.array([c for _, c in part]) / sum(c for _, c in part) for part in (positive, negative)])
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-4 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    x = np.hstack([kernel(words, marks) @ whiten, np.ones((len(words), 1))])
    w = _newton(x, y, cost, ridge)
    alpha = whiten @ w[:-1]
    weights = np.zeros(LETTERS**3)
    for a, m in zip(alpha, marks, strict=True):
        if len(m) >= 3:
            c, v = codes([m])
            np.add.at(weights, c[0], a * v)
    return Model(weights, float(w[-1]))


def _logistic(worst: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from worst decision values to labels."""
    a, b = 3.0, 0.0
    x = np.stack([worst, np.ones(len(worst))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * worst + b, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([1e-3, 1e-6]) * weight.sum()
        g = x.T @ (weight * (p - y)) + np.array([1e-3 * a, 0]) * weight.sum()
        da, db = np.linalg.solve(h, g)
        a, b = float(np.clip(a - da, 0.2, 30)), float(np.clip(b - db, -60, 60))
    return a, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model | float:
    """The machine, or one score for all where a class has no labelled document."""
    rows, counts = sample(C.docs_of(docs), labels, "toxic", PARTS, HELD, per_class)
    rows = rows.select("text", "label").persist()  # bounded by the sample

    def sentences(batches):
        import xxhash

        for b in batches:
            word, label, where = [], [], []
            for text, y in zip(C.texts_of(b.column("text")), b.column("label").to_pylist(), strict=True):
                for sentence in set(_SENTENCE.split(text)):
                    tokens = ["", *sentence.lower().split(), ""]
                    tokens[1:1] = strings_of(sentence) - set(tokens)
                    for before, t, after in zip(tokens, tokens[1:-1], tokens[2:], strict=False):
                        for w in windows(t):
                            if len(w) >= 3:
                                word.append(w), label.append(y), where.append(xxhash.xxh64_intdigest(f"{before} {after}") >> 1)
            yield pa.record_batch([pa.array(word, pa.string()), pa.array(label, pa.int32()), pa.array(where, pa.int64())], names=["word", "label", "context"])

    try:
        seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(seen) < 2:
            return float(next(iter(seen))) if seen else 0.0
        # a word between the same neighbours counts once, so that copies of a document add nothing
        stats = C.map_arrow(rows, sentences, "word string, label int, context long").distinct().groupBy("word").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).persist()
        lift = ((F.col("bad") + 0.5) / F.lit(float(seen[1]))) / ((F.col("good") + 0.5) / F.lit(float(seen[0])))
        # evidence: likelihood ratio of a word's two counts against equal rates
        share = F.lit(seen[1] / (seen[0] + seen[1]))
        term = lambda n, p: F.when(n > 0, n * F.log(n / (p * (F.col("bad") + F.col("good"))))).otherwise(0.0)
        evidence = 2 * (term(F.col("bad"), share) + term(F.col("good"), 1 - share))
        odd = stats.where((F.col("bad") >= 3) & (lift >= 6.0)).select("word", "bad", evidence.alias("evidence"))
        enough = 2 * np.log(max(2, stats.count()))  # one word in the whole vocabulary would get so far by chance
        found = odd.orderBy(F.desc("evidence"), "word").limit(MAX_WORDS // 6).collect()
        positive = [(r["word"], float(np.sqrt(r["bad"]))) for i, r in enumerate(found) if r["evidence"] >= enough or i < 10]
        plain = stats.where((F.col("good") >= 1) & (lift < 3.0))
        often = plain.orderBy(F.desc("good"), "word").limit(MAX_WORDS // 4)
        other = plain.orderBy(F.xxhash64("word"), "word").limit(MAX_WORDS // 2)
        negative = [(r["word"], 1.0) for r in often.union(other).distinct().orderBy(F.xxhash64("word"), "word").select("word").collect()]
        if not positive or not negative:
            return counts.get(1, 0) / max(1, sum(counts.values()))
        # the harmless words that a first machine takes for insults are the examples that the second needs
        first = docs.sparkSession.sparkContext.broadcast(machine(positive, negative))

        def mistaken(batches):
            for b in batches:
                value = first.value.words(b.column("word").to_pylist())
                yield pa.record_batch([b.column("word"), pa.array(value)], names=["word", "value"]).filter(pa.array(value > -0.3))

        hard = C.map_arrow(plain.select("word"), mistaken, "word string, value double").orderBy(F.desc("value"), "word").limit(MAX_WORDS // 4)
        negative += [(r["word"], 3.0) for r in hard.collect()]
        stats.unpersist()
        model = machine(positive, negative)
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def worst(batches):
            scorer = Scorer(shared.value)
            for b in batches:
                yield pa.record_batch([b.column("label"), pa.array(scorer.worst(C.texts_of(b.column("text"))))], names=["label", "worst"])

        got = C.map_arrow(rows, worst, "label int, worst double").toArrow()
        y, x = np.array(got["label"].to_pylist(), np.float64), got["worst"].to_numpy()
        weight = np.where(y > 0, counts[1] / seen[1], counts[0] / seen[0])
        model.slope, model.shift = _logistic(x, y, weight / weight.sum() * len(y))
        return model
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number for each of LETTERS^3 subsequences

    def run(batches):
        scorer = None if isinstance(shared.value, float) else Scorer(shared.value)
        for b in batches:
            texts = C.texts_of(b.column("text"))
            s = np.full(len(texts), shared.value) if scorer is None else shared.value.probability(scorer.worst(texts))
            s = np.round(s.astype(np.float64), 6)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return C.map_arrow(C.docs_of(docs).select("doc_id", in_fold(F.col("doc_id"), PARTS, HELD).alias("held_out"), "text"), run, OUT)


def keep_civil(docs: DataFrame, model: Model | float) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text is not toxic."""
    C.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        scorer = None if isinstance(m, float) else Scorer(m)
        for b in batches:
            texts = C.texts_of(b.column("text"))
            s = np.full(len(texts), m) if scorer is None else m.probability(scorer.worst(texts))
            yield b.filter(pa.array(np.round(s.astype(np.float64), 6) < THRESHOLD))

    return C.map_arrow(docs, run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
