"""Bounded samples of labelled rows, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``: the fold that a row belongs to."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts


def in_fold(doc_id: Column, parts: int, held: int) -> Column:
    """Whether a row is held out; a row without an id is not."""
    return F.coalesce(fold(doc_id, parts) == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most ``per_class`` training rows of each class, and all rows' class counts.

    The rows with the least hash of their id are taken, so the choice follows the ids and not the
    layout; rows of the held-out fold, of null id or of null label never enter.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), parts, held))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    few = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # at most 2 * per_class rows of two numbers: small enough to broadcast at any size of the corpus
    return docs.join(F.broadcast(few[0].unionByName(few[1])), "doc_id"), counts
