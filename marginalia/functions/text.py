"""Scalar parsing of tokens, features and coordinates (PRJ-1 to PRJ-12), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transliterate(x: Column, mapping: dict[str, str]) -> Column:
    """PRJ-1: one character for another; others stay."""
    return F.translate(x, "".join(mapping), "".join(mapping.values()))


def without(x: Column, chars: str) -> Column:
    """PRJ-2."""
    return F.translate(x, chars, "")


def folded(x: Column, variants: str, plain: str, strip: str = "") -> Column:
    """PRJ-3: trimmed, without ``strip``, and each of the variants written as the plain letter."""
    return F.translate(F.translate(F.trim(x), strip, "") if strip else F.trim(x), variants, plain * len(variants))


def features(x: Column, fields: dict[str, tuple[str, ...]], prefixes: dict[str, str]) -> dict[str, Column]:
    """PRJ-4: fields of a pipe-separated list: by a prefix (``ROOT:``), or by an exact token of a set.

    A later token overwrites an earlier one; nothing found gives null.
    """
    tokens = F.split(x, r"\|", -1)
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    one_of = lambda values: lambda t: t.isin(*values)
    begins = lambda p: lambda t: t.startswith(p)
    out = {name: last(F.filter(tokens, one_of(values))) for name, values in fields.items()}
    return out | {name: F.substring(last(F.filter(tokens, begins(p))), len(p) + 1, 1 << 30) for name, p in prefixes.items()}


def without_prefixes(x: Column, *prefixes: str) -> Column:
    """PRJ-5: each literal prefix taken off in turn, where it is there."""
    for p in prefixes:
        x = F.when(x.startswith(p), F.substring(x, len(p) + 1, 1 << 30)).otherwise(x)
    return x


def by_substring(x: Column, cases: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """PRJ-6, PRJ-10: the first substring that is found decides."""
    out = None
    for part, value in cases:
        out = F.when(x.contains(part), value) if out is None else out.when(x.contains(part), value)
    return out.otherwise(F.lit(otherwise))


def person(x: Column) -> Column:
    """PRJ-8: grammatical person in a compound tag such as 3MS, between no other letters or digits."""
    return F.nullif(F.regexp_extract(x, r"(?<![A-Za-z0-9])([123])(?:MS|FS|MD|FD|MP|FP|S|D|P)(?![A-Za-z0-9])", 1), F.lit(""))


def coordinate(x: Column) -> list[Column]:
    """PRJ-12: the four numbers of ``(s:a:w:t)``, or nulls."""
    pattern = r"^\((\d+):(\d+):(\d+):(\d+)\)$"
    return [F.nullif(F.regexp_extract(x, pattern, i), F.lit("")).cast("long") for i in range(1, 5)]
