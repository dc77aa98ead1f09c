"""Integrity checks, as rows (check, failures): joins and counts that Spark plans, never a loop over rows (SNK-5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(parent: DataFrame, key: str, child: DataFrame, foreign: str) -> DataFrame:
    """JOI-5: parents that no child names."""
    return parent.join(child.select(F.col(foreign).alias(key)), key, "left_anti")


def broken(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """JOI-6: children that name no parent; a null reference is no break, and null parents break none."""
    return child.where(F.col(foreign).isNotNull()).join(parent.where(F.col(key).isNotNull()).select(F.col(key).alias(foreign)), foreign, "left_anti")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """AGG-6: keys of more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def wrong_counts(parent: DataFrame, key: str, stated: str, child: DataFrame, foreign: str) -> DataFrame:
    """JOI-7: parents whose stated count isn't that of their children."""
    n = child.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias("__counted"))
    counted = F.coalesce("__counted", F.lit(0))
    return parent.join(n, key, "left").where(counted != F.col(stated)).select(key, stated, counted.alias("counted"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, failures, passed)."""
    rows = [df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("failures") == 0)
