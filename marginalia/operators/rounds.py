"""Loops over DataFrames: a step is repeated until nothing changes, each round's result cut from its lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of this machine (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return kept.get().rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_all() -> None:
    for spark, path in _WRITTEN:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended already
            return


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder: a lost executor repeats no earlier round.  The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marginalia/round-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame, cols: list[str]) -> tuple:
    """Row count and an order-free checksum: whether a round changed anything."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return tuple(r)


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], cols: list[str], most: int = 100) -> DataFrame:
    """Repeat a step until its result stays the same, or ``most`` times."""
    now = written(start.select(*cols))
    seen = fingerprint(now, cols)
    for _ in range(most):
        new = written(step(now).select(*cols))
        mark = fingerprint(new, cols)
        if mark == seen:
            break
        now, seen = new, mark
    return now
