"""What the operators of this subpackage share: tables, staging, hashing, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever file system the path names."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that
    is unset (a single machine, as in tests) a folder of this process is used.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    kept = sc._jsc.sc().getCheckpointDir()
    if kept.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
        kept = sc._jsc.sc().getCheckpointDir()
    return kept.get().rstrip("/")


_STAGED: list[tuple[SparkSession, str]] = []


def staged(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs only the tasks that read its share, never a repeat of
    the work above.  The files go when the application ends, or by ``drop``.
    """
    path = f"{shared_dir(spark)}/marginalia/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marginalia_path = path
    return out


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete what ``staged`` wrote, once nothing reads it any more."""
    path = getattr(df, "_marginalia_path", None)
    if path:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _STAGED:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------- hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise on uint64."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


class Words:
    """Hashes of the words of texts: A-Z in lower case, split at ASCII white space, by array operations.

    A word's hash is a polynomial over random numbers of its bytes, mixed with its length: 64 bits.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        low = np.arange(256)
        low[65:91] += 32
        self.number = mix64(low.astype(np.uint64) + U64(1001))
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.power = self.inverse = np.empty(0, np.uint64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes, and the number of words of each text."""
        raws = [t.encode() for t in texts]
        raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        n = len(raw)
        if n > len(self.power):
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.full(n, self.BASE, np.uint64))
                self.inverse = np.cumprod(np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64))
        turn = np.flatnonzero(np.diff(self.blank[raw], prepend=True))
        first, end = turn[::2], turn[1::2]
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.number[raw] * self.power[:n])))
            h = mix64((total[end] - total[first]) * self.inverse[first] ^ ((end - first).astype(np.uint64) * U64(0xD6E8FEB86659FD93)))
        stops = np.cumsum([len(r) + 1 for r in raws]) if raws else np.empty(0, np.int64)
        return h, np.diff(np.searchsorted(first, stops), prepend=0)


# --------------------------------------------------------------------------- Arrow plumbing

def sorted_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal ``key`` from key-sorted batches.

    Only the run still open is carried to the next batch, so memory follows the
    batch and the longest run.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            kept.append(batch.slice(0, last))
            yield pa.Table.from_batches(kept)
            kept = [batch.slice(last)]
        else:
            if kept and kept[-1].column(key)[0].as_py() != keys[-1]:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; a null text counts as an empty one."""
    return ["" if x is None else x for x in column.to_pylist()]


def binary_column(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL of long, int, double, float, string, boolean and binary."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([pa.field(n, kinds[t]) for n, t in (c.split() for c in ddl.split(","))])


#: Resident bytes that a worker may keep: some 110 MB are its libraries.
SMALL = 140 << 20


def tidy() -> None:
    """Give memory that a task has done with back to the system: Spark keeps its Python workers, and
    what each of them still holds counts against the executor.  A small one is left as it is: many tasks
    are short."""
    with open("/proc/self/statm") as f:
        if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < SMALL:
            return
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable, ddl: str | StructType) -> DataFrame:
    """``mapInArrow`` by code that the executors have been sent."""
    ship(df.sparkSession)

    @functools.wraps(fn)  # plans show the function's own name
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            tidy()

    return df.mapInArrow(run, ddl)


def docs_of(docs: DataFrame) -> DataFrame:
    """The id and text of a documents table; whatever else it carries can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
