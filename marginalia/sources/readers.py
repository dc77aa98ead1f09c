"""Scans with explicit schemas and sinks with stable output (SRC-1 to SRC-6, SNK-1 to SNK-5)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as P

MORPHOLOGY = "s long, a long, w long, t long, form string, tag string, features string"


def headerless_csv(spark: SparkSession, path: str, ddl: str, key: list[str] | None = None, header_when: str | None = None) -> DataFrame:
    """SRC-1: columns by position; rows that ``header_when`` describes go; of rows of one key the first stays.

    First means least file name and place in it: ``_metadata`` tells both without a sort of everything.
    """
    df = spark.read.schema(ddl).option("header", False).option("mode", "PERMISSIVE").csv(path)
    if header_when:
        df = df.where(~F.coalesce(F.expr(header_when), F.lit(False)))
    if not key:
        return df
    at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    w = Window.partitionBy(*key).orderBy("__file", "__block", "__row")
    return at.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__file", "__block", "__row", "__n")


def morphology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-2: (tokens, report) of a tab-separated file: comments, blank lines and the heading skipped, lines of fewer
    than four fields or without a coordinate ``(s:a:w:t)`` counted as malformed."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "") & ~F.col("value").startswith("LOCATION"))
    f = F.split("value", "\t", -1)
    at = P.coordinate(f[0])
    ok = (F.size(f) >= 4) & at[0].isNotNull()
    tokens = lines.where(ok).select(*(c.alias(n) for c, n in zip(at, "sawt", strict=True)), f[1].alias("form"), f[2].alias("tag"), f[3].alias("features"))
    report = lines.agg(F.count_if(ok).alias("imported"), F.count_if(~ok).alias("malformed"))
    return tokens, report


def table(spark: SparkSession, path: str, columns: list[str], not_null: list[str] = ()) -> DataFrame:
    """SRC-3: named columns of a stored table, without rows that lack the given ones: both reach the scan."""
    df = spark.read.parquet(path).select(*columns)
    for c in not_null:
        df = df.where(F.col(c).isNotNull())
    return df


def key_report(df: DataFrame, key: str) -> DataFrame:
    """SRC-6: (n, keys, least, most, gapless): whether a number column counts its rows without gap or repeat; a null is a gap."""
    a = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.min(key).alias("least"), F.max(key).alias("most"))
    return a.withColumn("gapless", (F.col("n") == F.col("keys")) & (F.col("most") - F.col("least") + 1 == F.col("n")))


def artifact(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC-4: a JSON product of an earlier phase."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def vocabulary(spark: SparkSession, words: dict[str, list[str]]) -> DataFrame:
    """SRC-5: (class, item) of an inline vocabulary."""
    return spark.createDataFrame([(c, i) for c, items in sorted(words.items()) for i in items], "class string, item string")


def write_table(df: DataFrame, path: str) -> None:
    """SNK-1."""
    df.write.mode("overwrite").parquet(path)


def canonical_json(value: object) -> str:
    """SNK-2: one spelling of a value: keys sorted, one space a level, letters as they are."""
    return json.dumps(value, sort_keys=True, indent=1, ensure_ascii=False)


def digest(df: DataFrame) -> DataFrame:
    """SNK-3: (rows, digest): a checksum that neither row order nor partitions change: sums of 64-bit hashes of
    rows' canonical JSON."""
    row = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))))
    h = F.xxhash64(row)
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string")), 256).alias("digest"))


def manifest(products: dict[str, DataFrame], constants: dict[str, object]) -> dict:
    """SNK-3, SNK-4: constants, and each product's rows and digest; nothing that changes from run to run."""
    out = {name: {"rows": r["rows"], "digest": r["digest"]} for name, df in sorted(products.items()) for r in [digest(df).first()]}
    body = {"constants": constants, "products": out}
    return body | {"sha256": hashlib.sha256(canonical_json(body).encode()).hexdigest()}
