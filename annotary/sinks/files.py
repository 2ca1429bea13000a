"""Writing tables: compressed Parquet, partitioned by source, counted in the same pass."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write(df: DataFrame, path: str, by: list[str] | None = None, compression: str = "zstd", skip_if_exists: bool = False) -> int | None:
    """Write and return the number of rows; None where the output is there already and may stay.

    The commit protocol makes the output whole or absent. pandas' stray index column is left out."""
    if skip_if_exists and _exists(df.sparkSession, f"{path}/_SUCCESS"):
        return None
    seen = Observation("written")
    out = df.drop("__index_level_0__").observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", compression).mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)
    return seen.get["n"]


def done(spark: SparkSession, path: str) -> set[str]:
    """Keys of the inputs that finished runs have taken to ``path``."""
    if not _exists(spark, f"{path}_done"):
        return set()
    return {r["key"] for r in spark.read.schema("key string").parquet(f"{path}_done").select("key").collect()}


def write_new(df: DataFrame, path: str, by: str, keys: Iterable[str], compression: str = "zstd") -> int:
    """Write the partitions ``by`` of inputs ``keys`` beside those of other inputs, and return the number of rows.

    What an unfinished or earlier run left of the same inputs goes first, so an input is there once. Runs that take
    different inputs may work at the same time."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for k in keys:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"{by}={escaped(k)}"), True)
    seen = Observation("written")
    out = df.drop("__index_level_0__").observe(seen, F.count(F.lit(1)).alias("n")).write.options(compression=compression, partitionOverwriteMode="dynamic")
    out.mode("overwrite").partitionBy(by).parquet(path)
    return seen.get["n"]


def write_parts(
    rows_of: Callable[[set[str]], DataFrame], path: str, by: str, keys: set[str], spark: SparkSession, fail_fast: bool = False, compression: str = "zstd"
) -> tuple[int, set[str]]:
    """Write the rows of inputs ``keys`` and return their number and the inputs that were taken.

    All go in one job. If it fails the inputs are taken one by one: each gives all its rows or none, and those
    that fail themselves are written to ``PATH_errors`` with the error. With ``fail_fast`` the error is raised."""
    try:
        return write_new(rows_of(keys), path, by, keys, compression), keys
    except Exception:
        if fail_fast:
            raise
    total, taken, lost = 0, set(), []
    for k in sorted(keys):
        try:
            total += write_new(rows_of({k}), path, by, {k}, compression)
            taken.add(k)
        except Exception as e:
            lost.append((k, f"{type(e).__name__}: {e}"[:4000]))
    if lost:
        spark.createDataFrame(lost, "key string, error string").coalesce(1).write.parquet(f"{path}_errors/run={uuid.uuid4().hex}")
    return total, taken


def note_done(spark: SparkSession, path: str, keys: set[str]) -> None:
    """Note inputs as taken to ``path``; call it when all that belongs to them is written."""
    if keys:
        spark.createDataFrame([(k,) for k in sorted(keys)], "key string").coalesce(1).write.parquet(f"{path}_done/run={uuid.uuid4().hex}")


def shard_name(stem: str, shard: int, shards: int) -> str:
    """Name of a worker's output."""
    return f"{stem}_crossencoded_shard{shard}-of-{shards}"
