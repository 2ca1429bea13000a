"""Global order without a single sorting task: row numbers, running sums, shards, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotary.runtime import cut

_PART, _AT = "__part", "__at"


def _ranged(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Rows in global order over range partitions, with partition and place in it, written once."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id())
    return cut(placed.withColumn(_PART, F.shiftright(_AT, 33)).withColumn(_AT, F.col(_AT).bitwiseAND((1 << 33) - 1)), "ranged")


def number_rows(df: DataFrame, keys: Sequence[Column | str], name: str = "row_nr") -> DataFrame:
    """Gap-free 0-based numbers in the order of ``keys``, which should tell rows apart."""
    rows = _ranged(df, keys)
    sizes = rows.groupBy(_PART).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(_PART, F.coalesce(before, F.lit(0)).alias("before"))  # a row for each shuffle partition
    return rows.join(F.broadcast(offsets), _PART).withColumn(name, F.col("before") + F.col(_AT)).drop(_PART, _AT, "before")


def running_sums(df: DataFrame, keys: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """Adds ``sum_<column>``: the sum from the first row in the order of ``keys`` to each row."""
    rows = _ranged(df, keys)
    sums = rows.groupBy(_PART).agg(*[F.sum(c).alias(f"all_{c}") for c in columns])
    w = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(_PART, *[F.coalesce(F.sum(f"all_{c}").over(w), F.lit(0)).alias(f"all_{c}") for c in columns])
    local = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(offsets), _PART)  # a row for each shuffle partition
    return out.withColumns({f"sum_{c}": F.sum(c).over(local) + F.col(f"all_{c}") for c in columns}).drop(_PART, _AT, *[f"all_{c}" for c in columns])


def row_shard(df: DataFrame, shard: int, shards: int, number: str = "row_nr") -> DataFrame:
    """Rows whose number falls to one of ``shards`` workers; all rows where there is one."""
    return df.where(F.pmod(F.col(number), F.lit(max(shards, 1))) == shard)


def file_shard(paths: DataFrame, shard: int | None, shards: int | None, path: str = "path", at_least_one: bool = True) -> DataFrame:
    """Files that fall to a worker, dealt out by sorted name; all without shard or count."""
    if shard is None or shards is None:
        return paths
    return row_shard(number_rows(paths, [path], "__nr"), shard, max(shards, 1) if at_least_one else shards, "__nr").drop("__nr")


def batches(df: DataFrame, size: int, number: str = "row_nr") -> DataFrame:
    """``(batch, start, end)``: fixed-size ranges ``[start, end)`` that cover the row numbers."""
    b = F.floor(F.col(number) / size)
    return df.groupBy(b.alias("batch")).agg((F.first(b) * size).alias("start"), (F.max(number) + 1).alias("end"))
