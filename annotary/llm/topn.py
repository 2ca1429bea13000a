"""Top N items within every group, whatever the groups' sizes.

Exact counts of items split the groups. A group is heavy if it holds more than one part in
``HEAVY_PARTS`` of all items, or more than ``HEAVY_ITEMS``, so a light group's task has a bound
at every size of the table. Light groups go through an ordinary window. Heavy groups are
range-sorted over all partitions (the group's items in their final order, salted by their place
in the range), each range keeps its best N, and only those meet in a window. There an item's
repeats are reduced to its best score within tasks before the shuffle. The list of heavy groups
is counted, and broadcast up to ``LISTED`` groups of 16 bytes; a longer one (of at least 10 ** 11
items) is joined without a hint, and adaptive execution splits the heavy groups' side of it.

Defined cases: a null group is no group; items that are null or blank, or whose score
is null or NaN, are left out; a group without items left gives no row; equal scores are
ordered by item, by code point; an empty table gives an empty table. Column names of the
input are chosen by the caller, so clashes do not arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotary.runtime import cut

#: A group with more than 1 / HEAVY_PARTS of all items is heavy, and one with more than HEAVY_ITEMS.
HEAVY_PARTS, HEAVY_ITEMS = 1024, 1_000_000
#: Most heavy groups in a broadcast list.
LISTED = 100_000


def digest(text: Column) -> Column:
    """16 bytes that stand for a text in shuffles."""
    return F.unhex(F.md5(text))


def _items(lists: DataFrame) -> DataFrame:
    """Each group's valid items, each once with its best score."""
    blank = F.regexp_replace("label", r"(?U)\s", "") == ""
    valid = lists.select("group", F.inline("items")).where(F.col("label").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & ~blank)
    return valid.groupBy("group", "label").agg(F.max("score").alias("score"))


def top_n(rows: DataFrame, n: int = 5, heavy_parts: int = HEAVY_PARTS, heavy_items: int = HEAVY_ITEMS) -> DataFrame:
    """``(group_id, first_id, rnk, label)`` of ``rows(group binary, id bigint, items array<struct<label,score>>)``.

    ``first_id`` is the least id among all rows of the group."""
    size = F.greatest(F.size("items.score"), F.lit(0))  # of a null list it is -1; only scores are read
    sizes = rows.where("group is not null").groupBy("group").agg(F.sum(size).alias("n"), F.min("id").alias("first_id"))
    counted = cut(sizes, "groups")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).head()["total"]
    heavy = counted.where((F.col("n") * heavy_parts > total) | (F.col("n") > heavy_items)).select("group")
    if heavy.count() <= LISTED:
        heavy = F.broadcast(heavy)
    lists = rows.where("group is not null and size(items) > 0").select("group", "items")
    rank = Window.partitionBy("group").orderBy(F.col("score").desc(), F.col("label"))
    cold = (
        # one shuffle of whole lists serves the repeats and the window alike
        _items(lists.join(heavy, "group", "left_anti").repartition("group"))
        .withColumn("rnk", F.row_number().over(rank)).where(F.col("rnk") <= n)
    )
    hot = (
        _items(lists.join(heavy, "group", "left_semi"))
        .repartitionByRange("group", F.col("score").desc(), "label")
        .withColumn("salt", F.spark_partition_id())
    )
    salted = Window.partitionBy("group", "salt").orderBy(F.col("score").desc(), F.col("label"))
    hot = (
        hot.withColumn("near", F.row_number().over(salted)).where(F.col("near") <= n)
        .withColumn("rnk", F.row_number().over(rank)).where(F.col("rnk") <= n)
    )
    best = cold.select("group", "rnk", "label", "score").unionByName(hot.select("group", "rnk", "label", "score"))
    return best.join(counted.select("group", "first_id"), "group").select(F.col("group").alias("group_id"), "first_id", "rnk", "label", "score")
