"""Train, test and validation splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.operators.ordering import number_rows


def checked_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """The same rows; running them fails on a label other than 0, 1 or null."""
    bad = F.raise_error(F.concat(F.lit("label outside 0/1: "), F.col(label).cast("string")))
    return rows.withColumn(label, F.when(F.col(label).isNull() | F.col(label).isin(0, 1), F.col(label)).otherwise(bad).cast("int"))


def text_groups(rows: DataFrame, text: str = "tiab", label: str = "label") -> DataFrame:
    """``(text, has_pos)``: the greatest label of each text; null is no text."""
    return rows.where(F.col(text).isNotNull()).groupBy(text).agg(F.max(label).alias("has_pos"))


def stratified(groups: DataFrame, key: str, stratum: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``side``: the first ``ceil(share * n)`` of each stratum in a hashed order are test, others train.

    Ranks come from a global range sort, so a stratum with half of all rows is no single task."""
    hashed = groups.withColumn("h", F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))))
    return _sides(hashed, key, stratum, ["h", key], share).drop("h")


def _sides(groups: DataFrame, key: str, stratum: str, order: list[str], share: float) -> DataFrame:
    rows = number_rows(groups, [stratum, *order], "nr")
    sizes = rows.groupBy(stratum).agg(F.min("nr").alias("first"), F.ceil(F.count("*") * share).alias("quota"))
    joined = rows.alias("r").join(F.broadcast(sizes).alias("s"), F.col(f"r.{stratum}").eqNullSafe(F.col(f"s.{stratum}")))  # a row a stratum
    side = F.when(F.col("nr") - F.col("first") < F.col("quota"), "test").otherwise("train")
    return joined.select("r.*", side.alias("side")).drop("nr")


def group_split(rows: DataFrame, text: str = "tiab", label: str = "label", share: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with ``side``, by text: no text is on both sides. Rows without text are on neither.

    Groups are kept by the digest that orders them, so texts are neither grouped, sorted nor joined on."""
    keyed = rows.where(F.col(text).isNotNull()).withColumn("__group", F.md5(F.concat(F.lit(str(seed)), F.col(text))))
    groups = keyed.groupBy("__group").agg(F.max(label).alias("has_pos"))
    sides = _sides(groups, "__group", "has_pos", ["__group"], share)
    return keyed.join(sides.select("__group", "side"), "__group").drop("__group")


def overlap(rows: DataFrame, text: str = "tiab", side: str = "side") -> DataFrame:
    """Texts on more than one side; empty where a split is clean."""
    return rows.groupBy(text).agg(F.countDistinct(side).alias("sides")).where("sides > 1")


def assert_disjoint(rows: DataFrame, text: str = "tiab", side: str = "side") -> DataFrame:
    """The rows, or an error if a text is on both sides."""
    if not overlap(rows, text, side).isEmpty():
        raise ValueError("a text is on both sides of the split")
    return rows
