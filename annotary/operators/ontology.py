"""Ontology rows as labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.schemas import ONTOLOGY_COLUMNS


def normalise(ontology: DataFrame) -> DataFrame:
    """The 15 columns as text in order: ``g2p id`` may be named with a blank or an underscore, blanks in
    other names may be underscores, and absent columns are empty."""
    have = {c.replace("_", " ").lower(): c for c in ontology.columns}
    pick = lambda c: F.col(f"`{have[k]}`").cast("string") if (k := c.replace("_", " ").lower()) in have else F.lit("")
    return ontology.select(*[pick(c).alias(c) for c in ONTOLOGY_COLUMNS])


def _inferred(rows: DataFrame) -> DataFrame:
    """Each column as a reader that infers types would write it again: of a column of numbers with gaps ``604149.0``, without gaps ``604149``."""
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    kinds = {}
    for i, c in enumerate(rows.columns):
        given = F.col(f"`{c}`").isNotNull()
        kinds[f"__numbers{i}"] = F.coalesce(F.min(F.when(given, number(c).isNotNull())), F.lit(False))
        kinds[f"__whole{i}"] = F.coalesce(F.min(F.when(given, F.col(f"`{c}`").rlike(r"^\s*[+-]?\d+\s*$"))), F.lit(False)) & F.min(given)
    one = rows.agg(*[k.alias(n) for n, k in kinds.items()])  # one row
    out = []
    for i, c in enumerate(rows.columns):
        d = number(c)
        plain = (d == F.floor(d)) & (F.abs(d) < 1e15)
        as_float = F.when(plain, F.concat(d.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(d.cast("string"))
        text = F.when(F.col(f"__whole{i}"), d.cast("decimal(20,0)").cast("string")).when(F.col(f"__numbers{i}"), as_float)
        out.append(F.coalesce(text, F.col(f"`{c}`")).alias(c))
    return rows.crossJoin(F.broadcast(one)).select(*out)


def render(ontology: DataFrame, null_text: str = "", inferred: bool = False) -> DataFrame:
    """Adds ``g2p_lgmde``: the columns joined by ``" - "``.

    Null is empty at inference; at training time it was written ``nan`` (``null_text="nan"``), and
    columns of numbers with gaps as floats (``inferred=True``), which makes another string of the same entry."""
    rows = normalise(ontology)
    rows = _inferred(rows) if inferred else rows
    # concat_ws would leave nulls out
    return rows.withColumn("g2p_lgmde", F.concat_ws(" - ", *[F.coalesce(F.col(f"`{c}`"), F.lit(null_text)) for c in ONTOLOGY_COLUMNS]))


def labels(ontology: DataFrame, null_text: str = "", inferred: bool = False) -> DataFrame:
    """The different labels."""
    return render(ontology, null_text, inferred).select("g2p_lgmde").distinct()
