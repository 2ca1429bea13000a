"""Candidate lists in the forms they arrive in, as lists of labels."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.functions.text import strip

MOST = 5


def labels(candidates: Column, most: int = MOST) -> Column:
    """Stripped labels of a typed list; blanks and nulls go before the cut to ``most``. None for null."""
    texts = F.transform(candidates, lambda x: strip(x["label"]))
    return F.coalesce(F.slice(F.filter(texts, lambda s: s.isNotNull() & (s != "")), 1, most), F.array().cast("array<string>"))


def labels_from_json(raw: Column, most: int = MOST) -> Column:
    """Labels of a JSON array of objects, strings or pairs; none for anything else.

    An element's label is its ``label`` field, its first element, or itself."""
    items = F.when(F.startswith(F.trim(raw), F.lit("[")), F.from_json(raw, "array<string>"))
    one = lambda s: (
        F.when(F.startswith(s, F.lit("{")), F.get_json_object(s, "$.label"))
        .when(F.startswith(s, F.lit("[")), F.get_json_object(s, "$[0]"))
        .otherwise(s)
    )
    texts = F.transform(items, lambda s: strip(one(s)))
    return F.coalesce(F.slice(F.filter(texts, lambda s: s.isNotNull() & (s != "")), 1, most), F.array().cast("array<string>"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def labels_from_literal(raw: pd.Series) -> pd.Series:
    """Labels of a list written as a Python literal, batch by batch; none for anything else."""

    def one(x: object) -> str | None:
        if isinstance(x, dict):
            x = x.get("label")
        elif isinstance(x, (list, tuple)) and x:
            x = x[0]
        return str(x).strip() or None if x is not None else None

    def read(s: str | None) -> list[str]:
        try:
            found = ast.literal_eval(s) if s else []
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return []
        return [v for v in map(one, found) if v][:MOST] if isinstance(found, (list, tuple)) else []

    return raw.map(read)


def any_labels(raw: Column) -> Column:
    """Labels of a text in JSON or, failing that, literal syntax."""
    by_json = labels_from_json(raw)
    return F.when(F.size(by_json) > 0, by_json).otherwise(labels_from_literal(raw))
