"""Models over columns: Arrow batches, one model for each Python worker."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.models.scorers import Factory
from annotary.runtime import spread

#: Texts in one step of a model.
MODEL_BATCH = 32


@cache
def _model(factory: Factory) -> object:
    return factory()


def _steps(texts: pd.Series, size: int) -> Iterator[list[str]]:
    filled = ["" if t is None else t for t in texts]
    return (filled[i : i + size] for i in range(0, len(filled), size))


def classify(text: Column, factory: Factory, size: int = MODEL_BATCH) -> Column:
    """Class with the greatest logit as bigint, the first of equals. Null counts as empty."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(factory)
        for s in batches:
            got = [model.logits(part).argmax(axis=1) for part in _steps(s, size)]
            yield pd.Series(np.concatenate(got) if got else np.empty(0, np.int64))

    return run(text)


def generate(prompts: Column, factory: Factory, size: int = MODEL_BATCH) -> Column:
    """A model's text for each prompt."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(factory)
        for s in batches:
            yield pd.Series([t for part in _steps(s, size) for t in model.generate(part)], dtype=object)

    return run(prompts)


def embed(text: Column, factory: Factory, size: int = 128) -> Column:
    """A model's vector for each text."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(factory)
        for s in batches:
            yield pd.Series([v for part in _steps(s, size) for v in model.embed(part).tolist()], dtype=object)

    return run(text)


def tokens(text: Column, most: int = 512) -> Column:
    """The first ``most`` words of a text as a model sees them; truncation is the model's limit."""
    return F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, most)


def padded(token_lists: Column, multiple: int = 8) -> Column:
    """Length to which a list is padded: the next multiple."""
    return (F.ceil(F.size(token_lists) / multiple) * multiple).cast("int")


def _scored(factory: Factory, blocks, k: int, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            best: list[list[tuple[float, str]]] = [[] for _ in texts]
            for labels in blocks.value:
                model.fit(labels)
                for at in range(0, len(texts), chunk):
                    scores = np.asarray(model.score(texts[at : at + chunk]), float)
                    scores = np.where(np.isnan(scores), -np.inf, scores)
                    # labels are sorted, so a stable sort orders ties by label
                    take = min(k, len(labels))
                    floor = np.partition(scores, -take, axis=1)[:, -take]
                    for i, (row, least) in enumerate(zip(scores, floor), at):
                        above = np.flatnonzero(row > least)
                        near = np.concatenate([above[np.argsort(-row[above], kind="stable")], np.flatnonzero(row == least)[: take - len(above)]])
                        best[i] = sorted([*best[i], *((-row[j], labels[j]) for j in near if row[j] > -np.inf)])[:k]
            yield pdf.drop(columns="text").assign(top5_cross=[[{"label": x, "score": -s} for s, x in b] for b in best])

    return run


def top_k(rows: DataFrame, key: list[str], labels: DataFrame, factory: Factory, k: int = 5, block: int = 2048, blocks_per_pass: int = 32, chunk: int = 200) -> DataFrame:
    """``key`` columns of ``rows(key..., text)`` and ``top5_cross``, the ``k`` best of ``labels(label)``.

    Every pair is scored, none is materialised, nothing is shuffled: labels are the stated
    query set and reach the tasks in blocks of ``block``. Labels beyond
    ``block * blocks_per_pass`` take another pass, merged per row, so a broadcast stays
    bounded. ``key`` tells rows apart. Order: score descending, label ascending; NaN scores are left out; fewer than
    ``k`` labels give all."""
    spark = rows.sparkSession
    passes: list[list[list[str]]] = []
    for r in labels.select("label").where("label is not null").distinct().sort("label").toLocalIterator():
        if not passes or len(passes[-1]) == blocks_per_pass and len(passes[-1][-1]) == block:
            passes.append([[]])
        elif len(passes[-1][-1]) == block:
            passes[-1].append([])
        passes[-1][-1].append(r["label"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema.fields)
    schema = f"{fields}, top5_cross array<struct<label:string,score:double>>"
    dealt = spread(rows.select(*key, "text"), always=True)
    if not passes:
        return rows.select(*key, F.array().cast("array<struct<label:string,score:double>>").alias("top5_cross"))
    done = dealt.mapInPandas(_scored(factory, spark.sparkContext.broadcast(passes[0]), k, chunk), schema)
    if len(passes) == 1:
        return done
    for p in passes[1:]:
        done = done.unionByName(dealt.mapInPandas(_scored(factory, spark.sparkContext.broadcast(p), k, chunk), schema))
    merged = done.groupBy(*key).agg(F.flatten(F.collect_list("top5_cross")).alias("all"))
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).otherwise(1)
    return merged.select(*key, F.slice(F.array_sort("all", order), 1, k).alias("top5_cross"))
