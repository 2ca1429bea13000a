"""Hard negatives by embedding similarity.

Positives are given as pairs, or are the other vectors of an anchor's group. Each anchor has
its positives' best similarity. Other vectors qualify with a similarity of
at most ``max_score`` and at most the positive's times ``1 - margin``; the first
``range_min`` of them are passed over, ``range_max`` bounds the rank, the next ``n`` are
taken. Both bounds are inclusive, ties go to the smaller id.

Anchors are the stated query set: they are broadcast in blocks of ``BLOCK`` and each block
is a pass over the corpus of dense products in numpy, with a local best list an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.runtime import spread

BLOCK = 4096


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _own(block, pdf: pd.DataFrame) -> np.ndarray:
    """Which of a batch's vectors are positives of which anchors of the block."""
    cand = pdf["id"].to_numpy()
    if block["pairs"] is None:
        return (block["groups"][:, None] == pdf["grp"].to_numpy()[None, :]) & (block["ids"][:, None] != cand[None, :])
    at, of = block["pairs"]  # ordered by candidate
    own = np.zeros((len(block["ids"]), len(cand)), bool)
    left, right = np.searchsorted(of, cand, "left"), np.searchsorted(of, cand, "right")
    column = np.repeat(np.arange(len(cand)), right - left)
    if len(column):
        first = np.repeat(left - np.cumsum(right - left) + (right - left), right - left)
        own[at[first + np.arange(len(column))], column] = True
    return own


def _positives(shared):
    block = shared.value
    ids, unit = block["ids"], block["unit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full(len(ids), -np.inf)
        for pdf in batches:
            if len(pdf):
                sims = unit @ _unit(pdf["v"]).T
                best = np.maximum(best, np.where(_own(block, pdf), sims, -np.inf).max(axis=1))
        some = best > -np.inf
        yield pd.DataFrame({"anchor": ids[some], "pos": best[some]})

    return run


def _negatives(shared, most: int):
    block = shared.value
    ids, unit, limit = block["ids"], block["unit"], block["limit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, cand, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        worst = np.full(len(ids), -np.inf)  # the least similarity still of use to an anchor
        for pdf in batches:
            if not len(pdf):
                continue
            sims = unit @ _unit(pdf["v"]).T
            these = pdf["id"].to_numpy()
            sims[_own(block, pdf) | (ids[:, None] == these[None, :]) | (sims > limit[:, None])] = -np.inf
            least = worst if sims.shape[1] <= most else np.maximum(worst, np.partition(sims, -most, axis=1)[:, -most])
            i, j = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
            row, cand, sim = np.concatenate([row, i]), np.concatenate([cand, these[j]]), np.concatenate([sim, sims[i, j]])
            order = np.lexsort((cand, -sim, row))
            row, cand, sim = row[order], cand[order], sim[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, "left")
            row, cand, sim, place = (x[place < most] for x in (row, cand, sim, place))
            full = place == most - 1
            worst[row[full]] = sim[full]
        yield pd.DataFrame({"anchor": ids[row], "cand": cand, "sim": sim})

    return run


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    max_score: float = 0.95,
    margin: float = 0.01,
    range_min: int = 5,
    range_max: int = 50,
    n: int = 5,
    positives: DataFrame | None = None,
) -> DataFrame:
    """``(anchor, cand, rnk)`` for ``anchors(id)`` among ``vectors(id, grp, v)``; one group's vectors are positives of each other.

    With ``positives(anchor, cand)`` those pairs count in place of groups, the corpus is
    ``vectors(id, v)`` and the anchors, ``anchors(id, v)``, need not be in it.
    Anchors without a positive have no negatives. Null vectors are left out."""
    spark = vectors.sparkSession
    if positives is None:
        corpus = spread(vectors.where("id is not null and grp is not null and v is not null").select("id", "grp", "v"))
        chosen = corpus.join(anchors.select("id").distinct(), "id", "left_semi")
    else:
        corpus = spread(vectors.where("id is not null and v is not null").select("id", "v"))
        own = positives.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("cand").alias("own"))
        chosen = anchors.where("v is not null").select("id", "v").dropDuplicates(["id"]).join(own, "id")
    out = []
    rows: list = []

    def passes(rows: list) -> None:
        block = {"ids": np.array([r["id"] for r in rows]), "unit": _unit(pd.Series([r["v"] for r in rows])), "pairs": None}
        if positives is None:
            block["groups"] = np.array([r["grp"] for r in rows])
        else:
            pairs = np.array(sorted((c, i) for i, r in enumerate(rows) for c in r["own"]), np.int64).reshape(-1, 2)
            block["pairs"] = pairs[:, 1], pairs[:, 0]
        best = corpus.mapInPandas(_positives(spark.sparkContext.broadcast(block)), "anchor long, pos double")
        pos = {r["anchor"]: r["p"] for r in best.groupBy("anchor").agg(F.max("pos").alias("p")).collect()}  # at most BLOCK rows
        block = block | {"limit": np.array([min(max_score, pos[i] * (1 - margin)) if i in pos else -np.inf for i in block["ids"].tolist()])}
        out.append(corpus.mapInPandas(_negatives(spark.sparkContext.broadcast(block), range_max), "anchor long, cand long, sim double"))

    for r in chosen.toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        if len(rows) == BLOCK:
            passes(rows)
            rows = []
    if rows:
        passes(rows)
    if not out:
        return spark.createDataFrame([], "anchor long, cand long, rnk int")
    w = Window.partitionBy("anchor").orderBy(F.col("sim").desc(), "cand")
    ranked = reduce(DataFrame.unionByName, out).withColumn("rnk", F.row_number().over(w))
    return ranked.where((F.col("rnk") > range_min) & (F.col("rnk") <= min(range_max, range_min + n))).select("anchor", "cand", "rnk")


def labeled_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """``(anchor, cand, label)``: positives with 1, mined negatives with 0."""
    one = lambda df, label: df.select("anchor", "cand", F.lit(label).alias("label"))
    return one(positives, 1).unionByName(one(negatives, 0))
