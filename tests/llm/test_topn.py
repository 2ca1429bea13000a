"""Top N of light and heavy groups against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from annotary.llm import topn as T

SCHEMA = "group string, id long, items array<struct<label:string,score:double>>, label string, rnk int, n long"


def brute(data, n):
    best, first = {}, {}
    for g, i, items in data:
        if not g:
            continue
        first[g] = min(first.get(g, i), i)
        for label, s in items or []:
            if label is None or not label.strip() or s is None or math.isnan(s):
                continue
            d = best.setdefault(g, {})
            d[label] = max(d.get(label, s), s)
    out = set()
    for g, d in best.items():
        for r, (label, _) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n], 1):
            out.add((first[g], r, label))
    return out


def run(spark, data, **kw):
    df = spark.createDataFrame([(*d, "clash", 1, 2) for d in data], SCHEMA).withColumn("group", T.digest(F.col("group")))
    df = df.where("group is not null")
    return {(r["first_id"], r["rnk"], r["label"]) for r in T.top_n(df, **kw).collect()}


@pytest.mark.parametrize("heavy_parts", [1, 3, 1024, 10**9])
def test_against_brute_force(spark, heavy_parts):
    rng = random.Random(5)
    score = lambda: rng.choice([0.1, 0.5, 0.5, 0.9, None, float("nan"), -0.0, 0.0, 1e300, -5.0])
    label = lambda: rng.choice([None, " ", "\t", *(f"l{i}" for i in range(30)), "é", "z", "Z", "a" * 5000])
    data = [(f"g{rng.randrange(12)}" if rng.random() < 0.6 else "hot", i, None if rng.random() < 0.1 else [(label(), score()) for _ in range(rng.randrange(9))]) for i in range(600)]
    data += [(None, 1, [("x", 1.0)])] + data[:20]
    assert run(spark, data, heavy_parts=heavy_parts) == brute(data, 5)


@pytest.mark.parametrize(("heavy_items", "listed"), [(1, 100), (1, 5), (20, 100), (10**9, 100)])
def test_heavy_by_items(spark, monkeypatch, heavy_items, listed):
    monkeypatch.setattr(T, "LISTED", listed)
    rng = random.Random(8)
    data = [(f"g{rng.randrange(20)}", i, [(f"l{rng.randrange(40)}", rng.choice([0.2, 0.4, 0.4]))] * rng.randrange(4)) for i in range(300)]
    assert run(spark, data, heavy_parts=1, heavy_items=heavy_items) == brute(data, 5)


def test_groups_without_items_and_empty_tables(spark):
    assert run(spark, [("g", 1, None), ("h", 2, []), ("i", 3, [(None, 1.0)])]) == set()
    assert run(spark, [("g", 1, [("a", 1.0)])], n=1) == {(1, 1, "a")}
    df = spark.createDataFrame([], SCHEMA).withColumn("group", T.digest(F.col("group")))
    assert T.top_n(df).count() == 0
