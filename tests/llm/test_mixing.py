"""Mixing: sizes, plan, choice of documents."""

import base64
import math
import os

import pytest

from annotary.functions.tokenizer import PATTERN, SETTING, VOCABULARY
from annotary.llm import mixing as M

needs = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
TARGETS = "source string, target_share double, max_repeats int"
SIZES = "id long, source string, tokens long"


@needs
def test_token_sizes(spark):
    import tiktoken

    data = [(1, "a", "A plain text, with 12 tokens or so."), (2, "a", ""), (3, None, None), (4, "b", "<|endoftext|>"), (5, "b", "é" * 20_000)]
    df = spark.createDataFrame(data, "id long, source string, text string")
    got = {r["id"]: r["tokens"] for r in M.token_sizes(df).collect()}
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}
    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: len(coder.encode_ordinary(t)) if t else 0 for i, _, t in data}
    assert M.token_sizes(df.limit(0)).count() == 0


def make(spark):
    sizes = [(i, "big", 10 + i % 7) for i in range(3000)] + [(10_000 + i, "small", 5) for i in range(40)] + [(20_000 + i, "mid", 8) for i in range(900)]
    sizes += [(30_000, "unlisted", 10**6), (30_001, None, 10**6), (30_002, "mid", 0)]
    targets = [("big", 0.5, 1), ("small", 0.1, 3), ("mid", 0.35, 4), ("absent", 0.05, 2), (None, 0.5, 1), ("mid", 0.35, 4)]
    return spark.createDataFrame(sizes, SIZES), spark.createDataFrame(targets, TARGETS)


@pytest.mark.parametrize("rule", ["targets", "temperature"])
def test_mix(spark, rule):
    sizes, targets = make(spark)
    planned = M.plan(sizes, targets, rule)
    plan = {r["source"]: r for r in planned.collect()}
    total = sum(r["tokens"] for r in plan.values())
    assert {s for s, r in plan.items() if r["short"]} == ({"small", "absent"} if rule == "targets" else {"absent"}) and set(plan) == {"big", "small", "mid", "absent"}
    used = M.repeats(sizes, planned)
    got = used.collect()
    assert len({r["id"] for r in got}) == len(got) and {r["source"] for r in got} <= set(plan)
    for s, r in plan.items():
        mine = [x for x in got if x["source"] == s]
        size = sum(x["tokens"] * x["repeats"] for x in mine)
        assert size <= r["budget"] and r["budget"] - size < 20
        assert all(x["repeats"] <= r["max_repeats"] for x in mine)
        assert len({x["repeats"] for x in mine}) <= 2
    if rule == "targets":
        assert plan["mid"]["exponent"] == plan["big"]["exponent"] == 0 and 0 < plan["small"]["exponent"] < 1 == plan["absent"]["exponent"]
        assert abs(plan["mid"]["budget"] - 0.35 * total) <= 1 and plan["small"]["budget"] == 3 * 200
    shares = {r["source"]: r["actual_share"] for r in M.shares(used, planned).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["absent"] == 0
    assert {tuple(r) for r in M.repeats(sizes, planned).collect()} == {tuple(r) for r in got}


def test_exponent():
    sizes = {"a": 1000.0, "b": 100.0, "c": 10.0, "none": 0.0}
    free = dict.fromkeys(sizes, 1e9)
    target = M.entropy([0.6, 0.3, 0.1])
    a = M.bisect_exponent(sizes, target, free, 1110)
    assert math.isclose(M.entropy(list(M.tempered(sizes, a).values())), target, rel_tol=1e-6)
    limited = M.bisect_exponent(sizes, target, dict.fromkeys(sizes, 2.0), 1110)
    assert limited > a and all(p * 1110 <= 2 * sizes[s] * (1 + 1e-9) for s, p in M.tempered(sizes, limited).items())
    assert M.tempered({}, 0.5) == {} and M.tempered({"a": 0.0}, 0.5) == {"a": 0.0}


@pytest.mark.parametrize(("base", "share", "limit"), [(0.3, 0.1, 0.15), (0.3, 0.1, 0.3), (0.2, 0.01, 0.02), (0.1, 0.5, 0.5), (0.0, 0.2, 0.2), (0.1, 0.0, 0.0)])
def test_own_exponent(base, share, limit):
    a = M.own_exponent(base, share, limit)
    if base <= limit:
        assert a == 0
    elif share == 0:
        assert a == 1
    else:
        assert math.isclose(base ** (1 - a) * share**a, limit, rel_tol=1e-9)


def test_nulls_ties_and_repeated_rows(spark):
    sizes = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, "a", 5), (2, None, 5), (3, "a", 0)] + [(i, "b", 1) for i in range(10, 40)], SIZES)
    targets = spark.createDataFrame([("a", 0.2, None), ("b", None, 2), (None, 0.5, 1)], TARGETS)
    planned = M.plan(sizes, targets)
    assert {r["source"]: r["short"] for r in planned.collect()} == {"a": False, "b": False}
    used = M.repeats(sizes, planned).groupBy("source").agg(M.F.sum("tokens").alias("n")).collect()
    assert {r["source"] for r in used} == {"a"} and used[0]["n"] <= 9


def test_setting_names_the_vocabulary(spark):
    spark.conf.set(SETTING, "/nowhere/else")
    try:
        with pytest.raises(FileNotFoundError):
            M.token_sizes(spark.createDataFrame([(1, "a", "x")], "id long, source string, text string"))
    finally:
        spark.conf.unset(SETTING)


def test_empty_tables(spark):
    sizes, targets = make(spark)
    none = M.plan(sizes.limit(0), targets)
    assert {r["source"] for r in none.where("short").collect()} == {"big", "small", "mid", "absent"}
    assert M.repeats(sizes.limit(0), none).count() == 0 and M.plan(sizes, targets.limit(0)).count() == 0
    assert M.shares(M.repeats(sizes, none), none).count() == 4


def test_hot_source_of_equal_documents(spark):
    sizes = spark.range(20_000).selectExpr("id", "'x' as source", "cast(1 as long) as tokens")
    planned = M.plan(sizes, spark.createDataFrame([("x", 0.25, 1)], TARGETS))
    assert M.repeats(sizes, planned).count() == 5000
