"""Overlaps across splits against brute force."""

import random

import numpy as np

from annotary.functions.tokens import words
from annotary.llm import crosssplit as C
from annotary.llm.neardup import WordHashes
from tests_llm_helpers import versions

SCHEMA = "id long, text string, split string, source string, cid long, chunk string"


def brute(data):
    out = set()
    for i, t, s, *_ in data:
        for j, u, v, *_ in data:
            if s == "train" and v in ("validation", "test") and t and u and i is not None and j is not None:
                a, b = set(words(t)), set(words(u))
                if len(a) >= 20 and len(b) >= 20 and len(a & b) / len(a | b) >= 0.7:
                    out.add((i, j))
    return out


def run(spark, data):
    df = spark.createDataFrame([(*d, 1, "x") for d in data], SCHEMA)
    return df, C.overlaps(df)


def test_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, t, rng.choice(["train", "train", "validation", "test", None, "other"]), "s") for i, t in enumerate(versions(4, 30, 6))]
    df, got = run(spark, data)
    pairs = {(r["id_l"], r["id_r"]) for r in got.collect()}
    want = brute(data)
    assert len(want) > 50 and pairs == want
    table = {(r["split"], r["source"]): r for r in C.report(df, got).collect()}
    assert sum(r["pairs"] for r in table.values()) == len(want)
    assert table[("test", "s")]["leaked"] == len({j for i, j in want if data[j][2] == "test"})


def test_edge_cases(spark):
    base = " ".join(f"b{i}" for i in range(40))
    long = " ".join(f"w{i}" for i in range(30_000))
    data = [(1, base, "train", None), (2, base.upper(), "test", None), (3, base, "test", "x"), (4, None, "test", "x"), (5, "", "train", "x"), (6, "a b", "train", "x"),
            (7, "a b", "test", "x"), (8, base, None, "x"), (9, long, "train", "x"), (10, long + " y", "validation", "x"), (11, base, "train", "x"), (None, base, "train", "x"),
            (12, base + " one more", "test", "x")]
    df, got = run(spark, data)
    assert {(r["id_l"], r["id_r"]) for r in got.collect()} == brute(data)
    assert {r["overlap"] for r in got.where("id_r = 3").collect()} == {1.0}
    assert C.overlaps(df.limit(0)).count() == 0 and C.report(df.limit(0), got).count() == 0


def cut_up(*records):
    hashed = WordHashes()
    tokens = [hashed(t) for t in records]
    return C.chunks(np.concatenate(tokens), np.cumsum([0, *map(len, tokens[:-1])]))


def test_edits_move_near_cuts_only():
    rng = random.Random(1)
    tokens = [f"word{rng.randrange(5000)}" for _ in range(2000)]
    edited = [*tokens[:500], "inserted", *tokens[500:]]
    digest, length, record = cut_up(tokens, edited)
    a, b = set(digest[record == 0]), set(digest[record == 1])
    assert len(a - b) <= 3 and length[record == 0].sum() == 2000 and 3 < length.mean() < 5
    assert len(C.chunks(np.empty(0, np.uint64), np.empty(0, np.int64))[0]) == 0


def test_chunks_of_a_batch_are_those_of_each_record():
    """Digests do not depend on what stands before a record in its batch."""
    rng = random.Random(2)
    records = [[f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 90))] for _ in range(40)]
    digest, length, record = cut_up(*records)
    for i, r in enumerate(records):
        alone = cut_up(r)
        assert list(digest[record == i]) == list(alone[0]) and list(length[record == i]) == list(alone[1])
    lists, sizes = C.chunk_lists([WordHashes()(r) for r in records])
    assert len(lists) == len(sizes) == 40 and all(len(set(x)) == len(x) == len(n) for x, n in zip(lists, sizes))


def test_salted_chunks_and_exact_way(spark, monkeypatch):
    rng = random.Random(7)
    data = [(i, t, rng.choice(["train", "validation", "test"]), "s") for i, t in enumerate(versions(9, 4, 30))]
    want = brute(data)
    monkeypatch.setattr(C, "SALT_ROWS", 5)
    assert {(r["id_l"], r["id_r"]) for r in run(spark, data)[1].collect()} == want
    df = spark.createDataFrame([(*d, 1, "x") for d in data], SCHEMA)
    assert {(r["id_l"], r["id_r"]) for r in C.overlaps(df, exact=True).collect()} == want


def test_recall_of_reordered_records(spark):
    """Records edited down to the limit and put in another order are found as often as near-duplicates are (0.9975)."""
    rng = random.Random(5)
    vocabulary = [f"{rng.choice('abcdefghijklmnop')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(200)}" for _ in range(3000)]
    data = []
    for i in range(500):
        a = rng.sample(vocabulary, rng.randrange(25, 90))
        b, near = list(a), list(a)
        while len({*a} & {*b}) / len({*a} | {*b}) >= 0.7:
            near = list(b)
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [b[k], rng.choice(vocabulary)]])
        rng.shuffle(near)
        data += [(2 * i, " ".join(a), "train", "s"), (2 * i + 1, " ".join(near), "test", "s")]
    got = {(r["id_l"], r["id_r"]) for r in run(spark, data)[1].collect()}
    assert len([x for x in range(500) if (2 * x, 2 * x + 1) not in got]) <= 1
