"""Leaked passages against brute force over n-grams."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from annotary.llm import leakage as L
from annotary.functions.tokens import words

SCHEMA = "id long, text string, items string, spans int"
ITEMS = "item_id long, text string, task string"


def brute(docs, items, least=L.LEAST):
    grams = lambda t: {tuple(w[i : i + least]) for w in [words(t)] for i in range(len(w) - least + 1)}
    held = [(i, grams(t)) for i, t in items if i is not None and t]
    return {(d, i) for d, t in docs if d is not None and t for g in [grams(t)] for i, h in held if g & h}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=14), min_size=1, max_size=4), st.text(alphabet="abcd", max_size=30), st.integers(1, 5))
def test_automaton_finds_longest_passages(items, doc, least):
    auto = L.Automaton([(i, list(t)) for i, t in enumerate(items)], least)
    found, spans = auto.scan(list(doc))
    want = {}
    for i, t in enumerate(items):
        n = max((k for k in range(least, len(t) + 1) if any(t[a : a + k] in doc for a in range(len(t) - k + 1))), default=0)
        if n:
            want[i] = n
    assert found == want
    covered = {k for a, b in spans for k in range(a, b)}
    hit = {k for a in range(len(doc) - least + 1) if any(doc[a : a + least] in t for t in items) for k in range(a, a + least)}
    assert covered == hit


def make(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = [(i, text(rng.randrange(5, 60))) for i in range(25)]
    items += [(90, items[3][1]), (91, None), (92, ""), (None, text(30))]
    docs = []
    for d in range(80):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items[:25])[1]).split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randrange(4, 40)]).upper().replace(" ", rng.choice([" ", ",\n", " - "])), text(5)]
        docs.append((d, " ".join(parts)))
    return docs + [(200, None), (201, ""), (None, items[0][1])], items


def test_against_brute_force(spark):
    docs, items = make(11)
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], SCHEMA)
    i = spark.createDataFrame([(*x, "t") for x in items], ITEMS)
    want = brute(docs, items)
    assert len(want) > 20
    assert {(r["id"], r["item_id"]) for r in L.leaks(d, i).collect()} == want
    small = {(r["id"], x["item_id"]) for r in L.scan(d, i, block_words=50).collect() for x in r["items"]}
    assert small == want


def test_decontaminate(spark):
    item = " ".join(f"i{k}" for k in range(30))
    docs = [(1, f"Before, {item.upper()}! After it comes more prose than was leaked: " + "x " * 60), (2, item), (3, "clean"), (4, None), (5, "y " * 50 + " ".join(item.split()[:15]))]
    d = spark.createDataFrame(docs, "id long, text string")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["id"]: r for r in L.decontaminate(d, i).collect()}
    assert got[1]["text"].startswith("Before, ! After it") and got[1]["removed"] == 1 and not got[1]["dropped"]
    assert got[2]["text"] == "" and got[2]["dropped"] and got[2]["coverage"] == 1.0
    assert got[3]["text"] == "clean" and got[3]["removed"] == 0 and got[4]["text"] is None
    assert got[5]["removed"] == 0 and 0 < got[5]["coverage"] < 0.5


def test_clean_repeated_ids_and_several_passes(spark, monkeypatch):
    """Row by row: an id may recur with another text; spans of all passes are cut from the text as it stands."""
    items = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdefghijkl"]
    docs = [(1, "x " + items[0]), (1, "short"), (None, items[5] + " y"), (2, f"p {items[1]} q {items[7]} r {items[11]}"), (3, "İİ z. " + items[2] + " İ end")]
    d = spark.createDataFrame(docs, "id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = [("x ", 1), ("short", 0), (" y", 1), ("p  q  r ", 3), ("İİ z.  İ end", 1)]
    for words in (30, 60, 10_000):
        got = sorted((r["text"], r["removed"]) for r in L.decontaminate(d, i, block_words=words).collect())
        assert got == sorted(want), words


def test_long_documents_and_empty_tables(spark):
    item = " ".join(f"i{k}" for k in range(30))
    d = spark.createDataFrame([(1, "pad " * 300_000 + item)], "id long, text string")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(r) for r in L.leaks(d, i).collect()] == [(1, 1, 30)]
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0
