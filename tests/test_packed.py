"""Unpacking packed fields."""

import itertools
import math

import pytest

from annotary.functions import packed as P
from annotary.operators.packed import unpack

NAME = "renoplasia disorder, with short stature"
CASES = [
    ("G2P1", ["G2P1"]), ("G2P1;G2P2", ["G2P1", "G2P2"]), ("G2P1 | G2P2", ["G2P1", "G2P2"]), ("G2P1||G2P2", ["G2P1", "G2P2"]), ("['G2P1', 'G2P2']", ["G2P1", "G2P2"]),
    ('"G2P1, G2P2"', ["G2P1", "G2P2"]), ('"G2P1, G2P2', ["G2P1", "G2P2"]), ("'G2P1;G2P2", ["G2P1", "G2P2"]), ("G2P1\nG2P2", ["G2P1", "G2P2"]), ("G2P1\t G2P1", ["G2P1", "G2P1"]),
    ("G2P1, G2P2 and G2P3", ["G2P1", "G2P2", "G2P3"]), ("G2P1 & G2P2", ["G2P1", "G2P2"]), ("G2P1 / G2P2", ["G2P1", "G2P2"]), ("“G2P1”; `G2P2`", ["G2P1", "G2P2"]), (";G2P1;", ["G2P1"]),
    (f'"{NAME}"', [NAME]), (f'G2P1;"{NAME}";G2P2', ["G2P1", NAME, "G2P2"]), ('"myotropia ataxia, so-called ""blue"" form"', ['myotropia ataxia, so-called "blue" form']),
    ("\"Smith's hepatosis disorder\" | G2P3", ["Smith's hepatosis disorder", "G2P3"]), ("NO MATCH", []), ("No match.", []), ("none of the candidates", []), ("-", []), (" ; ", []), ("", []), (None, []),
    ("9.0", ["9.0"]), ("x7", ["x7"]), (";".join(f"G2P{i}" for i in range(2000)), [f"G2P{i}" for i in range(2000)]), ("G2P1", ["G2P1"]),
]


@pytest.mark.parametrize(("field", "n"), [("G2P1", 1), ("G2P1;G2P2", 2), (" ;, ", 0), ("-", 0), ('"a, b"; c', 3), ("'a;b", 2), ("", 0)])
def test_atoms(field, n):
    assert len(P.read(field).atoms) == n


@pytest.mark.parametrize("field", ["x1;x2 x3", '"a b, c" 7', "'p;q' and r9 s", "a b c d e f"])
def test_lattice_against_all_paths(field):
    """Forward-backward and Viterbi against every path of the lattice."""
    f = P.read(field)
    es = P.edges(f, f)
    log_p = [-0.1 - 0.37 * (i % 5) for i in range(len(es))]
    paths = []

    def walk(at, path):
        if at == len(f.atoms):
            paths.append(path)
        for k, e in enumerate(es):
            if e.at == at:
                walk(e.to, [*path, k])

    walk(0, [])
    weight = [math.exp(sum(log_p[k] + math.log(P.MORE) for k in p)) for p in paths]
    post, best = P.posteriors(len(f.atoms), es, log_p)
    assert math.isclose(max(weight), weight[paths.index(best)])
    for k in range(len(es)):
        assert math.isclose(post[k], sum(w for w, p in zip(weight, paths) if k in p) / sum(weight), abs_tol=1e-9)
    assert P.apply_path(field, P.spell(es, best)) == [f.value(es[k]) for k in best if es[k].kind != P.FILLER]


def test_unpack(spark):
    df = spark.createDataFrame([("t", i, f) for i, (f, _) in enumerate(CASES)], "tab string, row_key long, raw string")
    got: dict = {}
    for r in unpack(df).sort("row_key", "pos").collect():
        got.setdefault(r["row_key"], []).append((r["pos"], r["item"]))
    for i, (field, want) in enumerate(CASES):
        assert got.get(i, []) == list(enumerate(want, 1)), field


def test_columns_are_apart_and_empty_tables_work(spark):
    df = spark.createDataFrame([("a", 1, '"x y"'), ("b", 1, "7;8"), ("b", 1, "7;8")], "tab string, row_key long, raw string")
    got = sorted((r["tab"], r["pos"], r["item"]) for r in unpack(df).collect())
    assert got == [("a", 1, "x y"), ("b", 1, "7"), ("b", 1, "7"), ("b", 2, "8"), ("b", 2, "8")]
    assert unpack(df.limit(0)).count() == 0


def test_values_decide_where_shapes_do_not(spark):
    """Names of one or two words, bare, with blanks between: the shapes speak for single words, the values tell where a name ends."""
    names = ["New York", "Los Angeles", "Boston", "Dallas", "San Jose", "Miami", "Denver"]
    rows = [";".join(p) for p in itertools.permutations(names, 2)] * 3 + names * 20 + ["New York Boston", "Dallas San Jose", "Los Angeles New York"]
    df = spark.createDataFrame([("t", i, f) for i, f in enumerate(rows)], "tab string, row_key long, raw string")
    got: dict = {}
    for r in unpack(df, digit=False, sure=2.0).sort("row_key", "pos").collect():
        got.setdefault(r["row_key"], []).append(r["item"])
    n = len(rows)
    assert [got[n - 3], got[n - 2], got[n - 1]] == [["New York", "Boston"], ["Dallas", "San Jose"], ["Los Angeles", "New York"]]
    assert all(got[i] == f.split(";") for i, f in enumerate(rows[: n - 3]))


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, "1;2", "x", 1.0), ("t", None, "3", "y", 2.0), ("t", 4, None, "z", 3.0)], "tab string, row_key long, raw string, shape string, path double")
    assert sorted((r["row_key"], r["item"]) for r in unpack(df.where("tab is not null")).collect()) == [(None, "3")]
