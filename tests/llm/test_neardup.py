"""Near-duplicates against brute force, crowded regions included."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from annotary.llm import neardup as N
from annotary.functions.tokens import words
from tests_llm_helpers import versions


def brute(data, least=0.7, min_words=20):
    sets = [(i, frozenset(words(t))) for i, t in data if i is not None and t]
    pairs = set()
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i != j and len(a) >= min_words and len(b) >= min_words and len(a & b) / len(a | b) >= least:
            pairs.add((min(i, j), max(i, j)))
    return pairs


SCHEMA = "id long, text string"


def found(spark, data, **options):
    return {tuple(r) for r in N.near_pairs(spark.createDataFrame(data, SCHEMA), **options).collect()}


def test_against_brute_force(spark):
    data = list(enumerate(versions(1, 40, 5)))
    want = brute(data)
    assert len(want) > 200 and found(spark, data) == want


def edited(threshold, n=400, size=80):
    """Pairs whose similarity is at the threshold or a little above, and single texts."""
    rng = random.Random(5)
    data = []
    for i in range(n):
        a = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        keep = math.ceil(2 * size * threshold / (1 + threshold))
        b = a[:keep] + [f"w{rng.randrange(10**6)}" for _ in range(size - keep)]
        rng.shuffle(b)
        data += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    return data


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.9])
def test_recall_at_each_threshold(spark, threshold):
    """The layout follows the threshold: pairs at the limit are found as often as stated."""
    data = edited(threshold)
    want = {(2 * i, 2 * i + 1) for i in range(400)}
    got = found(spark, data, threshold=threshold)
    assert got <= want and len(got) >= 0.98 * len(want)


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_exact_way(spark, threshold):
    data = [*edited(threshold, 100), *((10_000 + i, t) for i, t in enumerate(versions(4, 10, 5)))]
    assert found(spark, data, threshold=threshold, exact=True) == brute(data, threshold)


def test_crowded_regions():
    # the operators run in worker processes, so the functions are exercised here
    texts = versions(2, 3, 40)
    sets = [sorted(set(words(t))) for t in texts]
    hashed = N.WordHashes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([hashed(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cid", "hashes"])
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.7}
    for small, block, held in ((48, 1024, 262_144), (4, 6, 262_144), (4, 6, 16), (2, 1024, 5)):
        f = N.forest(0.7, small=small, block=block, held=held)
        rows = pa.Table.from_batches(N._keys(f)(iter([batch]))).sort_by([("key", "ascending"), ("cid", "ascending")])
        pairs, crowded = set(), []
        for b in N._neighbours(f)(iter(rows.to_batches(max_chunksize=7))):
            for r in b.to_pylist():
                if r["a"] is not None:
                    pairs.add((r["a"], r["b"]))
                else:
                    crowded.append(r)
        rest = pd.DataFrame(crowded)
        for _, g in rest.groupby("key") if len(rest) else []:
            blocks = -(-len(g) // block)
            own = g["cid"] % blocks
            for lo in range(blocks):
                for hi in range(lo, blocks):
                    part = g.assign(own=own)[own.isin([lo, hi])]
                    pairs |= {tuple(map(int, p)) for p in N._block_pairs(f.agree)((0, lo, hi), part).to_numpy()}
        assert want <= pairs, (small, block, held)
        assert all(a < b for a, b in pairs)


@pytest.mark.parametrize("limits", [{"small": 2, "block": 7}, {"small": 4, "block": 16, "held": 20}])
def test_block_path_in_spark(spark, limits):
    """Crowded rows through the salted comparison of blocks: regions of 150 classes, blocks of few."""
    data = [(i, " ".join(f"c{j}" for j in range(40)) + f" own{i}") for i in range(150)] + [(1000 + i, t) for i, t in enumerate(versions(6, 5, 4))]
    assert found(spark, data, **limits) == brute(data)


@pytest.mark.parametrize(("hot", "listed"), [(3, 1000), (12, 1000), (60, 1000), (3, 2)])
def test_hot_regions_are_dealt_out(spark, monkeypatch, hot, listed):
    """Regions hot at each depth, the full key included: the same pairs, and no partition holds a hot region."""
    monkeypatch.setattr(N, "LISTED", listed)
    data = [(i, " ".join(f"c{j}" for j in range(40)) + f" own{i}") for i in range(120)] + [(1000 + i, t) for i, t in enumerate(versions(6, 20, 6))]
    assert found(spark, data, small=2, block=16, looked=1, hot=hot) == brute(data)
    f = N.forest(0.7, small=2, looked=1, hot=hot)
    classes = N.classes_of(spark.createDataFrame(data, SCHEMA), 20)[0]
    regions = N.hot_regions(classes, f)
    rows = N.placed(classes.mapInArrow(N._keys(f), N._ROWS), regions, f)
    assert {r["depth"] for r in regions.collect()} and rows.count() == classes.count() * f.trees
    most = rows.where("place is not null").groupBy("place").count().agg({"count": "max"}).head()[0]
    assert most < hot


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    base = " ".join(f"b{i}" for i in range(30))
    data = [(1, base), (2, base.upper()), (2, base), (3, None), (4, ""), (5, "a b c"), (6, "a b c"), (None, base), (7, long), (8, long + " x"), (9, " ".join(reversed(base.split())))]
    assert found(spark, data) == {(1, 2), (1, 9), (2, 9), (7, 8)}
    groups = {r["id"]: (r["group_id"], r["copies"], r["links"]) for r in N.near_groups(spark.createDataFrame(data, SCHEMA)).collect()}
    assert groups[9] == groups[1] == (1, 3, 0) and groups[8] == (7, 1, 1) and groups[5] == (5, 1, 0) and groups[3] == (3, 1, 0)
    assert set(groups) == set(range(1, 10))


def test_empty_table_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA + ", cid long, words string, a int, tree int")
    assert N.near_pairs(none).count() == 0 and N.near_groups(none).count() == 0
    base = " ".join(f"b{i}" for i in range(30))
    more = spark.createDataFrame([(1, base, 9, "x", 1, 2), (2, base, 9, "x", 1, 2)], SCHEMA + ", cid long, words string, a int, tree int")
    assert [tuple(r) for r in N.near_pairs(more).collect()] == [(1, 2)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["root"] for r in N.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == 100


@pytest.mark.parametrize("s", [0.45, 0.5, 0.6, 0.7, 0.75, 0.8, 0.95, 1.0])
def test_layout(s):
    f = N.forest(s)
    assert 1 - (1 - s**f.depth) ** f.trees >= N.RECALL and f.trees * f.depth <= N.VALUES and f.depth * f.bits + 6 <= 64
    with pytest.raises(ValueError):
        N.forest(0.01)


def test_sketch_counts_bits_of_negative_numbers():
    a, b = np.array([-1], np.int64), np.array([-2], np.int64)
    assert N._alike(92, a, b, a, a)[0]
    assert not N._alike(92, np.array([0], np.int64), a, a, a)[0]
