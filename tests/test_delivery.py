"""One row per identifier, with deletion vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from annotary.operators import delivery as D
from annotary.runtime import cut

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "delivery_id long, pmid long, received_at timestamp, text string, k string, __file string, _metadata string"
DATA = [
    (1, 10, T0, "a"), (2, 10, T0, "b"), (3, 10, None, "c"), (4, 20, None, "d"), (5, 20, None, "e"), (6, None, T0, "f"), (7, None, T0, "f"),
    (8, 30, T0, None), (9, 40, T0, "x" * 100_000), (9, 40, T0, "x" * 100_000), (None, 50, T0, "n"), (11, 50, T0, "m"),
]


@pytest.fixture
def path(spark, tmp_path):
    df = spark.createDataFrame([(*d, "k", "f", "m") for d in DATA], SCHEMA)
    for i in range(3):
        df.where(F.pmod(F.xxhash64("delivery_id", "text"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")


@pytest.mark.parametrize("words", [D.WORDS_PER_BROADCAST, 1])
def test_keeps_one(spark, path, words):
    vectors = cut(D.deletion_vectors(spark, path, "pmid", ("received_at", "delivery_id")), "v")
    kept = D.read_with_vectors(spark, path, vectors, words=words)
    gone = D.read_with_vectors(spark, path, vectors, deleted=True, words=words)
    assert kept.columns == gone.columns == spark.read.parquet(path).columns
    assert sorted((r["delivery_id"] or 0) for r in kept.collect()) == [1, 4, 6, 7, 8, 9, 11]
    assert sorted((r["delivery_id"] or 0) for r in gone.collect()) == [0, 2, 3, 5, 9]


def test_many_rows_of_one_key(spark, tmp_path):
    to = str(tmp_path / "hot")
    spark.range(5000).select(F.col("id").alias("delivery_id"), F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-1).alias("pmid")).write.parquet(to)
    got = D.one_per_key(spark, to, "pmid", ("delivery_id",))
    assert got.count() == 5000 - 1667 + 1 and got.where("pmid = -1").head()["delivery_id"] == 0


def test_empty_table(spark, tmp_path):
    to = str(tmp_path / "none")
    spark.createDataFrame([], "delivery_id long, pmid long").write.parquet(to)
    assert D.one_per_key(spark, to, "pmid", ("delivery_id",)).count() == 0


def test_groups_and_ranges_of_vectors(spark, tmp_path):
    """Vectors in many groups, and a file with more of them than a broadcast may hold."""
    big = spark.range(5000).selectExpr("id as n", "cast(id % 700 as bigint) as k", "concat('x', id) as wide").coalesce(1)
    small = spark.range(5000, 5200).selectExpr("id as n", "cast(id % 900 as bigint) as k", "concat('x', id) as wide").repartition(3)
    path = f"{tmp_path}/a b%c"
    big.write.parquet(path)
    small.write.mode("append").parquet(path)
    rows = [(r["k"], r["n"]) for r in spark.read.parquet(path).collect()]
    want = {k: min(n for j, n in rows if j == k) for k, _ in rows}
    vectors = D.deletion_vectors(spark, path, "k", ["n"])
    for words in (7, 60, 1000):
        kept = D.read_with_vectors(spark, path, vectors, words=words)
        gone = D.read_with_vectors(spark, path, vectors, deleted=True, words=words)
        got = [(r["k"], r["n"]) for r in kept.collect()]
        assert sorted(got) == sorted(want.items()) and kept.columns == ["n", "k", "wide"]
        assert sorted(got + [(r["k"], r["n"]) for r in gone.collect()]) == sorted(rows)
