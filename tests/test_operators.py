"""Relational operators on small fixtures."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annotary.models.scorers import ContainmentScorer, FirstCandidate, HashEmbedder, RuleClassifier
from annotary.models.train import fine_tune, fine_tune_pairs, validation_split
from annotary.operators import metrics, mining, ontology, ordering, splits, stages, validate
from annotary.operators.apply import embed, top_k


def test_number_rows_has_no_gaps(spark, rows):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int")
    got = rows(ordering.number_rows(df, ["k"]), "row_nr", "k")
    assert sorted(got) == [(i, i) for i in range(101)]
    assert rows(ordering.number_rows(df.limit(0), ["k"])) == []


def test_shards_part_the_input(spark):
    df = ordering.number_rows(spark.range(50), ["id"])
    parts = [{r["id"] for r in ordering.row_shard(df, i, 3).collect()} for i in range(3)]
    assert set.union(*parts) == set(range(50)) and sum(map(len, parts)) == 50
    assert ordering.row_shard(df, 0, 0).count() == 50
    files = spark.createDataFrame([("c",), ("a",), ("b",)], "path string")
    assert [r["path"] for r in ordering.file_shard(files, 1, 2).collect()] == ["b"]
    assert ordering.file_shard(files, None, 2).count() == 3


def test_batches_cover(spark, rows):
    df = ordering.number_rows(spark.range(25), ["id"])
    assert sorted(rows(ordering.batches(df, 10))) == [(0, 0, 10), (1, 10, 20), (2, 20, 25)]


def test_running_sums(spark, rows):
    df = spark.createDataFrame([(i, 1) for i in range(40)], "k int, v int")
    assert all(s == k + 1 for k, s in rows(ordering.running_sums(df, ["k"], ["v"]), "k", "sum_v"))


def test_ontology_rendering(spark):
    df = spark.createDataFrame([("G1", None, "604149"), ("G1", None, "604149")], "`g2p id` string, `gene symbol` string, `gene mim` string")
    got = ontology.labels(df).collect()
    assert len(got) == 1 and got[0][0] == "G1 -  - 604149" + " - " * 12
    assert ontology.labels(df, "nan").head()[0].startswith("G1 - nan - 604149 - ")


LABELS = ["red fox", "blue fox", "red", "dog", "", "grey wolf pack"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="redfoxblu gwpack", max_size=20), min_size=1, max_size=4), st.integers(1, 7), st.integers(1, 3))
def test_top_k_by_blocks_is_global_top_k(spark, texts, k, block):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    got = {r["id"]: [(x["label"], x["score"]) for x in r["top5_cross"]] for r in top_k(df, ["id"], labels, ContainmentScorer, k, block, blocks_per_pass=2).collect()}
    for i, t in enumerate(texts):
        score = lambda x, t=t: len(set(x.split()) & set(t.split())) / max(1, len(x.split()))
        assert got[i] == sorted(((x, score(x)) for x in LABELS), key=lambda p: (-p[1], p[0]))[:k]


def test_top_k_leaves_nan_out_and_gives_all_of_few(spark):
    class NaN:  # here, so that it travels with the task
        def fit(self, labels):
            self.n = len(labels)

        def score(self, texts):
            return np.array([[np.nan] + [1.0] * (self.n - 1)] * len(texts))

    df = spark.createDataFrame([(1, None)], "id int, text string")
    labels = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "label string")
    assert [x["label"] for x in top_k(df, ["id"], labels, NaN).head()["top5_cross"]] == ["b"]
    assert top_k(df, ["id"], labels.limit(0), NaN).head()["top5_cross"] == []
    assert top_k(df.limit(0), ["id"], labels, NaN).count() == 0


def test_adjudication(spark):
    df = spark.createDataFrame([(1, "text", [("G2P1 - A", 0.5)]), (2, None, None)], "id int, tiab string, top5_cross array<struct<label:string,score:double>>")
    assert {r["id"]: r["llm_dis_map"] for r in stages.adjudicated(df, FirstCandidate).collect()} == {1: "G2P1", 2: "NO MATCH"}


def test_classified(spark):
    df = spark.createDataFrame([(1, "gene variant", None, "eng", 2000), (2, None, None, "eng", 2000), (3, "gene", "gene", "fre", 2000)], "pmid long, title string, abstract string, languages string, pubdate int")
    assert {(r["pmid"], r["tiab"], r["bert_predict"]) for r in stages.classified(df, RuleClassifier).collect()} == {(1, "gene variant", 1), (2, "", 0)}


def test_validation_plan(spark):
    onto = spark.createDataFrame([("G2P1", "A", "one"), ("G2P2", "B", "two"), ("G2P2", "C", "two"), ("G2P3 ", "D", "three"), ("G2P4", None, "four")], "g2p_id string, gene_symbol string, disease_name string")
    mentions = spark.createDataFrame([(1, 10, "7;8"), (2, 10, "9.0"), (3, 20, "7"), (4, 10, "7"), (5, 30, "x"), (6, None, "7")], "mention_id long, pmid long, entity_id string")
    genes = spark.createDataFrame([(9606, 7, "A"), (10090, 7, "a"), (9606, 9, "B"), (9606, 8, "C"), (9606, 5, None)], "tax_id long, geneid long, symbol string")
    cases = [
        (1, 10, "G2P1", 0.9), (2, 10, "G2P1;G2P9;'G2P1'", 0.95), (3, 10, "G2P2", 0.95), (4, 20, "G2P1", 0.8999), (5, 20, "G2P1", float("nan")),
        (6, 20, "G2P1", None), (7, 20, "NO MATCH", 1.0), (8, 20, None, 1.0), (9, 20, "G2P3", 1.0), (10, 30, "G2P1", 1.0), (11, 20, "G2P4", 1.0),
    ]
    answers = spark.createDataFrame(cases, "map_id long, pmid long, llm_dis_map string, best double")
    got = {r["map_id"]: r for r in validate.final_mapping(answers, onto, mentions, genes, ["map_id"]).collect()}
    assert set(got) == {1, 2}
    assert got[2]["llm_dis_map"] == "G2P1;G2P1" and got[2]["dis_map_gene"] == ["A"] and got[2]["dis_map_name"] == ["one"] and got[2]["gene_symbols"] == ["A", "B"]
    every = {r["map_id"]: r["dis_map_gene"] for r in validate.final_mapping(answers, onto, mentions, genes, ["map_id"], all_rows=True).collect()}
    assert every == {1: ["A"], 2: ["A"], 3: ["B", "C"], 10: ["A"], 11: ["nan"]}
    fixed = {r["map_id"]: r["dis_map_gene"] for r in validate.final_mapping(answers, onto, mentions, genes, ["map_id"], null_text=None, all_rows=True).collect()}
    assert fixed[11] == []


def test_group_split(spark):
    data = [(f"t{i % 40}", i % 2 if i < 40 else 0) for i in range(100)] + [(None, 1)]
    df = spark.createDataFrame(data, "tiab string, label int")
    got = splits.group_split(df)
    assert got.count() == 100 and splits.overlap(got).isEmpty()
    sides = {r["tiab"]: r["side"] for r in got.collect()}
    assert sum(s == "test" for s in sides.values()) == math.ceil(0.2 * 20) * 2
    splits.assert_disjoint(got)
    with pytest.raises(ValueError):
        splits.assert_disjoint(got.unionByName(got.limit(1).withColumn("side", F.lit("other"))))


def test_label_check(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "label int")
    assert splits.checked_labels(df).count() == 3
    with pytest.raises(Exception, match="outside 0/1"):
        splits.checked_labels(spark.createDataFrame([(2,)], "label int")).collect()


def test_metrics(spark):
    none = spark.createDataFrame([(0, 0), (0, 1)], "pred int, label int")
    got = metrics.binary(none).head()
    assert (got["precision"], got["recall"], got["f1"], got["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    assert metrics.binary(none.limit(0)).head()["accuracy"] == 0.0
    perfect = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.1, 0), (float("nan"), 1), (None, 0)], "score double, label int")
    got = metrics.pair_evaluation(perfect).head()
    assert (got["average_precision"], got["best_f1"], got["f1_threshold"], got["best_accuracy"]) == (1.0, 1.0, 0.8, 1.0)
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert metrics.pair_evaluation(tied).head()["average_precision"] == 0.5


def test_hard_negatives_against_brute_force(spark):
    rng = np.random.default_rng(0)
    data = [(i, i % 3, rng.normal(size=8).tolist()) for i in range(60)] + [(60, 9, [0.0] * 8), (61, 0, None)]
    df = spark.createDataFrame(data, "id long, grp int, v array<double>")
    got = sorted(map(tuple, mining.hard_negatives(df, df.where("id % 20 = 0"), range_min=2, range_max=10, n=3).collect()))
    full = [d for d in data if d[2] is not None]
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, _, v in full}
    want = []
    for i, g, _ in full:
        pos = [unit[i] @ unit[j] for j, h, _ in full if h == g and j != i]
        if i % 20 or not pos:
            continue
        limit = min(0.95, max(pos) * 0.99)
        ranked = sorted((-(unit[i] @ unit[j]), j) for j, h, _ in full if h != g and unit[i] @ unit[j] <= limit)
        want += [(i, j, k) for k, (_, j) in enumerate(ranked, 1) if 2 < k <= 5]
    assert got == sorted(want)


def test_training_stand_ins(spark):
    data = [(i, "gene variant syndrome" if i % 2 else "river stone", i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "id long, tiab string, label int").withColumn("g2p_lgmde", F.lit("x"))
    model, epoch = fine_tune(validation_split(df, "id"), epochs=2)
    assert epoch in (1, 2)
    got = model.transform(df.select(F.col("tiab").alias("text"))).select("prediction").distinct().count()
    assert got == 2
    assert fine_tune_pairs(df, epochs=1) is not None


def test_embedding(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string").select(embed(F.col("t"), HashEmbedder).alias("v"))
    assert sorted(len(r["v"]) for r in df.collect()) == [64, 64]
