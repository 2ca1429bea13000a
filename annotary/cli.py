"""Command line: ``python -m annotary.cli STAGE ...``, one stage of the pipeline each.

Shards are kept for parity: on a cluster the scheduler deals out the work, so the
defaults take everything in one job.
"""

from __future__ import annotations

import argparse
import importlib
import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary import schemas
from annotary.models import scorers, train
from annotary.models.devices import configured
from annotary.operators import metrics, mining, ontology, ordering, splits, stages, validate
from annotary.operators.apply import embed, top_k
from annotary.functions.text import max_score
from annotary.sinks.files import done, note_done, shard_name, write, write_new, write_parts
from annotary.runtime import cut
from annotary.sources import files, links, xml


def model(path: str) -> scorers.Factory:
    """A factory by ``module:name``; a bare name is one of the stand-ins."""
    module, _, name = path.rpartition(":")
    return getattr(importlib.import_module(module or scorers.__name__), name)


def download(spark: SparkSession, a: argparse.Namespace) -> int:
    """Files of the index pages that the folder lacks; the outcome of each is in ``OUT_log``. Returns how many came."""
    pages = cut(links.fetch_pages(spark, a.index), "pages")
    found = links.all_links(*[links.file_links(pages.where(F.col("base_url") == u)) for u in a.index])
    os.makedirs(a.out, exist_ok=True)
    wanted = links.missing_files(found, links.existing_files(spark, a.out))
    log = f"{a.out}_log/run={uuid.uuid4().hex}"
    links.fetch_files(wanted, a.out, a.at_once).write.parquet(log)
    lost = pages.where("error is not null").select(F.lit("").alias("name"), F.col("base_url").alias("url"), F.lit(0).cast("long").alias("bytes"), "error")
    lost.write.mode("append").parquet(log)
    return spark.read.parquet(log).where("error is null").count()


def to_parquet(spark: SparkSession, a: argparse.Namespace) -> int | None:
    """XML files to article tables; unreadable files and bad rows are set apart, with --no-rows_only all rows of a file with a bad one."""
    names = {p: p.rsplit("/", 1)[-1] for p in xml.xml_files(spark, a.input)}
    before = done(spark, a.out) if a.skip_if_exists else set()
    # files of one stem share a partition and are taken together
    stems = {xml.file_stem(n) for n in names.values() if n not in before}
    new = {p: n for p, n in names.items() if xml.file_stem(n) in stems}
    if not new:
        return None
    checked = xml.check_files(spark, list(new))
    good, bad = xml.quarantine(xml.read_articles(spark, a.input, checked), whole_files=not a.rows_only)
    write_new(bad.select("source_file", "pmid", "error").distinct(), f"{a.out}_quarantine", "source_file", new.values())
    n = write_new(good, a.out, "source_stem", stems)
    # a file that is set apart whole is tried again, it may have been replaced
    apart = {new[p] for p, error in checked if error}
    if not a.rows_only:
        apart |= {r["source_file"] for r in spark.read.schema("pmid long, source_file string").parquet(f"{a.out}_quarantine").select("source_file").distinct().collect()}
    note_done(spark, a.out, set(new.values()) - apart)
    return n


def classify(spark: SparkSession, a: argparse.Namespace) -> int | None:
    """Eligible articles with their class, by a factory (``module:name``) or a trained model (its folder); those of each source or file are a partition ``input_part`` of the output."""
    base, names = files.parquet_files(spark, a.input)
    parts = sorted({files.input_part(n) for n in names})
    if a.num_shards > 1 and parts:
        every = spark.createDataFrame([(n,) for n in parts], "path string")
        parts = [r["path"] for r in ordering.file_shard(every, a.shard, a.num_shards).collect()]
    before = done(spark, a.out) if a.skip_if_exists else set()
    new = set(parts) - before
    if not new:
        return None
    if "/" in a.model:  # what tune-classifier wrote
        trained = PipelineModel.load(a.model)
        by = lambda df: stages.classified_by(df, trained)
    else:
        factory = configured(model(a.model), a.device)
        by = lambda df: stages.classified(df, factory)
    rows = lambda keys: by(files.some_parquet(spark, base, [n for n in names if files.input_part(n) in keys], "input_part"))
    n, taken = write_parts(rows, a.out, "input_part", new, spark, a.fail_fast)
    note_done(spark, a.out, taken)
    return n


def positives(spark: SparkSession, a: argparse.Namespace) -> int | None:
    return write(stages.positives(spark.read.parquet(a.processed_dir)).drop("input_part"), a.out_path)


def cross_score(spark: SparkSession, a: argparse.Namespace) -> int | None:
    """Texts against the ontology; the row number is given before shards are taken."""
    rows = spark.read.parquet(a.input_parquet)
    # a total order: each shard is a run of its own, and all must number alike; rows equal in all of it can change places
    rows = rows.withColumn("__digest", F.md5(F.to_json(F.struct("*"))))
    rows = ordering.number_rows(rows, [a.order_by, "tiab", "__digest"]).drop("__digest")
    rows = ordering.row_shard(rows, a.shard, a.num_shards)
    names = ontology.labels(files.csv_texts(spark, a.g2p_csv, a.g2p_columns.split(",") if a.g2p_columns else ["g2p id", *schemas.ONTOLOGY_COLUMNS[1:]]))
    best = top_k(rows.select("row_nr", F.col("tiab").alias("text")), ["row_nr"], names.withColumnRenamed("g2p_lgmde", "label"), configured(model(a.model_path), a.device, a.dtype), a.top_k, a.g_block_size, chunk=a.chunk_size)
    to = f"{a.out_dir}/{shard_name(a.input_parquet.rstrip('/').rsplit('/', 1)[-1].removesuffix('.parquet'), a.shard, a.num_shards)}"
    return write(rows.join(best, "row_nr"), to, compression=a.compression, skip_if_exists=a.skip_if_exists)


def llm_map(spark: SparkSession, a: argparse.Namespace) -> int | None:
    """Prompts, answers and mappings, some input files at a time; files that are noted as done are not read again."""
    if a.out_dir.rstrip("/") == a.shards_dir.rstrip("/"):
        raise SystemExit("the output folder must not be the input folder")
    base, names = files.parquet_files(spark, a.shards_dir)
    parts = sorted({files.input_part(n) for n in names})
    if a.num_shards > 0 and a.shard_index >= 0 and parts:
        every = spark.createDataFrame([(n,) for n in parts], "path string")
        parts = sorted(r["path"] for r in ordering.file_shard(every, a.shard_index, a.num_shards, at_least_one=False).collect())
    before = done(spark, a.out_dir)
    new = [p for p in parts if p not in before]
    if not new:
        return None
    factory = configured(model(a.llm_model), temperature=a.temperature, top_p=a.top_p, max_tokens=a.max_tokens)
    rows = lambda keys: stages.adjudicated(
        files.some_parquet(spark, base, [n for n in names if files.input_part(n) in keys], "input_part"), factory, size=a.batch_size
    )
    total = 0
    for at in range(0, len(new), a.save_files):
        n, taken = write_parts(rows, a.out_dir, "input_part", set(new[at : at + a.save_files]), spark, a.fail_fast)
        total += n
        note_done(spark, a.out_dir, taken)
    return total


def final_clean(spark: SparkSession, a: argparse.Namespace) -> int | None:
    answers = ordering.number_rows(files.union_by_name(*[spark.read.parquet(p) for p in a.input]), ["pmid", "llm_dis_map", "tiab"], "map_nr")
    answers = answers.drop("input_part").withColumn("pmid", F.col("pmid").cast("bigint")).withColumn("best", max_score(F.col("top5_cross")))
    ids = ontology.normalise(files.csv_with_missing(spark, a.g2p_csv, ["g2p id", *schemas.ONTOLOGY_COLUMNS[1:]]))
    ids = ids.toDF(*[c.replace(" ", "_").lower() for c in ids.columns])
    mentions = files.gene_mentions(spark, a.pubtator)
    mentions = ordering.number_rows(mentions, ["pmid", "entity_id", "mention"], "mention_id")
    genes = files.gene_info(spark, a.gene_info, ["tax_id", "GeneID", "Symbol"]).toDF("tax_id", "geneid", "symbol")
    return write(validate.final_mapping(answers, ids, mentions, genes, ["map_nr"], a.threshold), a.out)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.csv_with_missing(spark, a.input, ["tiab", "g2p_lgmde", "label"]).withColumn("label", F.col("label").cast("int"))
    sides = splits.assert_disjoint(splits.group_split(splits.checked_labels(rows), share=a.test_size, seed=a.seed))
    for side in ("train", "test"):
        write(sides.where(F.col("side") == side).select("tiab", "g2p_lgmde", "label"), f"{a.out}/{side}")


def mine(spark: SparkSession, a: argparse.Namespace) -> int | None:
    """Hard negatives for the positive pairs of a train set among all ontology labels."""
    pairs = spark.read.schema(schemas.ANNOTATED).parquet(a.train)
    pairs = pairs if a.all_labels else pairs.where("label = 1")
    names = ontology.labels(files.csv_with_missing(spark, a.g2p_csv, ["g2p id", *schemas.ONTOLOGY_COLUMNS[1:]]), "nan", inferred=True)
    # labels are ranked, texts are not; a positive that the ontology lacks is a label too
    pairs = pairs.where("tiab is not null and g2p_lgmde is not null")
    labels = names.select(F.col("g2p_lgmde").alias("t")).unionByName(pairs.select(F.col("g2p_lgmde").alias("t"))).distinct().withColumn("kind", F.lit(1))
    texts = pairs.select(F.col("tiab").alias("t")).distinct().withColumn("kind", F.lit(0))
    every: DataFrame = ordering.number_rows(texts.unionByName(labels), ["kind", "t"], "id")
    vectors = every.withColumn("v", embed(F.col("t"), model(a.model)))
    ids = lambda kind, to, n: every.where(F.col("kind") == kind).select(F.col("t").alias(to), F.col("id").alias(n))
    positive = pairs.join(ids(0, "tiab", "anchor"), "tiab").join(ids(1, "g2p_lgmde", "cand"), "g2p_lgmde").select("anchor", "cand")
    negatives = mining.hard_negatives(
        vectors.where("kind = 1"), vectors.where("kind = 0"), a.max_score, a.relative_margin, a.range_min, a.range_max, a.num_negatives, positives=positive
    )
    out = mining.labeled_pairs(positive, negatives)
    text = lambda n, to: every.select(F.col("id").alias(n), F.col("t").alias(to))
    return write(out.join(text("anchor", "tiab"), "anchor").join(text("cand", "g2p_lgmde"), "cand").select("tiab", "g2p_lgmde", "label"), a.out)


def tune_classifier(spark: SparkSession, a: argparse.Namespace) -> None:
    """A text classifier from a train set, the best of several epochs by F1 on a validation side; model and metrics are written."""
    numbered = ordering.number_rows(spark.read.schema(schemas.ANNOTATED).parquet(a.train), ["tiab", "g2p_lgmde", "label"], "nr")
    sides = train.validation_split(numbered, "nr", share=a.val_size, seed=a.seed)
    best, epoch = train.fine_tune(sides, epochs=a.epochs, decay=a.weight_decay)
    checks = {"validation": sides.where("side = 'test'"), "test": spark.read.schema(schemas.ANNOTATED).parquet(a.test)} if a.test else {"validation": sides.where("side = 'test'")}
    found = [metrics.binary(train.scored(best, df)).select(F.lit(k).alias("split"), F.lit(epoch).alias("epoch"), "*") for k, df in checks.items()]
    train.save(best, files.union_by_name(*found), a.out)


def tune_scorer(spark: SparkSession, a: argparse.Namespace) -> None:
    """A pair scorer from labelled pairs; its evaluation on held-out pairs is written with the model."""
    pairs = spark.read.schema(schemas.ANNOTATED).parquet(a.train)
    best, epoch = train.fine_tune_pairs(pairs, epochs=a.epochs, seed=a.seed)
    held = spark.read.schema(schemas.ANNOTATED).parquet(a.test or a.train).withColumn("tiab", F.concat_ws(" ", "tiab", "g2p_lgmde"))
    found = metrics.pair_evaluation(train.scored(best, held)).select(F.lit("test" if a.test else "train").alias("split"), F.lit(epoch).alias("epoch"), "*")
    train.save(best, found, a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="annotary")
    sub = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, f, **options) -> None:
        p = sub.add_parser(name, help=f.__doc__)
        p.set_defaults(run=f)
        for k, v in options.items():
            flag = f"--{k}"
            if isinstance(v, bool):
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=v)
            elif v is ...:
                p.add_argument(flag, required=True)
            elif isinstance(v, list):
                p.add_argument(flag, nargs="+", required=True)
            else:
                p.add_argument(flag, type=type(v), default=v)

    stage("download", download, index=[], out="pubmed_data", at_once=8)
    stage("to-parquet", to_parquet, input=..., out=..., rows_only=True, skip_if_exists=True)
    stage("classify", classify, input=..., out="bert_processed", model="RuleClassifier", device="auto", shard=0, num_shards=1, fail_fast=False, skip_if_exists=True)
    stage("positives", positives, processed_dir="bert_processed", out_path="pubmed_bert_positive.parquet")
    stage(
        "cross-score", cross_score, input_parquet="pubmed_bert_positive.parquet", g2p_csv=..., out_dir="crossencoded_shards", model_path="ContainmentScorer",
        device="auto", dtype="auto", order_by="pmid", g2p_columns="", chunk_size=200, g_block_size=2048, top_k=5, shard=0, num_shards=1, skip_if_exists=True, compression="zstd",
    )
    stage(
        "llm-map", llm_map, shards_dir=..., llm_model="FirstCandidate", out_dir=..., batch_size=32, temperature=0.8, top_p=0.95, max_tokens=2048, shard_index=-1, num_shards=0,
        save_files=64, fail_fast=False,
    )
    stage("final-clean", final_clean, input=[], g2p_csv=..., pubtator=..., gene_info=..., out="final_tiab_mappings.parquet", threshold=0.9)
    stage("split", split, input=..., out="splits", test_size=0.2, seed=42)
    stage(
        "mine", mine, train=..., g2p_csv=..., out="hard_negatives_dataset", model="HashEmbedder", all_labels=False, max_score=0.95, relative_margin=0.01,
        range_min=5, range_max=50, num_negatives=5,
    )
    stage("tune-classifier", tune_classifier, train=..., test="", out="classifier", epochs=5, weight_decay=0.3, val_size=0.1, seed=42)
    stage("tune-scorer", tune_scorer, train=..., test="", out="scorer", epochs=2, seed=42)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName(f"annotary {a.stage}").getOrCreate(), a)


if __name__ == "__main__":
    main()
