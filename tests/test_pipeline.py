"""The command line, stage after stage, with stand-in models."""

import functools
import gzip
import http.server
import shutil
import threading

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from annotary import cli
from annotary.sinks.files import write_parts
from annotary.sources import files
from annotary.models.scorers import HashEmbedder
from annotary.schemas import ONTOLOGY_COLUMNS
from test_sources import article


def run(spark, *argv):
    a = cli.parser().parse_args([str(x) for x in argv])
    return a.run(spark, a)


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "xml").mkdir()
    year = "<Year>2001</Year>"
    texts = [(1, "Variant of the gene ABC1 in red syndrome", "A mutation of the exon."), (2, "Gene DEF2 variant and blue syndrome", "x"), (3, "A river", "of stone")]
    with gzip.open(tmp_path / "xml" / "a.xml.gz", "wt") as f:
        f.write("<PubmedArticleSet>" + "".join(article(i, t, [b], year) for i, t, b in texts) + "</PubmedArticleSet>")
    rows = [["G2P1", "ABC1", *[""] * 3, "red syndrome", *[""] * 9], ["G2P2", "DEF2", *[""] * 3, "blue syndrome", *[""] * 9]]
    rows += [[f"G2P{i}", f"X{i}", *[""] * 3, f"other {i}", *[""] * 9] for i in range(3, 30)]
    (tmp_path / "g2p.csv").write_text("\n".join(",".join(r) for r in [["g2p id", *ONTOLOGY_COLUMNS[1:]], *rows]) + "\n")
    (tmp_path / "mentions").write_text("1\tGene\t11\tABC1\ts\n2\tGene\t99\tZ\ts\n")
    names = "#tax_id GeneID Symbol LocusTag Synonyms dbXrefs chromosome map_location description type_of_gene Symbol_from_nomenclature_authority".split()
    names += "Full_name_from_nomenclature_authority Nomenclature_status Other_designations Modification_date Feature_type".split()
    gene = lambda i, s: "\t".join(["9606", str(i), s, *["-"] * 11, "20200101", "-"])
    (tmp_path / "genes").write_text("\n".join(["\t".join(names), gene(11, "ABC1"), gene(99, "ZZZ")]) + "\n")
    return tmp_path


def test_stages(spark, inputs):
    p = inputs
    assert run(spark, "to-parquet", "--input", p / "xml", "--out", p / "art") == 3
    assert run(spark, "to-parquet", "--input", p / "xml", "--out", p / "art") is None
    assert run(spark, "classify", "--input", p / "art", "--out", p / "cls") == 3
    assert run(spark, "positives", "--processed_dir", p / "cls", "--out_path", p / "pos") == 2
    assert run(spark, "cross-score", "--input_parquet", p / "pos", "--g2p_csv", p / "g2p.csv", "--out_dir", p / "cross") == 2
    shard = p / "cross" / "pos_crossencoded_shard0-of-1"
    assert run(spark, "llm-map", "--shards_dir", shard, "--out_dir", p / "llm") == 2
    answers = {r["pmid"]: r["llm_dis_map"] for r in spark.read.parquet(str(p / "llm")).collect()}
    assert answers == {1: "G2P1", 2: "G2P2"}
    files = ("--g2p_csv", p / "g2p.csv", "--pubtator", p / "mentions", "--gene_info", p / "genes", "--threshold", 0.1)
    assert run(spark, "final-clean", "--input", p / "llm", *files, "--out", p / "final") == 1
    got = spark.read.parquet(str(p / "final")).head()
    assert got["pmid"] == 1 and got["dis_map_gene"] == ["ABC1"] and got["dis_map_name"] == ["red syndrome"]
    with pytest.raises(SystemExit):
        run(spark, "llm-map", "--shards_dir", shard, "--out_dir", shard)


def test_shards_of_a_stage(spark, inputs):
    p = inputs
    run(spark, "to-parquet", "--input", p / "xml", "--out", p / "art")
    run(spark, "classify", "--input", p / "art", "--out", p / "cls")
    run(spark, "positives", "--processed_dir", p / "cls", "--out_path", p / "pos")
    sizes = [run(spark, "cross-score", "--input_parquet", p / "pos", "--g2p_csv", p / "g2p.csv", "--out_dir", p / "c", "--shard", i, "--num_shards", 2) for i in (0, 1)]
    assert sizes == [1, 1]


def test_split_and_mine(spark, inputs):
    p = inputs
    label = lambda i: f"G2P{i} - {'ABC1' if i == 1 else 'DEF2'}"
    lines = ["tiab,g2p_lgmde,label", *[f"text {i},{label(1 + i % 2)},{i % 2}" for i in range(20)]]
    (p / "ann.csv").write_text("\n".join(lines) + "\n")
    run(spark, "split", "--input", p / "ann.csv", "--out", p / "splits")
    assert spark.read.parquet(str(p / "splits/train")).count() == 16 and spark.read.parquet(str(p / "splits/test")).count() == 4
    onto = " - ".join(["G2P1", "ABC1", "nan", "nan", "nan", "red syndrome", *["nan"] * 9])
    spark.createDataFrame([("red syndrome of ABC1", onto, 1)], "tiab string, g2p_lgmde string, label int").write.parquet(str(p / "train"))
    n = run(spark, "mine", "--train", p / "train", "--g2p_csv", p / "g2p.csv", "--out", p / "hard", "--range_min", 1, "--num_negatives", 3)
    got = spark.read.parquet(str(p / "hard"))
    assert n == got.count() and got.where("label = 1").count() == 1 and 1 <= got.where("label = 0").count() <= 3


def test_mine_with_shared_and_several_labels(spark, inputs):
    """One label of three texts, one text of two labels, one label that the ontology lacks, against brute force over labels."""
    p = inputs
    label = lambda i, gene, name: " - ".join([f"G2P{i}", gene, "nan", "nan", "nan", name, *["nan"] * 9])
    red, blue, other = label(1, "ABC1", "red syndrome"), label(2, "DEF2", "blue syndrome"), label(99, "LOST", "grey syndrome")
    pairs = [("red syndrome of ABC1", red), ("ABC1 and the red syndrome", red), ("red and blue syndrome in ABC1 or DEF2", red), ("red and blue syndrome in ABC1 or DEF2", blue), ("LOST grey syndrome", other)]
    spark.createDataFrame([(*x, 1) for x in pairs] + [("red syndrome of ABC1", blue, 0), (None, red, 1)], "tiab string, g2p_lgmde string, label int").write.parquet(str(p / "train"))
    run(spark, "mine", "--train", p / "train", "--g2p_csv", p / "g2p.csv", "--out", p / "hard", "--range_min", 1, "--num_negatives", 3)
    got = sorted((r["tiab"], r["g2p_lgmde"], r["label"]) for r in spark.read.parquet(str(p / "hard")).collect())
    every = sorted({red, blue, other, *(label(i, f"X{i}", f"other {i}") for i in range(3, 30))})
    unit = lambda t: (lambda v: v / np.linalg.norm(v))(HashEmbedder().embed([t])[0])
    want = [(*x, 1) for x in pairs]
    for text in {t for t, _ in pairs}:
        sims = {x: float(unit(text) @ unit(x)) for x in every}
        own = {x for t, x in pairs if t == text}
        limit = min(0.95, max(sims[x] for x in own) * 0.99)
        ranked = sorted((-s, x) for x, s in sims.items() if x not in own and s <= limit)
        want += [(text, x, 0) for _, x in ranked[1:4]]
    assert got == sorted(want) and len(want) == len(pairs) + 4 * 3


def test_bad_rows_leave_the_rest_of_a_file(spark, inputs):
    p = inputs
    with gzip.open(p / "xml" / "b.xml.gz", "wt") as f:
        f.write("<PubmedArticleSet>" + article(4, "T", ["A"], "<Year>2001</Year>") + article(5, "T", ["A"], "<Season>Spring</Season>") + "</PubmedArticleSet>")
    (p / "xml" / "c.xml.gz").write_bytes((p / "xml" / "b.xml.gz").read_bytes()[:-30])
    assert run(spark, "to-parquet", "--input", p / "xml", "--out", p / "art") == 4
    assert sorted((r["source_file"], r["pmid"]) for r in spark.read.parquet(str(p / "art_quarantine")).collect()) == [("b.xml.gz", 5), ("c.xml.gz", None)]
    assert run(spark, "to-parquet", "--input", p / "xml", "--out", p / "strict", "--no-rows_only") == 3


def test_second_run_takes_new_files(spark, inputs):
    """Files that were taken are not taken again, new ones are, and the first outputs stay."""
    p = inputs
    read = lambda name: spark.read.parquet(str(p / name))
    to, to_class = ("to-parquet", "--input", p / "xml", "--out", p / "art"), ("classify", "--input", p / "art", "--out", p / "cls")
    assert run(spark, *to) == 3 and run(spark, *to_class) == 3
    with gzip.open(p / "xml" / "b [2].xml.gz", "wt") as f:
        f.write("<PubmedArticleSet>" + article(4, "Gene", ["A"], "<Year>2001</Year>") + article(5, "T", ["A"], "<Season>Spring</Season>") + "</PubmedArticleSet>")
    (p / "xml" / "c.xml.gz").write_bytes(b"broken")
    assert run(spark, *to) == 1 and run(spark, *to_class) == 1
    assert run(spark, *to) == 0 and run(spark, *to_class) is None  # the broken file is tried again
    for name in ("art", "cls"):
        assert sorted((r["pmid"], r["source_stem"]) for r in read(name).collect()) == [(1, "a"), (2, "a"), (3, "a"), (4, "b [2]")]
    assert sorted((r["source_file"], r["pmid"]) for r in read("art_quarantine").collect()) == [("b [2].xml.gz", 5), ("c.xml.gz", None)]
    (p / "xml" / "c.xml.gz").write_bytes(gzip.compress(b"<PubmedArticleSet></PubmedArticleSet>"))
    assert [run(spark, *to) for _ in (0, 1)] == [0, None] and read("art_quarantine").count() == 1
    (p / "xml" / "c.xml.gz").write_bytes(b"broken")
    # all again: the same rows, once
    assert run(spark, *to, "--no-skip_if_exists") == 4 and read("art").count() == 4 and read("art_quarantine").count() == 2
    # a file that shares a stem with one that was taken
    (p / "xml" / "a.xml").write_text("<PubmedArticleSet>" + article(6, "T", ["A"], "<Year>2001</Year>") + "</PubmedArticleSet>")
    assert run(spark, *to) == 4 and read("art").count() == 5
    # a run that ended between its table and its note is repeated without doubling
    shutil.rmtree(p / "cls_done")
    assert run(spark, *to_class) == 5 and sorted(r["pmid"] for r in read("cls").collect()) == [1, 2, 3, 4, 6]


def test_unfinished_run_and_shards_into_one_output(spark, inputs):
    p = inputs
    for i in range(5):
        spark.createDataFrame([(i, "Gene", "A", "eng", 2001)], "pmid long, title string, abstract string, languages string, pubdate int").coalesce(1).write.parquet(str(p / "in" / f"source_stem=00{i}"))
    to = ("classify", "--input", p / "in", "--out", p / "cls", "--num_shards", 2)
    assert [run(spark, *to, "--shard", i) for i in (0, 1, 0, 1)] == [3, 2, None, None]
    shutil.rmtree(p / "cls_done")
    assert run(spark, "classify", "--input", p / "in", "--out", p / "cls") == 5
    assert sorted(r["pmid"] for r in spark.read.parquet(str(p / "cls")).collect()) == list(range(5))
    assert run(spark, "positives", "--processed_dir", p / "cls", "--out_path", p / "pos") == 0
    assert "input_part" not in spark.read.parquet(str(p / "pos")).columns


def test_shards_number_ties_alike(spark, inputs):
    """Rows of one pmid, and of one pmid and text, are each in one shard, though they are read in another order by each run."""
    p = inputs
    rows = [(1, f"red syndrome {i // 2}", i) for i in range(40)]
    for i, part in enumerate((rows, rows[::-1])):
        spark.createDataFrame(part, "pmid long, tiab string, x int").coalesce(1).write.parquet(str(p / f"in{i}" / "pos"))
        run(spark, "cross-score", "--input_parquet", p / f"in{i}" / "pos", "--g2p_csv", p / "g2p.csv", "--out_dir", p / "c", "--shard", i, "--num_shards", 2)
    got = [r for i in (0, 1) for r in spark.read.parquet(str(p / "c" / f"pos_crossencoded_shard{i}-of-2")).collect()]
    assert sorted(r["x"] for r in got) == list(range(40)) and sorted(r["row_nr"] for r in got) == list(range(40))


@pytest.fixture
def site(tmp_path):
    """A folder served over HTTP."""
    folder = tmp_path / "site"
    (folder / "base").mkdir(parents=True)
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(folder))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield folder, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_download(spark, tmp_path, site):
    folder, url = site
    (folder / "base" / "index.html").write_text("<a href=a.xml.gz>a</a><a href='b.xml.gz'>b</a><a href=\"c.xml.gz.md5\">m</a><a class=x href=gone.xml.gz>g</a>")
    for n in "ab":
        (folder / "base" / f"{n}.xml.gz").write_bytes(n.encode() * 3_000_000)
    to = ("download", "--index", f"{url}/base/", f"{url}/base/", f"{url}/none/", "--out", tmp_path / "got")
    assert run(spark, *to) == 2
    assert sorted(p.name for p in (tmp_path / "got").iterdir()) == ["a.xml.gz", "b.xml.gz"] and (tmp_path / "got" / "b.xml.gz").stat().st_size == 3_000_000
    log = {r["url"].rsplit("/", 2)[-1] or r["url"].rsplit("/", 2)[-2]: r["error"] for r in spark.read.parquet(str(tmp_path / "got_log")).collect()}
    assert log["a.xml.gz"] is None and "404" in log["gone.xml.gz"] and "404" in log["none"]
    (tmp_path / "got" / "a.xml.gz").unlink()
    assert run(spark, *to) == 1


def test_llm_stage_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(i, f"text {i}", [(f"G2P{i} - x", 0.9)]) for i in range(6)]
    src = str(tmp_path / "in")
    put = lambda some: spark.createDataFrame(some, "row_nr long, tiab string, top5_cross array<struct<label:string,score:double>>").coalesce(1).write.mode("append").parquet(src)
    put(rows[:2])
    put(rows[2:3])
    to = ("llm-map", "--shards_dir", src, "--out_dir", tmp_path / "out", "--save_files", 1)
    assert run(spark, *to) == 3 and run(spark, *to) is None
    put(rows[3:])
    assert run(spark, *to) == 3
    got = {r["row_nr"]: r["llm_dis_map"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: f"G2P{i}" for i in range(6)}
    short = tmp_path / "short"
    assert run(spark, "llm-map", "--shards_dir", src, "--out_dir", short, "--max_tokens", 2) == 6
    assert {r["generated_text"] for r in spark.read.parquet(str(short)).collect()} == {"Looked at"}
    parts = [run(spark, "llm-map", "--shards_dir", src, "--out_dir", tmp_path / f"s{i}", "--shard_index", i, "--num_shards", 2) or 0 for i in range(2)]
    assert sum(parts) == 6 and all(parts)


def test_training_stages(spark, tmp_path):
    rows = [(f"gene variant {i} red", "red label", 1) for i in range(40)] + [(f"river stone {i}", "red label", 0) for i in range(40)] + [(None, "x", 0), ("y", None, None)]
    df = spark.createDataFrame(rows, "tiab string, g2p_lgmde string, label int")
    df.write.parquet(str(tmp_path / "train"))
    df.where("label is not null").write.parquet(str(tmp_path / "test"))
    for stage in ("tune-classifier", "tune-scorer"):
        run(spark, stage, "--train", tmp_path / "train", "--test", tmp_path / "test", "--out", tmp_path / stage, "--epochs", 2)
        model = PipelineModel.load(str(tmp_path / stage / "model"))
        table = {r["split"]: r.asDict() for r in spark.read.parquet(str(tmp_path / stage / "metrics")).collect()}
        assert table["test"].get("f1", table["test"].get("best_f1")) > 0.9 and 1 <= table["test"]["epoch"] <= 2
        assert model.transform(spark.createDataFrame([("gene variant", 1.0)], "text string, label double")).count() == 1


def test_classify_by_a_trained_model(spark, inputs):
    p = inputs
    run(spark, "to-parquet", "--input", p / "xml", "--out", p / "art")
    rows = [(f"gene variant {i}", "x", 1) for i in range(40)] + [(f"river stone {i}", "x", 0) for i in range(40)]
    spark.createDataFrame(rows, "tiab string, g2p_lgmde string, label int").write.parquet(str(p / "train"))
    run(spark, "tune-classifier", "--train", p / "train", "--out", p / "clf", "--epochs", 1)
    assert run(spark, "classify", "--input", p / "art", "--out", p / "cls", "--model", f"{p}/clf/model") == 3
    got = {r["pmid"]: r["bert_predict"] for r in spark.read.parquet(str(p / "cls")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_devices():
    from annotary.models.devices import configured, device_of, dtype_of
    from annotary.models.scorers import ContainmentScorer, FirstCandidate

    assert device_of() == "cpu" and device_of("cuda:1") == "cuda:1" and dtype_of("auto", "cuda:0") == "bfloat16" and dtype_of("fp16") == "float16" and dtype_of() == "float32"
    with pytest.raises(ValueError):
        dtype_of("int3")
    seen = configured(lambda **kw: kw, device="auto", dtype="bf16", temperature=0.5)()
    assert seen == {"temperature": 0.5, "device": "cpu", "dtype": "bfloat16"}
    assert configured(FirstCandidate, temperature=0.5, other=1)().temperature == 0.5 and isinstance(configured(ContainmentScorer, "cpu", "fp32")(), ContainmentScorer)


def test_one_input_that_fails(spark, tmp_path):
    """The other inputs are taken; the failed one is listed with its error and tried again by the next run."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a in (0, 10, 20):
        spark.range(a, a + 3).coalesce(1).write.mode("append").parquet(src)
    base, names = files.parquet_files(spark, src)
    rows = lambda keys: files.some_parquet(spark, base, [n for n in names if n in keys], "part").withColumn("x", F.when(F.col("id") == 11, F.raise_error(F.lit("no"))).otherwise(1))
    n, taken = write_parts(rows, out, "part", set(names), spark)
    assert n == 6 and len(taken) == 2 and sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 20, 21, 22]
    lost = spark.read.parquet(f"{out}_errors").collect()
    assert len(lost) == 1 and {lost[0]["key"]} == set(names) - taken and "no" in lost[0]["error"]
    with pytest.raises(Exception, match="no"):
        write_parts(rows, out, "part", set(names), spark, fail_fast=True)
