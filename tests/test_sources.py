"""Sources, sinks and the incremental stage, on files written here."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.sinks.files import write
from annotary.sources import files, links
from annotary.sources.xml import check_files, quarantine, read_articles, xml_files
from annotary.streaming.ingest import run_new


def article(pmid, title, abstract, date, langs=("eng",)):
    parts = "".join(f"<AbstractText>{a}</AbstractText>" for a in abstract)
    lang = "".join(f"<Language>{x}</Language>" for x in langs)
    body = f"<Abstract>{parts}</Abstract>" if abstract else ""
    return f"""<PubmedArticle><MedlineCitation><PMID Version="1">{pmid}</PMID><Article><Journal><JournalIssue><PubDate>{date}</PubDate></JournalIssue>
    <Title>J</Title></Journal><ArticleTitle>{title}</ArticleTitle>{body}{lang}</Article></MedlineCitation></PubmedArticle>"""


@pytest.fixture
def xml_dir(tmp_path):
    year = "<Year>2001</Year>"
    good = [article(1, "Ab <i>it</i> x", ["one", "two &amp; <sub>3</sub>"], year), article(2, "T", [], "<MedlineDate>1999-2000</MedlineDate>", ("eng", "fre"))]
    bad = [article(3, "T", ["A"], year), article(4, "T", ["A"], "<Season>Spring</Season>")]
    for name, parts in (("a", good), ("b", bad), ("c", [])):
        with gzip.open(tmp_path / f"{name}.xml.gz", "wt") as f:
            f.write('<?xml version="1.0"?><PubmedArticleSet>' + "".join(parts) + "</PubmedArticleSet>")
    return str(tmp_path)


def test_xml(spark, xml_dir):
    got = {r["pmid"]: r for r in read_articles(spark, xml_dir).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["title"] == "Ab it x" and got[1]["abstract"] == "one\ntwo & 3" and got[1]["pubdate"] == 2001 and got[1]["source_stem"] == "a"
    assert got[2]["languages"] == "eng; fre" and got[2]["pubdate"] == 1999 and not got[2]["abstract"]
    assert got[4]["bad_row"] and not got[3]["bad_row"]
    good, bad = quarantine(read_articles(spark, xml_dir))
    assert {r["pmid"] for r in good.collect()} == {1, 2} and {r["pmid"] for r in bad.collect()} == {3, 4}
    good, bad = quarantine(read_articles(spark, xml_dir), whole_files=False)
    assert {r["pmid"] for r in good.collect()} == {1, 2, 3} and {r["pmid"] for r in bad.collect()} == {4}


def test_unreadable_files(spark, tmp_path):
    """Files cut short, damaged or not well-formed give no row but an entry; whole ones next to them keep all of theirs."""
    year = "<Year>2001</Year>"
    parts = [article(i, f"T{i * 7919 % 10007}", [str(i * i)], year) for i in range(3000)]
    packed = lambda x: gzip.compress(("<PubmedArticleSet>" + "".join(x) + "</PubmedArticleSet>").encode())
    whole = packed(parts)
    damaged = bytearray(packed(parts[:50]))
    damaged[-6] ^= 0xFF  # checksum
    files = {
        "cut": whole[: len(whole) * 6 // 10], "sum": bytes(damaged), "none": b"", "text": b"no gzip at all", "tag": packed(["".join(parts[:9]), "<PubmedArticle><MedlineCitation>"]),
        "two": gzip.compress(b"<PubmedArticleSet>") + gzip.compress((parts[1] + "</PubmedArticleSet>").encode()), "odd [1] {x}": packed(parts[2:4]),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.xml.gz").write_bytes(data)
    (tmp_path / "cut.xml.gz.md5").write_text("x")
    for whole_files in (True, False):
        good, bad = quarantine(read_articles(spark, str(tmp_path)), whole_files)
        assert sorted((r["source_stem"], r["pmid"]) for r in good.collect()) == [("odd [1] {x}", 2), ("odd [1] {x}", 3), ("two", 1)]
        assert sorted((r["source_file"], r["pmid"]) for r in bad.collect()) == [(f"{x}.xml.gz", None) for x in ("cut", "none", "sum", "tag", "text")]
    only = tmp_path / "only"
    only.mkdir()
    (only / "cut.xml.gz").write_bytes(files["cut"])
    good, bad = quarantine(read_articles(spark, str(only)), False)
    assert good.count() == 0 and bad.count() == 1


def test_dates_in_words(spark, tmp_path):
    dates = ["1998 Dec-1999 Jan", "2000 Spring", "Spring 2000", "1999-2000", "no year"]
    with gzip.open(tmp_path / "d.xml.gz", "wt") as f:
        f.write("<PubmedArticleSet>" + "".join(article(i, "T", ["A"], f"<MedlineDate>{d}</MedlineDate>") for i, d in enumerate(dates)) + "</PubmedArticleSet>")
    got = {r["pmid"]: (r["pubdate"], r["bad_row"]) for r in read_articles(spark, str(tmp_path)).collect()}
    assert got == {0: (1998, False), 1: (2000, False), 2: (2000, False), 3: (1999, False), 4: (None, True)}


def test_csv(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text('a,b\n"x, ""y""",\nNA,nan\n')
    assert sorted(map(tuple, files.csv_texts(spark, str(path), ["a", "b"]).collect())) == [("NA", "nan"), ('x, "y"', "")]
    assert {tuple(r) for r in files.csv_with_missing(spark, str(path), ["a", "b"]).collect()} == {(None, None), ('x, "y"', None)}


def test_tsv(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("1\tGene\t7;8\tx\ts\n2\tGene\t\ty\ts\n")
    got = {r["pmid"]: r["entity_id"] for r in files.gene_mentions(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {1: "7;8", 2: None}
    names = "#tax_id GeneID Symbol LocusTag Synonyms dbXrefs chromosome map_location description type_of_gene Symbol_from_nomenclature_authority".split()
    names += "Full_name_from_nomenclature_authority Nomenclature_status Other_designations Modification_date Feature_type".split()
    lines = ["\t".join(names), "\t".join(["9606", "1", "NA", *["-"] * 11, "20200101", "-"]), "\t".join(["10090", "2", "-", *["x"] * 11, "20200101", "-"])]
    (tmp_path / "g.tsv").write_text("\n".join(lines) + "\n")
    got = {tuple(r) for r in files.gene_info(spark, str(tmp_path / "g.tsv"), ["tax_id", "GeneID", "Symbol", "Synonyms"]).collect()}
    assert got == {(9606, 1, "NA", None), (10090, 2, None, "x")}


def test_parquet_dir(spark, tmp_path):
    schema = T.StructType([T.StructField("x", T.LongType())])
    spark.range(3).select(F.col("id").alias("x")).coalesce(1).write.parquet(str(tmp_path / "d"))
    got = files.parquet_dir(spark, str(tmp_path / "d"), schema)
    assert got.count() == 3 and got.where("source_file like '%.parquet'").count() == 3
    assert files.parquet_dir(spark, str(tmp_path / "d"), schema, "none*").count() == 0


def test_union_and_schema(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2.0,)], "a double")
    assert {tuple(r) for r in files.union_by_name(a, b).collect()} == {(1.0, "x"), (2.0, None)}
    want = T.StructType([T.StructField("b", T.StringType()), T.StructField("c", T.LongType())])
    assert tuple(files.with_columns_of(a, want).head()) == ("x", None)


def test_links(spark):
    html = """<a class="x" href="a.xml.gz">1</a><a href='b.xml.gz'>2</a><a href="a.xml.gz.md5">3</a><a href="c.txt">4</a>"""
    pages = spark.createDataFrame([("u/", 200, html), ("v/", 404, html), ("w/", 200, "none"), ("y/", 200, None)], "base_url string, status int, html string")
    got = links.file_links(pages)
    assert [r["url"] for r in got.sort("pos").collect()] == ["u/a.xml.gz", "u/b.xml.gz"]
    assert links.all_links(got, got).count() == 4
    have = spark.createDataFrame([("a.xml.gz",)], "name string")
    assert [r["url"] for r in links.missing_files(got, have).collect()] == ["u/b.xml.gz"]


def test_existing_files(spark, tmp_path):
    (tmp_path / "z.xml.gz").write_bytes(b"x")
    assert [r["name"] for r in links.existing_files(spark, str(tmp_path)).collect()] == ["z.xml.gz"]


def test_write_counts_and_skips(spark, tmp_path):
    df = spark.range(7).withColumn("__index_level_0__", F.lit(0)).withColumn("p", F.col("id") % 2)
    to = str(tmp_path / "out")
    assert write(df, to, by=["p"]) == 7
    assert write(df, to, skip_if_exists=True) is None
    assert spark.read.parquet(to).columns == ["id", "p"]


def test_incremental_runs(spark, tmp_path):
    schema = T.StructType([T.StructField("x", T.LongType())])
    src, out, mark = (str(tmp_path / p) for p in ("src", "out", "mark"))
    put = lambda a, b: spark.range(a, b).select(F.col("id").alias("x")).coalesce(1).write.mode("append").parquet(src)
    step = lambda df: df.withColumn("y", F.col("x") * 2)
    put(0, 3)
    assert run_new(spark, src, schema, out, mark, step) == 1
    assert run_new(spark, src, schema, out, mark, step) == 0
    put(3, 5)
    assert run_new(spark, src, schema, out, mark, step) == 1
    assert sorted(r["x"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_incremental_quarantine(spark, tmp_path):
    """Only the file that fails is set apart, with its error; the others of its batch are there."""
    schema = T.StructType([T.StructField("x", T.LongType())])
    src = str(tmp_path / "src")
    for a in (0, 10, 20):
        spark.range(a, a + 3).select(F.col("id").alias("x")).coalesce(1).write.mode("append").parquet(src)
    fail = lambda df: df.withColumn("y", F.when(F.col("x") == 11, F.raise_error(F.lit("no"))).otherwise(F.col("x")))
    assert run_new(spark, src, schema, str(tmp_path / "o"), str(tmp_path / "m"), fail, quarantine=str(tmp_path / "q")) == 1
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [0, 1, 2, 20, 21, 22]
    apart = spark.read.parquet(str(tmp_path / "q")).collect()
    assert len(apart) == 1 and apart[0]["source_file"].endswith(".parquet") and "no" in apart[0]["error"]
    with pytest.raises(Exception, match="no"):
        run_new(spark, src, schema, str(tmp_path / "o"), str(tmp_path / "m2"), fail, fail_fast=True)


def test_errors_of_files(spark, tmp_path):
    whole = b"<PubmedArticleSet></PubmedArticleSet>"
    for name, content in {"a.xml": whole, "b.xml": whole[:-5], "c.xml.gz": gzip.compress(whole), "d.xml.gz": gzip.compress(whole * 1)[:-9], "e.xml.gz": b"plain", "f.xml": b""}.items():
        (tmp_path / name).write_bytes(content)
    found = {p.rsplit("/", 1)[-1]: error for p, error in check_files(spark, xml_files(spark, str(tmp_path)))}
    assert found["a.xml"] == found["c.xml.gz"] == "" and all(found[n] for n in ("b.xml", "d.xml.gz", "e.xml.gz", "f.xml"))
    got = {r["source_file"]: r["error"] for r in quarantine(read_articles(spark, str(tmp_path)))[1].collect()}
    assert got == {n: e for n, e in found.items() if e}
