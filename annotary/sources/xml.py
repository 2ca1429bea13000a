"""Bibliographic XML, one row for each article.

The schema is declared: inference would turn a title with inline markup into a struct and
lose the order of its parts. Declared as text, inner markup stays and is removed here.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.functions.text import basename, stem, strip, year_of
from annotary.sources.files import escaped

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_DATE = _struct(Year=_S, Month=_S, Day=_S, MedlineDate=_S)
_SCHEMA = _struct(
    MedlineCitation=_struct(
        PMID=_S,
        Article=_struct(
            ArticleTitle=_S,
            Abstract=_struct(AbstractText=T.ArrayType(_S)),
            Language=T.ArrayType(_S),
            Journal=_struct(Title=_S, JournalIssue=_struct(PubDate=_DATE)),
        ),
    ),
    _corrupt=_S,
)
#: Bytes unpacked at a time.
_STEP = 1 << 20
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def _plain(c: Column) -> Column:
    """Text without tags, predefined entities resolved."""
    c = F.regexp_replace(c, r"</?[A-Za-z][^<>]*>", "")
    for a, b in _ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return strip(c)


def _error(name: str, content: bytes) -> str:
    """Why a file cannot be unpacked, checksums included, and parsed to its end; empty if it can."""
    parser = expat.ParserCreate()
    try:
        if not name.endswith(".gz"):
            parser.Parse(content, True)
            return ""
        rest = memoryview(content)
        while len(rest):  # a gzip file may have several members
            member = zlib.decompressobj(wbits=31)
            chunk = rest
            while not member.eof:
                part = member.decompress(chunk, _STEP)
                parser.Parse(part, False)
                chunk = member.unconsumed_tail
                if not part and not chunk and not member.eof:
                    return "truncated: the packed data ends early"
            rest = rest[len(rest) - len(member.unused_data) :]
        parser.Parse(b"", True)
        return ""
    except (zlib.error, expat.ExpatError, ValueError) as e:
        return f"{type(e).__name__}: {e}"


def _read_through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        errors = [_error(p, c) for p, c in zip(pdf["path"], pdf["content"])]
        yield pd.DataFrame({"path": pdf["path"], "error": pd.Series(errors, dtype=str)})


def check_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """Each file's path and why it cannot be read to its end, empty if it can."""
    if not paths:
        return []
    found = spark.read.format("binaryFile").load([escaped(p) for p in paths]).select("path", "content")
    errors = {r["path"]: r["error"] for r in found.mapInPandas(_read_through, "path string, error string").collect()}
    return [(p, errors.get(p, "empty file")) for p in paths]  # a scan leaves empty files out


def xml_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the XML files, packed or not, of a folder or pattern."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.globStatus(at) or [])
    if not found:
        raise FileNotFoundError(path)
    listed = [x for f in found for x in (fs.listStatus(f.getPath()) if f.isDirectory() else [f])]
    return sorted(x.getPath().toString() for x in listed if x.isFile() and re.search(r"^[^._].*\.xml(\.gz)?$", x.getPath().getName()))


def file_stem(name: str) -> str:
    """A file name without its last two extensions, as in ``source_stem``."""
    return re.sub(r"(?s)(?<=.)\.[^.]*$", "", re.sub(r"(?s)(?<=.)\.[^.]*$", "", name))


def read_articles(spark: SparkSession, path: str, checked: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(pmid, title, abstract, languages, pubdate, journal, source_file, source_stem, error, bad_row)`` of ``*.xml.gz`` files.

    ``bad_row`` is set where the record is broken or its year cannot be read. A file that cannot be read to its end
    gives no record, only one bad row with its name. Files are read through once before, in tasks of their own, so that
    an error while records are read is an error of the run and never a shorter table. ``checked`` gives the files where
    that is done and not all of ``path`` are wanted."""
    if checked is None:
        checked = check_files(spark, xml_files(spark, path))
    rows = _records(spark, [p for p, error in checked if not error])
    lost = [x for x in checked if x[1]]
    if not lost:
        return rows
    broken = spark.createDataFrame(lost, "path string, error string").select(
        basename(F.col("path")).alias("source_file"), stem(F.col("path")).alias("source_stem"), "error", F.lit(True).alias("bad_row")
    )
    return rows.unionByName(broken, allowMissingColumns=True)


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], "pmid long, title string, abstract string, languages string, pubdate int, journal string, source_file string, source_stem string, error string, bad_row boolean")
    options = {"rowTag": "PubmedArticle", "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE", "ignoreCorruptFiles": False, "ignoreMissingFiles": False}
    raw = spark.read.format("xml").schema(_SCHEMA).options(**options).load([escaped(p) for p in paths])
    # the metadata's path is a URI; the file's own name counts
    meta = F.url_decode(F.replace(raw.metadataColumn("_metadata")["file_path"], F.lit("+"), F.lit("%2B")))
    a = "MedlineCitation.Article"
    # a date in words ('1998 Dec-1999 Jan', 'Spring 2000') has its year in its first four digits
    date = F.coalesce(F.col(f"{a}.Journal.JournalIssue.PubDate.Year"), F.regexp_extract(f"{a}.Journal.JournalIssue.PubDate.MedlineDate", r"\d{4}", 0))
    rows = raw.select(
        F.regexp_extract("MedlineCitation.PMID", r"(\d+)\s*(?:</|$)", 1).try_cast("bigint").alias("pmid"),
        _plain(F.col(f"{a}.ArticleTitle")).alias("title"),
        F.array_join(F.transform(f"{a}.Abstract.AbstractText", _plain), "\n").alias("abstract"),
        F.array_join(f"{a}.Language", "; ").alias("languages"),
        year_of(date).alias("pubdate"),
        F.col(f"{a}.Journal.Title").alias("journal"),
        basename(meta).alias("source_file"),
        stem(meta).alias("source_stem"),
        F.col("_corrupt").isNotNull().alias("broken"),
    )
    error = F.when(F.col("broken"), "the record is broken").when(F.col("pubdate").isNull(), "no year in the date")
    return rows.withColumn("error", error).withColumn("bad_row", error.isNotNull()).drop("broken")


def quarantine(rows: DataFrame, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows, and what is set apart: all rows of a file with a bad one, or with ``whole_files=False`` the bad rows only."""
    if not whole_files:
        return rows.where("not bad_row").drop("bad_row", "error"), rows.where("bad_row")
    bad = rows.groupBy("source_file").agg(F.max("bad_row").alias("bad")).where("bad").select("source_file")
    return rows.join(bad, "source_file", "left_anti").drop("bad_row", "error"), rows.join(bad, "source_file", "left_semi")
