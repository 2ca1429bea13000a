"""Links of an HTML index, what of them is still to be fetched, and fetching."""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary.functions.text import basename

_HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def hrefs(html: Column) -> Column:
    """The ``href`` of every anchor in order, in single, double or no quotes."""
    found = lambda i: F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_HREF), F.lit(i))
    return F.transform(F.arrays_zip(found(1).alias("a"), found(2).alias("b"), found(3).alias("c")), lambda x: F.concat(x["a"], x["b"], x["c"]))


def file_links(pages: DataFrame, wanted: str = ".xml.gz", unwanted: str = ".md5") -> DataFrame:
    """``(base_url, pos, url)`` of ``pages(base_url, status, html)``; a page that was not read (status not 200) gives none."""
    rows = pages.where("status = 200").select("base_url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    kept = rows.where(F.col("href").contains(wanted) & ~F.col("href").contains(unwanted))
    return kept.select("base_url", "pos", F.concat("base_url", "href").alias("url"))


def all_links(*lists: DataFrame) -> DataFrame:
    """Links of several listings with the listing's number, repeats kept."""
    out = None
    for i, part in enumerate(lists):
        part = part.withColumn("listing", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def existing_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(name)`` of a folder's files; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(basename(F.col("path")).alias("name"))


def missing_files(links: DataFrame, existing: DataFrame) -> DataFrame:
    """Links whose last part names no existing file."""
    return links.withColumn("name", F.element_at(F.split("url", "/"), -1)).join(existing.select("name").distinct(), "name", "left_anti")


def _pages(timeout: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url in pdf["base_url"]:
                try:
                    with urllib.request.urlopen(url, timeout=timeout) as r:
                        rows.append((url, r.status or 200, r.read().decode("utf-8", "replace"), None))
                except (OSError, ValueError) as e:  # an HTTP error is one of the former and has a status
                    rows.append((url, getattr(e, "code", 0), None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["base_url", "status", "html", "error"])

    return run


def fetch_pages(spark: SparkSession, urls: list[str], timeout: float = 60.0) -> DataFrame:
    """``(base_url, status, html, error)`` of index pages, each in the place where it is listed; status 0 where there was no answer."""
    return spark.createDataFrame([(u,) for u in urls], "base_url string").coalesce(1).mapInPandas(_pages(timeout), "base_url string, status int, html string, error string")


def _files(folder: str, timeout: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            rows = []
            for url, name in zip(pdf["url"], pdf["name"]):
                part, size = os.path.join(folder, f".{name}.{os.getpid()}"), 0
                try:
                    with urllib.request.urlopen(url, timeout=timeout) as r, open(part, "wb") as f:
                        while block := r.read(1 << 20):
                            size += f.write(block)
                    os.replace(part, os.path.join(folder, name))  # a file is there whole or not at all
                    rows.append((name, url, size, None))
                except (OSError, ValueError) as e:
                    if os.path.exists(part):
                        os.remove(part)
                    rows.append((name, url, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["name", "url", "bytes", "error"])

    return run


def fetch_files(links: DataFrame, folder: str, at_once: int = 8, timeout: float = 600.0) -> DataFrame:
    """``(name, url, bytes, error)`` of files of ``links(url, name)`` fetched to a folder that all executors share.

    A name that several listings have is fetched once. ``at_once`` tasks fetch; write the result to run them."""
    once = links.dropDuplicates(["name"]).select("url", "name")
    return once.repartition(at_once).mapInPandas(_files(folder, timeout), "name string, url string, bytes long, error string")
