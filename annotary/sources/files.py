"""Reading files with declared schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.functions.text import basename
from annotary.schemas import GENE_INFO, GENE_MENTION

#: Texts that the original's CSV reader takes for a missing value (fixed values).
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def escaped(path: str) -> str:
    """A path that is no pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def parquet_dir(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """All files of a folder that match, with their name in ``source_file``; an empty table where none does."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(files)
    named = T.StructType([*schema.fields, T.StructField("source_file", T.StringType())])
    if not found:
        return spark.createDataFrame([], named)
    rows = spark.read.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    return rows.withColumn("source_file", basename(rows.metadataColumn("_metadata")["file_path"]))


def parquet_files(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """A base folder and, as paths within it, all Parquet files of a folder and its partitions, of a pattern, or the one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    left = list(fs.globStatus(at) or [])
    if not left:
        raise FileNotFoundError(path)
    base = fs.makeQualified(at)
    if left[0].getPath() != base or left[0].isFile():  # a pattern or a file
        base = base.getParent()
        while re.search(r"[\[{*?]", base.toString()):
            base = base.getParent()
    found = []
    while left:
        x = left.pop()
        name = x.getPath().getName()
        if x.isDirectory():
            inner = fs.listStatus(x.getPath())
            left += [y for y in inner if y.getPath().getName()[0] not in "._" and (y.isDirectory() or y.getPath().getName().endswith(".parquet"))]
        elif x.getLen():
            found.append(x.getPath().toString()[len(base.toString().rstrip("/")) + 1 :])
    return base.toString(), sorted(found)


_PART_OF = r"((?:^|/)source_stem=[^/]*)/[^/]*$"


def input_part(name: str) -> str:
    """What is taken at once: all files of one source where they are partitioned by it (written anew, they get other names), else the file."""
    return re.sub(_PART_OF, r"\1", name)


def some_parquet(spark: SparkSession, base: str, names: list[str], column: str) -> DataFrame:
    """The rows of some files of a Parquet folder, with their ``input_part`` in ``column``."""
    paths = [escaped(f"{base}/{n}") for n in names]
    reader = spark.read.option("basePath", base)
    # a stem of digits stays a text
    schema = [T.StructField(f.name, T.StringType()) if f.name == "source_stem" else f for f in reader.parquet(*paths).schema]
    rows = reader.schema(T.StructType(schema)).parquet(*paths)
    # the metadata's path is a URI
    plain = F.url_decode(F.replace(rows.metadataColumn("_metadata")["file_path"], F.lit("+"), F.lit("%2B")))
    start = len(re.sub(r"^[A-Za-z][\w+.-]*:/*", "", base).rstrip("/"))
    name = F.regexp_replace(plain, r"^[A-Za-z][\w+.-]*:/*", "").substr(F.lit(start + 2), F.length(plain))
    return rows.withColumn(column, F.regexp_replace(name, _PART_OF, "$1"))


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True, enforceSchema=False).csv(path)


def csv_texts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header, all texts, nothing taken for missing: an empty cell is ``''``."""
    rows = _csv(spark, path, columns)
    return rows.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c) for c in columns])


def csv_with_missing(spark: SparkSession, path: str, columns: list[str], missing: list[str] = MISSING) -> DataFrame:
    """A CSV with header, all texts, the usual marks of a missing value as null."""
    rows = _csv(spark, path, columns)
    return rows.select(*[F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`")).alias(c) for c in columns])


def gene_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated gene mentions."""
    return spark.read.schema(GENE_MENTION).options(sep="\t", header=False, quote="").csv(path)


def gene_info(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated gene table; ``-`` is null, ``NA`` is text, ``#`` goes from the header."""
    rows = spark.read.schema(GENE_INFO).options(sep="\t", header=True, nullValue="-", quote="").csv(path)
    rows = strip_header(rows)
    return rows.select(*columns) if columns else rows


def strip_header(df: DataFrame) -> DataFrame:
    """Column names without leading ``#``."""
    return df.toDF(*[c.lstrip("#") for c in df.columns])


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: cast where there, null where absent."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def union_by_name(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
