"""Messages delivered more than once: keep one row per identifier.

The narrow pass shuffles identifier, delivery order and the row's place
(file hash, row index) only. The winners are turned into deletion vectors,
one 64-bit word for 64 rows of a file, and the wide columns are read once more
with the vectors applied during the scan; they are never shuffled.

Defined cases: a null identifier is no identifier, such rows all stay. A null in
an order column counts as latest. Rows equal in every order column are told
apart by their place in the files, so exactly one stays. An empty table gives an
empty table. Extra columns pass through untouched; only the four names that begin
with ``__place_`` are taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary.runtime import cut, shared_path
from annotary.sources.files import escaped

#: Vector words in one broadcast. A word and its key take about 100 bytes in a
#: hash relation, so a broadcast stays below about 100 MB whatever the table's size.
WORDS_PER_BROADCAST = 1_000_000
_FILE, _WORD, _BITS, _ROW = "__place_file", "__place_word", "__place_bits", "__place_row"


def _file(uri: Column) -> Column:
    """Number of a file; Spark writes the root of one and the same file with one slash or with three."""
    return F.xxhash64(F.regexp_replace(uri, r"^(\w+):/+", "$1:/"))


def _place(df: DataFrame) -> DataFrame:
    meta = df.metadataColumn("_metadata")  # also right where the table has a column of that name
    return df.withColumns({_FILE: _file(meta["file_path"]), _ROW: meta["row_index"]})


def _word() -> Column:
    return F.shiftright(F.col(_ROW), 6)


def _bit() -> Column:
    return F.expr(f"shiftleft(1L, cast({_ROW} & 63 as int))")


def deletion_vectors(spark: SparkSession, path: str, key: str, order: Sequence[str]) -> DataFrame:
    """``(__place_file, __place_word, __place_bits)``: the bits of rows that another delivery of the same key replaces."""
    narrow = _place(spark.read.parquet(path)).select(
        F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], _FILE, _ROW
    ).where("k is not null")
    rank = [x for i in range(len(order)) for x in (F.col(f"o{i}").isNull().alias(f"n{i}"), F.col(f"o{i}"))]
    winners = narrow.groupBy("k").agg(F.min(F.struct(*rank, _FILE, _ROW)).alias("w")).select(f"w.{_FILE}", f"w.{_ROW}")
    words = lambda df, what: df.groupBy(F.col(_FILE), _word().alias(_WORD)).agg(F.bit_or(_bit()).alias(what))
    none = F.lit(0).cast("bigint")
    both = words(narrow, "there").withColumn("kept", none).unionByName(words(winners, "kept").withColumn("there", none))
    return (
        both.groupBy(_FILE, _WORD)
        .agg(F.bit_or("there").alias("there"), F.bit_or("kept").alias("kept"))
        .select(_FILE, _WORD, F.col("there").bitwiseAND(F.bitwise_not("kept")).alias(_BITS))
        .where(f"{_BITS} <> 0")
    )


def read_with_vectors(
    spark: SparkSession, path: str, vectors: DataFrame, deleted: bool = False, words: int = WORDS_PER_BROADCAST
) -> DataFrame:
    """The table's rows without those in ``vectors``, or with ``deleted`` only those.

    Files are packed into groups whose vectors hold at most ``words`` entries; each group is one
    scan with its own broadcast, and a file that holds more is scanned once for each ``words``
    words of its rows. So the broadcast never grows with the table. The vectors of many groups
    are written once, a folder for each group. The driver holds a number for each file, as
    Spark's own listing does."""
    plain = spark.read.parquet(path)
    sizes = {r[_FILE]: r["n"] for r in vectors.groupBy(_FILE).agg(F.count("*").alias("n")).toLocalIterator()}
    if sum(sizes.values()) <= words:
        return _masked(plain, plain.columns, vectors, deleted)
    groups: list[tuple[int, list[str]]] = []
    number: dict[int, int] = {}
    by_hash = spark.createDataFrame([(f,) for f in plain.inputFiles()], "f string").select("f", _file(F.col("f")).alias("h"))
    for f, h in ((r.f, r.h) for r in by_hash.toLocalIterator()):
        n = sizes.get(h, 0)
        if not groups or groups[-1][0] + n > words:
            groups.append((0, []))
        groups[-1] = (groups[-1][0] + n, [*groups[-1][1], escaped(unquote(f))])
        number[h] = len(groups) - 1
    at = shared_path(spark, "vectors")
    named = spark.createDataFrame([(h, number[h]) for h in sizes], f"{_FILE} long, __place_group int")
    vectors.join(named, _FILE).write.partitionBy("__place_group").parquet(at)
    parts = []
    for i, (n, fs) in enumerate(groups):
        rows = spark.read.schema(plain.schema).parquet(*fs)
        if not n:
            parts += [] if deleted else [rows]
            continue
        own = spark.read.schema(vectors.schema).parquet(f"{at}/__place_group={i}")
        if n <= words:
            parts.append(_masked(rows, plain.columns, own, deleted))
            continue
        last = own.agg(F.max(_WORD)).head()[0]
        # rows behind the last word with an entry are in the last range
        for low in range(0, last + 1, words):
            high = low + words if low + words <= last else None
            parts.append(_masked(rows, plain.columns, own, deleted, low, high))
    return reduce(DataFrame.unionByName, parts)


def _masked(rows: DataFrame, columns: Sequence[str], vectors: DataFrame, deleted: bool, low: int = 0, high: int | None = None) -> DataFrame:
    """Rows, of words ``[low, high)``, that ``vectors`` leave or take; the vectors are broadcast, their number is bounded by the caller."""
    placed = _place(rows).withColumn(_WORD, _word())
    for limit in [F.col(_WORD) >= low] * bool(low) + ([F.col(_WORD) < high] if high is not None else []):
        placed, vectors = placed.where(limit), vectors.where(limit)
    joined = placed.join(F.broadcast(vectors), [_FILE, _WORD], "left")
    hit = F.coalesce(F.col(_BITS).bitwiseAND(_bit()) != 0, F.lit(False))
    return joined.where(hit if deleted else ~hit).select(*[F.col(f"`{c}`") for c in columns])


def one_per_key(spark: SparkSession, path: str, key: str, order: Sequence[str], deleted: bool = False) -> DataFrame:
    """The table at ``path`` with one row per non-null ``key``: the least in ``order``, nulls last.

    With ``deleted`` the rows that had to go instead."""
    return read_with_vectors(spark, path, cut(deletion_vectors(spark, path, key, order), "vectors"), deleted)
