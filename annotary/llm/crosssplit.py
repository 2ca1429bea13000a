"""Records that occur, exactly or almost, on both sides of a split.

A record's words are normalised in four forms: in order, and the different words in the order of
each of three hashes. Each form is cut into content-defined chunks: a hash rolls over
the last two words, and a chunk ends where its value is divisible. An edit moves the cuts near
it only, so the remaining chunks of an edited, extended or reordered record keep their digests.
Digests are joined across the sides and the lengths of shared chunks are summed into overlap
fractions. All of this is read off the text in one pass; digests, not texts, are joined.

The join is kept small without losing a pair: each form's chunks are ordered from rare to
common, and the first of them, up to ``1 - TAIL`` of its length, are joined, and any that at
most ``RARE`` records have. Two records that share more than ``TAIL`` of the longer one's length
in a form, or a rare chunk, share at least one of those. Chunks of very many records are salted:
their left rows are dealt out, their right rows copied. Pairs whose sketches of 128 one-bit
MinHash values differ too much for the threshold are dropped inside the join. The others get
the sum over all chunks of the text, and the exact similarity of their word sets decides.

Recall: the exact condition is on word sets; a pair is missed if in every form it shares no
chunk that is rare or among the first. In a simulation (each different text of sf0.1 with an
edited copy that ends at a similarity of 0.70 to 0.735, about 2,200 pairs a kind) of words
substituted, deleted, inserted or a mixture none was missed in order, and one of the deletions
fully reordered. The sketch test loses about 2 in 100,000 pairs at the threshold besides.
``exact=True`` takes the candidates of ``neardup.exact_candidates`` instead, which loses none.

Defined cases: rows without text, split or id, and with a split of neither side, are in no pair; nor are
texts with fewer than ``min_words`` different words. Equal texts on both sides are a pair
with overlap 1. Labels and sources play no part. Repeated rows have their own ids and are in
pairs of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.functions.tokens import words
from annotary.llm.neardup import BITS, MinHash, WordHashes, agree, agree_limit, exact_candidates, similarity, sketch
from annotary.operators.delivery import one_per_key
from annotary.runtime import cut, cut_path, spread

#: Mean number of words between cuts.
MEAN_WORDS = 4
TAIL, RARE = 0.15, 50
#: Left rows of one chunk in a task of the join.
SALT_ROWS = 100_000
_U = np.uint64
#: Base of the rolling hash, its inverse, and factors that mix bits (odd numbers).
_BASE, _MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_ORDERS = _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
FORMS = 4
_INVERSE = _U(pow(int(_BASE), -1, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    return x ^ (x >> _U(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunks(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, length in words and record of each content-defined chunk of word hashes; ``starts`` are where records begin.

    Digests come from differences of one running polynomial, so each word is hashed once."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.concatenate([np.zeros(1, np.uint64), tokens[:-1]])
    before[starts] = 0
    ends = _mixed(tokens * _BASE + before) % _U(MEAN_WORDS) == 0
    ends[np.append(starts[1:], n) - 1] = True
    ends = np.flatnonzero(ends)
    begins = np.append(0, ends[:-1] + 1)
    running = np.add.accumulate(tokens * _powers(_BASE, n))
    digest = (running[ends] - np.where(begins > 0, running[begins - 1], _U(0))) * _powers(_INVERSE, n)[begins]
    return _mixed(digest), ends - begins + 1, np.searchsorted(starts, begins, "right") - 1


def forms(tokens: np.ndarray) -> list[np.ndarray]:
    """A record's normal forms: as it stands, its different words in the order of their hashes, and in two more orders.

    The last three do not depend on the order of a record; an edit that breaks a chunk of one seldom breaks the same words in another."""
    different = np.unique(tokens)
    return [tokens, different, *(different[np.argsort(different * x)] for x in _ORDERS)]


def chunk_lists(records: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each record the digests of all forms' chunks, the form in the two lowest bits, and their lengths. A chunk that recurs counts once."""
    found = []
    for i, parts in enumerate(zip(*map(forms, records))):
        digest, length, record = chunks(np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])]))
        found.append(((digest & ~_U(3)) | _U(i), length, record))
    digest, length, record = map(np.concatenate, zip(*found))
    order = np.lexsort((digest, record))
    digest, length, record = digest[order], length[order], record[order]
    first = np.ones(len(digest), bool)
    first[1:] = (digest[1:] != digest[:-1]) | (record[1:] != record[:-1])
    bounds = np.searchsorted(record[first], np.arange(1, len(records)))
    return np.split(digest[first].view(np.int64), bounds), np.split(length[first].astype(np.int32), bounds)


_RECORD = "id long, is_left boolean, digest binary, hashes array<long>, s1 long, s2 long, chunk array<long>, length array<int>, sizes array<int>"


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, kind)))


def _records(min_words: int, most: int = 1 << 20):
    """Records with their chunks. A text that a task has met before keeps only its digest: an earlier row stands for its class.

    ``most`` texts are remembered; beyond that they are forgotten and written in full again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, minhash = WordHashes(), MinHash(BITS)
        seen: dict[bytes, bytes | None] = {}
        none = np.empty(0, np.uint64)
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            ids, sides, digests, full = [], [], [], []
            records: list[np.ndarray] = []
            sets: list[np.ndarray] = []
            if len(seen) > most:
                seen.clear()
            for i, side, text in zip(*(batch.column(c).to_pylist() for c in ("id", "is_left", "text"))):
                mark = b"l" if side else b"r"
                key = xxhash.xxh3_128_digest(text) + mark
                new = key not in seen
                if new:
                    tokens = hashed(words(text))
                    different = np.unique(tokens)
                    seen[key] = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() + mark if len(different) >= min_words else None
                if seen[key] is None:
                    continue
                ids.append(i)
                sides.append(side)
                digests.append(seen[key])
                full.append(new)
                if new:
                    records.append(tokens)
                    sets.append(different)
            if not ids:
                continue
            at = np.flatnonzero(full)
            s1, s2 = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            chunk, length, sizes = ([none.view(np.int64)] * len(ids), [none.astype(np.int32)] * len(ids), [none.astype(np.int32)] * len(ids))
            different = [none.view(np.int64)] * len(ids)
            if len(at):
                s1[at], s2[at] = sketch(minhash(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])))
                for j, c, n, d in zip(at, *chunk_lists(records), sets):
                    chunk[j], length[j], different[j] = c, n, d.view(np.int64)
                    sizes[j] = np.bincount(c & 3, n, FORMS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sides, pa.bool_()), pa.array(digests, pa.binary()), _lists(different, np.int64), pa.array(s1), pa.array(s2),
                    _lists(chunk, np.int64), _lists(length, np.int32), _lists(sizes, np.int32),
                ],
                ["id", "is_left", "digest", "hashes", "s1", "s2", "chunk", "length", "sizes"],
            )

    return run


def _met(classes: DataFrame, threshold: float) -> DataFrame:
    """``(l, r)``: pairs of classes across the sides that share a chunk joined and have sketches near enough."""
    flat = classes.select("cid", "is_left", F.explode(F.arrays_zip("chunk", "length")).alias("c")).select("cid", "is_left", F.col("c.chunk").alias("chunk"), F.col("c.length").alias("length"))
    # chunks of one side only come first in a record's order; their length is all but that of the others
    both_sides = flat.groupBy("chunk").agg(F.count("*").alias("df"), F.max("is_left").alias("some"), F.min("is_left").alias("all_left")).where("some and not all_left").select("chunk", "df")
    narrow = classes.select("cid", "is_left", "s1", "s2", "sizes")
    shared = flat.drop("is_left").join(both_sides, "chunk").withColumn("form", F.col("chunk").bitwiseAND(3).cast("int")).repartition("cid")
    by_form = Window.partitionBy("cid", "form")
    rows = shared.withColumns({"upto": F.sum("length").over(by_form.orderBy("df", "chunk")), "all": F.sum("length").over(by_form)}).join(narrow, "cid")
    rows = rows.withColumn("total", F.element_at("sizes", F.col("form") + 1)).withColumn("before", F.col("total") - F.col("all") + F.col("upto") - F.col("length"))
    rows = rows.where((F.col("before") <= (1 - TAIL) * F.col("total")) | (F.col("df") <= RARE))
    rows = cut(rows.select("cid", "chunk", "df", "total", "is_left", "s1", "s2"), "joined").withColumn("salts", F.ceil(F.col("df") / SALT_ROWS).cast("int"))
    a = rows.where("is_left").select("chunk", F.pmod(F.xxhash64("cid"), "salts").cast("int").alias("salt"), F.col("cid").alias("l"), F.col("total").alias("tl"), F.col("s1").alias("l1"), F.col("s2").alias("l2"))
    b = rows.where("not is_left").select("chunk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("cid").alias("r"), F.col("total").alias("tr"), F.col("s1").alias("r1"), F.col("s2").alias("r2"))
    # texts whose lengths differ more than the share allows cannot pass
    met = a.join(b, ["chunk", "salt"]).where(F.least("tl", "tr") >= TAIL * F.greatest("tl", "tr"))
    return met.where(agree(agree_limit(threshold), F.col("l1"), F.col("r1"), F.col("l2"), F.col("r2"))).select("l", "r").distinct()


def overlaps(
    rows: DataFrame, left: Sequence[str] = ("train",), right: Sequence[str] = ("validation", "test"), threshold: float = 0.7, min_words: int = 20, exact: bool = False
) -> DataFrame:
    """``(id_l, id_r, overlap, similarity)`` of ``rows(id, text, split)``: each pair across the sides once.

    ``overlap`` is the shared chunks' share of the right record's length."""
    spark = rows.sparkSession
    used = rows.where("id is not null and text is not null").where(F.col("split").isin([*left, *right])).select("id", F.col("split").isin([*left]).alias("is_left"), "text")
    read = spread(used).mapInArrow(_records(max(1, min_words)), _RECORD).withColumn("cid", F.monotonically_increasing_id())
    # numbers are fixed by writing; the least of equal texts of a side stands for their class
    path = cut_path(read, "records")
    classes = one_per_key(spark, path, "digest", ["cid"])
    narrow = spark.read.parquet(path).select("digest", "id", "cid")
    heads = narrow.groupBy("digest").agg(F.min("cid").alias("cid"))
    members = cut(narrow.drop("cid").join(heads, "digest").select("cid", "id"), "members")
    if exact:
        pairs = exact_candidates(classes, threshold)
        both = pairs.select(F.col("a").alias("l"), F.col("b").alias("r")).unionByName(pairs.select(F.col("b").alias("l"), F.col("a").alias("r")))
        side = lambda flag, n: classes.where(flag).select(F.col("cid").alias(n))
        met = both.join(side("is_left", "l"), "l", "left_semi").join(side("not is_left", "r"), "r", "left_semi")
    else:
        met = _met(classes, threshold)
    full = classes.select("cid", F.struct("hashes", "chunk", "length").alias("v"))
    side = lambda n: full.select(F.col("cid").alias(n), F.col("v").alias(f"v{n}"))
    both = met.join(side("l"), "l").join(side("r"), "r").withColumn("similarity", similarity(F.col("vl.hashes"), F.col("vr.hashes"))).where(F.col("similarity") >= threshold)
    # of the form that keeps the order
    parts = F.filter(F.arrays_zip("vr.chunk", "vr.length"), lambda x: x["chunk"].bitwiseAND(3) == 0)
    own = F.aggregate(parts, F.lit(0), lambda s, x: s + F.when(F.array_contains("vl.chunk", x["chunk"]), x["length"]).otherwise(0))
    whole = F.aggregate(parts, F.lit(0), lambda s, x: s + x["length"])
    near = both.select("l", "r", (own / whole).alias("overlap"), "similarity")
    end = lambda n: members.select(F.col("cid").alias(n), F.col("id").alias(f"id_{n}"))
    return near.join(end("l"), "l").join(end("r"), "r").select("id_l", "id_r", "overlap", "similarity")


def report(rows: DataFrame, pairs: DataFrame, right: Sequence[str] = ("validation", "test")) -> DataFrame:
    """Per split and source of ``rows(id, text, split, source)``: records, those found on the other side, pairs, and of each
    record found its greatest similarity and overlap, averaged."""
    hit = pairs.groupBy(F.col("id_r").alias("id")).agg(F.count("*").alias("pairs"), F.max("overlap").alias("overlap"), F.max("similarity").alias("similarity"))
    return (
        rows.where(F.col("split").isin([*right])).select("id", "split", "source").join(hit, "id", "left")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("records"), F.count("pairs").alias("leaked"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
            F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.round(F.avg("overlap"), 4).alias("mean_overlap"),
        )
    )
