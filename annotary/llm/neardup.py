"""Near-duplicate records: an LSH forest over word sets.

Texts with the same set of words form one class; everything below works on classes. A text is
read once, into the sorted 64-bit hashes of its different words; the class is chosen by digest
and its hashes are read through deletion vectors, so they are not shuffled for it.

Each class has a MinHash signature of ``trees`` groups of ``depth`` values. Every group is one
sorted order of all classes (a tree of the forest). Classes whose keys share a long prefix stand
next to each other in it: within a tree, those that agree in the first ``depth - 2`` values are
candidates where that region is small, and in crowded regions the depth grows until it is small
or ``depth`` is reached. Rows are dealt out by the first ``depth - 2`` values; regions that a look at
one class in 64 shows to be hot are dealt out by more of them, and rows of a hot full key are not
sorted at all. Regions crowded at full depth are not cut: their classes are compared
block against block, in as many tasks as there are pairs of blocks. A candidate leaves its task
only if 128 one-bit hashes agree well enough; then the exact similarity decides.

Trees, depth and the sketch's limit follow from the threshold (``forest``): the deepest trees
that meet ``RECALL`` at the threshold with at most ``VALUES`` MinHash values. A pair of similarity
s shares a full-depth prefix in some tree with probability ``1 - (1 - s ** depth) ** trees``, more
where regions are sparse; the sketch test loses about 2 in 100,000 pairs at the threshold.
``exact=True`` takes the candidates by prefix filtering instead, which loses none: the rarest
words of each set, as many as a pair at the threshold must share one of, are joined.

Similarity is that of the sets of 64-bit word hashes: two words of a pair of texts with equal
hashes would count as one, about once in 10 ** 15 pairs of 100 words.

Defined cases: null and empty texts and those with fewer than ``min_words`` different words
are in no pair, each is its own group. Equal texts are one class. Rows with a null id are
left out. Repeated rows count once. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotary.functions.tokens import words
from annotary.operators.delivery import one_per_key
from annotary.runtime import cut, cut_path, spread

#: Recall at the threshold that a forest is laid out for, most MinHash values of a class, one-bit hashes of a sketch.
RECALL, VALUES, BITS = 0.998, 160, 128
#: Most hot regions in a broadcast list.
LISTED = 100_000


class Forest(NamedTuple):
    """Layout of a forest and the limits of its regions."""

    trees: int
    depth: int
    agree: int
    #: A region of at most this many classes is compared whole, at whatever depth it is reached.
    small: int = 48
    #: Regions of more classes at full depth are compared in blocks of this size.
    block: int = 1024
    #: Rows held in a task while a region is incomplete.
    held: int = 262_144
    #: One class of so many is looked at for hot regions, and so many of those make a region hot; more than ``small``.
    looked: int = 64
    hot: int = 1000

    @property
    def least(self) -> int:
        return max(1, self.depth - 2)

    @property
    def bits(self) -> int:
        """Bits of a value in a key of 64 bits, six of them the tree's number."""
        return 58 // self.depth


def forest(threshold: float, **limits: int) -> Forest:
    """The deepest trees that meet ``RECALL`` at the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies above 0 and is at most 1")
    for depth in range(8, 0, -1):
        trees = max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - min(threshold, 0.99) ** depth)))
        if trees * depth <= VALUES and trees <= 64:
            return Forest(trees, depth, agree_limit(threshold), **limits)
    raise ValueError(f"no forest of {VALUES} values finds pairs of similarity {threshold}; use exact=True")


class WordHashes:
    """64-bit hashes of words, kept for words that recur."""

    def __init__(self, most: int = 1 << 20):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, ws) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = np.empty(len(ws), np.uint64)
        for i, w in enumerate(ws):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode())
            out[i] = h
        return out


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sets(min_words: int):
    """Of ``(id, text)`` the digest and the sorted hashes of the different words, where there are enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            ids, keys, sets = [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ws = set(words(text))
                if len(ws) >= min_words:
                    h = hashed(ws)
                    h.sort()
                    ids.append(i)
                    keys.append(digest(h))
                    sets.append(h.view(np.int64))
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "digest", "hashes"]
            )

    return run


def classes_of(rows: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """``(cid, hashes)`` with one row for each word set, and ``(cid, id)`` for each row of ``rows(id, text)``."""
    spark = rows.sparkSession
    read = spread(rows.where("id is not null and text is not null").select("id", "text"))
    sets = read.mapInArrow(_sets(max(1, min_words)), "id long, digest binary, hashes array<long>").withColumn("cid", F.monotonically_increasing_id())
    # numbers are fixed by writing; the least of a digest stands for its class
    path = cut_path(sets, "sets")
    classes = one_per_key(spark, path, "digest", ["cid"]).select("cid", "hashes")
    narrow = spark.read.parquet(path).select("digest", "id", "cid")
    heads = narrow.groupBy("digest").agg(F.min("cid").alias("cid"))
    return classes, cut(narrow.select("digest", "id").distinct().join(heads, "digest").select("cid", "id"), "members")


class MinHash:
    """``total`` mixed MinHash values, at least ``BITS``, of each of many sets laid end to end."""

    def __init__(self, total: int, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.mul = draw.integers(0, 2**63, total, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = draw.integers(0, 2**63, total, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x = hashes ^ (hashes >> np.uint64(32))
        low = np.empty((len(self.mul), len(starts)), np.uint32)
        y = np.empty_like(x)
        for j, (mul, add) in enumerate(zip(self.mul, self.add)):
            np.multiply(x, mul, out=y)
            y += add
            # the least whole value has the least upper half
            low[j] = np.minimum.reduceat(y, starts) >> np.uint64(32)
        return low * np.uint32(2654435761)


def sketch(mixed: np.ndarray) -> list[np.ndarray]:
    """The uppermost bits of the first ``BITS`` values, in two words."""
    bits = (mixed[:BITS] >> np.uint32(31)).astype(np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return [(bits[k : k + 64] * weight[:, None]).sum(axis=0, dtype=np.uint64).view(np.int64) for k in (0, 64)]


def agree_limit(threshold: float) -> int:
    """How many bits of two sketches agree at least at the threshold: the mean less 4.2 deviations."""
    p = (1 + threshold) / 2
    return math.floor(BITS * p - 4.2 * math.sqrt(BITS * p * (1 - p)))


def agree(least: int, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Whether two sketches agree in that many bits."""
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2)) <= BITS - least


_FOREST = ["key", "cid", "s1", "s2"]
_ROWS = "key long, cid long, s1 long, s2 long"


def _keys(f: Forest):
    """Rows of the forest: the tree's number and values in one key, class, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, minhash = np.uint64(f.bits), MinHash(max(f.trees * f.depth, BITS))
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            lists = batch.column("hashes")
            starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            mixed = minhash(np.asarray(lists.flatten()).view(np.uint64), starts)
            cid, words = batch.column("cid"), [pa.array(x) for x in sketch(mixed)]
            # the upper bit is in the sketch; the next ones are the key's
            part = ((mixed << np.uint32(1)) >> np.uint32(32 - f.bits)).astype(np.uint64)
            for t in range(f.trees):
                key = np.full(len(cid), t, np.uint64)
                for v in part[t * f.depth : (t + 1) * f.depth]:
                    key = (key << bits) | v
                key = key << np.uint64(58 - f.depth * f.bits)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), cid, *words], _FOREST)

    return run


def _shift(f: Forest, depth: int) -> int:
    """Bits of a key behind its first ``depth`` values."""
    return 58 - depth * f.bits


def _runs(keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each of the sorted ``keys`` is in."""
    new = np.zeros(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.cumsum(new)


def _alike(least: int, s1a: np.ndarray, s1b: np.ndarray, s2a: np.ndarray, s2b: np.ndarray) -> np.ndarray:
    count = lambda x: np.bitwise_count(x.view(np.uint64)).astype(np.int16)  # noqa: E731  (of signed numbers it counts the absolute value)
    return count(s1a ^ s1b) + count(s2a ^ s2b) <= BITS - least


def _neighbours(f: Forest):
    """Candidate pairs of each region of the sorted trees; rows of regions crowded at full depth as they are.

    Input is sorted by key, so a region is a run of rows and its parts at greater depth are runs in it."""
    depths = range(f.least, f.depth + 1)

    def out(a, b, rows) -> pa.RecordBatch:
        n = len(a)
        null = lambda k: pa.nulls(k, pa.int64())
        cols = [pa.concat_arrays([pa.array(x), null(len(rows))]) for x in (a, b)]
        cols += [pa.concat_arrays([null(n), pa.array(np.ascontiguousarray(rows[:, i]))]) for i in range(4)]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", *_FOREST])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        over: int | None = None

        def work(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            key = x[:, 0]
            region = np.full(len(x), -1, np.int64)
            open_ = np.ones(len(x), bool)
            for i, d in enumerate(depths):
                run_ = _runs(key >> _shift(f, d))
                size = np.bincount(run_)[run_]
                fits = open_ & (size <= (f.small if d < f.depth else f.block))
                if d == f.depth and over is not None:
                    fits &= key != over
                # regions of different depth never interleave: a number for each, in order
                region[fits] = run_[fits] * len(depths) + i
                open_ &= ~fits
            spill, y, r = x[open_], x[~open_], region[~open_]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            k, idx = 1, np.arange(len(y))
            while len(idx):
                idx = idx[idx + k < len(y)]
                idx = idx[r[idx] == r[idx + k]]
                if not len(idx):
                    break
                a, b = y[idx], y[idx + k]
                ok = _alike(f.agree, a[:, 2], b[:, 2], a[:, 3], b[:, 3]) & (a[:, 1] != b[:, 1])
                if ok.any():
                    found.append((np.minimum(a[ok, 1], b[ok, 1]), np.maximum(a[ok, 1], b[ok, 1])))
                k += 1
            left = np.concatenate([p[0] for p in found]) if found else np.empty(0, np.int64)
            right = np.concatenate([p[1] for p in found]) if found else np.empty(0, np.int64)
            if len(left) or len(spill):
                yield out(left, right, spill)

        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(c)) for c in _FOREST], axis=1))
            if sum(map(len, held)) < f.held:
                continue
            x = np.concatenate(held)
            # work up to where the last region begins; a region that fills the space is cut where its depth grows
            for d in depths:
                part = x[:, 0] >> _shift(f, d)
                change = np.flatnonzero(part[1:] != part[:-1])
                if len(change):
                    yield from work(x[: change[-1] + 1])
                    x = x[change[-1] + 1 :]
                    break
            else:
                over = int(x[-1, 0])
                yield from work(x)
                x = x[:0]
            held = [x]
        if held:
            yield from work(np.concatenate(held))

    return run


def _block_pairs(least: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Candidates between two blocks of a crowded region, or within one."""
        low, high = key[1], key[2]
        x, y = pdf[pdf["own"] == low], pdf[pdf["own"] == high]
        a, b = np.meshgrid(np.arange(len(x)), np.arange(len(y)), indexing="ij")
        a, b = a.ravel(), b.ravel()
        v = {c: (x[c].to_numpy()[a], y[c].to_numpy()[b]) for c in ("cid", "s1", "s2")}
        ok = _alike(least, *v["s1"], *v["s2"]) & ((v["cid"][0] < v["cid"][1]) if low == high else (v["cid"][0] != v["cid"][1]))
        p, q = v["cid"][0][ok], v["cid"][1][ok]
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)})

    return run


def hot_regions(classes: DataFrame, f: Forest) -> DataFrame:
    """``(depth, prefix)`` of regions that hold ``hot`` or more of the classes looked at.

    Only where rows go depends on it: such a region has more than ``small`` classes, so its pairs are
    looked for at a greater depth, and its rows can be dealt out by that."""
    rows = classes.where(F.pmod(F.xxhash64("cid"), F.lit(f.looked)) == 0).mapInArrow(_keys(f), _ROWS)
    levels = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("key", _shift(f, d)).alias("prefix")) for d in range(f.least, f.depth + 1)])
    return rows.select(F.inline(levels)).groupBy("depth", "prefix").agg(F.count("*").alias("n")).where(F.col("n") >= max(f.hot, f.small + 1)).select("depth", "prefix")


def placed(rows: DataFrame, hot: DataFrame, f: Forest) -> DataFrame:
    """Rows with ``place``, the region by whose depth a row is dealt out: the first on its way that is not hot; null where even the full key is."""
    n = hot.count()
    place = F.lit(None).cast("string")
    for d in range(f.depth, f.least - 1, -1):
        own = hot.where(F.col("depth") == d).select(F.col("prefix").alias(f"__p{d}"), F.lit(True).alias(f"__hot{d}"))
        own = F.broadcast(own) if n <= LISTED else own
        rows = rows.join(own, F.shiftright("key", _shift(f, d)) == F.col(f"__p{d}"), "left")
        # deeper regions first, so that a shallower one that is not hot decides
        place = F.when(F.col(f"__hot{d}").isNull(), F.concat(F.lit(f"{d}:"), F.shiftright("key", _shift(f, d)))).otherwise(place)
    return rows.select(*_FOREST, place.alias("place"))


def candidates(classes: DataFrame, f: Forest) -> DataFrame:
    """``(a, b)``: pairs of classes that the forest brings together, each once."""
    rows = classes.mapInArrow(_keys(f), _ROWS)
    hot = cut(hot_regions(classes, f), "hot")
    straight = None
    # a region is whole in a partition: all rows of a tree with the same first values
    if hot.isEmpty():
        dealt_out = rows.repartition(F.shiftright("key", _shift(f, f.least)))
    else:
        rows = placed(rows, hot, f)
        straight = rows.where("place is null").drop("place")
        dealt_out = rows.where("place is not null").repartition("place").drop("place")
    met = cut(dealt_out.sortWithinPartitions("key").mapInArrow(_neighbours(f), f"a long, b long, {_ROWS}").distinct(), "neighbours")
    crowded = met.where("cid is not null").drop("a", "b")
    crowded = crowded if straight is None else crowded.unionByName(straight)
    blocks = crowded.groupBy("key").agg(F.expr(f"cast(ceil(count(*) / {f.block}) as int)").alias("blocks"))
    dealt = crowded.join(blocks, "key").withColumn("own", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    rest = dealt.groupBy("key", "low", "high").applyInPandas(_block_pairs(f.agree), "a long, b long")
    return met.where("a is not null").select("a", "b").unionByName(rest).distinct()


def exact_candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: all pairs of classes that can reach the threshold, by prefix filtering and sizes.

    Words are ordered from rare to common; two sets at the threshold share one of their first
    ``n - ceil(threshold * n) + 1`` words. Words of many sets come last, so few sets are joined on them."""
    flat = classes.select("cid", F.size("hashes").alias("n"), F.explode("hashes").alias("word"))
    known = flat.groupBy("word").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("df", "word"))
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    kept = cut(flat.join(known, "word").withColumn("place", place).where(F.col("place") <= first).where("df > 1").select("cid", "n", "word"), "prefixes")
    a, b = kept.select("word", F.col("cid").alias("a"), F.col("n").alias("na")), kept.select("word", F.col("cid").alias("b"), F.col("n").alias("nb"))
    near = (F.col("na") >= F.lit(threshold) * F.col("nb")) & (F.col("nb") >= F.lit(threshold) * F.col("na"))
    return a.join(b, "word").where("a < b").where(near).select("a", "b").distinct()


def similarity(a: Column, b: Column) -> Column:
    """Of two sets of hashes."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def similar_classes(classes: DataFrame, threshold: float, exact: bool = False, **limits: int) -> DataFrame:
    """``(a, b, similarity)``: candidate pairs whose exact word-set similarity reaches the threshold."""
    met = exact_candidates(classes, threshold) if exact else candidates(classes, forest(threshold, **limits))
    side = lambda n: classes.select(F.col("cid").alias(n), F.col("hashes").alias(f"w{n}"))
    both = met.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", similarity(F.col("wa"), F.col("wb")))
    return both.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def near_pairs(rows: DataFrame, threshold: float = 0.7, min_words: int = 20, exact: bool = False, **limits: int) -> DataFrame:
    """``(id_a, id_b)``, smaller first: all pairs of different ids in ``rows(id, text)`` that are near-duplicates.

    Pairs of ids are written out, equal texts included, as many as there are; ``near_groups`` gives a row for each id."""
    classes, members = classes_of(rows, min_words)
    linked = similar_classes(classes, threshold, exact, **limits).select("a", "b")
    side = lambda n: members.select(F.col("cid").alias(n), F.col("id").alias(f"i{n}"))
    across = linked.join(side("a"), "a").join(side("b"), "b")
    within = side("a").join(side("b"), F.col("a") == F.col("b"))
    both = across.select("ia", "ib").unionByName(within.select("ia", "ib").where("ia < ib"))
    return both.where("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(id, root)``: the least id that each id of ``edges(a, b)`` is connected with.

    Each round takes the least label among neighbours and then the label's own label, so
    the rounds grow with the logarithm of the longest path, about."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        stepped = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("far"))
        nxt = cut(stepped.join(jump, "root", "left").select("id", "was", F.least("root", "far").alias("root")), "labels")
        labels = nxt.select("id", "root")
        if nxt.where("was <> root").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_groups(rows: DataFrame, threshold: float = 0.7, min_words: int = 20, exact: bool = False, **limits: int) -> DataFrame:
    """One row per id of ``rows(id, text)``: ``(id, group_id, copies, links)``.

    ``group_id`` is the least id of the group, ``copies`` counts the ids with the same word
    set, ``links`` the other word sets that are near. An id with several texts is in the
    group of each, so its groups become one."""
    classes, members = classes_of(rows, min_words)
    linked = cut(similar_classes(classes, threshold, exact, **limits).select("a", "b"), "linked")
    sizes = members.groupBy("cid").agg(F.count("*").alias("copies"), F.min("id").alias("head"))
    ends = linked.select(F.col("a").alias("cid")).unionByName(linked.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("links"))
    known = cut(members.join(sizes, "cid").join(ends, "cid", "left").fillna(0, ["links"]), "known")
    # edges between ids: each to the head of its class, and the heads of near classes
    head = known.select("cid", "head").distinct()
    star = known.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    across = linked.join(head.select(F.col("cid").alias("a"), F.col("head").alias("ha")), "a").join(head.select(F.col("cid").alias("b"), F.col("head").alias("hb")), "b")
    found = components(star.unionByName(across.where("ha <> hb").select(F.col("ha").alias("a"), F.col("hb").alias("b"))))
    per_id = known.groupBy("id").agg(F.max("copies").alias("copies"), F.sum("links").alias("links"))
    ids = rows.where("id is not null").select("id").distinct()
    return (
        ids.join(per_id, "id", "left").join(found, "id", "left")
        .select("id", F.coalesce("root", "id").alias("group_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    )
