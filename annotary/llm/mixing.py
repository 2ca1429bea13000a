"""Mixing sources to target shares of the total size in tokens.

Sizes are counted with a public tokenizer. Weights are tempered shares: a source's share of
the tokens is raised to an exponent and taken against a base, ``base ** (1 - a) * share ** a``,
so exponent 0 gives the base and exponent 1 the natural shares, which repeat nothing.

* Rule ``targets``: the base is the target shares. Each source has its own exponent, bisected
  to the least one at which its repetition limit holds. It stays 0, and the target is met, where
  the limit allows; a source whose exponent has to rise falls short, and gets what its limit gives.
* Rule ``temperature``: the base is even and one exponent serves all. It is bisected to the
  target entropy (of the target shares), then, where a source would be repeated too often,
  towards 1 until the limit holds. A source falls short if it cannot reach that weight.

One exponent cannot meet many given shares, so ``targets`` has one for each source. The plan
states weights under the rule and those of the single exponent beside them. Budgets are shares
of the size T of all listed sources; what short sources leave of T is not given to others, so
actual shares are stated of T and of the mix.

Either is realised by budgeted block permutations: whole passes over a source, and for the
remainder the documents in a random order fixed by the seed, block after block, until the
budget is used. Blocks are summed, then the parts of the block in which the budget ends, and
only the last part is looked at document by document: at 10 ** 11 documents of one source about
6,000, so nothing is sorted or held whole.

Defined cases: documents of a null or unlisted source are left out; null and empty texts
have 0 tokens; a listed source without tokens falls short if its target is above 0, of a table without
any too; of a
source listed twice the greater share and limit hold; null shares are 0 and null limits 1.
Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.functions.tokenizer import coder, read_vocabulary
from annotary.runtime import spread

BLOCKS = 4096


def _counter(vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(vocabulary.value)
        for pdf in batches:
            sizes = [len(c.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "tokens": sizes})

    return run


def token_sizes(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(id, source, tokens)`` of ``docs(id, source, text)``. The vocabulary is read here and sent to the tasks."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary))  # a vocabulary file, about 1 MB
    return spread(docs.select("id", "source", "text")).mapInPandas(_counter(ranks), "id long, source string, tokens long")


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def tempered(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares of the sizes raised to the exponent; sources without size have none."""
    top = max(sizes.values(), default=0)
    raised = {s: (n / top) ** exponent if n > 0 else 0.0 for s, n in sizes.items()}
    total = sum(raised.values())
    return {s: x / total if total else 0.0 for s, x in raised.items()}


def bisect_exponent(sizes: dict[str, float], target: float, limits: dict[str, float], total: float) -> float:
    """The exponent in [0, 1] whose shares have the target entropy, raised until no source exceeds its limit.

    Entropy falls and the greatest repetition, that of the smallest source, falls as the exponent grows."""

    def search(small_enough) -> float:
        low, high = 0.0, 1.0
        if small_enough(low):
            return low
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if small_enough(mid) else (mid, high)
        return high

    by_entropy = search(lambda a: entropy(list(tempered(sizes, a).values())) <= target)
    fits = lambda a: all(p * total <= sizes[s] * limits[s] * (1 + 1e-12) for s, p in tempered(sizes, a).items())
    return max(by_entropy, search(fits))


def own_exponent(base: float, share: float, limit: float) -> float:
    """The least exponent in [0, 1] at which ``base ** (1 - a) * share ** a`` is at most ``limit``; 1 where none does."""
    fits = lambda a: base <= limit if a == 0 else (base ** (1 - a) * share**a if base > 0 and share > 0 else 0.0) <= limit
    if fits(0.0):
        return 0.0
    if share == 0 or not fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def plan(sizes: DataFrame, targets: DataFrame, rule: str = "targets") -> DataFrame:
    """One row per listed source: target, weight, size, budget in tokens, whole passes, remainder, exponent, and whether it falls short.

    ``sizes(source, tokens)`` are summed where they are; one row a listed source reaches the driver."""
    spark = sizes.sparkSession
    listed = targets.where("source is not null").groupBy("source").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats")
    )
    total_by = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = listed.join(total_by, "source", "left").fillna(0, ["tokens"]).collect()
    total = sum(r["tokens"] for r in rows)
    have = {r["source"]: float(r["tokens"]) for r in rows}
    single = bisect_exponent(have, entropy([r["target_share"] for r in rows]), {r["source"]: float(max(1, r["max_repeats"])) for r in rows}, total)
    even = tempered(have, single)
    out = []
    for r in rows:
        s, size, target = r["source"], r["tokens"], r["target_share"]
        cap = size * max(0, r["max_repeats"])
        if rule == "targets":
            share, limit = (size / total, cap / total) if total else (0.0, 0.0)
            exponent = own_exponent(target, share, limit)
            weight = target if exponent == 0 else limit
            short = exponent > 0
        else:
            exponent, weight = single, even[s]
            short = cap < weight * total * (1 - 1e-9) or (target > 0 and size == 0)
        budget = min(round(weight * total), cap) if weight * total % 1 > 1 - 1e-6 else min(int(weight * total), cap)
        passes = budget // size if size else 0
        out.append((s, target, float(weight), r["max_repeats"], size, budget, passes, budget - passes * size, short, float(exponent), single, even[s], total))
    return spark.createDataFrame(
        out,
        "source string, target_share double, weight double, max_repeats int, tokens long, budget long, passes long, rest long, short boolean, "
        "exponent double, single_exponent double, tempered_share double, total long",
    )


def _last(rows: DataFrame, block: str, left: str, to: str) -> DataFrame:
    """``(source, to, left)``: the block of each source in which what is left of its budget ends, and what is left there."""
    sums = rows.groupBy("source", block).agg(F.sum("tokens").alias("in_block"), F.first(left).alias("l"))
    upto = F.sum("in_block").over(Window.partitionBy("source").orderBy(block))  # at most BLOCKS rows a source
    ends = sums.withColumn("upto", upto).where("upto > l and upto - in_block <= l")
    return ends.select("source", F.col(block).alias(to), (F.col("l") - F.col("upto") + F.col("in_block")).alias(f"left_{to}"))


def repeats(sizes: DataFrame, planned: DataFrame, seed: int = 42) -> DataFrame:
    """``(id, source, tokens, repeats)`` for each document of a listed source that is used."""
    h = F.xxhash64(F.lit(seed), F.col("id"))
    placed = sizes.select("id", "source", "tokens").join(planned.select("source", "passes", "rest"), "source").withColumns(
        {"b1": F.pmod(h, F.lit(BLOCKS)).cast("int"), "b2": F.pmod(F.shiftrightunsigned(h, 32), F.lit(BLOCKS)).cast("int")}
    )
    some = placed.where("rest > 0")
    # a row a listed source each
    ends = _last(some, "b1", "rest", "e1")
    ends = ends.join(_last(some.join(ends, "source").where("b1 = e1"), "b2", "left_e1", "e2"), "source", "left")
    known = placed.join(ends, "source", "left")
    edge = F.coalesce((F.col("b1") == F.col("e1")) & (F.col("b2") == F.col("e2")), F.lit(False))
    inside = F.coalesce((F.col("b1") < F.col("e1")) | ((F.col("b1") == F.col("e1")) & (F.col("b2") < F.col("e2"))), F.lit(False))
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), F.col("id")), "id").rowsBetween(Window.unboundedPreceding, 0))
    sure = known.where(~edge).withColumn("extra", inside.cast("int"))
    last = known.where(edge).withColumn("extra", (run <= F.col("left_e2")).cast("int"))
    chosen = sure.unionByName(last).withColumn("repeats", F.col("passes") + F.col("extra"))
    return chosen.where("repeats > 0").select("id", "source", "tokens", F.col("repeats").cast("int").alias("repeats"))


def shares(used: DataFrame, planned: DataFrame) -> DataFrame:
    """Per listed source: target and weight, tokens there are and are used, actual share of the mix and of T, and whether it falls short."""
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most_repeats"))
    joined = planned.join(got, "source", "left").fillna(0, ["used", "most_repeats"])
    whole = F.sum("used").over(Window.partitionBy())  # a row a listed source
    return joined.withColumns(
        {"actual_share": F.when(whole > 0, F.col("used") / whole).otherwise(0.0), "share_of_total": F.when(F.col("total") > 0, F.col("used") / F.col("total")).otherwise(0.0)}
    ).select("source", "target_share", "weight", "exponent", "single_exponent", "tempered_share", "tokens", "used", "most_repeats", "actual_share", "share_of_total", "short")
