"""Several values packed in one field: one row per value, position kept.

Each field is a lattice of candidates (``functions.packed``): any delimiter may separate or
belong to a value, a closed quoted span may be one value as a whole. What is likely is
learned from all rows of the column by expectation-maximisation, at two levels.

* Shapes. The lattice depends on a field's shape only (letters and digits by class), so the
  column is reduced to its distinct shapes with their numbers of rows. Fields with a single
  reading give the first frequencies of candidates' shapes; rounds of forward-backward over
  all lattices, each weighted by its rows, then settle them. Frequencies are a hashed table
  of one size for every column, so the broadcast is bounded.
* Values. Where a shape leaves a reading open (a probability below ``SURE``), the values'
  own frequencies decide: expected counts over the column, with the field's own count left
  out (else each odd field would be its own best value), and shapes for values not seen
  elsewhere. Values are a table joined by key.

Viterbi gives each shape, or each open field, its most probable path; rows take it by key.
A field without any possible delimiter has a single candidate and needs no path.

Defined cases: null, blank, delimiter-only fields and a lone hyphen give no row; nor does bare
text without a digit, such as an answer that nothing matches (``digit=False`` makes it a value).
Quoted text is a value. A quote that never closes is dropped. Values are kept as they stand,
repeated ones included. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotary.functions import packed as P
from annotary.runtime import cut, spread

ROUNDS = 2
#: A path is taken for its shape alone if each of its candidates has at least this probability.
SURE = 0.9


def shape_of(raw: Column) -> Column:
    for pattern, to in P.SHAPE:
        raw = F.regexp_replace(raw, pattern, to)
    return raw


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


class _Model:
    """Shape frequencies of each column, sent to the tasks: ``BUCKETS`` numbers a column."""

    def __init__(self, counts: dict[str, np.ndarray], totals: dict[str, float]):
        self.counts, self.totals, self._p = counts, totals, {}

    def __getstate__(self):
        return self.counts, self.totals

    def __setstate__(self, state):
        self.__init__(*state)

    def log_p(self, tab: str):
        if tab not in self._p:
            self._p[tab] = P.shape_log_p(self.counts.get(tab), self.totals.get(tab, 0.0))
        return self._p[tab]


def _lattice(shape: str, digit: bool):
    f = P.read(shape)
    return len(f.atoms), P.edges(f, f, digit)


def _expected(model, digit: bool):
    """Expected numbers of candidates by bucket; without a model those of fields with one reading."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = model.value if model else None
        got: dict[tuple[str, int], float] = {}
        for pdf in batches:
            for tab, shape, rows in zip(pdf["tab"], pdf["shape"], pdf["n"]):
                n, es = _lattice(shape, digit)
                if known:
                    p = known.log_p(tab)
                    post = P.posteriors(n, es, [p(e.shape) for e in es])[0]
                else:
                    post = [1.0] if len(es) == 1 else []
                for e, q in zip(es, post):
                    if q > 1e-12:
                        key = (tab, P.bucket(e.shape))
                        got[key] = got.get(key, 0.0) + rows * q
        yield pd.DataFrame([(*k, v) for k, v in got.items()], columns=["tab", "bucket", "n"])

    return run


def _decoded(model, digit: bool, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = model.value
        for pdf in batches:
            rows = []
            for tab, shape in zip(pdf["tab"], pdf["shape"]):
                n, es = _lattice(shape, digit)
                p = known.log_p(tab)
                post, path = P.posteriors(n, es, [p(e.shape) for e in es])
                sure = all(post[k] >= least for k in path) or len(es) < 2 or all(e.kind == P.FILLER for e in es)
                rows.append((P.spell(es, path), len(es) > 1, sure))
            yield pdf[["tab", "shape"]].assign(**{c: [r[i] for r in rows] for i, c in enumerate(("path", "choice", "sure"))})

    return run


def _learn(shapes: DataFrame, rounds: int, digit: bool):
    """The broadcast model after ``rounds``. What reaches the driver is at most ``BUCKETS`` rows a column."""
    sc = shapes.sparkSession.sparkContext
    model = None
    for _ in range(rounds + 1):
        found = shapes.mapInPandas(_expected(model, digit), "tab string, bucket int, n double").groupBy("tab", "bucket").agg(F.sum("n").alias("n"))
        counts: dict[str, np.ndarray] = {}
        for r in found.collect():
            counts.setdefault(r["tab"], np.zeros(P.BUCKETS))[r["bucket"]] = r["n"]
        model = sc.broadcast(_Model(counts, {t: float(c.sum()) for t, c in counts.items()}))
    return model


def shape_paths(rows: DataFrame, rounds: int = ROUNDS, digit: bool = True, sure: float = SURE):
    """``(tab, shape, n, path, choice, sure)`` for each shape of ``rows(tab, raw)``, and the model."""
    shapes = cut(rows.where("raw is not null").groupBy("tab", shape_of(F.col("raw")).alias("shape")).agg(F.count("*").alias("n")), "shapes")
    model = _learn(shapes, rounds, digit)
    return shapes.mapInPandas(_decoded(model, digit, sure), "tab string, shape string, path string, choice boolean, sure boolean"), model


_LATTICE = "array<struct<at:int,to:int,kind:string,value:string,base:double,post:double>>"


def _candidates(model, digit: bool):
    """Lattices of open fields: each candidate's log probability by shape and characters, and as its first share that among all paths alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = model.value
        for pdf in batches:
            out = []
            for tab, raw, shape in zip(pdf["tab"], pdf["raw"], pdf["shape"]):
                f, s = P.read(raw), P.read(shape)
                es = P.edges(f, s, digit)
                p = [known.log_p(tab)(e.shape) for e in es]
                post = P.posteriors(len(s.atoms), es, [0.0] * len(es))[0]
                values = [("~" if e.kind == P.FILLER else "") + f.value(e) for e in es]
                spelled = [sum(math.log(10) if c.isdigit() else math.log(26) for c in v if c.isalnum()) for v in values]
                out.append([{"at": e.at, "to": e.to, "kind": e.kind, "value": v, "base": q - c, "post": w} for e, v, q, c, w in zip(es, values, p, spelled, post)])
            yield pdf[["tab", "raw", "n"]].assign(lattice=out)

    return run


def _settled(model):
    """One more round: posteriors and best path from the values' counts, the field's own left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = model.value.totals
        for pdf in batches:
            lattices, paths = [], []
            for tab, n, lattice in zip(pdf["tab"], pdf["n"], pdf["lattice"]):
                lattice = sorted((dict(x["e"]) | {"count": x["count"], "pos": x["pos"]} for x in lattice), key=lambda x: x["pos"])
                es = [P.Edge(x["at"], x["to"], x["kind"], "") for x in lattice]
                total = max(totals.get(tab, 0.0), 1.0)
                own = [max(x["count"] - n * x["post"], 0.0) for x in lattice]
                log_p = [math.log((1 - P.REST) * c / total + P.REST * math.exp(max(x["base"], -700.0))) for c, x in zip(own, lattice)]
                post, path = P.posteriors(max(e.to for e in es), es, log_p)
                lattices.append([{k: x[k] for k in ("at", "to", "kind", "value", "base")} | {"post": q} for x, q in zip(lattice, post)])
                paths.append(P.spell(es, path))
            yield pdf[["tab", "raw", "n"]].assign(lattice=lattices, path=paths)

    return run


def value_paths(open_rows: DataFrame, certain: DataFrame, model, rounds: int = ROUNDS, digit: bool = True) -> DataFrame:
    """``(tab, raw, path)`` for each different field of ``open_rows(tab, raw, shape)``.

    ``certain(tab, value)`` are the values of all other fields; only those that are candidates here are counted."""
    fields = open_rows.groupBy("tab", "raw", "shape").agg(F.count("*").alias("n"))
    state = cut(spread(fields, always=True).mapInPandas(_candidates(model, digit), f"tab string, raw string, n long, lattice {_LATTICE}"), "lattices")
    wanted = state.select("tab", F.explode("lattice.value").alias("value")).distinct()
    sure = cut(certain.groupBy("tab", "value").agg(F.count("*").cast("double").alias("count")).join(wanted, ["tab", "value"], "left_semi"), "counts")
    for _ in range(rounds):
        flat = state.select("tab", "raw", "n", F.posexplode("lattice").alias("pos", "e")).withColumn("value", F.col("e.value"))
        counts = sure.unionByName(flat.select("tab", "value", (F.col("n") * F.col("e.post")).alias("count"))).groupBy("tab", "value").agg(F.sum("count").alias("count"))
        again = flat.join(counts, ["tab", "value"]).groupBy("tab", "raw", "n").agg(F.collect_list(F.struct("pos", "e", "count")).alias("lattice"))
        state = cut(again.mapInPandas(_settled(model), f"tab string, raw string, n long, lattice {_LATTICE}, path string"), "lattices")
    return state.select("tab", "raw", "path")


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["tab", "row_key"]].assign(items=[P.apply_path(r, p) for r, p in zip(pdf["raw"], pdf["path"])])


#: A field that is one candidate with a digit, blanks and such around it: no delimiter, quote or bracket within.
_INNER = "".join("\\" + c for c in P.SEPARATORS + P.MARKS + P.BRACKETS) + r"\s" + P.BLANKS
_ONE = rf"^[{_INNER}]*([^{_INNER}]*[^{_INNER}\-–—][^{_INNER}]*)[{_INNER}]*$"


def unpack(rows: DataFrame, rounds: int = ROUNDS, digit: bool = True, sure: float = SURE) -> DataFrame:
    """``(tab, row_key, pos, item)`` of ``rows(tab string, row_key bigint, raw string)``.

    ``tab`` tells columns apart that are unpacked together; each has its own frequencies. With
    ``sure`` above 1 values' frequencies decide every field that has a choice."""
    rows = rows.where("raw is not null").select("tab", "row_key", "raw")
    decided, model = shape_paths(rows, rounds, digit, sure)
    decided = cut(decided.withColumn("key", _digest("shape")).drop("shape"), "paths")
    one = F.regexp_extract("raw", _ONE, 1)
    alone = (one != "") & one.rlike(r"\p{N}")
    single = rows.where(alone).select("tab", "row_key", F.array(one).alias("items"))
    several = rows.where(~alone).withColumn("shape", shape_of(F.col("raw")))
    # a row for each different shape; where Spark does not broadcast it, adaptive execution splits a shape that many rows have
    several = several.withColumn("key", _digest("shape")).join(decided, ["tab", "key"])
    schema = "tab string, row_key long, items array<string>"
    take = lambda df: df.select("tab", "row_key", "raw", "path").where("path rlike '[vq]'").mapInPandas(_values, schema)
    parts = [single, take(several.where("sure"))]
    if not decided.where("not sure").isEmpty():
        certain = single.unionByName(parts[1]).select("tab", F.explode("items").alias("value"))
        open_rows = several.where("not sure").select("tab", "row_key", "raw", "shape")
        paths = value_paths(open_rows.drop("row_key"), certain, model, rounds, digit)
        parts.append(take(open_rows.join(paths, ["tab", "raw"])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("tab", "row_key", F.posexplode("items").alias("pos", "item")).select("tab", "row_key", (F.col("pos") + 1).cast("int").alias("pos"), "item")
