"""Passages of held-out evaluation items inside corpus documents.

All items' word sequences are put into one generalised suffix automaton: each of its
states stands for the passages that end at the same places of the items. A document's words
are streamed through it once; at each word the automaton knows the longest passage of any
item that ends there. Where it has ``LEAST`` words or more, the items that hold it are read
off the state and its suffix links.

The items are the stated query set. They reach the tasks in blocks of at most ``BLOCK_WORDS``
words (or one longer item), each block its own automaton, and at most ``BLOCKS_A_PASS`` of them
in one pass over the documents, so what a task holds is bounded whatever their number. Nothing
is shuffled. Cleaning takes the spans where they are found: a text is never joined with them.

Defined cases: null and empty documents hold no passage, items shorter than ``LEAST`` words
are in no document, null items and null item ids are left out, equal items are found alike.
A document of any length is streamed word by word. An empty table on either side gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.functions.tokens import WORD, words
from annotary.runtime import spread

#: Consecutive words that make a leak, words of items in one automaton, and automata in one pass.
LEAST, BLOCK_WORDS, BLOCKS_A_PASS = 12, 100_000, 4


class Automaton:
    """Generalised suffix automaton over items' words. ``ends[s]`` are the items below state ``s``."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int = LEAST):
        self.least = least
        self.code: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        tails: list[tuple[int, list[int]]] = []
        for item, tokens in items:
            coded = [self.code.setdefault(w, len(self.code)) for w in tokens]
            last = 0
            for c in coded:
                last = self._extend(last, c)
            tails.append((item, coded))
        self.ends: list[tuple[int, ...]] = [()] * len(self.next)
        held: dict[int, list[int]] = {}
        for item, coded in tails:
            seen: set[int] = set()
            s = 0
            for c in coded:
                s = self.next[s][c]
                u = s
                while u > 0 and self.length[u] >= least and u not in seen:
                    seen.add(u)
                    held.setdefault(u, []).append(item)
                    u = self.link[u]
        for s, found in held.items():
            self.ends[s] = tuple(dict.fromkeys(found))

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state reached from ``p`` by ``c``, holding nothing longer than ``length[p] + 1``."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        cur = self._new(self.length[last] + 1, {}, -1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        self.link[cur] = 0 if p < 0 else self._split(p, c)
        return cur

    def scan(self, tokens: list[str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """Longest passage of each item found, and the covered word spans [from, to)."""
        code, moves, link, length, least = self.code, self.next, self.link, self.length, self.least
        found: dict[int, int] = {}
        spans: list[tuple[int, int]] = []
        s = n = 0
        for i, w in enumerate(tokens):
            c = code.get(w)
            if c is None:
                s = n = 0
                continue
            while s and c not in moves[s]:
                s = link[s]
                n = length[s]
            if c in moves[s]:
                s = moves[s][c]
                n += 1
            if n >= least:
                u, m = s, n
                while u > 0 and m >= least:
                    for item in self.ends[u]:
                        if found.get(item, 0) < m:
                            found[item] = m
                    u = link[u]
                    m = length[u]
                at = i + 1 - n
                if spans and at <= spans[-1][1]:
                    spans[-1] = (min(at, spans[-1][0]), i + 1)
                else:
                    spans.append((at, i + 1))
        return found, spans


def _found(automata, tokens: list[str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    items: dict[int, int] = {}
    spans: list[tuple[int, int]] = []
    for a in automata:
        some, at = a.value.scan(tokens)
        for i, n in some.items():
            items[i] = max(n, items.get(i, 0))
        spans += at
    return items, spans


def _scanner(automata):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                tokens = words(text)
                found, spans = _found(automata, tokens)
                if found:
                    rows.append((key, [{"item_id": i, "longest": n} for i, n in found.items()], [{"at": a, "to": b} for a, b in spans], len(tokens)))
            yield pd.DataFrame(rows, columns=["id", "items", "spans", "words"])

    return run


def passes(items: DataFrame, least: int = LEAST, block_words: int = BLOCK_WORDS) -> list[list]:
    """Broadcast automata of all items, in groups for one pass each."""
    sc = items.sparkSession.sparkContext
    done: list[list] = [[]]
    block: list[tuple[int, list[str]]] = []

    def close() -> None:
        if len(done[-1]) == BLOCKS_A_PASS:
            done.append([])
        done[-1].append(sc.broadcast(Automaton(block, least)))

    size = 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        tokens = words(r["text"])
        if len(tokens) < least:
            continue
        if size and size + len(tokens) > block_words:
            close()
            block, size = [], 0
        block.append((r["item_id"], tokens))
        size += len(tokens)
    close()
    return done


def scan(docs: DataFrame, items: DataFrame, least: int = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(id, items, spans, words)`` of each of ``docs(id, text)`` that holds a passage of ``items(item_id, text)``.

    ``items`` lists the items with their longest passage, ``spans`` the covered words. With items for
    several passes a document can have a row for each."""
    rows = spread(docs.where("id is not null and text is not null").select("id", "text"))
    schema = "id long, items array<struct<item_id:long,longest:int>>, spans array<struct<at:int,to:int>>, words int"
    return reduce(DataFrame.unionByName, [rows.mapInPandas(_scanner(p), schema) for p in passes(items, least, block_words)])


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(id, item_id, longest)``: each document and item that share ``least`` or more consecutive words."""
    return scan(docs, items, least, block_words).select("id", F.inline("items"))


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _places(text: str) -> list[tuple[int, int]]:
    """Where the words of the lower-cased text stand in the text; few letters are longer in lower case."""
    low = text.lower()
    found = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return found
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[a], origin[b - 1] + 1) for a, b in found]


def _marker(automata):
    """Adds the spans of one pass to those of the passes before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_found(automata, words(t))[1] if t else [] for t in pdf["text"]]
            yield pdf.assign(spans=[[*map(dict, had), *({"at": a, "to": b} for a, b in new)] for had, new in zip(pdf["spans"], found)])

    return run


def _cleaner(automata, longest: int, coverage: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            before = pdf["spans"] if "spans" in pdf else [()] * len(pdf)
            for key, text, had in zip(pdf["id"], pdf["text"], before):
                spans = _found(automata, words(text))[1] if text else []
                merged = _joined([*spans, *((x["at"], x["to"]) for x in had)])
                if not merged:
                    rows.append((key, text, 0, 0.0, False))
                    continue
                places = _places(text)
                share = sum(b - a for a, b in merged) / max(1, len(places))
                long = [(a, b) for a, b in merged if b - a > longest]
                kept, at = [], 0
                for a, b in long:
                    kept.append(text[at : places[a][0]])
                    at = places[b - 1][1]
                rows.append((key, "".join([*kept, text[at:]]), len(long), share, share > coverage))
            yield pd.DataFrame(rows, columns=["id", "text", "removed", "coverage", "dropped"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, longest: int = 24, coverage: float = 0.5, least: int = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document of ``docs(id, text)``: spans of more than ``longest`` words cut out of ``text``.

    ``removed`` counts them, ``coverage`` is the leaked share of the words, and ``dropped``
    tells that it exceeds the limit. Row by row: ids may repeat or be null."""
    *first, last = passes(items, least, block_words)
    rows = spread(docs.select("id", "text"))
    if first:
        rows = rows.withColumn("spans", F.array().cast("array<struct<at:int,to:int>>"))
    for automata in first:
        rows = rows.mapInPandas(_marker(automata), "id long, text string, spans array<struct<at:int,to:int>>")
    return rows.mapInPandas(_cleaner(last, longest, coverage), "id long, text string, removed int, coverage double, dropped boolean")
