"""Reading one packed field: the lattice of its possible values.

Every run of delimiter characters may separate values or belong to one. The pieces between
them are atoms; a candidate value is a run of atoms with the text between them. A closed
quoted span is one candidate as a whole, and its inside is a lattice of its own. What is
likely is learned from the whole column (``annotary.operators.packed``).

Nothing here depends on letters or digits themselves, only on delimiters, quotes and whether
a piece holds a digit, so a field and its shape (``SHAPE``) have the same lattice.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

#: Opening quotes and what closes each.
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’", "„": "“", "«": "»"}
MARKS = "".join(sorted({*QUOTES, *QUOTES.values()}))
BRACKETS = "[](){}<>"
#: Characters that may separate values; blanks may too.
SEPARATORS = ";,|/&"
BLANKS = " \t\r\n\f\v   ﻿"
_DELIMITER = re.compile(rf"[{SEPARATORS}\s]+")
_ENDS = re.compile(r"[\s\]\)\}>]*(?:$|[;,|/&\s\]\)\}>])")
_EDGE = MARKS + BRACKETS + BLANKS
#: Java patterns that turn a field into its shape, in order: runs of digits, lower-case, upper-case and other letters.
SHAPE = [(r"\p{N}+", "9"), (r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"[\p{L}&&[^aA]]+", "o")]

#: Most atoms of a candidate outside quotes; a quoted span is a candidate whatever its length.
MOST_ATOMS = 4
#: Share of the probability that values' frequencies leave to their shapes, and shapes' to their prior.
REST = 0.01
#: Pseudo-count of the shapes' prior, 4 ** -length, where a delimiter in bare text counts as three characters.
PRIOR = 100.0
#: Probability that a value is followed by one more.
MORE = 0.5
#: Size of the table of shape frequencies: shapes are hashed into it, so it has one size for every column.
BUCKETS = 1 << 16

#: Kinds of candidates: no value (bare text without identifier shape), a value, a quoted span taken whole.
FILLER, VALUE, WHOLE = "f", "v", "q"


class Edge(NamedTuple):
    """Atoms ``[at, to)`` read as one candidate of a kind; ``shape`` is its key among shapes."""

    at: int
    to: int
    kind: str
    shape: str


class Field(NamedTuple):
    """Start, end and region of each atom, and for each quoted span: its first atom, the one after its last, its text."""

    text: str
    atoms: list[tuple[int, int, int]]
    spans: list[tuple[int, int, str]]

    def value(self, e: Edge) -> str:
        if e.kind == WHOLE:
            return next(t for a, b, t in self.spans if (a, b) == (e.at, e.to))
        return self.text[self.atoms[e.at][0] : self.atoms[e.to - 1][1]]


def _close(s: str, i: int) -> int:
    """Index of the quote that closes the one at ``i``, or -1."""
    end = QUOTES[s[i]]
    j = i + 1
    while (j := s.find(end, j)) >= 0:
        if end == '"' and s[j + 1 : j + 2] == '"':
            j += 2
            continue
        if _ENDS.match(s, j + 1):
            return j
        j += 1
    return -1


def read(s: str) -> Field:
    """The atoms and quoted spans of a field. A quote that never closes is an edge character."""
    atoms: list[tuple[int, int, int]] = []
    spans: list[tuple[int, int, str]] = []
    region = 0

    def take(a: int, b: int) -> None:
        at = a
        for m in [*_DELIMITER.finditer(s, a, b), None]:
            end = m.start() if m else b
            piece = s[at:end]
            left = at + len(piece) - len(piece.lstrip(_EDGE))
            piece = piece.strip(_EDGE)
            if piece.strip("-–—"):
                atoms.append((left, left + len(piece), region))
            at = m.end() if m else b

    i, begin, fresh = 0, 0, True
    while i < len(s):
        c = s[i]
        if fresh and c in QUOTES and (j := _close(s, i)) > i:
            take(begin, i)
            region += 1
            first = len(atoms)
            take(i + 1, j)
            if len(atoms) > first:
                inner = s[i + 1 : j].strip(BLANKS) if len(atoms) > first + 1 else s[atoms[first][0] : atoms[first][1]]
                spans.append((first, len(atoms), inner.replace('""', '"') if c == '"' else inner))
            region += 1
            i = begin = j + 1
            continue
        fresh = c.isspace() or c in SEPARATORS or c in BRACKETS
        i += 1
    take(begin, len(s))
    return Field(s, atoms, spans)


def shape(value: str) -> str:
    """Of a candidate in a field's shape; a run of lower-case words is ``a_``."""
    return re.sub(r"a(?:[ -]a)+", "a_", re.sub(r"\s+", " ", value))


def edges(f: Field, shapes: Field, digit: bool = True) -> list[Edge]:
    """All candidates of a field, by where they begin. With ``digit`` bare text without a digit is no value."""
    out: list[Edge] = []
    whole = {a: (b, t) for a, b, t in shapes.spans}
    for i, (start, _, region) in enumerate(shapes.atoms):
        if i in whole:
            b, text = whole[i]
            out.append(Edge(i, b, WHOLE, '"' + shape(text)))
            if b == i + 1:
                continue
        for j in range(i + 1, min(i + MOST_ATOMS, len(shapes.atoms)) + 1):
            if shapes.atoms[j - 1][2] != region:
                break
            if i in whole and j == whole[i][0] <= i + MOST_ATOMS:
                continue  # all of a span is the span
            text = shapes.text[start : shapes.atoms[j - 1][1]]
            bare = digit and region % 2 == 0 and "9" not in text
            out.append(Edge(i, j, FILLER, "~" + shape(text)) if bare else Edge(i, j, VALUE, shape(text)))
    return out


def bucket(shape_key: str) -> int:
    return zlib.crc32(shape_key.encode()) % BUCKETS


def shape_log_p(counts, total: float) -> Callable[[str], float]:
    """Log probability of a shape from counts by bucket; the prior alone where nothing is known."""

    @lru_cache(100_000)
    def p(key: str) -> float:
        size = len(key.lstrip('"~')) + (0 if key[:1] == '"' else 2 * len(_DELIMITER.findall(key)))
        prior = 4.0 ** -min(size, 500)
        if not total:
            return math.log(prior)
        return math.log((1 - REST) * (counts[bucket(key)] + PRIOR * prior) / (total + PRIOR) + REST * prior)

    return p


def _plus(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def posteriors(n: int, es: list[Edge], log_p: list[float]) -> tuple[list[float], list[int]]:
    """Of each edge of a lattice over ``n`` atoms the probability that it is on the path, and the most probable path.

    Forward-backward and Viterbi; equally probable paths give the one with the longer first candidate."""
    more = math.log(MORE)
    ahead, best, back = [0.0] + [-math.inf] * n, [0.0] + [-math.inf] * n, [-1] * (n + 1)
    for k, e in enumerate(es):
        step = log_p[k] + more
        ahead[e.to] = _plus(ahead[e.to], ahead[e.at] + step)
        if best[e.at] + step > best[e.to] + 1e-12:
            best[e.to], back[e.to] = best[e.at] + step, k
    behind = [-math.inf] * n + [0.0]
    for k in range(len(es) - 1, -1, -1):
        e = es[k]
        behind[e.at] = _plus(behind[e.at], behind[e.to] + log_p[k] + more)
    post = [math.exp(min(0.0, ahead[e.at] + log_p[k] + more + behind[e.to] - ahead[n])) for k, e in enumerate(es)]
    path, at = [], n
    while at > 0:
        path.append(back[at])
        at = es[back[at]].at
    return post, path[::-1]


def spell(es: list[Edge], path: list[int]) -> str:
    """A path as text: kind and number of atoms of each candidate."""
    return " ".join(f"{es[k].kind}{es[k].to - es[k].at}" for k in path)


@lru_cache(10_000)
def _steps(path: str) -> list[tuple[str, int]]:
    return [(x[0], int(x[1:])) for x in path.split()]


def apply_path(field: str, path: str) -> list[str]:
    """The values of a field on a path."""
    f = read(field)
    out, at = [], 0
    for kind, n in _steps(path):
        if kind != FILLER:
            out.append(f.value(Edge(at, at + n, kind, "")))
        at += n
    return out
