"""Models behind small interfaces, with deterministic stand-ins.

A model is built once in each Python worker by a factory that is sent to the tasks. Real
models (a transformer, an inference engine) implement the same methods; devices and number
types are theirs to choose, and Spark's resource profiles place them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np

from annotary.functions.tokens import words


class PairScorer(Protocol):
    """Relevance of each label to each text."""

    def fit(self, labels: Sequence[str]) -> None:
        """Take the block of labels that the next texts are scored against."""

    def score(self, texts: Sequence[str]) -> np.ndarray:
        """Scores with a row for each text and a column for each label."""


class TextClassifier(Protocol):
    def logits(self, texts: Sequence[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompts: Sequence[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


Factory = Callable[[], object]


class ContainmentScorer:
    """Share of a label's different words that the text holds. Labels' words are an inverted index."""

    def fit(self, labels: Sequence[str]) -> None:
        sets = [set(words(x)) for x in labels]
        self.sizes = np.maximum(1, np.array([len(s) for s in sets]))
        lists: dict[str, list[int]] = {}
        for i, s in enumerate(sets):
            for w in s:
                lists.setdefault(w, []).append(i)
        self.where = {w: np.array(v) for w, v in lists.items()}

    def score(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.sizes)))
        for row, text in zip(out, texts):
            hit = [self.where[w] for w in set(words(text)) if w in self.where]
            if hit:
                row += np.bincount(np.concatenate(hit), minlength=len(row))
        return out / self.sizes


class RuleClassifier:
    """Two classes by how many of some words a text has; ties go to the first class."""

    def __init__(self, marks: Sequence[str] = ("variant", "mutation", "gene", "syndrome", "exon", "allele"), tokens: int = 512):
        self.marks, self.tokens = set(marks), tokens

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        hits = np.array([sum(w in self.marks for w in words(t)[: self.tokens]) for t in texts], float)
        return np.stack([np.ones(len(hits)), hits], axis=1)


class FirstCandidate:
    """Answers with the identifier at the head of the first candidate line of a prompt.

    The answer is the same at every temperature; ``max_tokens`` bounds its words."""

    def __init__(self, temperature: float = 0.0, top_p: float = 1.0, max_tokens: int = 2048):
        self.temperature, self.top_p, self.max_tokens = temperature, top_p, max_tokens

    def generate(self, prompts: Sequence[str]) -> list[str]:
        out = []
        for p in prompts:
            line = next((x for x in p.split("\n") if x.startswith("1) ")), "")
            text = f"Looked at the candidates.\nANSWER: {line[3:].split(' - ')[0].strip() or 'NO MATCH'}"
            ends = [m.end() for m in re.finditer(r"\S+", text)]
            out.append(text if len(ends) <= self.max_tokens else text[: ends[self.max_tokens - 1] if self.max_tokens > 0 else 0])
        return out


class HashEmbedder:
    """Sums of word vectors drawn from the words' hashes."""

    def __init__(self, size: int = 64):
        self.size = size

    def _vector(self, w: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        return np.random.Generator(np.random.PCG64(seed)).standard_normal(self.size)

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return np.stack([sum((self._vector(w) for w in words(t)), np.zeros(self.size)) for t in texts]) if len(texts) else np.zeros((0, self.size))
