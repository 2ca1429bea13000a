"""A public tokenizer over Arrow batches: token ids, truncated as a model truncates them, and padded by batch."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Setting of the session that names the vocabulary file, and where it is otherwise.
SETTING, VOCABULARY = "spark.annotary.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is cut before merges, as that vocabulary's makers publish it (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(spark: SparkSession, path: str | None = None) -> bytes:
    """The vocabulary file named by ``path`` or the session; about 1 MB, read here and sent to the tasks."""
    with open(path or spark.conf.get(SETTING, VOCABULARY), "rb") as f:
        return f.read()


@lru_cache(4)
def coder(vocabulary: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_ids(text: Column, vocabulary: bytes, most: int = 512) -> Column:
    """The first ``most`` token ids of a text; truncation is the model's limit. Null counts as empty."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(vocabulary)
        for s in batches:
            yield pd.Series([c.encode_ordinary(t)[:most] if t else [] for t in s], dtype=object)

    return run(text)


def padded_batches(lists: list[list[int]], size: int = 32, multiple: int = 8, filler: int = 0) -> Iterator[list[list[int]]]:
    """Batches of ``size`` lists, those of one batch filled up to the next ``multiple`` of its longest."""
    for at in range(0, len(lists), size):
        batch = lists[at : at + size]
        width = -(-max(map(len, batch)) // multiple) * multiple
        yield [[*x, *[filler] * (width - len(x))] for x in batch]
