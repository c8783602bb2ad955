"""Token counts by a public byte-level BPE vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary lies on every machine; a parameter of all operators that size texts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's published pre-tokenisation pattern (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoder of a rank file, once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of one text; 0 for null and empty ones. Lone surrogates count as the replacement character."""
    if not text:
        return 0
    try:
        return len(encoder(path).encode_ordinary(text))
    except UnicodeEncodeError:
        return len(encoder(path).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8")))


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Column of token counts (0 for null)."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([count(t, path) for t in batch], dtype="int64")

    return run(text)
