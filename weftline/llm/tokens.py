"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the tokenizers' vocabulary files; a parameter of every operator that counts tokens.
TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary splits a text before merging. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text is tokenised in pieces of about this many characters, so that memory stays bounded for very long texts.
PIECE = 100_000


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer, loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _seam(text: str, at: int) -> int:
    """A place near ``at`` where no token crosses over: a blank after something else, with which the pattern always begins anew."""
    for place in (text.rfind(" ", 1, at), text.find(" ", at)):
        while 0 < place and text[place - 1].isspace():
            place = text.rfind(" ", 1, place) if place < at else text.find(" ", place + 1)
        if place > 0:
            return place
    return len(text)


def count(text: str | None, path: str) -> int:
    """Tokens of a text, as many as in one piece; 0 for null and empty."""
    total = 0
    while text and len(text) > PIECE:
        place = _seam(text, PIECE)
        total += len(encoding(path).encode_ordinary(text[:place]))
        text = text[place:]
    return total + len(encoding(path).encode_ordinary(text)) if text else total


def n_tokens(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text column (0 for null), by Arrow batches; the vocabulary file must be at the same place on every machine."""
    path = os.path.join(folder, vocabulary)

    @F.pandas_udf("int")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([count(None if x is None or x != x else x, path) for x in batch], dtype="int32")

    return size(text)
