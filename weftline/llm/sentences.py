"""Sentence units of every document."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import dictionary, segment


@functools.lru_cache(maxsize=2)
def _made(words: tuple[str, ...]) -> segment.Words:
    return segment.Words(words)


def _lexicon(held: Broadcast) -> segment.Words:
    """The dictionary, made once in each worker."""
    return _made(tuple(held.value))


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text", words: Iterable[str] | None = None) -> DataFrame:
    """``key, start_pos, end_pos``: one row per unit, positions in code points, end exclusive.

    Every non-blank character of a text is in exactly one unit. Documents with a null key, or a null or blank text, have none;
    repeated documents repeat their units. Needs no shuffle: documents stay in their partitions, whole, whatever their length; rows
    go out in blocks, so that a long text takes no more memory than its own size. ``words``: the dictionary of scripts without spaces
    (default: the Thai one of the Java runtime), broadcast once; its size doesn't grow with the documents. Where the default can't be
    read this raises, as Thai would be cut otherwise without a sign of it; an empty ``words`` does without a dictionary.
    """
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(sorted(dictionary.thai(spark) if words is None else words))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = _lexicon(held)
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, t in zip(batch["_key"], batch["_text"]):
                for s, e in segment.units(t, words_of):
                    keys.append(k)
                    starts.append(s)
                    ends.append(e)
                if len(keys) > 50_000:
                    yield pd.DataFrame({key: keys, "start_pos": starts, "end_pos": ends})
                    keys, starts, ends = [], [], []
            if keys:
                yield pd.DataFrame({key: keys, "start_pos": starts, "end_pos": ends})

    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInPandas(cut, f"`{key}` {kind}, start_pos long, end_pos long")


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start_pos, end_pos, sentence``: the units with their text; needs unique keys."""
    found = sentence_units(documents, key, text).join(documents.select(key, F.col(text).alias("_text")), key)
    return found.select(key, "start_pos", "end_pos", F.expr("substring(_text, start_pos + 1, end_pos - start_pos)").alias("sentence"))
