"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.operators.ranking import running_total
from weftline.session import cut, small_rows

#: Tokens of a block.
BLOCK = 512
#: Output slots, a block each, of a shard.
SLOTS = 4096
#: Above so many slots counts are drawn from the normal limit of their distribution.
_EXACT = 10**9


def permute(index: Column, size: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..size-1, another one for each key: a Feistel network, walked until it falls below size."""

    @F.pandas_udf("long")
    def walk(i: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        x, n = i.to_numpy(np.uint64), n.to_numpy(np.uint64)
        seed = k.to_numpy(np.int64).view(np.uint64)
        half = np.ceil(np.ceil(np.log2(np.maximum(n.astype(float), 2))) / 2).astype(np.uint64)
        mask = (np.uint64(1) << half) - np.uint64(1)
        open_ = np.ones(len(x), bool)
        with np.errstate(over="ignore"):
            while open_.any():
                left, right, s, m = x[open_] >> half[open_], x[open_] & mask[open_], seed[open_], mask[open_]
                for r in range(4):
                    h = (right + s + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(29)
                    h *= np.uint64(0x94D049BB133111EB)
                    h ^= h >> np.uint64(32)
                    left, right = right, left ^ (h & m)
                x[open_] = (left << half[open_]) | right
                open_ &= x >= n
        return pd.Series(x.astype(np.int64))

    return walk(index, size, key)


def _draw(rng: np.random.Generator, held: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` slots, drawn from ``held`` slots of each source without putting back, are each source's."""
    out, left, rest = np.zeros(len(held), np.int64), int(held.sum()), n
    for i, k in enumerate(held.tolist()):
        low, high = max(0, rest - (left - k)), min(k, rest)
        if low == high:
            x = low
        elif left < _EXACT:
            x = int(rng.hypergeometric(k, left - k, rest))
        else:
            p = k / left
            x = round(rng.normal(rest * p, np.sqrt(max(rest * p * (1 - p) * (left - rest) / (left - 1), 0.0))))
        out[i] = x = min(max(x, low), high)
        left, rest = left - k, rest - x
    return out


def shard_counts(totals: np.ndarray, shards: int, per_shard: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before the shard, slots of each in it).

    The counts of all shards are a multinomial draw given that every source gets its total. They come from halving the shards: each
    half's counts are drawn with a seed of the halving's own, so that any shard finds its counts alone, in as many draws as it takes to
    halve down to it.
    """
    low, high, before, held = 0, shards, np.zeros(len(totals), np.int64), totals.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = _draw(np.random.default_rng([seed, low, high]), held, min((middle - low) * per_shard, int(held.sum())))
        if shard < middle:
            high, held = middle, left
        else:
            low, before, held = middle, before + left, held - left
    return before, held


class Mix:
    """Documents of several sources, combined so that each has its target share of all tokens.

    Per source the documents' tokens, one document after the other in hash order, are packed into blocks of ``block`` tokens (the
    source's last one may be shorter); a document that crosses an edge lies in both blocks. The mixture is a row of slots, a block
    each, in shards of ``per_shard`` slots. The sources' counts are drawn for each shard, as a multinomial given that every source
    gets the blocks of its share. The j-th slot of a source takes the block at place ``j`` modulo their number in the source's own
    pseudorandom permutation: every block once before any is taken twice. Slots and blocks are joined by that index.

    ``total``: tokens of the mixture; None for as many as the documents of the named sources have. A source that can't reach its
    share within ``max_repeats`` gives all it may; one without documents gives nothing; sources not named, with a null or
    non-positive share or repeats, and documents with a null key, source or text, or without tokens, take no part. Of a source that is
    named twice the greatest share and repeats count. Repeated documents count as documents of their own.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 7, folder: str = tokens.TOKENIZERS, vocabulary: str = tokens.VOCABULARY):
        self.spark, self.seed, self.block = documents.sparkSession, seed, block
        named = small_rows(targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")))
        self.targets = {r["source"]: (r["share"], r["repeats"]) for r in sorted(named)}
        names = self.spark.createDataFrame([(s,) for s in self.targets] or [(None,)], "source string")
        docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").join(F.broadcast(names), "source")
        docs = docs.select("doc_id", "source", tokens.n_tokens(F.col("text"), folder, vocabulary).alias("n_tokens")).where("n_tokens > 0")
        docs = cut(docs.withColumn("hash", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.shiftright("hash", 50)))
        self.docs = cut(running_total(docs, ["source"], "bucket", ["hash", "doc_id"], "n_tokens", "start").select("doc_id", "source", "n_tokens", "start"))
        self.sizes = {r["source"]: int(r["tokens"]) for r in small_rows(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))}
        self.total = sum(self.sizes.values()) if total is None else total
        #: source -> (its blocks, slots it gets)
        self.plan: dict[str, tuple[int, int]] = {}
        for source in sorted(self.sizes):
            share, repeats = self.targets[source]
            blocks = -(-self.sizes[source] // block)
            self.plan[source] = blocks, min(round(share * self.total * blocks / self.sizes[source]), repeats * blocks)

    def _numbers(self) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(i, s, n) for i, (s, (n, _)) in enumerate(self.plan.items())] or [(None, None, 0)], "owner int, source string, blocks long"))

    def slots(self, per_shard: int = SLOTS) -> DataFrame:
        """``shard, slot, source, index``: the mixture, slot by slot, with the permuted index of its block. A row of numbers for each
        block used; no row of it is made on the driver."""
        totals, blocks = (np.array([p[k] for p in self.plan.values()], np.int64) for k in (1, 0))
        shards, seed = int(-(-int(totals.sum()) // per_shard)), self.seed

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard in batch["id"]:
                    before, counts = shard_counts(totals, shards, per_shard, int(shard), seed)
                    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                    j = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + before[owner]
                    slot = np.random.default_rng([seed, 1, int(shard)]).permutation(len(owner))
                    yield pd.DataFrame({"shard": int(shard), "slot": slot, "owner": owner, "index": j % blocks[owner]})

        made = self.spark.range(shards).mapInPandas(fill, "shard long, slot long, owner int, index long")
        return made.join(self._numbers(), "owner").select("shard", "slot", "source", "index")

    def blocks(self) -> DataFrame:
        """``source, block, index, doc_id, start, n_tokens, tokens``: the documents' parts, ``tokens`` long, in every block."""
        first, last = F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("n_tokens") - 1) / self.block)
        parts = self.docs.withColumn("block", F.explode(F.sequence(first, last)))
        inside = F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * self.block) - F.greatest(F.col("start"), F.col("block") * self.block)
        return parts.join(self._numbers(), "source").select("source", "block", permute(F.col("block"), F.col("blocks"), F.xxhash64("source", F.lit(self.seed))).alias("index"), "doc_id", "start", "n_tokens", inside.alias("tokens"))

    def chosen(self) -> DataFrame:
        """``doc_id, source, n_tokens, times_used, tokens_used``: the documents of the mixture. ``times_used``: how often a document is
        used, in whole or in part; ``tokens_used``: its tokens in the mixture."""
        uses = self.slots().groupBy("source", "index").agg(F.count("*").alias("uses"))
        used = self.blocks().join(uses, ["source", "index"]).groupBy("source", "start", "doc_id", "n_tokens")
        return used.agg(F.max("uses").alias("times_used"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used")).drop("start").select("doc_id", "source", "n_tokens", "times_used", "tokens_used")

    def shares(self, chosen: DataFrame) -> DataFrame:
        """``source, target_share, actual_share, tokens, documents, max_used, max_repeats, reached``: a row for every named source."""
        held = F.broadcast(self.spark.createDataFrame([(s, *t) for s, t in self.targets.items()] or [(None, 0.0, 0)], "source string, target_share double, max_repeats int"))
        used = chosen.groupBy("source").agg(F.sum("tokens_used").alias("tokens"), F.count("*").alias("documents"), F.max("times_used").alias("max_used"))
        all_ = held.where("source is not null").join(used, "source", "left").fillna(0, ["tokens", "documents", "max_used"])
        every = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per source
        shares = all_.withColumn("actual_share", F.when(every > 0, F.col("tokens") / every).otherwise(0.0))
        return shares.select("source", "target_share", "actual_share", "tokens", "documents", "max_used", "max_repeats", (F.col("tokens") >= F.floor(F.col("target_share") * self.total * 0.99)).alias("reached"))
