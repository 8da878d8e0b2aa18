"""Filling fixed-capacity containers with texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import differencing, tokens
from weftline.session import cut, small_rows

#: Windows that a shard of items fills on average. More windows leave less room in each, and take longer to balance.
WINDOWS = 256

_PACKED = "container_kind string, container_id string, place int, doc_id long, piece int, token_from int, token_to int"


def _pack_shard(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    kind, shard = key
    items = items.sort_values(["doc_id", "piece"], ignore_index=True)
    sizes = items["size"].to_numpy(dtype=np.int64)
    window = differencing.pack(sizes, int(items["capacity"].iloc[0]))
    order = np.lexsort((np.arange(len(items)), -sizes, window))
    items, window, sizes = items.iloc[order], window[order], sizes[order]
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts = np.concatenate([[True], window[1:] != window[:-1]])
    place = before - np.maximum.accumulate(np.where(starts, before, 0))
    return pd.DataFrame(
        {
            "container_kind": kind,
            "container_id": [f"s{shard}-{w}" for w in window],
            "place": place.astype(np.int32),
            "doc_id": items["doc_id"].to_numpy(),
            "piece": items["piece"].to_numpy(),
            "token_from": items["token_from"].to_numpy(),
            "token_to": items["token_to"].to_numpy(),
        }
    )


def fill_containers(documents: DataFrame, capacities: DataFrame, windows: int = WINDOWS, folder: str = tokens.TOKENIZERS, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``container_kind, container_id, place, doc_id, piece, token_from, token_to``: every text, or piece of one, in a container of each kind.

    ``place`` is the token of the container at which the piece begins, ``token_from`` and ``token_to`` the text's tokens in it. A
    text is cut only if it alone exceeds the capacity, into pieces of the full capacity, each a container of its own, and a last one
    that is packed like any text. Texts are dealt into shards of about ``windows`` containers by a hash of their key; a shard's
    items are spread over its windows by multiway differencing, and the number of windows rises until none is too full.

    Texts without a token (null, empty), null keys, and kinds with a null name or a capacity that is null or not positive are left
    out; repeated documents are packed as often as they come; of a kind that comes twice the greatest capacity counts; other columns
    are ignored. ``capacities`` is a small reference table. The sizes are written to the checkpoint folder, so that texts are
    tokenised once for all kinds.
    """
    sized = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), tokens.n_tokens(F.col("text"), folder, vocabulary).alias("n"))
    sized = cut(sized.where("n > 0"))
    kinds = capacities.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    held = small_rows(kinds)
    all_kinds = sized.withColumn("kind", F.explode(F.array(*(F.struct(F.lit(r["container_kind"]).alias("container_kind"), F.lit(r["capacity"]).alias("capacity")) for r in held)))) if held else sized.limit(0).withColumn("kind", F.struct(F.lit("").alias("container_kind"), F.lit(1).alias("capacity")))
    all_kinds = all_kinds.select("doc_id", "n", "kind.*")
    whole = (F.col("n") / F.col("capacity")).cast("int")
    full = all_kinds.where("n >= capacity").select("container_kind", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    begin = F.col("piece") * F.col("capacity")
    full = full.select("container_kind", F.format_string("d%d-%d", "doc_id", "piece").alias("container_id"), F.lit(0).alias("place"), "doc_id", "piece", begin.alias("token_from"), (begin + F.col("capacity")).alias("token_to"))
    rest = all_kinds.where("n % capacity > 0").select("container_kind", "capacity", "doc_id", whole.alias("piece"), (whole * F.col("capacity")).alias("token_from"), F.col("n").alias("token_to"), (F.col("n") % F.col("capacity")).alias("size"))
    shards = rest.groupBy("container_kind").agg(F.greatest(F.lit(1), F.round(F.sum("size") / F.max("capacity") / windows)).cast("long").alias("shards"))
    dealt = rest.join(F.broadcast(shards), "container_kind").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.col("shards")))
    packed = dealt.groupBy("container_kind", "shard").applyInPandas(_pack_shard, _PACKED)
    return packed.unionByName(full)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``container_kind, containers, tokens, fill``: how full the containers of each kind are."""
    used = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    kinds = capacities.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    return used.join(kinds, "container_kind").select("container_kind", "containers", "tokens", F.round(F.col("tokens") / F.col("containers") / F.col("capacity"), 6).alias("fill"))
