"""Sources mixed to target weights."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from weftline.llm import mixing


def documents(spark, sizes):
    rows, k = [], 0
    for source, (n, words) in sizes.items():
        for _ in range(n):
            k += 1
            rows.append((k, source, "word " * words, "clash", 1.0))
    rows += [(None, "a", "word", "x", 1.0), (9001, None, "word", "x", 1.0), (9002, "a", None, "x", 1.0), (9003, "a", "", "x", 1.0), (9004, "unnamed", "word", "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, bucket string, share double")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 17, 1000, 4097):
        got = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n), F.lit(5)).alias("p")).toPandas()["p"]
        assert sorted(got) == list(range(n))
    a, b = (spark.range(1000).select(mixing.permute(F.col("id"), F.lit(1000), F.lit(k)).alias("p")).toPandas()["p"].tolist() for k in (1, 2))
    assert a != b and a != sorted(a)


def test_shares_and_repeats(spark):
    docs = documents(spark, {"a": (300, 40), "b": (100, 60), "c": (5, 30), "d": (40, 500)})
    mix = mixing.Mix(docs, targets(spark, [("a", 0.4, 2), ("b", 0.3, 3), ("c", 0.1, 2), ("d", 0.15, 2), ("gone", 0.05, 2), (None, 0.1, 1), ("e", None, 1), ("f", 0.1, 0)]), block=64)
    chosen = mix.chosen().cache()
    rows = {r["source"]: r for r in mix.shares(chosen).collect()}
    assert set(rows) == {"a", "b", "c", "d", "gone"}
    for source, limit in (("a", 2), ("b", 3), ("c", 2), ("d", 2)):
        assert rows[source]["max_used"] <= limit
    assert rows["gone"]["tokens"] == 0 and not rows["gone"]["reached"]
    assert rows["c"]["tokens"] == 5 * 31 * 2 or rows["c"]["max_used"] == 2  # all it may give
    total = sum(r["tokens"] for r in rows.values())
    reachable = {s: 0.4 for s in "a"} | {"b": 0.3, "d": 0.15}
    for source, share in reachable.items():
        assert rows[source]["tokens"] == pytest.approx(share * mix.total, abs=64), source
    assert total > 0 and chosen.where("times_used < 1").count() == 0
    assert chosen.groupBy("doc_id").count().where("count > 1").count() == 0


def test_slots_draw_sources_evenly(spark):
    docs = documents(spark, {"a": (400, 30), "b": (400, 30)})
    mix = mixing.Mix(docs, targets(spark, [("a", 0.75, 5), ("b", 0.25, 5)]), block=31)
    counts = mix.slots(per_shard=100).groupBy("shard", "source").count().toPandas().pivot(index="shard", columns="source", values="count").fillna(0)
    full = counts[counts.sum(axis=1) == 100]
    assert len(full) >= 5 and abs(full["a"].mean() - 75) < 4 and 0 < full["a"].std() < 12
    assert counts.sum().to_dict() == {s: n for s, (_, n) in mix.plan.items()}
    # every block once before any is taken twice
    used = mix.slots(per_shard=100).groupBy("source", "index").count().toPandas()
    for source, (blocks, n) in mix.plan.items():
        mine = used[used["source"] == source]["count"]
        assert mine.max() == -(-n // blocks) and mine.sum() == n and (len(mine) == blocks or mine.max() == 1)


def test_shard_counts_add_up_and_spread_like_a_multinomial():
    totals = np.array([5000, 3000, 1500, 499, 0, 1])
    shards = 100
    got = [mixing.shard_counts(totals, shards, 100, k, 3) for k in range(shards)]
    counts = np.array([c for _, c in got])
    assert (counts.sum(axis=0) == totals).all() and (counts.sum(axis=1) == 100).all()
    assert all((b == counts[:k].sum(axis=0)).all() for k, (b, _) in enumerate(got))
    share = totals[0] / totals.sum()
    assert abs(counts[:, 0].var() / (100 * share * (1 - share)) - 1) < 0.5
    huge = np.array([7 * 10**11, 3 * 10**11])
    _, counts = mixing.shard_counts(huge, 10**8, 10**4, 12345, 3)
    assert counts.sum() == 10**4 and abs(counts[0] - 7000) < 300


def test_blocks_hold_all_tokens(spark):
    docs = documents(spark, {"a": (50, 40), "b": (3, 900)})
    mix = mixing.Mix(docs, targets(spark, [("a", 0.5, 2), ("b", 0.5, 2)]), block=64)
    rows = mix.blocks().groupBy("source", "block", "index").sum("tokens").toPandas()
    for source, (blocks, _) in mix.plan.items():
        mine = rows[rows["source"] == source].sort_values("block")
        assert sorted(mine["index"]) == list(range(blocks)) and (mine["sum(tokens)"][:-1] == 64).all() and mine["sum(tokens)"].sum() == mix.sizes[source]


def test_nothing_to_mix(spark):
    docs = documents(spark, {"a": (3, 5)})
    for d, t in ((docs.limit(0), [("a", 1.0, 1)]), (docs, [("zzz", 1.0, 1)])):
        mix = mixing.Mix(d, targets(spark, t))
        assert mix.chosen().count() == 0
        assert [r["tokens"] for r in mix.shares(mix.chosen()).collect()] == [0]
    empty = mixing.Mix(docs, targets(spark, []))
    assert empty.chosen().count() == 0 and empty.shares(empty.chosen()).count() == 0
