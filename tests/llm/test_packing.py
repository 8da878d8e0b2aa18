"""Texts in containers: differencing and the operator."""

import random

import numpy as np
from weftline.llm import differencing, packing, tokens


def plain(sizes, k):
    """Multiway differencing with full rows, one merge at a time."""
    rows = [[s] + [0] * (k - 1) for s in sorted(sizes, reverse=True)]
    while len(rows) > 1:
        rows.sort(key=lambda r: r[-1] - r[0])
        a, b = rows.pop(0), rows.pop(0)
        rows.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return rows[0]


def test_partition_like_plain_differencing():
    rng = random.Random(8)
    for k in (1, 2, 3, 7, 20):
        for n in (1, 2, 5, 30, 60):
            sizes = np.array(rng.sample(range(1, 10_000), n))  # distinct, so that few imbalances are equal
            window, sums = differencing.partition(sizes, k)
            assert sorted(np.bincount(window, sizes, k).astype(int).tolist()) == sorted(sums.tolist())
            assert sums.sum() == sizes.sum() and len(sums) == k
            if n <= 5:
                assert sorted(sums.tolist()) == sorted(plain(sizes.tolist(), k))


def test_two_way_known_case():
    _, sums = differencing.partition(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums.tolist()) == [14, 16]


def test_pack_never_exceeds_and_wastes_little():
    rng = np.random.default_rng(9)
    for capacity in (100, 1000):
        sizes = rng.integers(1, capacity // 2, 800)
        window = differencing.pack(sizes, capacity)
        used = np.bincount(window, sizes)
        assert used.max() <= capacity and (used > 0).all()
        assert len(used) <= 1.05 * sizes.sum() / capacity + 1
    assert differencing.pack(np.full(10, 51), 100).max() == 9
    assert differencing.pack(np.array([100]), 100).tolist() == [0]


def test_tokens():
    path = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
    assert tokens.count(None, path) == tokens.count("", path) == 0
    assert tokens.count("Hello world", path) == 2 and tokens.count("<|endoftext|>", path) > 1
    assert abs(tokens.count("word " * 50_000, path) - 50_000) < 10


def test_long_texts_have_the_tokens_of_one_piece():
    rng, path = random.Random(3), f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
    whole = lambda t: len(tokens.encoding(path).encode_ordinary(t))
    mixed = "".join(rng.choice(["word", " word", "  ", " ", "\n", "'s", "1234", "สวัสดี", "。", "...", "don't "]) for _ in range(120_000))
    for text in (mixed, "x" * 250_000, " " * 250_000, "ab " * 100_000, "ก" * 150_000, " " + "y" * 150_000 + "  z"):
        assert tokens.count(text, path) == whole(text)


def test_containers(spark):
    texts = ["word " * n for n in (3, 300, 60, 60, 500, 1, 700, 256)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(100, None, "x", 1), (101, "", "x", 1), (None, "word", "x", 1), (0, texts[0], "x", 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, shard string, capacity int")
    kinds = spark.createDataFrame([("small", 256), ("large", 2048), (None, 5), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    got = packing.fill_containers(documents, kinds).collect()
    path = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
    for kind, capacity in (("small", 256), ("large", 2048)):
        mine = [r for r in got if r["container_kind"] == kind]
        boxes = {}
        for r in mine:
            boxes.setdefault(r["container_id"], []).append((r["place"], r["token_to"] - r["token_from"]))
        for pieces in boxes.values():
            pieces.sort()
            assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(pieces[-1]) <= capacity
        for i, t in enumerate(texts):
            n, spans = tokens.count(t, path), sorted((r["token_from"], r["token_to"]) for r in mine if r["doc_id"] == i)
            copies = 2 if i == 0 else 1
            assert sum(b - a for a, b in spans) == n * copies
            assert len(spans) == -(-n // capacity) * copies
            assert all(b - a == capacity for a, b in spans[:-1]) or copies == 2
    assert {r["container_kind"] for r in got} == {"small", "large"}
    assert packing.fill_containers(documents.limit(0), kinds).count() == 0
