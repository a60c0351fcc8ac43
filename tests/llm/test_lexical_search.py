"""Ranked search against scores of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from gradus.llm import lexical_search

DOCS = "doc_id bigint, text string, q int, row string, n int, score double"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical_search.TERM, lower)


def plain(docs, items, k):
    counts = [Counter(words(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    total, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        found = []
        for (doc_id, _), c, size in zip(docs, counts, n, strict=True):
            m = 100 - 50 + (50 * size * total) // max(1, length)
            s = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                found.append((-s, doc_id is None, doc_id or 0))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k, parts=3, **options):
    d = spark.createDataFrame([(*x, 1, "x", 2, 0.0) for x in docs], DOCS).repartition(parts)
    i = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, q int")
    got = lexical_search.search(d, i, k, **options)
    return sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture
def made():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(200)] + ["Été", "naïve", "日本", "a1", "X"]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=share / share.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(i, "w3 w150 été,copied") for i in range(300, 400)]  # copies, more than k
    docs += [(400, None), (401, ""), (402, "-- !"), (403, "w0 " * 30_000), (None, "w150 w3"), (5, "w150 w3"), (5, "w150 w3")]
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(20)]
    items += [(20, "w150, w3"), (21, None), (22, "nowhere"), (20, "COPIED"), (23, "w0"), (24, " ; "), (None, "日本 X")]
    return docs, items


@pytest.mark.parametrize("k", [3, 50])
def test_equals_scores_of_all_documents(spark, made, monkeypatch, k):
    docs, items = made
    assert found(spark, docs, items, k) == plain(docs, items, k)
    # short lists and small buckets, so that every phase has many parts
    for name, value in (("BUCKET", 16), ("PART", 20), ("CHUNK_ROWS", 25), ("CHUNK_POSTINGS", 500)):
        monkeypatch.setattr(lexical_search, name, value)
    assert found(spark, docs, items, k, parts=4, max_pairs=60) == plain(docs, items, k)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 5) == [] and found(spark, [(1, "a"), (2, None)], [], 5) == []
    assert found(spark, [(1, None)], [(1, "a")], 5) == []
    assert found(spark, [(1, "A b")], [(7, "a c"), (8, "c")], 5) == plain([(1, "A b")], [(7, "a c"), (8, "c")], 5)


def test_thresholds_leave_postings_out():
    """A frequent list sends little, and what it keeps back is bounded."""
    block = lexical_search.Block({b"a": 0, b"b": 1}, [(0, 0, np.array([0, 1]))])
    block.weight, block.lowest, block.highest = np.array([10, 5000]), np.array([100, 100]), np.array([900, 900])
    block.bounds = {0: 2_000_000}
    lists, least, silent = block.thresholds(0)
    assert least.tolist() == [100_000, 200] and silent.tolist() == [9000, 999_999]
    assert block.sent().tolist() == [100_000, 200]
