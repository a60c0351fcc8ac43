import random
import re

import pytest
import xxhash

from gradus.llm import simhash_dedup
from gradus.llm.components import components
from gradus.llm.simhash_dedup import drop_near_duplicates, fingerprints, near_classes, near_links, op10_simhash_dedup


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def test_fingerprints_match_the_plain_form():
    rng = random.Random(3)
    texts = [None, "", "  \n\t", "One", "one TWO", "a b c", "É é A a", "x" * 5000]
    texts += [" ".join(rng.choice(["la", "Lo", "öl", "zz"]) for _ in range(rng.randrange(1, 900))) for _ in range(30)]
    assert fingerprints(texts).tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("limit", [2, 40, 4096])
def test_links_span_dense_classes_exactly(spark, limit):
    rng = random.Random(limit)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(3):
        seen = [rng.getrandbits(64)]
        for _ in range(150):
            x = rng.choice(seen)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            seen.append(x)
        fps |= set(seen)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    expected = roots(
        [signed(x) for x in fps],
        [(signed(a), signed(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3],
    )
    got = near_links(spark.createDataFrame([(signed(x),) for x in fps], "fp bigint"), bucket_limit=limit)
    links = [(r.a, r.b) for r in got.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    assert roots([signed(x) for x in fps], links) == expected
    named = {r.vertex: r.root for r in components(got).collect()}
    assert all(named.get(k, k) == v for k, v in expected.items())


@pytest.mark.parametrize("hot", [2, 64])
def test_query_equals_brute_force(spark, sf_dir, hot, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "HOT_MEMBERS", hot)  # names by broadcast, or by join
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    ids = sorted(prints)
    want = roots(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, fp string, component_id string, vertex int"
    rows = [(5, None, "f", "c", 1), (4, "", None, None, 2), (7, "a b c d", "x", "y", 3), (7, "a b c d", "x", "y", 3),
            (9, "A B c d", "x", "y", 3), (None, "q r s t u", "x", "y", 3), (2, "only one other text", "x", "y", 3)]
    docs = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.component_id) for r in near_classes(docs).collect()}
    assert got == {(5, 4), (4, 4), (7, 7), (9, 7), (None, None), (2, 2)}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [
        (0, "q r s t u"), (2, "only one other text"), (4, ""), (7, "a b c d")]
    assert near_classes(docs.limit(0)).collect() == []
    assert drop_near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("hot", "edges"), [(4096, 256), (3, 2), (1, 1)])
def test_components_with_hot_centres(spark, monkeypatch, hot, edges):
    from gradus.llm import components as module

    monkeypatch.setattr(module, "HOT", hot)
    monkeypatch.setattr(module, "HOT_EDGES", edges)
    rng = random.Random(hot)
    links = [(500, rng.randrange(1000, 1400)) for _ in range(600)] + [(7, i) for i in range(2000, 2100)]  # stars
    links += [(i, i + 1) for i in range(3000, 3060)] + [(rng.randrange(4000, 4400), rng.randrange(4000, 4400)) for _ in range(150)] + [(9, 9)]
    keys = sorted({x for p in links for x in p})
    got = {r.vertex: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: r for k, r in roots(keys, links).items() if k != 9}


def test_edges_of_a_hot_centre_are_dealt(spark):
    from pyspark.sql import functions as F

    from gradus.llm.components import _with_least

    arcs = spark.range(1, 20_000).select(F.floor(F.col("id") / 10**6).alias("u"), F.col("id").alias("v"))
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined, _ = _with_least(arcs)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("__m")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) >= 12 and sizes[-1] <= 4 * sizes[len(sizes) // 2]
