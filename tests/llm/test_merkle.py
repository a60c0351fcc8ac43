"""The manifest against a plain tree, for trees of all sorts of sizes."""

import hashlib
import zlib

import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from gradus.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, tree int, row string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """(root, way of each node as (slot, siblings))."""
    at, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, a in enumerate(at):
            run = runs[a // 8]
            ways[k].append((a % 8, run[: a % 8] + run[a % 8 + 1 :]))
            at[k] = a // 8
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], ways


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    found = {t: climb([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in order}
    root, above = climb([found[t][0] for t in order])
    out = []
    for t, up in zip(order, above, strict=True):
        for x, way in zip(sorted(trees[t], key=lambda x: x[:3]), found[t][1], strict=True):
            r, way = x[3], way + up
            digest = x[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                digest = leaf(*r[:4], text)
            for slot, siblings in way:
                digest = h("".join([*siblings[:slot], digest, *siblings[slot:]]))
            proof = h("".join(s for _, siblings in way for s in siblings))
            out.append((r[0], x[2], found[t][0], root, proof, digest, digest == root))
    return sorted(out, key=repr)


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = merkle.manifest(df, claimed={"text": F.translate("text", merkle.UPPER, merkle.LOWER)}, where=tampered)
    return sorted(map(tuple, got.collect()), key=repr)


def test_trees_of_many_sizes(spark):
    sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "é": 65, "Z": 130, None: 3, "": 2, "f": 1, "g": 1}
    rows, n = [], 0
    for lang, size in sizes.items():
        for i in range(size):
            rows.append((n * 7 % 331, "s" if i % 4 else None, lang, i if i % 5 else None, [None, "", "Ab Ç", "lower", "LINE\nTWO"][i % 5]))
            n += 1
    assert made(spark, rows) == plain(rows)


@pytest.mark.parametrize("count", [0, 1, 2, 9])
def test_trees_of_one_leaf(spark, count):
    rows = [(i, "s", f"l{i}", 1, "Text") for i in range(count)]
    assert made(spark, rows) == (plain(rows) if rows else [])


def test_repeated_rows_and_ids(spark):
    rows = [(7, "s", "en", 1, "Same")] * 40 + [(7, "s", "en", 1, f"Other {i}") for i in range(5)] + [(None, None, None, None, None)] * 3
    rows += [(8, "s", "en", 1, "L" * 200_000)]
    assert made(spark, rows) == plain(rows)


def test_ways_lead_to_the_root(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = merkle.manifest(docs, proofs=True).collect()
    assert len(rows) == docs.count() and all(r.verified for r in rows)
    for r in rows:
        digest = r.leaf
        for slot, siblings in r.proof:
            parts = [siblings[i : i + 64] for i in range(0, len(siblings), 64)]
            digest = h("".join([*parts[:slot], digest, *parts[slot:]]))
        assert digest == r.root and r.proof_sha256 == h("".join(s for _, s in r.proof))
    changed = merkle.manifest(docs, claimed={"source": F.concat("source", F.lit("x"))}, where=F.col("doc_id") < 9)
    assert {r.doc_id for r in changed.collect() if not r.verified} == set(range(9))


def test_layout_over_partitions():
    """A tree over three partitions, whole trees inside one, partitions without rows."""
    parts = [["a", "a"], [], ["a"], ["a", "b", "b", "c"], ["c", "d"]]
    runs = [(i, x) for i, p in enumerate(parts) for x in merkle._runs(iter([(t,) for t in p]))]
    layout, trees, total = merkle._layout(runs)
    assert (trees, total) == (4, 9)
    assert layout == {0: (0, 0, 4, 4), 2: (0, 2, 4, 4), 3: (0, 3, 4, 2), 4: (2, 1, 2, 1)}


def test_small_supersteps_take_few_tasks(spark, monkeypatch):
    """Where shuffles are dealt over many partitions, what they wrote is read again by a few tasks."""
    rows = [(i, "s", "en" if i % 3 else "fr", 1, f"Text {i}") for i in range(600)]
    dealt = RDD.partitionBy
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *a, **b: dealt(self, max(24, n or 0), *a, **b))
    context = spark.sparkContext
    context.setJobGroup("merkle-tasks", "test")
    try:
        assert made(spark, rows) == plain(rows)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("merkle-tasks") for s in tracker.getJobInfo(j).stageIds}
    found = [tracker.getStageInfo(s) for s in stages]
    assert 100 < sum(x.numCompletedTasks for x in found if x) < 400
