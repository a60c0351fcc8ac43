"""Top-k search against all products, and what bounds from summaries spare."""

import math

import numpy as np
from pyspark.sql import functions as F

from gradus.llm import vector_topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, cell int, score double"


def plain(rows, every, k=5):
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [max(-(2**63), min(2**63 - 1, math.floor(256 * float(np.float32(x))))) for x in v]) for i, v in ok]
    out = []
    for a, (q, v) in enumerate(whole):
        if q is None or q % every:
            continue
        scored = []
        for b, (i, w) in enumerate(whole):
            if a != b:
                s = sum(x * y for x, y in zip(v, w, strict=False))
                scored.append((-max(-(2**63 - 1), min(2**63 - 1, s)), i is None, i or 0))
        out += [(q, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, every, **options):
    df = spark.createDataFrame([(i, v, 0, "x", 1, 1.0) for i, v in rows], SCHEMA).repartition(3)
    got = vector_topk.top_k(df, F.col("id") % every == 0, **options)
    return sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_equals_all_products(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(7, 12)) * 4
    rows = [(i, (centres[i % 7] + rng.normal(size=12) * 0.3).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 12) for i in range(400, 700)]  # one vector that many rows repeat
    rows += [(i, rng.integers(-1, 2, 12).astype(float).tolist()) for i in range(700, 800)]  # many ties
    options = {"pivots": 9, "group_queries": 6, "slice_rows": 40}
    assert found(spark, rows, 5, **options) == plain(rows, 5)
    assert found(spark, rows, 50) == plain(rows, 50)


def test_hard_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0])]
    rows += [(5, []), (None, [1.0, 2.0]), (None, [9.0]), (10, [0.0, 0.0, 0.0]), (15, [-0.001, 1e30]), (20, [1e18, -1e18, 3.0]), (25, [])]
    assert found(spark, rows, 5) == plain(rows, 5)
    assert found(spark, [], 5) == [] and found(spark, [(5, [1.0])], 5) == [] and found(spark, [(6, [1.0]), (7, [1.0])], 5) == []


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = sorted((tuple(r) for r in vector_topk.op13_vector_topk(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()), key=repr)
    assert got == plain([(r.vec_id, r.embedding) for r in df.collect()], 50) and got


def test_routes_spare_far_cells_and_lose_none():
    """Two heaps far from each other: queries of one don't see the other; every true neighbour is on a route."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 4)), rng.normal(size=(300, 4)) + 100])
    pivots = x[rng.choice(600, 12, replace=False)]
    far = lambda a: np.sqrt(((a[:, None] - pivots) ** 2).sum(2))
    cell, dist = far(x).argmin(1), far(x).min(1)
    data = {int(c): (int((cell == c).sum()), dist[cell == c].min(), dist[cell == c].max(), sorted(dist[cell == c])[:3]) for c in set(cell)}
    asking = np.arange(0, 600, 10)
    queries = {int(c): (int((cell[asking] == c).sum()), dist[asking][cell[asking] == c].max()) for c in set(cell[asking])}
    groups = vector_topk.routes(far(pivots), data, queries, 3, 1e-9, 8, 50)
    of = {c: g for g in groups for c in g.cells}
    seen = 0
    for q in asking:
        g = of[int(cell[q])]
        need = [i for i in range(600) if int(cell[i]) in g.rings and g.rings[int(cell[i])][0] <= dist[i] <= g.rings[int(cell[i])][1]]
        seen += len(need)
        assert set(np.argsort(((x - x[q]) ** 2).sum(1))[:3]) <= set(need)
    assert seen < 0.6 * 600 * len(asking)
    assert sorted(c for g in groups for c in g.cells) == sorted(queries)


def test_large_cells_become_several_groups():
    groups = vector_topk.routes(np.zeros((2, 2)), {0: (10, 0.0, 1.0, [0.0])}, {0: (25, 1.0), 1: (3, 1.0)}, 5, 0.0, 10, 4)
    assert {tuple(g.cells): (g.parts, g.slices) for g in groups} == {(0,): (3, 3), (1,): (1, 3)}
