"""Exact top-k search by inner product: a Voronoi kNN join.

Inner products become distances: with M the longest vector's length, every data vector x gets one
more component sqrt(M^2 - |x|^2) and every query a 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the
nearest vectors are those of highest score. Pivots, drawn from the data by hash, cut this space into
cells; queries and data are grouped by their nearest pivot.

A cell's summary is the number of its vectors, their least and largest distance to the pivot and the
k + 1 smallest ones. From summaries alone follows, for each cell of queries, a distance within which all
of its queries have k + 1 neighbours, and hence, by the triangle inequality, which data cells, and which
ring of each around its pivot, may hold a neighbour. Only those rows are replicated to the group. Groups
are blocks of ``GROUP_QUERIES`` queries of neighbouring cells (a larger cell is several groups); the
data of a group are dealt into slices of about ``SLICE_ROWS`` rows, each solved alone by a matrix product, and
the best k + 1 of all slices are merged. Summaries and routes have at most ``PIVOTS`` ** 2 rows, whatever the data.

Equal vectors have equal scores, so of a vector that many rows repeat the k + 1 smallest ids are enough
for any query, and a query vector that many rows repeat is solved once; both are cut before the shuffle.

Scores are whole numbers and exact; distances decide only what is sent, with room for rounding.

Defined results: vectors that are null or hold a null or a component that is not finite take no part, as
query or as candidate; of vectors of different lengths the shorter end in zeros; components and scores
beyond 64 bits are held at its limits. Rows without an id are candidates, behind all others of the same score.
A row that repeats a query's id and vector is a candidate of it, the query's own row is not. Empty tables, and
tables of one row, give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.common import map_batches, snapshot, table

SCALE = 256
K = 5
EVERY = 50
#: Cells at most; fewer for small tables (the square root of the rows).
PIVOTS = 256
GROUP_QUERIES = 2048
SLICE_ROWS = 2048
#: Of the lengths that enter a distance, the part that rounding may take.
_SLACK = 1e-6
_LIMIT = (1 << 63) - 1


def _vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec, k1, k2) of the rows that take part; k1 and k2 are 128 bits that stand for the vector."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    vec = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    rows = df.where(F.col(vec_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    return rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})


def _first_ids(rows: DataFrame, n: int) -> DataFrame:
    """Of equal vectors the rows with the ``n`` smallest ids; cut to them before the shuffle."""
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.asc_nulls_last("id")))
    return rows.withColumn("n", place).where(F.col("n") <= n).drop("n")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, with zeros behind shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


# -- cells


@dataclass(frozen=True)
class Space:
    """Pivots with their additional component, and the square of the longest length."""

    pivots: np.ndarray
    longest: float

    @property
    def dim(self) -> int:
        return self.pivots.shape[1] - 1

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest - (x * x).sum(1)))
        return np.column_stack([x, last])

    def distances(self, x: np.ndarray) -> np.ndarray:
        squares = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(0, squares))


def _cells(rows: DataFrame, space: Space, query: bool) -> DataFrame:
    """Adds the nearest pivot ``cell`` and the distance ``dist`` to it."""

    def assign(batches):
        for batch in batches:
            far = space.distances(space.lifted(_matrix(batch.column("vec"), space.dim), query))
            cell = far.argmin(1) if len(far) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                [*batch.schema.names, "cell", "dist"],
            )

    return map_batches(rows, assign, "id long, vec array<bigint>, k1 long, k2 long, cell int, dist double")


@dataclass
class Group:
    """Query cells that are solved together, and the ring (least, largest distance) of each data cell that they need."""

    cells: list[int]
    parts: int
    rings: dict[int, tuple[float, float]]
    slices: int = 1


def _chain(cells: list[int], between: np.ndarray) -> list[int]:
    """Cells in an order in which neighbours follow each other."""
    left, out = set(cells), []
    at = min(cells, default=None)
    while left:
        out.append(at)
        left.remove(at)
        at = min(left, key=lambda c: (between[out[-1], c], c), default=None)
    return out


def routes(
    between: np.ndarray,
    data: dict[int, tuple[int, float, float, list[float]]],
    queries: dict[int, tuple[int, float]],
    k: int,
    slack: float,
    group_queries: int = GROUP_QUERIES,
    slice_rows: int = SLICE_ROWS,
) -> list[Group]:
    """Groups of query cells with what they need, from summaries alone.

    ``between``: distances of pivots. ``data``: of each cell rows, least and largest distance, the ``k``
    smallest ones. ``queries``: of each cell queries and largest distance.
    """

    def rings(i: int) -> dict[int, tuple[float, float]]:
        reach = queries[i][1]
        bounds = sorted(reach + between[i, j] + d for j, (_, _, _, near) in data.items() for d in near)
        within = (bounds[k - 1] if len(bounds) >= k else math.inf) + reach + slack
        out = {j: (between[i, j] - within, between[i, j] + within) for j in data}
        return {j: (lo, hi) for j, (lo, hi) in out.items() if data[j][2] >= lo and data[j][1] <= hi}

    groups: list[Group] = []
    held = 0
    for i in _chain(list(queries), between):
        n = queries[i][0]
        need = rings(i)
        if n > group_queries:
            groups.append(Group([i], -(-n // group_queries), need))
            held = group_queries  # closed
        elif groups and held + n <= group_queries:
            last = groups[-1]
            last.cells.append(i)
            held += n
            for j, (lo, hi) in need.items():
                a, b = last.rings.get(j, (lo, hi))
                last.rings[j] = (min(a, lo), max(b, hi))
        else:
            groups.append(Group([i], 1, need))
            held = n
    for g in groups:
        g.slices = max(1, -(-sum(data[j][0] for j in g.rings) // slice_rows))
    return groups


# -- solving


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores of each row, of equal ones the first columns."""
    n = scores.shape[1]
    if n > k:
        bound = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(scores >= bound[:, None])
    else:
        row, col = np.nonzero(np.ones(scores.shape, bool))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    return row[place < k], col[place < k]


def inner_products(q: np.ndarray, x: np.ndarray, q_exact: pa.Array, x_exact: pa.Array) -> np.ndarray:
    """Exact scores: by doubles where all sums are below 2 ** 53, else by Python's whole numbers, held at 64 bits."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < 2**53:
        return q @ x.T
    rows = [v.as_py() for v in x_exact]
    out = [[max(-_LIMIT, min(_LIMIT, sum(a * b for a, b in zip(v.as_py(), r, strict=False)))) for r in rows] for v in q_exact]
    return np.array(out, dtype=np.int64).reshape(len(q), len(x))


_FOUND = "k1 long, k2 long, id long, score long, same boolean"


def _solver(dim: int, k: int):
    def solve(data: pa.Table, queries: pa.Table) -> pa.Table:
        ids = data.column("id").combine_chunks()
        data = data.take(pa.array(np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))))
        data, ids = data.combine_chunks(), data.column("id")
        x, parts = _matrix(data.column("vec"), dim), []
        of = lambda t, name: t.column(name).to_numpy()
        step = max(1, (1 << 22) // max(1, len(x)))  # 32 MB of scores at once
        for start in range(0, queries.num_rows, step):
            some = queries.slice(start, step)
            scores = inner_products(_matrix(some.column("vec"), dim), x, some.column("vec"), data.column("vec"))
            row, col = best(scores, k)
            same = (of(some, "k1")[row] == of(data, "k1")[col]) & (of(some, "k2")[row] == of(data, "k2")[col])
            parts.append((of(some, "k1")[row], of(some, "k2")[row], col, scores[row, col].astype(np.int64), same))
        k1, k2, col, score, same = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else ([], [], np.zeros(0, int), [], [])
        names = ["k1", "k2", "id", "score", "same"]
        found = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), ids.take(pa.array(col, pa.int64())).combine_chunks(), pa.array(score, pa.int64()), pa.array(same, pa.bool_())]
        return pa.table(found, names=names)

    return solve


def _replicated(data: DataFrame, queries: DataFrame, groups: list[Group]) -> tuple[DataFrame, DataFrame]:
    """Data and queries at every (g, s) where they are needed."""
    spark = data.sparkSession
    first, to_data, to_queries = 0, [], []
    for g in groups:
        to_data += [(j, first, g.parts, g.slices, float(lo), float(hi)) for j, (lo, hi) in g.rings.items()]
        to_queries += [(i, first, g.parts, g.slices) for i in g.cells]
        first += g.parts
    rings = spark.createDataFrame(to_data, "cell int, g0 long, parts long, slices long, lo double, hi double")
    blocks = spark.createDataFrame(to_queries, "cell int, g0 long, parts long, slices long")
    sent = data.join(F.broadcast(rings), "cell").where(F.col("dist").between(F.col("lo"), F.col("hi")))  # PIVOTS ** 2 rows at most
    sent = sent.withColumn("g", F.explode(F.sequence("g0", F.col("g0") + F.col("parts") - 1)))
    asked = queries.join(F.broadcast(blocks), "cell").withColumn("g", F.col("g0") + F.pmod("k1", "parts"))  # PIVOTS rows at most
    asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    return (
        sent.select("g", F.pmod("k2", "slices").alias("s"), "id", "vec", "k1", "k2"),
        asked.select("g", "s", "vec", "k1", "k2"),
    )


def top_k(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    group_queries: int = GROUP_QUERIES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row that meets ``is_query`` (a condition on the column ``id``)
    the ``k`` other rows of highest score, equal scores by id."""
    spark = df.sparkSession
    rows = _vectors(df, id_col, vec_col, scale)
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dim, longest = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(length)).first()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = min(pivots, math.isqrt(n) + 1)
    drawn = rows.select("k1", "k2", "vec").orderBy("k1", "k2").limit(wanted * (k + 1)).collect()  # the keys are hashes
    drawn = list({(r.k1, r.k2): r.vec for r in drawn}.values())[:wanted]
    flat = np.zeros((len(drawn), dim))
    for i, v in enumerate(drawn):
        flat[i, : len(v)] = v
    space = Space(np.column_stack([flat, np.sqrt(np.maximum(0, longest - (flat * flat).sum(1)))]), longest)

    data = snapshot(_cells(_first_ids(rows, k + 1), space, False), "vectors")
    asking = rows.where(is_query)
    queries = snapshot(_cells(_first_ids(asking, 1), space, True), "queries")

    nearest = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    near: dict[int, list[float]] = {}
    for r in data.select("cell", "dist", nearest.alias("n")).where(F.col("n") <= k + 1).collect():  # k + 1 for each pivot
        near.setdefault(r.cell, []).append(r.dist)
    sizes = data.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()
    asked = queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("hi")).collect()
    groups = routes(
        space.distances(space.pivots),
        {r.cell: (r.n, r.lo, r.hi, near[r.cell]) for r in sizes},
        {r.cell: (r.n, r.hi) for r in asked},
        k + 1,
        _SLACK * (1 + 2 * math.sqrt(longest)),
        group_queries,
        slice_rows,
    )
    left, right = _replicated(data, queries, groups)
    found = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(_solver(dim, k + 1), _FOUND)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    merged = found.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*order))).where(F.col("n") <= k + 1)
    lists = merged.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score", "same"))).alias("found"))  # k + 1 at most
    each = asking.select(F.col("id").alias("query_id"), "k1", "k2").join(lists, ["k1", "k2"])
    own = F.array_position(F.transform("found", lambda x: x["same"] & x["id"].eqNullSafe(F.col("query_id"))), True)
    others = F.slice(F.filter("found", lambda x, i: i + 1 != F.col("own")), 1, k)
    out = each.withColumn("own", own).select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op13_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.r <> d.r WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
