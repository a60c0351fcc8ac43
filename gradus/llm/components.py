"""Connected components of a graph given as an edge table.

Alternating large-star and small-star rounds: every round is two aggregations and joins
on vertex ids, nothing reaches the driver but the number of edges that changed, and every
round is cut off by a table in the shared folder.

The centre of a large component has an edge to each of its members. What the ``HOT`` vertices of most edges are to be
linked to is broadcast, so their edges stay where they are and don't meet in one task; each other vertex has fewer than
``HOT_EDGES`` edges, or less than one in ``HOT`` of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import drop_snapshot, snapshot

#: Vertices whose edges are not shuffled by them (some 60 bytes each), and their least number of edges.
HOT, HOT_EDGES = 4096, 256


def _with_least(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs with ``__m``, (u, __m)): the least of each vertex and its neighbours v."""
    least = arcs.groupBy("u").agg(F.min("v").alias("__m"), F.count("*").alias("__n"))  # combined before the shuffle
    least = least.withColumn("__m", F.least("u", "__m"))
    hot = least.where(F.col("__n") >= HOT_EDGES).orderBy(F.desc("__n"), "u").limit(HOT).select(F.col("u").alias("__h"), F.col("__m").alias("__hm"))
    marked = arcs.join(F.broadcast(hot), F.col("u") == F.col("__h"), "left")  # ``HOT`` rows at most
    # edges of a hot vertex are spread by their other end, which finds nothing, or what it does not need
    marked = marked.withColumn("__key", F.when(F.col("__h").isNull(), F.col("u")).otherwise(F.col("v")))
    others = least.select(F.col("u").alias("__key"), F.col("__m").alias("__om"))
    joined = marked.join(others, "__key", "left")
    return joined.select("u", "v", F.coalesce("__hm", "__om").alias("__m")), least.select("u", "__m")


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each vertex to the least one of its neighbourhood.

    ``arcs`` are rows (u, v); large: all neighbours v of u in both directions, those above
    u are linked; small: only neighbours below u, those and u itself are linked.
    """
    if large:
        arcs = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, least = _with_least(arcs)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("__m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("__m").alias("v")).unionByName(
            least.select("u", F.col("__m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(vertex, root) for every vertex that has an edge; root is the least of its component.

    ``edges`` has two columns of an orderable type; direction, repeats and loops don't
    matter. Vertices without an edge to another are not in the result. Rounds grow with the
    logarithm of a component's size; if ``max_rounds`` do not settle it, an error is raised, and
    no result is cut short.
    """
    a, b = edges.columns
    arcs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    arcs = snapshot(arcs, "arcs")
    before = None
    for _ in range(max_rounds):
        wide = snapshot(_star(arcs, True), "large-star")
        after = snapshot(_star(wide, False), "small-star")
        drop_snapshot(wide)
        # Stars only: no vertex is both a centre and a leaf, and nothing moved.
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_snapshot(arcs)
        arcs = after
        if tuple(sums) == before:
            break
        before = tuple(sums)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = arcs.select(F.col("v").alias("vertex")).distinct()
    return arcs.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(
        roots.select("vertex", F.col("vertex").alias("root"))
    )
