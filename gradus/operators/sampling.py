"""Deterministic selection: a digest of (seed, id) takes the place of a shuffle.

A rank by digest is a permutation that every engine computes alike, does not depend on
the order or number of partitions, and stays the same for the rows that stay when others
come or go. ``exact_sample`` draws as a seeded generator does, for published selections.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.sources.scratch import scratch


def digest(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


#: Hex digits that tell the bins of a permutation: rows of a group and bin are numbered in one task, so 4096 bins
#: are meant for groups of up to some ten billion rows, and one more digit for sixteen times as many.
HEX_DIGITS = 3


def numbered(df: DataFrame, bin_: Column, order: list, group: list[str], rank: str = "rank") -> DataFrame:
    """Adds the place of each row in its group, from 1, without a task that sees a whole group.

    ``bin_`` is a number that never falls along ``order``. Rows of a bin are numbered, and the rows of
    the bins before are added from a table with a row for each group and bin.
    """
    binned = df.withColumn("__bin", bin_)
    sizes = binned.groupBy(*group, "__bin").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    renamed = sizes.select(*[F.col(g).alias(f"__{i}") for i, g in enumerate(group)], F.col("__bin").alias("__b"), "__before")
    same = F.col("__bin").eqNullSafe(F.col("__b"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__{i}"))
    inside = F.row_number().over(Window.partitionBy(*group, "__bin").orderBy(*order))
    ranked = binned.withColumn("__inside", inside).join(renamed, same)
    return ranked.select(*df.columns, (F.col("__inside") + F.col("__before")).alias(rank))


def shuffled(
    df: DataFrame, key: str, seed: int | str, group: list[str] | None = None, rank: str = "rank", limit: int | None = None, digits: int = HEX_DIGITS
) -> DataFrame:
    """Adds the place of each row in its group's permutation, from 1.

    With ``limit`` only that many rows of each group are kept; groups are cut to them before the
    shuffle. Without it the permutation is numbered bin by bin, also where all rows are one group.
    """
    place = digest(seed, F.col(key))
    if limit is not None:
        w = Window.partitionBy(*(group or [])).orderBy(place, key)
        return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)
    bin_ = F.conv(F.substring(place, 1, digits), 16, 10).cast("int")
    return numbered(df, bin_, [place, F.col(key)], group or [], rank)


def id_bin(key: str, rows: int = 65_536) -> Column:
    """Bins of so many successive numbers of an integer key."""
    return F.floor(F.col(key) / rows)


def split_by_rank(df: DataFrame, cuts: list[tuple[str, int]], rank: str = "rank", name: str = "partition") -> DataFrame:
    """Names rank ranges one after another; rows behind the last cut fall out.

    The bound on the rank stands before the names, so that groups are cut to it before the shuffle.
    """
    df = df.where(F.col(rank) <= sum(n for _, n in cuts))
    out, start = F.lit(None).cast("string"), 0
    for label, n in cuts:
        out = F.when(F.col(rank).between(start + 1, start + n), label).otherwise(out)
        start += n
    return df.withColumn(name, out).where(F.col(name).isNotNull())


def sample(df: DataFrame, key: str, n: int, seed: int | str, group: list[str] | None = None) -> DataFrame:
    """``n`` rows of each group without replacement, in permutation order."""
    if group:
        return shuffled(df, key, seed, group, limit=n)
    taken = df.withColumn("__d", digest(seed, F.col(key))).orderBy("__d", key).limit(n)  # a top-n, no full sort
    return taken.withColumn("rank", F.row_number().over(Window.orderBy("__d", key))).drop("__d")


def pool(df: DataFrame, probe: DataFrame, key: str, seed: int | str, group: list[str]) -> DataFrame:
    """What may be trained on: everything but the probe, shuffled per group."""
    return shuffled(df.join(probe.select(key), key, "left_anti"), key, seed, group)


def replay_mix(df: DataFrame, key: str, domain: str, current: str, old: tuple[str, ...], n_current: int, slots: int, ratio: int, seed: int) -> DataFrame:
    """(id, domain, kind, presentation) of a fixed number of presentations.

    All ``n_current`` rows of the current domain once; of ``slots`` further presentations
    a part of ``ratio`` / 20 goes to the old domains in equal shares (what is left over goes
    to the first of them, one each), the others repeat rows of the current domain.
    """
    if ratio not in (0, 10, 20):
        raise ValueError("a ratio is 0, 10 or 20")
    replayed = slots * ratio // 20
    base = sample(df.where(F.col(domain) == current), key, n_current, seed)
    repeats = base.where(F.col("rank") <= slots - replayed)
    each, more = divmod(replayed, len(old))
    past = sample(df.where(F.col(domain).isin(*old)), key, each + 1, f"{seed}-old", [domain])
    past = past.where((F.col("rank") <= each) | F.col(domain).isin(*old[:more]))
    parts = [(base, "current"), (repeats, "repeat"), (past, "replay")]
    cols = [F.col(key), F.col(domain), F.col("rank")]
    out = None
    for part, kind in parts:
        rows = part.select(*cols, F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), "kind", F.col(key).cast("string")))
    return out.drop("rank").withColumn("presentation", F.row_number().over(Window.orderBy(order, key, "kind")))


def substitute(plan: DataFrame, repeats: DataFrame, is_old: Column, key: str, pos: str) -> DataFrame:
    """Puts the k-th repeated id at the place of the k-th old-domain id; other places stay."""
    k = F.row_number().over(Window.partitionBy("__old").orderBy(pos))
    ranked = plan.withColumn("__old", is_old).withColumn("k", F.when(F.col("__old"), k))
    new = repeats.select(F.col(key).alias("__new"), F.row_number().over(Window.orderBy("pos")).alias("k"))
    joined = ranked.join(F.broadcast(new), "k", "left")  # as many as replay slots
    return joined.withColumn(key, F.coalesce("__new", key)).drop("__new", "__old", "k")


def first_distinct(plan: DataFrame, key: str, pos: str, n: int, group: list[str]) -> DataFrame:
    """A memory: the first ``n`` different ids of each group in plan order."""
    firsts = plan.groupBy(*group, key).agg(F.min(pos).alias(pos))
    return firsts.withColumn("slot", F.row_number().over(Window.partitionBy(*group).orderBy(pos))).where(F.col("slot") <= n)


def draw_replay(memory: DataFrame, allocation: DataFrame, key: str, domain: str, seed: str) -> DataFrame:
    """As many ids of each domain's memory as its slots; a memory that is too small raises."""
    sizes = memory.groupBy(domain).agg(F.count("*").alias("held"))
    short = allocation.join(sizes, domain, "left").where(F.coalesce("held", F.lit(0)) < F.col("slots"))
    lacking = short.limit(5).collect()
    if lacking:
        raise ValueError(f"replay memory too small: {lacking}")
    most = allocation.agg(F.max("slots")).first()[0] or 0
    ranked = shuffled(memory, key, seed, [domain], limit=most)
    return ranked.join(allocation.select(domain, "slots"), domain).where(F.col("rank") <= F.col("slots")).drop("slots")


def stage_plan(current: DataFrame, replay: DataFrame, key: str, seed: str, groups: int) -> DataFrame:
    """(pos, id, domain, source_type): current and replayed groups, mixed; the number must add up."""
    both = current.select(key, "domain", F.lit("current").alias("source_type")).unionByName(
        replay.select(key, "domain", F.lit("replay").alias("source_type"))
    )
    if both.count() != groups:
        raise ValueError(f"a stage has {groups} groups")
    return both.withColumn("pos", F.row_number().over(Window.orderBy(digest(seed, F.col(key)), key)))


def exact_sample(ids: list, n: int, seed: int) -> list:
    """The sample that Python's generator draws; ids in the order in which they were published."""
    return random.Random(seed).sample(ids, n)


def exact_shuffle(ids: list, seed: int) -> list:
    out = list(ids)
    random.Random(seed).shuffle(out)
    return out


def places(df: DataFrame, *keys: str, place: str = "place") -> DataFrame:
    """Every row with its place, from 1, in the order of ``keys`` (of rows with equal keys any order).

    Rows are dealt by ranges of the whole key and written down with the number of their range; a range is numbered
    by itself, and the sizes of the ranges before it are added, so no task sees all rows and none passes Python.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "ranges")  # ranges are drawn anew by every run of a plan, so they are fixed by writing
    df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "__row").withColumn("__range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__range", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys, "__row"))
    ranked = ranged.withColumn("__inside", inside).join(F.broadcast(sizes), "__range")
    return ranked.select(*df.columns, (F.col("__inside") + F.col("__before")).alias(place))
