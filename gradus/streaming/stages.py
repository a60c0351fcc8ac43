"""A fold over stages whose state is tables: every stage reads what the one before wrote.

``fold`` runs a step for each stage and writes its tables below ``stage=<number>``; a marker, published by one
rename, says that all of them are whole. A run that is killed goes on behind the last marked stage and gives the
same tables. The state is never held in the driver, and a stage's lineage begins at the written tables.

``replay_stage`` is the step of a curriculum with replay: allocation of the replay slots by what each old domain has
lost, draw from the memories, plan, memory of the new domain, best scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.operators import curriculum
from gradus.schemas import STRATEGIES
from gradus.sources import files

State = dict[str, DataFrame]


def _read(spark: SparkSession, path: str, tables: Iterable[str]) -> State:
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}


def fold(spark: SparkSession, path: str, stages: Iterable, start: State, step: Callable[[State, object], State]) -> dict[int, State]:
    """The tables of every stage, by its number from 1; ``start`` is the state before the first one."""
    state, out = start, {}
    for number, stage in enumerate(stages, 1):
        here = f"{path.rstrip('/')}/stage={number}"
        if not files.names(spark, here, "done"):
            files.delete(spark, here)  # what a killed run left
            made = step(state, stage)
            for name, table in made.items():
                table.write.parquet(f"{here}/{name}")
            files.write_new(spark, f"{here}/done", "\n".join(made))
        state = _read(spark, here, files.read_text(spark, f"{here}/done").split("\n"))
        out[number] = state
    return out


def union_of(stages: dict[int, State], table: str) -> DataFrame:
    """One table of all stages, with its ``stage``."""
    parts = [s[table].withColumn("stage", F.lit(n)) for n, s in stages.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_by_digest(rows: DataFrame, seed: Column, key: str, group: list[str], n: Column | int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in the order of a digest of (seed, key); groups are cut before the shuffle."""
    place = F.md5(F.concat_ws("|", seed, F.col(key).cast("string")))
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(place, key)))
    return ranked.where(F.col(rank) <= n)


def _each(names: Iterable[str]) -> Column:
    return F.explode(F.array(*[F.lit(n) for n in names]))


def replay_stage(
    state: State, pool: DataFrame, scores: DataFrame, domain: str, stage: int, seed: int, strategies: Iterable[str] = STRATEGIES,
    steps: int = 40, replay: int = 8, remember: int = 24,
) -> State:
    """Tables after one stage.

    ``state``: ``memory`` (strategy, domain, slot, id) and ``best`` (strategy, domain, best). ``pool``: ids of ``domain``
    that may be trained on. ``scores``: (strategy, domain, score) of the probe of old domains before this stage. Strategies: ``no_replay``
    trains on ``steps`` current ids; ``fixed_replay`` and ``adaptive_replay`` on ``steps - replay``, and replay old domains
    in equal shares, or by epsilon and what each lost since its best score.

    Result: ``allocation`` (strategy, domain, score, best_before, priority, slots), ``plan`` (strategy, pos, id, domain,
    source_type), ``memory`` and ``best`` for the next stage. A domain without a score has lost nothing.
    """
    memory, best = state["memory"], state["best"]
    known = memory.select("strategy", "domain").distinct()
    old = known.join(scores, ["strategy", "domain"], "left").join(best, ["strategy", "domain"], "left")
    old = old.withColumnRenamed("best", "best_before")
    lost = F.greatest(F.lit(0.0), F.coalesce(F.col("best_before") - F.col("score"), F.lit(0.0)))
    adaptive = F.col("strategy") == "adaptive_replay"
    old = old.where(F.col("strategy") != "no_replay").withColumn("priority", F.when(adaptive, F.lit(0.05) + lost).otherwise(F.lit(1.0)))
    allocation = curriculum.allocate(old, ["strategy"], "priority", "domain", replay)

    size = F.when(F.col("strategy") == "no_replay", steps).otherwise(steps - replay)
    tag = lambda kind: F.concat_ws("-", F.lit(f"{seed}-{stage}-{kind}"), "strategy")
    # as many rows as a plan has, and as memories hold
    first = first_by_digest(pool.select("id"), F.lit(f"{seed}-{stage}-pool"), "id", [], steps)
    current = first.withColumn("strategy", _each(strategies)).where(F.col("rank") <= size)
    drawn = memory.join(allocation.select("strategy", "domain", "slots"), ["strategy", "domain"])
    drawn = first_by_digest(drawn, tag("replay"), "id", ["strategy", "domain"], F.col("slots"))
    both = current.select("strategy", "id", F.lit(domain).alias("domain"), F.lit("current").alias("source_type")).unionByName(
        drawn.select("strategy", "id", "domain", F.lit("replay").alias("source_type"))
    )
    order = F.md5(F.concat_ws("|", tag("plan"), F.col("id").cast("string")))
    plan = both.withColumn("pos", F.row_number().over(Window.partitionBy("strategy").orderBy(order, "id", "source_type")))

    new = plan.where("source_type = 'current'").withColumn("slot", F.row_number().over(Window.partitionBy("strategy").orderBy("pos")))
    kept = new.where(F.col("slot") <= remember).select("strategy", "domain", "slot", "id")
    seen = scores.join(best, ["strategy", "domain"], "full").select("strategy", "domain", F.greatest("best", "score").alias("best"))
    return {
        "allocation": allocation.select("strategy", "domain", "score", "best_before", "priority", "slots"),
        "plan": plan.select("strategy", "pos", "id", "domain", "source_type"),
        "memory": memory.where(F.col("domain") != domain).unionByName(kept),
        "best": seen,
    }


def first_memory(pool: DataFrame, strategies: Iterable[str], domain: str, seed: int, remember: int = 24) -> DataFrame:
    """(strategy, domain, slot, id): what every strategy remembers of the domain that was learned before the first stage."""
    first = first_by_digest(pool.select("id"), F.lit(f"{seed}-0-pool"), "id", [], remember, "slot")
    return first.select(_each(strategies).alias("strategy"), F.lit(domain).alias("domain"), "slot", "id")
