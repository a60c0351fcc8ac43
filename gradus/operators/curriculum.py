"""Curriculum metrics: accuracy over stages, forgetting, retention, backward transfer, replay plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.numeric import clamp, ratio


def domain_dimension(spark, domains: tuple[str, ...]) -> DataFrame:
    """(domain, first_stage): a domain is learned at its place in the curriculum."""
    return spark.createDataFrame([(d, i) for i, d in enumerate(domains)], "domain string, first_stage int")


def accuracy_matrix(accuracy: DataFrame, dimension: DataFrame) -> DataFrame:
    """Triangular long matrix: a domain counts from the stage on at which it is learned."""
    joined = accuracy.join(F.broadcast(dimension), "domain").where("stage >= first_stage")  # a row for each domain of the curriculum
    return joined.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def domain_metrics(matrix: DataFrame) -> DataFrame:
    """Per strategy and domain: acquisition, final and best accuracy, forgetting, retention, transfer."""
    out = matrix.groupBy("strategy", "domain", "first_stage").agg(
        F.min_by("accuracy", "stage").alias("acquisition"),
        F.max_by("accuracy", "stage").alias("final"),
        F.max("accuracy").alias("best"),
        F.max("stage").alias("last_stage"),
    )
    return out.withColumns(
        {
            "forgetting": clamp(F.col("best") - F.col("final")),
            "retention": F.when(F.col("acquisition") > 0, F.col("final") / F.col("acquisition")),
            "backward_transfer": F.col("final") - F.col("acquisition"),
        }
    )


def continual_metrics(matrix: DataFrame) -> DataFrame:
    """Per strategy, in percent; what is lost or gained is averaged over domains learned before the last stage."""
    each = domain_metrics(matrix)
    old = F.col("first_stage") < F.max("last_stage").over(Window.partitionBy("strategy"))
    each = each.withColumn("old", old)
    mean = lambda c: (100 * F.avg(F.when(F.col("old"), F.col(c)))).alias(f"average_{c}")
    return each.groupBy("strategy").agg(
        (100 * F.avg("final")).alias("average_final"), mean("forgetting"), mean("retention"), mean("backward_transfer")
    )


def seen_average(matrix: DataFrame) -> DataFrame:
    """Mean accuracy over the domains seen so far, per stage."""
    return matrix.groupBy("strategy", "stage").agg(F.avg("accuracy").alias("average_seen"), F.count("accuracy").alias("domains_seen"))


def against_reference(runs: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Points lost to (or gained on) a fixed reference, by key."""
    joined = runs.join(reference.select(key, F.col("accuracy").alias("reference_accuracy")), key)
    gap = F.col("reference_accuracy") - F.col("accuracy")
    return joined.withColumns({"forgetting": clamp(gap), "gain": -gap})


def allocate(weights: DataFrame, group: list[str], weight: str, rank: str, total: int) -> DataFrame:
    """Shares ``total`` slots out by largest remainder.

    Negative weights count as 0; all zero: equal shares. Ties of remainders go by ``rank``.
    """
    w = Window.partitionBy(*group)
    clamped = F.greatest(F.lit(0.0), F.col(weight))
    shared = weights.withColumn("__w", clamped).withColumns({"__sum": F.sum("__w").over(w), "__n": F.count("*").over(w)})
    share = F.when(F.col("__sum") == 0, 1.0 / F.col("__n")).otherwise(F.col("__w") / F.col("__sum"))
    raw = shared.withColumn("__raw", share * total).withColumn("__base", F.floor("__raw"))
    left = F.lit(total) - F.sum("__base").over(w)
    place = F.row_number().over(w.orderBy(F.desc(F.round(F.col("__raw") - F.col("__base"), 12)), rank))
    given = raw.withColumns({"__left": left, "__place": place})
    slots = (F.col("__base") + F.when(F.col("__place") <= F.col("__left"), 1).otherwise(0)).cast("bigint")
    return given.withColumn("slots", slots).drop("__w", "__sum", "__n", "__raw", "__base", "__left", "__place")


def adaptive_priorities(scores: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """(strategy, stage, domain, ..., priority): what was lost since the best score before, plus epsilon.

    ``scores`` has (strategy, stage, domain, score); the best is taken over earlier stages
    only (a domain's first score has lost nothing), and updated afterwards.
    """
    w = Window.partitionBy("strategy", "domain").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.max("score").over(w), F.col("score"))
    out = scores.withColumn("best_before", best)
    return out.withColumns(
        {
            "deficit": clamp(F.col("best_before") - F.col("score")),
            "priority": F.lit(epsilon) + clamp(F.col("best_before") - F.col("score")),
            "best_after": F.greatest("best_before", "score"),
        }
    )
