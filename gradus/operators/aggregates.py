"""Aggregations of graded answers: counts first, one division last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.numeric import percent, sample_std
from gradus.operators.sampling import id_bin, numbered


def count_true(x: Column) -> Column:
    return F.count_if(x)


def by_scope(df: DataFrame, domain: str, subtype: str | None, *measures: Column) -> DataFrame:
    """Global, per-domain and (if asked for) per-subtype rows in one pass over the data.

    ``scope`` is global, domain or subtype; keys not used say ``global`` and ``all``.
    """
    sets = [[], [F.col(domain)]] + ([[F.col(domain), F.col(subtype)]] if subtype else [])
    keys = [F.col(domain)] + ([F.col(subtype)] if subtype else [])
    out = df.groupingSets(sets, *keys).agg(
        F.grouping(domain).alias("__d"), *([F.grouping(subtype).alias("__s")] if subtype else []), *measures
    )
    scope = F.when(F.col("__d") == 1, "global")
    scope = scope.when(F.col("__s") == 1, "domain").otherwise("subtype") if subtype else scope.otherwise("domain")
    named = {"scope": scope, domain: F.when(F.col("__d") == 1, "global").otherwise(F.col(domain))}
    if subtype:
        named[subtype] = F.when(F.col("__s") == 1, "all").otherwise(F.col(subtype))
    return out.withColumns(named).drop("__d", "__s")


def accuracy(correct: Column, empty: float | None = 0.0) -> list[Column]:
    n, c = F.count("*"), F.count_if(correct)
    return [n.alias("total"), c.alias("correct"), percent(c, n, empty).alias("accuracy")]


def answer_metrics(rounded: bool = False) -> list[Column]:
    """The eleven figures of a set of graded answers (booleans as booleans)."""
    n = F.count("*")
    r = (lambda x: F.bround(x, 2)) if rounded else (lambda x: x)
    c = {k: F.count_if(F.col(k)) for k in ("strict_correct", "end_to_end", "conclusion_correct", "truncated")}
    return [
        n.alias("questions"),
        c["strict_correct"].alias("correct"),
        r(percent(c["strict_correct"], n)).alias("accuracy"),
        c["end_to_end"].alias("formatted_correct"),
        r(percent(c["end_to_end"], n)).alias("formatted_accuracy"),
        c["conclusion_correct"].alias("conclusion_correct"),
        r(percent(c["conclusion_correct"], n)).alias("conclusion_accuracy"),
        F.count_if(F.col("status") == "contradictory").alias("contradictions"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        c["truncated"].alias("truncated"),
        r(F.sum("tokens") / n).alias("mean_tokens"),
    ]


def histogram(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """A map from value to count for each group."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n")))).alias("histogram"))


def micro_macro(df: DataFrame, domain: str, correct: Column, by: list[str] | None = None) -> DataFrame:
    """Accuracy over all rows, and the mean of the domains' accuracies; null where empty."""
    by = by or []
    each = df.groupBy(*by, domain).agg(F.count("*").alias("n"), F.count_if(correct).alias("c"))
    return each.groupBy(*by).agg(
        F.sum("n").alias("total"),
        F.sum("c").alias("correct"),
        (F.sum("c") / F.sum("n")).alias("micro_accuracy"),
        F.avg(F.col("c") / F.col("n")).alias("average_domain_accuracy"),
    )


def error_analysis(df: DataFrame, keys: list[str], correct: Column, item: Column, review: Column) -> DataFrame:
    """Counts, accuracy and the list of failures of each class of exercises."""
    n, c = F.count("*"), F.count_if(correct)
    return df.groupBy(*keys).agg(
        n.alias("total"),
        c.alias("correct"),
        percent(c, n).alias("accuracy"),
        F.count_if(review).alias("to_review"),
        F.sort_array(F.collect_list(F.when(~correct, item))).alias("failures"),
    )


def failures(df: DataFrame, keys: list[str], correct: Column, item: str) -> DataFrame:
    """The failures of each class of exercises, numbered from 1 in the order of an integer ``item``, one a row."""
    rows = df.where(~correct).select(*keys, item)
    return numbered(rows, id_bin(item), [F.col(item)], keys, "nr")


def mean_std(df: DataFrame, group: list[str], values: list[str], runs: int | None = None) -> DataFrame:
    """Mean and sample deviation over runs; a deviation of a single run is 0.

    ``runs``: groups without exactly this many rows get ``complete`` false.
    """
    measures = [m for v in values for m in (F.avg(v).alias(f"{v}_mean"), sample_std(F.col(v)).alias(f"{v}_std"))]
    out = df.groupBy(*group).agg(F.count("*").alias("runs"), *measures)
    return out.withColumn("complete", F.col("runs") == runs) if runs else out


def group_signal(generations: DataFrame, group: str, correct: Column, reward: str) -> DataFrame:
    """What a group of generations teaches: some right and some wrong, or only format differs."""
    each = generations.groupBy(group).agg(
        F.count("*").alias("size"), F.count_if(correct).alias("correct"), F.countDistinct(reward).alias("rewards")
    )
    return each.withColumns(
        {
            "signal": (F.col("correct") > 0) & (F.col("correct") < F.col("size")),
            "all_correct": F.col("correct") == F.col("size"),
            "none_correct": F.col("correct") == 0,
            "format_only": (F.col("correct") == 0) & (F.col("rewards") > 1),
        }
    )


def signal_summary(signals: DataFrame) -> DataFrame:
    flags = ("signal", "all_correct", "none_correct", "format_only")
    return signals.agg(
        F.count("*").alias("groups"), F.sum("size").alias("generations"), F.sum("correct").alias("correct_generations"),
        *[F.count_if(F.col(f)).alias(f"{f}_groups") for f in flags],
    )


def cross_tab(df: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Counts of flags that may hold together, in one pass."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def length_stats(df: DataFrame, length: Column, keep: Column, by: list[str] | None = None) -> DataFrame:
    """Length figures of what is kept, and the share that is."""
    kept = F.when(keep, length)
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("selected"), F.count(kept).alias("kept"), F.min(kept).alias("shortest"), F.max(kept).alias("longest"),
        F.avg(kept).alias("mean_length"), (F.count(kept) / F.count("*")).alias("retention"),
    )
