"""Resumable work: append-only logs, anti-join resume, rollback, running state.

The reference semantics are a log of finished units; each id counts once, the last record
of an id wins, and a log can be cut back to a checkpoint. The streaming forms do the same
continuously with Structured Streaming; event-time windows are extensions of our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions.classify import TRANSIENT
from gradus.operators.joins import remaining


def last_record(log: DataFrame, key: str, order: str) -> DataFrame:
    """One record for each id: the last one written. Of records with the same ``order`` the one
    with the largest hash of all its columns is taken, whole."""
    others = [c for c in log.columns if c != key]
    tie = F.xxhash64(*[c for c, t in log.dtypes if "map<" not in t])
    best = log.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(order), tie)).alias("__last"))
    return best.select(*[key if c == key else F.col("__last")[c].alias(c) for c in log.columns])


def persistable(results: DataFrame, status: str = "status") -> DataFrame:
    """Results worth keeping; transient failures are left out, so the next run retries them."""
    return results.where(~F.col(status).isin(*TRANSIENT))


def resume(expected: DataFrame, log: DataFrame, key: str, order: str, work) -> DataFrame:
    """The complete table: what the log has, and ``work`` applied to what it lacks."""
    done = last_record(log, key, order)
    fresh = persistable(work(remaining(expected, done, key)))
    return done.unionByName(fresh, allowMissingColumns=True)


def roll_back(log: DataFrame, step: str, checkpoint: int | None) -> DataFrame:
    """Records before a checkpoint; a log without a checkpoint raises."""
    if checkpoint is None:
        raise ValueError("there is a log, but no checkpoint it could belong to")
    return log.where(F.col(step) < checkpoint)


def repair(log: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(records to keep, ids to do again)."""
    return log.where(~F.coalesce(bad, F.lit(False))), log.where(bad).select("id").distinct()


def valid_cache(results: DataFrame, cases: DataFrame, key: str, digest: str) -> DataFrame:
    """Cached results whose case still has the digest they were made for."""
    return results.join(cases.select(key, digest), [key, digest], "left_semi")


def running_state(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Best value so far and before, and the number of events, at each step."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumns({"best": F.max(value).over(upto), "best_before": F.max(value).over(before), "seen": F.count("*").over(upto)})


# -- continuous forms


def read_log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def deduplicated_stream(stream: DataFrame, key: str, event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each id once; with an event time, state older than ``late`` is forgotten."""
    if event_time:
        return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str = "batch"):
    """Writes each micro-batch once: a batch that is repeated replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/{key}={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def window_counts(events: DataFrame, time: str, size: str, slide: str | None = None, by: list[str] | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding windows of event time; the same for tables and streams."""
    df = events.withWatermark(time, late) if late else events
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(window.alias("w"), *(by or [])).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []), "events", "total")


def session_counts(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    df = events.withWatermark(time, late) if late else events
    out = df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "events")


def best_so_far_stream(stream: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the best value and the number of records so far; written in update mode. NaN is no value."""
    number = F.col(value).cast("double")
    return stream.groupBy(key).agg(F.max(F.when(~F.isnan(number), number)).alias("best"), F.count("*").alias("seen"))
