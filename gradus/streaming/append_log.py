"""An append log that holds every record once, whatever is killed or repeated.

A batch is a segment (a Parquet table in a folder of its own) and an entry in the ledger, a small file
that names it. The entry is published by one rename: a segment without one is not part of the log, so
a writer that dies leaves the log as it was, and a batch whose entry stands is not written again.

``run_available`` is the streaming writer: the checkpoint holds which input belongs to which batch, the state store
which ids were seen, the ledger which batches stand. Of these any may be ahead when the writer is killed.
After a restart Spark repeats the open batch with its number and its input; the ledger turns a batch that
was published already into none.

Defined results: an id counts once, with the first record that came (of several in one batch, any of them); records
without an id are one id; an empty batch has an entry and no rows. An event time bounds the state: ids are
forgotten when they are ``late``, so a repetition must come within that time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradus.sources import files
from gradus.streaming.resume import deduplicated_stream

_ENTRY = "batch bigint, run string, segment string, rows bigint"


class AppendLog:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.columns = spark.createDataFrame([], schema).columns

    def _entry(self, number: int) -> str:
        return f"{self.path}/ledger/{number:012d}.json"

    def committed(self) -> set[int]:
        """Numbers of the batches that stand."""
        return {int(n[: -len(".json")]) for n in files.names(self.spark, f"{self.path}/ledger", ".json")}

    def ledger(self) -> DataFrame:
        """(batch, run, segment, rows) of every batch that stands."""
        if not self.committed():
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).json(f"{self.path}/ledger/*.json")

    def publish(self, batch: DataFrame, number: int, run: str = "", before_entry: Callable[[], None] | None = None) -> bool:
        """Adds a batch; False if it stands already. ``before_entry`` is called between the segment and its entry."""
        if number in self.committed():
            return False
        segment = f"segments/{number:012d}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/{segment}")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{segment}").count()
        if before_entry:
            before_entry()
        try:
            files.write_new(self.spark, self._entry(number), json.dumps({"batch": number, "run": run, "segment": segment, "rows": rows}))
        except FileExistsError:  # another writer was faster; this segment is nobody's
            files.delete(self.spark, f"{self.path}/{segment}")
            return False
        return True

    def read(self) -> DataFrame:
        """All records of the batches that stand."""
        segments = [f"{self.path}/{r.segment}" for r in self.ledger().select("segment").collect()]  # one for each batch
        return self.spark.read.schema(self.schema).parquet(*segments) if segments else self.spark.createDataFrame([], self.schema)

    def sweep(self) -> int:
        """Deletes segments that no entry names; only while no writer is at work. Returns their number."""
        named = {r.segment.split("/")[1] for r in self.ledger().select("segment").collect()}
        lost = [n for n in files.names(self.spark, f"{self.path}/segments") if n not in named]
        for name in lost:
            files.delete(self.spark, f"{self.path}/segments/{name}")
        return len(lost)


def run_available(
    stream: DataFrame,
    log: AppendLog,
    checkpoint: str,
    key: str,
    run: str = "",
    event_time: str | None = None,
    late: str = "1 hour",
    before_entry: Callable[[int], None] | None = None,
    after_entry: Callable[[int], None] | None = None,
) -> None:
    """Appends all that ``stream`` has now, each ``key`` once, and ends.

    The two calls, with the number of the batch, stand where a writer can be killed: before an entry is
    published, and before Spark notes that the batch is done.
    """
    unique = deduplicated_stream(stream, key, event_time, late)

    def write(batch: DataFrame, number: int) -> None:
        if number in log.committed():  # run for the state store alone, which has to follow
            batch.write.format("noop").mode("overwrite").save()
        log.publish(batch.select(*log.columns), number, run, before_entry and (lambda: before_entry(number)))
        if after_entry:
            after_entry(number)

    query = unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def resume_log(expected: DataFrame, log: AppendLog, key: str, number: int, work: Callable[[DataFrame], DataFrame]) -> bool:
    """Does the work that the log lacks and appends it as batch ``number``."""
    missing = expected.join(log.read().select(key), key, "left_anti")
    return log.publish(work(missing), number)
