"""Results kept by the digest of what they were made for; a run does only what changed.

A case is told by a digest of its content and of the protocol (evaluator, model, settings), so a result is valid
exactly as long as both are the same, and equal cases are worked on once. Results lie in ``BUCKETS`` folders by digest.
A run reads the digests it has, anti-joins the cases, works on the rest and adds files to the buckets of
new digests only; files that stand are never touched. The new files become part of the cache by one entry in a
ledger, so a run that dies adds nothing, and one that is repeated finds its work done.

Defined results: null fields are part of the content and differ from empty ones; cases that repeat get one result
each; results that the work leaves out (transient failures) are not kept, and tried again by the next run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.sources import files

BUCKETS = 64


def case_digest(protocol: str, *fields: Column) -> Column:
    """SHA-256 of the protocol and the fields; lengths are part of it, so fields can't run into each other."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(F.lit(f"{len(protocol)}:{protocol}"), *parts), 256)


@dataclass(frozen=True)
class Run:
    results: DataFrame  # every case with its result and whether it was worked on in this run (``fresh``)
    worked: int  # different digests
    buckets: int  # that got files


class ResultCache:
    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> None:
        """``schema``: of the results, without their digest."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = f"digest string, {schema}"

    def entries(self) -> list[dict]:
        """One for each run that added results, in order."""
        names = files.names(self.spark, f"{self.path}/ledger", ".json")
        return [json.loads(files.read_text(self.spark, f"{self.path}/ledger/{n}")) for n in names]

    def read(self, upto: int | None = None) -> DataFrame:
        """(digest, bucket, ...) of all results; with ``upto`` those of the first runs."""
        parts = [f"{self.path}/results/{e['name']}" for e in self.entries()[:upto] if e["rows"]]
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        frames = [self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", p).parquet(p) for p in parts]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def run(self, cases: DataFrame, digest: Column, work: Callable[[DataFrame], DataFrame]) -> Run:
        """Results of all cases. ``work`` gets the columns of one case for each new digest and ``digest``, and returns
        the digest with the result's columns."""
        before = len(self.entries())
        keyed = cases.withColumn("digest", digest)
        known = self.read().select("digest")
        new = keyed.join(known, "digest", "left_anti").dropDuplicates(["digest"])
        name = f"{before + 1:06d}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.conv(F.substring("digest", 1, 7), 16, 10).cast("int"), F.lit(self.buckets))
        done = work(new).withColumn("bucket", bucket)
        done.repartition("bucket", F.substring("digest", 9, 1)).write.partitionBy("bucket").parquet(f"{self.path}/results/{name}")
        got = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/results/{name}")
        rows, touched = got.agg(F.count("*"), F.count_distinct("bucket")).first()
        files.write_new(self.spark, f"{self.path}/ledger/{before + 1:06d}.json", json.dumps({"name": name, "rows": rows, "buckets": touched}))
        old = self.read(before).withColumn("fresh", F.lit(False))
        held = old.unionByName(got.withColumn("fresh", F.lit(True))) if rows else old
        return Run(keyed.join(held.drop("bucket"), "digest"), rows, touched)
