"""A log with versions: immutable segments, and a manifest for every state it had.

A manifest names the segments of a version with their rows and range of steps. Appending, cutting back to a
checkpoint and repairing write new segments where rows change, keep all others by name, and publish a new manifest by
one rename; nothing is rewritten in place. A change that fails leaves the version before as it was, and
every version stays readable until ``expire`` removes what no kept version names.

Cutting back reads only the one segment that lies across the checkpoint (and those whose ranges overlap it); repairing
rewrites only segments that hold bad rows. Two writers that start from the same version can't both publish.

Defined results: rows without a step are never cut back; a predicate that is null is not bad; an empty table makes an
empty segment; a log without a version reads as an empty table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.sources import files

_MANIFEST = "version bigint, kind string, checkpoint bigint, segments array<struct<name:string,rows:bigint,low:bigint,high:bigint>>"


class VersionedLog:
    def __init__(self, spark: SparkSession, path: str, schema: str, step: str) -> None:
        self.spark, self.path, self.schema, self.step = spark, path.rstrip("/"), schema, step

    # -- versions

    def versions(self) -> list[int]:
        return [int(n[: -len(".json")]) for n in files.names(self.spark, f"{self.path}/manifests", ".json")]

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, or the last one; that of an empty log is version 0."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "kind": "empty", "checkpoint": None, "segments": []}
        if version not in known:
            raise ValueError(f"no version {version}")
        return json.loads(files.read_text(self.spark, f"{self.path}/manifests/{version:012d}.json"))

    def _publish(self, before: dict, kind: str, segments: list[dict], checkpoint: int | None) -> int:
        version = before["version"] + 1
        text = json.dumps({"version": version, "kind": kind, "checkpoint": checkpoint, "segments": segments})
        files.write_new(self.spark, f"{self.path}/manifests/{version:012d}.json", text)
        return version

    def history(self) -> DataFrame:
        """(version, kind, checkpoint, segments, rows, kept): ``kept`` segments were taken over from the version before."""
        if not self.versions():
            return self.spark.createDataFrame([], "version bigint, kind string, checkpoint bigint, segments int, rows bigint, kept int")
        m = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/*.json")
        before = m.select((F.col("version") + 1).alias("version"), F.col("segments.name").alias("names"))
        names = F.coalesce("names", F.array().cast("array<string>"))
        return m.join(before, "version", "left").select(
            "version", "kind", "checkpoint", F.size("segments").alias("segments"),
            F.aggregate("segments", F.lit(0).cast("bigint"), lambda a, s: a + s["rows"]).alias("rows"),
            F.size(F.array_intersect(F.col("segments.name"), names)).alias("kept"),
        )

    # -- segments

    def _write(self, rows: DataFrame) -> list[dict]:
        """A new segment, unless it has no rows."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/segments/{name}")
        written = self._segment(name).agg(F.count("*").alias("rows"), F.min(self.step).alias("low"), F.max(self.step).alias("high")).first()
        return [{"name": name, **written.asDict()}] if written.rows else []

    def _segment(self, *names: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/segments/{n}" for n in names])

    def read(self, version: int | None = None, before: int | None = None) -> DataFrame:
        """The table as of a version; with ``before`` only steps below it, from segments that can have some."""
        segments = self.manifest(version)["segments"]
        if before is not None:
            segments = [s for s in segments if s["low"] is not None and s["low"] < before]
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        rows = self._segment(*[s["name"] for s in segments])
        return rows if before is None else rows.where(F.col(self.step) < before)

    # -- changes

    def append(self, rows: DataFrame) -> int:
        """A new version with these rows behind the others; its checkpoint is the step after the last one."""
        now = self.manifest()
        new = self._write(rows)
        tops = [s["high"] for s in now["segments"] + new if s["high"] is not None]
        return self._publish(now, "append", now["segments"] + new, max(tops) + 1 if tops else None)

    def roll_back(self, checkpoint: int | None) -> int:
        """A new version without steps at or after the checkpoint. A log with rows and no checkpoint raises."""
        now = self.manifest()
        if checkpoint is None:
            if now["segments"]:
                raise ValueError("there is a log, but no checkpoint it could belong to")
            return now["version"]
        kept, cut = [], []
        for s in now["segments"]:
            (kept if s["high"] is None or s["high"] < checkpoint else cut).append(s)
        for s in cut:
            stays = F.coalesce(F.col(self.step) < checkpoint, F.lit(True))
            if s["low"] < checkpoint or self._segment(s["name"]).where(F.col(self.step).isNull()).limit(1).count():
                kept += self._write(self._segment(s["name"]).where(stays))
        return self._publish(now, "rollback", kept, checkpoint)

    def repair(self, bad: Column) -> int:
        """A new version without the bad rows, which the version before still has (to be done again)."""
        now = self.manifest()
        if not now["segments"]:
            return now["version"]
        bad = F.coalesce(bad, F.lit(False))
        where = F.regexp_extract(F.col("_metadata.file_path"), "/segments/([0-9a-f]+)/", 1)
        hit = self._segment(*[s["name"] for s in now["segments"]]).where(bad).select(where.alias("name")).distinct()
        touched = {r.name for r in hit.collect()}  # segments at most
        kept = []
        for s in now["segments"]:
            kept += self._write(self._segment(s["name"]).where(~bad)) if s["name"] in touched else [s]
        return self._publish(now, "repair", kept, now["checkpoint"])

    def expire(self, keep: int) -> int:
        """Forgets all versions but the last ``keep``, then deletes segments that none of these names."""
        if keep < 1:
            raise ValueError("at least the last version is kept")
        known = self.versions()
        named = {s["name"] for v in known[-keep:] for s in self.manifest(v)["segments"]}
        for v in known[:-keep]:
            files.delete(self.spark, f"{self.path}/manifests/{v:012d}.json")
        lost = [n for n in files.names(self.spark, f"{self.path}/segments") if n not in named]
        for name in lost:
            files.delete(self.spark, f"{self.path}/segments/{name}")
        return len(lost)
