"""What the corpus operators share: tables, the shared folder, snapshots, text helpers."""

from __future__ import annotations

import atexit
import ctypes
import getpass
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the
    session is local (tests) a folder of this machine takes its place. On a cluster
    without that setting an error is raised, as executors could not see the folder.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir")
    if not where:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        where = f"file://{tempfile.gettempdir()}/gradus-{getpass.getuser()}"
        context.setCheckpointDir(where)
    return where.rstrip("/")


def _delete(context, path: str) -> None:
    try:
        hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/gradus/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark.sparkContext, path)
    return path


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and
    executors that are lost take nothing with them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_snapshot(df: DataFrame) -> None:
    """Removes a snapshot that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark.sparkContext, path)


#: Bytes of rows that go to a Python worker at once. Spark's own limits (64 MB, 10,000 rows) are
#: held several times, by the executor and by each of its workers.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of ``BATCH_BYTES`` at most, however long texts are.

    The limit is a setting of the session, and stays; one that is lower already is kept.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", spark.conf.get(name).strip().lower()).groups()
    held = int(number) * 1024 ** "bkmgtp".index(unit[0] if unit else "b")
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes in each (one row at least).

    Freed memory is given back at the start, as the worker may have run another stage, and
    after every ``limit`` * 16 bytes.
    """
    release()
    passed = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                passed += held
                start, held = i, 0
            held += size
        yield batch.slice(start)
        passed += held
        if passed > 16 * limit:
            release()
            passed = 0


def sample_labelled(spark: SparkSession, sf_dir: str, label: str, rows: int, max_bytes: int) -> list:
    """Texts and labels to learn from: at most ``rows`` labelled documents of at most
    ``max_bytes`` bytes, chosen by a hash of doc_id among those whose
    crc32(doc_id as text) mod 5 is not 0. Nothing but text and label is returned.

    A doc_id that has several labels counts with the largest; one that has several texts
    counts with one of them (the least by hash, then by text), so at most ``rows`` texts
    come to the driver however often an id is repeated.
    """
    key = F.col("doc_id").cast("string")
    chosen = (
        table(spark, sf_dir, "labels")
        .where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(key) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = documents(spark, sf_dir).select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
    found = texts.join(F.broadcast(chosen), "doc_id")  # chosen has ``rows`` rows at most
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")  # combined before the shuffle
    got = found.groupBy("doc_id", "label").agg(one).select("doc_id", "one.text", "label").collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: r["doc_id"])]


def held_out() -> Column:
    """True for documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
