"""CSV with line feeds inside quoted cells, read by many tasks a file.

Whether a line begins a record depends on the number of quotes before it in the file. A first pass counts the quotes of every
block of a file, and looks whether a record begins in it for either parity; a running sum over the blocks tells which
parity holds where. In a second pass every task cuts its blocks at true record ends. What a record has in further
blocks comes as pieces, two for most blocks, which are put together by the block where the record begins.

The driver holds a row for each block, as it does for the splits of any scan. Records are not shuffled but for those
that cross a block.

Defined results: blank lines between records are skipped; in files whose lines end with CR LF, those inside cells read as
LF; a file that ends inside quotes raises when it is read; a file without a line has no records.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = "file string, record string, chain bigint, start bigint, header boolean, open boolean"


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((file, start), lines) of the blocks of a partition, one after another."""

    def lines() -> Iterator[tuple[tuple, str]]:
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("file", "start", "value"))
            yield from (((f, s), v) for f, s, v in zip(*columns, strict=True))

    for key, rows in groupby(lines(), key=lambda x: x[0]):
        yield key, (v for _, v in rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, quotes, later, cr): quotes of a block; whether a line begins a record if the block begins inside one;
    whether the first line ends with CR."""
    out = []
    for (file, start), lines in _blocks_of(batches):
        quotes, later, cr = 0, False, None
        for line in lines:
            later = later or quotes % 2 == 1
            cr = line.endswith("\r") if cr is None else cr
            quotes += line.count('"')
        out.append((file, start, quotes, later, cr))
    if out:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        names = ["file", "start", "quotes", "later", "cr"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def layout(blocks: list[tuple]) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """(begins inside quotes, block where that record begins, lines end with CR LF) of every block."""
    out: dict = {}
    for file, rows in groupby(sorted(blocks), key=lambda b: b[0]):
        inside, chain, crlf = False, 0, None
        for _, start, quotes, later, cr in rows:
            crlf = cr if crlf is None else crlf
            out[file, start] = (inside, chain, crlf)
            if later or not inside:  # a record begins here
                chain = start
            inside ^= quotes % 2 == 1
    return out


def _cut(places):
    """Whole records, and pieces of those that cross a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for (file, start), lines in _blocks_of(batches):
            inside, chain, crlf = places.value[file, start]
            held: list[str] = []
            continued, header = inside, start == 0
            for line in lines:
                line = line.removesuffix("\r") if crlf else line
                if not held and not inside and not line:
                    continue
                held.append(line)
                size += len(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    text = "\n".join(held)
                    if continued:
                        out.append((file, text, chain, start, False, False))
                    elif not header:
                        out.append((file, text, None, start, False, False))
                    held, continued, header = [], False, False
                if size > 1 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if held or inside:  # goes on in the next block; a piece may be without a line of its own
                out.append((file, "\n".join(held), chain if continued else start, start, header and not continued, True))
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    names = ["file", "record", "chain", "start", "header", "open"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def csv_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, record): the text of every record but the first one of each file."""
    lines = spark.read.option("lineSep", "\n").text(files)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    counted = lines.mapInArrow(_count, "file string, start bigint, quotes bigint, later boolean, cr boolean").collect()  # a row for each block
    places = spark.sparkContext.broadcast(layout([tuple(r) for r in counted]))
    cut = lines.mapInArrow(_cut(places), _RECORD)
    whole = cut.where(F.col("chain").isNull()).select("file", "record")
    pieces = cut.where(F.col("chain").isNotNull()).groupBy("file", "chain").agg(
        F.array_sort(F.collect_list(F.struct("start", "record", "open"))).alias("pieces"), F.max("header").alias("header")
    )  # the pieces of one record
    ended = F.when(~F.element_at("pieces", -1)["open"], True).otherwise(F.raise_error(F.concat("file", F.lit(": an open quote"))).cast("boolean"))
    joined = F.array_join(F.transform("pieces", lambda p: p["record"]), "\n")
    return whole.unionByName(pieces.where(ended).where(~F.col("header")).select("file", joined.alias("record")))
