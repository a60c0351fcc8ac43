"""Binary token store: raw id payloads in shards, and a minimal perfect hash index over keys.

Shard file (little-endian): magic, raw ids one document after another, then a trailer
with the id width and count. Documents lie in ascending order of their key; shards cover
ascending ranges of keys. Ids take two bytes where the vocabulary allows it, else four.

Index: keys are dealt to files by a hash. Each file holds a minimal perfect hash (levels
of bit sets: a key sits on the first level where no other key has its bit, its slot is
the number of set bits before it) and for every slot a 32-bit fingerprint of the key, the
shard, the first id and the number of ids. A lookup reads a constant number of words,
and a key that was never stored is told apart by its fingerprint (up to 2**-32).

Writing is one range shuffle by key and one narrow pass; a repeated or lost task writes
the same file again under a name of its own and renames it. All files live in the shared
folder. They are reached through pyarrow's file systems (file, hdfs, s3, gs). The number of
shards follows the bytes of the texts, without a limit. Ranges are cut by (key, hash of the
text), so that a key which many rows repeat, or rows without a key, spread over shards.

Reading seeks to the place that the index gives and takes the bytes of the document; a shard
that is shorter than its trailer tells, or has no trailer, is an error.

Defined results: a null text counts as empty (only the end id is stored); very long texts are
encoded whole. Rows that repeat a key are all stored, told apart by ``copy`` 0, 1, ... in order
of the hash of their text, then their text; null keys come first. Empty tables give no shards.
Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import functools
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.bpe import default_path
from gradus.llm.common import documents, map_batches, pieces, release, scratch_path, snapshot
from gradus.llm.piece_table import ENTRIES, PieceTable, is_word

MAGIC = b"GRADTOK1"
TRAILER = "<8sIQ"
END_ID = 2
#: Keys of one index file, in the mean.
INDEX_KEYS = 1 << 15
#: Bits per key on each level of the minimal perfect hash.
LOAD = 2.0
#: Bytes of text that one shard takes, in the mean.
SHARD_BYTES = 32 << 20
#: Ids that are read at once where documents follow each other.
READ_IDS = 1 << 18

#: Words that go to the library in one call; what it returns takes about 2 kB a word.
ASKED = 8192
_SEP = "<|endoftext|>"


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct word (module piece_table).

    Texts are cut at blanks and line feeds, where the library's own pre-tokenizer cuts as
    well, and a full stop or comma behind letters is cut off, as it does too. The library
    ignores case, so texts that it would not change otherwise are lower-cased first. Words
    not seen before go to the library in one call.
    """

    def __init__(self, path: str, entries: int = ENTRIES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.mark = self.tool.token_to_id(_SEP)
        vocabulary = self.tool.get_vocab()
        self.type = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table = PieceTable(self._learn, entries)

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tool.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _learn(self, new: list[str]) -> list[bytes]:
        """Asks the library for the ids of ``new`` pieces, some thousands at a time."""
        return [ids for at in range(0, len(new), ASKED) for ids in self._ask(new[at : at + ASKED])]

    def _ask(self, new: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        words, odd, rest = [], [], []
        for p in new:
            (words if p.isalpha() and (p.isascii() or is_word(p)) else rest if "<" in p or "|" in p else odd).append(p)
        if words:  # letters only: each ends with the first token that has the word-end mark
            ids = np.asarray(self.tool.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.type)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            self._share(words, ids, np.concatenate([[0], cuts[:-1]]), cuts, known)
        if odd:  # parted by a special token, which none of them can hold
            ids = np.asarray(self.tool.encode_batch_fast([_SEP.join(odd)], add_special_tokens=False)[0].ids, self.type)
            cuts = np.flatnonzero(ids == self.mark)
            self._share(odd, ids, np.concatenate([[0], cuts + 1]), np.append(cuts, len(ids)), known)
        for p in rest:
            known[p] = self._ids(p)
        return [known[p] for p in new]

    def _share(self, names: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: dict[str, bytes]) -> None:
        if len(starts) != len(names):
            raise ValueError("the library joined words that blanks part")
        data, width = ids.tobytes(), self.type.itemsize
        for p, a, b in zip(names, (starts * width).tolist(), (ends * width).tolist(), strict=True):
            known[p] = data[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of ``type``."""
        return [b"".join(values) for values in self.table.look_up(texts)]


@functools.lru_cache(2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


@functools.lru_cache(8)
def _system(root: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root)
    return system, path


def _open_new(root: str, name: str):
    system, path = _system(root)
    system.create_dir(path, recursive=True)
    context = TaskContext.get()
    held = f"{path}/.{name}-{context.taskAttemptId() if context else 0}"
    return system, held, f"{path}/{name}"


# -- minimal perfect hash


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, none: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64 bits for each (key, whether it is null, copy); distinct for distinct keys of copy 0."""
    with np.errstate(over="ignore"):
        x = _mix(ids.astype(np.int64).view(np.uint64))
        y = copies.astype(np.uint64) * np.uint64(2) + none.astype(np.uint64)
        return _mix(x + y * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit hashes."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.first = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def _at(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(hashes + np.uint64(level + 1) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("keys are not distinct")
        sizes, words, left = [], [np.zeros(0, np.uint64)], hashes
        while len(left):
            size = max(64, -(-int(LOAD * len(left)) // 64) * 64)
            at = cls._at(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
            sizes.append(size)
            words.append(bits)
            left = left[~alone[at]]
        return cls(np.asarray(sizes, np.int64), np.concatenate(words))

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; some slot or -1 for a hash that is not in the set."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            at = self._at(hashes[open_], level, size)
            word = self.first[level] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            hit = ((self.words[word] >> bit) & np.uint64(1)) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class IndexFile:
    """One file of the index, in memory."""

    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as f:
            self.hash = PerfectHash(f["sizes"], f["words"])
            self.prints, self.shard, self.start, self.count = f["prints"], f["shard"], f["start"], f["count"]

    @staticmethod
    def pack(hashes: np.ndarray, shard: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
        table = PerfectHash.build(hashes)
        order = np.empty(len(hashes), np.int64)
        order[table.slot(hashes)] = np.arange(len(hashes))
        out = io.BytesIO()
        np.savez(
            out, sizes=table.sizes, words=table.words, prints=(hashes >> np.uint64(32)).astype(np.uint32)[order],
            shard=shard.astype(np.int32)[order], start=start.astype(np.int64)[order], count=count.astype(np.int64)[order],
        )
        return out.getvalue()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, first id, ids) of each hash; shard -1 where the key was never stored."""
        slot = self.hash.slot(hashes)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == (hashes[known] >> np.uint64(32)).astype(np.uint32)
        slot = np.where(known, slot, 0)
        if not len(self.shard):
            return np.full(len(hashes), -1), slot, slot
        return np.where(known, self.shard[slot], -1), self.start[slot], np.where(known, self.count[slot], 0)


@functools.lru_cache(4)
def _index_file(root: str, bucket: int) -> IndexFile:
    system, path = _system(root)
    with system.open_input_file(f"{path}/index-{bucket:05d}.npz") as f:
        return IndexFile(f.read())


class TokenStore:
    """Keyed reads from a finished store: ``store[doc_id]`` gives the ids of copy 0."""

    def __init__(self, root: str, buckets: int, width: int):
        self.root, self.buckets, self.type = root, buckets, np.dtype(f"<u{width}")

    def find(self, doc_id: int | None, copy: int = 0) -> tuple[int, int, int] | None:
        h = key_hash(np.asarray([doc_id or 0]), np.asarray([doc_id is None]), np.asarray([copy]))
        if not self.buckets:
            return None
        # A bucket without keys has no file; that every document is in the index is checked in writing.
        bucket = int(h[0] % np.uint64(self.buckets))
        system, path = _system(self.root)
        if not system.get_file_info(f"{path}/index-{bucket:05d}.npz").is_file:
            return None
        shard, start, count = _index_file(self.root, bucket).find(h)
        return None if shard[0] < 0 else (int(shard[0]), int(start[0]), int(count[0]))

    def __getitem__(self, doc_id: int | None) -> np.ndarray:
        found = self.find(doc_id)
        if found is None:
            raise KeyError(doc_id)
        shard, start, count = found
        with ShardFile(self.root, shard, self.type.itemsize) as f:
            return np.frombuffer(f.read(start, count), self.type)


class ShardFile:
    """A finished shard, read by place. Its size, magic and trailer are checked when it is opened."""

    def __init__(self, root: str, shard: int, width: int):
        system, path = _system(root)
        self.shard, self.width = shard, width
        name = f"{path}/shard-{shard:05d}.ids"
        size = system.get_file_info(name).size
        self.file = system.open_input_file(name)
        end = struct.calcsize(TRAILER)
        if size < len(MAGIC) + end or self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"shard {shard} is not a token shard")
        self.file.seek(size - end)
        magic, stored, self.ids = struct.unpack(TRAILER, self.file.read(end))
        if magic != MAGIC or stored != width or size != len(MAGIC) + self.ids * width + end:
            raise ValueError(f"shard {shard} is cut off or has other ids than its trailer tells")

    def read(self, start: int, count: int) -> bytes:
        """The bytes of ``count`` ids from ``start``."""
        if start < 0 or start + count > self.ids:
            raise ValueError(f"shard {self.shard} ends before id {start + count}")
        self.file.seek(len(MAGIC) + start * self.width)
        data = self.file.read(count * self.width)
        if len(data) != count * self.width:
            raise ValueError(f"shard {self.shard} gave {len(data)} of {count * self.width} bytes")
        return data

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> ShardFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


# -- writing and reading with Spark

_ROW = "doc_id bigint, none boolean, copy bigint, shard int, start bigint, count bigint"


def _write_shards(root: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(path)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:05d}.ids"
        out = None
        at = copy = 0
        before: object = ()
        end = np.asarray([end_id], coder.type).tobytes()
        for batch in pieces(batches, "text", 4 << 20):
            if out is None:
                system, held, final = _open_new(root, name)
                out = system.open_output_stream(held)
                out.write(MAGIC)
            ids = batch.column("doc_id").to_pylist()
            coded = coder.encode(batch.column("text").to_pylist())
            rows = []
            for doc_id, data in zip(ids, coded, strict=True):
                copy = copy + 1 if doc_id == before else 0
                before = doc_id
                count = len(data) // coder.type.itemsize + 1
                rows.append((doc_id or 0, doc_id is None, copy, shard, at, count))
                at += count
            out.write(b"".join([x for data in coded for x in (data, end)]))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "none", "copy", "shard", "start", "count"), r, strict=True)) for r in rows], schema=_SCHEMA
            )
        release()
        if out is not None:
            out.write(struct.pack(TRAILER, MAGIC, coder.type.itemsize, at))
            out.close()
            system.move(held, final)

    return run


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("none", pa.bool_()), ("copy", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("count", pa.int64())]
)


def _bucket_of(buckets: int):
    """Adds the index file of each key; the same function as a lookup uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "none", "copy")]
            bucket = (key_hash(*cols) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], names=[*batch.schema.names, "bucket"])

    return run


def _build_index(root: str):
    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy() for c in table.column_names if c != "none"}
        hashes = key_hash(cols["doc_id"], table.column("none").to_numpy(), cols["copy"])
        bucket = int(cols["bucket"][0])
        system, held, final = _open_new(root, f"index-{bucket:05d}.npz")
        with system.open_output_stream(held) as out:
            out.write(IndexFile.pack(hashes, cols["shard"], cols["start"], cols["count"]))
        system.move(held, final)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([len(hashes)], pa.int64())})

    return run


def _look_up(root: str):
    """Replaces places by those the index gives for the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "none", "copy", "bucket")}
            hashes = key_hash(cols["doc_id"], cols["none"], cols["copy"])
            shard, start, count = (np.zeros(len(hashes), np.int64) for _ in range(3))
            for bucket in np.unique(cols["bucket"]).tolist():
                own = cols["bucket"] == bucket
                shard[own], start[own], count[own] = _index_file(root, bucket).find(hashes[own])
            if (shard < 0).any():
                raise LookupError("the index does not know a key that was stored")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "none", "copy")), pa.array(shard.astype(np.int32)), pa.array(start), pa.array(count)],
                schema=_SCHEMA,
            )

    return run


def _read_back(root: str, width: int, base: np.ndarray):
    """Reads each document's ids from its shard; rows come in the order of the payload."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            shards, starts, counts = (batch.column(c).to_numpy() for c in ("shard", "start", "count"))
            crcs, held, first = [], b"", 0
            for i, (shard, start, count) in enumerate(zip(shards.tolist(), starts.tolist(), counts.tolist(), strict=True)):
                if file is None or file.shard != shard:
                    if file is not None:
                        file.close()
                    file, held = ShardFile(root, shard, width), b""
                at = (start - first) * width
                if not held or at < 0 or at + count * width > len(held):
                    # Documents that follow in the payload come with one read, of about READ_IDS ids.
                    more = count
                    for k in range(i + 1, len(shards)):
                        if shards[k] != shard or starts[k] != start + more or more + counts[k] > READ_IDS:
                            break
                        more += int(counts[k])
                    held, first, at = file.read(start, more), start, 0
                crcs.append(zlib.crc32(np.frombuffer(held, kind, count, at).astype("<u4").tobytes()))
            none = batch.column("none").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("doc_id").to_numpy(), mask=none), pa.array(base[shards] + starts), pa.array(counts),
                    pa.array(crcs, pa.int64()), batch.column("shard"),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
            )
        if file is not None:
            file.close()

    return run


def _text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts. Only the number of shards depends on it."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def _copies_over_shards(written: DataFrame, totals: list) -> DataFrame:
    """``written`` with copies of a key that goes on from one shard to the next numbered on."""
    moved, run, before = [], 0, None
    for r in sorted(totals, key=lambda r: r["shard"]):
        first, last, size = tuple(r["first"]), tuple(r["last"])[:2], r["last"]["copy"] + 1
        if before == first:
            moved.append((r["shard"], not first[0], first[1], run))
        run = run + size if before == first == last else size
        before = last
    if not moved:
        return written
    shift = written.sparkSession.createDataFrame(moved, "__shard int, __none boolean, __doc_id bigint, __shift bigint")
    on = (F.col("shard") == F.col("__shard")) & (F.col("none") == F.col("__none")) & (F.col("doc_id") == F.col("__doc_id"))
    shifted = written.join(F.broadcast(shift), on, "left")  # a row for each shard file at most
    return shifted.withColumn("copy", F.col("copy") + F.coalesce("__shift", F.lit(0))).select(*written.columns)


def write_store(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, index_keys: int = INDEX_KEYS
) -> tuple[TokenStore, DataFrame, np.ndarray]:
    """Encodes and writes ``docs`` (doc_id, text).

    Returns the store, the table of what was written (key, copy, shard, start, count,
    bucket) and the number of ids before each shard (a few bytes for each file).
    """
    spark = docs.sparkSession
    path = path or default_path()
    root = scratch_path(spark, "tokens")
    width = library_encoder(path).type.itemsize
    shards = max(spark.sparkContext.defaultParallelism, -(-_text_bytes(docs) // shard_bytes))
    order = [F.col("doc_id").asc_nulls_first(), "hash"]
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order, "text")
        .select("doc_id", "text")
    )
    written = snapshot(map_batches(ordered, _write_shards(root, path, end_id), _ROW), "written")
    stored = (~F.col("none")).alias("stored")
    totals = written.groupBy("shard").agg(
        F.sum("count").alias("ids"),
        F.count("*").alias("rows"),
        F.min(F.struct(stored, "doc_id")).alias("first"),
        F.max(F.struct(stored, "doc_id", "copy")).alias("last"),
    ).collect()  # a row for each file
    written = _copies_over_shards(written, totals)
    base = np.zeros(max([-1, *(r["shard"] for r in totals)]) + 2, np.int64)
    for r in totals:
        base[r["shard"] + 1] = r["ids"]
    buckets = -(-sum(r["rows"] for r in totals) // index_keys)
    if buckets:
        written = written.mapInArrow(_bucket_of(buckets), f"{_ROW}, bucket int")
        built = written.groupBy("bucket").applyInArrow(_build_index(root), "bucket int, keys bigint")
        if built.agg(F.sum("keys")).first()[0] != sum(r["rows"] for r in totals):
            raise RuntimeError("the index does not hold every document")
    else:
        written = written.withColumn("bucket", F.lit(0))
    return TokenStore(root, buckets, width), written, np.cumsum(base)


def read_store(store: TokenStore, written: DataFrame, base: np.ndarray) -> DataFrame:
    """One row per stored document, looked up by key in the index and read from the shards."""
    keys = written.select("doc_id", "none", "copy", "bucket").repartition("bucket")
    places = keys.mapInArrow(_look_up(store.root), _ROW)
    dealt = places.repartition("shard").sortWithinPartitions("shard", "start")
    out = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int"
    return dealt.mapInArrow(_read_back(store.root, store.type.itemsize, base), out)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(*write_store(documents(spark, sf_dir).select("doc_id", "text")))
