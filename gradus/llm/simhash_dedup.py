"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in
at most three bits, one of the segments differs in at most one. So each segment is
indexed by its 32 variants in which one bit is replaced by a wildcard: two segments that
differ at bit j only are equal in variant j, and equal segments are equal in every
variant (variant 0 stands for them). An equality join on (segment, wildcard, other bits)
brings the pairs together, and the number of differing bits of the whole is verified.

Scale:

* fingerprints are made distinct first (combined map-side), so copies, however many,
  take part once;
* the join is a co-grouping on the variant key: keys are sorted, verified inside the
  task, and only links that join two classes of a bucket are emitted, never all pairs;
* a bucket of more than ``bucket_limit`` fingerprints is not compared there. Its rows are
  indexed again by the variants of the halves of the *other* segment (16 bits, then 8),
  of which one differs by at most one bit again. After the third cut at most 11 bits are
  free, so no bucket can hold more than 2,048 fingerprints: the way out is exact;
* components are found by rounds of star contraction on tables (module components).

Defined results: a null text counts as empty; texts without words have fingerprint zero
and are linked like any other; texts under ``width`` words have one shingle; repeated
rows and ties link by equality; null doc_ids are reported but never become a class id
unless a class has nothing else; very long texts are read whole; empty tables give empty
results. ``near_classes`` reads the id and ``text`` only, whatever else is named how;
``drop_near_duplicates`` keeps all columns, of which none may begin with ``__``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, map_batches, pieces, snapshot
from gradus.llm.components import components

WIDTH = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints of one bucket that are compared in a task; above it they are indexed further.
BUCKET_LIMIT = 4096

_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each bit set: runs x 64, bit 0 first."""
    ends = np.append(starts[1:], len(hashes))
    counts = np.zeros((len(starts), 64), np.int64)
    # Eight bits a word are added up at once in byte lanes; a lane holds 255 additions.
    cuts, owner = [], []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        steps = range(a, b, 255)
        cuts.extend(steps)
        owner.extend([i] * len(steps))
    owner = np.asarray(owner, np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        held = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
        sums = np.zeros((len(starts), 8), np.int64)
        np.add.at(sums, owner, held)
        counts[:, k::8] = sums
    return counts


def shingle_hashes(texts: list[str | None], width: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(hashes, starts, rows): the shingles' hashes of all texts that have words, one text after
    another, where each begins, and which text it is."""
    from xxhash import xxh64_intdigest

    parts: list[np.ndarray] = []
    starts, rows, at = [], [], 0
    for row, text in enumerate(texts):
        words = text.encode().lower().split() if text else []  # bytes: A-Z only, ASCII white space only
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            new = [xxh64_intdigest(joined, seed)]
        else:
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            new = [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]
        rows.append(row)
        starts.append(at)
        at += len(new)
        parts.append(np.asarray(new, np.uint64))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.asarray(starts, np.int64), rows


def fingerprints(texts: list[str | None], width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """One unsigned fingerprint for each text."""
    hashes, starts, rows = shingle_hashes(texts, width, seed)
    out = np.zeros(len(texts), np.uint64)
    if rows:
        counts = _bit_counts(hashes, starts)
        sizes = np.diff(np.append(starts, len(hashes)))
        bits = (2 * counts > sizes[:, None]).astype(np.uint64)
        out[rows] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            got = fingerprints(batch.column("text").to_pylist(), width, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, "text"), run, f"`{id_col}` {kind}, fp bigint")


def _index(rows: DataFrame, level: int) -> DataFrame:
    """(tag, key, fp): a row for each half of the open segment and each wildcard in it.

    ``open_at`` is the shift of the bits not yet indexed; ``tag`` chains the keys of the
    levels above.
    """
    half = [32, 16, 8][level]
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    cut = rows.select("tag", "open_at", "fp", side)
    shift = F.col("open_at") + F.col("side") * half
    value = F.expr(f"shiftrightunsigned(fp, cast(open_at + side * {half} as int)) & {(1 << half) - 1}L")
    cut = cut.select(
        "tag",
        "fp",
        shift.alias("at"),
        # the other half stays open
        (F.col("open_at") + (1 - F.col("side")) * half).alias("open_at"),
        value.alias("seg"),
        F.explode(F.sequence(F.lit(0), F.lit(half - 1))).alias("wild"),
    )
    masked = F.expr("seg & ~shiftleft(1L, wild)")
    # bits 0-31: the segment without the wildcard, 32-39: the wildcard, from 40: where the segment lies
    key = F.col("at") * F.lit(1 << 40) + F.col("wild") * F.lit(1 << 32) + masked
    return cut.select("tag", key.alias("key"), "open_at", (F.col("at") + F.col("wild")).alias("bit"), "fp")


_OUT = "a bigint, b bigint, tag bigint, open_at int"


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links left[i] - right[i] (positions in ``fps``)."""
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _links(fps: np.ndarray, bit: int, wild: int, max_bits: int) -> list[tuple[int, int]]:
    """Links inside one bucket, as a spanning forest of positions.

    Pairs that differ at the wildcard are compared here; pairs that agree there are only
    compared in variant 0 of the segment, as they share all its variants.
    """
    ones = ((fps >> np.uint64(bit)) & np.uint64(1)).astype(bool)
    zero, one = np.flatnonzero(~ones), np.flatnonzero(ones)
    found_l, found_r = [], []
    sides = [(zero, one)]
    if wild == 0:
        sides += [(zero, zero), (one, one)]
    for xs, ys in sides:
        if not len(xs) or not len(ys):
            continue
        for start in range(0, len(xs), 256):
            block = xs[start : start + 256]
            near = _popcount(fps[block][:, None] ^ fps[ys][None, :]) <= max_bits
            i, j = np.nonzero(near)
            x, y = block[i], ys[j]
            keep = x < y if xs is ys else x != y
            if keep.any():
                # the forest of a block has at most as many links as the bucket has rows
                tree = _forest(fps, x[keep], y[keep])
                found_l += [t[0] for t in tree]
                found_r += [t[1] for t in tree]
    if not found_l:
        return []
    return _forest(fps, np.asarray(found_l), np.asarray(found_r))


def _verify(limit: int, max_bits: int):
    """Walks sorted (tag, key) rows: links of ordinary buckets, rows of buckets over the limit."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(arrays, group starts) of whole buckets; a bucket over the limit may come in parts."""
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if rest is not None:
                now = [np.concatenate([r, n]) for r, n in zip(rest, now, strict=True)]
            n = len(now[0])
            if not n:
                continue
            new = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            last = int(new[-1]) if len(new) else 0
            if last:
                yield [x[:last] for x in now], np.concatenate([[0], new[:-1]])
            rest = [x[last:] for x in now]
            if len(rest[0]) > limit:
                yield rest, np.zeros(1, np.int64)
                rest = None
        if rest is not None and len(rest[0]):
            yield rest, np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = None  # the bucket over the limit that was seen last; what follows may be more of it
        for (tag, key, open_at, bit, fp), starts in groups(batches):
            ends = np.append(starts[1:], len(tag))
            sizes = ends - starts
            if (tag[0], key[0]) == over:
                sizes[0] = limit + 1
            fps = fp.view(np.uint64)
            left, right = [], []
            # Buckets of two are the bulk; they are verified in one go.
            two = starts[sizes == 2]
            x, y = fps[two], fps[two + 1]
            wild = (key[two] >> 32) & 0xFF
            differ = ((x ^ y) >> bit[two].astype(np.uint64)) & np.uint64(1)
            good = (_popcount(x ^ y) <= max_bits) & ((differ == 1) | (wild == 0))
            left.append(x[good])
            right.append(y[good])
            over_a, over_tag, over_open = [], [], []
            for s, e, size in zip(*(x[sizes > 2].tolist() for x in (starts, ends, sizes)), strict=True):
                if size > limit:
                    over = (tag[s], key[s])
                    over_a.append(fp[s:e])
                    over_tag.append(np.full(e - s, hash((int(tag[s]), int(key[s]))), np.int64))
                    over_open.append(open_at[s:e])
                    continue
                part = fps[s:e]
                found = _links(part, int(bit[s]), int((key[s] >> 32) & 0xFF), max_bits)
                if found:
                    i = np.asarray(found)
                    left.append(part[i[:, 0]])
                    right.append(part[i[:, 1]])
            a = np.concatenate(left).view(np.int64)
            b = np.concatenate(right).view(np.int64)
            n, m = len(a), sum(map(len, over_a))
            none = np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a, *over_a])),
                    pa.array(np.concatenate([b, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
                    pa.array(np.concatenate([none, *over_tag])),
                    pa.array(np.concatenate([none.astype(np.int32), *[o.astype(np.int32) for o in over_open]]).astype(np.int32)),
                ],
                names=["a", "b", "tag", "open_at"],
            )

    return run


def near_links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every class exactly."""
    if max_bits > 3:
        raise ValueError("two segments with one wildcard cover three differing bits at most")
    rows = distinct_fps.select(
        F.lit(0).cast("bigint").alias("tag"), F.lit(0).alias("open_at"), F.col("fp").cast("bigint").alias("fp")
    )
    links = []
    for level in range(3):
        index = _index(rows, level)
        dealt = index.repartition("tag", "key").sortWithinPartitions("tag", "key")
        limit = bucket_limit if level < 2 else 1 << 62  # the last level has 2,048 rows a bucket at most
        got = snapshot(dealt.mapInArrow(_verify(limit, max_bits), _OUT), f"links-{level}")
        links.append(got.where(F.col("b").isNotNull()).select("a", "b"))
        rows = got.where(F.col("b").isNull()).select("tag", "open_at", F.col("a").alias("fp"))
        if level == 2 or rows.isEmpty():
            break
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


#: Classes whose name reaches their members by broadcast, and the least members of one.
HOT_CLASSES = 4096
HOT_MEMBERS = 64


def name_classes(first: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, component_id) from (fp, __first) and the components' (vertex, root).

    Names of the ``HOT_CLASSES`` largest classes are broadcast, so a class of very many
    fingerprints does not meet in one task; members of the others join them by their root.
    """
    rooted = first.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", "__first", F.coalesce("root", "fp").alias("__root"))
    rooted = snapshot(rooted, "rooted")
    least = rooted.groupBy("__root").agg(F.min("__first").alias("__least"), F.count("*").alias("__members")).where("__members > 1")
    largest = least.where(F.col("__members") >= HOT_MEMBERS).orderBy(F.desc("__members"), "__root").limit(HOT_CLASSES)
    hot = largest.select(F.col("__root").alias("__hot"), F.col("__least").alias("__hot_least"))
    marked = rooted.join(F.broadcast(hot), F.col("__root") == F.col("__hot"), "left")  # ``HOT_CLASSES`` rows at most
    own = F.when(F.col("__hot").isNotNull(), F.col("fp")).otherwise(F.col("__root")).alias("__own")
    marked = marked.select("fp", "__first", (F.col("__hot").isNotNull()).alias("__is_hot"), "__hot_least", own)
    named = marked.join(least, F.col("__own") == F.col("__root"), "left")
    alone = F.when(F.col("__members").isNull(), F.col("__first")).otherwise(F.col("__least"))
    return named.select("fp", F.when(F.col("__is_hot"), F.col("__hot_least")).otherwise(alone).alias("component_id"))


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    width: int = WIDTH,
    seed: int = SEED,
    max_bits: int = MAX_BITS,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable."""
    prints = snapshot(with_fingerprint(docs, id_col, width, seed), "fingerprints")
    first = snapshot(prints.groupBy("fp").agg(F.min(id_col).alias("__first")), "distinct")
    named = snapshot(name_classes(first, components(near_links(first, max_bits, bucket_limit))), "classes")
    # Hot fingerprints sit on the left side only; the right side has each once, and a
    # skewed partition is split at run time.
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", classes=None, **parameters) -> DataFrame:
    """One row of each class stays: the one with the smallest id (of rows that repeat it, one).

    ``classes`` finds them: ``near_classes`` (fingerprints within ``max_bits``) or
    ``simhash_wide.similar_classes`` (shingles of a similarity). Rows without an id are compared
    too, and stay only if their class has no id.
    """
    columns = docs.columns
    keyed = docs.withColumn("__row", F.xxhash64(id_col, "text"))
    order = F.struct(F.col(id_col).isNull().alias("__none"), F.col(id_col).alias("__kid"), F.col("__row").alias("__krow"))
    found = (classes or near_classes)(keyed.select(order.alias("__id"), "text"), "__id", **parameters)
    keep = found.groupBy("component_id").agg(F.count_if(F.col("__id") == F.col("component_id")).alias("__n"))
    keep = snapshot(keep.select("component_id.__kid", "component_id.__krow", "__n"), "keep")
    same = F.col(id_col).eqNullSafe(F.col("__kid")) & (F.col("__row") == F.col("__krow"))
    stays = keyed.join(keep.select("__kid", "__krow"), same, "left_semi")
    if not keep.where("__n > 1").isEmpty():  # rows that are equal in id and text: one is enough
        stays = stays.dropDuplicates(["__row", id_col])
    return stays.select(*columns)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_classes(documents(spark, sf_dir))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes.select("doc_id", digits.alias("fingerprint"), "component_id")
