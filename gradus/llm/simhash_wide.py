"""Near copies by similarity: deletion-variant signatures over wide SimHash fingerprints, verified on shingles.

Texts whose word shingles have a Jaccard similarity s differ at acos(2s / (1 + s)) / pi of
their fingerprint's bits in the mean: 15 % at s = 0.8. That is far more than the three of 64
bits of exact search, so fingerprints are wider, are cut into more segments, and a pair is found where
at least one segment differs by at most one bit. Each segment is indexed by its variants with one bit
replaced by a wildcard, an equality join on (segment, wildcard, other bits) brings pairs together,
and the differing bits of the whole are compared. What passes is a candidate: pairs of similarity 0.8
pass in more than nine of ten cases, more similar ones almost always, but so do many pairs of less.

Candidates are verified: the sets of shingle hashes of two texts must have a similarity of ``SIMILARITY`` or more.
The first round takes the two closest candidates of every fingerprint; the second one those that still connect
different classes. Candidates inside a class would change nothing. Families of which only a tree was a candidate are
then compared once more, rows of different classes only: what a sketch of the sets does not rule out for certain is
verified, first one pair to connect two classes, then all pairs that still lie between classes. So every pair that
shares a bucket within the bits is verified or ends inside a class.

Scale:

* fingerprints are made distinct first (combined map-side), so equal texts take part once;
* a ``Shape`` (segments and their bits) follows the number of rows, at the same chance to find a pair: a
  segment of b bits gives buckets of about distinct fingerprints / 2**(b-1) rows, so it grows with them, and
  more segments make up for it;
* buckets are compared inside the task as the sorted rows pass by. Of up to ``ALL`` rows every pair within the bits is
  emitted, in the first bucket only that the pair shares; more rows are told apart into families that pairs within the
  bits connect. Families of up to ``ALL`` rows give every pair; larger ones a spanning tree, of close pairs
  as far as they reach, and their rows, which are compared again when their classes are known;
* a sketch holds the parity of a set's hashes in ``SKETCH`` places. Sets differ in at least as many hashes as their
  sketches differ in bits, so no pair of enough similarity is ruled out; of texts of many thousand words less is ruled out;
* a bucket of more than ``bucket_limit`` rows is dealt out again: its rows fall into chunks,
  and each pair of chunks is compared in a task of its own. No pair is left out;
* shingles are made again for texts with candidates only, one text for each fingerprint.

Defined results: a null text counts as empty; texts without words have fingerprint zero and
are one class; texts under ``width`` words have one shingle; repeated rows and ties link by
equality; very long texts are read whole; empty tables give empty results; columns of the
input other than the id and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import drop_snapshot, map_batches, pieces, release, snapshot
from gradus.llm.components import components
from gradus.llm.simhash_dedup import SEED, _bit_counts, _forest, name_classes, shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
#: Chance that a pair of just that similarity shares a bucket; and the standard deviations that its bits may exceed their mean.
FOUND, DEVIATIONS = 0.95, 2.0
#: Bits of a segment by the rows that it is meant for.
SEGMENT_BITS = ((1 << 26, 17), (1 << 31, 20), (1 << 62, 24))
#: Rows of a bucket of which all pairs within the bits are emitted, rows compared as one matrix, and
#: rows that a task compares at all.
SMALL, ALL, MATRIX, BUCKET_LIMIT = 8, 64, 256, 1 << 15
#: Bits of a sketch.
SKETCH = 2048


def differing(similarity: float) -> float:
    """Share of bits at which texts of this similarity differ in the mean."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Shape:
    """How a fingerprint is cut."""

    segment_bits: int
    segments: int

    @property
    def lanes(self) -> int:
        """Words of 64 bits of a fingerprint."""
        return -(-self.segment_bits * self.segments // 64)

    @property
    def names(self) -> list[str]:
        return [f"f{i}" for i in range(self.lanes)]

    def bits_for(self, similarity: float, deviations: float = DEVIATIONS) -> int:
        """Differing bits of texts of this similarity: the mean and so many standard deviations."""
        bits, p = 64 * self.lanes, differing(similarity)
        return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def shape_for(rows: int, similarity: float = SIMILARITY, found: float = FOUND) -> Shape:
    """Segments of a size that fits ``rows``, as many as find a pair of ``similarity`` with chance ``found``."""
    b = next(bits for most, bits in SEGMENT_BITS if rows <= most)
    p = differing(similarity)
    one = (1 - p) ** b + b * p * (1 - p) ** (b - 1)  # a segment differs by at most one bit
    return Shape(b, math.ceil(math.log(1 - found) / math.log(1 - one)))


def wide_fingerprints(texts: list[str | None], lanes: int, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Texts x lanes words of 64 bits; a bit is 1 if set in over half the shingles' hashes."""
    hashes, starts, rows = shingle_hashes(texts, width, seed)
    out = np.zeros((len(texts), lanes), np.uint64)
    if not rows:
        return out
    sizes = np.diff(np.append(starts, len(hashes)))
    places = np.arange(64, dtype=np.uint64)
    for lane in range(lanes):
        if lane:  # further hashes of a shingle are mixed from its first
            with np.errstate(over="ignore"):
                hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
                hashes = hashes ^ (hashes >> np.uint64(33))
        bits = (2 * _bit_counts(hashes, starts) > sizes[:, None]).astype(np.uint64)
        out[rows, lane] = (bits << places).sum(axis=1, dtype=np.uint64)
    return out


def with_wide_fingerprint(docs: DataFrame, id_col: str, shape: Shape, width: int, seed: int) -> DataFrame:
    """(id, th, fp, f0, ...): a hash of the text, the fingerprint as bytes and as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            got = wide_fingerprints(batch.column("text").to_pylist(), shape.lanes, width, seed)
            lanes = [pa.array(got[:, i].view(np.int64)) for i in range(shape.lanes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("th"), _as_bytes(got), *lanes], names=[id_col, "th", "fp", *shape.names])
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    lanes = ", ".join(f"{n} bigint" for n in shape.names)
    rows = docs.select(id_col, F.xxhash64("text").alias("th"), "text")
    return map_batches(rows, run, f"`{id_col}` {kind}, th bigint, fp binary, {lanes}")


def _as_bytes(rows: np.ndarray) -> pa.Array:
    size = 8 * rows.shape[1]
    flat = np.ascontiguousarray(rows).astype("<u8").tobytes()
    offsets = np.arange(0, len(flat) + 1, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _segment(shape: Shape, k: int) -> Column:
    """The bits of segment ``k`` as a long; a segment may reach from one word into the next."""
    word, shift = divmod(k * shape.segment_bits, 64)
    value = F.shiftrightunsigned(F.col(f"f{word}"), shift)
    if shift + shape.segment_bits > 64:
        value = value.bitwiseOR(F.shiftleft(F.col(f"f{word + 1}"), 64 - shift))
    return value.bitwiseAND(F.lit((1 << shape.segment_bits) - 1))


def _segment_of(words: np.ndarray, shape: Shape, k: int) -> np.ndarray:
    """The same of rows of words."""
    word, shift = divmod(k * shape.segment_bits, 64)
    value = words[:, word] >> np.uint64(shift)
    if shift + shape.segment_bits > 64:
        value = value | (words[:, word + 1] << np.uint64(64 - shift))
    return value & np.uint64((1 << shape.segment_bits) - 1)


def _index(rows: DataFrame, shape: Shape) -> DataFrame:
    """(key, f0, ...): a row for each segment and each wildcard in it."""
    cut = rows.select(*shape.names, F.posexplode(F.array(*[_segment(shape, k) for k in range(shape.segments)])).alias("at", "seg"))
    cut = cut.select(*shape.names, "at", "seg", F.explode(F.sequence(F.lit(0), F.lit(shape.segment_bits - 1))).alias("wild"))
    # bits 0-31: the segment without the wildcard, 32-39: the wildcard, from 40: which segment
    key = F.expr("shiftleft(cast(at as bigint), 40) | shiftleft(cast(wild as bigint), 32) | (seg & ~shiftleft(1L, wild))")
    return cut.select(key.alias("key"), *shape.names)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds the words."""
    out = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int16)
    for lane in range(1, x.shape[-1]):
        out += np.bitwise_count(x[..., lane] ^ y[..., lane])
    return out


def _first_shared(x: np.ndarray, y: np.ndarray, keys: np.ndarray, shape: Shape) -> np.ndarray:
    """Whether the bucket ``key`` is the first one that a pair shares."""
    at, wild = keys >> 40, (keys >> 32) & 255
    xor = x ^ y
    out = np.ones(len(keys), bool)
    for k in range(shape.segments):
        differ = _segment_of(xor, shape, k)
        # equal segments meet at every wildcard, others at the bit that differs
        out &= np.where(at == k, (wild == 0) | (differ != 0), (at < k) | (np.bitwise_count(differ) > 1))
    return out


def bucket_forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (positions) that connect all classes of the rows of one bucket.

    Up to ``MATRIX`` rows all pairs are compared at once. Above, a search walks from row to
    linked row: rows that it has reached are not compared any more, so copies by the thousand
    are done in about one step.
    """
    n = len(fps)
    if n <= MATRIX:
        i, j = np.nonzero(np.triu(_differ(fps[:, None], fps[None]) <= max_bits, 1))
        return _forest(fps, i, j) if len(i) else []
    links, left, walk = [], np.arange(n), []
    while len(left):
        if walk:
            now = walk.pop()
        else:
            now, left = int(left[0]), left[1:]
        near = _differ(fps[left], fps[now][None]) <= max_bits
        if near.any():
            reached = left[near].tolist()
            links += [(now, r) for r in reached]
            walk += reached
            left = left[~near]
    return links


def _families(rows: int, links: np.ndarray) -> list[np.ndarray]:
    """Positions of the rows that ``links`` connect, for each family of two rows or more."""
    parent = list(range(rows))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in links.tolist():
        parent[find(x)] = find(y)
    linked = np.unique(links)
    names = np.asarray([find(x) for x in linked.tolist()], np.int64)
    order = np.argsort(names, kind="stable")
    return np.split(linked[order], np.flatnonzero(np.diff(names[order])) + 1) if len(linked) else []


def _verify(limit: int, max_bits: int, close_bits: int, shape: Shape, pairs: bool):
    """Walks rows (key, f0, ...) sorted by key: links of buckets, rows of families that only a tree spans, and rows of
    buckets over the limit.

    ``pairs``: keys are those of the index, so that a pair is emitted in the first bucket only that it shares.
    """

    def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(keys, fingerprints, over): whole buckets, or a part of a bucket over the limit."""
        keys, fps, over = np.zeros(0, np.int64), np.zeros((0, shape.lanes), np.uint64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            new = np.stack([batch.column(i + 1).to_numpy().view(np.uint64) for i in range(shape.lanes)], axis=1)
            fps = np.concatenate([fps, new])
            if not len(keys):
                continue
            if over is not None:
                at = int(np.searchsorted(keys, over, side="right"))
                if at:
                    yield keys[:at], fps[:at], True
                    keys, fps = keys[at:], fps[at:]
                if not len(keys):
                    continue
                over = None
            at = int(np.searchsorted(keys, keys[-1]))
            if at:
                yield keys[:at], fps[:at], False
                keys, fps = keys[at:], fps[at:]
            if len(keys) > limit:
                over = keys[0]
                yield keys, fps, True
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield keys, fps, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps, over in whole_buckets(batches):
            if over:
                yield _links_out(fps, None, keys, shape)
                continue
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            sizes = np.diff(np.append(starts, len(keys)))
            left, right = [], []

            def add(i: np.ndarray, j: np.ndarray, keys=keys, fps=fps, left=left, right=right) -> None:
                near = _differ(fps[i], fps[j]) <= max_bits
                i, j = i[near], j[near]
                if pairs:
                    first = _first_shared(fps[i], fps[j], keys[i], shape)
                    i, j = i[first], j[first]
                left.append(fps[i])
                right.append(fps[j])

            # Small buckets, which are the bulk, are compared all at once.
            small = np.repeat(sizes <= SMALL, sizes)
            for step in range(1, SMALL):
                i = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:])) if len(keys) > step else np.zeros(0, np.int64)
                if not len(i):
                    break
                add(i, i + step)
            large = sizes > SMALL
            for start, size in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
                if size > limit:
                    yield _links_out(fps[start : start + size], None, keys[start : start + size], shape)
                    continue
                if size <= ALL:
                    i, j = np.triu_indices(size, 1)
                    add(i + start, j + start)
                    continue
                bucket = fps[start : start + size]
                for family in _families(size, np.asarray(bucket_forest(bucket, max_bits), np.int64).reshape(-1, 2)):
                    if len(family) <= ALL:
                        i, j = np.triu_indices(len(family), 1)
                        add(family[i] + start, family[j] + start)
                        continue
                    part = bucket[family]
                    found = np.asarray([*bucket_forest(part, close_bits), *bucket_forest(part, max_bits)], np.int64)
                    found = np.asarray(_forest(part, found[:, 0], found[:, 1]), np.int64)  # close pairs first
                    left.append(part[found[:, 0]])
                    right.append(part[found[:, 1]])
                    yield _links_out(part, None, np.full(len(part), keys[start]), shape, True)
            if left:
                yield _links_out(np.concatenate(left), np.concatenate(right), None, shape)

    return run


def _links_out(a: np.ndarray, b: np.ndarray | None, keys: np.ndarray | None, shape: Shape, spanned: bool = False) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [
            _as_bytes(a),
            pa.nulls(n, pa.binary()) if b is None else _as_bytes(b),
            pa.nulls(n, pa.int32()) if b is None else pa.array(_differ(a, b).astype(np.int32)),
            pa.nulls(n, pa.int64()) if keys is None else pa.array(keys),
            pa.array(np.full(n, spanned)),
            *[pa.array(np.ascontiguousarray(a[:, i]).view(np.int64)) if b is None else pa.nulls(n, pa.int64()) for i in range(shape.lanes)],
        ],
        names=["a", "b", "bits", "key", "spanned", *shape.names],
    )


def similar_links(distinct: DataFrame, shape: Shape, max_bits: int, close_bits: int, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Candidates (a, b, bits) between distinct fingerprints (fp, f0, ...), a below b; both are fingerprints as bytes."""
    return _candidates(distinct, shape, max_bits, close_bits, bucket_limit)[0]


def _candidates(distinct: DataFrame, shape: Shape, max_bits: int, close_bits: int, bucket_limit: int) -> tuple[DataFrame, DataFrame]:
    """The candidates, and (key, fp, f0, ...) of families whose candidates only span them: rows of a key belong together."""
    out = "a binary, b binary, bits int, key bigint, spanned boolean, " + ", ".join(f"{n} bigint" for n in shape.names)
    dealt = _index(distinct, shape).repartition("key").sortWithinPartitions("key")
    got = snapshot(dealt.mapInArrow(_verify(bucket_limit, max_bits, close_bits, shape, True), out), "wide-links")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits"]
    links = got.where(F.col("b").isNotNull()).select(*pair)
    crowd = ["key", F.col("a").alias("fp"), *shape.names]
    crowds = got.where("spanned").select(*crowd)
    over = got.where(F.col("b").isNull() & ~F.col("spanned")).select("key", *shape.names)
    if over.isEmpty():
        return links.distinct(), crowds
    # Chunks of about half the limit; every pair of chunks of a bucket meets in one place.
    sizes = over.groupBy("key").agg(F.ceil(F.count("*") / (bucket_limit / 2)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64(*shape.names), F.col("chunks")).cast("int")
    rows = over.join(sizes, "key").withColumn("own", chunk)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    place = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(place.alias("key"), *shape.names).repartition("key").sortWithinPartitions("key")
    more = snapshot(rows.mapInArrow(_verify(1 << 62, max_bits, close_bits, shape, False), out), "wide-links-over")
    return links.unionByName(more.where(F.col("b").isNotNull()).select(*pair)).distinct(), crowds.unionByName(more.where("spanned").select(*crowd))


# -- verification


def _shingle_sets(docs: DataFrame, id_col: str, wanted: DataFrame, width: int, seed: int) -> DataFrame:
    """(fp, shingles, sketch): the different shingle hashes of one text for each of the ``wanted`` (fp, id, th)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            sets = [np.unique(shingle_hashes([t], width, seed)[0]).view(np.int64) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), lists, _as_bytes(_sketches(sets))], names=["fp", "shingles", "sketch"])
        release()

    keys = wanted.select("fp", F.col("id").alias("__id"), F.col("th").alias("__th"))
    rows = docs.select(F.col(id_col).alias("__key"), F.xxhash64("text").alias("th"), "text")
    # rows that repeat an id and text are left out before shingles are made
    found = rows.join(keys, (F.col("th") == F.col("__th")) & F.col("__key").eqNullSafe(F.col("__id"))).select("fp", "text").dropDuplicates(["fp"])
    return map_batches(found, run, "fp binary, shingles array<bigint>, sketch binary")


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x words of 64 bits: whether an odd number of a set's hashes falls to a place."""
    odd = np.zeros((len(sets), SKETCH), np.uint8)
    for row, hashes in zip(odd, sets, strict=True):
        row[:] = np.bincount(hashes & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd, axis=1, bitorder="little").view("<u8").reshape(len(sets), SKETCH // 64)


def _between(max_bits: int, similarity: float, shape: Shape, span: bool):
    """Walks rows (key, fp, f0, ..., root, n, sketch) sorted by key: pairs (a, b) of rows of one key and different
    roots that may be similar; ``span``: only so many as connect the roots."""
    share = (1 - similarity) / (1 + similarity)  # of the sizes of two sets: the hashes that they may differ in

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            keys = rest.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()]
            for start, end in zip(cuts, cuts[1:], strict=False):
                yield rest.slice(start, end - start)
            rest = rest.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole(batches):
            _, roots, members = np.unique(np.asarray(rows.column("root").to_pylist(), object), return_inverse=True, return_counts=True)
            if len(members) == 1:
                continue
            fps = np.stack([rows.column(n).to_numpy().view(np.uint64) for n in shape.names], axis=1)
            sizes = rows.column("n").to_numpy().astype(np.int64)
            sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u8").reshape(len(fps), -1)
            most = int(members.argmax())  # rows of the largest class are not compared with each other
            joined: list[np.ndarray] = []
            for x in np.flatnonzero(roots != most).tolist():
                near = (roots != roots[x]) & (_differ(fps, fps[x][None]) <= max_bits)
                near[:x] &= roots[:x] == most
                y = np.flatnonzero(near)
                y = y[np.minimum(sizes[y], sizes[x]) + 1e-9 >= similarity * np.maximum(sizes[y], sizes[x])]
                y = y[_differ(sketches[y], sketches[x][None]) <= share * (sizes[y] + sizes[x]) + 1e-6]
                if not len(y):
                    continue
                if span:  # one row of each root, and the roots are one from here on
                    y = y[np.unique(roots[y], return_index=True)[1]]
                    one = [roots[x], *roots[y]]
                    roots = np.where(np.isin(roots, one), most if most in one else roots[x], roots)
                joined.append(np.stack([np.full(len(y), x), y]))
            if joined:
                i, j = np.concatenate(joined, axis=1)
                yield pa.RecordBatch.from_arrays([_as_bytes(fps[i]), _as_bytes(fps[j])], names=["a", "b"])

    return run


def _verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose texts are as similar as asked for."""
    side = lambda n: sets.select(F.col("fp").alias(n), F.col("shingles").alias(f"{n}_set"))
    met = links.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    small, large = F.least(F.size("a_set"), F.size("b_set")), F.greatest(F.size("a_set"), F.size("b_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    alike = common + 1e-9 >= similarity * (F.size("a_set") + F.size("b_set") - common)
    return met.where(small >= similarity * large).where(alike).select("a", "b")


def similar_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    width: int = WIDTH,
    similarity: float = SIMILARITY,
    seed: int = SEED,
    bucket_limit: int = BUCKET_LIMIT,
    shape: Shape | None = None,
) -> DataFrame:
    """(id, component_id) for every row; component_id is the smallest id reachable over links of that similarity."""
    shape = shape or shape_for(docs.count(), similarity)
    prints = snapshot(with_wide_fingerprint(docs, id_col, shape, width, seed), "wide-fingerprints")
    least = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "th")).alias("one")
    first = snapshot(prints.groupBy("fp", *shape.names).agg(least).select("fp", *shape.names, "one.id", "one.th"), "wide-distinct")
    close = shape.bits_for((1 + similarity) / 2)
    max_bits = shape.bits_for(similarity)
    links, crowds = _candidates(first, shape, max_bits, close, bucket_limit)
    links = snapshot(links, "candidates")
    ends = links.select(F.col("a").alias("fp")).unionByName(links.select(F.col("b").alias("fp"))).distinct()
    sets = snapshot(_shingle_sets(docs, id_col, first.join(ends, "fp", "left_semi"), width, seed), "shingles")

    both = links.select(F.col("a").alias("v"), "a", "b", "bits").unionByName(links.select(F.col("b").alias("v"), "a", "b", "bits"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("bits", "a", "b"))
    closest = both.withColumn("n", place).where(F.col("n") <= 2).select("a", "b").distinct()
    sure = snapshot(_verified(closest, sets, similarity), "verified")
    root = components(sure)
    named = lambda n: root.select(F.col("vertex").alias(n), F.col("root").alias(f"{n}_root"))
    open_ = links.select("a", "b").join(named("a"), "a", "left").join(named("b"), "b", "left")
    apart = open_.where(~F.coalesce("a_root", "a").eqNullSafe(F.coalesce("b_root", "b"))).join(closest, ["a", "b"], "left_anti")
    more = snapshot(_verified(apart, sets, similarity), "verified-more")
    verified, spare = sure, [links, sets, sure, more]
    if not more.isEmpty():
        verified = sure.unionByName(more)
        root = components(verified)
    if not crowds.isEmpty():
        sketches = sets.select("fp", F.size("shingles").alias("n"), "sketch")
        known = crowds.join(sketches, "fp")  # rows without any candidate have no sketch
        columns, tested = ["key", *shape.names, "root", "n", "sketch"], links.select("a", "b")
        for span in (True, False):
            rooted = known.join(root.select(F.col("vertex").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
            dealt = rooted.select(*columns).repartition("key").sortWithinPartitions("key")
            pairs = map_batches(dealt, _between(max_bits, similarity, shape, span), "a binary, b binary")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
            pairs = snapshot(pairs, "crowd-pairs")
            found = snapshot(_verified(pairs, sets, similarity), "crowd-verified")
            tested = tested.unionByName(pairs)
            spare += [pairs, found]
            if not found.isEmpty():
                verified = verified.unionByName(found)
                root = components(verified)
    classes = snapshot(name_classes(first.select("fp", F.col("id").alias("__first")), root), "wide-classes")
    for table in spare:
        drop_snapshot(table)
    # Hot fingerprints sit on the left side only; a skewed partition is split at run time.
    return prints.select(id_col, "fp").join(classes, "fp").select(id_col, "component_id")
