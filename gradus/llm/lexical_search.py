"""Ranked lexical search: TPUT over term-partitioned postings.

The documents are tokenised once into rows of term numbers and counts (terms that no item asks for are only
counted). A second pass turns these into posting lists, sorted by impact and dealt by term; a list that
is long is cut into parts of about ``PART`` postings, so that no task holds a whole frequent term.

Three phases find the ``k`` best documents of every item, with all of a list's values known to be exact:

1. every list sends its head, the first ``k`` postings of each part; the sums of what arrives are lower bounds, and
   the k-th largest of them, tau1, bounds the k-th best score of the item from below;
2. a threshold that is the same for all lists of an item, tau1 / lists, is laid on every list, and all postings
   at or above it are sent. A document of which nothing arrives stays below tau1. For the others the sums
   are lower bounds again, and the largest value that each silent list could still hold makes upper
   bounds; documents whose upper bound is below the k-th largest lower bound are out;
3. the exact scores of the rest are looked up by document.

A posting travels once in a phase, however many items ask for its term: postings meet in buckets of ``BUCKET``
documents, and there all items are summed. Only the best of a bucket go on.

Items are worked on in blocks of at most ``MAX_PAIRS`` (item, term) pairs and ``MAX_BYTES`` bytes of terms, which the
driver holds and sends to the tasks; more items take more blocks. Statistics cover all documents.

Defined results: a null text has no terms; terms are compared after lower-casing A-Z; items without a
term, or without a document of score above 0, have no rows; items that repeat are ranked each for itself, and so
are documents that repeat a doc_id; of equal scores documents without a doc_id come last. Empty tables have no
rows. Very long texts are read whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.common import LOWER, UPPER, documents, drop_snapshot, map_batches, pieces, snapshot, table

K = 50
#: Saturation and length normalisation of the score, as its definition gives them.
SCALE, BASE, SPAN = 1_000_000_000, 100 - 50, 50
#: Documents whose postings meet in one group, and postings of a part of a list.
BUCKET = 1 << 14
PART = 1 << 16
#: Documents, and postings, that a task sorts into lists at once.
CHUNK_ROWS, CHUNK_POSTINGS = 1 << 16, 1 << 21
#: (Item, term) pairs and bytes of terms of a block of items.
MAX_PAIRS, MAX_BYTES = 1 << 20, 64 << 20
_BATCH = 4 << 20

#: Bytes that a term is made of stay, A-Z in lower case; all others part terms.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, with repeats."""
    return text.translate(_FOLD).split()


@dataclass
class Block:
    """Items that are ranked together. A list is a term's number; items are told by their place in ``items``."""

    numbers: dict[bytes, int]
    items: list[tuple]  # (row, item_id, numbers of its terms)
    weight: np.ndarray | None = None
    lowest: np.ndarray | None = None  # least and largest impact of each list
    highest: np.ndarray | None = None
    bounds: dict[int, int] = field(default_factory=dict)  # tau1 of an item
    documents: int = 0
    words: int = 0

    def lists(self, item: int) -> np.ndarray:
        """Lists of an item that can add to a score."""
        numbers = self.items[item][2]
        return numbers[(self.weight[numbers] > 0) & (self.highest[numbers] > 0)]

    def thresholds(self, item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lists, least impact that each sends, most that a posting which it does not send can add)."""
        lists = self.lists(item)
        w, tau = self.weight[lists], self.bounds.get(item, 0)
        least = np.maximum(1, -(-tau // np.maximum(1, w * len(lists))))
        silent = np.minimum((tau - 1) // max(1, len(lists)) if tau else 0, w * self.highest[lists])
        return lists, least, np.where(least <= self.lowest[lists], 0, silent)

    def sent(self) -> np.ndarray:
        """For each list the least impact that any item asks for."""
        out = np.full(len(self.numbers), np.iinfo(np.int64).max)
        for i in range(len(self.items)):
            lists, least, _ = self.thresholds(i)
            np.minimum.at(out, lists, least)
        return out


def impact(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What a term adds for each unit of its weight, in whole numbers."""
    m = BASE + (SPAN * n * documents) // words
    return (SCALE * tf) // (1000 * tf + 20 * m)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


# -- tables


def _asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(q, item_id, term) for every different term of an item; q numbers the items."""

    def cut(batches):
        for batch in pieces(batches, "text", _BATCH):
            rows = zip(batch.column("q").to_pylist(), batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
            out = [(q, i, t) for q, i, text in rows for t in sorted(set(terms(text or b"")))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())],
                ["q", "item_id", "term"],
            )

    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return map_batches(rows, cut, "q long, item_id long, term binary")


def _index(docs: DataFrame, block, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n, terms, tfs) of every document: its number of words and the counts of the terms asked for."""

    def count(batches):
        get = block.value.numbers.get
        for batch in pieces(batches, "text", _BATCH):
            n, numbers, tfs = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = terms(text.as_py() or b"")
                n.append(len(words))
                found, counts = np.unique(np.array([t for t in map(get, words) if t is not None], np.int32), return_counts=True)
                numbers.append(found)
                tfs.append(counts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), _lists(numbers, np.int32), _lists(tfs, np.int32)],
                ["row", "doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, count, "row long, doc_id long, n long, terms array<int>, tfs array<int>")


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column."""
    return column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


_POSTINGS = "term int, part int, rows array<bigint>, impacts array<int>"


def _postings(index: DataFrame, block, parts: np.ndarray, partitions: int) -> DataFrame:
    """Posting lists (term, part, rows, impacts), highest impact first, each at the partition of its term and part."""

    def sort(chunk: list[tuple]) -> pa.RecordBatch:
        row, n, size, term, tf = (np.concatenate(c) for c in zip(*chunk, strict=True))
        rows = np.repeat(row, size)
        value = impact(tf.astype(np.int64), np.repeat(n, size), block.value.documents, block.value.words)
        order = np.lexsort((rows, -value, term))
        rows, value, term = rows[order], value[order].astype(np.int32), term[order]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, int)
        heads, ends = term[starts], np.r_[starts, len(term)].astype(np.int32)
        spread = (int(row[0]) * 0x9E3779B1 >> 7) % (1 << 31)  # of a chunk; parts of a list get whole chunks
        return pa.RecordBatch.from_arrays(
            [
                pa.array(heads.astype(np.int32)), pa.array((spread % parts[heads]).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(rows)), pa.ListArray.from_arrays(pa.array(ends), pa.array(value)),
            ],
            ["term", "part", "rows", "impacts"],
        )

    def chunks(batches):
        held, rows, total = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size, term = _flat(batch.column("terms"))
            held.append((batch.column("row").to_numpy(), batch.column("n").to_numpy(), size, term, _flat(batch.column("tfs"))[1]))
            rows, total = rows + batch.num_rows, total + len(term)
            if rows >= CHUNK_ROWS or total >= CHUNK_POSTINGS:
                yield sort(held)
                held, rows, total = [], 0, 0
        if held:
            yield sort(held)

    def one(key: tuple, run: Iterator[tuple]) -> tuple:
        rows, value = (np.concatenate(c) for c in zip(*((r, v) for _, r, v in run), strict=True))
        order = np.lexsort((rows, -value))
        return *key, rows[order], value[order]

    def merge(batches):
        def blocks():
            for b in batches:
                for i in range(b.num_rows):
                    rows, value = b.column("rows")[i].values, b.column("impacts")[i].values
                    yield (b.column("term")[i].as_py(), b.column("part")[i].as_py()), rows.to_numpy(), value.to_numpy()

        held, size = [], 0
        for key, run in groupby(blocks(), key=lambda x: x[0]):
            held.append(one(key, run))
            size += len(held[-1][2])
            if size >= PART:
                yield _posting_batch(held)
                held, size = [], 0
        if held:
            yield _posting_batch(held)

    dealt = map_batches(index.select("row", "n", "terms", "tfs"), chunks, _POSTINGS).repartition(partitions, "term", "part")
    return map_batches(dealt.sortWithinPartitions("term", "part"), merge, _POSTINGS)


def _posting_batch(lists: list[tuple]) -> pa.RecordBatch:
    term, part, rows, value = zip(*lists, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(term, pa.int32()), pa.array(part, pa.int32()), _lists(list(rows), np.int64), _lists(list(value), np.int32)],
        ["term", "part", "rows", "impacts"],
    )


# -- the three phases

_SENT = "bucket long, term int, places array<int>, impacts array<int>"


def _send(postings: DataFrame, block, head: int | None) -> DataFrame:
    """What lists send, by buckets of documents: their heads, or all at or above the threshold of any item."""
    least = None if head else block.value.sent()

    def send(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                term, value = batch.column("term")[i].as_py(), batch.column("impacts")[i].values.to_numpy()
                upto = head or int(np.searchsorted(-value, -least[term], "right"))
                if not upto:
                    continue
                rows, value = batch.column("rows")[i].values.to_numpy()[:upto], value[:upto]
                bucket = rows // BUCKET
                order = np.argsort(bucket, kind="stable")  # highest first inside a bucket
                bucket, rows, value = bucket[order], rows[order], value[order]
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                for a, b in zip(starts, np.r_[starts[1:], len(rows)], strict=True):
                    out.append((int(bucket[a]), term, (rows[a:b] % BUCKET), value[a:b]))
            if out:
                b, t, rows, value = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b, pa.int64()), pa.array(t, pa.int32()), _lists(list(rows), np.int32), _lists(list(value), np.int32)],
                    ["bucket", "term", "places", "impacts"],
                )

    return map_batches(postings.select("term", "rows", "impacts"), send, _SENT)


_BOUNDS = "q int, row long, lower long, upper long"


def _bounds(sent: DataFrame, block, k: int, whole: bool) -> DataFrame:
    """(q, row, lower, upper) of documents that can be among the ``k`` best, bucket by bucket.

    With ``whole`` all that was sent counts and upper bounds are made; else, for heads, only the ``k`` largest
    lower bounds of each bucket are kept.
    """

    def add(group: pa.Table) -> pa.Table:
        block_ = block.value
        group = group.combine_chunks()
        by_term: dict[int, list] = {}
        for i in range(group.num_rows):
            pair = group.column("places")[i].values.to_numpy(), group.column("impacts")[i].values.to_numpy()
            by_term.setdefault(group.column("term")[i].as_py(), []).append(pair)
        first = group.column("bucket")[0].as_py() * BUCKET
        out = []
        for item in range(len(block_.items)):
            lists, least, silent = block_.thresholds(item)
            if not by_term.keys() & set(lists.tolist()):
                continue
            lower, heard = np.zeros(BUCKET, np.int64), np.zeros(BUCKET, np.int64)
            for t, low, rest in zip(lists.tolist(), least.tolist(), silent.tolist(), strict=True):
                for place, value in by_term.get(t, ()):
                    upto = int(np.searchsorted(-value, -low, "right")) if whole else len(value)
                    lower[place[:upto]] += block_.weight[t] * value[:upto].astype(np.int64)
                    if rest:
                        heard[place[:upto]] += rest
            upper = lower + silent.sum() - heard if whole else lower
            seen = np.flatnonzero(lower)
            kth = np.partition(lower[seen], len(seen) - k)[len(seen) - k] if len(seen) > k else 0
            rows = seen[upper[seen] >= max(kth, block_.bounds.get(item, 0))]
            out.append((np.full(len(rows), item, np.int32), rows + first, lower[rows], upper[rows]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c.astype(np.int32) if i == 0 else c) for i, c in enumerate(columns)], names=["q", "row", "lower", "upper"])

    return sent.groupBy("bucket").applyInArrow(add, _BOUNDS)


def _kth(bounds: DataFrame, k: int) -> DataFrame:
    """(q, kth): the k-th largest lower bound of each item, 0 if there are fewer."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower")))
    best = bounds.select("q", "lower", place.alias("n")).where(F.col("n") <= k)
    return best.groupBy("q").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(0).alias("kth"))


def _exact(candidates: DataFrame, index: DataFrame, block) -> DataFrame:
    """(q, item_id, doc_id, row, score) of candidates, from the counts of the documents."""

    def score(batches):
        block_ = block.value
        lists = [block_.lists(i) for i in range(len(block_.items))]
        held = np.zeros(len(block_.numbers), np.int64)
        for batch in batches:
            sizes, term = _flat(batch.column("terms"))
            tf = _flat(batch.column("tfs"))[1].astype(np.int64)
            n = batch.column("n").to_numpy()
            value = impact(tf, np.repeat(n, sizes), block_.documents, block_.words) if len(tf) else tf
            ends, out = np.cumsum(sizes), []
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("qs").to_pylist(), strict=True)
            for i, (doc_id, row, qs) in enumerate(rows):
                mine = slice(ends[i] - sizes[i], ends[i])
                held[term[mine]] = value[mine]
                for q in qs:
                    out.append((q, block_.items[q][1], doc_id, row, int((block_.weight[lists[q]] * held[lists[q]]).sum())))
                held[term[mine]] = 0
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], ["q", "item_id", "doc_id", "row", "score"]
            )

    wanted = candidates.groupBy("row").agg(F.collect_list("q").alias("qs"))  # an item once
    return map_batches(wanted.join(index, "row"), score, "q int, item_id long, doc_id long, row long, score long")


def _search_block(docs: DataFrame, pairs: list, k: int, id_col: str, text_col: str) -> DataFrame | None:
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in pairs}))}
    items = []
    for (q, item_id), run in groupby(sorted(pairs, key=lambda r: r.q), key=lambda r: (r.q, r.item_id)):
        items.append((q, item_id, np.array(sorted(numbers[bytes(r.term)] for r in run), np.int64)))
    block = Block(numbers, items)
    index = snapshot(_index(docs, send(block), id_col, text_col), "term-counts")
    block.documents, block.words = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not block.words:
        return None
    df = np.zeros(len(numbers), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a row for each term
        df[r.t] = r.n
    block.weight = weights(df, block.documents)
    postings = snapshot(_postings(index, send(block), np.maximum(1, -(-df // PART)), partitions), "postings")
    block.lowest, block.highest = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    ends = postings.groupBy("term").agg(F.min(F.element_at("impacts", -1)).alias("lo"), F.max(F.element_at("impacts", 1)).alias("hi"))
    for r in ends.collect():  # a row for each term
        block.lowest[r.term], block.highest[r.term] = r.lo, r.hi
    stats = send(block)
    heads = _bounds(_send(postings, stats, k), stats, k, False)
    tau = {r.q: r.kth for r in _kth(heads, k).collect()}  # a row for each item
    stats = send(Block(block.numbers, items, block.weight, block.lowest, block.highest, tau, block.documents, block.words))
    bounds = snapshot(_bounds(_send(postings, stats, None), stats, k, True), "bounds")
    drop_snapshot(postings)
    kept = bounds.join(_kth(bounds, k), "q").where(F.col("upper") >= F.col("kth")).select("q", "row")
    return _exact(kept, index, stats)


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", max_pairs: int = MAX_PAIRS, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score of every item."""
    spark = docs.sparkSession
    asked = snapshot(_asked(items, item_col, item_text), "asked")
    pairs, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    blocks = max(1, -(-pairs // max_pairs), -(-size // max_bytes))
    out = None
    for b in range(blocks if pairs else 0):
        mine = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # about max_pairs rows
        scored = _search_block(docs, mine, k, id_col, text_col) if mine else None
        if scored is not None:
            scored = scored.withColumn("block", F.lit(b))
            out = scored if out is None else out.unionByName(scored)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = out.where(F.col("score") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
OP12_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
d AS (SELECT r, doc_id, len(ws) AS n, ws FROM t WHERE len(ws) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
i AS (SELECT q, item_id, unnest(ws) AS term FROM (SELECT row_number() OVER () AS q, item_id, list_distinct({_WORDS}) AS ws FROM benchmark)),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * n * docs) // words) AS m FROM d, s),
f AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM f WHERE score > 0 QUALIFY rank <= {K}
"""
