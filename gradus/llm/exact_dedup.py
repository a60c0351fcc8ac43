"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Lengths are counted first, map-side, and those that several rows have are sent to all tasks: a row whose
length no other has is done, nothing of its text is hashed. Of the others the prefix is hashed, and only rows
that share length *and* prefix go on to the full hash, which is made where the text lies; a text is
never shuffled, rows travel as keys of a few bytes. Texts of ``LONGEST`` bytes and more skip the first level, which
so has ``LONGEST`` lengths at most.

Which keys are shared is told by a bit map over hashes of (length, prefix), built map-side
and sent to all tasks. It has ``BITS_A_ROW`` bits for each row, ``MAX_BITS`` (32 MB) at
most: a row with a shared key always has its bit, so no group is lost at any size; a row
without one goes on only if it falls on the bit of another key, and then forms a group of its
own. Nothing is switched off when keys grow in number, the part of such rows grows slowly.

Of groups of equal texts those of ``HOT_ROWS`` and more rows, the ``HOT_GROUPS`` largest at
most, reach their rows by broadcast. Each other group has either fewer than ``HOT_ROWS`` rows
or at most one in ``HOT_GROUPS`` of all, so no task of the join that takes these gets a hot key.

Defined results: a null text counts as empty; texts are equal when identical after
lower-casing A-Z; of equal texts the row with the largest doc_id stays (null doc_ids
only when all are null); rows that repeat a doc_id are each reported with the same
verdict. Empty tables give empty results; very long texts are digested whole. Other columns
are passed on untouched, but for columns of the input that are named like a result
(``keep_id``, ``group_size``, ``kept``) or begin with ``__``: those are replaced or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import LOWER, UPPER, ascii_lower, documents, snapshot

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 128
#: Bits of the map of shared keys: for each row, and of the whole map (32 MB) at most.
BITS_A_ROW = 8
MAX_BITS = 1 << 28
#: Groups whose verdict reaches the rows by broadcast (about 60 bytes each), and their least size.
HOT_GROUPS = 4096
HOT_ROWS = 64

#: Lengths from here on all count as shared.
LONGEST = 1 << 20

_WORD = 1 << 15  # bits that Spark's bitmap functions put in one row


def _norm():
    return ascii_lower(F.coalesce(F.col("text"), F.lit("")))


def _full_hash():
    """SHA-256 of the whole normalised text."""
    return F.sha2(_norm(), 256)


def _bit(bits: int) -> Column:
    """The place of a row's (length, prefix) in a map of ``bits`` bits, a power of two."""
    return F.xxhash64("__len", "__pre").bitwiseAND(F.lit(bits - 1))


def _shared_keys(keyed: DataFrame, bits: int) -> DataFrame:
    """(__at, __map): rows of the bit map of keys that several rows have."""
    # Counted map-side first, so a hot key is one row a task.
    pairs = keyed.groupBy("__len", "__pre").agg(F.count("*").alias("__n")).where("__n > 1")
    place = pairs.select(_bit(bits).alias("__b"))
    rows = place.groupBy(F.floor(F.col("__b") / _WORD).cast("long").alias("__at"))
    return rows.agg(F.bitmap_construct_agg((F.col("__b") % _WORD).cast("long")).alias("__map"))


def _has_bit(bits: int) -> Column:
    """Whether the joined map has the row's bit."""
    at = (_bit(bits) % _WORD).cast("int")
    byte = F.conv(F.hex(F.substring("__map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.expr("1") == F.call_function("getbit", byte, at % 8), F.lit(False))


def candidates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without its text, with ``__len``, ``__pre`` of rows that share it, and the full hash of rows that share both."""
    sized = docs.withColumn("__len", F.octet_length(F.coalesce(F.col("text"), F.lit(""))))  # lower case has the same
    lengths = sized.where(F.col("__len") < LONGEST).groupBy(F.col("__len").alias("__l")).agg(F.count("*").alias("__n")).where("__n > 1")
    marked = sized.join(F.broadcast(lengths.select("__l")), F.col("__len") == F.col("__l"), "left")  # LONGEST rows at most
    shared = F.col("__l").isNotNull() | (F.col("__len") >= LONGEST)
    keyed = marked.withColumn("__pre", F.when(shared, F.xxhash64(F.substring(_norm(), 1, prefix_chars)))).drop("__l")
    wanted, bits = min(max_bits, BITS_A_ROW * docs.count()), _WORD
    while bits < wanted:
        bits *= 2
    bitmap = _shared_keys(keyed.where(F.col("__pre").isNotNull()), bits)
    # at most ``max_bits`` / 8 bytes
    rows = keyed.join(F.broadcast(bitmap), F.floor(_bit(bits) / _WORD) == F.col("__at"), "left")
    return rows.withColumn("__full", F.when(F.col("__pre").isNotNull() & _has_bit(bits), _full_hash())).drop("text", "__at", "__map")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", prefix_chars: int = PREFIX_CHARS, max_bits: int = MAX_BITS) -> DataFrame:
    """Adds ``keep_id``, ``group_size`` and ``kept`` to every row of ``docs``."""
    carried = [c for c in docs.columns if c not in ("text", "keep_id", "group_size", "kept") and not c.startswith("__")]
    rows = candidates(docs.select(*carried, "text"), prefix_chars, max_bits)
    rows = snapshot(rows.withColumn("__row", F.monotonically_increasing_id()), "digests")  # numbered once, in writing
    # Level 3: groups of equal texts, counted map-side, so a hot group costs one row a task.
    groups = (
        rows.where(F.col("__full").isNotNull())
        .groupBy("__full")
        .agg(F.max(id_col).alias("__keep"), F.count("*").alias("__size"))
        .where("__size > 1")
    )
    largest = groups.where(F.col("__size") >= HOT_ROWS).orderBy(F.desc("__size"), "__full").limit(HOT_GROUPS)
    hot = largest.select(F.col("__full").alias("__hot"), F.col("__keep").alias("__hot_keep"), F.col("__size").alias("__hot_size"))
    marked = rows.join(F.broadcast(hot), F.col("__full") == F.col("__hot"), "left")  # ``HOT_GROUPS`` rows at most
    # Rows that need no other group get a key of their own, which spreads them.
    own = F.concat(F.lit("-"), F.hex(F.xxhash64("__row")))
    key = F.when(F.col("__full").isNull() | F.col("__hot").isNotNull(), own).otherwise(F.col("__full"))
    out = marked.withColumn("__full", key).drop("__len", "__pre", "__row", "__hot").join(groups, "__full", "left")
    size = F.coalesce("__hot_size", "__size", F.lit(1))
    keep = F.when(F.col("__hot_size").isNotNull(), F.col("__hot_keep")).when(F.col("__size").isNotNull(), F.col("__keep"))
    keep = keep.otherwise(F.col(id_col))
    return out.select(
        *carried,
        keep.alias("keep_id"),
        size.cast("long").alias("group_size"),
        ((size == 1) | F.col(id_col).eqNullSafe(keep)).alias("kept"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("text_sha256", _full_hash())
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
