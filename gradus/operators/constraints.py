"""Integrity checks. Each gives a table of violations; ``require_*`` raise if there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import fingerprint


class Violation(ValueError):
    """A check failed; the message shows ten rows at most."""


def require_none(violations: DataFrame, what: str) -> None:
    found = violations.limit(10).collect()
    if found:
        raise Violation(f"{what}: " + ", ".join(str(tuple(r)) for r in found))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    require_none(duplicates(df, *keys), f"{', '.join(keys)} not unique")
    return df


def orphans(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys of the left table that the right one lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def key_difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys of one table only, with the side they are on."""
    return orphans(left, right, *keys).withColumn("side", F.lit("left_only")).unionByName(
        orphans(right, left, *keys).withColumn("side", F.lit("right_only"))
    )


def same_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that some of the tables lack, with the number of tables that have them."""
    every = reduce(DataFrame.unionByName, [t.select(key).distinct() for t in tables])
    return every.groupBy(key).agg(F.count("*").alias("tables")).where(F.col("tables") < len(tables))


def wrong_counts(df: DataFrame, group: str, expected: dict[str, int]) -> DataFrame:
    """Groups whose number of rows is not the expected one (0 for groups not expected)."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"`{group}` string, expected bigint")
    got = df.groupBy(group).agg(F.count("*").alias("rows"))
    joined = got.join(F.broadcast(want), group, "full")  # the expectation is written in code
    joined = joined.select(group, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return joined.where("rows <> expected")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def split_leaks(df: DataFrame, split: str, text: str) -> DataFrame:
    """Texts (by fingerprint) that stand in more than one split."""
    marked = df.select(split, fingerprint(F.col(text)).alias("question_hash")).distinct()
    return marked.groupBy("question_hash").agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def answer_leaks(df: DataFrame, split: str, answer: str, allowed: tuple[str, ...] = ("train",)) -> DataFrame:
    """Rows that show an answer outside the splits that may."""
    return df.where(F.col(answer).isNotNull() & ~F.col(split).isin(*allowed))


def domain_mismatches(left: DataFrame, right: DataFrame, key: str, domain: str) -> DataFrame:
    """Keys whose domain differs between two tables."""
    r = right.select(key, F.col(domain).alias("other_domain"))
    return left.select(key, domain).join(r, key).where(~F.col(domain).eqNullSafe(F.col("other_domain")))


def field_mismatches(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of two one-row tables (metadata of runs) that are not the same; null equals null."""
    a = left.select(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("a"))
    b = right.select(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("b"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("left"), F.col(f"b.{f}").alias("right")) for f in fields])
    one = a.crossJoin(F.broadcast(b)).select(F.explode(pairs).alias("p"))  # one row by one row
    return one.select("p.*").where(~F.col("left").eqNullSafe(F.col("right")))


def order_mismatches(cached: DataFrame, dataset: DataFrame, key: str, order: str) -> DataFrame:
    """Positions at which two tables do not have the same key."""
    a = cached.select(order, F.col(key).alias("cached"))
    return a.join(dataset.select(order, F.col(key).alias("dataset")), order, "full").where(~F.col("cached").eqNullSafe(F.col("dataset")))


def require_count(df: DataFrame, condition, expected: int, what: str) -> None:
    """Guards a destructive step: it goes on only if exactly the expected rows are concerned."""
    n = df.where(condition).count()
    if n != expected:
        raise Violation(f"{what}: {n} rows, expected {expected}")


def run_words(text: Column) -> Column:
    """Words in lower case, between blanks, tabs and line ends."""
    return F.filter(F.split(F.lower(text), r"[ \n\t\r]+"), lambda w: w != "")


#: A word's hash has 31 bits and a factor 28, so that a run of eight is summed without an overflow.
_WORD_BITS, _FACTOR = 31, 28


def _factors(words: int) -> list[int]:
    """Odd factors, one for each place of a run."""
    return [((0x9E3779B97F4A7C15 * (2 * i + 1)) >> 20) % (1 << _FACTOR) | 1 for i in range(words)]


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << _WORD_BITS) - 1)))


def _run_hash(hashes: Column, at: Column, words: int) -> Column:
    """Hash of the run that begins at a place: a sum over its words, made from their hashes."""
    out = F.element_at(hashes, at) * F.lit(_factors(words)[0])
    for j, factor in enumerate(_factors(words)[1:], 1):
        out = out + F.element_at(hashes, at + j) * F.lit(factor)
    return out


def _starts(words: Column, run: int) -> Column:
    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= run, F.sequence(F.lit(1), F.size(words) - (run - 1))).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of the filter for each run looked for, and the most bits that it has; beyond that all runs pass it.
_BITS_A_RUN, _MOST_BITS = 16, 1 << 24


def _filter_words(runs: DataFrame) -> tuple[Column | None, int]:
    """The filter as an array of longs with 32 bits each, and its number of bits; none for more runs than it holds."""
    n = runs.select("__hash").distinct().count()
    bits = 1 << max(12, (_BITS_A_RUN * n - 1).bit_length())
    if bits > _MOST_BITS:
        return None, bits
    place = F.pmod("__hash", F.lit(bits))
    set_ = runs.select(F.floor(place / 32).alias("w"), (place % 32).cast("int").alias("b")).distinct()
    rows = set_.groupBy("w").agg(F.sum(F.expr("shiftleft(1L, b)")).alias("v")).collect()  # bits / 32 at most
    words = ["0"] * (bits // 32)
    for r in rows:
        words[r.w] = str(r.v)
    return F.split(F.lit(",".join(words)), ",").cast("array<bigint>"), bits


def passage_leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, words: int = 8) -> DataFrame:
    """(item, documents): in how many documents a run of ``words`` words of an item stands.

    Runs are told by sums of word hashes, made once a word. A bit map of the items' runs, part of the
    plan, lets few others pass before anything is unfolded; the text of a run is put together only for those, and
    compared. The documents are read once and no text of theirs is shuffled. For more runs than the map
    holds (a million) there is none, and hashes meet in a join. Null texts and texts of fewer words have no runs.
    """
    if words > 1 << (63 - _WORD_BITS - _FACTOR - 1):
        raise ValueError("runs of eight words at most")
    cut = items.select(item_id, run_words(F.col(text)).alias("__w")).where(F.size("__w") >= words)
    at = cut.select(item_id, "__w", _word_hashes(F.col("__w")).alias("__h"), F.explode(_starts(F.col("__w"), words)).alias("__i"))
    runs = at.select(item_id, _run_hash(F.col("__h"), F.col("__i"), words).alias("__hash"), F.array_join(F.slice("__w", F.col("__i"), words), " ").alias("__run"))
    runs = runs.distinct()
    held, bits = _filter_words(runs)

    def passing(w: Column) -> Column:
        """(hash, place) of the runs that the filter lets pass."""

        def of(h: Column) -> Column:
            pairs = F.transform(_starts(w, words), lambda i: F.struct(_run_hash(h, i, words).alias("h"), i.alias("i")))
            if held is None:
                return pairs
            place = lambda x: F.pmod(x["h"], F.lit(bits))
            word = lambda x: F.element_at(held, (F.floor(place(x) / 32) + 1).cast("int"))
            bit = lambda x: F.call_function("getbit", word(x), (place(x) % 32).cast("int"))
            return F.filter(pairs, lambda x: bit(x) == 1)

        return _let(_word_hashes(w), of)

    found = docs.select(doc_id, run_words(F.col(text)).alias("__w")).where(F.size("__w") >= words)
    # each passing run takes its own words along, not the document
    taken = F.transform(passing(F.col("__w")), lambda x: F.struct(x["h"].alias("h"), F.array_join(F.slice("__w", x["i"], words), " ").alias("run")))
    hits = found.select(doc_id, F.explode(taken).alias("__x")).select(doc_id, F.col("__x.h").alias("__hash"), F.col("__x.run").alias("__run"))
    return hits.join(runs, ["__hash", "__run"]).groupBy(item_id).agg(F.count_distinct(doc_id).alias("documents"))
