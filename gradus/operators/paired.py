"""Paired comparison of two runs over the same questions."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.numeric import mcnemar_exact, percent
from gradus.operators.aggregates import by_scope


def transitions(pairs: DataFrame, before: Column, after: Column, domain: str, id_col: str | None = None) -> DataFrame:
    """Per domain and over all: gained, lost, both, neither, accuracies, change in points, p-value.

    ``id_col``: also the sorted ids that were gained and lost (for small tables of questions).
    """
    n = F.count("*")
    gained, lost = F.count_if(~before & after), F.count_if(before & ~after)
    measures = [
        n.alias("total"), F.count_if(before).alias("before_correct"), F.count_if(after).alias("after_correct"),
        gained.alias("gained"), lost.alias("lost"), F.count_if(before & after).alias("both_correct"),
        F.count_if(~before & ~after).alias("both_incorrect"),
    ]
    if id_col:
        ids = lambda c: F.sort_array(F.collect_list(F.when(c, F.col(id_col))))
        measures += [ids(~before & after).alias("gained_ids"), ids(before & ~after).alias("lost_ids")]
    out = by_scope(pairs, domain, None, *measures)
    return out.withColumns(
        {
            "before_accuracy": percent(F.col("before_correct"), F.col("total")),
            "after_accuracy": percent(F.col("after_correct"), F.col("total")),
            "delta_points": F.lit(100.0) * (F.col("gained") - F.col("lost")) / F.col("total"),
            "net_gain": F.col("gained") - F.col("lost"),
            "p_value": mcnemar_exact(F.col("gained"), F.col("lost")),
        }
    )


def bootstrap_ci(pairs: DataFrame, group: str, difference: str, order: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean difference (in points) by resampling rows within groups.

    Each row, named by its ``order`` key, makes one draw in each replicate: a digest of (seed,
    replicate, key) mod n is a place among the group's differences in ascending order, and the
    counts of the few different differences tell which one lies there. So draws are summed where
    the rows lie, and a sum for each task, group and replicate is all that is shuffled; any engine
    gives the same interval. Differences are small integers (-1, 0, 1 for paired outcomes).
    """
    d = F.col(difference).cast("bigint")
    counts = pairs.groupBy(F.col(group).alias("__g"), d.alias("d")).agg(F.count("*").alias("c"))
    kinds = counts.groupBy("__g").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("d", "c"))).alias("__kinds"))
    upto = lambda k: F.aggregate(F.filter("__kinds", lambda x: x["d"] <= k["d"]), F.lit(0).cast("bigint"), lambda a, x: a + x["c"])
    kinds = kinds.select("__g", "n", F.transform("__kinds", lambda k: F.struct(upto(k).alias("end"), k["d"].alias("d"))).alias("__ends"))
    # one row for each group, with an entry for each different difference
    rows = pairs.select(group, F.col(order).cast("string").alias("__key")).join(kinds, F.col(group).eqNullSafe(F.col("__g")))
    draws = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    text = F.concat_ws("|", F.lit(str(seed)), "replicate", "__key")
    place = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.col("n"))
    drawn = draws.select(group, "n", "replicate", "__ends", place.alias("__place"))
    value = F.element_at(F.filter("__ends", lambda k: k["end"] > F.col("__place")), 1)["d"]
    sums = drawn.groupBy(group, "replicate", "n").agg(F.sum(value).alias("s"))
    each = sums.select(group, "n", (F.lit(100.0) * F.col("s") / F.col("n")).alias("estimate"))
    low, high = int(0.025 * (replicates - 1)), int(0.975 * (replicates - 1))
    sorted_ = F.sort_array(F.collect_list("estimate"))
    return each.groupBy(group, "n").agg(
        F.element_at(sorted_, low + 1).alias("ci_low"), F.element_at(sorted_, high + 1).alias("ci_high"), F.avg("estimate").alias("mean_estimate")
    )


def changes(pairs: DataFrame, before: Column, after: Column, domain: str, id_col: str) -> DataFrame:
    """(domain, id, change): the questions that were ``gained`` or ``lost``, one a row, however many they are."""
    change = F.when(~before & after, "gained").when(before & ~after, "lost")
    return pairs.select(domain, id_col, change.alias("change")).where(F.col("change").isNotNull())


#: Random bits of a digest that are used (fifteen hex digits), and of how many digests a half is made.
_BITS, _DIGESTS = 60, 20
#: Binary digits of a probability; a draw is undecided after them with chance 2 ** -48.
_PLACES = 48


def _half(m: Column, tag: Column) -> Column:
    """How many of ``m`` fair coins show heads: counted for up to 1200 of them; for more, 1200 coins stand for all.

    The mean and standard deviation are those of ``m`` coins then, and a uniform digest fills the gaps between counts.
    """
    most = _BITS * _DIGESTS
    word = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", tag, i.cast("string"))), 1, 15), 16, 10).cast("bigint")
    k = F.least(F.lit(_DIGESTS), F.ceil(m / F.lit(_BITS))).cast("int")
    rest = (m % _BITS).cast("int")
    last = (m < most) & (rest > 0)
    mask = lambda i: F.when(last & (i == k - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), rest) - 1).otherwise((1 << _BITS) - 1)
    heads = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0), lambda a, i: a + F.bit_count(word(i).bitwiseAND(mask(i))))
    deviate = (heads - F.lit(most / 2) + word(F.lit(_DIGESTS)) / F.lit(float(1 << _BITS)) - F.lit(0.5)) / F.sqrt(F.lit(most / 4))
    many = F.floor(m / F.lit(2.0) + deviate * F.sqrt(m.cast("double")) / F.lit(2.0) + F.lit(0.5)).cast("bigint")
    return F.when(m <= 0, F.lit(0).cast("bigint")).when(m <= most, heads.cast("bigint")).otherwise(F.greatest(F.lit(0).cast("bigint"), F.least(m, many)))


def binomial(n: Column, part: Column, whole: Column, tag: Column) -> Column:
    """How many of ``n`` draws fall on ``part`` of ``whole`` things, from digests of ``tag``.

    A draw is a binary fraction that is compared with part / whole digit by digit: of those not decided yet half have a one.
    Where the quotient's digit is one, those with a zero are below it; where it is zero, those with a one are
    above. So a binomial is a few throws of fair coins, whatever ``n`` is.
    """
    long = lambda x: x.cast("bigint")

    def step(s: Column, j: Column) -> Column:
        one = s["r"] * 2 >= whole
        state = F.struct(s["r"].alias("r"), s["m"].alias("m"), s["below"].alias("below"), _half(s["m"], F.concat_ws("|", tag, j.cast("string"))).alias("h"))
        nxt = lambda x: F.struct(
            (x["r"] * 2 - F.when(one, whole).otherwise(0)).alias("r"),
            F.when(one, x["h"]).otherwise(x["m"] - x["h"]).alias("m"),
            (x["below"] + F.when(one, x["m"] - x["h"]).otherwise(0)).alias("below"),
        )
        return F.when(s["m"] > 0, F.element_at(F.transform(F.array(state), nxt), 1)).otherwise(s)

    start = F.struct(long(part).alias("r"), long(n).alias("m"), F.lit(0).cast("bigint").alias("below"))
    drawn = F.aggregate(F.sequence(F.lit(1), F.lit(_PLACES)), start, step, lambda s: s["below"])
    return F.when(part >= whole, long(n)).when(part <= 0, F.lit(0).cast("bigint")).otherwise(drawn)


def bootstrap_counts(pairs: DataFrame, group: str, difference: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean difference (in points), from the counts of the different differences alone.

    A resample of n rows is a multinomial draw over these counts: the first difference gets a binomial share of the n draws, the
    next one of what is left, and so on. Rows are read once, to count them; the draws cost groups x replicates x
    different differences. Null differences are left out; a group whose differences are all alike has an interval of one point.
    """
    counts = pairs.where(F.col(difference).isNotNull()).groupBy(F.col(group).alias("g"), F.col(difference).cast("bigint").alias("d")).agg(F.count("*").alias("c"))
    kinds = counts.groupBy("g").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("d", "c"))).alias("kinds"))  # few differences
    rows = kinds.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # a group's name is part of the tag, so that groups of the same counts draw apart
    tag = lambda k: F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("g").cast("string"), F.lit("")), F.col("replicate").cast("string"), k["d"].cast("string"))

    def step(s: Column, k: Column) -> Column:
        got = F.struct(s["n"].alias("n"), s["whole"].alias("whole"), s["sum"].alias("sum"), binomial(s["n"], k["c"], s["whole"], tag(k)).alias("x"))
        nxt = lambda y: F.struct((y["n"] - y["x"]).alias("n"), (y["whole"] - k["c"]).alias("whole"), (y["sum"] + y["x"] * k["d"]).alias("sum"))
        return F.element_at(F.transform(F.array(got), nxt), 1)

    start = F.struct(F.col("n").alias("n"), F.col("n").alias("whole"), F.lit(0).cast("bigint").alias("sum"))
    total = F.aggregate("kinds", start, step, lambda s: s["sum"])
    # dealt by replicate: all the work is in the draws
    each = rows.repartition("g", "replicate").select("g", "n", (F.lit(100.0) * total / F.col("n")).alias("estimate"))
    low, high = int(0.025 * (replicates - 1)), int(0.975 * (replicates - 1))
    sorted_ = F.sort_array(F.collect_list("estimate"))  # one for each replicate
    return each.groupBy(F.col("g").alias(group), "n").agg(
        F.element_at(sorted_, low + 1).alias("ci_low"), F.element_at(sorted_, high + 1).alias("ci_high"), F.avg("estimate").alias("mean_estimate")
    )


def bootstrap_ci_exact(pairs: DataFrame, group: str, difference: str, order: str, replicates: int, seed: int = 42) -> DataFrame:
    """The interval of published figures: one generator a group, rows in order of their id.

    One task for each group of questions, as the generator asks for; for benchmark tables.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order)[difference].astype(int).tolist()
        draw, n = random.Random(seed).randrange, len(values)
        means = sorted(100 * sum(values[draw(n)] for _ in range(n)) / n for _ in range(replicates))
        at = lambda q: means[int(q * (replicates - 1))]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [n], "ci_low": [at(0.025)], "ci_high": [at(0.975)]})

    kind = pairs.schema[group].dataType.simpleString()
    return pairs.select(group, difference, order).groupBy(group).applyInPandas(run, f"`{group}` {kind}, n bigint, ci_low double, ci_high double")


def resolved_and_coverage(df: DataFrame, status: str, by: list[str] | None = None) -> DataFrame:
    """The policy that leaves doubtful answers out: accuracy on resolved ones, and their share."""
    c, i, n = F.count_if(F.col(status) == "correct"), F.count_if(F.col(status) == "incorrect"), F.count("*")
    return df.groupBy(*(by or [])).agg(
        n.alias("total"), c.alias("correct"), i.alias("incorrect"), (c + i).alias("resolved"),
        percent(c, c + i).alias("accuracy_on_resolved"), percent(c + i, n, 0.0).alias("coverage"),
    )


def rescued(correct: Column, rescue: Column) -> list[Column]:
    """Counts after a recheck; the original count stays beside the indicative one."""
    n, c, r = F.count("*"), F.count_if(correct), F.count_if(~correct & rescue)
    return [n.alias("total"), c.alias("correct"), r.alias("rescued"), (c + r).alias("indicative_correct"), percent(c + r, n).alias("indicative_accuracy")]
