"""Mixing sources to target weights by temperature.

The token share p of every source is raised to an exponent a and normalised:
w(a) = p**a / sum(p**a). a = 1 keeps the shares, a = 0 weighs all sources alike. The
exponent is found by narrowing an interval until the mix meets a target: an entropy (as
a part of the largest possible one), or the most passes that any source may be repeated.
The weights then become budgets in tokens, and a source spends its budget in blocks: each
block is a keyed permutation of all its documents, the last one is cut where the budget
ends.

Only DataFrame operations. Statistics are one combined aggregation by source; the search
for the exponent asks the small table of sources for a few sums per step, for a grid of
exponents at once. The cut of a block does not sort a source in one task: the positions
of the permutation are split into bins of about ``BIN_ROWS`` documents, bins into groups,
token sums of groups and bins are accumulated first, and only documents of the one bin
where the budget ends are ranked. No window covers more than a bin, a group of bins or
the groups of a source.

Defined results: tokens are words between white space; a null or empty text has none, so
it belongs to every block that its position is in; a null source is a source of its own;
sources without tokens get weight zero and no rows, or one pass if asked for; rows that repeat take part each. With
one source, or shares that are all equal, the exponent does not matter and the upper end
of the interval is taken. Very long texts are counted whole; empty tables give empty results.
Columns of the input that begin with ``__`` are dropped, all others are passed on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.common import documents, snapshot

#: Steps of a search and exponents that each tries; GRID ** -STEPS is below 1e-13.
STEPS, GRID = 6, 200
BIN_ROWS = 2000
GROUP_BINS = 256
SEED = "mix-42"
#: Bits of a permutation position.
POSITION_BITS = 52


@dataclass(frozen=True)
class Target:
    """What the mix has to meet: exactly one of the two.

    entropy: the mix's entropy as a part of log(number of sources), 0 to 1.
    passes: no source may be read more often than this, for the budget asked for.
    budget: tokens to draw; None: the least that reads every source once in full.
    """

    entropy: float | None = None
    passes: float | None = None
    budget: int | None = None


def count_tokens(text: Column) -> Column:
    """Words between white space (space, tab, line feeds and the like)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def source_shares(docs: DataFrame, source: str = "source") -> DataFrame:
    """(source, docs, tokens) of every source."""
    return docs.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("docs"), F.sum(count_tokens(F.col("text"))).alias("tokens")
    )


def _within(sums: dict, total: int, smallest: int, largest: int, n: int, a: float, target: Target) -> bool:
    """Whether the mix of exponent ``a`` is flat enough (entropy) or too flat (passes)."""
    z, zl = sums["z"], sums["zl"]
    if target.entropy is not None:
        return math.log(z) - a * zl / z >= target.entropy * math.log(n)
    low, high = smallest / total, largest / total
    weight = lambda p: p**a / z
    if target.budget is None:
        passes = (weight(low) / low) / (weight(high) / high)  # the largest source is read once (a <= 1)
    else:
        passes = max(weight(p) * target.budget / (p * total) for p in (low, high))
    return passes > target.passes


def find_exponent(shares: DataFrame, target: Target, low: float = 0.0, high: float = 1.0) -> float:
    """The largest exponent that is flat enough, or the least that keeps the pass limit.

    Both conditions hold below some exponent and fail above it (for passes: they are
    exceeded below it); the interval around that exponent is narrowed. If the target is
    not met at ``low`` or is met all over, an end of the interval is the answer.
    """
    if (target.entropy is None) == (target.passes is None):
        raise ValueError("give either an entropy or a pass limit")
    used = shares.where("tokens > 0")
    row = used.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    total, smallest, largest, n = row
    if not n or smallest == largest:
        return high
    p = F.col("tokens") / F.lit(float(total))

    def flat(exponents: list[float]) -> list[bool]:
        # The grid is one array literal, so that all steps run the same compiled code.
        tried = used.select(p.alias("p"), F.explode(F.lit(exponents)).alias("a"))
        sums = tried.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("zl"))
        got = {r["a"]: {"z": r["z"], "zl": r["zl"]} for r in sums.collect()}  # a row for each exponent
        return [_within(got[a], total, smallest, largest, n, a, target) for a in exponents]

    ends = flat([low, high])
    if not ends[0]:
        return low
    if ends[1]:
        return high
    for _ in range(STEPS):
        grid = [low + (high - low) * i / (GRID + 1) for i in range(GRID + 2)]
        states = [True, *flat(grid[1:-1]), False]
        last = max(i for i, s in enumerate(states) if s)
        low, high = grid[last], grid[last + 1]
        if high - low < 1e-13:
            break
    return low if target.entropy is not None else high


def source_budgets(shares: DataFrame, target: Target) -> DataFrame:
    """(source, docs, tokens, exponent, weight, budget): the plan of a mix, a row per source."""
    a = find_exponent(shares, target)
    used = shares.where("tokens > 0")
    total = used.agg(F.sum("tokens")).first()[0] or 1
    raw = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    z = used.agg(F.sum(raw)).first()[0] or 1.0
    weighed = used.withColumns({"exponent": F.lit(a), "weight": raw / F.lit(z)})
    if target.budget is None:
        whole = weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    else:
        whole = float(target.budget)
    # a millionth of a token absorbs what doubles lose
    budget = F.floor(F.col("weight") * F.lit(whole) + 1e-6).cast("long")
    if target.budget is None:  # every source is read in full; doubles lose whole tokens of large ones
        budget = F.greatest(budget, F.col("tokens"))
    return weighed.withColumn("budget", budget)


def _position(block: Column, seed: str) -> Column:
    """Where a document lies in a block's permutation: the digest of seed, block and document."""
    text = F.concat_ws("|", F.lit(seed), block.cast("string"), F.col("__key.i"), F.col("__key.h"))
    return F.conv(F.substring(F.md5(text), 1, POSITION_BITS // 4), 16, 10).cast("long")


def draw(
    docs: DataFrame, target: Target, source: str = "source", id_col: str = "doc_id", seed: str = SEED, keep_empty: bool = False
) -> DataFrame:
    """The rows of the mix: ``docs`` (all columns but those that begin with ``__``) with ``__block``, ``__place``, ``__tokens``.

    A row stands in every block that takes it: blocks 0, 1, ... hold all documents of the
    source, the last one those whose place in the permutation lies before the cut. Rows of
    a source sorted by block and place are its reading order; equal rows share a place and
    are taken together. With ``keep_empty`` sources without tokens are read once, as block 0.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if not c.startswith("__")])
    counted = docs.withColumns(
        {
            "__source": F.col(source),
            "__tokens": count_tokens(F.col("text")),
            "__key": F.struct(
                F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.md5(F.coalesce("text", F.lit(""))).alias("h")
            ),
        }
    )
    # One pass over the texts for the plan, one for the rows of the mix.
    light = snapshot(counted.select("__source", "__tokens", "__key"), "counted")
    shares = snapshot(
        light.groupBy(F.col("__source").alias("source")).agg(F.count("*").alias("docs"), F.sum("__tokens").alias("tokens")),
        "shares",
    )
    bin_count = F.greatest(F.lit(1), F.ceil(F.col("docs") / BIN_ROWS)).cast("long").alias("__bins")
    plan = snapshot(source_budgets(shares, target), "mix-plan").select(
        F.col("source").alias("__s"),
        F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("__full"),
        (F.col("budget") % F.col("tokens")).alias("__rest"),
        bin_count,
    )
    if keep_empty:
        none = shares.where("tokens = 0").select(
            F.col("source").alias("__s"), F.lit(1).alias("__full"), F.lit(0).cast("long").alias("__rest"), bin_count
        )
        plan = plan.unionByName(none)
    # The plan has a row for each source; a source that is hot on the other side of this
    # join is split at run time where the plan is too large to be broadcast by its size.
    of_source = F.col("__source").eqNullSafe(F.col("__s"))
    place = _position(F.col("__full"), seed)

    def placed(rows: DataFrame) -> DataFrame:
        out = rows.join(plan, of_source).drop("__s").withColumn("__place", place)
        top = F.lit(float(1 << POSITION_BITS))
        out = out.withColumn("__bin", F.floor(F.col("__place") / top * F.col("__bins")).cast("long"))
        return out

    # The bin in which each source's budget ends, and what is left for it there.
    bins = placed(light).groupBy("__source", "__bin", "__rest").agg(F.sum("__tokens").alias("__t"))
    bins = snapshot(bins.withColumn("__group", F.floor(F.col("__bin") / GROUP_BINS)), "bins")
    groups = bins.groupBy("__source", "__group", "__rest").agg(F.sum("__t").alias("__t"))
    running = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__t").over(running("__source").orderBy("__group")), F.lit(0))
    ends = groups.withColumn("__before", before).where("__before <= __rest and __before + __t > __rest")
    ends = ends.select(F.col("__source").alias("__s"), F.col("__group").alias("__g"), "__before")
    inner = bins.join(ends, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__group") == F.col("__g")))
    sofar = F.col("__before") + F.coalesce(F.sum("__t").over(running("__source").orderBy("__bin")), F.lit(0))
    cut = inner.withColumn("__sofar", sofar).where("__sofar <= __rest and __sofar + __t > __rest")
    cut = snapshot(
        cut.select(F.col("__source").alias("__s2"), F.col("__bin").alias("__cut"), (F.col("__rest") - F.col("__sofar")).alias("__left")),
        "cuts",
    )
    of_cut = F.col("__source").eqNullSafe(F.col("__s2"))
    # Documents of that bin, in order, as long as their tokens fit.
    edge = placed(light).join(cut, of_cut & (F.col("__bin") == F.col("__cut")))
    spent = F.sum("__tokens").over(Window.partitionBy("__source").orderBy("__place", "__key"))  # peers together
    edge = edge.withColumn("__spent", spent).where("__spent <= __left")
    last = snapshot(
        edge.groupBy(F.col("__source").alias("__s3")).agg(F.max(F.struct("__place", "__key")).alias("__last")), "last"
    )
    rows = placed(counted).join(cut, of_cut, "left").join(last, F.col("__source").eqNullSafe(F.col("__s3")), "left")
    inside = (F.col("__bin") < F.col("__cut")) | (
        (F.col("__bin") == F.col("__cut"))
        & F.coalesce(F.struct("__place", "__key") <= F.col("__last"), F.lit(False))
    )
    blocks = F.col("__full") + F.coalesce(inside, F.lit(False)).cast("int")
    taken = rows.withColumn("__n", blocks).where("__n > 0")
    taken = taken.withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return taken.select(*docs.columns, "__block", _position(F.col("__block"), seed).alias("__place"), "__tokens")


#: Production target of the query: no source is read more than one and a half times for
#: each time the largest is read.
TARGET = Target(passes=1.5)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    drawn = draw(docs, TARGET)
    return drawn.select(
        "doc_id", "source", F.col("__block").alias("block"), F.col("__place").alias("place"), F.col("__tokens").alias("n_tokens")
    )


#: For a pass limit without a budget the exponent has a closed form: the passes of the
#: smallest source are (largest / smallest) ** (1 - a).
OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n,
         coalesce(doc_id::VARCHAR, '') AS i, md5(coalesce(text, '')) AS h
  FROM documents),
s AS (SELECT source, sum(n)::DOUBLE AS t FROM d GROUP BY source HAVING sum(n) > 0),
e AS (
  SELECT CASE WHEN max(t) = min(t) OR max(t) / min(t) <= {TARGET.passes} THEN CASE WHEN max(t) = min(t) THEN 1.0 ELSE 0.0 END
              ELSE 1 - ln({TARGET.passes}) / ln(max(t) / min(t)) END AS a, sum(t) AS total FROM s),
w AS (SELECT source, t, (t / total) ** a / sum((t / total) ** a) OVER () AS w FROM s, e),
b AS (SELECT source, t, floor(w * max(t / w) OVER () + 1e-6) AS budget FROM w),
p AS (SELECT source, t::BIGINT AS t, floor(budget / t)::BIGINT AS blocks, (budget::BIGINT % t::BIGINT) AS rest FROM b),
o AS (
  SELECT d.*, p.blocks, p.rest, ('0x' || substr(md5(concat_ws('|', '{SEED}', p.blocks::VARCHAR, i, h)), 1, 13))::BIGINT AS place
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY place, i, h) AS spent FROM o),
k AS (SELECT *, blocks + CASE WHEN spent <= rest THEN 1 ELSE 0 END AS m FROM c),
x AS (SELECT *, unnest(range(m)) AS block FROM k)
SELECT doc_id, source, block,
       ('0x' || substr(md5(concat_ws('|', '{SEED}', block::VARCHAR, i, h)), 1, 13))::BIGINT AS place, n AS n_tokens
FROM x
"""
