"""Joins by key with the integrity the callers count on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gradus.operators.constraints import key_difference, orphans, require_none, require_unique, same_keys
from gradus.operators.sampling import id_bin, numbered

#: Checks that are part of the join's own plan: they cost no further job, and raise when rows are read.
INLINE = "inline"


def _required(df: DataFrame, good: Column, message: Column) -> DataFrame:
    """``df``, which fails with ``message`` at the first row that is not good. As a filter it is never pruned."""
    return df.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def aligned(tables: dict[str, DataFrame], key: str, observe: Observation | None = None) -> DataFrame:
    """(key, one struct for each table): tables whose keys are unique and the same, in one aggregation by key.

    Every table is read and shuffled once. A key that a table has twice or not at all fails the job that reads the result,
    with the key and its number of rows in each table; a null key is a key. ``observe`` gets ``keys`` and the rows of
    each table from the same pass.
    """
    kinds = {name: t.select(F.struct(*[c for c in t.columns if c != key]).alias("x")).schema["x"].dataType for name, t in tables.items()}
    parts = []
    for name, t in tables.items():
        row = F.struct(*[c for c in t.columns if c != key])
        cells = [(row if n == name else F.lit(None).cast(kind)).alias(n) for n, kind in kinds.items()]
        parts.append(t.select(F.col(key), F.lit(name).alias("__table"), *cells))
    rows = reduce(DataFrame.unionByName, parts)
    counts = [F.count_if(F.col("__table") == n).alias(f"__n_{n}") for n in tables]
    met = rows.groupBy(key).agg(*counts, *[F.first(n, ignorenulls=True).alias(n) for n in tables])
    if observe is not None:
        met = met.observe(observe, F.count("*").alias("keys"), *[F.sum(f"__n_{n}").alias(n) for n in tables])
    good = reduce(lambda a, b: a & b, [F.col(f"__n_{n}") == 1 for n in tables])
    found = F.concat_ws(", ", *[F.concat(F.lit(f"{n}: "), F.col(f"__n_{n}").cast("string")) for n in tables])
    message = F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" is not once in each table ("), found, F.lit(")"))
    return _required(met, good, message).select(key, *tables)


def one_to_one(left: DataFrame, right: DataFrame, key: str, check: bool | str = True) -> DataFrame:
    """Inner join of two tables whose keys are unique and the same; ``check`` may be ``INLINE``."""
    if check == INLINE:
        return aligned({"__left": left, "__right": right}, key).select(key, "__left.*", "__right.*")
    if check:
        require_unique(left, key)
        require_unique(right, key)
        require_none(key_difference(left, right, key), f"{key} differs between the tables")
    return left.join(right, key)


def lookup(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Every left row with its right row; a key that the right table lacks raises."""
    if check:
        require_none(orphans(left, right, key), f"{key} without a match")
    return left.join(right, key, "left")


_GRADE, _MADE = ("correct", "format_ok", "status"), ("tokens", "truncated")


def paired_records(
    base_grades: DataFrame, new_grades: DataFrame, base_generations: DataFrame, new_generations: DataFrame, check: bool | str = True
) -> DataFrame:
    """Two runs side by side: four tables with the same ids and domains, one row for each id; ``check`` may be ``INLINE``."""
    if check == INLINE:
        grades = {"bg": base_grades, "ng": new_grades}
        made = {"bm": base_generations, "nm": new_generations}
        four = {n: t.select("id", "domain", *_GRADE) for n, t in grades.items()} | {n: t.select("id", *_MADE) for n, t in made.items()}
        differ = F.concat(F.lit("domains differ for id "), F.col("id").cast("string"))
        rows = _required(aligned(four, "id"), F.col("bg.domain").eqNullSafe(F.col("ng.domain")), differ)
        cells = [F.col(f"{t[0]}{k}.{c}").alias(f"{t}_{c}") for k, names in (("g", _GRADE), ("m", _MADE)) for t in ("base", "new") for c in names]
        return rows.select("id", F.col("bg.domain").alias("domain"), *cells)
    tables = [base_grades, new_grades, base_generations, new_generations]
    if check:
        for t in tables:
            require_unique(t, "id")
        require_none(same_keys(tables, "id"), "ids differ between the runs")
        other = new_grades.select("id", F.col("domain").alias("other"))
        require_none(base_grades.select("id", "domain").join(other, "id").where("domain <> other"), "domains differ")
    grade = lambda t, p: t.select("id", *([] if p == "new" else ["domain"]), *[F.col(c).alias(f"{p}_{c}") for c in _GRADE])
    made = lambda t, p: t.select("id", *[F.col(c).alias(f"{p}_{c}") for c in _MADE])
    parts = [grade(base_grades, "base"), grade(new_grades, "new"), made(base_generations, "base"), made(new_generations, "new")]
    return reduce(lambda a, b: a.join(b, "id"), parts)


def wide_by_model(long: DataFrame, key: list[str], model: str, models: list[str], fields: list[str]) -> DataFrame:
    """A row for each question with ``{model}_{field}`` columns, in one aggregation."""
    picks = [F.max(F.when(F.col(model) == m, F.col(f))).alias(f"{m}_{f}") for m in models for f in fields]
    return long.groupBy(*key).agg(*picks)


def before_after(runs: DataFrame, keys: list[str], ratio: str, baseline: int, fields: list[str]) -> DataFrame:
    """Rows of every other ratio beside the baseline's row of the same keys."""
    before = runs.where(F.col(ratio) == baseline).select(*keys, *[F.col(f).alias(f"before_{f}") for f in fields])
    after = runs.where(F.col(ratio) != baseline).select(*keys, F.col(ratio).alias("ratio_after"), *[F.col(f).alias(f"after_{f}") for f in fields])
    return before.join(after, keys)


def remaining(expected: DataFrame, done: DataFrame, key: str, check: bool | str = True) -> DataFrame:
    """What a resumed run still has to do; done keys that are not expected raise. ``check`` may be ``INLINE``."""
    if check == INLINE:
        keys = done.groupBy(key).agg(F.lit(True).alias("__done"))
        both = expected.withColumn("__expected", F.lit(True)).join(keys, key, "full")
        message = F.concat(F.lit(f"unexpected {key} in the log: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        return _required(both, F.col("__expected"), message).where(F.col("__done").isNull()).select(*expected.columns)
    if check:
        require_none(orphans(done, expected, key), f"unexpected {key} in the log")
    return expected.join(done.select(key).distinct(), key, "left_anti")


def override(rows: DataFrame, manual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Manual values go before automatic ones; ``reviewed`` tells which rows have some."""
    m = manual.select(key, F.lit(True).alias("reviewed"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = rows.join(m, key, "left")
    values = {f: F.when(F.col("reviewed"), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(values | {"reviewed": F.coalesce("reviewed", F.lit(False))}).drop(*[f"__{f}" for f in fields])


def in_given_order(rows: DataFrame, ids: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The rows of a list of keys with the list's positions."""
    return ids.select(key, pos).join(rows, key)


def checkpoint_grid(strategies: DataFrame, stages: DataFrame) -> DataFrame:
    """Every strategy at every stage; both are lists written in code, of a few rows."""
    return strategies.crossJoin(F.broadcast(stages))


def round_robin(df: DataFrame, group: str, order: str, ranks: dict[str, int]) -> DataFrame:
    """Adds the place (``turn``, ``seat``) of each row when groups take turns in a fixed order.

    An integer ``order`` is numbered bin by bin, another one group by group.
    """
    seat = reduce(lambda c, kv: c.when(F.col(group) == kv[0], kv[1]), ranks.items(), F.when(F.lit(False), 0)).otherwise(len(ranks))
    if df.schema[order].dataType.typeName() in ("byte", "short", "integer", "long"):
        return numbered(df, id_bin(order), [F.col(order)], [group], "turn").withColumn("seat", seat)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumns({"turn": turn, "seat": seat})
