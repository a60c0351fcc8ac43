"""Synthetic questions from digests of seeds: templates with operands, and the first different ones of each domain.

A seed stands for an attempt. Its digest chooses the template and the operands, so a question depends on nothing but the
seed; attempts whose question was made before are rejected, and the first ``n`` of each domain in the order of attempts stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a digest that make one number.
DIGITS = 3


def drawn(digest: Column, at: int, low: int, high: int) -> Column:
    """The number at place ``at`` of a digest, from ``low`` to ``high``."""
    raw = F.conv(F.substring(digest, 1 + DIGITS * at, DIGITS), 16, 10).cast("bigint")
    return raw % (high - low + 1) + low


def questions(digest: Column, domain: Column) -> tuple[Column, Column]:
    """(question, answer) of an attempt: five forms of calculation, four equations, five lines of code."""
    a, b, c, x = drawn(digest, 1, 2, 40), drawn(digest, 2, 2, 30), drawn(digest, 3, 2, 12), drawn(digest, 4, 1, 25)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in (q.cast("string") if isinstance(q, Column) else q for q in parts)])
    forms = {
        "maths": [
            (text("Calculate ", a, " + ", b), a + b), (text("Calculate ", a, " - ", b), a - b), (text("Calculate ", a, " * ", c), a * c),
            (text("Calculate (", a, " + ", b, ") * ", c), (a + b) * c), (text("Calculate ", a, " * ", c, " - ", b), a * c - b),
        ],
        "algebra": [
            (text("Solve ", c, "x + ", b, " = ", c * x + b), x), (text("Solve ", c, "x - ", b, " = ", c * x - b), x),
            (text("Solve ", c, "(x + ", b, ") = ", c * (x + b)), x), (text("Solve x/", c, " + ", b, " = ", x + b), x * c),
        ],
        "code": [
            (text("What is ", a, " // ", c, "?"), F.floor(a / c)), (text("What is ", a, " % ", c, "?"), a % c), (text("What is ", c, " ** 2?"), c * c),
            (text("What is ", a, " // ", c, " + ", b, "?"), F.floor(a / c) + b), (text("What is ", a, " % ", c, " * ", b, "?"), a % c * b),
        ],
    }
    question, answer = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for name, of in forms.items():
        kind = drawn(digest, 0, 0, len(of) - 1)
        for i, (q, v) in enumerate(of):
            chosen = (domain == name) & (kind == i)
            question, answer = F.when(chosen, q).otherwise(question), F.when(chosen, v.cast("bigint")).otherwise(answer)
    return question, answer


def first_different(attempts: DataFrame, group: str, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group with different keys, numbered; a group that has fewer is reported with ``complete`` false."""
    once = attempts.groupBy(group, key).agg(F.min_by(F.struct(*[c for c in attempts.columns if c not in (group, key)]), order).alias("r"))
    rows = once.select(group, key, "r.*")
    ranked = rows.withColumn("nr", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("nr") <= n)
    return ranked.withColumn("complete", F.max("nr").over(Window.partitionBy(group)) == n)  # n rows at most
