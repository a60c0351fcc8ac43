"""Generated questions have the answers they are given, and are different."""

import re

from pyspark.sql import functions as F

from gradus.operators import generation
from gradus.plans import catalog


def test_answers_are_right(spark, sf_dir):
    rows = catalog.QUERIES["generated_questions"](spark, sf_dir).collect()
    assert len({r.question for r in rows}) == len(rows) == 360 and all(r.complete for r in rows)
    forms = set()
    for r in rows:
        if r.domain == "algebra":
            left, right = re.sub(r"(\d)(x|\()", r"\1*\2", r.question.removeprefix("Solve ")).split(" = ")
            assert eval(left, {"x": r.answer}) == int(right)
        else:
            assert eval(r.question.removeprefix("Calculate ").removeprefix("What is ").rstrip("?")) == r.answer
        forms.add((r.domain, re.sub(r"\d+", "0", r.question.replace("= -", "= "))))
    assert len(forms) == 14  # every template occurs
    assert sorted(r.nr for r in rows if r.domain == "code") == list(range(1, 121))


def test_repeated_questions_are_rejected(spark):
    df = spark.createDataFrame([("d", "q1", 5, "x"), ("d", "q1", 2, "y"), ("d", "q2", 9, "z"), ("e", "q1", 1, "w")], "g string, q string, seed int, v string")
    got = {(r.g, r.q, r.seed, r.v, r.nr, r.complete) for r in generation.first_different(df, "g", "q", "seed", 2).collect()}
    assert got == {("d", "q1", 2, "y", 1, True), ("d", "q2", 9, "z", 2, True), ("e", "q1", 1, "w", 1, False)}
    assert generation.first_different(df.limit(0), "g", "q", "seed", 2).count() == 0
    assert spark.range(200).select(generation.drawn(F.md5(F.col("id").cast("string")), 2, 5, 7).alias("x")).distinct().count() == 3
