"""Checks inside plans, braces without Python, the search for copied passages."""

import random
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gradus.functions import braces, grading, text
from gradus.operators import constraints, joins


def made(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def fails(df, words):
    with pytest.raises(Exception, match=words):
        df.count()  # rows are counted only, no column is read


# -- integrity in the same pass


def test_one_to_one_raises_when_read(spark):
    left = made(spark, "k int, a string", (1, "x"), (2, "y"), (None, "z"))
    right = made(spark, "k int, b int", (2, 20), (1, 10), (None, 0))
    watch = Observation()
    got = joins.aligned({"l": left, "r": right}, "k", watch)
    assert sorted((r.k is None, r.k, r.l.a, r.r.b) for r in got.collect()) == [(False, 1, "x", 10), (False, 2, "y", 20), (True, None, "z", 0)]
    assert watch.get == {"keys": 3, "l": 3, "r": 3}
    assert joins.one_to_one(left, right, "k", joins.INLINE).columns == ["k", "a", "b"]
    fails(joins.one_to_one(left.unionByName(left.where("k = 2")), right, "k", joins.INLINE), r"k 2 is not once in each table \(__left: 2, __right: 1\)")
    fails(joins.one_to_one(left.where("k = 1"), right, "k", joins.INLINE), "__left: 0, __right: 1")
    assert joins.one_to_one(left.limit(0), right.limit(0), "k", joins.INLINE).count() == 0


def test_each_side_is_read_and_dealt_once(spark, tmp_path):
    for name in "ab":
        spark.range(50).withColumnRenamed("id", "k").withColumn(name, F.col("k") * 2).write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    plan = joins.one_to_one(a, b, "k", joins.INLINE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 1


def test_paired_records_with_checks(spark):
    grades = lambda *ids, domain="d": made(spark, "id int, domain string, correct boolean, format_ok boolean, status string", *[(i, domain, True, False, "s") for i in ids])
    gens = lambda *ids: made(spark, "id int, tokens int, truncated boolean", *[(i, i * 10, False) for i in ids])
    inline = joins.paired_records(grades(1, 2), grades(2, 1), gens(1, 2), gens(1, 2), joins.INLINE)
    eager = joins.paired_records(grades(1, 2), grades(2, 1), gens(1, 2), gens(1, 2))
    assert inline.columns == eager.columns and sorted(inline.collect()) == sorted(eager.collect())
    fails(joins.paired_records(grades(1, 2), grades(2, 1), gens(1, 2, 2), gens(1, 2), joins.INLINE), "id 2 is not once")
    fails(joins.paired_records(grades(1), grades(1, domain="e"), gens(1), gens(1), joins.INLINE), "domains differ for id 1")


def test_remaining_with_checks(spark):
    expected = made(spark, "id int, q string", (1, "a"), (2, "b"), (2, "c"), (3, "d"))
    done = made(spark, "id int", (3,), (3,))
    assert sorted(joins.remaining(expected, done, "id", joins.INLINE).collect()) == [(1, "a"), (2, "b"), (2, "c")]
    fails(joins.remaining(expected, made(spark, "id int", (9,)), "id", joins.INLINE), "unexpected id in the log: 9")


# -- braces


def test_boxes_equal_the_plain_functions(spark):
    rng = random.Random(4)
    parts = ["{", "}", "\\boxed{", "\\boxed {", "\\boxed\n\t{", "\\boxed", "a", " 7 ", "\n", "é", "\\{", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["", None, "\\boxed{", "\\boxed{}", "}\\boxed{ x }{", "\\boxed{{" * 3 + "}" * 5, "\\boxed{a} \\boxed {b", "{\\boxed{1}"]
    df = made(spark, "i int, t string", *enumerate(texts))
    t = F.col("t")
    got = {r.i: r for r in df.select("i", braces.boxed_contents(t).alias("c"), braces.boxed_whole(t).alias("w"), braces.boxed_any(t).alias("a")).collect()}
    for i, x in enumerate(texts):
        want = grading.boxed_contents(x), grading.boxed_whole(x), grading.boxed_any(x)
        assert (got[i].c, got[i].w, got[i].a) == want, x
    assert sum(r.a is not None for r in got.values()) > 300


def test_no_python_worker(spark):
    plan = spark.range(1).select(braces.boxed_any(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_long_texts_are_linear(spark):
    texts = ["\\boxed{" * 20_000 + "}" * 20_000, "{" * 100_000, "\\boxed{a}" + " x" * 300_000, "x" + " " * 300_000 + "y"]
    start = time.time()
    df = made(spark, "i int, t string", *enumerate(texts)).select("i", braces.boxed_any(F.col("t")).alias("a"), text.strip(F.col("t")).alias("s"))
    got = {r.i: r for r in df.collect()}
    assert got[0].a == "\\boxed{}" and got[1].a is None and got[2].a == "\\boxed{a}" and got[3].s == texts[3]
    assert time.time() - start < 60


# -- copied passages


def plain_leaks(docs, items, words):
    cut = lambda x: {tuple(w[i : i + words]) for w in [[p for p in (x or "").lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if p]] for i in range(len(w) - words + 1)}
    by_doc = {}
    for d, x in docs:
        by_doc.setdefault(d, set()).update(cut(x))
    found = {}
    for i, x in items:
        found.setdefault(i, set()).update(d for d, runs in by_doc.items() if runs & cut(x))
    return {i: len(ds) for i, ds in found.items() if ds}


@pytest.mark.parametrize("most", [constraints._MOST_BITS, 1])
def test_leaks_equal_plain_runs(spark, monkeypatch, most):
    monkeypatch.setattr(constraints, "_MOST_BITS", most)  # also without the filter
    rng = random.Random(8)
    words = [f"w{i}" for i in range(6)] + ["Été", "ÉTÉ", "x\ty"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i % 15, say(rng.randint(0, 12))) for i in range(20)] + [(99, None)]
    docs = [(i, say(rng.randint(0, 60))) for i in range(80)] + [(i, items[i][1]) for i in range(10)] + [(7, None), (8, ""), (9, items[3][1] + " " + items[4][1])]
    d, i = made(spark, "doc_id int, text string", *docs), made(spark, "item_id int, text string", *items)
    for n in (3, 8):
        got = {r.item_id: r.documents for r in constraints.passage_leaks(d, i, "doc_id", "item_id", "text", n).collect()}
        assert got == plain_leaks(docs, items, n)
    assert constraints.passage_leaks(d.limit(0), i, "doc_id", "item_id", "text").count() == 0
    assert constraints.passage_leaks(d, i.limit(0), "doc_id", "item_id", "text").count() == 0
