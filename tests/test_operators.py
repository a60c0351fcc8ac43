import json

import pytest
from pyspark.sql import functions as F

from gradus import schemas
from gradus.operators import aggregates, constraints, curriculum, joins, paired, sampling
from gradus.sources import scans, sinks
from gradus.streaming import resume

# Published figures. Correct and well-formed answers (of 30) by run and domain,
# and the published mean and deviation of accuracy and of well-formed accuracy by ratio.
RUNS = {
    (42, 0): {"maths": (26, 17), "algebre": (26, 23), "code": (21, 21)}, (42, 10): {"maths": (26, 26), "algebre": (27, 27), "code": (15, 15)},
    (42, 20): {"maths": (26, 25), "algebre": (27, 27), "code": (21, 21)}, (123, 0): {"maths": (27, 21), "algebre": (26, 14), "code": (19, 19)},
    (123, 10): {"maths": (25, 23), "algebre": (26, 25), "code": (19, 19)}, (123, 20): {"maths": (29, 29), "algebre": (27, 27), "code": (20, 20)},
    (2026, 0): {"maths": (24, 13), "algebre": (22, 14), "code": (21, 21)}, (2026, 10): {"maths": (26, 26), "algebre": (27, 27), "code": (21, 21)},
    (2026, 20): {"maths": (28, 28), "algebre": (27, 27), "code": (20, 20)},
}
BY_RATIO = {
    (0, "algebre"): (82.22, 7.7, 56.67, 17.32), (0, "code"): (67.78, 3.85, 67.78, 3.85), (0, "maths"): (85.56, 5.09, 56.67, 13.34), (0, "global"): (78.52, 3.57, 60.37, 7.23),
    (10, "algebre"): (88.89, 1.92, 87.78, 3.85), (10, "code"): (61.11, 10.18, 61.11, 10.18), (10, "maths"): (85.56, 1.93, 83.34, 5.77), (10, "global"): (78.52, 3.39, 77.41, 4.21),
    (20, "algebre"): (90.0, 0.0, 90.0, 0.0), (20, "code"): (67.78, 1.92, 67.78, 1.92), (20, "maths"): (92.22, 5.09, 91.11, 6.94), (20, "global"): (83.33, 1.11, 82.96, 1.7),
}
# Correct answers by strategy and stage, of these totals; and the published final figures.
TOTALS = {"maths_appliques": 150, "algebre_avancee": 100, "maths_competition": 100, "programmation": 90}
STAGES = {
    "no_replay": [(69,), (71, 18), (70, 18, 12), (71, 15, 8, 22)],
    "fixed_replay": [(69,), (68, 17), (68, 17, 13), (72, 17, 17, 20)],
    "adaptive_replay": [(69,), (70, 17), (68, 18, 14), (70, 17, 12, 22)],
}
FINAL = {
    "no_replay": (23.694444444444443, 2.333333333333333, -1.8888888888888895),
    "fixed_replay": (26.055555555555554, 0.0, 1.9999999999999991),
    "adaptive_replay": (25.027777777777775, 1.0, -0.4444444444444455),
}
ERRORS = {"passed": 18, "failed_assertion": 49, "syntax_error": 1}
RAISED = {"TypeError": 9, "NameError": 6, "IndexError": 4, "ValueError": 2, "UnboundLocalError": 1}


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_scans_and_sinks(spark, tmp_path):
    t = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"id": "a", "domain": "maths", "question": "é?", "answer": 3}\n\n{"id": "b", "answer": 4}\n')
    df = scans.json_lines(spark, f"{t}/a.jsonl", schemas.SMALL_QUESTIONS, "id")
    assert rows(df, "id", "answer") == [("a", 3), ("b", 4)]
    (tmp_path / "b.jsonl").write_text('{"id": "a"}\n{"id": "a"}\n')
    with pytest.raises(constraints.Violation):
        scans.json_lines(spark, f"{t}/b.jsonl", schemas.SMALL_QUESTIONS, "id")
    assert scans.json_lines_if_any(spark, f"{t}/none.jsonl", "id string").count() == 0
    (tmp_path / "c.csv").write_text('﻿id,text\n1,"two ""quoted""\nlines"\n2,x\n', encoding="utf-8")
    assert rows(scans.csv_table(spark, f"{t}/c.csv", "id string, text string"), "id", "text") == [("1", 'two "quoted"\nlines'), ("2", "x")]
    assert sinks.write_csv(df, f"{t}/out.csv", ["answer", "id"]) and not sinks.write_csv(df.limit(0), f"{t}/no.csv")
    assert rows(scans.csv_table(spark, f"{t}/out.csv", "answer int, id string"), "id", "answer") == [("a", 3), ("b", 4)]
    sinks.append_json_lines(df, f"{t}/log")
    sinks.append_json_lines(df, f"{t}/log")
    log = scans.json_lines(spark, f"{t}/log", schemas.SMALL_QUESTIONS)
    assert log.count() == 4 and sinks.is_complete(spark, f"{t}/log")
    assert sinks.rewrite_filtered(log, F.col("id") == "a", f"{t}/fixed", f"{t}/backup") == (2, 2)
    with pytest.raises(ValueError):
        sinks.rewrite_filtered(log, F.col("id") == "a", f"{t}/log", f"{t}/b2")
    with pytest.raises(Exception, match="exist"):
        sinks.write_new(df, f"{t}/log")
    assert json.loads(sinks.pretty_json(df.limit(1)))["question"] == "é?"
    assert sinks.markdown_table(df.select("id", "answer").orderBy("id")).splitlines()[2] == "| a | 3 |"
    with pytest.raises(ValueError):
        scans.limited(df, "id", 0)
    assert scans.limited(df, "id", 1).first().id == "a"
    assert scans.lineage(df, "s", "c", "train").first().total_rows == 2
    assert scans.file_hashes(spark, f"{t}/c.csv").first().sha256


def test_synthetic_questions(spark):
    for domain in schemas.SMALL_DOMAINS:
        made = scans.synthetic_questions(spark, domain, 60, 42).collect()
        assert len({r.question for r in made}) == 60
        if domain == "maths":
            assert all(eval(r.question.split(":")[1]) == r.answer for r in made)
    with pytest.raises(ValueError):
        scans.synthetic_questions(spark, "maths", 10**6, 42)


def test_published_run_metrics(spark):
    """Rows with the published counts give the published figures of every ratio."""
    made = [
        (seed, ratio, domain, f"{domain}_{i:02}", i < c, i < f)
        for (seed, ratio), domains in RUNS.items() for domain, (c, f) in domains.items() for i in range(30)
    ]
    p = spark.createDataFrame(made, "seed int, ratio int, domain string, id string, strict_correct boolean, end_to_end boolean")
    p = p.withColumns({"conclusion_correct": F.col("strict_correct"), "status": F.lit("-"), "truncated": F.lit(False), "tokens": F.lit(1)})
    sets = [[F.col("seed"), F.col("ratio")], [F.col("seed"), F.col("ratio"), F.col("domain")]]
    runs = p.groupingSets(sets, "seed", "ratio", "domain").agg(*aggregates.answer_metrics(rounded=True))
    runs = runs.withColumn("domain", F.coalesce("domain", F.lit("global")))
    one = runs.where("seed = 42 and ratio = 0 and domain = 'global'").first()
    assert (one.questions, one.correct, one.accuracy, one.formatted_correct, one.formatted_accuracy) == (90, 73, 81.11, 61, 67.78)
    mean = aggregates.mean_std(runs, ["ratio", "domain"], ["accuracy", "formatted_accuracy"], runs=3)
    assert mean.where("not complete").count() == 0
    r2 = lambda c: F.bround(c, 2)
    names = ("accuracy_mean", "accuracy_std", "formatted_accuracy_mean", "formatted_accuracy_std")
    got = mean.select("ratio", "domain", *[r2(n).alias(n) for n in names]).collect()
    assert {(r.ratio, r.domain): tuple(r)[2:] for r in got} == BY_RATIO
    pairs = joins.before_after(p, ["seed", "id", "domain"], "ratio", 0, ["strict_correct"])
    pairs = pairs.withColumn("k", F.concat_ws("/", "seed", "ratio_after", "domain"))
    each = paired.transitions(pairs, F.col("before_strict_correct"), F.col("after_strict_correct"), "k").where("scope = 'domain'")
    assert {r.k: r.net_gain for r in each.collect()} == {
        f"{seed}/{ratio}/{d}": c - RUNS[seed, 0][d][0] for (seed, ratio), ds in RUNS.items() if ratio for d, (c, _) in ds.items()
    }


def test_published_curriculum_metrics(spark, tmp_path):
    """Stage summaries give the published final results to the last digit."""

    def summary(name, correct):
        domains = {d: {"total": TOTALS[d], "correct": c} for d, c in zip(schemas.CURRICULUM, correct)}
        (tmp_path / name).write_text(json.dumps({"total": 1, "domains": domains}, indent=1))
        return f"{tmp_path}/{name}"

    shared = summary("shared.json", STAGES["no_replay"][0])
    paths = {(s, k): summary(f"{s}{k}.json", rows_[k]) for s, rows_ in STAGES.items() for k in (1, 2, 3)}
    accuracy = scans.stage_summaries(spark, shared, paths, schemas.SUMMARY)
    matrix = curriculum.accuracy_matrix(accuracy, curriculum.domain_dimension(spark, schemas.CURRICULUM))
    got = {r.strategy: (r.average_final, r.average_forgetting, r.average_backward_transfer) for r in curriculum.continual_metrics(matrix).collect()}
    for strategy, want in FINAL.items():
        assert got[strategy] == pytest.approx(want, abs=1e-12)
    text = sinks.matrix(matrix, schemas.CURRICULUM).where("strategy = 'no_replay' and stage = 0").first()
    assert text.maths_appliques == "46.000000" and text.programmation == ""


def test_published_error_categories(spark):
    from gradus.functions.classify import error_category

    made = [(s, None) for s, n in ERRORS.items() for _ in range(n)] + [("execution_error", f"{e}: x: y") for e, n in RAISED.items() for _ in range(n)]
    grades = spark.createDataFrame(made, "status string, error string")
    got = {r[0]: r[1] for r in grades.groupBy(error_category(F.col("status"), F.col("error"))).count().collect()}
    assert got == {"passed": 18, "incorrect_result": 49, "syntax_error": 1, **RAISED}


def test_constraints_and_joins(spark):
    q = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, domain string")
    k = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    with pytest.raises(constraints.Violation):
        joins.one_to_one(q, k, "id")
    with pytest.raises(constraints.Violation):
        joins.lookup(q, k, "id")
    assert rows(constraints.key_difference(q, k, "id"), "id", "side") == [("c", "left_only")]
    assert rows(joins.remaining(q, k, "id"), "id") == [("c",)]
    with pytest.raises(constraints.Violation):
        joins.remaining(k, q, "id")
    assert rows(constraints.wrong_counts(q, "domain", {"x": 2, "z": 1}), "domain", "rows", "expected") == [("y", 1, 0), ("z", 0, 1)]
    assert constraints.missing_columns(q, ["id", "z"]) == ["z"]
    a, b = spark.createDataFrame([(1, "x", None)], "s int, m string, n string"), spark.createDataFrame([(1, "y", None)], "s int, m string, n string")
    assert rows(constraints.field_mismatches(a, b, ["s", "m", "n"]), "field", "left", "right") == [("m", "x", "y")]
    texts = spark.createDataFrame([("train", "Q  one"), ("test", "q ONE "), ("test", "two")], "p string, t string")
    assert constraints.split_leaks(texts, "p", "t").first().splits == ["test", "train"]
    assert rows(constraints.answer_leaks(texts, "p", "t"), "t") == [("q ONE ",), ("two",)]
    got = joins.override(q, spark.createDataFrame([("b", None)], "id string, domain string"), "id", ["domain"])
    assert rows(got, "id", F.coalesce("domain", F.lit("-")), "reviewed") == [("a", "x", False), ("b", "-", True), ("c", "x", False)]
    with pytest.raises(constraints.Violation):
        constraints.require_count(q, F.col("domain") == "x", 3, "repair")
    wide = joins.wide_by_model(spark.createDataFrame([("a", "m1", 1), ("a", "m2", 2)], "id string, m string, v int"), ["id"], "m", ["m1", "m2"], ["v"])
    assert tuple(wide.first()) == ("a", 1, 2)
    assert [r.id for r in joins.round_robin(q, "domain", "id", {"x": 0, "y": 1}).orderBy("turn", "seat").collect()] == ["a", "b", "c"]


def test_paired_and_bootstrap(spark):
    grades = lambda xs: spark.createDataFrame([(f"q{i:02}", "d", bool(x), True, "s") for i, x in enumerate(xs)], "id string, domain string, correct boolean, format_ok boolean, status string")
    made = spark.createDataFrame([(f"q{i:02}", 5, False) for i in range(9)], "id string, tokens int, truncated boolean")
    p = joins.paired_records(grades([1, 0, 0, 0, 0, 0, 0, 0, 0]), grades([0] + [1] * 8), made, made)
    t = {r.scope: r for r in paired.transitions(p, F.col("base_correct"), F.col("new_correct"), "domain", "id").collect()}
    assert t["global"].p_value == 0.0390625 and t["domain"].lost_ids == ["q00"] and t["global"].net_gain == 7
    p = p.withColumn("d", F.col("new_correct").cast("int") - F.col("base_correct").cast("int"))
    ci = paired.bootstrap_ci(p, "domain", "d", "id", 400).first()
    assert ci.ci_low < 700 / 9 < ci.ci_high <= 100
    import random

    values, rng = [-1] + [1] * 8, random.Random(42)
    means = sorted(100 * sum(values[rng.randrange(9)] for _ in range(9)) / 9 for _ in range(300))
    exact = paired.bootstrap_ci_exact(p, "domain", "d", "id", 300).first()
    assert (exact.ci_low, exact.ci_high) == (means[int(0.025 * 299)], means[int(0.975 * 299)])
    assert sorted(sampling.exact_shuffle([1, 2, 3], 1)) == [1, 2, 3] and len(sampling.exact_sample(list(range(9)), 4, 1)) == 4


def test_allocation_and_replay(spark):
    w = spark.createDataFrame([("s", "a", 1.0, 0), ("s", "b", 1.0, 1), ("s", "c", 1.0, 2), ("t", "a", -1.0, 0), ("t", "b", 3.0, 1), ("z", "a", 0.0, 0), ("z", "b", 0.0, 1)], "g string, d string, w double, r int")
    got = {(r.g, r.d): r.slots for r in curriculum.allocate(w, ["g"], "w", "r", 8).collect()}
    assert got == {("s", "a"): 3, ("s", "b"): 3, ("s", "c"): 2, ("t", "a"): 0, ("t", "b"): 8, ("z", "a"): 4, ("z", "b"): 4}
    s = spark.createDataFrame([("x", 1, "a", 0.5), ("x", 2, "a", 0.3), ("x", 3, "a", 0.6), ("x", 4, "a", 0.6)], "strategy string, stage int, domain string, score double")
    got = [(r.best_before, round(r.deficit, 6), r.best_after) for r in curriculum.adaptive_priorities(s).orderBy("stage").collect()]
    assert got == [(0.5, 0.0, 0.5), (0.5, 0.2, 0.5), (0.5, 0.0, 0.6), (0.6, 0.0, 0.6)]
    q = spark.range(400).select(F.concat(F.lit("q"), "id").alias("id"), F.element_at(F.array(F.lit("code"), F.lit("maths"), F.lit("algebre")), (F.col("id") % 3 + 1).cast("int")).alias("domain"))
    for ratio in (0, 10, 20):
        m = sampling.replay_mix(q, "id", "domain", "code", ("maths", "algebre"), 96, 24, ratio, 42)
        kinds = {r[0]: r[1] for r in m.groupBy("kind").count().collect()}
        assert m.count() == 120 and m.where("domain = 'code'").select("id").distinct().count() == 96
        assert kinds == {k: n for k, n in {"current": 96, "repeat": 24 - 24 * ratio // 20, "replay": 24 * ratio // 20}.items() if n}
    plan = sampling.replay_mix(q, "id", "domain", "code", ("maths", "algebre"), 96, 24, 20, 42)
    repeats = sampling.sample(q.where("domain = 'code'"), "id", 24, 7).withColumnRenamed("rank", "pos")
    swapped = sampling.substitute(plan, repeats, F.col("domain") != "code", "id", "presentation")
    assert swapped.count() == 120 and swapped.join(repeats, "id", "left_semi").count() >= 24
    probe = sampling.sample(q, "id", 8, 1, ["domain"])
    assert probe.count() == 24 and sampling.pool(q, probe, "id", 2, ["domain"]).count() == 376
    memory = sampling.first_distinct(plan, "id", "presentation", 24, ["domain"])
    alloc = spark.createDataFrame([("code", 5), ("maths", 3)], "domain string, slots int")
    replayed = sampling.draw_replay(memory, alloc, "id", "domain", "s")
    assert replayed.count() == 8
    with pytest.raises(ValueError):
        sampling.draw_replay(memory, alloc.withColumn("slots", F.lit(99)), "id", "domain", "s")
    current = sampling.sample(q.where("domain = 'code'"), "id", 32, 3)
    assert [r.pos for r in sampling.stage_plan(current, replayed, "id", "p", 40).orderBy("pos").collect()] == list(range(1, 41))
    with pytest.raises(ValueError):
        sampling.stage_plan(current, replayed, "id", "p", 41)
    ranked = sampling.shuffled(q, "id", 42)
    got = {r[0]: r[1] for r in sampling.split_by_rank(ranked, [("train", 120), ("validation", 30), ("test", 50)]).groupBy("partition").count().collect()}
    assert got == {"train": 120, "validation": 30, "test": 50}


def test_resume_and_streams(spark, tmp_path):
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    log = spark.createDataFrame([("a", 1, "passed"), ("a", 2, "failed_assertion")], "id string, ord int, status string")
    work = lambda d: d.withColumns({"ord": F.lit(9), "status": F.when(F.col("id") == "b", "timeout").otherwise("passed")})
    assert rows(resume.resume(expected, log, "id", "ord", work), "id", "ord", "status") == [("a", 2, "failed_assertion"), ("c", 9, "passed")]
    with pytest.raises(ValueError):
        resume.roll_back(log, "ord", None)
    assert resume.roll_back(log, "ord", 2).count() == 1
    kept, again = resume.repair(log, F.col("status") == "passed")
    assert kept.count() == 1 and rows(again, "id") == [("a",)]
    source = f"{tmp_path}/in"
    events = [("k1", "e1", 1.0), ("k1", "e1", 1.0), ("k2", "e2", 5.0), ("k1", "e3", 3.0)]
    spark.createDataFrame(events, "k string, id string, value double").coalesce(1).write.json(source)
    stream = resume.read_log_stream(spark, source, "k string, id string, value double")
    q = resume.append_once(resume.deduplicated_stream(stream, "id"), f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.read.json(f"{tmp_path}/out"), "id") == [("e1",), ("e2",), ("e3",)]
    best = resume.best_so_far_stream(stream, "k", "value").writeStream.format("memory").queryName("best").outputMode("update")
    best.option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination(120)
    assert rows(spark.table("best"), "k", "best", "seen") == [("k1", 3.0, 3), ("k2", 5.0, 1)]


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('b,a,more\n1,"two\nlines",x\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("\ufeffa,b\nq,2\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("a,c\nq,2\n")
    (tmp_path / "d.csv").write_text("a,b\nq,no number\n")
    read = lambda *names: scans.csv_table(spark, [f"file://{tmp_path}/{n}.csv" for n in names], "a string, b int")
    assert sorted(tuple(r) for r in read("a", "b").collect()) == [("q", 2), ("two\nlines", 1)]
    assert read("a").columns == ["a", "b"]
    with pytest.raises(ValueError, match="no column b"):
        read("c")
    with pytest.raises(Exception):  # noqa: B017
        read("d").collect()
    with pytest.raises(FileNotFoundError):
        read("none")


def test_integral_looks_at_the_digits(spark):
    from gradus.functions.text import integral

    cases = {"2.9999999999999996": None, "12.00000000001": None, "12.0": 12, "12.": 12, "-3": -3, "+4.000": 4, "204.5": None, "1.0E7": 10_000_000,
             "1.5e0": None, "": None, "x": None, "9223372036854775807": 2**63 - 1, "9223372036854775808": None, "0.00000000000000000000": 0}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.v for r in df.select("x", integral(F.col("x")).alias("v")).collect()} == cases


def test_replay_gives_every_slot(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(["en"] * 30 + ["de"] * 20 + ["fr"] * 20 + ["es"] * 20)], "id int, domain string")
    for slots, ratio, old in ((10, 10, ("de", "fr")), (10, 20, ("de", "fr", "es")), (7, 20, ("de", "fr"))):
        kinds = [(r.kind, r.domain) for r in sampling.replay_mix(df, "id", "domain", "en", old, 20, slots, ratio, 1).collect()]
        assert len(kinds) == 20 + slots and sum(k == "replay" for k, _ in kinds) == slots * ratio // 20


def test_questions_are_tried_for_as_long_as_needed(spark):
    assert scans.synthetic_questions(spark, "code", 2000, 1).count() == 2000


def test_callback_checks_lengths():
    from gradus.functions.rewards import reward_list

    assert reward_list(["1", "2"], ["1", "3"], lambda c, e: c == e) == [1.0, 0.0]
    with pytest.raises(ValueError, match="2 completions for 1"):
        reward_list(["1", "2"], ["1"], lambda c, e: 1)


def test_last_record_is_one_record(spark):
    log = spark.createDataFrame([(1, 5, "a", "x"), (1, 5, "b", "y"), (1, 4, "c", "z"), (2, 1, None, "q")], "id int, at int, p string, q string")
    got = {r.id: (r.at, r.p, r.q) for r in resume.last_record(log, "id", "at").collect()}
    assert got[1] in {(5, "a", "x"), (5, "b", "y")} and got[2] == (1, None, "q")
