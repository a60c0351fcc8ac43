import pytest
from pyspark.sql import functions as F

from gradus.functions import classify, extraction, grading, numeric, rewards, text
from gradus.functions.expressions import equal_values, exact_value, read_values


@pytest.mark.parametrize(
    ("response", "domain", "expected", "status", "format_ok"),
    [
        ("REPONSE: 114", "maths", 114, "correct", True),
        ("REPMESSE: nombre.", "maths", 114, "missing", False),
        ("REPMESSE: 39", "maths", 39, "correct", False),
        ("22 * 19 = 418", "maths", 418, "correct", False),
        ("REPONSE: 103\nDonc, la solution est x = 29.", "algebre", 29, "contradictory", False),
        ("REPONSE: 10\nDonc, la solution est x = 10.", "algebre", 10, "correct", False),
        ("REPMESSEMENT: 3\nLe résultat est 4.", "code", 4, "contradictory", False),
        ("REPONSE: 0.8909090909090909", "algebre", 154, "non_integer", False),
        ("REPONSE: 806", "maths", 798, "incorrect", True),
        ("", "maths", 1, "missing", False),
        ("**RéPONSE : 12.0**", "maths", 12, "correct", False),
    ],
)
def test_final_analyser(spark, response, domain, expected, status, format_ok):
    df = spark.createDataFrame([(response, domain, expected)], "r string, d string, e bigint")
    row = df.select(*[c.alias(n) for n, c in extraction.analyse_final(F.col("r"), F.col("d"), F.col("e")).columns().items()]).first()
    assert (row.status, row.format_ok) == (status, format_ok)
    assert row.end_to_end == (row.strict_correct and row.format_ok)


@pytest.mark.parametrize(
    ("response", "domain", "expected", "status"),
    [
        ("REPMESSE: 39", "maths", 39, "correct"),
        ("REPONSE: nombre.", "maths", 39, "missing"),
        ("REPONSE: 103\nDonc, la solution est x = 29.", "algebre", 29, "ambiguous"),
        ("REPMESSEMENT: 3\nLe résultat est 4.", "code", 4, "ambiguous"),
        ("22 * 19 = 418", "maths", 418, "correct"),
        ("REPONSE: 204.5\nDonc, la solution est x = 23.", "algebre", 23, "ambiguous"),
    ],
)
def test_reconciler(spark, response, domain, expected, status):
    df = spark.createDataFrame([(response, domain, expected)], "r string, d string, e bigint")
    assert df.select(extraction.analyse_reconciled(F.col("r"), F.col("d"), F.col("e")).status).first()[0] == status


def test_extractors(spark):
    rows = ["REPONSE: 15", "a RÉPONSE: 7\nREPONSE : x = -8.0", " x = 5. ", "Le résultat est 17.", "RESULTAT: 9", "2 + 3 = 5", "rien", "REPONSE: 4\nx = 6"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").orderBy("i")
    r, d = F.col("r"), F.lit("maths")
    made = {
        "v1": extraction.extract_v1(r), "v2": extraction.extract_v2(r), "v3": extraction.extract_v3(r),
        "v4": extraction.extract_v4(r, d), "v5": extraction.extract_v5(r, d), "smoke": extraction.extract_smoke(r),
    }
    got = df.select(*[x.value.alias(n) for n, x in made.items()]).collect()
    assert [x.v1 for x in got] == [15, -8, 5, 17, None, None, None, 4]
    assert [x.v2 for x in got] == [15, -8, 5, 17, None, None, None, 4]
    assert [x.v3 for x in got] == [15, -8, 5, 17, 9, None, None, 4]
    assert [x.v4 for x in got] == [15, -8, 5, 17, 9, 5, None, 4]
    assert [x.v5 for x in got] == [15, -8, 5, 17, 9, 5, None, 6]
    assert [x.smoke for x in got] == [15, None, None, None, 9, None, None, 4]
    assert [x[0] for x in df.select(made["v1"].method).collect()] == [
        "explicit", "explicit", "numeric", "fallback", "not_found", "not_found", "not_found", "explicit"]


@pytest.mark.parametrize(
    ("response", "candidate", "category"),
    [
        ("Therefore, their combined experience is 70 years.", "70", "unique_numeric_candidate"),
        ("Therefore, the plane can hold **90** more bags.", "90", "unique_numeric_candidate"),
        ("Therefore, Pete should leave at 0850 hours to arrive by 0900 hours.", None, "ambiguous_multiple_numbers"),
        ("Therefore, Linda initially had $10.", "10", "unique_numeric_candidate"),
        ("So, there are 15 male alligators.", "15", "unique_numeric_candidate"),
        ("Step 1: calculate 42.", None, "no_explicit_conclusion"),
        (" \n", None, "empty_response"),
        ("Thus it holds.", None, "no_numeric_candidate"),
    ],
)
def test_conclusions(spark, response, candidate, category):
    df = spark.createDataFrame([(response,)], "r string")
    assert tuple(df.select(*extraction.conclusion_candidate(F.col("r"))).first()) == (category, candidate)


def test_math_graders():
    assert grading.grade_by_label("1/2", "REPONSE: 0.5")["correct"]
    assert grading.grade_by_label("42", "Le résultat est 42.\nREPONSE: 42")["correct"]
    assert not grading.grade_by_label("42", "REPONSE: 41")["correct"]
    assert grading.grade_by_label(r"\frac{3}{4}", r"REPONSE: \frac{6}{8}")["correct"]
    assert grading.grade_choice("(C)", "REPONSE: (C)")["correct"] and not grading.grade_choice("(C)", "REPONSE: (A)")["correct"]
    assert grading.grade_choice("Z", "A")["status"] == "unsupported_gold" and grading.grade_choice("A", "hm")["status"] == "missing_choice"
    for response, expected, correct in [
        (r"REPONSE: \boxed{42}", "42", True), (r"REPONSE: \boxed{41}", "42", False),
        (r"REPONSE: \boxed{\frac{3}{4}}", r"\frac{6}{8}", True), (r"REPONSE: \boxed{2938}", "2938", True), ("Calculation: 42", "42", False),
    ]:
        assert grading.grade_by_box(expected, response)["correct"] == correct
    assert grading.grade_by_box("42", "Calculation: 42")["status"] == "no_final_answer"
    assert grading.rescue("70", "70") == "rescued_correct" and grading.rescue("7", "70") == "candidate_incorrect"


@pytest.mark.parametrize(("response", "reward"), [(r"REPONSE: \boxed{42}", 1.02), (r"REPONSE: \boxed{41}", 0.02), (r"The result is \boxed{42}.", 1.0), ("No final answer.", 0.0)])
def test_reward_with_format(spark, response, reward):
    g = grading.grade_by_box("42", response)
    df = spark.createDataFrame([(g["correct"], g["format_ok"])], "c boolean, f boolean")
    assert df.select(rewards.correct_and_format(F.col("c"), F.col("f"))).first()[0] == pytest.approx(reward)
    assert df.select(rewards.correct_and_format(F.col("c"), F.col("f"), 0.0)).first()[0] == float(g["correct"])


def test_graded_rewards(spark):
    df = spark.createDataFrame([(48, 48, True), (48, 40, True), (None, 48, False)], "p bigint, e bigint, x boolean")
    got = [r[0] for r in df.select(rewards.graded(F.col("p"), F.col("e"), F.col("x"))).collect()]
    assert got[0] == 1.05 and 0.05 < got[1] < 1.0 and got[2] == 0.0
    got = [r[0] for r in df.select(rewards.consistent_only(F.col("p"), F.col("e"), F.lit(True))).collect()]
    assert got == [1.0, pytest.approx(0.05 / 9), 0.0]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("1,000", "1000", True), (r"\dfrac{1}{3}", "1/3", True), (r"\sqrt{8}", r"2\sqrt{2}", True), ("50\\%", "0.5", True), ("x+1", "1+x", True),
     ("x+1", "x+2", False), ("(1,2)", "(1, 2)", True), ("(1,2)", "(2,1)", False), (r"\{1,2\}", r"\{2,1\}", True), (r"2\pi", "6.28", False),
     ("-5", "−5", True), (r"x = 5", "5", True), (r"\$10", "10", True), (r"90^\circ", "90", True), (r"\frac12", "0.5", True), ("2^{10}", "1024", True)],
)
def test_equality(a, b, same):
    assert equal_values(read_values(a), read_values(b)) == same


def test_expressions_that_cannot_be_read():
    assert all(read_values(x) is None for x in (None, "", "1/0", "((", "\\begin{x}", "5 @ 3"))
    assert exact_value("(7 - 9) * 3 / 4") == exact_value("-3/2")
    with pytest.raises(ValueError):
        exact_value("2**9**9")


def test_boxes_and_code():
    s = r"\boxed{1} and \boxed{\frac{1}{2}} and \boxed{open"
    assert grading.boxed_contents(s) is None and grading.boxed_whole(s) is None and grading.boxed_any(s) == r"\boxed{\frac{1}{2}}"
    assert grading.boxed_contents(r"a \boxed{ {x} }") == "{x}"
    assert grading.code_block("Sure:\n```python\ndef f(): pass\n```") == "def f(): pass" == grading.code_that_parses("```py\ndef f(): pass\n```")
    assert grading.code_block("Here\ndef f(:\n x") == "def f(:\n x"
    assert grading.code_that_parses("Here it is\ndef f():\n  return 1") == "def f():\n  return 1"
    assert [grading.code_status(x) for x in ("", "x = 1", "this is (")] == ["empty_code", "ready", "syntax_error"]
    assert grading.normal_grading('{"a": {"test_list": [" assert f(1) ", ""]}, "b": {"setup_code": "import m"}}') == {
        "setup": "import m", "tests": ["assert f(1)"], "problem": None}
    assert grading.tests_of([{"assertion": "a"}, "b", {"z": 1}]) == ["a", "b"] and grading.tests_of({"q": "assert(1)"}) == ["assert(1)"]
    assert grading.normal_grading("{}")["problem"] and grading.normal_grading("[")["problem"] == "invalid_json"
    assert grading.test_readiness("programmation", {"public": ["assert 1"], "hidden": ["assert ("]}) == ("invalid_test_syntax", 2)
    assert grading.test_readiness("programmation", {}) == ("missing_tests", 0)
    assert grading.test_readiness("programmation_avancee", {"test": "x"}) == ("base_tests_present", 1)


def test_text_and_classes(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    s = lambda x: F.lit(x).cast("string")
    assert v(text.lines(s("a\r\n \u2028b\x1c\nc\x85"))) == ["a", "b", "c"]
    assert v(text.strip(s("\u00a0\t x \u3000"))) == "x" and v(text.clean_line(s(" ** `12` * "))) == "12"
    assert [v(text.integral(s(x))) for x in ("12.0", "204.5", "NaN", "x", None)] == [12, None, None, None, None]
    assert v(text.answer_after_hashes(s("so <<1+1=2>>2\n#### 2 "))) == "2" and v(text.reasoning_without_marks(s("so <<1+1=2>>2\n#### 2"))) == "so 2"
    assert v(text.normal_number(s("−12,000"))) == "-12000" and v(text.choice_letter(s(" (c). "))) == "C" and v(text.choice_letter(s("f"))) is None
    assert [v(text.level_between(s(x))) for x in ("Level 3", "Level 2", "Level ?", None)] == [True, False, False, False]
    assert [v(text.as_bool(s(x))) for x in (" TRUE", "1", None)] == [True, False, False]
    assert v(text.compose_choices(s("q"), F.array(s("A"), s("B")), F.array(s("x")))) == "q\n(A) x"
    assert v(classify.subtype(s("Calcule : 6 / 2 * 3"), s("maths"))) == "division" and v(classify.exercise_type(s("Calcule : 6 / 2 * 3"), s("maths"))) == "multiplication"
    assert v(classify.subtype(s("Résous : 3x - 4 = 5"), s("algebre"))) == "equation_soustraction"
    assert v(classify.error_category(s("execution_error"), s("NameError: x"))) == "NameError" and v(classify.error_category(s("execution_error"), s(None))) == "other_execution_error"
    assert v(numeric.floor_div(F.lit(-7), F.lit(2))) == -4 and v(text.prompt("sys", s("user"))) == "sys\n\nuser"


@pytest.mark.parametrize(("gained", "lost", "p"), [(0, 0, 1.0), (8, 1, 0.0390625), (8, 0, 0.0078125), (3, 3, 1.0), (600, 500, 0.0028), (3000, 2900, 0.198)])
def test_mcnemar(spark, gained, lost, p):
    got = spark.range(1).select(numeric.mcnemar_exact(F.lit(gained), F.lit(lost))).first()[0]
    assert got == pytest.approx(p, rel=1e-12 if gained < 100 else 0.02)


def test_graders_by_name_in_sql(spark):
    grading.register(spark)
    row = spark.sql(r"select last_boxed('a \\boxed{3}') b, grade_math('3', 'x \\boxed{3}').correct c, python_round(2.675D) r").first()
    assert tuple(row) == ("\\boxed{3}", True, 2.67)
