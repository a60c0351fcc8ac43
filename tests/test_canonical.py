"""Normal forms of expressions, and grading by their keys."""

import itertools
import random
from fractions import Fraction

import pytest

from gradus.functions import grading
from gradus.functions.canonical import Inexact, Quotient
from gradus.functions.expressions import POINTS, canonical_key, equal_texts, equal_values, read_values

EQUAL = [
    ("\\frac{1}{2}", "0.5", "50\\%", "\\boxed{\\frac12}"), ("1/\\sqrt{2}", "\\frac{\\sqrt{2}}{2}", "2^{-1/2}"), ("(x+1)^2", "x^2+2x+1", "x(x+2)+1"),
    ("\\frac{x^2-1}{x-1}", "x+1"), ("\\frac{1}{1+\\sqrt{3}}", "(\\sqrt3-1)/2"), ("\\frac{xy-x}{y^2-1}", "x/(y+1)"), ("\\sqrt{8}+\\sqrt2", "3\\sqrt{2}", "\\sqrt{18}"),
    ("a/b+c/d", "(ad+bc)/(bd)"), ("5!", "120"), ("0", "x-x", "2\\pi-\\pi-\\pi"), ("\\sqrt{12}/\\sqrt{3}", "2", "4^{1/2}"), ("1,234", "1234"),
    ("\\frac{x^3-y^3}{x-y}", "x^2+xy+y^2"), ("(\\sqrt2+\\sqrt3)^2", "5+2\\sqrt6"), ("\\frac{1}{\\sqrt2+\\sqrt3+\\sqrt5}", "\\frac{2\\sqrt3+3\\sqrt2-\\sqrt{30}}{12}"),
]


@pytest.mark.parametrize("texts", EQUAL)
def test_equal_expressions_have_one_key(texts):
    assert len({canonical_key(t) for t in texts}) == 1 and canonical_key(texts[0]) is not None


def test_different_expressions_have_different_keys():
    keys = [canonical_key(t[0]) for t in EQUAL]
    assert len(set(keys)) == len(keys)


def test_equal_at_all_points_but_not_equal():
    """A polynomial that is zero wherever values are compared."""
    zeros = [p + Fraction(ord("x") % 64, 7) for p in POINTS]
    text = "*".join(f"(x-{z.numerator}/{z.denominator})" for z in zeros)
    assert equal_values(read_values(text), read_values("0")) and not equal_texts(text, "0")
    assert grading.grade_by_box("0", f"\\boxed{{{text}}}")["status"] == "incorrect"


def test_without_a_normal_form_values_count():
    assert canonical_key("\\sin x") is None and equal_texts("\\sin x", "\\sin(x)") and not equal_texts("\\sin x", "\\cos x")
    assert canonical_key("(1,2)") is None and equal_texts("(1, 2)", "(1, \\frac42)") and not equal_texts("[1,2]", "(1,2)")
    assert canonical_key("\\sqrt[3]{8}") is None and equal_texts("\\sqrt[3]{8}", "2")
    for text in ("", None, "1/0", "x/(y-y)", "(x+y+z+a+b+c)^{60}", "))"):
        assert canonical_key(text) is None
    with pytest.raises(Inexact):
        Quotient.number(1) + 0.5


def test_keys_agree_with_values_on_random_expressions():
    """Quotients of two letters: keys are equal exactly where values are."""
    rng = random.Random(6)

    def make(depth):
        if not depth:
            return rng.choice(["x", "y", "1", "2", "(x+y)", "(x-y)", "\\sqrt2", "3"])
        a, b = make(depth - 1), make(depth - 1)
        return rng.choice([f"({a}+{b})", f"({a}-{b})", f"{a}*{b}", f"({a})/({b})", f"\\frac{{{a}}}{{{b}}}", f"({a})^2"])

    texts = [t for t in (make(rng.randint(1, 3)) for _ in range(260)) if read_values(t) is not None]
    for a, b in itertools.pairwise(sorted(texts, key=lambda t: float(read_values(t)[0]))):
        assert canonical_key(a) is not None
        assert (canonical_key(a) == canonical_key(b)) == equal_values(read_values(a), read_values(b)), (a, b)


def test_grading_reads_every_answer_once(spark):
    responses = [
        "REPONSE: \\boxed{\\frac{1}{2}}", "so \\boxed{0.5} and more", "Réponse : 1/2", "final answer: 2/4 \nbye", "FINAL_ANSWER: \\sin(x)", "\\boxed{\\sin x}",
        "no answer", "", None, "\\boxed{@@}", "\\boxed {(1,2)}", "Reponse: {1;", "REPONSE: $\\boxed{x+1}$", "\\boxed{a \\boxed{1", "Answer: \nREPONSE: 1/2 ",
    ]
    golds = ["1/2", "\\sin{x}", "(1,2)", "1+x", None, "((", "0.50"]
    rows = [(i, g, r) for i, (g, r) in enumerate(itertools.product(golds, responses))] * 2
    df = spark.createDataFrame(rows, "i int, gold string, answer string")
    got = grading.graded_by_box(df, "gold", "answer")
    assert got.columns == ["i", "gold", "answer", "status", "correct", "format_ok", "final_answer", "extraction"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        want = grading.grade_by_box(r.gold, r.answer)
        assert {k: r[k] for k in want} == want, (r.gold, r.answer)
    assert {r.status for r in found} >= {"correct", "incorrect", "no_final_answer", "unparsed_answer", "unsupported_gold"}
