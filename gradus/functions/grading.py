"""Graders that column expressions cannot say: balanced braces, symbolic equality, programs.

Plain functions of one value come first; ``*_udf`` wrap them as vectorised pandas UDFs.
No code from a table is ever executed: programs are parsed, and results of running them
are read as a table.
"""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.functions import braces
from gradus.functions.expressions import canonical_key, equal_texts, exact_value, read_values
from gradus.functions.text import SPACE, strip

# How final answers are announced, what a strict answer looks like, and how
# code stands in a response.
_LABELS_A = re.compile(r"^(?:REPONSE|RÉPONSE|ANSWER|FINAL ANSWER|####)\s*[:：]?\s*(.+?)\s*$", re.I)
_LABELS_B = re.compile(r"(?im)^\s*(?:REPONSE|RÉPONSE|FINAL_ANSWER|Final answer)\s*:\s*(.+?)\s*$")
_STRICT_A = re.compile(r"REPONSE:\s*\S.*", re.I)
_STRICT_B = re.compile(r"(?im)^\s*REPONSE\s*:\s*\$?\s*\\boxed\s*\{")
_BARE_VALUE = re.compile(r"[\d\s.,+\-*/()]+")
_SOLVED = re.compile(r"x\s*=\s*(.+)", re.I)
_CHOICE = re.compile(r"\(?\s*([A-E])\s*\)?[.]?", re.I)
_FENCE = re.compile(r"```(?:python)?\s*(.*?)```", re.I | re.S)
_FENCE_LINE = re.compile(r"```(?:python|py)?[ \t]*\n(.*?)```", re.I | re.S)
_STATEMENTS = (("def",), ("async", "def"), ("class",), ("import",), ("from",))
_STARTS = ("def ", "async def ", "import ", "from ", "@")
SHORT_LINE = 128

# -- boxed answers


def _closing(text: str, opening: int) -> int | None:
    """Where the brace opened at ``opening`` closes."""
    depth = 0
    for m in re.finditer(r"[{}]", text[opening:]):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return opening + m.start()
    return None


def boxed_contents(text: str | None) -> str | None:
    """Inside of the last ``\\boxed{``; None if its braces don't close."""
    at = (text or "").rfind("\\boxed{")
    end = _closing(text, at + 6) if at >= 0 else None
    return text[at + 7 : end].strip() if end is not None else None


def boxed_whole(text: str | None) -> str | None:
    """The last ``\\boxed{...}`` with its wrapper; None if the last one doesn't close."""
    at = (text or "").rfind("\\boxed{")
    end = _closing(text, at + 6) if at >= 0 else None
    return text[at : end + 1] if end is not None else None


def boxed_any(text: str | None) -> str | None:
    """The last ``\\boxed {...}`` that closes, blanks before the brace allowed, with its wrapper."""
    for m in reversed(list(re.finditer(r"\\boxed\s*\{", text or ""))):
        end = _closing(text, m.end() - 1)
        if end is not None:
            return text[m.start() : end + 1]
    return None


# -- final answers


def _lines(text: str) -> list[str]:
    return [s for s in map(str.strip, text.splitlines()) if s]


def final_by_label(text: str | None) -> tuple[str | None, bool]:
    """(answer, strict format): last label, else last boxed, else a short last line that is a value."""
    rows = _lines(text) if isinstance(text, str) else []
    if not rows:
        return None, False
    strict = _STRICT_A.fullmatch(rows[-1]) is not None
    named = (m.group(1).strip() for m in map(_LABELS_A.match, reversed(rows)) if m)
    value = next(filter(None, named), None) or boxed_whole(text)
    if value is not None:
        return value, strict
    if len(rows[-1]) <= SHORT_LINE:
        if _BARE_VALUE.fullmatch(rows[-1]):
            return rows[-1], False
        solved = _SOLVED.fullmatch(rows[-1])
        if solved:
            return solved.group(1).strip(), False
    return None, False


def final_by_box(text: str | None) -> tuple[str, str]:
    """(answer, how found): last boxed, else the last labelled line."""
    boxed = boxed_any(text)
    if boxed is not None:
        return boxed, "boxed"
    named = _LABELS_B.findall(text or "")
    return (named[-1].strip(), "final_line") if named else ("", "no_final_answer")


def parse_gold(expected: str | None) -> list | None:
    return read_values(expected)


def grade_by_label(expected: str | None, response: str | None) -> dict:
    """Symbolic grading after the label-first extraction; says what a reviewer has to see."""
    gold = parse_gold(expected)
    final, strict = (None, False) if gold is None else final_by_label(response)
    value = read_values(final)
    if gold is None:
        status = "unsupported_gold"
    elif final is None:
        status = "missing_final"
    elif value is None:
        status = "unparsed_prediction"
    else:
        status = _compare(expected, final)
    return _graded(status, strict, final) | {"needs_review": status not in ("correct", "incorrect")}


def _compare(gold: str, answer: str) -> str:
    """Of two texts that can be read."""
    try:
        return "correct" if equal_texts(gold, answer) else "incorrect"
    except (ArithmeticError, TypeError, ValueError):
        return "verification_error"


def _graded(status: str, format_ok: bool, final: str | None) -> dict:
    return {"status": status, "correct": status == "correct", "format_ok": format_ok, "final_answer": final}


def grade_by_box(expected: str | None, response: str | None) -> dict:
    """Symbolic grading after the boxed-first extraction."""
    final, how = final_by_box(response)
    value = read_values(final)
    if not final:
        status = "no_final_answer"
    elif value is None:
        status = "unparsed_answer"
    else:
        status = "unsupported_gold" if parse_gold(expected) is None else _compare(expected, final)
    return _graded(status, _STRICT_B.search(response or "") is not None, final) | {"extraction": how}


def grade_choice(expected: str | None, response: str | None) -> dict:
    """Multiple choice A to E; the last line counts where no answer is announced."""

    def letter(x: str | None) -> str | None:
        m = _CHOICE.fullmatch((x or "").strip())
        return m.group(1).upper() if m else None

    gold = letter(expected)
    if gold is None:
        return _graded("unsupported_gold", False, None) | {"needs_review": True}
    final, strict = final_by_label(response)
    final = (final if final is not None else (_lines(response or "") or [None])[-1])
    got = letter(final.strip().strip("$")) if final else None
    if got is None:
        return _graded("missing_choice", strict, final) | {"needs_review": True}
    return _graded("correct" if got == gold else "incorrect", strict, got) | {"needs_review": False}


def rescue(candidate: str | None, expected: str | None) -> str:
    """Whether a conclusion's number is the expected value."""
    a, b = read_values(candidate), read_values(expected)
    if a is None or b is None:
        return "verification_unavailable"
    return {"correct": "rescued_correct", "incorrect": "candidate_incorrect"}.get(_compare(expected, candidate), "verification_error")


# -- programs


def parses(code: str) -> bool:
    try:
        ast.parse(code)
    except (SyntaxError, ValueError):
        return False
    return True


def code_block(text: str | None) -> str:
    """First fenced block, else from the first line that looks like code, else all; not parsed."""
    text = (text or "").strip()
    fenced = _FENCE.search(text)
    if fenced:
        return fenced.group(1).strip()
    text = re.sub(r"\s*```$", "", re.sub(r"^```(?:python)?\s*", "", text, flags=re.I))
    rows = text.splitlines()
    at = next((i for i, r in enumerate(rows) if r.lstrip().startswith(_STARTS)), None)
    return text if at is None else "\n".join(rows[at:]).strip()


def _begins_program(line: str) -> bool:
    """Whether a line is a decorator or begins with the words of a definition or an import."""
    words = tuple(line.split())
    return bool(words) and (words[0].startswith("@") or any(words[: len(s)] == s for s in _STATEMENTS))


def code_that_parses(text: str | None) -> str:
    """First fenced block, else all if it parses, else the longest tail from a code line that does."""
    raw = (text or "").strip()
    fenced = _FENCE_LINE.findall(raw)
    if fenced:
        return fenced[0].strip()
    if not raw or parses(raw):
        return raw
    rows = raw.splitlines()
    tails = ("\n".join(rows[i:]).strip() for i, r in enumerate(rows) if _begins_program(r))
    return next(filter(parses, tails), raw)


def code_status(response: str | None) -> str:
    """What can be said of a program without running it."""
    code = code_that_parses(response)
    return "empty_code" if not code else "ready" if parses(code) else "syntax_error"


# Keys under which tests and their preparation are stored, in order of precedence.
TEST_KEYS = ("test_list", "tests", "assertions", "test_cases", "unit_tests", "cases", "test")
ITEM_KEYS = ("test", "assertion", "code", "source")
SETUP_KEYS = ("setup", "setup_code", "test_setup")


def tests_of(value: object) -> list[str]:
    """Test sources in a payload of unknown shape; the first place that has some wins."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        if all(isinstance(x, str) for x in value):
            return value
        picked = (x if isinstance(x, str) else next((x[k] for k in ITEM_KEYS if isinstance(x.get(k), str)), None) for x in value if isinstance(x, str | dict))
        return [x for x in picked if x is not None]
    if not isinstance(value, dict):
        return []
    known = (tests_of(value[k]) for k in TEST_KEYS if k in value)
    asserts = ([x for x in value.values() if isinstance(x, str) and re.search(r"assert[ (]", x)] for _ in (0,))
    nested = (tests_of(x) for x in value.values() if isinstance(x, dict | list))
    return next((found for source in (known, asserts, nested) for found in source if found), [])


def setup_of(value: object) -> str:
    """The preparation that goes with the tests, looked for in nested objects too."""
    if not isinstance(value, dict):
        return ""
    own = next((value[k] for k in SETUP_KEYS if isinstance(value.get(k), str)), None)
    return own if own is not None else next(filter(None, map(setup_of, value.values())), "")


def normal_grading(payload: str | None) -> dict:
    """{setup, tests} of a JSON grading payload: tests trimmed, empty ones dropped."""
    try:
        value = json.loads(payload or "null")
    except ValueError:
        return {"setup": "", "tests": [], "problem": "invalid_json"}
    tests = [t.strip() for t in tests_of(value) if t.strip()]
    problem = None if tests else "no tests under " + ", ".join(sorted(value) if isinstance(value, dict) else [type(value).__name__])
    return {"setup": setup_of(value).strip(), "tests": tests, "problem": problem}


def test_readiness(domain: str, tests: dict | None) -> tuple[str, int]:
    """(status, number of tests) of a grading key's tests, by their syntax only."""
    tests = tests or {}
    if domain == "programmation_avancee":
        present = bool(tests.get("test"))
        return ("base_tests_present" if present else "missing_base_tests"), int(present)
    if domain != "programmation":
        raise ValueError(f"no program tests in domain {domain}")
    every = [t for k in ("public", "hidden", "challenge") for t in tests.get(k) or []]
    if not every:
        return "missing_tests", 0
    good = all(map(parses, [tests.get("setup") or "", *every]))
    return ("ready_for_sandbox" if good else "invalid_test_syntax"), len(every)


def casefold_fingerprint(question: str | None) -> str | None:
    """The fingerprint with full case folding (``ß`` is ``ss``), for corpora that need it."""
    import hashlib

    return None if question is None else hashlib.sha256(" ".join(question.split()).casefold().encode()).hexdigest()


def python_round(x: float | None, digits: int = 2) -> float | None:
    """Rounding of the exact binary value, ties to even, as published figures were made."""
    return None if x is None or x != x else round(x, digits)


def nfc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFC", text)


# -- as UDFs


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _column(work: Callable, kind: str):
    """A vectorised UDF that applies ``work`` to each row."""

    @F.pandas_udf(_TYPES[kind])
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: work(None if v is None or v is pd.NA else v))

    return run


def _columns(work: Callable, kind: str):
    """A vectorised UDF of two columns that yields a struct."""
    fields = [f.split() for f in kind.split(", ")]

    @F.pandas_udf(T.StructType([T.StructField(n, _TYPES[t]) for n, t in fields]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([work(x, y) for x, y in zip(a, b, strict=True)], columns=[n for n, _ in fields])

    return run


@F.pandas_udf(T.StructType([T.StructField("key", T.StringType()), T.StructField("readable", T.BooleanType())]))
def _read_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        keys = [canonical_key(x) for x in s]
        yield pd.DataFrame({"key": keys, "readable": [k is not None or read_values(x) is not None for k, x in zip(keys, s, strict=True)]})


@F.pandas_udf(T.StringType())
def _compare_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for gold, answer in batches:
        yield pd.Series([_compare(g, a) for g, a in zip(gold, answer, strict=True)], dtype=object)


def last_labelled(text: Column) -> Column:
    """What stands behind the last label of a final answer, on its line; null without one."""
    pattern = rf"(?imud)^{SPACE}*(?:REPONSE|RÉPONSE|FINAL_ANSWER|Final answer){SPACE}*:{SPACE}*(.+?){SPACE}*$"
    return strip(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)))


def graded_by_box(df: DataFrame, expected: str, response: str) -> DataFrame:
    """``df`` with ``status``, ``correct``, ``format_ok``, ``final_answer`` and ``extraction``, as ``grade_by_box`` gives them.

    Answers are cut out of the responses without Python. Every different answer, and every different gold, is read once and
    becomes the key of its normal form; equality is equality of keys. Only different pairs of which one has no normal form
    are compared by value. Columns of ``df`` with these names are replaced; a null response has no answer.
    """
    names = ["status", "correct", "format_ok", "final_answer", "extraction"]
    carried = [c for c in df.columns if c not in names]
    text = F.coalesce(F.col(response), F.lit(""))
    boxed, named = braces.boxed_any(text), last_labelled(text)
    how = F.when(F.col("__boxed").isNotNull(), "boxed").when(F.col("__named").isNotNull(), "final_line").otherwise("no_final_answer")
    strict = text.rlike(rf"(?imd)^{SPACE}*REPONSE{SPACE}*:{SPACE}*\$?{SPACE}*\\boxed{SPACE}*\{{")
    rows = df.select(*carried, boxed.alias("__boxed"), named.alias("__named"), strict.alias("format_ok"), F.col(expected).alias("__gold"))
    rows = rows.withColumns({"final_answer": F.coalesce("__boxed", "__named", F.lit("")), "extraction": how}).drop("__boxed", "__named")

    pairs = rows.select("__gold", "final_answer").distinct().where(F.col("final_answer") != "")
    texts = pairs.select(F.col("final_answer").alias("__x")).unionByName(pairs.select(F.col("__gold").alias("__x"))).distinct()
    read = texts.where(F.col("__x").isNotNull()).withColumn("__read", _read_udf("__x"))
    side = lambda n: read.select(F.col("__x").alias(n), F.col("__read.key").alias(f"{n}_key"), F.col("__read.readable").alias(f"{n}_ok"))
    both = pairs.join(side("final_answer"), "final_answer").join(side("__gold"), "__gold", "left")
    keyed = F.col("final_answer_key").isNotNull() & F.col("__gold_key").isNotNull()
    known = (
        F.when(~F.col("final_answer_ok"), "unparsed_answer")
        .when(~F.coalesce("__gold_ok", F.lit(False)), "unsupported_gold")
        .when(keyed, F.when(F.col("final_answer_key") == F.col("__gold_key"), "correct").otherwise("incorrect"))
    )
    both = both.select("__gold", "final_answer", known.alias("status"))
    by_value = both.where(F.col("status").isNull()).withColumn("status", _compare_udf("__gold", "final_answer"))
    graded = both.where(F.col("status").isNotNull()).unionByName(by_value)
    graded = graded.select(F.col("__gold").alias("__g"), F.col("final_answer").alias("__f"), "status")
    same = F.col("__gold").eqNullSafe(F.col("__g")) & (F.col("final_answer") == F.col("__f"))
    status = F.coalesce("status", F.lit("no_final_answer"))
    out = rows.join(graded, same, "left").withColumn("status", status).withColumn("correct", F.col("status") == "correct")
    return out.select(*carried, *names)


boxed_contents_udf = _column(boxed_contents, "string")
boxed_whole_udf = _column(boxed_whole, "string")
boxed_any_udf = _column(boxed_any, "string")
code_block_udf = _column(code_block, "string")
code_that_parses_udf = _column(code_that_parses, "string")
code_status_udf = _column(code_status, "string")
casefold_fingerprint_udf = _column(casefold_fingerprint, "string")
python_round_udf = _column(python_round, "double")


@F.pandas_udf(T.StructType([T.StructField("setup", T.StringType()), T.StructField("tests", T.ArrayType(T.StringType())), T.StructField("problem", T.StringType())]))
def normal_grading_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([normal_grading(x) for x in s], columns=["setup", "tests", "problem"])


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("tests", T.LongType())]))
def test_readiness_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of a domain and the tests as JSON."""
    for domain, tests in batches:
        yield pd.DataFrame([test_readiness(d, json.loads(t or "null")) for d, t in zip(domain, tests, strict=True)], columns=["status", "tests"])


@F.pandas_udf(T.StringType())
def rescue_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for candidate, expected in batches:
        yield pd.Series([None if c is None else rescue(c, e) for c, e in zip(candidate, expected, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def exact_value_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The exact value of a plain calculation as text (``7/3``, ``-2``); anything else raises."""
    for s in batches:
        yield pd.Series([None if x is None else str(exact_value(x)) for x in s], dtype=object)


def on_distinct(df: DataFrame, columns: list[str], function: Callable[..., Column], name: str) -> DataFrame:
    """``df`` with ``name``: the function of these columns, called once for each different combination of their values."""
    each = df.select(*columns).distinct().withColumn(name, function(*columns))
    renamed = each.select(*[F.col(c).alias(f"__{c}") for c in columns], name)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return df.drop(name).join(renamed, condition).drop(*[f"__{c}" for c in columns])


_KEYS = "status string, correct boolean, format_ok boolean, final_answer string"
grade_by_label_udf = _columns(grade_by_label, f"{_KEYS}, needs_review boolean")
grade_by_box_udf = _columns(grade_by_box, f"{_KEYS}, extraction string")
grade_choice_udf = _columns(grade_choice, f"{_KEYS}, needs_review boolean")

#: UDFs by the names under which SQL text can call them.
SQL_FUNCTIONS = {
    "last_boxed": boxed_any_udf,
    "code_block": code_block_udf,
    "code_status": code_status_udf,
    "python_round": python_round_udf,
    "grade_math": grade_by_box_udf,
    "grade_choice": grade_choice_udf,
}


def register(spark) -> None:
    """Makes the graders callable from SQL text."""
    for name, function in SQL_FUNCTIONS.items():
        spark.udf.register(name, function)
