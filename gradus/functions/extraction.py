"""Answer extraction and grading of short integer answers, as column expressions.

Several generations of extractors exist side by side; a result says which it comes from.
Each returns columns, so grading stays inside code generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions.text import cleaned_lines, integral, last, let, lines, strip

# Labels, verbs and number forms that the graders accept.
LABEL_SHORT = r"(?:R[ÉE]PONSE|RESPONSE)"
LABEL = r"(?:R[ÉE]PONSE|RESPONSE|R[ÉE]SULTAT|RESULTAT)"
LABEL_WITH_TYPOS = r"(?:R[ÉE]PONSE|RESPONSE|R[ÉE]SULTAT|RESULTAT|REPMESSE(?:MENT)?)"
VERBS = r"(?:est|is|affiche|vaut)"
VERBS_MORE = r"(?:est|is|vaut|affiche|donne)"
X_IS = r"(?:x\s*=\s*)?"
WHOLE = r"(-?\d+)(?:\.0+)?"
NUMBER = r"(-?\d+(?:\.\d+)?)"
STOP = r"\s*[.!]?\s*"
CONCLUSION = r"(?i)^\s*(?:therefore|thus|hence|so|finally|in conclusion|the final answer is|the answer is)\b\s*[,:\s]*"
CONCLUSION_NUMBER = r"(?<![A-Za-z0-9_])[-+]?\d[\d,]*(?:\.\d+)?(?:/\d+)?(?![A-Za-z0-9_])"

_I = "(?iU)"  # case and classes by Unicode
_LINES = "(?iUmd)"  # ^ and $ at line feeds only


def _first(x: Column, pattern: str) -> Column:
    """Group 1 of the first match; null if there is none."""
    got = F.regexp_extract(x, pattern, 1)
    return F.when(got != "", got)


def _long(x: Column) -> Column:
    return x.try_cast("bigint")


def _last_of_all(x: Column, pattern: str) -> Column:
    return _long(last(F.regexp_extract_all(x, F.lit(pattern), F.lit(1))))


def _last_line(x: Column) -> Column:
    return F.coalesce(last(lines(x)), F.lit(""))


def _phrase(line: Column) -> Column:
    return _long(_first(line, rf"{_I}{VERBS}\s+[`*]*{WHOLE}[`*]*[.!]?\s*$"))


@dataclass(frozen=True)
class Extracted:
    value: Column
    method: Column


def extract_v1(text: Column) -> Extracted:
    """Last labelled number anywhere; a text that is a number; a verb and a number in the last line."""
    explicit = _last_of_all(text, rf"{_I}{LABEL_SHORT}\s*:\s*{X_IS}{WHOLE}")
    numeric = _long(_first(text, rf"(?U)^\s*{X_IS}{WHOLE}{STOP}\z"))
    fallback = _phrase(strip(F.coalesce(last(F.split(strip(text), r"\r\n|[\n\r]")), F.lit(""))))
    return _by_method(explicit, numeric, fallback)


def extract_v2(text: Column) -> Extracted:
    """As v1, but the label has to fill its line (bold marks allowed)."""
    explicit = _last_of_all(text, rf"{_LINES}^\s*\**{LABEL_SHORT}\**\s*:\s*{X_IS}{WHOLE}{STOP}$")
    numeric = _long(_first(text, rf"(?U)^\s*{X_IS}{WHOLE}{STOP}\z"))
    return _by_method(explicit, numeric, _phrase(_last_line(text)))


def _by_method(explicit: Column, numeric: Column, fallback: Column) -> Extracted:
    method = F.when(explicit.isNotNull(), "explicit").when(numeric.isNotNull(), "numeric")
    method = method.when(fallback.isNotNull(), "fallback").otherwise("not_found")
    return Extracted(F.coalesce(explicit, numeric, fallback), method)


def _bare(line: Column) -> Column:
    return _long(_first(line, rf"(?U)^{WHOLE}[.!]?\z"))


def _equation(line: Column) -> Column:
    return _long(_first(line, rf"{_I}^x\s*=\s*{WHOLE}[.!]?\z"))


def _calculation(line: Column) -> Column:
    return _long(_first(line, rf"(?U)^[0-9\s()+*/.-]+=\s*{WHOLE}\z"))


def _labelled_line(text: Column) -> Column:
    return _last_of_all(text, rf"{_LINES}^\s*\**{LABEL}\**\s*:\s*{X_IS}{WHOLE}{STOP}$")


def extract_v3(text: Column) -> Extracted:
    """Labels of results as well, then forms of the last line; the method tells explicit ones."""
    explicit, line = _labelled_line(text), _last_line(text)
    rest = F.coalesce(_bare(line), _equation(line), _phrase(line))
    return _by_method(explicit, F.lit(None).cast("bigint"), rest)


def extract_v4(text: Column, domain: Column) -> Extracted:
    """As v3; in ``maths`` a calculation that ends in ``= number`` counts last."""
    explicit, line = _labelled_line(text), _last_line(text)
    sum_ = F.when(domain == "maths", _calculation(line))
    return _by_method(explicit, F.lit(None).cast("bigint"), F.coalesce(_bare(line), _equation(line), _phrase(line), sum_))


def extract_v5(text: Column, domain: Column) -> Extracted:
    """The last line only, without marks; a calculation goes before a phrase."""
    line = F.coalesce(last(cleaned_lines(text)), F.lit(""))
    explicit = _long(_first(line, rf"{_I}^{LABEL}\s*:\s*{X_IS}{WHOLE}[.!]?\z"))
    sum_ = F.when(domain == "maths", _calculation(line))
    return _by_method(explicit, F.lit(None).cast("bigint"), F.coalesce(_bare(line), _equation(line), sum_, _phrase(line)))


def extract_smoke(text: Column) -> Extracted:
    """A line that is a labelled number, or a text that is a number."""
    explicit = _last_of_all(text, rf"{_LINES}^\s*{LABEL}\s*:\s*{WHOLE}{STOP}$")
    return _by_method(explicit, _long(_first(text, rf"(?U)^\s*{WHOLE}{STOP}\z")), F.lit(None).cast("bigint"))


# -- analysers: labels, conclusion, conflict


def _conclusion(line: Column, domain: Column, verbs: str, tail: str, sums: str) -> tuple[Column, Column]:
    """(raw number, whether any form matched) of a last line; the first form that matches decides."""
    forms = [
        _first(line, rf"{_I}^{LABEL_WITH_TYPOS}\s*:\s*{X_IS}{NUMBER}{tail}\z"),
        _first(line, rf"(?U)^{NUMBER}{tail}\z"),
        _first(line, rf"{_I}^x\s*=\s*{NUMBER}{tail}\z"),
        _first(line, rf"{_I}{verbs}\s+{X_IS}[`*]*{NUMBER}[`*]*[.!]?\s*\z"),
        F.when(domain == "maths", _first(line, rf"(?U)^{sums}+=\s*{NUMBER}{tail}\z")),
    ]
    return F.coalesce(*forms), F.coalesce(*forms).isNotNull()


@dataclass(frozen=True)
class Analysis:
    status: Column
    prediction: Column
    declared: Column
    conclusion: Column
    conclusion_correct: Column
    format_ok: Column

    def columns(self) -> dict[str, Column]:
        strict = self.status == "correct"
        return {
            "status": self.status,
            "prediction": self.prediction,
            "declared": self.declared,
            "conclusion": self.conclusion,
            "conclusion_correct": self.conclusion_correct,
            "strict_correct": strict,
            "format_ok": self.format_ok,
            "end_to_end": strict & self.format_ok,
        }


def _read(all_lines: Column, domain: Column, tail: str, verbs: str, sums: str) -> Column:
    """Struct of what the lines say, each part evaluated once: ``end`` (last line), ``empty``,
    ``declared`` (integral values of lines that are labels, in order), ``odd`` (some label is
    not integral) and ``conclusion`` (the last line's number, if it is integral)."""
    pattern = rf"{_I}^{LABEL_WITH_TYPOS}\s*:\s*{X_IS}{NUMBER}{tail}\z"

    def parts(ls: Column) -> Column:
        raw = F.filter(F.transform(ls, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")
        return F.struct(
            F.coalesce(last(ls), F.lit("")).alias("end"), (F.size(ls) == 0).alias("empty"), F.transform(raw, integral).alias("values")
        )

    def numbers(p: Column) -> Column:
        return F.struct(
            p["end"].alias("end"),
            p["empty"].alias("empty"),
            F.filter(p["values"], lambda v: v.isNotNull()).alias("declared"),
            F.exists(p["values"], lambda v: v.isNull()).alias("odd"),
            let(_conclusion(p["end"], domain, verbs, tail, sums)[0], integral).alias("conclusion"),
        )

    return let(let(all_lines, parts), numbers)


def _in_conflict(read: Column) -> Column:
    """Whether labels differ among themselves or from the conclusion."""
    return (F.size(F.array_distinct(read["declared"])) > 1) | (
        read["conclusion"].isNotNull() & F.exists(read["declared"], lambda v: v != read["conclusion"])
    )


def _analysis(read: Column, status, expected: Column, prediction, format_ok) -> Analysis:
    """An analysis of one struct, which is evaluated once."""

    def judged(r: Column) -> Column:
        found = F.coalesce(r["conclusion"], last(r["declared"]))
        return F.struct(r.alias("r"), found.alias("found"), status(r, found).alias("status"))

    def named(j: Column) -> Column:
        r = j["r"]
        return F.struct(
            j["status"].alias("status"), prediction(j).alias("prediction"), r["declared"].alias("declared"), r["conclusion"].alias("conclusion"),
            F.coalesce(r["conclusion"] == expected, F.lit(False)).alias("conclusion_correct"), format_ok(r).alias("format_ok"),
        )

    out = let(let(read, judged), named)
    return Analysis(*[out[f] for f in ("status", "prediction", "declared", "conclusion", "conclusion_correct", "format_ok")])


def _status(conflict_name: str, conflict: Column, prediction: Column, expected: Column, non_integer: Column | None) -> Column:
    out = F.when(conflict, conflict_name)
    if non_integer is not None:
        out = out.when(non_integer, "non_integer")
    return out.when(prediction.isNull(), "missing").when(prediction == expected, "correct").otherwise("incorrect")


def analyse_final(text: Column, domain: Column, expected: Column) -> Analysis:
    """The reference grader of short answers: a contradiction is never correct.

    Labels of all lines are read without looking at the expected value. The conclusion is
    the last line's; if labels differ among themselves or from it the answer is
    ``contradictory``; else a label that is no integer makes it ``non_integer``.
    """
    read = _read(cleaned_lines(text), domain, STOP, r"\b(?:est|is|vaut|affiche|donne|qui\s+est)\b", r"[\d\s()+*/%.,-]")

    def status(r: Column, found: Column) -> Column:
        return F.when(r["empty"], "missing").otherwise(_status("contradictory", _in_conflict(r), found, expected, r["odd"]))

    return _analysis(
        read,
        status,
        expected,
        lambda j: F.when(j["status"].isin("correct", "incorrect"), j["found"]),
        lambda r: let(_first(r["end"], rf"{_I}^REPONSE:\s*{NUMBER}\z"), integral).isNotNull() & ~r["empty"],
    )


def analyse_reconciled(text: Column, domain: Column, expected: Column) -> Analysis:
    """The older policy: anything in doubt is ``ambiguous`` and left to a reviewer."""
    marks = F.transform(lines(text), lambda x: F.regexp_replace(strip(x), r"^[ *`]+|[ *`]+\z", ""))
    read = _read(marks, domain, r"\s*[.!]?", VERBS_MORE, r"[\d\s()+*/%.-]")

    def status(r: Column, found: Column) -> Column:
        return F.when(r["empty"], "missing").otherwise(_status("ambiguous", r["odd"] | _in_conflict(r), found, expected, None))

    return _analysis(read, status, expected, lambda j: j["found"], lambda r: F.lit(False))


def extract_consistent(text: Column) -> tuple[Column, Column]:
    """(number of a labelled last line, whether no earlier label contradicts it)."""
    marks = F.transform(lines(text), lambda x: F.regexp_replace(x, r"^[ *`]+|[ *`]+\z", ""))
    end = F.coalesce(last(marks), F.lit(""))
    value = _long(_first(end, rf"{_I}^\s*{LABEL}\s*:\s*{X_IS}{WHOLE}{STOP}\z"))
    pattern = rf"{_I}^\s*{LABEL_WITH_TYPOS}\s*:\s*{NUMBER}\s*\z"
    before = F.slice(marks, F.lit(1), F.greatest(F.size(marks) - 1, F.lit(0)))
    clash = F.exists(before, lambda x: x.rlike(pattern) & (F.regexp_extract(x, pattern, 1).try_cast("double") != value.cast("double")))
    return value, value.isNotNull() & ~F.coalesce(clash, F.lit(False))


# -- recheck of conclusions


def conclusion_candidate(text: Column) -> tuple[Column, Column]:
    """(category, candidate) of a last line that draws a conclusion with one number."""
    end = _last_line(text)
    numbers = F.regexp_extract_all(F.regexp_replace(end, CONCLUSION, ""), F.lit(CONCLUSION_NUMBER), F.lit(0))
    category = (
        F.when(F.size(lines(text)) == 0, "empty_response")
        .when(~end.rlike(CONCLUSION), "no_explicit_conclusion")
        .when(F.size(numbers) == 0, "no_numeric_candidate")
        .when(F.size(numbers) > 1, "ambiguous_multiple_numbers")
        .otherwise("unique_numeric_candidate")
    )
    return category, F.when(category == "unique_numeric_candidate", F.element_at(numbers, 1))


def recheck_route(truncated: Column, domain: Column, text: Column, rescuable: str = "maths_appliques") -> Column:
    """Why an ungraded response can't or may be rescued; the first reason that holds."""
    return (
        F.when(truncated, "truncated")
        .when(domain != rescuable, "other_domain")
        .when(text.rlike(r"\\boxed\s*\{"), "has_boxed")
        .otherwise(conclusion_candidate(text)[0])
    )


def is_truncated(tokens: Column, limit: int, last_token: Column, stops: tuple[int, ...]) -> Column:
    """All tokens used up and no stop token at the end."""
    return (tokens >= limit) & ~last_token.isin(*stops)


def transition(before: Column, after: Column) -> Column:
    """What became of a question between two models."""
    return (
        F.when(~before & after, "improved")
        .when(before & ~after, "regressed")
        .when(before & after, "correct_both")
        .otherwise("incorrect_both")
    )
