"""Linear equations in the forms that questions use, read and checked as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four forms; a, b and c are whole numbers.
FORMS = {
    "addition": r"(-?\d+)x\s*\+\s*(\d+)\s*=\s*(-?\d+)",
    "soustraction": r"(-?\d+)x\s*-\s*(\d+)\s*=\s*(-?\d+)",
    "distributivite": r"(-?\d+)\(x\s*\+\s*(\d+)\)\s*=\s*(-?\d+)",
    "fraction": r"x/(-?\d+)\s*\+\s*(\d+)\s*=\s*(-?\d+)",
}


def equation_form(question: Column) -> Column:
    """The form of the equation in a question, null if there is none."""
    out = None
    for name, pattern in FORMS.items():
        out = F.when(question.rlike(pattern), name) if out is None else out.when(question.rlike(pattern), name)
    return out


def _number(question: Column, group: int) -> Column:
    out = None
    for pattern in FORMS.values():
        got = F.regexp_extract(question, pattern, group).try_cast("bigint")
        out = F.when(question.rlike(pattern), got) if out is None else out.when(question.rlike(pattern), got)
    return out


def solves(question: Column, x: Column) -> Column:
    """Whether ``x`` put into the equation makes it true; null without an equation.

    A fraction holds if x is a multiple of its divisor; a coefficient or divisor of 0 never does.
    """
    form = equation_form(question)
    a, b, c = (_number(question, g) for g in (1, 2, 3))
    good = (
        F.when(form == "addition", a * x + b == c)
        .when(form == "soustraction", a * x - b == c)
        .when(form == "distributivite", a * (x + b) == c)
        .when(form == "fraction", x == (c - b) * a)
    )
    return F.when(form.isNotNull(), (a != 0) & good)
