"""Classification of questions and errors by rules; the order of rules is part of each version."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions.text import LINE_END, strip


def _after_colon(question: Column) -> Column:
    at = F.instr(question, ":")
    return strip(F.when(at > 0, F.substr(question, at + 1)).otherwise(question))


def _rules(text: Column, rules: list[tuple[str, str]], rest: str | None) -> Column:
    """The first rule whose mark occurs in the text."""
    out = None
    for mark, name in rules:
        hit = text.contains(mark)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(rest))


# Marks and names of the classes.
_CODE_RULES = [("**", "puissance"), ("//", "division_entiere"), ("sum(", "somme_liste"), ("len(", "longueur_liste"), ("%", "modulo")]


def subtype(question: Column, domain: Column) -> Column:
    """Current version: division is looked for before multiplication, code in the last line."""
    tail = _after_colon(question)
    maths = _rules(tail, [("(", "operations_combinees"), ("/", "division"), ("*", "multiplication"), ("-", "soustraction")], "addition")
    algebra = (
        F.when(tail.contains("x/"), "equation_fraction")
        .when(tail.contains("(x"), "distributivite")
        .when(tail.rlike(r"\dx\s*-\s*\d+"), "equation_soustraction")
        .otherwise("equation_addition")
    )
    code = _rules(F.element_at(F.split(strip(question), LINE_END), -1), _CODE_RULES, "autre")
    return F.when(domain == "maths", maths).when(domain == "algebre", algebra).when(domain == "code", code)


def exercise_type(question: Column, domain: Column) -> Column:
    """First version: multiplication before division, and ``autre`` for the rest."""
    q = strip(question)
    maths = _rules(
        strip(F.replace(q, F.lit("Calcule :"), F.lit(""))),
        [("(", "operations_combinees"), ("*", "multiplication"), ("/", "division"), ("+", "addition"), ("-", "soustraction")],
        "autre",
    )
    tail = _after_colon(q)
    algebra = (
        F.when(tail.contains("("), "distributivite")
        .when(tail.startswith("x/"), "equation_fraction")
        .when(tail.contains("x +"), "equation_addition")
        .when(tail.contains("x -"), "equation_soustraction")
        .otherwise("autre")
    )
    code = _rules(q, _CODE_RULES, "autre")
    return F.when(domain == "maths", maths).when(domain == "algebre", algebra).when(domain == "code", code).otherwise("autre")


def error_category(status: Column, error: Column) -> Column:
    """Category of a graded program: its status, or the name of the exception it raised."""
    name = strip(F.split(F.coalesce(error, F.lit("")), ":", 2)[0])
    raised = F.when(name == "", "other_execution_error").otherwise(name)
    return F.when(status == "failed_assertion", "incorrect_result").when(status == "execution_error", raised).otherwise(status)


#: Statuses that say nothing about the program and are never persisted.
TRANSIENT = ("container_error", "timeout", "invalid_runner_output", "invalid_runner_json")
#: All statuses that a sandbox may report.
SANDBOX_STATUSES = ("passed", "missing_dependency", "failed_assertion", "syntax_error", "execution_error", *TRANSIENT)
