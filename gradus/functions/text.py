"""Text helpers as column expressions: white space, lines, labels, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() of Python removes, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Where str.splitlines() of Python cuts.
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def strip(x: Column) -> Column:
    """Removes Unicode white space from both ends (``trim`` removes spaces only)."""
    # a run is entered at its start and never given back, so runs inside cost one pass
    return F.regexp_replace(x, rf"^{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def collapse(x: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return strip(F.regexp_replace(x, rf"{SPACE}+", " "))


def clean_line(x: Column) -> Column:
    """A line without white space and the marks ``*`` and `````  at its ends."""
    marks = r"[ *`\s\p{Z}]"
    return F.regexp_replace(strip(x), rf"^{marks}++|(?<!{marks}){marks}++\z", "")


def lines(x: Column) -> Column:
    """Lines that are not blank, stripped."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), LINE_END), strip), lambda y: y != "")


def cleaned_lines(x: Column) -> Column:
    return F.filter(F.transform(lines(x), clean_line), lambda y: y != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last(values: Column) -> Column:
    """The last element, null of an empty array."""
    return F.try_element_at(values, F.lit(-1))


def fingerprint(question: Column) -> Column:
    """SHA-256 of the text in lower case with collapsed white space."""
    return F.sha2(F.lower(collapse(question)), 256)


def stable_offset(text: Column) -> Column:
    """A number below 2**32 from a text: the first eight hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def as_bool(text: Column) -> Column:
    """True for ``true`` in any case, false for all else, never null."""
    return F.coalesce(F.lower(strip(text)) == "true", F.lit(False))


#: Two sets of texts that stand for a missing prediction.
MISSING = ("", "None")
MISSING_OR_NULL = ("", "None", "null")


def is_missing(x: Column, values: tuple[str, ...] = MISSING) -> Column:
    return F.coalesce(strip(x).isin(*values), F.lit(True))


def integral(raw: Column) -> Column:
    """The number as a long if it is integral, else null (``12.0`` is 12, ``204.5`` is null).

    The digits decide, however many there are: ``12.00000000001`` is no integer. Numbers with
    an exponent are read to 18 decimals; integers beyond a long are null.
    """
    whole = F.regexp_extract(raw, r"^\s*([-+]?\d+)(?:\.0*)?\s*\z", 1)
    plain = F.when(whole != "", whole).try_cast("bigint")
    number = F.when(raw.rlike("(?i)e"), raw).try_cast("decimal(38,18)")
    return F.coalesce(plain, F.when(number == F.floor(number), number).try_cast("bigint"))


def level_between(label: Column, low: int = 3, high: int = 5) -> Column:
    """Whether the first number in a level label lies in a range; unreadable labels are false."""
    level = F.regexp_extract(label, r"\d+", 0).try_cast("int")
    return F.coalesce(level.between(low, high), F.lit(False))


def answer_after_hashes(text: Column) -> Column:
    """What stands behind ``####`` at the end; empty if there is none."""
    return F.regexp_extract(text, r"(?s)####\s*(.+?)\s*\z", 1)


def reasoning_without_marks(text: Column) -> Column:
    """The part before ``####`` without ``<<...>>`` calculator marks."""
    head = F.element_at(F.split(text, "####", 2), 1)
    return strip(F.regexp_replace(head, r"<<[^<>]*>>", ""))


def boxed_answer(reasoning: Column, answer: Column) -> Column:
    """Reasoning, a blank line, and the answer in its final form."""
    final = F.concat(F.lit("REPONSE: \\boxed{"), answer, F.lit("}"))
    return F.when(strip(reasoning) == "", final).otherwise(F.concat(strip(reasoning), F.lit("\n\n"), final))


def normal_number(text: Column) -> Column:
    """A real minus sign, and no commas between thousands."""
    return F.regexp_replace(F.translate(strip(text), "−", "-"), r"(?<=\d),(?=\d{3}(?:\D|$))", "")


def choice_letter(text: Column) -> Column:
    """``(A)``, ``a.`` and the like as ``A``; null for anything but A to E."""
    found = F.regexp_extract(strip(text), r"(?i)^\(?\s*([A-E])\s*\)?[.]?\z", 1)
    return F.when(found != "", F.upper(found))


def has_boxed(text: Column) -> Column:
    return text.rlike(r"\\boxed\s*\{")


def has_final_marker(text: Column) -> Column:
    return text.rlike(r"(?imd)^\s*(?:REPONSE|RÉPONSE|FINAL_ANSWER|Final answer)\s*:")


def has_answer_phrase(text: Column) -> Column:
    return text.rlike(r"(?i)\b(?:the (?:final )?answer is|la réponse est|therefore|thus)\b")


def compose_question(text: Column, first_test: Column) -> Column:
    """A programming task with its first test below."""
    return F.concat_ws("\n\n", strip(text), F.when(F.coalesce(first_test, F.lit("")) != "", first_test))


def compose_choices(question: Column, labels: Column, texts: Column) -> Column:
    """A question with its choices, one in a line; the shorter list ends it."""
    n = F.least(F.size(labels), F.size(texts))
    pairs = F.filter(F.arrays_zip(labels.alias("l"), texts.alias("t")), lambda p: p["l"].isNotNull() & p["t"].isNotNull())
    shown = F.transform(F.slice(pairs, F.lit(1), F.greatest(n, F.lit(0))), lambda p: F.concat(F.lit("("), p["l"], F.lit(") "), p["t"]))
    return F.concat_ws("\n", question, F.array_join(shown, "\n"))


def prompt(system: str, user: Column) -> Column:
    """A chat prompt as plain text; a model's own template is applied outside."""
    return F.concat_ws("\n\n", F.lit(system), user)


def sorted_json(fields: dict[str, Column]) -> Column:
    """An object with its fields in the order of their names, a blank behind ``:`` and ``,``; null is ``null``."""
    cells = []
    for name in sorted(fields):
        one = F.to_json(F.struct(fields[name].alias(name)))  # {"name":value}, {} for null
        head = F.length(F.to_json(F.struct(F.lit(0).alias(name)))) - 2
        value = F.substr(one, head + 1, F.length(one) - head - 1)
        cells.append(F.concat(F.substr(F.to_json(F.struct(F.lit(0).alias(name))), F.lit(2), head - 1), F.lit(" "), F.when(fields[name].isNull(), "null").otherwise(value)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}"))


def case_hash(fields: dict[str, Column]) -> Column:
    """Digest of a test case, whatever order its fields are given in. Letters beyond ASCII stay as they are."""
    return F.sha2(sorted_json(fields), 256)
