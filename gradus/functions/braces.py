"""Boxed answers with balanced braces as column expressions.

A text is cut behind each brace, and the depth is a running sum over the pieces: one pass forward finds where a brace
closes, one pass backward which of several markers is the last that closes at all. The state of a pass is a
few numbers, so the cost is linear in the text, however deep braces are nested.

Defined results: a null text, and one without a marker that closes, give null; braces that are not part of a marker
count for the depth like any other, also behind a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions.text import SPACE, let, strip

MARKER = "\\boxed"
_OPEN = rf"\\boxed{SPACE}*\{{"


def _pieces(text: Column) -> Column:
    """The text up to its last brace, cut behind each brace."""
    upto = F.regexp_extract(text, r"(?s)\A.*[{}]", 0)
    return F.regexp_extract_all(upto, F.lit(r"[^{}]*[{}]"), F.lit(0))


def _step(piece: Column) -> Column:
    return F.when(F.endswith(piece, F.lit("{")), 1).otherwise(-1)


def closing(text: Column) -> Column:
    """Number of characters up to the brace that closes the first one of a text; 0 if none does."""

    def add(state: Column, piece: Column) -> Column:
        depth, at = state["depth"] + _step(piece), state["at"] + F.length(piece)
        open_ = state["end"] == 0
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(open_ & (depth == 0), at).otherwise(state["end"]).alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    return F.aggregate(_pieces(text), start, add, lambda s: s["end"])


def _upto_closing(tail: Column) -> Column:
    """A text up to the brace that closes its first one; null if none does."""
    return let(F.struct(tail.alias("t"), closing(tail).alias("n")), lambda x: F.when(x["n"] > 0, F.substr(x["t"], F.lit(1), x["n"])))


def _last_marker(text: Column) -> Column:
    """The text from the brace of its last ``\\boxed{`` on; null without one."""
    mark = MARKER + "{"
    return F.when(F.contains(text, F.lit(mark)), F.concat(F.lit("{"), F.substring_index(text, mark, -1)))


def boxed_contents(text: Column) -> Column:
    """Inside of the last ``\\boxed{``, stripped; null if its braces don't close."""
    return let(_upto_closing(_last_marker(text)), lambda x: strip(F.substr(x, F.lit(2), F.length(x) - 2)))


def boxed_whole(text: Column) -> Column:
    """The last ``\\boxed{...}`` with its wrapper; null if the last one doesn't close."""
    return F.concat(F.lit(MARKER), _upto_closing(_last_marker(text)))


def _last_that_closes(text: Column) -> Column:
    """How many characters before the end of the pieces the last marker that closes begins; 0 if none does.

    Backwards, a marker closes if the depth behind it falls below its own somewhere.
    """

    def back(state: Column, piece: Column) -> Column:
        opened = F.regexp_extract(piece, _OPEN + r"\z", 0)
        found = (state["start"] == 0) & (opened != "") & (state["least"] < state["depth"])
        return F.struct(
            (state["depth"] - _step(piece)).alias("depth"),  # behind the brace before
            F.least(state["least"], state["depth"]).alias("least"),
            (state["at"] + F.length(piece)).alias("at"),
            F.when(found, state["at"] + F.length(opened)).otherwise(state["start"]).alias("start"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(1 << 30).alias("least"), F.lit(0).alias("at"), F.lit(0).alias("start"))
    return F.aggregate(F.reverse(_pieces(text)), start, back, lambda s: s["start"])


def boxed_any(text: Column) -> Column:
    """The last ``\\boxed {...}`` that closes, blanks before the brace allowed, with its wrapper."""
    upto = F.regexp_extract(text, r"(?s)\A.*[{}]", 0)
    tail = let(F.struct(upto.alias("t"), _last_that_closes(text).alias("n")), lambda x: F.when(x["n"] > 0, F.right(x["t"], x["n"])))
    return let(tail, _upto_closing)
