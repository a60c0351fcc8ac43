"""Equality of mathematical answers: numbers, fractions, a LaTeX subset, tuples and sets.

An expression is parsed to a tree. Where it is a quotient of polynomials (letters, pi, square roots and rational
numbers), the tree gives its normal form, and equality is equality of keys (``canonical_key``). Other expressions are
compared by value, as doubles, those with letters at several points. What cannot be parsed gives None, which
graders report as a status.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction

from gradus.functions.canonical import Inexact, Quotient, as_quotient

#: Points at which letters are evaluated: letter k has POINTS[j] + k / 7 at point j.
POINTS = (Fraction(37, 11), Fraction(53, 29), Fraction(97, 41))
MAX_EXPONENT = 64

_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|\d+(?:\.\d+)?|\.\d+|[A-Za-z]|[-+*/^(){}\[\],=_|!%]")
_DROP = re.compile(r"\\(?:left|right|displaystyle|,|;|!|quad|qquad)\b|\\[,;! ]|\\\$|\$|°|\^\\circ|\^\{\\circ\}|~")
_TEXT = re.compile(r"\\(?:text|mathrm|mbox|textbf)\s*\{[^{}]*\}")
_FUNCTIONS = {"\\sin": math.sin, "\\cos": math.cos, "\\tan": math.tan, "\\ln": math.log, "\\log": math.log10}


class Unreadable(ValueError):
    pass


@dataclass(frozen=True)
class Group:
    """A tuple, interval or set: opening and closing mark, and the values inside."""

    marks: str
    items: tuple


def unwrap(text: str) -> str:
    """The inside of ``\\boxed{...}`` if the text is one, else the text."""
    found = re.fullmatch(r"\s*\\boxed\s*\{(.*)\}\s*", text, re.S)
    return found.group(1) if found else text


def _tokens(text: str) -> list[str]:
    text = unwrap(text.strip()).replace("−", "-").replace("×", "*").replace("·", "*").replace("π", "\\pi ")
    text = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", text.replace("{,}", ","))
    text = _TEXT.sub(" ", _DROP.sub(" ", text)).replace("\\{", " \\lbrace ").replace("\\}", " \\rbrace ")
    out, at = [], 0
    text = text.strip().rstrip(".")
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(text)
        out.append(m.group())
        at = m.end()
    return out


class _Reader:
    """Recursive descent; a node is a function of what letters and numbers stand for."""

    def __init__(self, tokens: list[str]):
        self.t, self.i = tokens, 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str = "") -> str:
        got = self.peek()
        if not got or (want and got != want):
            raise Unreadable(got)
        self.i += 1
        return got

    def top(self):
        values = [self.equation()]
        while self.peek() == ",":
            self.take()
            values.append(self.equation())
        if self.i < len(self.t):
            raise Unreadable(self.peek())
        return values[0] if len(values) == 1 else (lambda env: Group("", tuple(v(env) for v in values)))

    def equation(self):
        left = self.sum()
        if self.peek() == "=":  # ``x = 5`` stands for 5
            self.take()
            return self.sum()
        return left

    def sum(self):
        node = self.product()
        while self.peek() in ("+", "-"):
            sign, right = self.take(), self.product()
            node = (lambda a, b: lambda env: a(env) + b(env))(node, right) if sign == "+" else (lambda a, b: lambda env: a(env) - b(env))(node, right)
        return node

    def product(self):
        node = self.signed()
        while True:
            now = self.peek()
            if now in ("*", "\\cdot", "\\times"):
                self.take()
                node = (lambda a, b: lambda env: a(env) * b(env))(node, self.signed())
            elif now in ("/", "\\div"):
                self.take()
                node = (lambda a, b: lambda env: _divide(a(env), b(env)))(node, self.signed())
            elif now and (now in ("(", "{") or now[0].isalnum() or now in ("\\frac", "\\dfrac", "\\tfrac", "\\sqrt", "\\pi") or now in _FUNCTIONS):
                node = (lambda a, b: lambda env: a(env) * b(env))(node, self.power())
            else:
                return node

    def signed(self):
        if self.peek() == "-":
            self.take()
            inner = self.signed()
            return lambda env: -inner(env)
        if self.peek() == "+":
            self.take()
            return self.signed()
        return self.power()

    def power(self):
        base = self.atom()
        while self.peek() in ("!", "%", "\\%"):
            mark = self.take()
            base = (lambda a: lambda env: a(env) / 100)(base) if mark != "!" else (lambda a: lambda env: _factorial(a(env)))(base)
        if self.peek() == "^":
            self.take()
            exponent = self.signed()
            return lambda env: _power(base(env), exponent(env))
        return base

    def braced(self):
        if self.peek() == "{":
            self.take()
            node = self.sum()
            self.take("}")
            return node
        now = self.take()
        if now.isdigit():  # \frac12: one digit each
            if len(now) > 1:
                self.t[self.i - 1 : self.i] = list(now)
                now = self.t[self.i - 1]
            value = Fraction(now)
            return lambda env: env(value)
        self.i -= 1
        return self.atom()

    def atom(self):
        now = self.take()
        if now[0].isdigit() or now[0] == ".":
            value = Fraction(now)
            return lambda env: env(value)
        if now == "\\pi":
            return lambda env: env(now)
        if now.isalpha():
            if self.peek() == "_":
                self.take()
                self.braced()
            return lambda env: env(now)
        if now in ("\\frac", "\\dfrac", "\\tfrac"):
            a = self.braced()
            b = self.braced()
            return lambda env: _divide(a(env), b(env))
        if now == "\\sqrt":
            n = None
            if self.peek() == "[":
                self.take()
                n = self.sum()
                self.take("]")
            x = self.braced()
            return lambda env: _root(x(env), n(env) if n else 2)
        if now in _FUNCTIONS:
            x = self.power()
            return lambda env: _FUNCTIONS[now](x(env))
        if now in ("(", "[", "{", "\\lbrace"):
            values = [self.equation()]
            while self.peek() == ",":
                self.take()
                values.append(self.equation())
            close = self.take()
            if close not in (")", "]", "}", "\\rbrace"):
                raise Unreadable(close)
            if len(values) == 1 and now in ("(", "{") and close in (")", "}"):
                return values[0]
            return lambda env: Group(now + close, tuple(v(env) for v in values))
        raise Unreadable(now)


def _divide(a, b):
    if b == 0:
        raise Unreadable("division by zero")
    return a / b


def _power(a, b):
    if isinstance(a, Quotient) or isinstance(b, Quotient):
        exponent = as_quotient(b).value
        if exponent is None:
            raise Inexact("power")
        return as_quotient(a).power(exponent)
    if isinstance(a, Fraction) and isinstance(b, Fraction) and b.denominator == 1 and abs(b) <= MAX_EXPONENT:
        return a ** int(b)
    return float(a) ** float(b)


def _root(x, n):
    if isinstance(x, Quotient):
        if n != 2:
            raise Inexact("root")
        return x.root()
    if isinstance(x, Fraction) and x >= 0 and n == 2:
        a, b = math.isqrt(x.numerator), math.isqrt(x.denominator)
        if a * a == x.numerator and b * b == x.denominator:
            return Fraction(a, b)
    return float(x) ** (1 / float(n))


def _factorial(x):
    if isinstance(x, Quotient):
        return Quotient.number(_factorial(x.value))
    if not isinstance(x, Fraction) or x.denominator != 1 or not 0 <= x <= 170:
        raise Unreadable("factorial")
    return Fraction(math.factorial(int(x)))


def _at(point: Fraction):
    """What letters and numbers stand for at a point."""

    def env(x):
        if isinstance(x, Fraction):
            return x
        return math.pi if x == "\\pi" else point + Fraction(ord(x) % 64, 7)

    return env


def _symbols(x):
    """What they stand for in a normal form."""
    return Quotient.number(x) if isinstance(x, Fraction) else Quotient.atom("pi" if x == "\\pi" else x)


def canonical_key(text: str | None) -> str | None:
    """The key of the expression's normal form; None if it can't be read, has none, or is a tuple, interval or set."""
    if text is None or not text.strip():
        return None
    try:
        value = _Reader(_tokens(text)).top()(_symbols)
        return value.key if isinstance(value, Quotient) else None
    except (Unreadable, ArithmeticError, ValueError, TypeError, AttributeError, RecursionError):
        return None


def read_values(text: str | None) -> list | None:
    """The expression's value at each point, or None if it cannot be read."""
    if text is None or not text.strip():
        return None
    try:
        node = _Reader(_tokens(text)).top()
        out = []
        for p in POINTS:
            out.append(node(_at(p)))
        return out
    except (Unreadable, ArithmeticError, ValueError, TypeError, AttributeError, RecursionError):
        return None


def _same(a, b) -> bool:
    if isinstance(a, Group) or isinstance(b, Group):
        if not (isinstance(a, Group) and isinstance(b, Group)) or len(a.items) != len(b.items):
            return False
        if "\\lbrace" in a.marks + b.marks:  # sets: in any order
            left = list(b.items)
            for x in a.items:
                hit = next((i for i, y in enumerate(left) if _same(x, y)), None)
                if hit is None:
                    return False
                left.pop(hit)
            return True
        return (a.marks or b.marks) == (b.marks or a.marks) and all(map(_same, a.items, b.items))
    if isinstance(a, complex) or isinstance(b, complex):
        return abs(complex(a) - complex(b)) <= 1e-9 * max(1.0, abs(complex(b)))
    if isinstance(a, Fraction) and isinstance(b, Fraction):
        return a == b
    return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-12)


def equal_values(a: list, b: list) -> bool:
    return all(map(_same, a, b))


def equal_texts(a: str, b: str) -> bool:
    """Whether two expressions that can be read are equal: by their keys, or else by their values."""
    left, right = canonical_key(a), canonical_key(b)
    if left is not None and right is not None:
        return left == right
    return equal_values(read_values(a), read_values(b))


# -- whole numbers under + - * /


def exact_value(expression: str) -> Fraction:
    """The value of an expression of integers, + - * /, signs and parentheses; anything else raises."""
    if not re.fullmatch(r"[\d\s+*/()-]+", expression):
        raise ValueError(f"not a plain calculation: {expression!r}")
    values = read_values(expression)
    if values is None or not isinstance(values[0], Fraction):
        raise ValueError(f"not a plain calculation: {expression!r}")
    return values[0]
