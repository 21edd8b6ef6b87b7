r"""Equality of mathematical answers, by an exact normal form of what they say.

A reader goes through an answer once, rule by rule, and gives sums of fractions times square
roots times powers of letters: ``\frac{2}{4}``, ``0.5``, ``50\%`` and ``\sqrt{\frac14}`` are all 1/2. Lists,
tuples, intervals and sets are their brackets and their parts (a set's in any order). What stands before the last ``=``, units in
``\text``, degrees, dollar signs and spacing count for nothing. An answer that isn't understood, or that divides by zero, has
no normal form; then only equal texts are equal.
"""

from __future__ import annotations

import re
from fractions import Fraction
from math import isqrt

_WORD = re.compile(r"\d+(?:,\d{3})+(?:\.\d+)?(?![\d,])|\d+(?:\.\d+)?|\.\d+|\\[a-zA-Z]+|\\.|[a-zA-Z]|\S")
_SPACE = re.compile(r"\\[!,;:> ]|\\(?:left|right|displaystyle|quad|qquad|limits)(?![a-zA-Z])|\\?\$|~")
_DROPPED = re.compile(r"\^\s*(?:\{\s*\\circ\s*\}|\\circ)|\\degree|\\(?:text|mathrm|textbf|mbox)\s*\{[^{}]*\}(?:\s*\^\s*\d)?")
_ROOTS = 10**12

#: A sum: of each product of a root (of a whole number without square factors) and powers of letters, the fraction before it.
Sum = dict[tuple[int, tuple[tuple[str, int], ...]], Fraction]
_ONE = (1, ())


class _Unreadable(Exception):
    pass


def _number(x: Fraction | int) -> Sum:
    return {_ONE: Fraction(x)} if x else {}


def _plus(a: Sum, b: Sum, sign: int = 1) -> Sum:
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, Fraction(0)) + sign * v
    return {k: v for k, v in out.items() if v}


def _square_free(n: int) -> tuple[int, int]:
    """``n`` as the square of the first number times the second."""
    if n > _ROOTS:
        raise _Unreadable
    whole, k = 1, 2
    while k * k <= n:
        while n % (k * k) == 0:
            n, whole = n // (k * k), whole * k
        k += 1
    return whole, n


def _times(a: Sum, b: Sum) -> Sum:
    out: Sum = {}
    for (r, x), v in a.items():
        for (s, y), w in b.items():
            whole, root = _square_free(r * s)
            powers = dict(x)
            for letter, n in y:
                powers[letter] = powers.get(letter, 0) + n
            key = root, tuple(sorted((c, n) for c, n in powers.items() if n))
            out = _plus(out, {key: v * w * whole})
    return out


def _inverse(a: Sum) -> Sum:
    if len(a) == 2 and all(not x for _, x in a):  # p + q by its conjugate
        (k, v), (m, w) = a.items()
        other = {k: v, m: -w}
        square = _times(a, other)
        if list(square) == [_ONE]:
            return _times(other, _number(1 / square[_ONE]))
    if len(a) != 1:
        raise _Unreadable
    [((root, letters), v)] = a.items()
    return {(root, tuple((c, -n) for c, n in letters)): 1 / (v * root)}


def _power(a: Sum, by: Sum) -> Sum:
    if by and list(by) != [_ONE]:
        raise _Unreadable
    n = by.get(_ONE, Fraction(0))
    if n.denominator == 2 and abs(n) < 20:
        return _power(_root(a), _number(n * 2))
    if n.denominator != 1 or abs(n) > 200 or (not a and n <= 0):
        raise _Unreadable
    base, out = (_inverse(a) if n < 0 else a), _number(1)
    for _ in range(abs(int(n))):
        out = _times(out, base)
        if len(out) > 100 or any(abs(v.numerator).bit_length() + v.denominator.bit_length() > 4000 for v in out.values()):
            raise _Unreadable
    return out


def _root(a: Sum) -> Sum:
    if not a:
        return a
    if list(a) != [_ONE] or a[_ONE] < 0:
        raise _Unreadable
    x = a[_ONE]
    if isqrt(x.numerator) ** 2 == x.numerator and isqrt(x.denominator) ** 2 == x.denominator:
        return _number(Fraction(isqrt(x.numerator), isqrt(x.denominator)))
    whole, root = _square_free(x.numerator * x.denominator)
    return {(root, ()): Fraction(whole, x.denominator)}


class _Reader:
    """Reads sums of products of powers of atoms."""

    def __init__(self, text: str):
        self.words, self.at = _WORD.findall(text), 0

    def next(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def take(self, *words: str) -> bool:
        if self.next() in words and self.next():
            self.at += 1
            return True
        return False

    def sum(self) -> Sum:
        out = self.product()
        while self.next() in ("+", "-"):
            sign = 1 if self.next() == "+" else -1
            self.at += 1
            out = _plus(out, self.product(), sign)
        return out

    def product(self) -> Sum:
        out = self.signed()
        while True:
            if self.take("*", "\\cdot", "\\times"):
                out = _times(out, self.signed())
            elif self.take("/", "\\div"):
                out = _times(out, _inverse(self.signed()))
            elif re.fullmatch(r"[a-zA-Z({]|\\(?:pi|d?t?frac|sqrt)", self.next()):
                # a whole number before a fraction is a mixed number
                mixed = self.words[self.at - 1].isdigit() and self.next().endswith("frac") and list(out) == [_ONE]
                out = _plus(out, self.power()) if mixed else _times(out, self.power())
            else:
                return out

    def signed(self) -> Sum:
        if self.take("-"):
            return _times(_number(-1), self.signed())
        self.take("+")
        return self.power()

    def power(self) -> Sum:
        out = self.atom()
        while True:
            if self.take("^"):
                out = _power(out, self.single())
            elif self.take("%", "\\%"):
                out = _times(out, _number(Fraction(1, 100)))
            else:
                return out

    def single(self) -> Sum:
        """What a command takes without braces: a sign and an atom, of a number its first digit."""
        if self.take("-"):
            return _times(_number(-1), self.single())
        word = self.next()
        if word.isdigit() and len(word) > 1:
            self.words[self.at : self.at + 1] = [word[0], word[1:]]
        return self.atom()

    def atom(self) -> Sum:
        word = self.next()
        self.at += 1
        if re.fullmatch(r"\d[\d,]*(?:\.\d+)?|\.\d+", word):
            return _number(Fraction(word.replace(",", "")))
        if re.fullmatch(r"[a-zA-Z]|\\pi", word):
            return {(1, ((word.removeprefix("\\"), 1),)): Fraction(1)}
        if word in ("(", "{"):
            out = self.sum()
            if not self.take(")" if word == "(" else "}"):
                raise _Unreadable
            return out
        if word in ("\\frac", "\\dfrac", "\\tfrac"):
            above = self.single()
            return _times(above, _inverse(self.single()))
        if word == "\\sqrt":
            if self.take("["):
                degree = self.sum()
                if not self.take("]") or degree != _number(2):
                    raise _Unreadable
            return _root(self.single())
        raise _Unreadable


def _parts(text: str) -> list[str]:
    """A text cut at commas outside of brackets that don't part thousands."""
    out, depth, begin = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0 and not (re.match(r"\d{3}(?!\d)", text[k + 1 :]) and re.search(r"(?:^|\D)[1-9]\d{0,2}(?:,\d{3})*$", text[begin:k])):
            out.append(text[begin:k])
            begin = k + 1
    return [*out, text[begin:]]


def _form(text: str):
    text = text.strip()
    inner = _parts(text)
    if len(inner) > 1:
        return ("list", *map(_form, inner))
    braces = re.fullmatch(r"\\\{(.*)\\\}", text, re.DOTALL)
    if braces:
        return ("set", *sorted(map(_form, _parts(braces[1])), key=repr))
    if text[:1] in ("(", "[") and text[-1:] in (")", "]"):
        parts = _parts(text[1:-1])
        if len(parts) > 1:
            return (text[0] + text[-1], *map(_form, parts))
    reader = _Reader(text)
    out = reader.sum()
    if reader.at < len(reader.words):
        raise _Unreadable
    return tuple(sorted(out.items()))


def normal_form(answer: str | None):
    """What an answer says, to be compared; None if it can't be read."""
    text = _DROPPED.sub("", (answer or "").strip().rstrip("."))
    text = _SPACE.sub(" ", re.sub(r"(?<=\d)\s*\{,\}\s*(?=\d{3})", ",", re.sub(r"\\,(?=\d{3})", "", text)))
    text = re.split(r"(?<![<>!\\])=|\\in(?![a-zA-Z])", text)[-1]
    if len(text) > 2000:
        return None
    try:
        return _form(text)
    except (_Unreadable, ZeroDivisionError, ValueError, RecursionError, OverflowError):
        return None


def equal(a: str | None, b: str | None) -> bool:
    """Whether two answers say the same: by their texts, else by their normal forms."""
    if (a or "").strip() == (b or "").strip():
        return True
    x = normal_form(a)
    return x is not None and x == normal_form(b)
