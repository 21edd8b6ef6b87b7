r"""Prompt templates, compiled once to one Column.

Two kinds. :func:`formatted` knows ``{name}``, ``{name.field}``, ``{name[0]}`` and doubled braces; a name
that isn't given stays as it stands. :func:`rendered` knows ``{{ expression }}``, ``{% for x in xs %}``
with ``loop.index``, ``loop.first`` and ``loop.last``, ``{% if test %}`` with ``elif`` and ``else``, ``{# comments #}``
and marks with ``-``, which take the white space beside them; a name that isn't given is an error,
and one line feed at the template's end goes. An expression is a name with fields and places, a
quoted text or a number, and filters behind ``|``: ``trim``, ``upper``, ``lower``, ``length``, ``first``, ``last``,
``join(text)``, ``replace(old, new)`` and ``default(text)``. A test is an expression, ``not`` one, or two
of them with ``==`` or ``!=``, joined by ``and`` (binds first) and ``or``. Null, false, 0, and empty texts and arrays
are false.

What stands for a name is never read as a template: the parts are concatenated once, so
values may hold braces, names and marks. A null value counts as empty; a place behind
the end of an array too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

Scope = Mapping[str, Column]


def _path(value: Column, path: str) -> Column:
    """Fields and places behind a name."""
    for field, place in re.findall(r"\.(\w+)|\[(\d+|'[^']*'|\"[^\"]*\")\]", path):
        value = F.get(value, F.lit(int(place))) if place.isdigit() else value.getField(field or place[1:-1])
    return value


def _joined(parts: list[Column]) -> Column:
    return F.concat(F.lit(""), *parts)


def formatted(template: str, columns: Scope) -> Column:
    """``template`` with the columns in place of their names in braces."""
    out, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)((?:\.\w+|\[\w+\])*)\}", template):
        out.append(F.lit(template[at : m.start()]))
        if m[0] in ("{{", "}}"):
            out.append(F.lit(m[0][0]))
        elif m[1] in columns:
            out.append(T.empty(_path(columns[m[1]], re.sub(r"\[([^\d\]][^\]]*)\]", r".\1", m[2]))))
        else:
            out.append(F.lit(m[0]))
        at = m.end()
    return _joined([*out, F.lit(template[at:])])


@dataclass
class Said:
    """An expression whose value is written."""

    value: Callable[[Scope], Column]

    def column(self, scope: Scope) -> Column:
        return T.empty(self.value(scope))


@dataclass
class Loop:
    """Its parts for every element."""

    name: str
    values: Callable[[Scope], Column]
    parts: list

    def column(self, scope: Scope) -> Column:
        values = self.values(scope)

        def one(x: Column, k: Column) -> Column:
            state = F.struct((k + 1).alias("index"), k.alias("index0"), (k == 0).alias("first"), (k + 1 == F.size(values)).alias("last"))
            return _joined([p.column({**scope, self.name: x, "loop": state}) for p in self.parts])

        return F.coalesce(F.array_join(F.transform(values, one), ""), F.lit(""))


@dataclass
class Choice:
    """The parts of the first test that holds; the last test may be None."""

    cases: list[tuple[Callable[[Scope], Column] | None, list]]

    def column(self, scope: Scope) -> Column:
        out = F.lit("")
        for test, parts in reversed(self.cases):
            text = _joined([p.column(scope) for p in parts])
            out = text if test is None else F.when(test(scope), text).otherwise(out)
        return out


_TOKEN = re.compile(r"\s*(\d+|'[^']*'|\"[^\"]*\"|[A-Za-z_]\w*(?:\.\w+|\[\d+\]|\['[^']*'\]|\[\"[^\"]*\"\])*|==|!=|[|(),])")
_QUOTED = r"""'[^']*'|"[^"]*\""""
_MARK = re.compile(rf"(\{{\{{(?:{_QUOTED}|(?!\}}\}}).)*\}}\}}|\{{%(?:{_QUOTED}|(?!%\}}).)*%\}}|\{{#.*?#\}})", re.DOTALL)
_FILTERS: dict[str, Callable[..., Column]] = {
    "trim": lambda x: T.strip(T.empty(x)),
    "upper": lambda x: F.upper(T.empty(x)),
    "lower": lambda x: F.lower(T.empty(x)),
    "length": lambda x: F.coalesce(F.char_length(x.cast("string")), F.lit(0)),
    "count": lambda x: F.coalesce(F.size(x), F.lit(0)),
    "first": lambda x: F.get(x, F.lit(0)),
    "last": lambda x: F.try_element_at(x, F.lit(-1)),
    "join": lambda x, by=None: F.call_function("array_join", F.transform(x.cast("array<string>"), T.empty), by if by is not None else F.lit("")),
    "replace": lambda x, old, new: F.replace(T.empty(x), T.empty(old), T.empty(new)),
    "default": lambda x, other: F.coalesce(x.cast("string"), other),
}


class _Reader:
    """The words of an expression, read from left to right."""

    def __init__(self, source: str):
        self.source, self.words, at = source, [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"not understood: {source[at:].strip()!r} in {source!r}")
            self.words.append(m[1])
            at = m.end()
        self.at = 0

    def next(self, *wanted: str) -> str | None:
        """The next word, if it is one of those wanted (any, if none are named), and past it."""
        word = self.words[self.at] if self.at < len(self.words) else None
        if word is None or (wanted and word not in wanted):
            return None
        self.at += 1
        return word

    def done(self, value):
        if self.at < len(self.words):
            raise ValueError(f"not understood: {self.words[self.at]!r} in {self.source!r}")
        return value

    def primary(self) -> Callable[[Scope], Column]:
        word = self.next()
        if word is None or re.fullmatch(r"[|(),]|==|!=", word):
            raise ValueError(f"a value is missing in {self.source!r}")
        if word.isdigit():
            return lambda scope: F.lit(int(word))
        if word[0] in "'\"":
            return lambda scope: F.lit(word[1:-1])
        name, path = re.fullmatch(r"(\w+)(.*)", word).groups()

        def named(scope: Scope) -> Column:
            if name not in scope:
                raise ValueError(f"no value for {name!r}; there are {sorted(scope)}")
            return _path(scope[name], path)

        return named

    def value(self) -> Callable[[Scope], Column]:
        out = self.primary()
        while self.next("|"):
            name, given = self.next(), []
            if name not in _FILTERS:
                raise ValueError(f"unknown filter {name!r} in {self.source!r}")
            if self.next("("):
                while not self.next(")"):
                    given.append(self.primary())
                    self.next(",")
            out = lambda scope, before=out, name=name, given=tuple(given): _FILTERS[name](before(scope), *[g(scope) for g in given])
        return out

    def test(self) -> Callable[[Scope], Column]:
        out = self._all()
        while self.next("or"):
            out = lambda scope, a=out, b=self._all(): a(scope) | b(scope)
        return out

    def _all(self) -> Callable[[Scope], Column]:
        out = self._single()
        while self.next("and"):
            out = lambda scope, a=out, b=self._single(): a(scope) & b(scope)
        return out

    def _single(self) -> Callable[[Scope], Column]:
        if self.next("not"):
            inner = self._single()
            return lambda scope: ~inner(scope)
        left = self.value()
        sign = self.next("==", "!=")
        if not sign:
            return lambda scope: ~T.empty(left(scope)).isin("", "false", "0", "0.0", "[]")
        right = self.value()
        same = lambda scope: T.empty(left(scope)) == T.empty(right(scope))
        return same if sign == "==" else lambda scope: ~same(scope)


def parsed(template: str) -> list:
    """The parts of a template; raises ValueError where it isn't one."""
    template = template.removesuffix("\n")
    pieces = re.split(_MARK, template)
    for k, piece in enumerate(pieces):
        if k % 2:
            pieces[k - 1] = pieces[k - 1].rstrip() if piece[2] == "-" else pieces[k - 1]
            pieces[k + 1] = pieces[k + 1].lstrip() if piece[-3] == "-" else pieces[k + 1]
    root: list = []
    open_: list[tuple[str, list, object]] = [("", root, None)]
    for k, piece in enumerate(pieces):
        parts = open_[-1][1]
        if not k % 2:
            parts.extend([Said(lambda scope, x=piece: F.lit(x))] if piece else [])
            continue
        inner = piece[2:-2].removeprefix("-").removesuffix("-").strip()
        if piece.startswith("{{"):
            reader = _Reader(inner)
            parts.append(Said(reader.done(reader.value())))
        elif piece.startswith("{%"):
            word, _, rest = inner.partition(" ")
            if word == "for":
                m = re.fullmatch(r"\s*(\w+)\s+in\s+(.+)", rest, re.DOTALL)
                if not m:
                    raise ValueError(f"not a loop: {piece}")
                reader = _Reader(m[2])
                loop = Loop(m[1], reader.done(reader.value()), [])
                parts.append(loop)
                open_.append(("for", loop.parts, loop))
            elif word == "if":
                reader = _Reader(rest)
                choice = Choice([(reader.done(reader.test()), [])])
                parts.append(choice)
                open_.append(("if", choice.cases[-1][1], choice))
            elif word in ("elif", "else") and open_[-1][0] == "if" and open_[-1][2].cases[-1][0] is not None:
                reader = _Reader(rest)
                open_[-1][2].cases.append((reader.done(reader.test()) if word == "elif" else None, []))
                open_[-1] = ("if", open_[-1][2].cases[-1][1], open_[-1][2])
            elif word in ("endfor", "endif") and open_[-1][0] == word[3:]:
                open_.pop()
            else:
                raise ValueError(f"out of place: {piece}")
    if len(open_) > 1:
        raise ValueError(f"{open_[-1][0]} isn't closed")
    return root


def rendered(template: str, columns: Scope) -> Column:
    """``template`` with loops, choices and values filled in from columns."""
    return _joined([p.column(columns) for p in parsed(template)])


#: What stands around a question by model family, and what stands for an image in it.
FAMILIES = {
    "qwen2_5vl": ("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n", "<|vision_start|><|image_pad|><|vision_end|>"),
    "qwen3_nothink": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n", None),
    "qwen3_think": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n", None),
    "qwen3vl_nothink": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n", "<|vision_start|><|image_pad|><|vision_end|>"),
    "intern_vl": ("<s><|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n", "<image>\n"),
}
IMAGE_MARK, IMAGE_PLACE = "<image>", "{<|image_pad|>}"


def for_family(question: Column, family: str) -> Column:
    """A question as a chat of one turn, as a model family wants it; families that see images drop image marks and put their own at the place of one."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}; there are {sorted(FAMILIES)}")
    before, behind, image = FAMILIES[family]
    said = T.empty(question)
    if image is not None:
        said = F.replace(F.replace(said, F.lit(IMAGE_MARK), F.lit("")), F.lit(IMAGE_PLACE), F.lit(image))
    return F.concat(F.lit(before), said, F.lit(behind))
