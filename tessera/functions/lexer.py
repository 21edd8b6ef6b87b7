r"""TeX code as tokens of a kind, in built-in functions.

The lexer has three states: text, math (inline, from ``\(`` or ``$`` up to ``\)`` or ``$``; displayed,
from ``\[`` or ``$$`` up to ``\]`` or ``$$``) and what follows a command (options in
brackets on its line, stars). Math doesn't nest, so one expression cuts the code into whole stretches
of one state, math with its marks, and a second one cuts each stretch into tokens. Comments
reach to the end of their line, in math too, where they hide end marks. Math that isn't
closed reaches to the end. No expression looks ahead or takes a choice back, so time grows with the length.

Kinds: ``comment``, ``text``, ``keyword`` (commands), ``attribute`` (options), ``string``
(marks of math), ``variable`` (commands in math), ``number``, ``operator`` and ``builtin``
(braces, ``&_^``, a lone ``$`` in displayed math, other characters of math). A null text has no tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.arrays import let

_ITEM = r"%[^\n]*|\\[a-zA-Z]+|\\[^\sa-zA-Z{close}]|\\\s|[^\\$%]"
_INLINE = r"(?:\\\(|\$)(?:" + _ITEM.replace("{close}", ")") + r")*+(?:\\\)|\$|\\?\z)"
_DISPLAY = r"(?:\\\[|\$\$)(?:\$?(?:" + _ITEM.replace("{close}", r"\]") + r"))*+(?:\$?\\\]|\$\$|\$?\\?\z)"
_COMMAND = r"\\(?:[a-zA-Z@_:]+|\S)?"
#: Stretches of one state, in the order in which they are tried.
STRETCHES = rf"{_DISPLAY}|{_INLINE}|{_COMMAND}(?:\[[^\n]*?\]|\*)*|%[^\n]*|[{{}}&_^]|[^\\$%&_^{{}}]+"
IN_COMMAND = rf"\A{_COMMAND}|\[[^\n]*?\]|\*"
_MATH = r"%[^\n]*|\\(?:[a-zA-Z]+|\S)?|[{}&_^]|[0-9]+|[-=!+*/()\[\]]|[^=!+*/()\[\]\\$%&_^{}0-9-]+"
IN_MATH = rf"\A(?:\$\$|\\\[|\\\(|\$)|\\[)\]]\z|\$\$\z|\$|{_MATH}"


def _value_kind(value: Column, kind: Column) -> Column:
    return F.struct(value.alias("value"), kind.alias("kind"))


def _begins(x: Column, *marks: str) -> Column:
    out = F.lit(False)
    for mark in marks:
        out |= x.startswith(mark)
    return out


def _in_text(stretch: Column) -> Column:
    """The tokens of a stretch outside of math."""
    command = stretch.startswith("\\")
    parts = F.regexp_extract_all(stretch, F.lit(IN_COMMAND), F.lit(0))
    named = F.transform(parts, lambda p, k: _value_kind(p, F.when((k > 0) & p.startswith("["), "attribute").otherwise("keyword")))
    kind = F.when(stretch.startswith("%"), "comment").when(stretch.rlike(r"\A[{}&_^]"), "builtin").otherwise("text")
    return F.when(command, named).otherwise(F.array(_value_kind(stretch, kind)))


def _in_math(stretch: Column) -> Column:
    """The tokens of a whole stretch of math: its first mark, and one at its end that closes it, are strings."""
    display = _begins(stretch, "$$", "\\[")
    parts = F.regexp_extract_all(stretch, F.lit(IN_MATH), F.lit(0))

    def kind(p: Column, k: Column) -> Column:
        closes = p.isin("$$", "\\]") & display | p.isin("$", "\\)") & ~display
        return (
            F.when(k == 0, "string").when(p.startswith("%"), "comment").when(closes, "string").when(p.startswith("\\"), "variable")
            .when(p.rlike(r"\A[0-9]"), "number").when(p.rlike(r"\A[-=!+*/()\[\]]"), "operator").otherwise("builtin")
        )

    return F.transform(parts, lambda p, k: _value_kind(p, kind(p, k)))


def tokens(code: Column) -> Column:
    """All tokens of TeX code, comments included: an array of ``value`` and ``kind``; values together are the code."""
    stretches = F.regexp_extract_all(T.empty(code), F.lit(STRETCHES), F.lit(0))
    return F.flatten(F.transform(stretches, lambda s: F.when(_begins(s, "$", "\\[", "\\("), _in_math(s)).otherwise(_in_text(s))))


#: English words whose full stop belongs to them, and those for which that holds before a number.
NO_BREAK = (
    "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z Adj Adm Adv Asst Bart Bldg Brig Bros Capt Cmdr Col Comdr Con Corp Cpl DR Dr Drs Ens Gen Gov Hon Hr Hosp Insp Lt MM MR MRS MS Maj Messrs Mlle Mme Mr Mrs Ms Msgr "
    "Op Ord Pfc Ph Prof Pvt Rep Reps Res Rev Rt Sen Sens Sfc Sgt Sr St Supt Surg v vs i.e rev e.g Nos Nr"
).split()
NO_BREAK_NUMBER = "No Art pp".split()
#: Characters that word tokens write as entities, in order.
ENTITIES = [("&", "&amp;"), ("|", "&#124;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"), ("[", "&#91;"), ("]", "&#93;")]


def words(text: Column) -> Column:
    """Words and marks of a text as machine translation counts them (the Moses rules for English): an array."""
    x = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"[\x00-\x1f]", "")
    x = F.regexp_replace(T.strip(x), r"(?U)([^\p{IsAlphabetic}\p{Nd}\s.'`,\-])", " $1 ")
    # runs of full stops stay together, commas leave words but not numbers
    x = F.regexp_replace(x, r"(\.\.+)", " $1 ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?<=[^\p{N}]),", " , "), r",(?=[^\p{N}])", " , ")
    x = F.regexp_replace(x, r"(?<=\p{N}),\z", " , ")
    letter = r"\p{IsAlphabetic}"
    for pattern, by in (
        (rf"(?<=[^{letter}])'(?=[^{letter}])", " ' "),
        (rf"(?<=[^{letter}\p{{N}}])'(?=[{letter}])", " ' "),
        (rf"(?<=[{letter}])'(?=[^{letter}])", " ' "),
        (rf"(?<=[{letter}])'(?=[{letter}])", " '"),
        (r"(?<=\p{N})'(?=s)", " '"),
    ):
        x = F.regexp_replace(x, pattern, by)
    parts = F.filter(F.split(T.strip(x), r"\s+"), lambda w: w != "")
    return let(parts, _words)


def _words(parts: Column) -> Column:
    """Full stops off words that don't keep them, marks as entities."""
    letter = r"\p{IsAlphabetic}"
    after = F.when(F.size(parts) > 0, F.concat(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")))).otherwise(parts)

    def stop(word: Column, following: Column) -> Column:
        stem = F.substring(word, F.lit(1), F.length(word) - 1)
        stays = (F.contains(stem, F.lit(".")) & stem.rlike(rf"[{letter}]")) | stem.isin(NO_BREAK) | following.rlike(r"\A\p{Ll}") | (stem.isin(NO_BREAK_NUMBER) & following.rlike(r"\A[0-9]+"))
        return F.when(word.endswith(".") & (F.length(word) > 1) & ~word.endswith("..") & ~stays, F.array(stem, F.lit("."))).otherwise(F.array(word))

    def escaped(w: Column) -> Column:
        for mark, entity in ENTITIES:
            w = F.replace(w, F.lit(mark), F.lit(entity))
        return w

    return F.transform(F.flatten(F.zip_with(parts, after, stop)), escaped)


def spoken(text: Column) -> Column:
    """Words and marks of a text as the extended edit distance counts them: an array."""
    x = F.regexp_replace(text, r"(?U)\s+\z", "")
    for mark in ".!?,":
        x = F.replace(x, F.lit(mark), F.lit(" " + mark))
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    x = F.regexp_replace(x, r"(\p{Nd}) ([.,]) (\p{Nd})", "$1$2$3")
    x = F.regexp_replace(x, r"(Dr|Jr|Prof|Rev|Gen|Mr|Mt|Mrs|Ms) .", "$1.")
    for before, by in (("e . g .", "e.g."), ("i . e .", "i.e."), ("U . S .", "U.S.")):
        x = F.replace(x, F.lit(before), F.lit(by))
    return _split(x)


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _said(code: Column) -> Column:
    """Tokens without comments and blank ones, trimmed."""
    trimmed = F.transform(tokens(code), lambda t: _value_kind(F.regexp_replace(t["value"], r"(?U)\A\s+|\s+\z", ""), t["kind"]))
    return F.filter(trimmed, lambda t: (t["value"] != "") & (t["kind"] != "comment"))


def code_words(code: Column) -> Column:
    """The tokens that n-gram metrics compare: those of text, of options and of braces and names in math by :func:`words`, others as they are."""
    return F.flatten(F.transform(_said(code), lambda t: F.when(t["kind"].isin("text", "attribute", "builtin"), words(t["value"])).otherwise(F.array(t["value"]))))


def edit_words(code: Column) -> Column:
    """The tokens that the edit distance compares: those of text by :func:`spoken`, others between white space."""
    return F.flatten(F.transform(_said(code), lambda t: F.when(t["kind"] == "text", spoken(t["value"])).otherwise(_split(t["value"]))))


def sql_pattern(pattern: str) -> str:
    """An expression of this module for an engine that takes no choice back."""
    return re.sub(r"\*\+", "*", pattern)
