"""Chat formatting with a finite-state machine over roles; DataFrame functions only.

A :class:`Template` declares, per role, the strings around a turn, whether the text
of the turn counts for the loss, and which roles may follow. ``format_chats`` gives
per conversation the formatted text, its segments (marker or turn text, each with its
loss flag) and whether the turn order is valid. ``read_back`` recovers the turns from
the formatted text alone.

Control strings inside texts are escaped reversibly: every backslash is doubled, then
a backslash is put after the first character of each control string. Control strings
hold no backslash, so no escaped text contains one, and dropping one backslash of each
``\\x`` pair restores the text.

Turns go by (turn, role, text); a null turn sorts first. A null text is an empty text,
a null role an empty role. Roles that the template doesn't know are written between the
markers of ``other`` with their name, and make the order invalid, as any step that the
machine doesn't allow; such conversations are formatted all the same. Rows whose
conversation is null form one conversation with a null id. Repeated rows are repeated
turns. A conversation is one value of the result, so its turns meet in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How one role is written: markers around the text, loss flag, and the roles that may come next."""

    before: str
    after: str
    loss: bool = False
    then: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """Roles by name, the roles that may begin and end, the markers of other roles, and further control strings."""

    roles: dict[str, Turn]
    begin: tuple[str, ...]
    end: tuple[str, ...]
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    reserved: tuple[str, ...] = field(default=())

    @property
    def controls(self) -> list[str]:
        """Every control string once, markers first."""
        marks = [m for t in self.roles.values() for m in (t.before, t.after)]
        return list(dict.fromkeys([*marks, *self.other, *self.reserved]))


#: Instruction style: user turns in brackets, the loss on assistant turns only.
INSTRUCT = Template(
    roles={
        "system": Turn("<<SYS>>", "<</SYS>>", then=("user",)),
        "user": Turn("[INST]", "[/INST]", then=("assistant",)),
        "assistant": Turn("<s>", "</s>", loss=True, then=("user",)),
    },
    begin=("system", "user"),
    end=("assistant",),
    reserved=("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>", "<pad>"),
)
#: The same roles between marks that name them.
NAMED = Template(
    roles={
        "system": Turn("<|system|>", "<|/system|>", then=("user",)),
        "user": Turn("<|user|>", "<|/user|>", then=("assistant",)),
        "assistant": Turn("<|assistant|>", "<|/assistant|>", loss=True, then=("user",)),
    },
    begin=("system", "user"),
    end=("assistant",),
    other=("<|role|>", "<|/role|>", "<|/other|>"),
    reserved=("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"),
)


def escaped(text: Column, template: Template) -> Column:
    """``text`` without any control string in it."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.controls:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescaped(text: Column) -> Column:
    """The text before :func:`escaped`."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _quoted(mark: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in mark)


def _pick(role: Column, template: Template, value, other: Column) -> Column:
    out = None
    for name, turn in template.roles.items():
        out = (F if out is None else out).when(role == name, F.lit(value(turn)))
    return out.otherwise(other)


def _machine(template: Template) -> Column:
    """The map of allowed steps, from state and role to the next state; the state is the last role."""
    steps = [("", r) for r in template.begin] + [(a, b) for a, t in template.roles.items() for b in t.then]
    return F.create_map(*[F.lit(x) for a, b in steps for x in (f"{a}>{b}", b)])


def format_chats(turns: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: ``conv_id``, ``formatted``, ``segments`` (array of role, text, loss), ``loss_spans`` (array of start from 1, length in ``formatted``), ``valid``, ``bad_turn`` (index of the first turn out of order, from 0; the number of turns if it ends too early; else null)."""
    said = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), said.alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    a, b, c = template.other

    def parts(t: Column) -> Column:
        before = _pick(t.role, template, lambda x: x.before, F.concat(F.lit(a), escaped(t.role, template), F.lit(b)))
        after = _pick(t.role, template, lambda x: x.after, F.lit(c))
        loss = _pick(t.role, template, lambda x: x.loss, F.lit(False))
        marker = lambda x: F.struct(t.role.alias("role"), x.alias("text"), F.lit(False).alias("loss"))
        return F.array(marker(before), F.struct(t.role.alias("role"), escaped(t.text, template).alias("text"), loss.alias("loss")), marker(after))

    def step(state: Column, t: Column) -> Column:
        to = F.element_at(_machine(template), F.concat(state.at, F.lit(">"), t.role))
        good = state.bad.isNull() & to.isNotNull()
        return F.struct(
            F.when(good, to).otherwise(state.at).alias("at"),
            F.when(state.bad.isNull() & to.isNull(), state.n).otherwise(state.bad).alias("bad"),
            (state.n + 1).alias("n"),
        )

    start = F.struct(F.lit("").alias("at"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))
    ran = grouped.withColumn("run", F.aggregate("turns", start, step)).withColumn("segments", F.flatten(F.transform("turns", parts)))
    bad = F.coalesce(F.col("run.bad"), F.when(~F.col("run.at").isin(*template.end), F.col("run.n")))
    at = F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))

    def span(s: Column, x: Column) -> Column:
        long = F.length(x.text).cast("bigint")
        return F.struct((s.at + long).alias("at"), F.when(x.loss, F.array_append(s.spans, F.struct(s.at.alias("start"), long.alias("length")))).otherwise(s.spans).alias("spans"))

    ran = ran.withColumn("loss_spans", F.aggregate("segments", at, span, lambda s: s.spans))
    return ran.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments", "loss_spans", bad.isNull().alias("valid"), bad.alias("bad_turn"))


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (array of role, text) that a formatted text holds, read from its markers."""
    a, b, c = template.other
    named = [*template.roles.items()]
    begin = "|".join(_quoted(t.before) for _, t in named)
    end = "|".join(_quoted(t.after) for _, t in named)
    whole = rf"(?s)(?:(?:{begin}).*?(?:{end})|{_quoted(a)}.*?{_quoted(b)}.*?{_quoted(c)})"

    def turn(x: Column) -> Column:
        role = text = None
        for name, t in named:
            here = x.startswith(t.before)
            cut = F.substring(x, F.lit(len(t.before) + 1), F.length(x) - len(t.before) - len(t.after))
            role = (F if role is None else role).when(here, F.lit(name))
            text = (F if text is None else text).when(here, cut)
        at = F.instr(x, b)
        role = role.otherwise(F.substring(x, F.lit(len(a) + 1), at - len(a) - 1))
        text = text.otherwise(F.substring(x, at + len(b), F.length(x) - at - len(b) - len(c) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(whole), F.lit(0)), turn)


def digests(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, read back from the output: counts and digests of its turns and of its loss text."""
    read = chats.withColumn("back", read_back(F.col("formatted"), template)).withColumn("learned", F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s.start, s.length))), ""))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
