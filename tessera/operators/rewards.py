"""Reward functions: scores of model answers, composed of columns. ``REWARDS`` names them with their type."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import answers
from tessera.functions import maths as M
from tessera.functions import text as T
from tessera.operators.external import once
from tessera.shipping import ship


@dataclass(frozen=True)
class Reward:
    """A reward by name. ``batch`` works on whole DataFrames, ``sequential`` on one record as a Python function."""

    name: str
    kind: str
    function: Callable


REWARDS: dict[str, Reward] = {}


def reward(name: str, kind: str = "batch", keep: bool = False) -> Callable:
    """Registers a function; with ``keep`` the entry is given back instead of the function."""
    if kind not in ("batch", "sequential"):
        raise ValueError(f"unknown type {kind!r}")

    def add(function: Callable) -> Callable:
        REWARDS[name] = Reward(name, kind, function)
        return REWARDS[name] if keep else function

    return add


def loaded(file: str, function: str) -> Reward:
    """A reward from a Python file, also registered: ``REWARD_NAME`` (unknown without) and ``REWARD_TYPE`` (batch without) in the file say how it is called.

    Raises FileNotFoundError, RuntimeError if the file can't be run, AttributeError without the function.
    """
    if not Path(file).exists():
        raise FileNotFoundError(file)
    spec = importlib.util.spec_from_file_location(f"reward_{Path(file).stem}", file)
    module = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(module)
    except Exception as e:
        raise RuntimeError(f"{file} can't be run: {e}") from e
    found = getattr(module, function)
    sys.modules[module.__name__] = module
    cloudpickle.register_pickle_by_value(module)  # workers don't have the file
    return reward(getattr(module, "REWARD_NAME", "unknown"), getattr(module, "REWARD_TYPE", "batch"), keep=True)(found)


def scored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` with the struct ``reward`` of the function ``name``; equal records are scored once where it is a Python function."""
    if name not in REWARDS:
        raise ValueError(f"unknown reward {name!r}; known: {', '.join(sorted(REWARDS))}")
    found = REWARDS[name]
    if found.kind == "batch":
        return found.function(df, **options)
    ship(df.sparkSession)
    keys = ["response", "ground_truth"]

    @F.pandas_udf("overall double, format double, accuracy double")
    def run(response: pd.Series, truth: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([found.function({"response": a or "", "ground_truth": b or ""}, **options) for a, b in zip(response, truth, strict=True)], columns=["overall", "format", "accuracy"])

    return once(df, keys, lambda few: few.withColumn("reward", run(*keys)))


@reward("dapo")
def dapo(df: DataFrame, max_length: int = 4096, buffer: int = 1024, factor: float = 1.0) -> DataFrame:
    """1 or -1 for the answer in the last 300 characters, and a penalty for length."""
    tail = F.substring("response", F.greatest(F.length("response") - 299, F.lit(1)), F.lit(300))
    right = F.when(T.normalize_answer(T.last_answer(tail)) == T.normalize_answer(F.col("ground_truth")), 1.0).otherwise(-1.0)
    long = M.overlong(F.col("response_length"), max_length, buffer)
    return df.withColumn("reward", F.struct((right + long * factor).alias("overall"), right.alias("accuracy"), long.alias("overlong"), (0.5 * (right + 1)).alias("accuracy_normalized")))


def same_answers(df: DataFrame, given: str, truth: str, out: str) -> DataFrame:
    """``df`` with the flag ``out``: equal normal texts, else what both say (:mod:`tessera.functions.answers`); different pairs are read once, and only those whose texts differ."""
    ship(df.sparkSession)
    alike = T.normalize_answer(F.col(given)) == T.normalize_answer(F.col(truth))

    @F.pandas_udf("boolean")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([answers.equal(x, y) for x, y in zip(left, right, strict=True)], dtype="bool")

    marked = df.withColumn("_alike", F.coalesce(alike, F.lit(False)))
    pairs = marked.where("NOT _alike").select(F.col(given).alias("_x"), F.col(truth).alias("_y")).distinct().where(run("_x", "_y"))
    found = marked.join(pairs, F.col(given).eqNullSafe(F.col("_x")) & F.col(truth).eqNullSafe(F.col("_y")), "left")
    return found.withColumn(out, F.col("_alike") | F.col("_x").isNotNull() | F.col("_y").isNotNull()).drop("_alike", "_x", "_y")


@reward("math")
def math(df: DataFrame, format_weight: float = 0.1) -> DataFrame:
    """Boxed answer and form; answers are equal when their normal texts are or when they say the same."""
    response = T.squeezed_marks(F.col("response"))
    good = T.boxed_format(response)
    boxed = df.withColumns({"_boxed": T.boxed(response), "_truth": T.empty(F.col("ground_truth"))})
    right = F.col("_right").cast("double")
    scored = same_answers(boxed, "_boxed", "_truth", "_right")
    return scored.withColumn("reward", F.struct(((1 - format_weight) * right + format_weight * good).alias("overall"), good.alias("format"), right.alias("accuracy"))).drop("_boxed", "_truth", "_right")


@reward("r1v")
def r1v(df: DataFrame, format_weight: float = 0.5) -> DataFrame:
    """Tagged answer and form; without a tag the whole response is the answer."""
    response, truth = T.empty(F.col("response")), T.strip(T.empty(F.col("ground_truth")))
    good = T.answer_format(response)
    given = T.strip(T.extract(response, r"<answer>(.*?)</answer>", 1, response))
    right = (given == truth).cast("double")
    return df.withColumn("reward", F.struct(((1 - format_weight) * right + format_weight * good).alias("overall"), good.alias("format"), right.alias("accuracy")))


@reward("choice")
def choice(df: DataFrame) -> DataFrame:
    """1 if the first of 0, 1 and 2 in the answer is the truth."""
    right = (T.first_choice(F.col("response")) == T.empty(F.col("ground_truth"))).cast("double")
    return df.withColumn("reward", F.struct(right.alias("overall"), right.alias("accuracy")))


@reward("self_consistency")
def self_consistency(
    df: DataFrame,
    compile_reward: float = 0.1,
    compile_penalty: float = -0.8,
    visual_weight: float = 0.8,
    visual_threshold: float = 0.5,
    code_weight: float = 0.15,
    code_threshold: float = 0.6,
    penalty_max: float = 0.1,
    ws: float = 0.4,
    wl: float = 0.6,
    hold: float = 0.8,
) -> DataFrame:
    """Compile, look and agree: over ``compiled``, ``semantic``, ``structural``, ``width``, ``height``, ``code``, ``code_prime``, ``bleu``, ``edit_sim``, ``image_path``.

    A failure gives the penalty alone. The code term counts only for good looks, a second code and sides of at most 15 to 1.
    """
    has_image = F.coalesce(F.col("image_path") != "", F.lit(False))
    ok = F.coalesce(F.col("compiled"), F.lit(False)) & has_image
    vis = M.visual(M.unit(F.col("semantic")), F.col("structural"), ws, wl, hold)
    second = F.coalesce(F.col("code_prime") != "", F.lit(False))
    ratio = F.greatest("width", "height") / F.when(F.least("width", "height") > 0, F.least("width", "height"))
    shaped = F.coalesce(ratio <= 15.0, F.lit(True))
    enter = (vis > visual_threshold) & second & shaped
    c = F.when(enter, M.code_score(F.col("bleu"), F.col("edit_sim"))).otherwise(0.0)
    bonus = (c - code_threshold) / (1 - code_threshold) * code_weight
    malus = F.greatest(-(code_threshold - c) / code_threshold * penalty_max, F.lit(-penalty_max))
    code = F.when(enter, F.when(c >= code_threshold, bonus).otherwise(malus)).otherwise(0.0)
    total = F.greatest(F.least(F.lit(compile_reward) + vis * visual_weight + code, F.lit(1.0)), F.lit(-1.0))
    good = lambda x: F.when(ok, x).otherwise(0.0)
    flag = lambda x: good(x.cast("double"))
    score = F.when(ok, total).otherwise(compile_penalty)
    return df.withColumn(
        "reward",
        F.struct(
            score.alias("score"),
            score.alias("overall"),
            F.when(ok, compile_reward).otherwise(compile_penalty).alias("r_compile"),
            good(vis * visual_weight).alias("r_visual"),
            good(code).alias("r_code"),
            flag(ok).alias("cycle_render_ok"),
            flag(second).alias("cycle_has_codeprime"),
            good(vis).alias("cycle_vis"),
            flag(vis > visual_threshold).alias("cycle_vis_gate_pass"),
            flag(shaped).alias("cycle_aspect_ok"),
            flag(enter).alias("cycle_enter"),
            good(F.length(T.empty(F.col("code"))).cast("double")).alias("cycle_code_len"),
            good(F.length(T.empty(F.col("code_prime"))).cast("double")).alias("cycle_codeprime_len"),
            good(c).alias("code_similarity"),
            good(F.when(enter, F.col("edit_sim")).otherwise(0.0)).alias("code_ted_sim"),
            good(F.when(enter, F.col("bleu")).otherwise(0.0)).alias("code_crystalbleu"),
            good(vis).alias("visual_consistency"),
            good(F.col("semantic")).alias("semantic"),
            good(F.col("structural")).alias("structural"),
            flag(ok).alias("compile_success"),
        ),
    )


#: The rubric's fields, in the order of the answer.
RUBRIC = ("correctness", "layout_precision", "readability", "scientific_plausibility", "visual_complexity")


def judged(answer: Column) -> Column:
    """Struct of the five rubric scores, ``total_score`` and ``valid``: whole numbers from 0 to 5 that add up; from the last line that is JSON."""
    said = F.filter(F.split(T.empty(answer), "\n"), lambda x: T.strip(x) != "")
    line = F.try_element_at(said, F.lit(-1))
    parsed = F.from_json(line, ", ".join(f"{c} int" for c in (*RUBRIC, "total_score")))
    fields = [parsed[c] for c in RUBRIC]
    valid, total = F.lit(True), F.lit(0)
    for f in fields:
        valid, total = valid & F.coalesce(f.between(0, 5), F.lit(False)), total + f
    return F.struct(*[f.alias(c) for f, c in zip(fields, RUBRIC, strict=True)], parsed["total_score"].alias("total_score"), (valid & F.coalesce(total == parsed["total_score"], F.lit(False))).alias("valid"))
