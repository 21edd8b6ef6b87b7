"""Group-relative advantages and losses over sampled responses.

Rows are responses. Estimators are DataFrame functions in ``ESTIMATORS``; they add
``advantages`` (an array along the mask ``mask``) and, where it differs, ``returns``.
Group statistics come from aggregates that combine before they are exchanged, joined
back by group, so a group of any size meets in no task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A

EPS = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def estimator(name: str) -> Callable:
    """Register a function under ``name``."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ESTIMATORS[name] = function
        return function

    return add


def compute(name: str, df: DataFrame, **options) -> DataFrame:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name](df, **options)


def _grouped(df: DataFrame, *aggregates: Column, group: str = "uid") -> DataFrame:
    stats = df.groupBy(F.col(group).alias("_g")).agg(*aggregates)
    return df.join(stats, df[group].eqNullSafe(stats["_g"])).drop("_g")


def _along(value: Column) -> Column:
    return F.transform("mask", lambda m: m * value)


@estimator("grpo")
def grpo(df: DataFrame, eps: float = EPS) -> DataFrame:
    """(score - mean) / (deviation + eps); null for groups of one."""
    out = _grouped(df, F.avg("score").alias("_mean"), F.stddev_samp("score").alias("_std"))
    out = out.withColumn("advantage", (F.col("score") - F.col("_mean")) / (F.col("_std") + eps))
    return out.withColumn("advantages", _along(F.col("advantage"))).drop("_mean", "_std")


@estimator("grpo_passk")
def grpo_passk(df: DataFrame, eps: float = EPS, zero_others: bool = True, order: str = "row_idx") -> DataFrame:
    """The best response gets (best - second) / (deviation + eps); others 0, or with ``zero_others=False`` their raw score. Ties: the least ``order``."""
    best = _grouped(df, F.max_by(order, F.struct("score", -F.col(order))).alias("_best"), F.max("score").alias("_top"), F.stddev_samp("score").alias("_std"))
    second = best.where(F.col(order) != F.col("_best")).groupBy(F.col("uid").alias("_g")).agg(F.max("score").alias("_second"))
    out = best.join(second, best["uid"].eqNullSafe(second["_g"]), "left")
    value = F.when(F.col(order) == F.col("_best"), (F.col("_top") - F.col("_second")) / (F.col("_std") + eps)).otherwise(F.lit(0.0) if zero_others else F.col("score"))
    return out.withColumn("advantage", value).withColumn("advantages", _along(F.col("advantage"))).drop("_best", "_top", "_std", "_second", "_g")


@estimator("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """score - mean of the others; null for groups of one."""
    out = _grouped(df, F.sum("score").alias("_sum"), F.count("*").alias("_n"))
    others = (F.col("_sum") - F.col("score")) / F.when(F.col("_n") > 1, F.col("_n") - 1)
    return out.withColumn("advantage", F.col("score") - others).withColumn("advantages", _along(F.col("advantage"))).drop("_sum", "_n")


def whitened(df: DataFrame, column: str, mask: str = "mask", eps: float = 1e-8) -> DataFrame:
    """``column`` less its masked mean over the whole batch, by its masked deviation; unmasked places alike."""
    pair = F.zip_with(column, mask, lambda x, m: F.struct(x.cast("double").alias("x"), m.cast("double").alias("m")))
    sums = df.select(F.aggregate(pair, F.lit(0.0), lambda a, p: a + p.x * p.m).alias("xm"), F.aggregate(pair, F.lit(0.0), lambda a, p: a + p.m).alias("m"))
    mean = sums.agg((F.sum("xm") / (F.sum("m") + eps)).alias("_mu"), F.sum("m").alias("_m"))
    centred = df.join(F.broadcast(mean))
    spread = centred.agg((F.sum(F.aggregate(F.zip_with(column, mask, lambda x, m: F.struct(x.alias("x"), m.cast("double").alias("m"))), F.lit(0.0), lambda a, p: a + (p.x - F.col("_mu")) ** 2 * p.m)) / (F.first("_m") + eps) * F.when(F.first("_m") > 1, F.first("_m") / (F.first("_m") - 1)).otherwise(1.0)).alias("_var"))
    out = centred.join(F.broadcast(spread))
    return out.withColumn(column, F.transform(column, lambda x: (x - F.col("_mu")) / F.sqrt(F.col("_var") + eps))).drop("_mu", "_m", "_var")


@estimator("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    out = df.withColumn("returns", A.suffix_sums(F.col("rewards"), F.col("mask"), gamma))
    return whitened(out.withColumn("advantages", F.col("returns")), "advantages")


@estimator("remax")
def remax(df: DataFrame) -> DataFrame:
    """score less the baseline of the greedy response; returns are masked sums to the end."""
    masked = F.zip_with("rewards", "mask", lambda r, m: r * m)
    ones = F.transform("mask", lambda m: F.lit(1))
    out = df.withColumn("returns", A.suffix_sums(masked, ones))
    return out.withColumn("advantage", F.col("score") - F.col("baseline")).withColumn("advantages", _along(F.col("advantage")))


@estimator("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    out = df.withColumn("advantages", A.gae(F.col("rewards"), F.col("values"), F.col("mask"), gamma, lam))
    out = out.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v))
    return whitened(out, "advantages")


def average_loss(df: DataFrame, loss: str, mode: str = "token", mask: str = "mask", eps: float = 1e-8) -> DataFrame:
    """One row: the mean over all tokens, or the mean of the sequences' means."""
    x, m = A.total(A.product(F.col(loss), F.col(mask))), A.total(F.transform(mask, lambda v: v.cast("double")))
    if mode == "token":
        return df.agg((F.sum(x) / (F.sum(m) + eps)).alias("loss"))
    if mode == "seq":
        return df.agg(F.avg(x / (m + eps)).alias("loss"))
    raise ValueError(f"unknown mode {mode!r}")


def clamped(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def policy_terms(log_prob: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.3, dual: float = 3.0, kind: str = "default") -> Column:
    """Of one token: struct of ``loss``, whether the ratio was ``clipped`` from above or from below (``dual``), and ``kl``."""
    import math

    x = log_prob - old
    ratio, bounded = F.exp(clamped(x, -20.0, 20.0)), F.exp(clamped(x, math.log(1 - low), math.log(1 + high)))
    one, two, three = -advantage * ratio, -advantage * bounded, -advantage * dual
    worst = F.greatest(one, two)
    loss = -advantage * log_prob * bounded if kind == "cispo" else F.when(advantage < 0, F.least(worst, three)).otherwise(worst)
    return F.struct(loss.alias("loss"), (one < two).cast("double").alias("clipped"), ((worst > three) & (advantage < 0)).cast("double").alias("dual"), (old - log_prob).alias("kl"))


def policy_loss(df: DataFrame, low: float = 0.2, high: float = 0.3, dual: float = 3.0, kind: str = "default", mode: str = "token") -> DataFrame:
    """One row of ``loss``, ``clipfrac_higher``, ``clipfrac_lower`` and ``ppo_kl`` over arrays ``log_probs``, ``old_log_probs``, ``advantages``, ``mask``.

    ``kind``: default, cispo, or gspo, which takes a sequence's masked mean as every token's log-ratio.
    """
    new = F.col("log_probs")
    if kind in ("gspo", "gspo_token"):
        gap = F.zip_with("log_probs", "old_log_probs", lambda a, b: a - b)
        mean = A.masked_mean(gap, F.col("mask"))
        new = A.let(mean, lambda g: F.transform("old_log_probs", lambda b: b + g))
    elif kind not in ("default", "cispo"):
        raise ValueError(f"unknown loss {kind!r}")
    rows = F.zip_with(F.zip_with(new, "old_log_probs", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), "advantages", lambda p, v: policy_terms(p.a, p.b, v, low, high, dual, kind))
    out = df.select("mask", rows.alias("t"))
    parts = out.select("mask", *[F.col(f"t.{c}").alias(c) for c in ("loss", "clipped", "dual", "kl")])
    total = lambda c: F.sum(A.total(A.product(F.col(c), F.col("mask")))) / (F.sum(A.total(F.transform("mask", lambda v: v.cast("double")))) + 1e-8)
    seq = F.avg(A.masked_mean(F.col("loss"), F.col("mask")))
    return parts.agg((total("loss") if mode == "token" else seq).alias("loss"), total("clipped").alias("clipfrac_higher"), total("dual").alias("clipfrac_lower"), total("kl").alias("ppo_kl"))


def value_loss(df: DataFrame, clip: float = 0.5) -> DataFrame:
    """One row of half the mean of the larger squared error, of predictions or of predictions clipped around the old values, and the share clipped."""
    both = F.zip_with(F.zip_with("predicted", "values", lambda p, v: F.struct(p.alias("p"), clamped_by(p, v, clip).alias("c"))), "returns", lambda x, r: F.struct(((x.p - r) ** 2).alias("a"), ((x.c - r) ** 2).alias("b")))
    parts = df.select("mask", F.transform(both, lambda e: F.greatest(e.a, e.b)).alias("loss"), F.transform(both, lambda e: (e.a < e.b).cast("double")).alias("clipped"))
    total = lambda c: F.sum(A.total(A.product(F.col(c), F.col("mask")))) / (F.sum(A.total(F.transform("mask", lambda v: v.cast("double")))) + 1e-8)
    return parts.agg((0.5 * total("loss")).alias("loss"), total("clipped").alias("clipfrac"))


def clamped_by(x: Column, centre: Column, by: float) -> Column:
    return F.greatest(F.least(x, centre + by), centre - by)


class FixedKL:
    """A penalty coefficient that stays."""

    def __init__(self, coef: float):
        self.coef = coef

    def update(self, current: float, steps: int) -> None:
        pass


class AdaptiveKL(FixedKL):
    """A penalty coefficient that follows the divergence towards ``target``."""

    def __init__(self, coef: float, target: float, horizon: float):
        super().__init__(coef)
        self.target, self.horizon = target, horizon

    def update(self, current: float, steps: int) -> None:
        error = max(-0.2, min(0.2, current / self.target - 1))
        self.coef *= 1 + error * steps / self.horizon
