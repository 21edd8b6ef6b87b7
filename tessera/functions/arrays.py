"""Functions over arrays: n-grams, masked sums, sequence recurrences. A mask is an array of 0 and 1 of the same length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, also inside of lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(length: Column, n: int) -> Column:
    """The 1-based beginnings of windows of ``n`` in ``length``; none if it is shorter."""
    count = length - (n - 1)
    return F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of an array, repeats included."""
    return let(tokens, lambda t: F.transform(places(F.size(t), n), lambda k: F.slice(t, k, F.lit(n))))


def window_hashes(hashes: Column, n: int) -> Column:
    """The 64-bit hashes of all windows of ``n`` elements of an array of hashes, repeats included.

    Windows of m and the same ones further on make those of up to 2 m, so a window costs log n steps.
    The last step hashes ``n`` too: else windows of 3 and of 4 equal elements would hash alike.
    """
    out, m = hashes, 1
    while m < n:
        step = min(m, n - m)
        m += step
        out = let(out, _together(step, [F.lit(n)] if m == n else []))
    return out


def _together(step: int, more: list[Column]) -> Callable[[Column], Column]:
    """Every element hashed with the one ``step`` behind it and with ``more``."""

    def pairs(w: Column) -> Column:
        rest = F.greatest(F.size(w) - step, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(1 + step), rest), lambda a, b: F.xxhash64(a, b, *more))

    return pairs


def padded_ngrams(tokens: Column, n: int, pad: str) -> Column:
    """n-grams of the array with n - 1 pads at either end."""
    pads = F.array_repeat(F.lit(pad), n - 1)
    return ngrams(F.concat(pads, tokens, pads), n)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def product(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.cast("double") * b)


def masked_mean(x: Column, mask: Column, eps: float = 1e-8) -> Column:
    return total(product(x, mask)) / (total(F.transform(mask, lambda m: m.cast("double"))) + eps)


def suffix_sums(x: Column, mask: Column, gamma: float = 1.0) -> Column:
    """Discounted returns from the end: R_t = x_t + gamma * c, and then c is R_t where the mask holds, else 0."""
    pairs = F.reverse(F.zip_with(x, mask, lambda a, m: F.struct(a.cast("double").alias("x"), m.cast("double").alias("m"))))
    start = F.struct(F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        value = p.x + gamma * s.c
        return F.struct((value * p.m).alias("c"), F.concat(F.array(value), s.out).alias("out"))

    return F.aggregate(pairs, start, step, lambda s: s.out)


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages; masked places carry the state of the places behind them."""
    rows = F.reverse(F.zip_with(F.arrays_zip(rewards.alias("r"), values.alias("v")), mask, lambda p, m: F.struct(p.r.cast("double").alias("r"), p.v.cast("double").alias("v"), m.alias("m"))))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        g = p.r + gamma * s.next - p.v + gamma * lam * s.last
        last = F.when(p.m > 0, g).otherwise(s.last)
        return F.struct(F.when(p.m > 0, p.v).otherwise(s.next).alias("next"), last.alias("last"), F.concat(F.array(last), s.out).alias("out"))

    return F.aggregate(rows, start, step, lambda s: s.out)


def response_mask(ids: Column, *eos: int) -> Column:
    """1 up to and with the first end mark, then 0."""
    first = F.aggregate(
        ids,
        F.struct(F.lit(0).alias("seen"), F.array().cast("array<int>").alias("out")),
        lambda s, x: F.struct(F.when(x.isin(*eos), 1).otherwise(s.seen).alias("seen"), F.concat(s.out, F.array(1 - s.seen)).alias("out")),
        lambda s: s.out,
    )
    return first


def position_ids(mask: Column) -> Column:
    """Running counts of the mask less one, at least 0."""
    return F.aggregate(
        mask,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")),
        lambda s, m: F.struct((s.n + m).alias("n"), F.concat(s.out, F.array(F.greatest(s.n + m - 1, F.lit(0)))).alias("out")),
        lambda s: s.out,
    )


def response_positions(last: Column, length: Column) -> Column:
    return F.when(length > 0, F.sequence(last + 1, last + F.greatest(length, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def placed_score(score: Column, length: Column, size: Column) -> Column:
    """Zeros of ``size`` with the score at the last of ``length`` places; nowhere for length 0."""
    return F.transform(F.sequence(F.lit(1), size), lambda k: F.when(k == length, score).otherwise(0.0))


def kl(a: Column, b: Column, kind: str) -> Column:
    """Estimate of the divergence of log-probabilities ``a`` from ``b``, place by place; ``full``: exact, from arrays of a place's log-probabilities over all tokens."""
    if kind == "full":
        return F.zip_with(a, b, lambda p, q: total(F.zip_with(p, q, lambda x, y: F.exp(x) * (x - y))))

    def one(x: Column, y: Column) -> Column:
        if kind == "kl":
            return x - y
        if kind == "abs":
            return F.abs(x - y)
        if kind == "mse":
            return 0.5 * (x - y) * (x - y)
        if kind == "low_var_kl":
            k = F.greatest(F.least(y - x, F.lit(20.0)), F.lit(-20.0))
            return F.greatest(F.least(F.exp(k) - k - 1, F.lit(10.0)), F.lit(-10.0))
        raise ValueError(f"unknown estimator {kind!r}")

    return F.zip_with(a, b, one)
