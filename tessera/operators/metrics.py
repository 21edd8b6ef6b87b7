"""Similarity metrics over pairs of texts, vectors and images.

BLEU counts stay in the row of a pair.
They, edit distance and image similarity are numpy functions behind Arrow UDFs. A metric that
needs a neural model takes its distance as a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexer as X
from tessera.functions import maths as M
from tessera.functions import text as T
from tessera.shipping import ship

_SEP = "\x1f"
_TEX = re.compile(r"\\[A-Za-z@]+\*?|\\.|[{}\[\]()$&#^_~]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|[^\sA-Za-z0-9]")


def tex_tokens(code: str | None) -> list[str]:
    """Commands, marks, words and numbers of TeX code; comments must be out before."""
    return _TEX.findall(code or "")


def tex_tokens_of(code: Column) -> Column:
    """:func:`tex_tokens` of a column."""
    return F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(_TEX.pattern), F.lit(0))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


#: An odd number whose powers weigh the places of a window; hashes of words are as good as random, so sums of them are.
_PLACES = np.uint64(0x9E3779B97F4A7C15)


def _windows(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of ``n`` words that lie in one row, and their rows."""
    count = max(0, len(words) - n + 1)
    out = words[:count].copy()
    for k in range(1, n if count else 1):
        out *= _PLACES
        out += words[k : k + count]
    inside = row[:count] == row[n - 1 :] if count else np.zeros(0, np.bool_)
    return out[inside], row[:count][inside]


def ngram_matches(hyp: pa.ListArray, ref: pa.ListArray, trivial: list[np.ndarray]) -> np.ndarray:
    """Per row of hashes of words: ``matched``, ``total`` and ``kinds`` of every order, then the words of either side; ``trivial`` holds hashes of windows by order. The n-grams of all rows are put in order together."""
    sides = []
    for side in (hyp, ref):
        ends = side.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(ends)
        row = np.repeat(np.arange(len(side), dtype=np.uint16 if len(side) < 1 << 16 else np.int64), sizes)
        sides.append((side.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64).view(np.uint64), row, sizes))
    out = np.zeros((len(hyp), 3 * len(trivial) + 2), np.int64)
    for n, few in enumerate(trivial, 1):
        (h, at), (other, where) = (_windows(*side[:2], n) for side in sides)
        hashes, rows = np.concatenate([h, other]), np.concatenate([at, where])
        order = np.argsort(hashes)
        order = order[np.argsort(rows[order], kind="stable")]
        hashes, rows, said = hashes[order], rows[order], order < len(h)
        if not len(order):
            continue
        first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])])
        mine = np.add.reduceat(said.astype(np.int64), first)
        others = np.diff(np.r_[first, len(order)]) - mine
        mine[np.isin(hashes[first], few)] = 0
        for k, count in enumerate((np.minimum(mine, others), mine, mine > 0)):
            out[:, 3 * n - 3 + k] = np.bincount(rows[first], count, len(hyp))
    out[:, -2], out[:, -1] = sides[0][2], sides[1][2]
    return out


def matches(spark: SparkSession, hyp: Column, ref: Column, trivial: DataFrame | None = None, orders: int = 4) -> Column:
    """An array of what :func:`ngram_matches` says of two arrays of words, without n-grams in ``trivial`` (``n``, ``gram``), a list of bounded length (the k commonest)."""
    ship(spark)
    few: list[list[np.ndarray]] = [[] for _ in range(orders)]
    for r in trivial.select("n", word_hashes(F.split("gram", _SEP)).alias("words")).collect() if trivial is not None else []:
        words = np.array(r["words"], np.int64).view(np.uint64)[: r["n"]]
        if 0 < r["n"] <= orders:
            few[r["n"] - 1].append(_windows(words, np.zeros(len(words), np.uint16), r["n"])[0])
    listed = [np.concatenate([np.zeros(0, np.uint64), *some]) for some in few]

    @F.arrow_udf("array<bigint>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        found = ngram_matches(left, right, listed)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

    return run(word_hashes(hyp), word_hashes(ref))


def bleu_counts(pairs: DataFrame, key: str, hyp: str, ref: str, trivial: DataFrame | None = None, orders: int = 4) -> DataFrame:
    """Per key and order ``n``: ``matched``, ``total`` (n-grams of the hypothesis) and ``kinds`` (different ones), without those in ``trivial`` (``n``, ``gram``).

    A pair's n-grams are counted in its row, by 64-bit hashes; nothing is shuffled.
    """
    counted = pairs.select(key, matches(pairs.sparkSession, F.col(hyp), F.col(ref), trivial, orders).alias("_c"))
    each = [F.struct(F.lit(n + 1).alias("n"), *[F.get("_c", F.lit(3 * n + k)).alias(c) for k, c in enumerate(("matched", "total", "kinds"))]) for n in range(orders)]
    return counted.select(key, F.explode(F.array(*each)).alias("c")).select(key, "c.n", "c.matched", "c.total", "c.kinds")


def _score(counts: Column, under: str, orders: int) -> Column:
    """BLEU from an array as of :func:`matches`."""
    at = lambda k: F.get(counts, F.lit(k))
    matched, total = [at(3 * n) for n in range(orders)], [at(3 * n + ("total", "kinds").index(under) + 1) for n in range(orders)]
    hyp, ref = at(3 * orders), at(3 * orders + 1)
    whole = (hyp > 0) & (ref > 0)
    for m in matched:
        whole = whole & (m > 0)
    logs = F.lit(0.0)
    for m, t in zip(matched, total, strict=True):
        logs = logs + F.log(m / F.when(t > 0, t))
    short = F.when(hyp > ref, 1.0).otherwise(F.exp(1 - ref / F.when(hyp > 0, hyp)))
    return F.when(whole, short * F.exp(logs / orders)).otherwise(0.0)


def crystal_bleu(pairs: DataFrame, key: str, hyp: str, ref: str, trivial: DataFrame | None = None, orders: int = 4) -> DataFrame:
    """Per key ``bleu``: BLEU that leaves trivially shared n-grams out; 0 if a side is empty or an order has no match."""
    counted = pairs.select(key, matches(pairs.sparkSession, F.col(hyp), F.col(ref), trivial, orders).alias("_c"))
    return counted.select(key, _score(F.col("_c"), "total", orders).alias("bleu"))


def corpus_bleu(pairs: DataFrame, key: str, hyp: str, ref: str, trivial: DataFrame | None = None, orders: int = 4) -> DataFrame:
    """One row: BLEU of pooled counts."""
    counted = pairs.select(matches(pairs.sparkSession, F.col(hyp), F.col(ref), trivial, orders).alias("_c"))
    pooled = counted.agg(*[F.coalesce(F.sum(F.get("_c", F.lit(k))), F.lit(0)).alias(f"_{k}") for k in range(3 * orders + 2)])
    return pooled.select(F.array(*pooled.columns).alias("_c")).select(_score(F.col("_c"), "total", orders).alias("bleu"))


def fallback_bleu(pairs: DataFrame, key: str, hyp: str, ref: str, orders: int = 4, clip: bool = False) -> DataFrame:
    """Per key ``bleu`` whose precisions divide by the number of different n-grams; may exceed 1 unless clipped."""
    counted = pairs.select(key, matches(pairs.sparkSession, F.col(hyp), F.col(ref), None, orders).alias("_c"))
    out = counted.select(key, _score(F.col("_c"), "kinds", orders).alias("bleu"))
    return out.withColumn("bleu", F.least("bleu", F.lit(1.0))) if clip else out


def _trigrams(text: str) -> np.ndarray:
    """The set of three characters each as one number, in order."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else c[:0]


def _shared(a: str, b: str) -> float:
    x, y = _trigrams(a), _trigrams(b)
    every = np.sort(np.concatenate([x, y]))
    common = int((every[1:] == every[:-1]).sum())
    return common / (len(every) - common) if len(x) and len(y) else 0.0


def trigram_share(spark: SparkSession) -> Callable[[Column, Column], Column]:
    """Jaccard of the character trigrams of two texts as :func:`tessera.functions.text.char_grams` makes them, but exact numbers and in numpy: a step for each character costs much in a lambda."""
    ship(spark)

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([_shared(a.as_py() or "", b.as_py() or "") for a, b in zip(left, right, strict=True)], pa.float64())

    return lambda a, b: run(T.compact(a), T.compact(b))


#: Costs of edits are whole numbers of this part of one, so that ties are ties.
_UNIT = 1000


def extended_edit_distance(hyp: str, ref: str, alpha: float = 2.0, rho: float = 0.3, deletion: float = 0.2, insertion: float = 1.0) -> float:
    """Extended edit distance of characters, 0 to 1 (Stanchev et al. 2019): edits, jumps at blanks of the reference, and a penalty for repeated visits.

    Sums of costs are exact; among places of equal cost the first is visited.
    """
    if not ref:
        return 0.0 if not hyp else 1.0
    jump, drop, more = (round(x * _UNIT) for x in (alpha, deletion, insertion))
    h = np.frombuffer(hyp.encode("utf-32-le", "surrogatepass"), np.uint32)
    steps = np.arange(len(h) + 1, dtype=np.int64) * drop
    row = np.full(len(h) + 1, _UNIT, np.int64)
    row[0] = 0
    visits = np.full(len(h) + 1, -1, np.int64)
    for c in ref:
        fresh = np.empty_like(row)
        fresh[0] = row[0] + _UNIT
        fresh[1:] = np.minimum(row[:-1] + np.where(h != ord(c), _UNIT, 0), row[1:] + more)
        fresh = np.minimum.accumulate(fresh - steps) + steps
        at = int(fresh.argmin())
        visits[at] += 1
        if c == " ":
            fresh = np.minimum(fresh, jump + fresh[at])
        row = fresh
    coverage = rho * float(np.where(visits >= 0, visits, 1).sum())
    return min(1.0, (float(row[-1]) / _UNIT + coverage) / (len(ref) + coverage))


#: Characters of hypotheses that are worked on at once: as many as a core keeps near.
_CELLS = 1 << 15


def extended_edit_distances(pairs: list[tuple[str, str]], alpha: float = 2.0, rho: float = 0.3, deletion: float = 0.2, insertion: float = 1.0) -> list[float]:
    """:func:`extended_edit_distance` of many pairs: those of about equal length together, one character of all references a step."""
    out = [0.0 if not r and not h else 1.0 for h, r in pairs]
    order = sorted((k for k, (_, r) in enumerate(pairs) if r), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and end - start < 4096 and (end + 1 - start) * (len(pairs[order[end]][0]) + 1) <= _CELLS:
            end += 1
        some = sorted(order[start:end], key=lambda k: -len(pairs[k][1]))
        for k, d in zip(some, _together([pairs[k] for k in some], alpha, rho, deletion, insertion), strict=True):
            out[k] = d
        start = end
    return out


def _together(pairs: list[tuple[str, str]], alpha: float, rho: float, deletion: float, insertion: float) -> list[float]:
    """Distances of pairs, the longest reference first: at every step the pairs whose references go on are the first ones."""
    jump, drop, more = (round(x * _UNIT) for x in (alpha, deletion, insertion))
    codes = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes, lengths = np.array([len(h) for h, _ in pairs]), np.array([len(r) for _, r in pairs])
    kind = np.int32 if (int(sizes.max()) + int(lengths.max())) * 2 * max(_UNIT, jump, drop, more) < 2**31 else np.int64
    wide, long = int(sizes.max()), int(lengths.max())
    hyp, ref = np.zeros((len(pairs), wide), np.uint32), np.zeros((long, len(pairs)), np.uint32)
    for k, (h, r) in enumerate(pairs):
        hyp[k, : len(h)], ref[: len(r), k] = codes(h), codes(r)
    beyond = np.where(np.arange(wide + 1)[None] > sizes[:, None], np.iinfo(kind).max // 2, 0).astype(kind)
    steps = (np.arange(wide + 1) * drop).astype(kind)
    row = np.full((len(pairs), wide + 1), _UNIT, kind)
    row[:, 0] = 0
    visits = np.full((len(pairs), wide + 1), -1, np.int32)
    going = np.searchsorted(-lengths, -np.arange(long), side="left")  # references longer than the step's number
    for step in range(long):
        n = int(going[step])
        now, fresh = row[:n], np.empty((n, wide + 1), kind)
        fresh[:, 0] = now[:, 0] + _UNIT
        np.multiply(hyp[:n] != ref[step, :n, None], kind(_UNIT), out=fresh[:, 1:], dtype=kind)
        fresh[:, 1:] += now[:, :-1]
        np.minimum(fresh[:, 1:], now[:, 1:] + kind(more), out=fresh[:, 1:])
        fresh -= steps
        np.minimum.accumulate(fresh, axis=1, out=fresh)
        fresh += steps
        at = np.maximum(fresh, beyond[:n]).argmin(1)
        pair = np.arange(n)
        visits[pair, at] += 1
        blank = np.flatnonzero(ref[step, :n] == ord(" "))
        if len(blank):
            fresh[blank] = np.minimum(fresh[blank], jump + fresh[blank, at[blank]][:, None])
        row[:n] = fresh
    counted = np.where(beyond > 0, 0, np.where(visits >= 0, visits, 1)).sum(1)
    last = row[np.arange(len(pairs)), sizes]
    coverage = rho * counted.astype(np.float64)
    return np.minimum(1.0, (last / _UNIT + coverage) / (lengths + coverage)).tolist()


def edit_distance(spark: SparkSession, hyp: Column, ref: Column) -> Column:
    """Extended edit distance of both sides' tokens (arrays), joined by blanks and with one at either end; null if a side is null. A batch computes equal pairs once.

    The recurrence runs over the characters of the reference, for all pairs of a batch at once, in numpy behind Arrow.
    """
    ship(spark)

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        every = list(zip(left, right, strict=True))
        few = list({pair for pair in every if None not in pair})
        made = dict(zip(few, extended_edit_distances(few), strict=True))
        return pd.Series([made.get(pair) for pair in every], dtype="float64")

    spaced = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return run(spaced(hyp), spaced(ref))


def code_metrics(pairs: DataFrame, key: str, hyp: str, ref: str, trivial: DataFrame | None = None, tau: float = 0.4) -> DataFrame:
    """The record of code metrics per key, over the normalised bodies of both sides: ``token_edit_dist_norm``, ``token_edit_dist`` (times the reference's tokens), ``token_edit_sim`` and ``crystalbleu``.

    Both compare tokens of the TeX lexer; ``trivial`` holds n-grams of :func:`tessera.functions.lexer.code_words`.
    """
    return code_record(code_tokens(pairs, key, hyp, ref), key, trivial, tau)


def code_tokens(pairs: DataFrame, key: str, hyp: str, ref: str) -> DataFrame:
    """Per key what :func:`code_record` compares: the normalised bodies of both sides as tokens of the edit distance (``_h``, ``_r``) and of n-grams (``_hw``, ``_rw``). Written once, it spares those who need them again the lexer."""
    body = lambda c: T.normalize_tex(T.document_body(F.col(c)))
    return pairs.select(key, X.edit_words(body(hyp)).alias("_h"), X.edit_words(body(ref)).alias("_r"), X.code_words(body(hyp)).alias("_hw"), X.code_words(body(ref)).alias("_rw"))


def code_record(tokens: DataFrame, key: str, trivial: DataFrame | None = None, tau: float = 0.4) -> DataFrame:
    """:func:`code_metrics` of the table of :func:`code_tokens`."""
    spark = tokens.sparkSession
    d = tokens.select(key, edit_distance(spark, F.col("_h"), F.col("_r")).alias("token_edit_dist_norm"), F.size("_r").alias("_n"), matches(spark, F.col("_hw"), F.col("_rw"), trivial).alias("_c"))
    distance = F.col("token_edit_dist_norm")
    return d.select(key, distance, M.edit_count(distance, F.col("_n")).alias("token_edit_dist"), M.from_distance(distance, tau).alias("token_edit_sim"), _score(F.col("_c"), "total", 4).alias("crystalbleu"))


def pixels(width: int, data: bytes, channels: int = 3) -> np.ndarray:
    """Rows of RGB pixels from 8-bit ones; gray ones count in all three channels."""
    image = np.frombuffer(data, np.uint8).reshape(-1, width, channels)
    return image if channels == 3 else np.repeat(image, 3, axis=2)


def trimmed(image: np.ndarray, pad: int = 2) -> np.ndarray:
    """An image without its white border but for ``pad`` pixels; as it is if all white. A pixel is white whose difference from white has a luminance below one half."""
    gap = 255 - image.astype(np.int64)
    ink = (gap @ np.array([19595, 38470, 7471]) + 0x8000) >> 16 > 0
    rows, columns = np.flatnonzero(ink.any(1)), np.flatnonzero(ink.any(0))
    if not len(rows):
        return image
    return image[max(0, rows[0] - pad) : rows[-1] + 1 + pad, max(0, columns[0] - pad) : columns[-1] + 1 + pad]


def _resampled(image: np.ndarray, size: int) -> np.ndarray:
    """The columns of an image brought down to ``size`` by the cubic kernel with a = -1/2, widened by the factor, in whole numbers."""
    have = image.shape[1]
    factor = have / size
    centre = (np.arange(size) + 0.5) * factor
    reach = 2 * factor
    low, high = np.maximum(0, (centre - reach + 0.5).astype(int)), np.minimum(have, (centre + reach + 0.5).astype(int))
    at = low[:, None] + np.arange((high - low).max())[None]
    x = np.abs((at - centre[:, None] + 0.5) / factor)
    weight = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0)) * (at < high[:, None])
    weight /= weight.sum(1, keepdims=True)
    taken = image[:, np.minimum(at, have - 1)]
    return np.clip(np.floor(np.einsum("hskc,sk->hsc", taken.astype(np.float64), weight) + 0.5), 0, 255).astype(np.uint8)


def downscaled(image: np.ndarray, most: int = 1024) -> np.ndarray:
    """An image whose longer side is at most ``most``; 0 leaves all as they are."""
    height, width = image.shape[:2]
    if not most or max(height, width) <= most:
        return image
    scale = most / max(height, width)
    image = _resampled(image, max(1, round(width * scale)))
    return _resampled(image.transpose(1, 0, 2), max(1, round(height * scale))).transpose(1, 0, 2)


def fitted(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image filled with white, or cut, around its centre."""
    for axis, size in ((0, height), (1, width)):
        have = image.shape[axis]
        if have > size:
            at = (have - size) // 2
            image = image[at : at + size] if axis == 0 else image[:, at : at + size]
        elif have < size:
            before = (size - have) // 2
            pads = [(0, 0)] * 3
            pads[axis] = (before, size - have - before)
            image = np.pad(image, pads, constant_values=255)
    return image


def _smooth(x: np.ndarray, window: int, sigma: float) -> np.ndarray:
    """Means under a Gaussian window, where it lies inside the image; a side shorter than the window stays as it is."""
    place = np.arange(window) - window // 2
    weight = np.exp(-(place**2) / (2 * sigma**2))
    weight /= weight.sum()
    for axis in (0, 1):
        if x.shape[axis] >= window:
            x = np.lib.stride_tricks.sliding_window_view(x, window, axis) @ weight
    return x


def structural_similarity(a: np.ndarray, b: np.ndarray, align: str = "pad", most: int = 1024, window: int = 11, sigma: float = 1.5, k1: float = 0.01, k2: float = 0.03) -> float:
    """Mean SSIM of RGB images (Wang et al. 2004) under a Gaussian window, over all channels.

    White borders go, longer sides come down to ``most``, and both are brought to one size: ``pad`` fills up to the larger one of each side, ``crop`` cuts to the smaller.
    """
    if align not in ("pad", "crop"):
        raise ValueError(f"unknown alignment {align!r}")
    a, b = (downscaled(trimmed(x), most) for x in (a, b))
    pick = max if align == "pad" else min
    size = [pick(x, y) for x, y in zip(a.shape[:2], b.shape[:2], strict=True)]
    a, b = (fitted(x, *size).astype(np.float64) / 255 for x in (a, b))
    ma, mb = _smooth(a, window, sigma), _smooth(b, window, sigma)
    va, vb, cov = (_smooth(x, window, sigma) - m for x, m in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    c1, c2 = k1**2, k2**2
    return float(((2 * ma * mb + c1) / (ma**2 + mb**2 + c1) * ((2 * cov + c2) / (va + vb + c2))).mean())


def image_similarity(df: DataFrame, width: str, a: str, b: str, out: str = "ssim", channels: int = 1, align: str = "pad", most: int = 1024) -> DataFrame:
    """``df`` with the similarity of two columns of 8-bit pixels, gray (1 channel) or RGB (3); null where one is null or doesn't fit the width. Windows over pixels are numpy behind Arrow."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def run(widths: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        def one(w, x, y):
            if x is None or y is None or not w or len(x) % (w * channels) or len(y) % (w * channels) or not len(x) or not len(y):
                return None
            return structural_similarity(pixels(int(w), x, channels), pixels(int(w), y, channels), align, most)

        return pd.Series([one(*row) for row in zip(widths, left, right, strict=True)], dtype="float64")

    return df.withColumn(out, run(width, a, b))


def dispatched(pairs: DataFrame, metrics: dict[str, Column], known: tuple[str, ...]) -> DataFrame:
    """``pairs`` with a column of every known metric: the given one, or null where it is off."""
    return pairs.withColumns({name: metrics.get(name, F.lit(None).cast("double")) for name in known})


#: The fields of the records of image and code metrics. Of a metric that wasn't taken a similarity counts 0 and a distance nothing.
IMAGE_RECORD = ("siglip_cos", "clip_cos", "lpips_dist", "dreamsim_dist", "siglip_sim", "clip_sim", "lpips_sim", "ssim", "dreamsim_sim")
CODE_RECORD = ("token_edit_dist", "token_edit_dist_norm", "token_edit_sim", "crystalbleu")


def recorded(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with every field of a record: as it is, NaN as null, or by default null for distances and cosines and 0 for similarities."""
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) if c in df.columns else F.lit(None).cast("double") for c in fields}
    distance = lambda c: "dist" in c or c.endswith("_cos")
    return df.withColumns({c: x if distance(c) else F.coalesce(x, F.lit(0.0)) for c, x in known.items()})
