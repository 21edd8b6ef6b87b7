"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts the n-grams of a bounded sample of labelled texts on the executors and
returns the matrix of log-probabilities (buckets by languages). ``predict`` broadcasts
the matrix and scores every whole text in numpy: the n-grams of a batch of texts are
looked up as sparse rows and summed by text.

Texts are lower-cased, every run of other characters than letters counts as a blank, and
one stands behind every text.
A null text, an empty one and one without a letter gets ``und`` with score 1.0 (it is
certain that nothing can be told). Scores are posterior probabilities. Equal posteriors
go to the language that sorts first. With no labelled text at all every text is ``und``
with score 0.0. Rows are kept one to one, repeated rows and null ids included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runs import beside
from tessera.shipping import ship

BITS = 16
ORDERS = (1, 2, 3, 4)
#: Labelled texts the fit takes of each language, in expectation.
FIT_TEXTS = 1000
UNKNOWN = "und"
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Model:
    """Languages in order, log-probabilities of buckets by language, log-priors."""

    langs: tuple[str, ...]
    matrix: np.ndarray
    prior: np.ndarray


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Whether each text has a letter; then for each order the text and bucket of each n-gram, texts ascending."""
    codes = np.frombuffer("".join(f"{t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    letter = _letters()[codes]
    at = np.repeat(np.arange(len(texts)), lengths + 1)
    has = np.zeros(len(texts), np.bool_)
    has[at[letter]] = True
    kept = letter | np.r_[False, letter[:-1]]  # of a run of other characters only the first
    symbols, owner = np.where(letter, codes, 32)[kept].astype(np.uint32), at[kept]

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = np.zeros(len(symbols), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(symbols) < n:
                return
            h = h[: len(symbols) - n + 1] * np.uint32(0x01000193) + symbols[n - 1 :]
            if n in ORDERS:
                own = owner[: len(h)]
                inside = own == owner[n - 1 :]
                bucket = ((h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                yield own[inside], bucket[inside]

    return has, each()


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``_CHUNK`` characters together, with the place of the first."""
    first, part, size = 0, [], 0
    for k, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= _CHUNK:
            yield first, part
            first, part, size = k + 1, [], 0
    if part:
        yield first, part


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = FIT_TEXTS, smooth: float = 0.5) -> Model:
    """Learn from rows with non-null ``lang`` and text; about ``per_lang`` rows of each language, chosen by a hash of ``key``."""
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros((1 << BITS, 0)), np.zeros(0))
    rate = F.create_map(*[x for s in langs for x in (F.lit(s), F.lit(min(1.0, per_lang / sizes[s])))])
    share = F.pmod(F.xxhash64("key", F.lit("language fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(share < F.element_at(rate, F.col("lang"))).select("text", "lang").repartition(8)
    index = {s: k for k, s in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(langs), 1 << BITS), np.int64)
        for batch in batches:
            own = np.array([index[s] for s in batch.column("lang").to_pylist()], np.int64)
            for first, part in _chunks(batch.column("text").to_pylist()):
                for owner, bucket in _grams(part)[1]:
                    found += np.bincount(own[first + owner] << BITS | bucket, minlength=len(langs) << BITS).reshape(found.shape)
        at = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(found[at])], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((1 << BITS, len(langs)))
    n[counts["bucket"].to_numpy(), counts["lang"].to_numpy()] = counts["n"].to_numpy()
    total = np.array([sizes[s] for s in langs], float)
    return Model(langs, np.log((n + smooth) / (n.sum(0) + smooth * len(n))), np.log(total / total.sum()))


def posteriors(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language and its posterior; index -1 for texts without letters."""
    best, score = np.full(len(texts), -1), np.ones(len(texts))
    if not model.langs:
        return best, np.zeros(len(texts))
    for first, part in _chunks(texts):
        has, grams = _grams(part)
        logs = np.tile(model.prior, (len(part), 1))
        for owner, bucket in grams:
            if len(owner):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                logs[owner[starts]] += np.add.reduceat(model.matrix[bucket], starts, axis=0)
        top = logs.argmax(1)
        p = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        part_at = slice(first, first + len(part))
        best[part_at] = np.where(has, top, -1)
        score[part_at] = np.where(has, p, 1.0)
    return best, score


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``; underscores go before these names if ``keep`` has them."""
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.matrix, model.prior))

    def make(texts: pa.Array) -> list[pa.Array]:
        own = Model(*shared.value)
        best, score = posteriors(own, texts.to_pylist())
        return [pa.array(np.array([*own.langs, UNKNOWN], object)[best].tolist(), pa.string()), pa.array(score)]

    return beside(df, keep, text, make, {"lang_pred": "string", "score": "double"})


def remainder(key: Column, by: int) -> Column:
    """crc32 of the decimal key, modulo ``by``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % by
