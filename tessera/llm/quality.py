"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes two groups of hashed counts, of character trigrams and of character
shapes (letter case, digit, blank, mark) four at a time, and a few marks of its
statistics. ``fit`` weighs the counts of a bounded sample of labelled rows by inverse
document frequency, takes a truncated singular value decomposition and keeps the
labelled latent vectors. ``score`` broadcasts these, projects every whole text, takes
exact blocked cosine products with all labelled vectors and lets the nearest vote,
each with a power of its similarity as weight.

The score is the weighted share of label 1. A null or empty text has no vector and gets
the share of label 1 among the labelled rows, as has any text without a similar
neighbour (0.5 if there are no labelled rows). Rows are kept one to one, repeated rows
and null ids included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runs import beside
from tessera.shipping import ship

BITS = 12
MARKS = 64
WIDTH = (2 << BITS) + MARKS
#: Labelled rows the fit takes, in expectation.
FIT_ROWS = 4000
DIMS = 64
NEAREST = 15
POWER = 8
THRESHOLD = 0.7
#: Texts that are worked on at once.
BLOCK = 256


@dataclass(frozen=True)
class Model:
    """Inverse document frequencies, projection, labelled latent unit vectors, their labels, share of label 1."""

    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


@lru_cache(1)
def _shapes() -> np.ndarray:
    """A shape of each code point: 1 small letter, 2 capital, 3 digit, 4 blank, 5 line end, marks by their code."""

    def shape(c: str) -> int:
        if c.isalpha():
            return 2 if c.isupper() else 1
        return 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 6 + ord(c) % 122

    return np.fromiter((shape(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a text's features, each group of unit length; none for an empty text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    codes = np.r_[np.uint32(32), codes, np.uint32(32)]
    shapes = _shapes()[codes].astype(np.uint32)
    places, weights = [], []
    for group, (symbols, n) in enumerate(((codes, 3), (shapes, 4))):
        h = np.zeros(len(symbols), np.uint32)
        for k in range(min(n, len(symbols))):
            h = h[: len(symbols) - k] * np.uint32(0x01000193) + symbols[k:]
        counts = np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
        at = np.flatnonzero(counts)
        w = np.sqrt(counts[at]).astype(np.float32)
        places.append(at + (group << BITS))
        weights.append(w / np.sqrt(w @ w))
        if group == 0:
            spread = int(8 * len(at) / min(len(h), 1 << BITS))
            places.append(np.array([(2 << BITS) + min(7, spread) * 8 + min(7, int(np.log2(len(h) + 1)) // 2)]))
            weights.append(np.ones(1, np.float32) * 0.3)
    return np.concatenate(places), np.concatenate(weights)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS, dims: int = DIMS, seed: int = 7) -> Model:
    """Learn from about ``rows`` labelled rows, chosen by a hash of ``key``; labels other than 0 and 1 and null keys are left out.

    ``rows`` bounds what the driver gets: their labels, then their features. A key counts
    once, also where several documents have it: then the text whose hash is least.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    share = F.pmod(F.xxhash64("key", F.lit("quality fit")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(share < rows / max(1, known.count())).collect()
    if not chosen:
        return Model(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    small = spark.createDataFrame(chosen, known.schema).dropDuplicates()
    every = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("__text")).join(F.broadcast(small), "key")
    found = every.groupBy("key", "label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text")).select("key", "__text", "label")
    kind = found.schema["key"].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([p.astype(np.uint16).tobytes() for p, _ in got]), pa.array([w.astype(np.float16).tobytes() for _, w in got])], ["key", "label", "places", "weights"])

    sample = found.mapInArrow(take, f"key {kind}, label int, places binary, weights binary").toArrow().sort_by([("key", "ascending"), ("label", "ascending"), ("places", "ascending")])
    keep = [k for k, p in enumerate(sample["places"].to_pylist()) if p]
    if not keep:
        return Model(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    sample = sample.take(keep)
    y = np.array(sample["label"].to_pylist(), np.float32)
    x = np.zeros((len(y), WIDTH), np.float32)
    for k, (p, w) in enumerate(zip(sample["places"].to_pylist(), sample["weights"].to_pylist(), strict=True)):
        x[k, np.frombuffer(p, np.uint16)] = np.frombuffer(w, np.float16)
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + np.float32(0.1)
    del sample
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    wide = min(dims + 16, *x.shape)
    q = x.T @ (x @ np.random.default_rng(seed).standard_normal((WIDTH, wide), np.float32))
    for _ in range(3):
        q = x.T @ (x @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    project = np.ascontiguousarray((q @ vt.T)[:, : min(dims, int((s > 1e-6).sum()) or 1)])
    return Model(idf, project, _unit(x @ project), y, float(y.mean()) if len(y) else 0.5)


def _unit(z: np.ndarray) -> np.ndarray:
    n = np.sqrt((z * z).sum(1, keepdims=True))
    return np.divide(z, n, out=np.zeros_like(z), where=n > 1e-9)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` greatest in every row; of equal ones the first."""
    least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
    above, same = cosine > least, cosine == least
    chosen = above | (same & (np.cumsum(same, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(chosen)[1].reshape(len(cosine), k)


def votes(model: Model, texts: list[str | None], block: int = BLOCK) -> np.ndarray:
    """The score of each text."""
    out = np.full(len(texts), model.prior)
    for first in range(0, len(texts), block) if len(model.labels) else ():
        part = texts[first : first + block]
        x = np.zeros((len(part), WIDTH), np.float32)
        for k, t in enumerate(part):
            places, weights = features(t or "")
            x[k, places] = weights
        cosine = _unit((x * model.idf) @ model.project) @ model.vectors.T
        k = min(NEAREST, cosine.shape[1])
        near = nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** POWER
        total = weight.sum(1)
        voted = np.divide((weight * model.labels[near]).sum(1), total, out=np.full(len(part), model.prior), where=total > 1e-12)
        out[first : first + len(part)] = voted
    return np.clip(out, 0, 1)


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns ``keep`` of every row with its score as ``out``; underscores go before that name if ``keep`` has it."""
    shared = df.sparkSession.sparkContext.broadcast((model.idf, model.project, model.vectors, model.labels, model.prior))

    def make(texts: pa.Array) -> list[pa.Array]:
        each = [votes(Model(*shared.value), texts[at : at + BLOCK].to_pylist()) for at in range(0, len(texts), BLOCK)]
        return [pa.array(np.concatenate([np.zeros(0), *each]))]

    return beside(df, keep, text, make, {out: "double"})
