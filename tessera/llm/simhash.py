"""SimHash near-duplicates, searched in BK-trees.

``fingerprints`` gives the 64-bit fingerprint of every whole text. ``components_of``
links fingerprints that differ in at most ``radius`` bits and returns the component of
every row.

Search. The distinct fingerprints are dealt to shards that agree in some bits: with the
64 bits in ``radius + keep`` blocks, two fingerprints within the radius agree in at
least ``keep`` whole blocks, so a shard for every choice of ``keep`` blocks and every
value of them misses no link. Each shard is one BK-tree, whose children hang at their
integer Hamming distance to the parent, and each of its fingerprints is looked up in it
following only edges within the radius of the distance found. Trees of a task are built
and searched level by level in numpy, many shards together. A shard of more than
``TREE`` fingerprints is cut into trees of that size; each such tree is sent to every
group of the shard's queries, so no task holds more and no pair is missed. What is sent
is bounded by ``TREE``, never by the corpus. ``keep`` grows with the number of
fingerprints so that a shard stays small; every choice of it finds the same links.

A task returns no pairs but a spanning forest of the links it found.

Null and empty texts have fingerprint zero, which links as any other. Texts with fewer
words than the shingle size count as one shingle of all their words. Rows are kept one
to one; a row with a null id takes the component of its text, which is null if no row
of the component has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.runs import beside, whole_runs
from tessera.llm.storage import scratch, written
from tessera.shipping import ship

WORDS = 4
SEED = 42
RADIUS = 4
#: Most fingerprints of one BK-tree.
TREE = 4096
_HASHES = 1 << 15
_FLUSH = 1 << 17
_QUERIES = 1 << 13


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bit by bit the majority of the XXH64 of all shingles (ties give 0), as an unsigned number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    first = np.r_[0, ends[:-1] + 1][: len(last)].tolist()
    last = last.tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(last), _HASHES):
        part = np.array([digest(joined[i:j], seed) for i, j in zip(first[at : at + _HASHES], last[at : at + _HASHES], strict=True)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` of every row with ``fp``, its fingerprint as a signed long; underscores go before that name if ``keep`` has it."""

    def make(texts: pa.Array) -> list[pa.Array]:
        found = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), np.uint64, len(texts))
        return [pa.array(found.view(np.int64))]

    return beside(df, keep, text, make, {"fp": "long"})


def hexed(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def masks(keep: int, radius: int = RADIUS) -> list[int]:
    """The bits that fingerprints of a shard agree in, for each choice of ``keep`` of ``radius + keep`` blocks, as signed longs."""
    n = radius + keep
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(n)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(blocks, keep))]


class Forest:
    """BK-trees of many shards together. ``tree`` numbers the shard of each value; trees are built level by level."""

    def __init__(self, tree: np.ndarray, values: np.ndarray):
        self.values, n = values, len(values)
        trees, self.roots = np.unique(tree, return_index=True)
        self.trees = trees
        at = self.roots[np.searchsorted(trees, tree)]
        left = np.setdiff1d(np.arange(n), self.roots, assume_unique=True)
        parent, edge = [], []
        at = at[left]
        while len(left):
            key = at * 65 + np.bitwise_count(values[left] ^ values[at])
            keys, first, which = np.unique(key, return_index=True, return_inverse=True)
            parent.append(keys)
            edge.append(left[first])
            rest = np.ones(len(left), np.bool_)
            rest[first] = False
            at, left = left[first][which][rest], left[rest]
        keys = np.concatenate(parent) if parent else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.child = keys[order], (np.concatenate(edge)[order] if edge else np.zeros(0, np.int64))

    def search(self, tree: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (query, value) places within ``radius``, block by block; every query must name a tree that exists."""
        for start in range(0, len(queries), _QUERIES):
            q = np.arange(start, min(start + _QUERIES, len(queries)))
            node = self.roots[np.searchsorted(self.trees, tree[q])]
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
                n = hi - lo
                q = np.repeat(q, n)
                node = self.child[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union in place: ``labels`` points each place to a smaller one of its set or itself."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def forest_links(cells: np.ndarray, side: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each cell. ``side``: 0 in the tree and a query, 1 only in the tree, 2 only a query."""
    inside, asks = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
    forest, labels = Forest(cells[inside], values[inside]), np.arange(len(values))
    asks = asks[np.isin(cells[asks], forest.trees)]
    for q, v in forest.search(cells[asks], values[asks], radius):
        joined(labels, asks[q], inside[v])
    while (labels[labels] != labels).any():
        labels = labels[labels]
    moved = np.flatnonzero(labels != np.arange(len(values)))
    return values[moved], values[labels[moved]]


def links(distinct: DataFrame, count: int, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links ``a``, ``b`` of a table of ``count`` distinct fingerprints ``fp`` that connect all within the radius."""
    ship(distinct.sparkSession)
    keep = next((k for k in range(1, 9) if count >> (64 * k // (radius + k)) <= tree), 8)
    chosen = masks(keep, radius)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(chosen)]))
    dealt = distinct.select("fp", keys.alias("s")).select("fp", "s.mask", "s.key")
    large = dealt.groupBy("mask", "key").count().where(F.col("count") > tree).select("mask", "key", F.ceil(F.col("count") / tree).cast("int").alias("groups"))
    large = written(large, "large-shards")
    if large.isEmpty():
        cells = dealt.select("mask", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("groups")).cast("int")
        sized = dealt.join(large, ["mask", "key"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
        each = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        cells = each.select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "fp")

    places = ["mask", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell in whole_runs(batches, places, _FLUSH):
            more = np.bincount(cell)[cell] > 1
            a, b = forest_links(cell[more], table["side"].to_numpy()[more], table["fp"].to_numpy().view(np.uint64)[more], radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count * len(chosen) / (4 * _FLUSH)))
    return cells.repartition(parts, *places).sortWithinPartitions(*places).mapInArrow(run, "a long, b long")


def rooted(rows: DataFrame, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """For every fingerprint of ``rows`` its ``root``, which its component agrees on, and the ``least`` key that has it; a written table."""
    with scratch() as keep:
        seen = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "fingerprints")
        roots = components(links(seen.select("fp"), seen.count(), radius))
        return keep(written(seen.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots"))


def components_of(rows: DataFrame, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """``rows`` (with ``fp``, a written table) with ``component_id``: the smallest key reachable over fingerprints within the radius."""
    with scratch() as keep:
        known = rooted(rows, radius, key)
        least = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        named = keep(written(known.join(least, "root").select("fp", "component_id"), "named"))
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Per row: ``key``, ``fingerprint`` in hexadecimal digits, ``component_id``."""
    rows = written(fingerprints(docs, text, (key,)), "texts")
    return components_of(rows, radius, key).select(key, hexed(F.col("fp")).alias("fingerprint"), "component_id")
