"""Subword tokens by ranked pair merges.

A text is cut into pieces by a regular expression in the JVM; the pieces of a batch, each
different one once, become ids together: all bytes of all pieces lie in one array, and in each
round every piece that still has a pair in the table merges its pair of lowest rank (the
first of equal ones). The table of pairs is built from a rank file: a pair of tokens
whose bytes together are a token merges to it. It is broadcast; its size is that of the
vocabulary. Pieces of more than ``LONG`` bytes, such as long runs without blanks, are merged
with a heap, so that their time grows with n log n.

A null text has no tokens, an empty one neither. Every byte is a token of its own at least, so
any text can be encoded, and the bytes of its tokens are its own.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship

LONG = 64
#: Pieces of rows that are encoded together, and short pieces whose ids a worker keeps.
PIECES, KNOWN = 1 << 17, 1 << 16
_NONE = np.iinfo(np.int64).max


class Merges:
    """A vocabulary: ids of the single bytes, and pairs of ids in order of their number with the id, which is the rank, of what they merge to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.known: dict[str, np.ndarray] = {}

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs merge to; the greatest number where they don't."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            if len(piece) > LONG:
                out[k] = self._one(piece)
            elif piece:
                short.append(k)
        for start in range(0, len(short), 1 << 15):
            some = short[start : start + (1 << 15)]
            ids, piece = self._together([pieces[k] for k in some])
            ends = np.searchsorted(piece, np.arange(len(some) + 1))
            for place, k in enumerate(some):
                out[k] = ids[ends[place] : ends[place + 1]]
        return out

    def texts(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each different piece of a step; those of short ones are kept for the next steps, up to ``KNOWN`` and a step's."""
        fresh = [p for p in pieces if p not in self.known]
        if len(self.known) + len(fresh) > KNOWN:
            self.known.clear()
            fresh = pieces
        made = dict(zip(fresh, (e.astype(np.int32) for e in self.encode([p.encode("utf-8", "surrogatepass") for p in fresh])), strict=True))
        out = [made[p] if p in made else self.known[p] for p in pieces]
        self.known.update((p, ids) for p, ids in made.items() if len(p) <= LONG)
        return out

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pieces behind each other, and the piece of each."""
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        done_ids, done_piece = [], []
        rank = self._beside(ids, piece)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(ids)])
            lowest = np.repeat(least, size)
            ended = lowest == _NONE
            if ended.any():
                done_ids.append(ids[ended])
                done_piece.append(piece[ended])
                ids, piece, rank, lowest = ids[~ended], piece[~ended], rank[~ended], lowest[~ended]
                continue
            hit = np.flatnonzero(rank == lowest)
            hit = hit[np.r_[True, piece[hit][1:] != piece[hit][:-1]]]
            ids[hit] = rank[hit]
            left = np.ones(len(ids), np.bool_)
            left[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged ones are when their right halves have gone
            ids, piece, rank = ids[left], piece[left], rank[left]
            for k in (at, at[(at > 0)] - 1):
                k = k[k + 1 < len(ids)] if len(ids) else k[:0]
                same = piece[k] == piece[k + 1]
                rank[k] = np.where(same, self.of(ids[k], ids[k + 1]), _NONE)
            rank[-1:] = _NONE
        flat, which = np.concatenate([np.zeros(0, np.int64), *done_ids]), np.concatenate([np.zeros(0, np.int64), *done_piece])
        order = np.argsort(which, kind="stable")
        return flat[order], which[order]

    def _beside(self, ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
        rank = np.full(len(ids), _NONE)
        rank[:-1] = np.where(piece[1:] == piece[:-1], self.of(ids[:-1], ids[1:]), _NONE)
        return rank

    def _one(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece: a heap of pairs by rank and place."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, behind, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        first = self.of(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(k: int) -> None:
            if k >= 0 and behind[k] < n:
                pair = ids[k], ids[behind[k]]
                if pair not in known:
                    known[pair] = int(self.of(np.array([pair[0]]), np.array([pair[1]]))[0])
                if known[pair] != _NONE:
                    heapq.heappush(heap, (known[pair], k, *pair))

        while heap:
            rank, k, left, right = heapq.heappop(heap)
            other = behind[k]
            if not live[k] or other >= n or ids[k] != left or ids[other] != right:
                continue
            ids[k], live[other], behind[k] = rank, False, behind[other]
            if behind[k] < n:
                before[behind[k]] = k
            push(k)
            push(before[k])
        return np.array([x for x, there in zip(ids, live, strict=True) if there], np.int64)


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines of a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pieces(text: Column, pattern: str) -> Column:
    r"""The pieces of a text, none left out: ``\s`` is Unicode's white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U)(?s:{pattern}|.)"), F.lit(0))


def _steps(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a list column that hold about ``PIECES`` values each, or one row of more."""
    ends = column.offsets.to_numpy()
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + PIECES, side="right")) - 1)
        yield start, end
        start = end


def _ids(merges: Merges, column: pa.Array) -> pa.Array:
    """The ids of every row's pieces behind each other; each different piece is merged once."""
    flat = column.flatten().dictionary_encode()
    each = merges.texts(flat.dictionary.to_pylist())
    which = flat.indices.to_numpy(zero_copy_only=False)
    sizes = np.array([len(e) for e in each], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    table = np.concatenate([np.zeros(0, np.int32), *each])
    taken = sizes[which] if len(which) else np.zeros(0, np.int64)
    ends = np.r_[0, np.cumsum(taken)]
    ids = table[np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[which], taken)] if len(which) else table[:0]
    bounds = column.offsets.to_numpy() - column.offsets.to_numpy()[0] if len(column) else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(ids))


def encoder(spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> Callable[[Column], Column]:
    """A function from a text column to its ids, an array of int: what filters and profiles take as ``tokens``."""
    ship(spark)
    shared = spark.sparkContext.broadcast(Merges(ranks))

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        made = [_ids(shared.value, column.slice(start, end - start)) for start, end in _steps(column)]
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *made])

    return lambda text: run(pieces(text, pattern))
