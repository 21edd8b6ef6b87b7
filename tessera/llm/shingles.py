"""Character shingles of many lines at once in numpy: hashes, MinHash bands, exact similarities.

A shingle is hashed over ``CHARS`` code points; a line that is no longer is its only
shingle. Lines are worked on in parts of about ``PART`` characters, so what is held is
bounded by that and the longest line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHARS = 9
BANDS = 10
ROWS = 3
#: Characters and lines of a part.
PART, MOST = 1 << 18, 1 << 14
#: Bits of a hash that order a line's shingles, and shingles up to which a cell's pairs are counted one by one.
_BITS = 44
_FEW = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2, _BASE4 = (np.uint64(pow(int(_BASE), k, 1 << 64)) for k in (2, 4))
_PAD = np.uint64(0xD6E8FEB86659FD93)
_ONE, _TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
TURNS = (np.arange(BANDS, dtype=np.uint64) * np.uint64((1 << 64) // BANDS) + np.uint64(12345)) >> np.uint64(64 - _BITS)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no order."""
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


def parts(sizes: list[int]) -> Iterator[slice]:
    """Slices of lines of about ``PART`` characters each."""
    start = count = 0
    for k, size in enumerate(sizes):
        if k > start and (count + size > PART or k - start >= MOST):
            yield slice(start, k)
            start, count = k, 0
        count += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the shingle at every position, line behind line, and how many each line has; lines aren't empty."""
    have = np.fromiter(map(len, lines), np.int64, len(lines))
    short = np.flatnonzero(have < CHARS)
    if len(short):
        lines = list(lines)
        for k in short:
            lines[k] = lines[k].ljust(CHARS)
    size = np.maximum(have, CHARS)
    ends = np.cumsum(size)
    code = mixed(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + _BASE)
    for k in range(CHARS - 1):
        code[(ends[short] - 1 - k)[have[short] < CHARS - k]] = _PAD
    two = code[:-1] * _BASE + code[1:]
    four = two[:-2] * _BASE2 + two[2:]
    eight = four[:-4] * _BASE4 + four[4:]
    nine = mixed(eight[:-1] * _BASE + code[8:])
    good = np.ones(len(nine), np.bool_)
    over = (ends[:-1, None] - np.arange(1, CHARS)[None]).ravel()
    good[over] = False
    return nine[good], size - (CHARS - 1)


def bands(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different band keys of every line, line behind line, and how many each has.

    The shingles' hashes stand in order on a circle, each once; a band is the ``ROWS``
    next behind one of ``BANDS`` turns, or all of them in a line of fewer.
    """
    hashed, n = hashes(lines)
    line = np.arange(len(lines), dtype=np.uint64) << np.uint64(_BITS)
    keys = np.repeat(line, n) | (hashed >> np.uint64(64 - _BITS))
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    first = np.searchsorted(keys, line)
    size = np.diff(np.r_[first, len(keys)])
    place = np.searchsorted(keys, (line[:, None] | TURNS[None]).ravel()).reshape(-1, BANDS) - first[:, None]
    place[size < ROWS] = 0
    low = keys & np.uint64((1 << _BITS) - 1)
    made = np.zeros(place.shape, np.uint64)
    for r in range(ROWS):
        part = low[first[:, None] + (place + r) % size[:, None]]
        made = mixed(made + np.where(size[:, None] > r, part, 0).astype(np.uint64) + _BASE)
    made.sort(axis=1)
    good = np.hstack([np.ones((len(made), 1), np.bool_), made[:, 1:] != made[:, :-1]])
    return made[good], good.sum(1)


def sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of every line's shingles, line behind line, and how many each has."""
    found, sizes = [], []
    for at in parts([len(x) for x in lines]):
        hashed, n = hashes(lines[at])
        line = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        salted = mixed(hashed + line * _ONE)  # a number of the line and the shingle: equal ones are repeats
        order = np.argsort(salted)
        first = np.sort(order[np.r_[True, salted[order[1:]] != salted[order[:-1]]]])
        found.append(hashed[first])
        sizes.append(np.bincount(line[first].astype(np.int64), minlength=len(n)))
    return np.concatenate(found), np.concatenate(sizes)


def _pairs(runs: np.ndarray, sizes: np.ndarray, member: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``a * rows + b`` of the pairs of members that stand in a run together, and in how many they do."""
    codes = []
    for d in np.unique(sizes):
        block = np.sort(member[runs[sizes == d][:, None] + np.arange(d)[None]], axis=1)
        a, b = np.triu_indices(d, 1)
        codes.append((block[:, a] * rows + block[:, b]).ravel())
    return np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near(cell: np.ndarray, side: np.ndarray, line: np.ndarray, found: np.ndarray, sizes: np.ndarray, jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell whose lines' sets have this Jaccard similarity or more.

    ``cell`` ascends; row k stands for the set ``line[k]`` of ``found`` and ``sizes``. Rows
    of a cell meet if both have ``side`` 0, or 1 and 2. Shingles that few rows of a cell have
    are counted pair by pair, the others by a matrix product.
    """
    rows, starts = len(cell), np.r_[0, np.cumsum(sizes)]
    n = sizes[line]
    member = np.repeat(np.arange(rows), n)
    inside = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
    salted = mixed(found[np.repeat(starts[line], n) + inside] + cell[member].astype(np.uint64) * _TWO)
    order = np.argsort(salted)
    salted, member = salted[order], member[order]
    runs = np.flatnonzero(np.r_[True, salted[1:] != salted[:-1]])
    count = np.diff(np.r_[runs, len(salted)])
    few = (count > 1) & (count <= _FEW)
    codes, common = _pairs(runs[few], count[few], member, rows)
    a, b = codes // rows, codes % rows
    many = np.flatnonzero(count > _FEW)
    if len(many):
        of = cell[member[runs[many]]]
        for number in np.unique(of):
            low, high = np.searchsorted(cell, [number, number + 1])
            mine = many[of == number]
            total = np.zeros((high - low, high - low), np.float32)
            width = max(1, (1 << 20) // (high - low))
            for at in range(0, len(mine), width):
                part = mine[at : at + width]
                marks = np.zeros((high - low, len(part)), np.float32)
                column = np.repeat(np.arange(len(part), dtype=np.int32), count[part])
                step = np.arange(len(column)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
                marks[member[np.repeat(runs[part], count[part]) + step] - low, column] = 1
                total += marks @ marks.T
            here = (a >= low) & (a < high)
            np.add.at(total, (a[here] - low, b[here] - low), common[here].astype(np.float32))
            own = n[low:high]
            total[total < jaccard / (1 + jaccard) * (own[:, None] + own[None]) - 0.5] = 0  # can't be similar enough
            x, y = np.nonzero(np.triu(total, 1))
            a, b, common = np.r_[a[~here], x + low], np.r_[b[~here], y + low], np.r_[common[~here], total[x, y].astype(np.int64)]
    met = np.where(side[a] == 0, side[b] == 0, side[a] + side[b] == 3)
    good = met & (common >= jaccard * (n[a] + n[b] - common))
    return a[good], b[good]
