"""Line deduplication against brute force over all shingles of every pair of lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lines, shingles


def grams(line):
    return {line[k : k + 9] for k in range(max(1, len(line) - 8))}


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def brute(texts):
    """How many of different lines stay."""
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                up[find(a)] = find(b)
    return len({find(k) for k in range(len(texts))})


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in lines.dedup_lines(docs).where("__kept > 0").collect()}


def test_every_position_counts(spark):
    rng = np.random.default_rng(5)
    chinese = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 49)))
    different = ["2024-01-15T10:30:00", "2024-01-16T10:30:00", "user_id=10045", "user_id=12345", "andththwhes.", "andththwhwh."]
    long = "y" * 200 + text(rng, 100_000)
    assert kept(spark, [*different, chinese, "x" + chinese, long, "z" + long]) == {*range(7), 8}
    wide = ["a𝄞ü€b", "𝄞" * 12 + "ab", "Grüße aus Köln", "short", "short   ", "x" * 50]
    assert shingles.sets(wide)[1].tolist() == [len(grams(x)) for x in wide]
    assert len(set(shingles.sets(["short", "short ", "short\0", "shorts"])[0].tolist())) == 4


def edited(rng, line, n):
    """``line`` with ``n`` of its words replaced."""
    words = line.split(" ")
    for k in rng.choice(len(words), n, replace=False):
        words[k] = "".join(rng.choice(list("qxyzjkvw"), 5))
    return " ".join(words)


def text(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


@pytest.mark.parametrize("blocks", [(1 << 19, 1024), (4000, 1024), (1 << 19, 16)])
def test_lines_around_a_template(spark, monkeypatch, blocks):
    """One hot band: a template, lines near it, and lines that are near no other."""
    monkeypatch.setattr(lines, "BLOCK", blocks[0])
    monkeypatch.setattr(lines, "LINES", blocks[1])
    rng = np.random.default_rng(7)
    base = text(rng, 52)
    around = [edited(rng, base, 2) for _ in range(120)]
    found = [*around, *[edited(rng, x, 2) for x in around[:60]]]
    assert len(kept(spark, found)) == brute(found) < 140


def test_chains(spark):
    rng = np.random.default_rng(8)
    found = []
    for _ in range(80):
        middle = text(rng, 23)
        found += [edited(rng, middle, 1), middle, edited(rng, middle, 1)]
    assert len(kept(spark, found)) == brute(found)


def shared(pairs):
    """How many pairs of lines share a band."""
    flat, sizes = shingles.bands([x for pair in pairs for x in pair])
    each = np.split(flat, np.cumsum(sizes)[:-1])
    return sum(bool(set(a.tolist()) & set(b.tolist())) for a, b in zip(each[::2], each[1::2], strict=True))


def test_bands_of_repeats(spark):
    """Sets decide, however often a shingle stands in a line."""
    rng = np.random.default_rng(10)
    pairs = []
    for _ in range(300):
        few = text(rng, 3)[: rng.integers(1, 14)]
        a, b = sorted(rng.integers(12, 60, 2))
        pairs.append(((few * 60)[: len(few) * a], (few * 60)[: len(few) * b]))
    assert shared(pairs) == len(pairs)
    assert kept(spark, ["ab" * 30, "ab" * 200, "xyz" * 10, "abc" * 100]) == {0, 2, 3}


@pytest.mark.parametrize("size", [12, 20, 40, 120, 400])
def test_recall(size):
    """Pairs at a Jaccard similarity of 0.8 to 0.85, by the length of the lines."""
    rng = np.random.default_rng(size)
    pairs = []
    while len(pairs) < 1000:
        line = "x" + "".join(rng.choice(list("abcdefghij "), size + 30)) + "y"
        other = list(line)
        for k in rng.choice(len(line), rng.integers(0, size // 60 + 1), replace=False):
            other[k] = "z"
        other = "".join(other)[rng.integers(0, 12) :]
        if 0.8 <= jaccard(line, other) <= 0.85:
            pairs.append((line, other))
    assert shared(pairs) >= 0.99 * len(pairs)


def test_near_pairs():
    """Both ways of counting, against sets."""
    rng = np.random.default_rng(4)
    base = [text(rng, 30) for _ in range(4)]
    found = [edited(rng, base[k % 4], rng.integers(0, 4)) for k in range(150)] + ["ab", "ab", "aB"]
    flat, sizes = shingles.sets(found)
    cell = np.sort(rng.integers(0, 3, len(found)))
    side = np.where(cell == 2, rng.integers(1, 3, len(found)), 0)
    a, b = shingles.near(cell, side, np.arange(len(found)), flat, sizes, 0.8)
    want = {(x, y) for x in range(len(found)) for y in range(x + 1, len(found)) if cell[x] == cell[y] and (cell[x] < 2 or side[x] != side[y]) and jaccard(found[x], found[y]) >= 0.8}
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == want and len(want) > 100


def test_numbers_that_clash(spark, monkeypatch):
    """Different lines whose first hash agrees stay different lines."""
    written = lines.written

    def clashing(df, label, **options):
        return written(df.withColumn("line_id", F.lit(7).cast("bigint")) if label == "signatures" and "number" not in df.columns and "second" in df.columns and not clashing.done else df, label, **options)

    def once(df, label, **options):
        out = clashing(df, label, **options)
        clashing.done |= label == "signatures"
        return out

    clashing.done = False
    monkeypatch.setattr(lines, "written", once)
    assert kept(spark, ["first line of text here", "another line of text", "third thing altogether", "first line of text here"]) == {0, 1, 2}


def test_columns_that_clash(spark):
    df = spark.createDataFrame([("a", "x\ny", 1, 2), ("b", "x\nz", 3, 4)], "`doc.id` string, `te.xt` string, __lines int, __kept int")
    out = lines.dedup_lines(df, "te.xt", "doc.id")
    assert out.columns == ["doc.id", "te.xt", "__lines", "__kept", "___lines", "___kept"]
    assert [tuple(r) for r in out.orderBy("`doc.id`").collect()] == [("a", "x\ny", 1, 2, 2, 2), ("b", "z", 3, 4, 2, 1)]


def test_no_python(spark):
    """Signatures and similarities are DataFrame functions."""
    docs = spark.createDataFrame([(1, "one line\nanother")], "doc_id long, text string")
    cells = spark.createDataFrame([(1, 0, 0, 0, 5, "one line", [1])], "band long, i int, j int, side int, line_id long, line string, bands array<long>")
    for made in (lines.signatures(docs, "text", "doc_id"), lines.similar(cells, 0.8)):
        plan = made._jdf.queryExecution().toString()
        assert "Exchange" in plan and "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


def test_cells_are_dealt_once(spark):
    """Shingle sets of a cell's lines are made where the cell is and never shuffled."""
    members = spark.createDataFrame([(1, 5)], "band long, line_id long")
    texts = spark.createDataFrame([(5, "one line", 8)], "line_id long, line string, chars int")
    asked = spark.createDataFrame([(5, [1])], "line_id long, bands array<long>")
    plan = lines.similar(lines._cells(members, texts, asked), 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(hashes" in plan
    assert "Exchange" not in plan.partition("REPARTITION_BY_NUM")[0].rpartition("Exchange")[0]


def test_recall_of_columns(spark):
    """Of pairs at a Jaccard similarity of 0.8 to 0.85, those that share a band."""
    rng = np.random.default_rng(11)
    found = []
    for size in (12, 40, 120):
        while len(found) % 1200 < 1198 or not found:
            line = "x" + "".join(rng.choice(list("abcdefghij "), size + 30)) + "y"
            other = list(line)
            for k in rng.choice(len(line), rng.integers(0, size // 60 + 1), replace=False):
                other[k] = "z"
            other = "".join(other)[rng.integers(0, 12) :]
            if 0.8 <= jaccard(line, other) <= 0.85:
                found += [line, other]
        found += ["a", "b"]  # no pair, fill the size up
    rows = spark.createDataFrame(list(enumerate(found)), "line_id long, line string")
    bands = {r.line_id: set(r.bands) for r in lines.banded(rows, ["line_id"]).collect()}
    pairs = [k for k in range(0, len(found), 2) if found[k] != "a"]
    assert len(pairs) == 1797 and sum(bool(bands[k] & bands[k + 1]) for k in pairs) >= 0.99 * len(pairs)
