"""Answer equality by hand, edit distances together, JPEG walks, the ordered log."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import answers
from tessera.operators import metrics as M
from tessera.operators import rewards as W
from tessera.sources import ordered, readers
from tessera.sources.scratch import scratch_dir

SAME = [
    (r"\frac{1}{2}", "0.5"), (r"\frac12", "1/2"), (r"\dfrac{2}{4}", r"\tfrac12"), ("50\\%", "1/2"), ("50%", ".5"), ("1,000", "1000"), ("1{,}000{,}000", "10^6"), (r"1\,000", "1000"), ("x=5", "5"), ("5.0", "5"),
    (r"\sqrt{12}", r"2\sqrt{3}"), (r"\sqrt{\frac14}", "0.5"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt{2}}{2}"), (r"\sqrt2", r"\sqrt{2}"), (r"\sqrt[2]{9}", "3"), ("2^{10}", "1024"), ("4^{1/2}", "2"), ("2^{-1}", "1/2"), (r"2\cdot3", "6"), (r"2\times 3", "6"), (r"6\div 3", "2"),
    (r"\frac{3\pi}{2}", r"1.5\pi"), (r"2\pi r", r"r\cdot 2\pi"), ("2x+3", "3+2x"), ("(x+1)^2", "x^2+2x+1"), ("(x+1)(x-1)", "x^2-1"), ("x-x", "0"), ("-(-3)", "3"), ("--3", "3"), ("+3", "3"), (r"\frac{x}{x}", "1"), ("2xy", "2yx"),
    ("(1,2)", "( 1 , 2 )"), (r"(\frac12, 3)", "(0.5,3)"), (r"\left(1,2\right)", "(1,2)"), ("[0,1)", "[0, 1)"), ("1, 2", "1,2"), (r"\{1,2\}", r"\{2,1\}"), (r"x\in[0,1]", "[0,1]"), ("(1, (2, 3))", "(1,(2,3))"), (r"$5$", "5"), (r"\$5", "5"), ("5.", "5"),
    (r"90^\circ", "90"), (r"90^{\circ}", "90"), (r"5\text{ cm}", "5"), (r"5\text{ cm}^2", "5"), (r"5\mathrm{m}", "5"), (r"3\frac{1}{2}", "3.5"), (r"\frac{1}{1+\sqrt{2}}", r"\sqrt{2}-1"), (r"\sqrt{8}+\sqrt{2}", r"3\sqrt{2}"), (r"\frac{\sqrt3}{3}", r"\frac1{\sqrt3}"),
    ("0", "-0"), ("0.10", "1/10"), (r"\pi", r"\pi"), ("A", "A"), ("abc?!", "abc?!"), ("", None), (r"\frac{-1}{2}", r"-\frac{1}{2}"), (r"-\frac12", "-0.5"), ("3!", "3!"),
]
OTHER = [
    ("1/2", "1/3"), ("(1,2)", "(2,1)"), ("(1,2)", "[1,2]"), ("[0,1)", "[0,1]"), ("1,2", "(1,2)"), ("1,2,3", "1,2"), ("1000", "1,00"), ("x", "y"), ("x+1", "x-1"), ("1/0", "0"), ("0/0", "1"), (r"\sqrt{2}", "1.41421356"), (r"\sqrt{-1}", "1"), ("abc?!", "abd?!"), ("", "0"), (None, "0"),
    ("(1", "1"), ("{1", "1"), (r"\frac{1}", "1"), ("+", "-"), ("2^x", "2^y"), (r"\pi", "3.14"), ("5%", "5"), (r"\{1,2\}", "(1,2)"), (r"\{1,2\}", r"\{1,3\}"), ("9" * 5000, "8"), ("(" * 1500, ")"), ("2^{999999999}", "1"), ("0^0", "1"), ("12", "1,2"), ("x>=2", "2 "), ("yes", "no"),
    (r"\frac12", "12"), (r"\sqrt{4}", "-2"), ("3x", "3"), ("1.5", "1.50001"), ("[1,2]", "[1,2,3]"),
]


def test_equal_answers():
    assert len(SAME) + len(OTHER) >= 95
    for a, b in SAME:
        assert answers.equal(a, b) and answers.equal(b, a), (a, b)
    for a, b in OTHER:
        assert not answers.equal(a, b) and not answers.equal(b, a), (a, b)


def test_math_reward_reads_answers(spark):
    rows = [(f"so \\boxed{{{a}}}", b) for a, b in SAME[:20] + OTHER[:20]] + [("no box", "None"), ("\\boxed{1/2}", None), (None, "1")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows * 2)], "k int, response string, ground_truth string")
    out = W.scored(df, "math").select("k", "reward.accuracy").collect()
    assert len(out) == len(df.collect())
    got = {r.k: r.accuracy for r in out}
    assert all(got[k] == 1.0 for k in range(20)) and got[20] == 0.0 and sum(got[k] for k in range(20, 40)) <= 2


def test_distances_together():
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("ab \\d"), int(n)))
    pairs = [(word(a), word(b)) for a, b in rng.integers(0, 60, (400, 2))] + [("", ""), ("", "ab"), ("ab", ""), ("ü😀 x", "😀ü x"), (word(700), word(500)), (" a ", " a ")]
    got = M.extended_edit_distances(pairs)
    assert got == pytest.approx([M.extended_edit_distance(*p) for p in pairs], abs=1e-12)
    assert M.extended_edit_distances([]) == []


def test_long_jpeg_headers(spark):
    def jpeg(segments, frame=b"\xff\xc0\x00\x11\x08\x01\x02\x03\x04" + b"\x00" * 10):
        return b"\xff\xd8" + b"\xff\xe1\x00\x06abcd" * segments + frame + b"\xff\xda\x00\x02" + b"\x55" * 200_000

    cases = [(jpeg(3), (772, 258)), (jpeg(500), (772, 258)), (jpeg(64), (772, 258)), (jpeg(3, b""), (None, None)), (b"\xff\xd8", (None, None)), (b"\xff\xd8\xff\xe1\x00\x00" * 3, (None, None))]
    rows = spark.createDataFrame([(k, bytearray(c)) for k, (c, _) in enumerate(cases)], "k int, c binary").select("k", readers.image_size(F.col("c")).alias("s"))
    assert {r.k: tuple(r.s) for r in rows.collect()} == {k: s for k, (_, s) in enumerate(cases)}


def test_ordered_log(spark, monkeypatch):
    path = scratch_dir(spark)
    batch = lambda low, high: spark.range(low, high).select(F.col("id"), F.concat(F.lit("t\n"), F.col("id").cast("string")).alias("t"))
    said = lambda: [(r["_place"], r.id, r.t) for r in ordered.log(spark, path, "id long, t string").orderBy("_place").collect()]
    assert said() == []
    assert ordered.commit_batch(batch(0, 30).withColumn("back", -F.col("id")), path, 0, "back")
    want = [(k, 29 - k, f"t\n{29 - k}") for k in range(30)]
    assert said() == want
    real = ordered._commit
    monkeypatch.setattr(ordered, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        ordered.commit_batch(batch(30, 50), path, 1, "id")
    assert said() == want
    monkeypatch.setattr(ordered, "_commit", real)
    assert ordered.commit_batch(batch(30, 40), path, 1, "id") and not ordered.commit_batch(batch(30, 40), path, 1, "id")
    assert ordered.commit_batch(batch(0, 0), path, 2, "id") and ordered.commit_batch(batch(40, 45), path, 5, "id")
    assert said() == want + [(k, k, f"t\n{k}") for k in range(30, 45)]
    with pytest.raises(ValueError):
        ordered.commit_batch(batch(0, 1), path, 3, "id")


def test_followed_stream(spark):
    source, path, checkpoint = (scratch_dir(spark) for _ in range(3))
    seen = 0
    for size in (20, 15):
        spark.range(seen, seen + size).write.mode("append").parquet(source)
        seen += size
        for _ in range(2):
            ordered.follow(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source), path, checkpoint, "id").awaitTermination()
    rows = ordered.log(spark, path, "id long").orderBy("_place").collect()
    assert [r["_place"] for r in rows] == list(range(35)) and sorted(r.id for r in rows) == list(range(35))
