"""Literal cases and invariants of the core operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as T
from tessera.operators import advantage as V
from tessera.operators import balance as B
from tessera.operators import external as E
from tessera.operators import filters as L
from tessera.operators import metrics as S
from tessera.operators import relational as R
from tessera.operators import rewards as W
from tessera.operators import stats
from tessera.sources import writers


def values(df, column):
    return [r[column] for r in df.collect()]


def test_repetition_thresholds(spark):
    rows = [(0, ["a"] * 2), (1, ["a", "b"] * 4), (2, ["a", "b"] * 5), (3, [])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    assert values(df.select(L.max_repeats(F.col("t"), 3).alias("n")).orderBy("n"), "n") == [0, 0, 3, 4]


def test_geometry_edges(spark):
    cases = {(31, 100): True, (32, 32): False, (5000, 4000): True, (6000, 500): True, (480, 32): True, (479, 32): False, (0, 5): True, (None, 5): True}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "w int, h int, bad boolean")
    assert df.where(L.bad_geometry(F.col("w"), F.col("h")) != F.col("bad")).count() == 0


def test_choice_cases(spark):
    cases = [("0", "0", 1), ("The answer is 1", "1", 1), ("I choose option 2", "2", 1), ("2", "0", 0), ("I don't know", "1", 0), ("", "2", 0)]
    df = spark.createDataFrame(cases, "response string, ground_truth string, want int")
    out = W.scored(df, "choice").where(F.col("reward.overall") != F.col("want"))
    assert out.count() == 0
    with pytest.raises(ValueError):
        W.scored(df, "unknown")


def test_sequences(spark):
    df = spark.createDataFrame([([0, 0, 2, 4, 3, 5, 1, 0, 0], [1, 1, 0, 1])], "ids array<int>, m array<int>")
    row = df.select(A.response_mask(F.col("ids"), 1).alias("rm"), A.position_ids(F.col("m")).alias("p"), A.suffix_sums(F.array(*map(F.lit, (1.0, 2.0, 4.0))), F.array(*map(F.lit, (1, 0, 1))), 0.5).alias("s")).first()
    assert row.rm == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    assert row.p == [0, 1, 1, 2]
    assert row.s == [1.0, 4.0, 4.0]


def test_group_advantages(spark):
    rows = [(k, g, float(s), [1, 1]) for k, (g, s) in enumerate([(0, 1), (0, 3), (1, 2), (1, 2), (2, 5), (None, 1), (None, 4)])]
    df = spark.createDataFrame(rows, "row_idx int, uid int, score double, mask array<int>")
    grpo = {r.row_idx: r.advantage for r in V.compute("grpo", df).collect()}
    assert abs(grpo[0] + grpo[1]) < 1e-9 and grpo[2] == 0 and grpo[4] is None and len(grpo) == 7
    best = {r.row_idx: r.advantage for r in V.compute("grpo_passk", df).collect()}
    assert best[0] == 0 and best[1] > 1 and best[2] == 0
    with pytest.raises(ValueError):
        V.compute("none", df)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=4, max_size=60), st.integers(1, 4))
def test_balanced_sets(lengths, k):
    sets = B.differenced(lengths, k)
    assert sorted(i for s in sets for i in s) == list(range(len(lengths)))
    assert B.restored([lengths[i] for s in sets for i in s], sets) == lengths
    assert sorted(i for s in B.micro_batches(lengths, 600) for i in s) == list(range(len(lengths)))
    assert sorted(i for s in B.greedy(lengths, k) for i in s) == list(range(len(lengths)))
    with pytest.raises(ValueError):
        B.differenced(lengths[:2], 3)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \\{", max_size=20))
def test_edit_distance(text):
    assert S.extended_edit_distance(text, text) <= S.extended_edit_distance(text + "zz", text) + 1e-9
    assert S.extended_edit_distance(text[::-1] + " a", text) == pytest.approx(slow_distance(text[::-1] + " a", text), abs=1e-9)


def slow_distance(hyp, ref):
    """The recurrence place by place, with exact costs."""
    from fractions import Fraction

    if not ref:
        return 0.0 if not hyp else 1.0
    row = [Fraction(0)] + [Fraction(1)] * len(hyp)
    visits = [-1] * len(row)
    for c in ref:
        fresh = [row[0] + 1]
        for i, h in enumerate(hyp, 1):
            fresh.append(min(fresh[i - 1] + Fraction(1, 5), row[i - 1] + (h != c), row[i] + 1))
        least = min(fresh)
        visits[fresh.index(least)] += 1
        row = [min(x, least + 2) for x in fresh] if c == " " else fresh
    coverage = Fraction(3, 10) * sum(v if v >= 0 else 1 for v in visits)
    return float(min(1, (row[-1] + coverage) / (len(ref) + coverage)))


def test_image_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    a = np.full((40, 30, 3), 255, np.uint8)
    a[5:32, 6:24] = rng.integers(0, 200, (27, 18, 3))
    shifted = np.roll(a, 3, axis=1)
    assert S.structural_similarity(a, a) == pytest.approx(1)
    assert S.structural_similarity(a, shifted) == pytest.approx(1)
    b = a.copy()
    b[10:20, 10:20] = 255 - b[10:20, 10:20]
    b = np.pad(b[4:], ((0, 9), (0, 0), (0, 0)), constant_values=7)
    for align in ("pad", "crop"):
        assert S.structural_similarity(a, b, align) == pytest.approx(slow_similarity(a, b, align), abs=1e-9)
    with pytest.raises(ValueError):
        S.structural_similarity(a, b, "stretch")
    assert S.trimmed(a).shape == (31, 22, 3) and S.trimmed(a[:3]).shape == (3, 30, 3)
    wide = rng.integers(0, 256, (50, 3000, 3), np.uint8)
    assert S.downscaled(wide, 1024).shape == (17, 1024, 3) and S.downscaled(wide, 0).shape == wide.shape
    flat = np.full((40, 2000, 3), 77, np.uint8)
    assert (S.downscaled(flat, 500) == 77).all()


def slow_similarity(a, b, align):
    """Window by window, as the definition says."""
    import numpy as np

    a, b = S.trimmed(a), S.trimmed(b)
    pick = max if align == "pad" else min
    height, width = pick(a.shape[0], b.shape[0]), pick(a.shape[1], b.shape[1])
    images = []
    for x in (a, b):
        y = np.full((height, width, 3), 255.0)
        for row in range(height):
            for column in range(width):
                r, c = row, column
                r += (x.shape[0] - height) // 2 if x.shape[0] > height else -((height - x.shape[0]) // 2)
                c += (x.shape[1] - width) // 2 if x.shape[1] > width else -((width - x.shape[1]) // 2)
                if 0 <= r < x.shape[0] and 0 <= c < x.shape[1]:
                    y[row, column] = x[r, c]
        images.append(y / 255)
    weight = np.array([np.exp(-((k - 5) ** 2) / 4.5) for k in range(11)])
    weight = np.outer(weight, weight) / weight.sum() ** 2
    out = []
    for channel in range(3):
        for row in range(height - 10):
            for column in range(width - 10):
                x, y = (i[row : row + 11, column : column + 11, channel] for i in images)
                mx, my = (x * weight).sum(), (y * weight).sum()
                vx, vy, c = (x * x * weight).sum() - mx * mx, (y * y * weight).sum() - my * my, (x * y * weight).sum() - mx * my
                out.append((2 * mx * my + 1e-4) * (2 * c + 9e-4) / ((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4)))
    return float(np.mean(out))


def test_resume_and_scatter(spark):
    todo = spark.createDataFrame([(1,), (1,), (2,), (3,)], "id int")
    done = spark.createDataFrame([(2, "ok"), (3, "failed")], "id int, status string")
    assert sorted(values(R.remaining(todo, done), "id")) == [1]
    assert sorted(values(R.remaining(todo, done, retry="status <> 'ok'"), "id")) == [1, 3]
    with pytest.raises(KeyError):
        R.required(todo, "absent")
    with pytest.raises(ValueError):
        R.from_columns(spark, {"a": [1], "b": [1, 2]})


def test_row_numbers_and_chunks(spark):
    df = L.row_numbers(spark.range(97).withColumn("k", F.md5(F.col("id").cast("string").cast("binary"))), "k")
    assert sorted(values(df, "row_idx")) == list(range(97))
    assert R.unpadded(R.padded(df, 10)).count() == 97 and R.padded(df, 10).count() == 100
    with pytest.raises(ValueError):
        R.chunked(df, 10)


def slow_bleu(hyp, ref, trivial, kinds=False):
    """Matched n-grams by counters."""
    from collections import Counter
    from math import exp, log

    grams = lambda t, n: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
    logs = []
    for n in range(1, 5):
        h, r = ({g: c for g, c in grams(t, n).items() if g not in trivial} for t in (hyp, ref))
        matched = sum(min(c, r.get(g, 0)) for g, c in h.items())
        if not matched:
            return 0.0
        logs.append(log(matched / (len(h) if kinds else sum(h.values()))))
    return min(1.0, exp(1 - len(ref) / len(hyp))) * exp(sum(logs) / 4)


def test_bleu_counts(spark):
    import random

    rng = random.Random(3)
    pairs = [(k, [rng.choice("abc") for _ in range(rng.randint(0, 40))]) for k in range(60)]
    pairs = [(k, h, [x if rng.random() < 0.8 else "d" for x in h] + ["a"] * rng.randint(0, 3)) for k, h in pairs]
    df = spark.createDataFrame(pairs, "id int, hyp array<string>, ref array<string>")
    trivial = spark.createDataFrame([(1, "a"), (2, "a\x1fb"), (4, "a\x1fb\x1fc\x1fa")], "n int, gram string")
    skip = {("a",), ("a", "b"), ("a", "b", "c", "a")}
    got = {r.id: r.bleu for r in S.crystal_bleu(df, "id", "hyp", "ref", trivial).collect()}
    plain = {r.id: r.bleu for r in S.fallback_bleu(df, "id", "hyp", "ref").collect()}
    clipped = {r.id: r.bleu for r in S.fallback_bleu(df, "id", "hyp", "ref", clip=True).collect()}
    for k, h, r in pairs:
        assert got[k] == pytest.approx(slow_bleu(h, r, skip) if h and r else 0.0, abs=1e-9)
        assert plain[k] == pytest.approx(slow_bleu(h, r, (), True) if h and r else 0.0, abs=1e-9)
        assert clipped[k] == pytest.approx(min(1.0, plain[k]))


def test_trivial_ngrams_with_ties(spark):
    from collections import Counter

    texts = ["a b a b c", "c a b", "x y", "a b c d e f g", ""] * 3 + ["tie tie"]
    counted = Counter()
    for t in texts:
        w = t.split()
        counted.update((n, "\x1f".join(w[k : k + n])) for n in range(1, 5) for k in range(len(w) - n + 1))
    want = sorted(((c, n, g) for (n, g), c in counted.items()), key=lambda x: (-x[0], x[1], x[2]))
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("t", F.filter(F.split("t", " "), lambda x: x != ""))
    for k in (1, 4, 7, 1000):
        assert [(r["count"], r.n, r.gram) for r in stats.trivial_ngrams(df, F.col("t"), k).collect()] == want[:k]
    assert stats.trivial_ngrams(df.where("false"), F.col("t"), 5).count() == 0


def test_trivial_ngrams_of_crowded_classes(spark, monkeypatch):
    """Few classes, so that rare n-grams make the k-th class look common: all n-grams as common as the k-th are still found."""
    from collections import Counter

    monkeypatch.setattr(stats, "_CLASSES", 64)
    texts = [" ".join(f"w{k * 31 + j}" for j in range(40)) for k in range(40)] + ["b b a"] * 3 + ["c", "d"] * 2
    counted = Counter()
    for t in texts:
        w = t.split()
        counted.update((n, "\x1f".join(w[k : k + n])) for n in range(1, 5) for k in range(len(w) - n + 1))
    want = sorted(((c, n, g) for (n, g), c in counted.items()), key=lambda x: (-x[0], x[1], x[2]))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for k in (2, 5, 60):
        assert [(r["count"], r.n, r.gram) for r in stats.trivial_ngrams(df, F.split("t", " "), k).collect()] == want[:k]


def test_bleu_stays_in_the_row(spark):
    """Counts by a loop, nulls and repeats included; no pair leaves its row."""
    import random
    from collections import Counter

    chance = random.Random(5)
    some = lambda: chance.choice([None, [], [chance.choice("aabc") for _ in range(chance.randrange(30))]])
    data = [(k, some(), some()) for k in range(300)]
    trivial = {(1, "a"), (2, "a\x1fb"), (3, "a\x1fa\x1fa")}
    df = spark.createDataFrame(data, "id int, hyp array<string>, ref array<string>")
    got = {(r.id, r.n): (r.matched, r.total, r.kinds) for r in S.bleu_counts(df, "id", "hyp", "ref", spark.createDataFrame(sorted(trivial), "n int, gram string")).collect()}
    for key, hyp, ref in data:
        for n in range(1, 5):
            h, r = (Counter(g for k in range(len(x or []) - n + 1) if (n, g := "\x1f".join(x[k : k + n])) not in trivial) for x in (hyp, ref))
            assert got[key, n] == ((h & r).total(), h.total(), len(h))
    for found in (S.crystal_bleu(df, "id", "hyp", "ref"), S.fallback_bleu(df, "id", "hyp", "ref")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_trigram_share(spark):
    """As sets of characters say, beyond the basic plane too, and as the column functions."""
    texts = ["", "ab", "aB c", "abcabcabc", "\U0001f600x\U0001f600x\n\U0001f600", "xyz " * 900, "ab" + "\u00e9" * 9, None]
    pairs = [(k * 8 + j, a, b) for k, a in enumerate(texts) for j, b in enumerate(texts)]
    df = spark.createDataFrame(pairs, "id int, a string, b string")
    said = df.select("id", T.text_similarity(F.col("a"), F.col("b"), S.trigram_share(spark)).alias("x"), T.text_similarity(F.col("a"), F.col("b")).alias("y"))
    got = {r.id: (r.x, r.y) for r in said.collect()}
    for key, a, b in pairs:
        x, y = ({t[k : k + 3] for k in range(len(t) - 2)} for t in ((s or "").lower().replace(" ", "").replace("\n", "") for s in (a, b)))
        assert got[key] == (len(x & y) / len(x | y) if x and y else 0.0,) * 2


def test_rendered_in_slices(spark):
    """A batch is handed on in parts, none of its rows missing."""
    import pandas as pd

    from tessera.operators import external as E

    assert [len(x) for x in E.slices(pd.DataFrame({"id": range(600)}))] == [256, 256, 88]
    code = F.when(F.col("id") % 3 > 0, F.concat(F.lit("\\begin{document}"), F.col("id"), F.lit("\\end{document}")))
    got = {r.id: r for r in E.rendered(spark.range(600).coalesce(1).withColumn("code", code), E.StubRenderer()).collect()}
    assert sorted(got) == list(range(600)) and all((r.image is None) == (k % 3 == 0) == (r.error is not None) for k, r in got.items())


def test_largest_differencing_ties():
    """Written out: two candidates at a time, the widest spread first, of equal ones the greater first set."""

    def slow(lengths, k, equal):
        order = sorted((n, i) for i, n in enumerate(lengths))
        groups = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[x] for x in order]
        states = [sorted([(n, 1, [(i, n)]) for n, i in g] + [(0, 0, [])] * (k - len(g)), reverse=True) for g in groups]
        while len(states) > 1:
            states.sort(key=lambda s: (s[0][0] - s[-1][0], s[0]))
            a, b = states.pop(), states.pop()
            states.append(sorted([(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a, b[::-1], strict=True)], reverse=True))
        return [sorted(i for i, _ in s[2]) for s in states[0]]

    import random

    rng = random.Random(5)
    for _ in range(200):
        k = rng.randint(1, 5)
        lengths = [rng.randint(1, 6) for _ in range(k * rng.randint(1, 8))]
        for equal in (False, True):
            assert B.differenced(lengths, k, equal) == slow(lengths, k, equal)
    with pytest.raises(ValueError):
        B.micro_batches([5, 50], 20)


def test_greedy_equal():
    sets = B.greedy([3, 1, 1, 9, 2, 2], 2, equal=True)
    assert [len(s) for s in sets] == [3, 3] and sets[0][0] == 0 and sets[1][0] == 1
    with pytest.raises(AssertionError):
        B.greedy([1, 2, 3], 2, equal=True)


def test_boxed(spark):
    cases = {"\\boxed{1}": "1", "x \\boxed{\\frac{1}{2}} y": "\\frac{1}{2}", "\\boxed{1} \\boxed{a{b}{c}} d}": "a{b}{c}", "\\boxed{open": "None", "none": "None", "\\boxed{ 3 }": "3"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert df.where(T.boxed(F.col("t")) != F.col("want")).count() == 0


def test_long_lines(spark):
    """Whole lines of a hundred thousand characters pass the functions with repeated groups."""
    line = "ab\\%" * 30_000
    got = spark.createDataFrame([(line + "% note\nx",)], "t string").select(T.strip_comments(F.col("t")).alias("c"), T.normalize_answer(F.col("t")).alias("a"), F.size(T.char_grams(F.col("t"))).alias("n")).first()
    assert got.c == line + "\nx" and got.n < 50


def test_accumulated(spark):
    parts = [spark.createDataFrame([(k * 10 + i,) for i in range(10)], "id int") for k in range(4)]
    keep = lambda b: b.where("id % 2 = 0")
    assert values(L.accumulated(iter(parts), keep, 8, "id"), "id") == [0, 2, 4, 6, 8, 10, 12, 14]
    with pytest.raises(RuntimeError):
        L.accumulated(iter(parts), keep, 8, "id", most=1)
    with pytest.raises(RuntimeError):
        L.accumulated(iter(parts), lambda b: b.where("id < 0"), 1, "id")


def test_accumulated_of_sparse_batches(spark, tmp_path):
    """Batches that leave nothing, gaps of ids and too few rows: the query says what its SQL says."""
    from tessera.plans import curation
    from tests.compare import same

    rows = [(k * 250 + j, j if k % 9 else 7, 30.0 if j else 10.0) for k in range(60) for j in range(2)] + [(9_000_000 + j, 7, 10.0 + j * 20) for j in range(2)] + [(-300, 8, 30.0), (-260, 8, 1.0), (None, 8, 1.0)]
    name = "st4_accumulate_until_full"
    for number, some in enumerate((rows, rows * 5, rows[:0])):
        spark.createDataFrame(some, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/{number}/events.parquet")
        same(curation.QUERIES[name], curation.ORACLE[name], spark, f"{tmp_path}/{number}")


def test_options():
    from dataclasses import dataclass, field

    from tessera import options

    @dataclass
    class Inner:
        a: int = 1
        b: str = "x"

        def post_init(self):
            self.c = self.a * 2

    @dataclass
    class Outer:
        inner: Inner = field(default_factory=Inner)
        n: int = 0

        def post_init(self):
            self.n += self.inner.c

    got = options.merged(Outer(), {"inner": {"a": 5, "b": "file"}}, ["inner.b=line", "n=3"])
    assert (got.inner.a, got.inner.b, got.n) == (5, "line", 13)
    with pytest.raises(KeyError):
        options.merged(Outer(), {"absent": 1})


def test_waits_and_preflight():
    assert E.waits(7) == pytest.approx([2.0, 3.6, 6.48, 11.664, 20.0, 20.0])
    assert E.checked(["a", "b"], None, url="u") == "a" and E.checked(["a", "b"], "b") == "b"
    for models, model, needed in (([], None, {}), (["a"], "c", {}), (["a"], "a", {"key": ""})):
        with pytest.raises(ValueError):
            E.checked(models, model, **needed)
    assert E.errors_of("x\n! bad\nl.3 foo\ny") == "! bad\nl.3 foo" and E.errors_of("! " + "a" * 4000).endswith("\n...[log truncated]")
    made = E.Lazy(E.StubGenerator, "test")
    assert made.generate("x") == made.generate("x") and E.Lazy._made["test"] is made._own()


def test_once_with_nulls(spark):
    rows = [(1, None, "a"), (2, "a", None), (3, "a", "a"), (4, None, None), (5, None, "a"), (6, "", "a")]
    df = spark.createDataFrame(rows, "id int, x string, y string")
    seen = []

    def call(few):
        seen.append(few.count())
        return few.withColumn("told", F.concat_ws("/", F.coalesce("x", F.lit("null")), F.coalesce("y", F.lit("null"))))

    got = {r.id: r.told for r in E.once(df, ["x", "y"], call).collect()}
    assert seen == [5] and got == {k: f"{'null' if x is None else x}/{'null' if y is None else y}" for k, x, y in rows}


def test_executable(tmp_path, monkeypatch):
    program = tmp_path / "prog"
    program.write_text("")
    assert E.executable("absent-program", str(program)) is None
    program.chmod(0o755)
    monkeypatch.setenv("PROG", str(program))
    assert E.executable("absent-program", None, "PROG") == E.executable("absent-program", places=(str(program),)) == str(program)
    assert E.executable("absent-program") is None


def test_zipped_length(spark):
    a, b = spark.range(3).withColumnRenamed("id", "row_idx"), spark.range(2).withColumnRenamed("id", "row_idx")
    with pytest.raises(Exception, match="length"):
        R.zipped(a, b).collect()


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from tessera.sources import scratch

    context = SimpleNamespace(master="spark://x", getConf=lambda: {}, applicationId="a")
    with pytest.raises(RuntimeError):
        scratch.scratch_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_minibatches_resume(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    pick = lambda done: [tuple(r) for r in R.minibatches(df, 10, 3, 5, "k", L.row_numbers, done).select("epoch", "batch", "place", "k").orderBy("epoch", "place").collect()]
    every = pick(0)
    assert len(every) == 300 and len({(e, k) for e, _, _, k in every}) == 300
    assert pick(13) == every[130:] and pick(30) == []


def test_zipped_conflict(spark):
    a = spark.createDataFrame([(0, 1)], "row_idx int, x int")
    b = spark.createDataFrame([(0, 2)], "row_idx int, x int")
    with pytest.raises(Exception, match="differ"):
        R.zipped(a, b).collect()


def test_empty_profile(spark):
    row = stats.length_profile(spark.createDataFrame([], "n int"), "n").first()
    assert row["count"] == 0 and row.p99 == 0 and row["max"] == 0


def test_failed_calls_become_status(spark):
    class Broken:
        def generate(self, prompt):
            raise RuntimeError("down")

    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, prompt string")
    assert set(values(E.generated(df, Broken(), retries=2, wait=0), "error")) == {"api_error: down"}
    images = E.rendered(spark.createDataFrame([(1, None)], "id int, code string"), E.StubRenderer()).first()
    assert images.image is None and images.error


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.dictionaries(st.text("xyz", min_size=1, max_size=3), st.integers(), min_size=1), max_size=4))
def test_flatten_round_trip(nested):
    assert writers.unflattened(writers.flattened(nested)) == nested


def test_judge(spark):
    good = '{"correctness": 1, "layout_precision": 1, "readability": 1, "scientific_plausibility": 1, "visual_complexity": 1, "total_score": 5}'
    df = spark.createDataFrame([("text\n" + good,), (good.replace("5}", "6}"),), ("none",), (None,)], "a string")
    assert values(df.select(W.judged(F.col("a")).valid.alias("v")), "v") == [True, False, False, False]


def test_fences(spark):
    df = spark.createDataFrame([("```latex\nx\n```",), ("```latex\nx",), (None,), ("y",)], "t string")
    assert values(df.select(T.best_effort(F.col("t")).status.alias("s")), "s") == ["full_block", "open_block", "empty", "no_block"]
    assert values(df.select(T.one_block(F.col("t")).alias("s")), "s")[0] == "```latex\nx\n```"


def test_windows_of_different_sizes_hash_apart(spark):
    """Also where all elements are equal; windows of one size hash alike where their elements do."""
    from tessera.functions.arrays import window_hashes

    words = spark.createDataFrame([([7] * 12, [1, 2, 3, 1, 2, 3, 1])], "a array<bigint>, b array<bigint>")
    row = words.select(*[window_hashes(F.col("a"), n).alias(f"a{n}") for n in range(1, 14)], *[window_hashes(F.col("b"), n).alias(f"b{n}") for n in range(1, 8)]).first()
    assert [len(row[f"a{n}"]) for n in range(1, 14)] == [13 - n for n in range(1, 14)]
    assert len({h for n in range(1, 13) for h in row[f"a{n}"]}) == 12
    for n in range(1, 8):
        b = [1, 2, 3, 1, 2, 3, 1]
        windows = [tuple(b[k : k + n]) for k in range(8 - n)]
        assert len(set(zip(windows, row[f"b{n}"], strict=True))) == len(set(windows)) == len(set(row[f"b{n}"]))


def test_trivial_ngrams_of_repeated_words(spark):
    from tessera.operators.stats import trivial_ngrams

    rows = spark.createDataFrame([("the " * 9 + "a b c",), ("the the x " * 5,)], "t string")
    words = lambda t: t.split()
    counts = {}
    for t in ("the " * 9 + "a b c", "the the x " * 5):
        for n in range(1, 5):
            for k in range(len(words(t)) - n + 1):
                gram = "\x1f".join(words(t)[k : k + n])
                counts[n, gram] = counts.get((n, gram), 0) + 1
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    for k in (3, 6, 9):
        got = [((r.n, r.gram), r["count"]) for r in trivial_ngrams(rows, F.split(F.trim("t"), " "), k).collect()]
        assert sorted(got, key=lambda x: (-x[1], x[0])) == want[:k]


def test_tokens_of_media(spark):
    """Squares of 28 pixels: small images grow, large ones shrink, a missing size is too long."""
    from tessera.operators import filters

    sizes = [(28, 28, None), (56, 56, 4), (10, 10, 4), (42, 28, None), (100, 280, 40), (5000, 4000, None), (None, 5, None), (0, 5, None)]
    rows = spark.createDataFrame([(k, w, h) for k, (w, h, _) in enumerate(sizes)], "k int, w int, h int")
    got = {r.k: r.n for r in rows.select("k", filters.image_tokens(F.col("w"), F.col("h")).alias("n")).collect()}
    assert got[1] == 4 and got[2] == 4 and got[4] == 40 and got[6] is None and got[7] is None
    assert got[5] <= 12_845_056 // 784 and got[5] > 15_000 and got[0] >= 4
    text = spark.createDataFrame([(1, "a b", [(56, 56)], None), (2, "a b", [(56, 56)], [(56, 56, 4)]), (3, "a b", [(None, 5)], None), (4, None, None, None)], "k int, t string, i array<struct<width:int,height:int>>, v array<struct<width:int,height:int,frames:int>>")
    long = {r.k: r.l for r in text.select("k", filters.overlong(F.col("t"), 6, F.col("i"), F.col("v")).alias("l")).collect()}
    assert long == {1: False, 2: True, 3: True, 4: False}
