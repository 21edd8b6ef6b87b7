"""Selection, chained fingerprints, permutations and two-level balancing against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import balance as B
from tessera.operators import filters as L
from tessera.operators import permutation as N
from tessera.operators import stats as S
from tessera.sources.scratch import kept


def test_ranks(spark):
    rng = np.random.default_rng(1)
    columns = {
        "long": [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 500)] + [(1 << 63) - 1, (1 << 63) - 2, -(1 << 63), -(1 << 63) + 1] * 2,
        "int": [7] * 300 + [1, 2, 3],
        "double": [2.0**k for k in range(-1000, 1000, 3)] + [-(2.0**k) for k in range(-900, 900, 7)] + [0.0, 1.7e308, -1.7e308, 5e-324, float("inf"), float("-inf")] + [1.0, 1.0 + 2**-52] * 20,
    }
    for kind, values in columns.items():
        rows = kept(spark.createDataFrame([(v,) for v in values] + [(None,), *([(float("nan"),)] if kind == "double" else [])], f"x {kind}"))
        ranks = range(0, len(values), max(1, len(values) // 40))
        want = sorted(values)
        assert S.at_ranks(rows, "x", [*ranks, len(values) - 1, len(values), -1]) == {r: want[r] for r in [*ranks, len(values) - 1]}
    none = spark.createDataFrame([(None,)], "x int")
    assert S.at_ranks(none, "x", [0]) == {} and S.percentiles(none, "x", [0.5]) == {0.5: None}
    row = S.length_profile(none, "x").first()
    assert (row["count"], row["p50"], row["max"], row["mean"]) == (0, 0, 0, 0.0)


def test_percentiles_of_ten_million_values(spark):
    """All different; two rounds of counts of bins."""
    n = 10_000_000
    rows = kept(spark.range(n).select(((F.col("id") * 7_654_321) % n * 3).alias("x")))
    shares = [0.0, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = S.percentiles(rows, "x", shares)
    assert got == pytest.approx({s: 3 * s * (n - 1) for s in shares})


def test_ordered_fingerprint(spark):
    texts = ["a", "b", "", None, "a", "ü" * 1000] + [f"text {k}" for k in range(2500)]

    def sequential(texts):
        chain = 0
        for t in texts:
            h = int(hashlib.md5(("n" if t is None else "t" + t).encode()).hexdigest()[:15], 16)
            chain = (chain * S.CHAIN_BASE + h) % S.CHAIN_PRIME
        return len(texts), chain

    def spoken(texts, parts):
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(parts)
        return tuple(S.ordered_fingerprint(rows, "t", "k").first())

    assert spoken(texts, 1) == spoken(texts, 7) == sequential(texts)
    swapped = texts[:10] + [texts[11], texts[10]] + texts[12:]
    assert spoken(swapped, 3) == sequential(swapped) != sequential(texts)
    assert spoken(texts[:2000], 3) == sequential(texts[:2000]) and spoken(["x"], 1) == sequential(["x"])
    assert tuple(S.ordered_fingerprint(spark.createDataFrame([], "k int, t string"), "t", "k").first()) == (0, 0)


def test_permutations_are_bijections():
    for n in [*range(1, 1001), 65_536, 99_991]:
        x = np.arange(n)
        y = N.once(x, n, 3, 1)
        for _ in range(N.walks(n, 3, 1)):
            y = np.where(y >= n, N.once(y, n, 3, 1), y)
        assert np.array_equal(np.sort(y), x)
        assert np.array_equal(N.rows_at(y, n, 3, 1), x)
    orders = {tuple(N.rows_at(np.arange(50), 50, 1, e)) for e in range(5)}
    assert len(orders) == 5
    far = 10**12
    places = np.array([0, 1, 17, far - 1])
    assert len(set(N.rows_at(places, far, 9, 0).tolist())) == 4 and N.rows_at(places, far, 9, 0).max() < far
    spread = N.rows_at(np.arange(10_000), 1_000_000, 9, 0)
    assert abs(spread.mean() / 1_000_000 - 0.5) < 0.02 and abs(np.corrcoef(spread[:-1], spread[1:])[0, 1]) < 0.05


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 1000])
def test_place_in_the_row(spark, n):
    rows = spark.range(n).select("id", *[N.place_of(F.col("id"), n, 3, e).alias(f"p{e}") for e in range(3)]).toPandas()
    for e in range(3):
        assert np.array_equal(N.rows_at(rows[f"p{e}"].to_numpy(), n, 3, e), rows["id"].to_numpy())


def test_permuted_batches(spark):
    rows = L.row_numbers(spark.range(103).select((F.col("id") * 2).alias("key")), "key")
    every = N.permuted_batches(rows, 10, 3, 7)
    got = {(r.epoch, r.place): r.row_idx for r in every.collect()}
    assert sorted(got) == [(e, p) for e in range(3) for p in range(100)]
    for batch in (0, 9, 10, 25):
        assert [got[batch // 10, batch % 10 * 10 + k] for k in range(10)] == N.batch_rows(103, 10, 7, batch).tolist()
    left = {(r.epoch, r.place): r.row_idx for r in N.permuted_batches(rows, 10, 3, 7, done=12).collect()}
    assert left == {(e, p): v for (e, p), v in got.items() if e * 10 + p // 10 >= 12}
    assert N.permuted_batches(rows, 200, 3, 7).count() == 0 and N.permuted_batches(rows.where("false"), 10, 3, 7).count() == 0


def spreads(df, group):
    sums = df.groupBy(group, "part").agg(F.sum("n").alias("s"), F.count("*").alias("c"), F.max("n").alias("long"))
    return {r[0]: r for r in sums.groupBy(group).agg(F.count("*").alias("sets"), (F.max("s") - F.min("s")).alias("gap"), F.max("long").alias("long"), F.min("c").alias("least"), F.max("c").alias("most"), F.sum("c").alias("all")).collect()}


@pytest.mark.parametrize("equal", [False, True])
def test_two_levels(spark, equal):
    rows = spark.range(12_000).select(F.col("id").alias("row_idx"), F.when(F.col("id") < 8000, "hot").when(F.col("id") < 8016, "few").when(F.col("id") < 9600, "some").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(997)) * F.when(F.col("id") % 50 == 0, 9).otherwise(1)).alias("n"))
    got = spreads(B.balanced(rows, "n", 8, group="g", equal=equal, block=512), "g")
    assert {g: r["all"] for g, r in got.items()} == {"hot": 8000, "few": 16, "some": 1584, None: 2400}
    for r in got.values():
        assert r["sets"] == 8 and r["gap"] <= r["long"] and (not equal or r["least"] == r["most"])


def test_one_batch_of_any_size(spark):
    """Without a group: no cap, no task with all items, and for small batches the method itself."""
    rows = spark.range(150_000).select(F.col("id").alias("row_idx"), (F.pmod(F.xxhash64("id"), F.lit(5000)) + 1).alias("n"), F.lit(0).alias("g"))
    done = kept(B.balanced(rows, "n", 4, equal=True, block=2048))
    [r] = spreads(done, "g").values()
    assert r["gap"] <= r["long"] and r["least"] == r["most"] == 37_500
    few = rows.where("row_idx < 60")
    lengths = [r.n for r in few.orderBy("row_idx").collect()]
    found = {r.row_idx: r.part for r in B.balanced(few, "n", 7).collect()}
    want = B.differenced(lengths, 7)
    assert [[i for i in range(60) if found[i] == j] for j in range(7)] == want


def test_ordered_sets_have_no_nested_loop(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_idx"), (F.col("id") * 7 % 13).cast("int").alias("part"))
    placed = B.ordered(rows)
    assert "NestedLoop" not in placed._jdf.queryExecution().executedPlan().toString()
    want = [i for p in range(13) for i in range(1000) if i * 7 % 13 == p]
    assert [r.row_idx for r in placed.orderBy("new_idx").collect()] == want and sorted(r.new_idx for r in placed.collect()) == list(range(1000))
    assert math.isclose(sum(r.part for r in placed.collect()), sum(i * 7 % 13 for i in range(1000)))


def test_snaked(spark):
    rows = spark.range(20).select(F.col("id").alias("row_idx"), (20 - F.col("id")).alias("n"))
    assert [r.part for r in B.snaked(rows, "n", 3).orderBy("row_idx").collect()][:8] == [0, 1, 2, 2, 1, 0, 0, 1]
