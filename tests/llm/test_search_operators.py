"""Near duplicates, vectors, lines, shards and the pipeline against brute force, with odd rows."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, lines, lsh, pivots, queries, sharding, simhash
from tessera.llm.oracle import ORACLE
from tests.compare import same

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, hash string, id string"


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(k) for k in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    words = ["w%d" % k for k in range(300)]
    base = [" ".join(rng.choice(words, 80)) for _ in range(25)]
    texts = [b for b in base for _ in range(2)] + [b.replace("w1 ", "zz ", 1) for b in base] + ["", None, "  ", "one two", "one two", "ONE two"]
    texts += [base[0] + "\n" + base[1] + " tail\n\n" + base[0], "a" * 20_000 + "\n" + base[2], "\n\n"]
    rows = [(None if k % 40 == 39 else k, t, "en", ["a", "b", None][k % 3], 0, "clash", "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], DOC)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in components.components(links).collect()}
    assert len({found[k] for k in range(61)}) == 1 and found[100] == found[101] != found[0] and len(found) == 63
    assert components.components(links.where("false")).count() == 0


def test_fingerprint():
    def slow(text):
        parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = [" ".join(parts[k : k + 4]) for k in range(max(1, len(parts) - 3))] if parts else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in ("", "One", "ÉA b\x0bc  d\te f", "x y z w " * 30, "a b c d e"):
        assert simhash.fingerprint(text) == slow(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("tree", [4096, 8])
def test_bk_trees(spark, tree):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = [(np.uint64(1) << rng.integers(0, 64, n, np.uint64)) for n in rng.integers(0, 5, 400)]
    values = np.unique([np.bitwise_xor.reduce(f, initial=s) for f, s in zip(flips, rng.choice(seeds, 400), strict=True)]).astype(np.uint64)
    near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None]) <= 4)
    want = roots(len(values), near.tolist())
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(df, len(values), 4, tree)).collect()}
    got = [found.get(int(v), int(v)) for v in values.view(np.int64)]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))
    for keep in (1, 2, 3):
        assert len(simhash.masks(keep)) == math.comb(4 + keep, keep)


def test_simhash_rows(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(f"{simhash.fingerprint(r.text):016x}", set()).add(r.doc_id)
    prints = list(by)
    pairs = [(a, b) for a, x in enumerate(prints) for b, y in enumerate(prints) if (int(x, 16) ^ int(y, 16)).bit_count() <= 4]
    root = roots(len(prints), pairs)
    least = {}
    for p, r in zip(prints, root, strict=True):
        known = [d for d in by[p] if d is not None]
        least[r] = min([*known, *([least[r]] if r in least else [])])
    want = {p: least[r] for p, r in zip(prints, root, strict=True)}
    assert all(g.component_id == want[g.fingerprint] for g in got)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    rows = [(k, (base[k % 60] + rng.standard_normal(16) * (0.03 if k >= 60 else 0)).tolist(), k % 3) for k in range(240)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], None), (303, None, 0), (304, [0.0] * 16, 0), (305, [float("nan")] * 16, 0), (306, [None] * 16, 0), (307, [1.0, 2.0], 0), (308, [1.0, 2.0], 0), (None, rows[0][1], 0), (400, [float("inf")] + [0.0] * 15, 0)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, node string")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("most", [384, 5])
def test_pivots(spark, vectors, monkeypatch, most):
    monkeypatch.setattr(pivots, "LIST", most)
    monkeypatch.setattr(pivots.list_links, "__defaults__", (pivots.COSINE, most))
    got = {r.vec_id: r for r in pivots.near_vectors(vectors).collect()}
    rows = vectors.collect()
    fit = [r for r in rows if r.vec_id is not None and r.label is not None and usable(r.embedding)]
    unit = [np.array(r.embedding) / np.linalg.norm(r.embedding) for r in fit]
    pairs = [(a, b) for a in range(len(fit)) for b in range(len(fit)) if a != b and fit[a].label == fit[b].label and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    root = roots(len(fit), pairs)
    least = {}
    for r, k in zip(fit, root, strict=True):
        least[k] = min(r.vec_id, least.get(k, r.vec_id))
    found = sum(got[r.vec_id].n_links for r in fit)
    assert found >= 0.9 * len(pairs) and found <= len(pairs)
    for k, r in enumerate(fit):
        assert got[r.vec_id].n_links <= sum(a == k for a, _ in pairs)
        assert got[r.vec_id].component_id == least[root[k]] and got[r.vec_id].kept == (r.vec_id == least[root[k]])
    for k in (302, 303, 304, 305, 306, 400):
        assert got[k].n_links == 0 and got[k].component_id == k and got[k].kept
    assert len(got) == len(rows) and got[307].n_links == 1
    assert pivots.near_vectors(vectors.where("false")).count() == 0


def nearest_rows(rows, q, k):
    """By all distances."""
    return sorted((float(lsh.distances(np.array([r.embedding]), np.array(q.embedding))[0]), r.vec_id) for r in rows if r.vec_id != q.vec_id and len(r.embedding) == len(q.embedding))[:k]


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append(r)
    return {q: [(r.score, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] for q, found in out.items()}


def test_lsh_exact(spark, vectors):
    rows = [r for r in vectors.collect() if r.vec_id is not None and usable(r.embedding)]
    got = by_query(lsh.nearest(vectors, F.col("vec_id") % 50 == 0, 5, exact=True))
    assert got == {q.vec_id: nearest_rows(rows, q, 5) for q in rows if q.vec_id % 50 == 0}


def test_lsh_odd_rows(spark, vectors):
    assert lsh.nearest(vectors, F.lit(False), 5).count() == 0
    assert lsh.nearest(vectors.where("vec_id = 50"), F.lit(True), 5).count() == 0
    assert lsh.nearest(vectors.where("false"), F.lit(True), 5).count() == 0
    few = by_query(lsh.nearest(vectors.where("vec_id < 5"), F.lit(True), 10))
    assert {q: len(x) for q, x in few.items()} == dict.fromkeys(range(5), 4)
    assert [x[1] for x in by_query(lsh.nearest(vectors, F.col("vec_id") == 307, 5))[307]] == [308]
    same_ = vectors.where("vec_id = 10").select("embedding").crossJoin(spark.range(1000, 1030)).select(F.col("id").alias("vec_id"), "embedding")
    tied = by_query(lsh.nearest(same_.union(vectors.select("embedding", "vec_id").where("vec_id < 60").select("vec_id", "embedding")), F.col("vec_id") == 1010, 5))
    assert tied == {1010: [(0.0, k) for k in (10, 1000, 1001, 1002, 1003)]}
    repeated = by_query(lsh.nearest(vectors.where("vec_id < 9").union(vectors.where("vec_id = 3")), F.col("vec_id") == 4, 20))[4]
    assert len(repeated) == 9 and sorted(x[1] for x in repeated) == [0, 1, 2, 3, 3, 5, 6, 7, 8]
    scaled = [(k, [float(x) for x in np.random.default_rng(k).standard_normal(8) * 10.0**e]) for e in (200, -200, 0) for k in range(e + 300, e + 320)]
    wide = spark.createDataFrame(scaled, "vec_id long, embedding array<double>")
    assert len(by_query(lsh.nearest(wide, F.col("vec_id") % 10 == 0, 10))) == 6
    assert all(len(x) == 10 and all(math.isfinite(s) for s, _ in x) for x in by_query(lsh.nearest(wide, F.col("vec_id") % 10 == 0, 10)).values())


def test_lsh_distances():
    x = np.array([[3e200, 4e200], [3e-200, 4e-200], [3.0, 4.0], [0.0, 0.0]])
    assert lsh.distances(x, np.zeros(2)) == pytest.approx([5e200, 5e-200, 5.0, 0.0])


def test_lsh_probes():
    """Buckets by falling success, none twice, and a vector's own bucket the first of each table."""
    rng = np.random.default_rng(6)
    q = rng.standard_normal(32)
    found = lsh.probes(q, 2.0 * 0.5 * 32**0.5)
    assert len(set(found.tolist())) == len(found)
    assert set(lsh.keys(q[None], 2.0 * 0.5 * 32**0.5)[0].tolist()) <= set(found.tolist())
    near = q + 0.5 * rng.standard_normal((2000, 32))
    hit = np.isin(lsh.keys(near, 2.0 * 0.5 * 32**0.5), found).any(1).mean()
    assert 0.88 <= hit <= 0.99


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((150, 24))
    rows = [(k, (centres[k % 150] + 0.15 * rng.standard_normal(24)).tolist()) for k in range(3000)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("settings", [{}, {"HOT": 5, "PART": 200}])
def test_lsh_recall(spark, clusters, monkeypatch, settings):
    """Recall over buckets alone, whatever the files, the parts and the split buckets."""
    for name, value in settings.items():
        monkeypatch.setattr(lsh, name, value)
    rows = clusters.collect()
    want = {q.vec_id: {i for _, i in nearest_rows(rows, q, 10)} for q in rows if q.vec_id % 50 == 0}
    seen = []
    for files in (1, 4, 16):
        got = by_query(lsh.nearest(clusters.repartition(files), F.col("vec_id") % 50 == 0, 10))
        assert sum(len({i for _, i in got[q]} & w) for q, w in want.items()) >= 0.9 * 10 * len(want)
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]
    recall, share = lsh.visited(clusters, F.col("vec_id") % 50 == 0)
    assert recall >= 0.9 and share < 0.2


def brute_lines(rows):
    first, order = {}, {}
    for doc, text in rows:
        for pos, line in enumerate(text.split("\n")):
            line = line.strip(" \t\r").lower()
            if line:
                place = (doc is not None, doc or 0, xxhash.xxh64_intdigest(text.encode(), 42), pos)
                place = (place[0], place[1], place[2] - (1 << 64) if place[2] >> 63 else place[2], pos)
                first[line] = min(first.get(line, place), place)
    known = list(first)
    sets = [{x[k : k + 9] for k in range(max(1, len(x) - 8))} for x in known]
    pairs = [(a, b) for a in range(len(known)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for line, root in zip(known, roots(len(known), pairs), strict=True):
        order[root] = min(order.get(root, first[line]), first[line])
    return set(order.values())


@pytest.mark.parametrize("small", [8 << 20, 0])
def test_lines(spark, docs, monkeypatch, small):
    monkeypatch.setattr(lines, "SMALL", small)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    keep = brute_lines([r for r in rows if r[1]])
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__lines", "__kept"] and out.count() == len(rows)
    texts = {r.text for r in out.collect()}
    assert None in texts and "" in texts
    once = lines.dedup_lines(docs.dropDuplicates(["doc_id", "text"]))
    assert once.select(F.sum("__kept")).first()[0] == len(keep)
    assert lines.dedup_lines(docs.where("false")).count() == 0


def test_shards(spark, docs, tables):
    same(queries.op10_shards, ORACLE["op10_shards"], spark, tables)
    hot = docs.select("doc_id", "text").union(spark.range(1000, 1300).select("id", F.lit("hot text " * 5)))
    got = sharding.shards(hot, 7).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == hot.count() and set(got.shard) <= set(range(7))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sums.max() - sums.min() <= 2 * got["size"].max()
    assert sharding.shards(docs.where("false"), 7).count() == 0


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    quality = corpus_pipeline.keep_quality(spark, docs, tables)
    assert quality.columns == docs.columns and 0.7 * docs.count() < quality.count() < docs.count()
    cut = corpus_pipeline.dedup_lines(spark, quality, tables).cache()
    assert cut.columns == docs.columns and cut.count() == quality.count()
    assert cut.where(F.length("text") != F.col("n_chars")).count() == 0
    single = corpus_pipeline.dedup_near(spark, cut, tables).cache()
    groups = simhash.near_duplicates(cut).select("component_id").distinct().count()
    assert single.columns == docs.columns and single.count() == groups
    assert single.join(simhash.near_duplicates(cut).where("doc_id = component_id"), "doc_id", "left_anti").count() == 0
    mix = corpus_pipeline.mix_sources(spark, single, tables).cache()
    assert mix.columns == docs.columns and mix.where("text = ''").count() == 0
    out = corpus_pipeline.encode_tokens(spark, mix, tables)
    assert out.count() == mix.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "tokens"]


def test_pipeline_odd_rows(spark, docs, tables):
    repeated = docs.unionByName(docs)
    kept = corpus_pipeline.dedup_near(spark, repeated, tables)
    assert kept.columns == docs.columns
    assert kept.count() == corpus_pipeline.dedup_near(spark, docs, tables).count() == len({r.component_id for r in simhash.near_duplicates(docs).collect()})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), tables).count() == 0
        assert stage(spark, docs, tables).count() >= 1


def test_pipeline_runs_agree(spark, tables):
    first, again = (sorted(map(str, corpus_pipeline.run(spark, tables).drop("ids").collect())) for _ in range(2))
    assert first == again and len(first) > 100


def test_pipeline_clashing_columns(spark, docs, tables):
    named = docs.withColumns({"score": F.lit(1), "a.b": F.lit(2), "__lines": F.lit(3)})
    long = named.limit(1).withColumns({"doc_id": F.lit(99_999).cast("long"), "text": F.concat(F.repeat(F.lit("x y"), 60_000), F.lit("\nshort line here"))})
    given = named.unionByName(long)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, tables)
        assert out.columns == given.columns and out.count() >= 1, name
    cut = corpus_pipeline.dedup_lines(spark, given, tables)
    assert cut.where("doc_id = 99999").first().text.startswith("x y")
