"""Url filter, Merkle manifest and hard negatives against slow versions, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, negatives, queries, storage, urls
from tessera.llm.oracle import ORACLE
from tests.compare import same


@pytest.mark.parametrize("name", ["op11_urls", "op12_merkle", "op13_hard_negatives"])
def test_sql(spark, tables, name):
    same(queries.QUERIES[name], ORACLE[name], spark, tables)


URLS = (
    ["http://a.example.net/en/%d" % k for k in range(40)]
    + ["https://b.net/x/%d?q=1" % k for k in range(40)]
    + ["https://C.Example.COM/de/%d" % k for k in range(40)]
    + ["http://d.org/fr/%d#top" % k for k in range(40)]
    + ["http://e.example.com/fr/%d" % k for k in range(20)]
    + [None, "", "no scheme/net/", "x://", "net://net/", "http://net", "http://NET/", "http://xnet/", "http://net:80/", "a://b://c.net/y", "http://ü.org/fr/ä?ö#ß", "http://org/fr/x\ny"]
    + ["http://d.org/fr/0#top"] * 3
    + ["http://long.org/en/" + "ab/" * 3000]
)


def parsed(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def slow_rule(host, path):
    fits = [(len(r), r, v) for v, r in queries.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def slow_scores(texts, learn):
    """Models as dictionaries of contexts; the probability by recursion."""
    follow = [defaultdict(Counter), defaultdict(Counter)]
    letters = set()
    for text, mark in zip(texts, learn, strict=True):
        said = urls.START * urls.ORDER + (text or "") + urls.END
        for at in range(urls.ORDER, len(said)):
            letters.add(said[at])
            for k in range(urls.ORDER + 1):
                if mark is not None:
                    follow[mark][said[at - k : at]][said[at]] += 1

    def chance(mark, context, c):
        lower = 1 / len(letters) if context is None else chance(mark, context[1:] if context else None, c)
        if context is None:
            return lower
        seen = follow[mark].get(context)
        return lower if not seen else (seen[c] + len(seen) * lower) / (sum(seen.values()) + len(seen))

    out = []
    for text in texts:
        said = urls.START * urls.ORDER + (text or "") + urls.END
        sums = [math.floor((math.log(chance(1, said[at - urls.ORDER : at], said[at])) - math.log(chance(0, said[at - urls.ORDER : at], said[at]))) * 1e6 + 0.5) for at in range(urls.ORDER, len(said))]
        out.append(sum(sums) / (len(sums) * 1_000_000))
    return out


def test_urls(spark):
    pages = spark.createDataFrame([(k if k % 50 else None, u, "kept", "kept") for k, u in enumerate(URLS)], "page_id long, url string, host string, Verdict string")
    got = urls.judged(pages, queries.RULES)
    assert got.columns == ["page_id", "url", "host", "Verdict", "_host", "path", "rule", "_verdict", "score"]
    rows = got.collect()
    assert Counter((r.page_id, r.url) for r in rows) == Counter((k if k % 50 else None, u) for k, u in enumerate(URLS))
    held = [hashlib.md5((u or "").encode()).hexdigest()[0] in "0123456789abcdef"[: urls.HELD] for u in URLS]
    ruled = [slow_rule(*parsed(u)) for u in URLS]
    marks = [{"allow": 1, "block": 0, None: None}[v] for _, v in ruled]
    scores = dict(zip(URLS, slow_scores(URLS, [None if h else m for m, h in zip(marks, held, strict=True)]), strict=True))
    known = [(math.floor(scores[u] * urls.BINS), m) for u, m, h in zip(URLS, marks, held, strict=True) if h and m is not None]
    total = Counter(m for _, m in known)
    edges = range(-urls.FAR * urls.BINS, urls.FAR * urls.BINS + 1)
    right = {e: sum(b >= e for b, m in known if m) * total[0] + sum(b < e for b, m in known if not m) * total[1] for e in edges}
    least = min(edges, key=lambda e: (-right[e], abs(e), e))
    for r in rows:
        host, path = parsed(r.url)
        rule, verdict = slow_rule(host, path)
        assert (r._host, r.path, r.rule) == (host, path, rule), r
        assert r.score == pytest.approx(scores[r.url], abs=1e-9)
        assert r._verdict == (verdict or ("allow" if math.floor(scores[r.url] * urls.BINS) >= least else "block"))
    assert urls.judged(pages.where("false"), queries.RULES).count() == 0


def test_urls_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {(r.rule, r.verdict, r.score) for r in urls.judged(pages, []).collect()} == {(None, "allow", 0.0)}
    with pytest.raises(ValueError):
        urls.in_order([("allow", "nopath")])


def test_urls_hot_and_seldom_windows(spark, monkeypatch):
    """The split of frequent and other windows changes nothing."""
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    want = sorted(map(tuple, urls.judged(pages, queries.RULES).select("page_id", "score").collect()))
    for hot in (1, 20):
        monkeypatch.setattr(urls, "HOT", hot)
        assert sorted(map(tuple, urls.judged(pages, queries.RULES).select("page_id", "score").collect())) == want


def slow_manifest(rows):
    """Digest lists of trees, level by level, as the definition reads; rows by their place."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(said, r))

    def tampered(r):
        odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        return leaf((*r[:4], r[4].replace("\n", "") if odd and r[4] is not None else r[4]))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def climb(levels, at, node):
        proof = []
        for nodes in levels[:-1]:
            start = at // 3 * 3
            run = nodes[start : start + 3]
            proof += run[: at - start] + run[at - start + 1 :]
            node, at = h(*run[: at - start], node, *run[at - start + 1 :]), at // 3
        return proof, node

    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r)))) for s in names}
    trees = {s: tree([leaf(r) for r in g]) for s, g in groups.items()}
    top = tree([trees[s][-1][0] for s in names])
    for place, s in enumerate(names):
        for at, r in enumerate(groups[s]):
            low, sub = climb(trees[s], at, tampered(r))
            high, root = climb(top, place, sub)
            yield r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*low, *high), root, root == top[-1][0]


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, row string, tree string, root string"


def manifested(df):
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return merkle.manifest(df, tampered={"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})


@pytest.mark.parametrize("hot", [merkle.HOT, 4])
def test_manifest(spark, monkeypatch, hot):
    monkeypatch.setattr(merkle, "HOT", hot)
    sizes = {"hot": 300, "three": 3, "four": 4, "Ä": 28, "zz": 1, None: 10, "": 9, "-": 82}
    rows, doc = [], 0
    for source, n in sizes.items():
        for k in range(n):
            text = [None, "", "a\nb\n", "plain", "ü\n" * 5][k % 5]
            rows.append((None if k % 29 == 28 else doc, source, None if k % 3 else "en", k, text))
            doc += 1
    rows += rows[:3] + [rows[5]] * 40 + [(doc, "hot", "en", 1, "line\n" * 400_000)]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], MANIFEST)
    got = sorted(map(tuple, manifested(df).collect()), key=str)
    assert got == sorted(slow_manifest(rows), key=str)


def test_small_manifests(spark):
    assert manifested(spark.createDataFrame([], MANIFEST)).count() == 0
    for n in (1, 2, 3, 4, 9, 10, 27, 28, 82):
        rows = [(k, "one", None, k, f"{k}\n") for k in range(n)]
        got = manifested(spark.createDataFrame([(*r, "", "", "") for r in rows], MANIFEST)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(slow_manifest(rows), key=str)


def slow_negatives(rows):
    seen = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        most = math.floor(math.sqrt(2.0**62 / max(1, len(vector))))
        v = tuple(max(-most, min(most, math.floor(256 * float(np.float32(x))))) for x in vector)
        if (key, label, v) not in seen:
            seen.append((key, label, v))
    for key, label, v in seen:
        if key % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k, other) for k, other, w in seen if k != key and len(w) == len(v))
            for goal, positive, _ in [s for s in scored if s[2] == label][:5]:
                found = [(-s, k) for s, k, other in scored if other != label and 80 * -goal <= 100 * -s <= 100 * -goal][:5]
                for rank, (score, k) in enumerate(found, 1):
                    yield key, positive, rank, k, -goal, score


VECTORS = "vec_id long, embedding array<float>, label int, score long, goal string, number string"


def mined(df, **more):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect()))


def test_negatives(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((8, 12))
    rows = [(k, [float(np.float32(x)) for x in centres[rng.integers(8)] / 3 + rng.standard_normal(12) / 6], int(rng.integers(3))) for k in range(300)]
    hot = rows[0][1]
    rows += [(1000 + k, hot, k % 2) for k in range(150)] + rows[:4] + [(20, rows[1][1], 1)]
    rows += [(400, [0.0] * 12, 1), (401, [0.0] * 12, 2), (410, [1.0, 2.0], 0), (411, [1.0, 2.5], 0), (412, [1.0, 2.25], 1), (420, [], 0), (421, [], 0), (422, [], 1)]
    rows += [(430, None, 1), (431, [1.0, None], 1), (440, [float("nan")] * 12, 1), (441, [float("inf")] * 12, 1), (None, hot, 1), (450, hot, None)]
    rows += [(460, [3e38] * 3, 0), (461, [3e38] * 3, 0), (462, [3e38, 3e38, 2e5], 1), (463, [-3e38] * 3, 1)]
    df = spark.createDataFrame([(*r, 1, "x", "x") for r in rows], VECTORS)
    assert mined(df) == sorted(slow_negatives(rows))
    assert mined(df.where("false")) == [] and mined(df.where("vec_id % 10 = 1")) == []


def test_negatives_with_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (10, [0.5, 0.5], 3)]
    df = spark.createDataFrame([(*r, 1, "x", "x") for r in rows], VECTORS)
    assert mined(df) == sorted(slow_negatives(rows)) != []


def test_goals_prune_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(negatives, "AT_ONCE", 2)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16)) * 300
    group = np.sort(rng.integers(0, 40, 8000))
    x = (centres[group] + rng.standard_normal((8000, 16)) * 20).astype(np.int64)
    labels, ids = rng.integers(0, 3, 8000), rng.permutation(8000)
    space = negatives.Space(x[::16], labels[::16], ids[::16], float((x * x).sum(1).max()) + 1)
    away, asked = space.to_pivots(space.augmented(x)), np.arange(0, 8000, 400)
    whole = negatives._floors(space, ids[asked], labels[asked], x[asked], 5), np.full(len(asked), -negatives.LEAST)
    goals = negatives.Goals(space, ids[asked], ids[asked], labels[asked], x[asked], np.arange(len(asked)), *whole, True, 5)
    compared, plain = [], negatives.products
    negatives.products = lambda a, b: compared.append(len(a) * len(b)) or plain(a, b)
    try:
        for start in range(0, 8000, 200):
            s = slice(start, start + 200)
            goals.see(ids[s], labels[s], x[s], away[s])
    finally:
        negatives.products = plain
    for place, at in enumerate(asked):
        score = x @ x[at]
        order = [k for k in np.lexsort((ids, -score)) if labels[k] == labels[at] and k != at][:5]
        assert goals.best[place].tolist() == ids[order].tolist() and goals.score[place].tolist() == score[order].tolist()
    assert sum(compared) < 0.4 * len(asked) * 8000


def test_scratch(spark):
    """Tables go at the end of their scope but for kept ones, which go at the end of the scope around."""
    with storage.scratch() as keep:
        with storage.scratch() as inner:
            one, two = storage.written(spark.range(3), "one"), inner(storage.written(spark.range(4), "two"))
        assert two.count() == 4 and not spark._jvm.java.io.File(one._tessera_path.removeprefix("file://")).exists()
        three = keep(storage.written(spark.range(5), "three"))
    assert three.count() == 5 and not spark._jvm.java.io.File(two._tessera_path.removeprefix("file://")).exists()
