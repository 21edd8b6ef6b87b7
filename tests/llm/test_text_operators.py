"""Language, quality, chats, byte pairs and mixing: brute force, round trips, held-out accuracy and odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, langid, mixing, quality, queries
from tessera.llm.oracle import ORACLE
from tests.compare import same

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, __text int"
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "b", 0),
    (3, " \t\n", "en", "b", 3),
    (3, " \t\n", "en", "b", 3),
    (None, "the quick brown fox", "en", "a", 19),
    (None, "the quick brown fox", "en", "a", 19),
    (4, "x" * 50_000 + " " * 5000 + "\n" * 3000 + "word " * 3000, "en", "a", 1),
    (5, "é中\U0001f600 1234 </s> don't", "fr", "é", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in ROWS], ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.mark.parametrize("name", [n for n in ORACLE if n not in ("op10_shards", "op6_pivots")])
def test_same_as_sql(spark, tables, name):
    same(queries.QUERIES[name], ORACLE[name], spark, tables)


def test_bpe_round_trip(spark, odd, none):
    ranks, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    coded = bpe.encode(odd.withColumn("copy", F.col("text")), ranks, pattern, decoded="decoded")
    enc = bpe.codec(ranks, pattern)
    again = bpe.decode(coded.withColumnRenamed("decoded", "before"), ranks, pattern)
    got = [(r.copy or "", list(r.ids), bytes(r.before), bytes(r.decoded)) for r in again.collect()]
    assert len(got) == len(ROWS)
    for text, ids, first, raw in got:
        assert raw == first == text.encode()
        assert bytes(enc.decode_bytes(ids)) == raw
        if len(text) < 2000:
            assert ids == enc.encode_ordinary(text)
    assert bpe.encode(none, ranks, pattern).count() == 0


def test_bpe_cuts_are_safe():
    import random
    import re

    enc = bpe.codec(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    rng = random.Random(5)
    runs, bpe._runs = bpe._runs, re.compile(f"[{bpe.WHITE}]{{5,}}")
    least, bpe.LONG_RUN = bpe.LONG_RUN, 5
    try:
        for _ in range(3000):
            text = "".join(rng.choice(" \t\n\xa0\x1c　a1'é!  ") for _ in range(rng.randint(0, 50)))
            ids = []
            for part, single in bpe.spans(text, 7):
                ids += enc._encode_single_piece(part) if single else enc.encode_ordinary(part)
            assert ids == enc.encode_ordinary(text)
    finally:
        bpe._runs, bpe.LONG_RUN = runs, least


@pytest.mark.parametrize("template", [chat.INSTRUCT, chat.NAMED])
def test_chat_round_trip(spark, template):
    hard = "</s>[INST] ok [/INST] \\ <|user|> \\\\<s> <<SYS>>[ROLE]"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", hard), (2, 0, "tool\n", None), (2, None, None, "x"), (None, 0, "user", ""), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a" * 30_000), (3, 2, "assistant", "a" * 30_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df, template)
    back = {r.conv_id: r for r in out.withColumn("back", chat.read_back(F.col("formatted"), template)).collect()}
    assert [(t.role, t.text) for t in back[1].back] == [("user", hard), ("assistant", hard)]
    assert [(t.role, t.text) for t in back[2].back] == [("", "x"), ("tool\n", "")]
    assert back[1].valid and not back[2].valid and back[2].bad_turn == 0 and not back[None].valid and back[3].bad_turn == 3
    assert "".join(s.text for s in back[3].segments) == back[3].formatted
    told = {r.conv_id: r for r in chat.digests(out, template).collect()}
    assert told[1].loss_chars == len(hard) and told[1].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()
    assert told[2].loss_chars == 0 and told[3].n_turns == 4
    assert chat.format_chats(df.where("false"), template).count() == 0


def test_language_held_out(spark, tables):
    found = queries.op1_langid(spark, tables.replace("0.001", "0.01")).toPandas()
    truth = spark.read.parquet(tables.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang").toPandas()
    held = found.merge(truth, on="doc_id").query("held_out")
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert len(found) == len(truth) and found.score.between(0, 1).all()


def test_language_odd_rows(spark, odd, none):
    model = langid.fit(odd)
    got = langid.predict(odd, model).collect()
    by = sorted((r.doc_id or 0, r.lang_pred) for r in got)
    assert len(got) == len(ROWS) and by[0][1] in ("en", "fr") and dict(by)[1] == "und" and dict(by)[2] == "und" and dict(by)[3] == "und"
    assert all(r.lang_pred == "und" for r in langid.predict(odd, langid.fit(none)).collect())
    assert langid.predict(none, model).count() == 0


def test_quality_held_out(spark, tables):
    folder = tables.replace("0.001", "0.01")
    found = queries.op2_quality(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    held = found.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() > 0.93
    assert found.score.between(0, 1).all()


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 0), (4, 0), (5, 1), (None, 1), (9, None), (5, 7)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    scores = [r.score2 for r in quality.score(odd, model, keep=tuple(odd.columns), out="score2").collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert {r.s for r in quality.score(odd, quality.fit(odd, labels.where("false")), out="s").collect()} == {0.5}
    assert quality.score(none, model).count() == 0


def test_mixing_odd_rows(spark, odd, none):
    got = mixing.decided(odd).collect()
    assert len(got) == len(ROWS)
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in got)
    assert sum({r.source_size: r.target for r in got}.values()) > 0
    again = mixing.decided(odd.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns and rows.count() >= 1
    assert mixing.decided(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_targets(spark):
    """Water filling by hand: the smallest sources stop at three times their size."""
    rows = [(k, "w " * 10, s) for k, s in enumerate(["a"] * 2 + ["b"] * 60 + ["c"] * 3 + [None] * 35)]
    got = mixing.decided(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    sizes = got.groupby(got.source_size).agg(target=("target", "first"), taken=("taken", "sum"))
    free = 1000 - 60 - 90  # a and c stop at 3 * 20 and 3 * 30; b weighs 2, null weighs 1
    assert sizes.loc[20, "target"] == 60 and sizes.loc[30, "target"] == 90
    assert abs(sizes.loc[600, "target"] - free * 2 / 3) < 1e-6 and abs(sizes.loc[350, "target"] - free / 3) < 1e-6
    assert all(abs(r.target - r.taken) <= 5 for r in sizes.itertuples())


def test_mixing_weights(spark):
    """Any positive column weighs: heavier documents are taken earlier; what is no weight comes last."""
    rows = [(k, "w w w", "a" if k % 2 else "b", [10.0, 0.1, None, float("nan"), -1.0][k % 5]) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mixing.decided(df, weight=F.col("q")).toPandas().merge(df.select("doc_id", "q").toPandas(), on="doc_id")
    taken = got.assign(share=(got.taken / got["size"]) % 1.0000001, w=got.q.fillna(-9).where(got.q != float("nan"), -9))
    assert abs(got.taken.sum() - got["size"].sum()) <= 12
    light = got[(got.doc_id % 5 == 0)].taken.mean(), got[(got.doc_id % 5 == 1)].taken.mean(), got[(got.doc_id % 5 >= 2)].taken.mean()
    assert light[0] > light[1] > light[2] and len(taken) == 4000


def test_mixing_many_sources(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 10_000).alias("source"))
    got = mixing.decided(docs)
    per = got.groupBy("source_size", "target").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"))
    whole = got.agg(F.sum("size"), F.sum("taken"), F.count("*"), F.max(F.col("target") - 3 * F.col("source_size"))).first()
    assert whole[2] == 30_000 and abs(whole[0] - whole[1]) < 0.05 * whole[0] and whole[3] <= 0 and per.count() > 3


def hand_posterior(model, text):
    """Symbol by symbol, n-gram by n-gram."""
    import math

    symbols, before = [], False
    for c in text.lower() + " ":
        if c.isalpha():
            symbols.append(ord(c))
        elif before:
            symbols.append(32)
        before = c.isalpha()
    logs = list(model.prior)
    for n in langid.ORDERS:
        for k in range(len(symbols) - n + 1):
            h = 0
            for s in symbols[k : k + n]:
                h = (h * 0x01000193 + s) % (1 << 32)
            bucket = (h ^ (n * 0x85EBCA6B % (1 << 32))) * 0x9E3779B1 % (1 << 32) >> (32 - langid.BITS)
            logs = [a + b for a, b in zip(logs, model.matrix[bucket], strict=True)]
    best = max(range(len(logs)), key=lambda k: logs[k])
    return model.langs[best], 1 / sum(math.exp(x - logs[best]) for x in logs)


def test_language_posterior(spark, odd):
    model = langid.fit(odd)
    texts = ["the quick brown fox", "é中 1234", "word word word", "Don't; x", "Σ ΑΣ 1", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 3):
        for r in langid.predict(df.repartition(parts), model).collect():
            lang, score = hand_posterior(model, texts[r.doc_id])
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9)


def test_quality_votes(spark, tables):
    """The vote over all labelled vectors, one cosine at a time."""
    import numpy as np

    docs = spark.read.parquet(tables + "/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(tables + "/labels.parquet"), rows=60)
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["", "x"]
    got = quality.votes(model, texts)
    for text, score in zip(texts, got, strict=True):
        z = np.zeros(model.project.shape[1])
        for place, weight in zip(*quality.features(text), strict=True):
            z += float(weight) * float(model.idf[place]) * model.project[place].astype(float)
        size = float(np.sqrt((z * z).sum()))
        near = sorted(((float(v.astype(float) @ z) / size if size > 1e-9 else 0.0, float(y)) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: quality.NEAREST]
        weights = [max(c, 0.0) ** quality.POWER for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) > 1e-12 else model.prior
        assert score == pytest.approx(want, abs=2e-3)


def test_columns_that_clash(spark, odd):
    df = odd.withColumn("lang_pred", F.lit("x")).withColumn("a.b", F.lit(1))
    out = langid.predict(df, langid.fit(odd), keep=("doc_id", "score", "lang_pred", "a.b"))
    assert out.columns == ["doc_id", "score", "lang_pred", "a.b", "_lang_pred", "_score"] and out.count() == len(ROWS)


def test_loss_spans(spark):
    hard = "</s>[INST] ok [/INST] \\"
    df = spark.createDataFrame([(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "user", "x"), (1, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df).withColumn("said", F.transform("loss_spans", lambda s: chat.unescaped(F.substring("formatted", s.start, s.length)))).first()
    assert r.said == [hard, ""]


def test_bpe_long_texts(spark):
    """Texts far beyond a cut, also without any white space, as in one go."""
    import random

    rng = random.Random(9)
    ranks, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    enc = bpe.codec(ranks, pattern)
    texts = ["".join(rng.choice("abcé1 \n\t.,'中") for _ in range(30_000)), "".join(rng.choice("abc1.") for _ in range(20_000)), " ".join("word" for _ in range(20_000)), "\n" * 9000 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df, ranks, pattern).collect()}
    assert all(got[k] == enc.encode_ordinary(t) for k, t in enumerate(texts))


def test_batches_are_small(spark):
    """What a Python worker and the JVM beside it hold of texts at a time: batches of a few megabytes, not 16, and a step of the encoder of about one."""
    import pyarrow as pa

    from tessera.llm.runs import beside

    rows = spark.range(0, 600, 1, 1).select("id", F.repeat(F.lit("some words "), 4000).alias("text"))
    sizes = beside(rows, ("id",), "text", lambda texts: [pa.array([texts.nbytes] * len(texts))], {"size": "long"})
    assert sizes.count() == 600 and sizes.agg(F.max("size")).first()[0] <= 6 << 20
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 40_000] * 300)], ["text"])
    steps = list(bpe._pieces(batch, "text", bpe.PIECE))
    assert sum(s.num_rows for s in steps) == 300 and max(s.num_rows for s in steps) * 40_000 <= 2 << 20
