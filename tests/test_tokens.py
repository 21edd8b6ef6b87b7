"""Subword tokens and the TeX lexer against slow versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import lexer as X
from tessera.operators import filters as L
from tessera.operators import metrics as M
from tessera.operators import subwords as W
from tessera.plans import fixtures, tokens


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return W.ranks_of(public_tokenizers.path(tokens.RANKS))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merge loop as it is defined: the pair of lowest rank, the first of equal ones, until none is left."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merges(ranks):
    rng = np.random.default_rng(2)
    pieces = [b"", b"a", b" the", b" tokenization", "Überstraße".encode(), b"\xff\x00\xfe", b"aaaaaaaaaaaaaaaa", b" " * 40, b"=" * 300, b"abc" * 100, " naïve\u3000".encode()]
    pieces += [bytes(rng.choice(np.frombuffer(b"aeiounrst ", np.uint8), int(n))) for n in rng.integers(1, 120, 200)]
    table = W.Merges(ranks)
    assert [e.tolist() for e in table.encode(pieces)] == [merged(p, ranks) for p in pieces]
    tiny = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 256, b"aa": 301, b"aab": 257}
    small = [b"abcabc", b"aabc", b"aaaa", b"cab" * 50, b"a" * 99]
    assert [e.tolist() for e in W.Merges(tiny).encode(small)] == [merged(p, tiny) for p in small]
    assert [e.tolist() for e in W.Merges({bytes([b]): 255 - b for b in range(256)}).encode([b"ab"])] == [[158, 157]]


TEXTS = ["", None, "Hello  world, it's 2024!\n\n x", "ÄÖ \u00a0\u2028 日本語 text…", "word " * 3000, "x" * 20_000, " \n\t ", "😀😀 don't"]


def test_encoder(spark, ranks):
    import public_tokenizers
    import tiktoken

    encode = W.encoder(spark, ranks, public_tokenizers.PATTERN)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").repartition(3)
    got = {r.k: r.ids for r in rows.select("k", encode(F.col("t")).alias("ids")).collect()}
    true = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, text in enumerate(TEXTS):
        assert got[k] == true.encode_ordinary(text or "")
        assert b"".join(true.decode_single_token_bytes(i) for i in got[k]).decode() == (text or "")
    assert rows.where("false").select(encode(F.col("t"))).count() == 0
    flags = {r.k: (r.long, r.rep) for r in rows.select("k", L.too_long(F.col("t"), 2000, encode).alias("long"), L.has_repetition(encode(F.col("t")), 10, 3).alias("rep")).collect()}
    assert [k for k in flags if flags[k][0]] and flags[4] == (True, True) and flags[2] == (False, False)


def test_queries_on_subwords(spark, tables, ranks):
    """FLT1, FLT5 and AG1 count what the ids say."""
    import public_tokenizers
    import tiktoken

    true = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: r.text for r in fixtures.documents(spark, tables).collect()}
    sizes = {k: len(true.encode_ordinary(t or "")) for k, t in docs.items()}
    assert {r.doc_id: r.n_tokens for r in tokens.subword_tokens(spark, tables).collect()} == sizes
    assert {r.doc_id for r in tokens.subword_length(spark, tables).collect()} == {k for k, t in docs.items() if len(true.encode_ordinary((t or "").strip())) > 1024}
    row = tokens.subword_profile(spark, tables).first()
    assert [row[f"p{p}"] for p in (50, 75, 90, 95, 99)] == [int(np.percentile(list(sizes.values()), p)) for p in (50, 75, 90, 95, 99)]
    assert (row["count"], row["min"], row["max"]) == (len(sizes), min(sizes.values()), max(sizes.values()))

    def most(ids, n=10):
        grams = [tuple(ids[k : k + n]) for k in range(len(ids) - n + 1)]
        return max((grams.count(g) for g in set(grams)), default=0)

    found = {r.doc_id: r.repeats for r in tokens.subword_repetition(spark, tables).collect()}
    want = {k: most(true.encode_ordinary((t or "").strip())) for k, t in docs.items() if k % 13}
    assert found == {k: n for k, n in want.items() if n >= 3}


def lexed(code: str) -> list[tuple[str, str]]:
    """A lexer that goes from token to token with a stack of states."""
    general = [(r"%[^\n]*", "comment", None), (r"[{}&_^]", "builtin", None)]
    math = [(r"\\(?:[a-zA-Z]+|[^ \t\n\x0b\f\r]?)", "variable", None), *general, (r"[0-9]+", "number", None), (r"[-=!+*/()\[\]]", "operator", None), (r"[^=!+*/()\[\]\\$%&_^{}0-9-]+", "builtin", None)]
    states = {
        "root": [(r"\\\[", "string", "display"), (r"\\\(", "string", "inline"), (r"\$\$", "string", "display"), (r"\$", "string", "inline"), (r"\\(?:[a-zA-Z@_:]+|[^ \t\n\x0b\f\r]?)", "keyword", "command"), *general, (r"[^\\$%&_^{}]+", "text", None)],
        "inline": [(r"\\\)|\$", "string", "pop"), *math],
        "display": [(r"\\\]|\$\$", "string", "pop"), (r"\$", "builtin", None), *math],
        "command": [(r"\[[^\n]*?\]", "attribute", None), (r"\*", "keyword", None), (r"", None, "pop")],
    }
    stack, at, out = ["root"], 0, []
    while at < len(code) or stack[-1] == "command":
        for pattern, kind, to in states[stack[-1]]:
            if m := re.compile(pattern).match(code, at):
                if kind:
                    out.append((m[0], kind))
                at = m.end()
                if to == "pop":
                    stack.pop()
                elif to:
                    stack.append(to)
                break
    return out


CODES = [
    "", None, "plain text, no marks", "a % c\nb", "\\foo[a=b]*{x} \\bar*[1][2] \\\\[2pt] \\%\\$ \\ x", "$a_1$ b \\(c\\) \\[ d \\] $$e$$", "$a %$\n b$ c", "\\[ a $ b $$ c", "$$ a $ \\] b", "$$$", "$$$$$", "\\( a $ b", "$ a \\$ b \\) c",
    "$x\\", "\\", "\\[ \\", "$$ a\\ b $$ t", "\\[x=[y]] z\\]", "\\foo[a\nb]", "\\a*b", "%only", "{}&_^", "\\documentclass[tikz]{standalone}", "$1+23-x/2!=(4)$", "\\[%\\]\n\\]x", "a~b \x0b c", "\\((\\)\\))", "x" * 200_000, "$" + "y+" * 100_000, "\\a{b}" * 50_000,
]


def test_lexer(spark):
    rng = np.random.default_rng(4)
    marks = ["$", "$$", "\\[", "\\]", "\\(", "\\)", "\\", "%", "\n", "[", "]", "*", "{", "}", "&", "_", "ab", "\\cd", "12", "-", " ", "\\$", "\\%", "\\\\"]
    codes = CODES + ["".join(rng.choice(marks, int(n))) for n in rng.integers(1, 25, 3000)]
    rows = spark.createDataFrame(list(enumerate(codes)), "k int, c string")
    for r in rows.select("k", X.tokens(F.col("c")).alias("t")).collect():
        assert [(t.value, t.kind) for t in r.t] == lexed(codes[r.k] or ""), codes[r.k]


def test_words(spark):
    """Rules by hand."""
    cases = {
        "Mr. Smith's dogs, 1,000 of them, ran.": "Mr. Smith &apos;s dogs , 1,000 of them , ran .",
        "wait... what? (yes) [no] a&b <c>": "wait ... what ? ( yes ) &#91; no &#93; a &amp; b &lt; c &gt;",
        "i.e. this e.g. that. End": "i.e. this e.g. that . End",
        "No. 5 is No. Five": "No. 5 is No . Five",
        "don't 'quote' x.": "don &apos;t &apos; quote &apos; x .",
        "": "", "a,b 5, c,6": "a , b 5 , c , 6", "Dr. U.S. 3.14 approx. lower Upper. X": "Dr. U.S. 3.14 approx. lower Upper . X",
    }
    rows = spark.createDataFrame([(k, k) for k in cases], "k string, t string").select("k", F.array_join(X.words(F.col("t")), " ").alias("w"))
    assert {r.k: r.w for r in rows.collect()} == cases
    spoken = {"Hi, there! No?": "Hi , there ! No ?", "e.g. this": "e .g . this", "e. g. x": "e.g. x", "Mr. A": "Mr. A", "3.5 4": "3 .5 4", "": ""}
    rows = spark.createDataFrame([(k, k) for k in spoken], "k string, t string").select("k", F.array_join(X.spoken(F.col("t")), " ").alias("w"))
    assert {r.k: r.w for r in rows.collect()} == spoken


def test_code_metrics_keep_case_and_commands(spark):
    """Both metrics compare the lexer's tokens, whose case counts."""
    rows = spark.createDataFrame([(1, "\\draw (A) -- (B); $x$", "\\draw (A) -- (B); $x$"), (2, "\\draw (a) -- (b); $X$", "\\draw (A) -- (B); $x$")], "id int, hyp string, ref string")
    got = {r.id: r for r in M.code_metrics(rows, "id", "hyp", "ref").collect()}
    assert got[1].crystalbleu == pytest.approx(1) and got[1].token_edit_sim > got[2].token_edit_sim and got[2].crystalbleu < 0.8


def test_steps_of_a_batch(ranks, monkeypatch):
    """A batch of many pieces is encoded in steps of bounded size, with the ids that each text has by itself; what a worker keeps is bounded."""
    import pyarrow as pa

    monkeypatch.setattr(W, "PIECES", 50)
    monkeypatch.setattr(W, "KNOWN", 30)
    rng = np.random.default_rng(3)
    rows = [[f" w{k}" for k in rng.integers(0, 90, int(n))] for n in [0, 200, *rng.integers(0, 40, 60), 0]] + [["x" * 300, "x" * 300], []]
    column = pa.array([["cut"], *rows], pa.list_(pa.string())).slice(1)
    table = W.Merges(ranks)
    steps = list(W._steps(column))
    assert [a for a, _ in steps] + [len(rows)] == [0] + [b for _, b in steps] and len(steps) > 20
    assert all(b - a == 1 or sum(map(len, rows[a:b])) <= 50 for a, b in steps)
    got = []
    for a, b in steps:
        got += W._ids(table, column.slice(a, b - a)).to_pylist()
        assert len(table.known) <= 30 + 200 and "x" * 300 not in table.known
    assert got == [[i for p in row for i in merged(p.encode(), ranks)] for row in rows]


def test_edit_distance_lexes_once(spark, tables):
    """SM1, SM10: the metrics read tokens that were written once; no text goes through the lexer again."""
    from tessera.plans import learning

    found = learning.edit_distances(spark, tables)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == spark.read.parquet(f"{tables}/conversations.parquet").count()
