"""Queries of subword tokens and of the TeX lexer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexer as X
from tessera.operators import filters as L
from tessera.operators import stats as S
from tessera.operators import subwords as W
from tessera.plans.fixtures import SAMPLES, documents, quoted, samples
from tessera.sources.scratch import kept

RANKS = "byte_bpe_50k.tiktoken"


def _ids(spark: SparkSession):
    import public_tokenizers

    return W.encoder(spark, W.ranks_of(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


def subword_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The number of every text's subword tokens, and a digest of their ids."""
    ids = documents(spark, folder).select("doc_id", _ids(spark)(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("ids_md5"))


def subword_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that say one run of ten tokens three times or more; half of them in a fence, some without an id."""
    key = F.when(F.col("doc_id") % 13 != 0, F.col("doc_id")).alias("doc_id")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Sure: ```latex\n"), "text", F.lit("\n``` done"))).otherwise(F.col("text")).alias("text")
    return L.repetitive(documents(spark, folder).select(key, text), "doc_id", "text", fenced=True, n=10, threshold=3, tokens=_ids(spark))


def subword_length(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of more than 1024 tokens."""
    return documents(spark, folder).where(L.too_long(F.col("text"), 1024, _ids(spark))).select("doc_id")


def subword_profile(spark: SparkSession, folder: str) -> DataFrame:
    sizes = kept(documents(spark, folder).select(F.size(_ids(spark)(F.col("text"))).alias("n")))
    return S.length_profile(sizes, "n").withColumn("mean", F.round("mean", 6))


#: What stands behind every sample: math in both ways, closed and open, comments that hide marks, options.
MATH = " $x_1+\\alpha^{2}\\%$ %c $ d\n\\[ a\\$b $ 3-4 % $$\n\\] \\foo*[k=v, 2]{y} \\\\[2pt] \\( f(x) \\) Mr. Smith's 1,000 dogs, e.g. two... $$ open \\"


def _code(tex: Column) -> Column:
    return F.concat(tex, F.lit(MATH))


def tex_lexer(spark: SparkSession, folder: str) -> DataFrame:
    """All tokens of every sample with their kinds."""
    found = samples(spark, folder).select("doc_id", X.tokens(_code(F.col("tex"))).alias("t"))
    kinds = F.array_join(F.transform("t", lambda t: F.concat(t["kind"], F.lit("\x1f"), t["value"])), "\x1e")
    return found.select("doc_id", F.size("t").alias("n_tokens"), F.md5(kinds.cast("binary")).alias("tokens_md5"))


def tex_words(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens that n-gram metrics and the edit distance compare."""
    code = _code(F.col("tex"))
    found = samples(spark, folder).select("doc_id", X.code_words(code).alias("c"), X.edit_words(code).alias("e"))
    return found.select("doc_id", F.size("c").alias("n_code"), F.size("e").alias("n_edit"), F.md5(F.array_join("c", "\x1f").cast("binary")).alias("code_md5"), F.md5(F.array_join("e", "\x1f").cast("binary")).alias("edit_md5"))


def _lexer_sql() -> str:
    every = lambda text, pattern: f"regexp_extract_all({text}, {quoted(X.sql_pattern(pattern))})"
    math = "(s[1] = '$' OR s[1:2] IN ('\\[', '\\('))"
    closes = "((p IN ('$$', '\\]')) AND display OR (p IN ('$', '\\)')) AND NOT display)"
    kind = f"""CASE WHEN math THEN CASE WHEN k = 1 THEN 'string' WHEN p[1] = '%' THEN 'comment' WHEN {closes} THEN 'string' WHEN p[1] = '\\' THEN 'variable'
        WHEN regexp_matches(p, '\\A[0-9]') THEN 'number' WHEN regexp_matches(p, '\\A[-=!+*/()\\[\\]]') THEN 'operator' ELSE 'builtin' END
      WHEN s[1] = '\\' THEN CASE WHEN k > 1 AND p[1] = '[' THEN 'attribute' ELSE 'keyword' END
      WHEN s[1] = '%' THEN 'comment' WHEN regexp_matches(s, '\\A[{{}}&_^]') THEN 'builtin' ELSE 'text' END""".replace("{{", "{").replace("}}", "}")
    return f"""WITH x AS (SELECT doc_id, {every('tex || ' + quoted(MATH), X.STRETCHES)} AS parts FROM {SAMPLES} y),
      s AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM x),
      m AS (SELECT *, {math} AS math, s[1:2] IN ('$$', '\\[') AS display FROM s),
      p AS (SELECT *, CASE WHEN math THEN {every('s', X.IN_MATH)} WHEN s[1] = '\\' THEN {every('s', X.IN_COMMAND)} ELSE [s] END AS ps FROM m),
      t AS (SELECT doc_id, s, i, math, display, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM p)
      SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens, md5(string_agg({kind} || chr(31) || p, chr(30) ORDER BY i, k)) AS tokens_md5 FROM t GROUP BY doc_id"""


QUERIES = {
    "tok1_subword_tokens": subword_tokens,
    "flt1_subword_repetition": subword_repetition,
    "flt5_subword_length": subword_length,
    "ag1_subword_profile": subword_profile,
    "str35_tex_lexer": tex_lexer,
    "str35_tex_words": tex_words,
}
ORACLE = {"str35_tex_lexer": _lexer_sql()}
