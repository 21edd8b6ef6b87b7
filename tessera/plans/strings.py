"""Queries of the string functions over code samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.filters import depends_on_files
from tessera.operators.metrics import trigram_share
from tessera.plans.fixtures import SAMPLES, quoted, samples


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A\s+|\s+\z', '', 'g')"


def _all(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def _get(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {quoted(pattern)}, {group})"


def _first(x: str, pattern: str, by: str) -> str:
    m = _get(x, pattern, 0)
    return f"CASE WHEN {_has(x, pattern)} THEN substr({x}, 1, instr({x}, {m}) - 1) || {by.format(m=m)} || substr({x}, instr({x}, {m}) + length({m})) ELSE {x} END"


def _unified(x: str) -> str:
    return _all(_all(x, T.LINE_ENDS, "\n"), r"\n\z")


def _comments(x: str, mode: str = "parity") -> str:
    pattern = r"(?m)^((?:[^%\\\n]|\\[^\n])*)%[^\n]*" if mode == "parity" else r"(?m)(^|[^\\\n])%[^\n]*"
    return _all(_unified(x), pattern, r"\1")


def _normalized(x: str) -> str:
    return _strip(_all(_all(_comments(f"replace({x}, chr(13) || chr(10), chr(10))", "prev_char"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


_FULL, _START = r"(?is)```latex\s*(.*?)```", r"(?is)```latex(.*)"
_CODE = f"CASE WHEN {_has('tex', _FULL)} THEN {_strip(_get('tex', _FULL, 1))} WHEN {_has('tex', _START)} THEN {_strip(_get('tex', _START, 1))} ELSE '' END"
_STATUS = f"CASE WHEN tex = '' THEN 'empty' WHEN {_has('tex', _FULL)} THEN 'full_block' WHEN {_has('tex', _START)} THEN 'open_block' ELSE 'no_block' END"
_S = _strip("tex")
_RESPONSE = _strip(f"CASE WHEN {_has('tex', T.CODE_FENCE)} THEN {_get('tex', T.CODE_FENCE, 1)} ELSE tex END")
_RESPONSE = _strip("translate(" + _all(_all(_RESPONSE, r"(?i)\A\s*`+\s*(?:latex|tex|tikz)?\s*"), r"\n\s*```\s*\z", "\n") + ", chr(13), chr(10))")


def _answer(x: str) -> str:
    x = f"list_last(string_split({x}, '='))"
    for before, after in T.SUBSTITUTIONS:
        x = f"replace({x}, {quoted(before)}, {quoted(after)})"
    for word in T.REMOVED:
        x = f"replace({x}, {quoted(word)}, '')"
    for pattern, by in T.UNWRAPPED:
        x = _all(x, pattern, by.replace("$$", "$"))
    return f"(SELECT {_strip('CASE WHEN ' + _has(_plain('v'), chr(92) + 'A[0-9]+' + chr(92) + 'z') + ' THEN ' + _plain('v') + ' ELSE v END')} FROM (SELECT replace({x}, '$', '') AS v))"


def _plain(x: str) -> str:
    return f"replace({x}, ',', '')"


def _split(x: str) -> str:
    return f"string_split({_unified(x)}, chr(10))"


_BANG = f"list_filter(list_transform({_split('tex')}, lambda x: {_strip('x')}), lambda x: starts_with(x, '!'))"
_MISSING = f"list_filter(list_transform({_split('tex')}, lambda x: {_strip('x')}), lambda x: contains(lower(x), 'not found'))"
_MARKED = f"list_filter({_split('tex')}, lambda x: {_has(_strip('x'), chr(92) + 'A(?:!|l' + chr(92) + '.|L' + chr(92) + '.|' + chr(92) + '[TIMEOUT' + chr(92) + '])')})"
_LINES = f"array_to_string(CASE WHEN len({_MARKED}) > 0 THEN {_MARKED} ELSE list_slice({_split('tex')}, greatest(len({_split('tex')}) - 19, 1), len({_split('tex')})) END, chr(10))"
_FENCES = f"len(regexp_extract_all(tex, {quoted(T.CODE_FENCE)}))"
_OPEN = f"(contains(tex, '```') AND NOT {_has('tex', chr(40) + '?m)```' + chr(92) + 's*$')})"
_ENDED = r"(?:\\end\s*\{(?:document|tikzpicture)\})"


def _grams(x: str) -> str:
    """Trigrams of ``x`` by ``doc_id``, each once."""
    y = f"replace(replace(lower({x}), ' ', ''), chr(10), '')"
    return f"(SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda k: c[k] || c[k + 1] || c[k + 2])) AS g FROM (SELECT doc_id, string_split({y}, '') AS c FROM ab))"


_STANDALONE = f"contains(lower({_get('tex', T.CLASS, 2)}), 'standalone')"
_DOC = "(contains(lower(tex), '\\documentclass') OR contains(lower(tex), '\\begin{document}'))"
_BEGIN = r"\\begin\s*\{document\}"
_ANSWERS = f"regexp_extract_all(tex, {quoted(chr(40) + '?i)Answer' + chr(92) + 's*:' + chr(92) + 's*([^' + chr(92) + 'n]+)')}, 1)"
_ONE = _strip(_all(_S, r"\A(?:```latex\s*)+"))
_BODY1 = _strip(f"CASE WHEN instr({_ONE}, '```') > 1 THEN substr({_ONE}, 1, instr({_ONE}, '```') - 1) ELSE {_ONE} END")



def extracted_sql(x: str) -> str:
    """What ``extract_latex`` takes from ``x``."""
    x = _strip(x)
    return _strip(f"CASE WHEN {_has(x, T.FENCE)} THEN {_get(x, T.FENCE, 1)} ELSE {x} END")


#: Name: columns of the sample ``tex`` and id, and the same in SQL.
SCALARS: dict[str, tuple[dict[str, object], dict[str, str]]] = {
    "str1_extract_latex": ({"out": T.extract_latex}, {"out": _strip(f"CASE WHEN {_has(_S, T.FENCE)} THEN {_get(_S, T.FENCE, 1)} ELSE {_S} END")}),
    "str2_strip_comments_parity": ({"out": T.strip_comments}, {"out": _comments("tex")}),
    "str3_strip_comments_prev_char": ({"out": lambda x: T.strip_comments(x, "prev_char")}, {"out": _comments("tex", "prev_char")}),
    "str4_normalize_tex": ({"out": T.normalize_tex}, {"out": _normalized("tex")}),
    "str5_document_body": ({"out": T.document_body}, {"out": f"CASE WHEN {_has('tex', T.BODY)} THEN {_get('tex', T.BODY, 1)} ELSE tex END"}),
    "str6_single_fence": ({"out": T.single_fence}, {"out": f"CASE WHEN {_has(_S, T.ONE_FENCE)} AND {_strip(_get(_S, T.ONE_FENCE, 1))} <> '' THEN {_strip(_get(_S, T.ONE_FENCE, 1))} END"}),
    "str7_is_complete": ({"out": T.is_complete}, {"out": f"{_has('tex', '(?i)' + chr(92) * 2 + 'documentclass')} AND {_has('tex', T.BEGIN)} AND {_has('tex', T.END)}"}),
    "str8_best_effort": ({"code": lambda x: T.best_effort(x).code, "status": lambda x: T.best_effort(x).status}, {"code": _CODE, "status": _STATUS}),
    "str9_problem": (
        {"out": lambda x: T.problem(T.best_effort(x).status, T.best_effort(x).code)},
        {"out": f"CASE WHEN {_STATUS} = 'open_block' THEN 'LaTeX code block is not closed (``` missing). Output likely truncated.' WHEN {_STATUS} = 'no_block' THEN 'Missing ```latex ...``` block.' WHEN {_CODE} = '' THEN 'Empty LaTeX code.' ELSE '' END"},
    ),
    "str10_is_standalone": ({"out": T.is_standalone}, {"out": _STANDALONE}),
    "str11_inject_pagestyle": ({"out": T.inject_pagestyle}, {"out": f"CASE WHEN {_has('tex', chr(92) * 2 + '(this)?pagestyle' + chr(92) + 's*' + chr(92) + '{empty' + chr(92) + '}')} THEN tex ELSE {_first('tex', T.BEGIN, '{m} || chr(10) || ' + quoted(chr(92) + 'pagestyle[empty]' + chr(92) + 'thispagestyle[empty]').replace('[', '{{').replace(']', '}}') + ' || chr(10)')} END"}),
    "str13_first_block": ({"out": T.first_block}, {"out": f"CASE WHEN {_has('tex', T.LATEX_FENCE)} THEN trim({_get('tex', T.LATEX_FENCE, 1)}, chr(10)) END"}),
    "str14_one_block": ({"out": T.one_block}, {"out": "'```latex' || chr(10) || " + _strip(_all(_BODY1, r"(?i)```(?:latex)?\s*")) + " || chr(10) || '```'"}),
    "str16_image_mark_and_name": (
        {"question": lambda x: T.without_image_mark(F.concat(F.lit(" <image>"), x)), "name": T.safe_name},
        {"question": _strip(f"replace({_strip(chr(39) + ' <image>' + chr(39) + ' || tex')}, '<image>', '')"), "name": _all("tex", r"[^A-Za-z0-9_.\-]+", "_")},
    ),
    "str17_code_of_response": ({"out": T.code_of_response}, {"out": _RESPONSE}),
    "str18_is_full_document": ({"out": T.is_full_document}, {"out": _DOC}),
    "str19_no_page": (
        {"out": T.no_page},
        {"out": f"CASE WHEN contains(tex, '{{standalone}}') OR NOT {_has('tex', _BEGIN)} THEN tex ELSE replace({_first('tex', _BEGIN, quoted(T.NO_PAGE.replace('{', '{{').replace('}', '}}')))}, {quoted(chr(92) + 'end{document}')}, {quoted(chr(92) + 'thispagestyle{empty}' + chr(10) + chr(92) + 'end{document}')}) END"},
    ),
    "str20_wrapped": ({"out": T.wrapped}, {"out": f"CASE WHEN {_DOC} THEN tex ELSE {quoted(chr(92) + 'documentclass[tikz]{standalone}' + chr(10) + T.PREAMBLE + chr(10) + chr(92) + 'begin{document}' + chr(10))} || tex || {quoted(chr(10) + chr(92) + 'end{document}' + chr(10))} END"}),
    "str21_needs_retry": ({"out": T.needs_retry}, {"out": " OR ".join(f"contains(tex, {quoted(m)})" for m in T.RETRY_MESSAGES)}),
    "str22_format_score": (
        {"score": lambda x: T.format_score(x).score, "violation": lambda x: T.format_score(x).violation},
        {"score": f"CASE WHEN {_FENCES} = 1 THEN 0.1::DOUBLE WHEN {_FENCES} = 0 AND {_OPEN} THEN -0.3 ELSE -0.2 END", "violation": f"CASE WHEN {_FENCES} = 1 THEN '' WHEN {_FENCES} > 1 THEN 'multiple_fences' WHEN {_OPEN} THEN 'unclosed_fence' ELSE 'no_fence' END"},
    ),
    "str23_truncation_risk": (
        {"out": lambda x: T.truncation_risk(x, x)},
        {"out": f"CASE WHEN tex = '' THEN 1.0::DOUBLE WHEN NOT {_has('tex', chr(40) + '?m)```' + chr(92) + 's*$')} THEN 0.8 WHEN NOT {_has('lower(tex)', _ENDED)} THEN 0.6 WHEN abs((length(tex) - length(replace(tex, '{{', ''))) - (length(tex) - length(replace(tex, '}}', '')))) > 2 THEN 0.4 ELSE 0.0 END".replace("{{", "{").replace("}}", "}")},
    ),
    "str24_estimated_tokens": ({"out": T.estimated_tokens}, {"out": "CAST(length(tex) // 4 AS INTEGER)"}),
    "str26_log_message": ({"out": lambda x: T.log_message(x, F.lit(""))}, {"out": f"CASE WHEN len({_BANG}) > 0 THEN array_to_string(list_slice({_BANG}, 1, 3), ' | ') WHEN len({_MISSING}) > 0 THEN array_to_string(list_slice({_MISSING}, 1, 3), ' | ') ELSE 'Compile failed (unknown)' END"}),
    "str27_error_lines": ({"out": lambda x: T.error_lines(x, most=80)}, {"out": f"CASE WHEN length({_LINES}) > 80 THEN substr({_LINES}, 1, 80) || chr(10) || '...[log truncated]' ELSE {_LINES} END"}),
    "str28_repair_prompt": (
        {"out": lambda x: T.repair_prompt(x, F.concat(F.lit("! {code} {note} "), x, F.lit("{{error}}")), 100)},
        {"out": "'Fix this LaTeX code with the fewest changes and answer with one fenced block.' || chr(10) || '<ERROR_START>' || chr(10) || '! {code} {note} ' || tex || '{{error}}' || chr(10) || '<ERROR_END>' || chr(10) || '<CODE_START>' || chr(10) || substr(tex, 1, 100) || chr(10) || '<CODE_END>' || chr(10) || CASE WHEN length(tex) > 100 THEN chr(10) || '[Code truncated]' || chr(10) ELSE '' END || chr(10)"},
    ),
    "str29_template": (
        {"out": lambda x: T.filled("Question: {content}\nAnswer {{{hint}}}: {absent}", content=F.concat(F.lit("{hint}{content}"), x), hint=F.concat(F.lit("{content}"), x))},
        {"out": "'Question: {hint}{content}' || tex || chr(10) || 'Answer {{content}' || tex || '}: {absent}'"},
    ),
    "str31_normalize_answer": ({"out": T.normalize_answer}, {"out": _answer("tex")}),
    "str32_last_answer": ({"out": T.last_answer}, {"out": f"CASE WHEN len({_ANSWERS}) > 0 THEN list_last({_ANSWERS}) ELSE '[INVALID]' END"}),
    "str33_answer_formats": (
        {"boxed": T.boxed_format, "tagged": T.answer_format, "squeezed": T.squeezed_marks},
        {"boxed": f"CAST({_has('tex', chr(40) + '?s)' + chr(92) + 'A<think>.*</think>.*' + chr(92) * 2 + 'boxed' + chr(92) + '{.*' + chr(92) + '}.*' + chr(92) + 'z')} AS DOUBLE)", "tagged": f"CAST({_has('tex', chr(40) + '?s)' + chr(92) + 'A<think>.*?</think>' + chr(92) + 's*<answer>.*?</answer>' + chr(92) + 'z')} AS DOUBLE)", "squeezed": _all("tex", r"\s*([<>/])\s*", r"\1")},
    ),
    "str34_first_choice": ({"out": T.first_choice}, {"out": "regexp_extract(tex, '[012]', 0)"}),
    "tok1_word_tokens": ({"out": lambda x: F.array_join(T.tokens(x), "|")}, {"out": r"array_to_string(list_filter(regexp_split_to_array(lower(tex), '\s+'), lambda w: w <> ''), '|')"}),
    "flt4_external_dependency": ({"out": depends_on_files}, {"out": _has(_comments("tex"), T.EXTERNAL)}),
    "flt8_repair_status": (
        {"out": lambda x: F.when(T.single_fence(x).isNull(), "bad_output_format").when(~T.is_complete(T.single_fence(x)), "not_complete_doc").otherwise("ok")},
        {"out": f"CASE WHEN NOT {_has(_S, T.ONE_FENCE)} OR {_strip(_get(_S, T.ONE_FENCE, 1))} = '' THEN 'bad_output_format' WHEN NOT ({_has(_S, '(?i)' + chr(92) * 2 + 'documentclass')} AND {_has(_S, T.BEGIN)} AND {_has(_S, T.END)}) THEN 'not_complete_doc' ELSE 'ok' END"},
    ),
}


def _query(columns: dict[str, object]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        made: list[Column] = [f(F.col("tex")).alias(name) for name, f in columns.items()]
        return samples(spark, folder).select("doc_id", *made)

    return run


def _similarity(spark: SparkSession, folder: str) -> DataFrame:
    both = samples(spark, folder).select("doc_id", F.col("tex").alias("a"), F.substring("tex", F.lit(20), F.length("tex")).alias("b"))
    return both.select("doc_id", F.round(T.text_similarity(F.col("a"), F.col("b"), trigram_share(spark)), 9).alias("similarity"))


def _ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = samples(spark, folder)
    key = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, F.col("tex"))
    return rows.select("doc_id", T.six_digit_id(key).alias("id6"))


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("Fig"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".PNG", ".jpeg", ".webp", ""))), (F.col("doc_id") % 4 + 1).cast("int")))
    return samples(spark, folder).select("doc_id", T.data_url(path, F.col("tex").cast("binary")).alias("url"))


_SIM = f"""WITH ab AS (SELECT doc_id, tex AS a, substr(tex, 20) AS b FROM {SAMPLES} s), ga AS {_grams('a')}, gb AS {_grams('b')},
  na AS (SELECT doc_id, count(*) AS n FROM ga GROUP BY doc_id), nb AS (SELECT doc_id, count(*) AS m FROM gb GROUP BY doc_id), nc AS (SELECT doc_id, count(*) AS c FROM ga JOIN gb USING (doc_id, g) GROUP BY doc_id)
  SELECT doc_id, round(CASE WHEN length(b) = 0 THEN CASE WHEN contains(lower(a), 'tikz') AND (contains(a, '\\draw') OR contains(a, '\\node')) THEN 0.3 ELSE 0.0 END
    WHEN n IS NULL OR m IS NULL THEN 0.0 ELSE coalesce(c, 0) / (n + m - coalesce(c, 0)) END, 9) AS similarity
  FROM ab LEFT JOIN na USING (doc_id) LEFT JOIN nb USING (doc_id) LEFT JOIN nc USING (doc_id)"""
_ID = f"""SELECT doc_id, CASE WHEN regexp_matches(k, '\\A[0-9]+\\z') THEN CASE WHEN length(CAST(CAST(k AS BIGINT) AS VARCHAR)) >= 6 THEN CAST(CAST(k AS BIGINT) AS VARCHAR) ELSE lpad(CAST(CAST(k AS BIGINT) AS VARCHAR), 6, '0') END
  ELSE substr(regexp_replace(k, '[^\\w\\-.]+', '_', 'g'), 1, 128) END AS id6
  FROM (SELECT doc_id, {_strip("CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 1 THEN tex ELSE '0' END")} AS k FROM {SAMPLES} s)"""
_URL = f"""SELECT doc_id, 'data:' || CASE doc_id % 4 WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' ELSE 'image/png' END || ';base64,' || base64(encode(tex)) AS url FROM {SAMPLES} s"""

QUERIES = {name: _query(columns) for name, (columns, _) in SCALARS.items()} | {"str25_text_similarity": _similarity, "str12_six_digit_id": _ids, "str15_data_url": _urls}
ORACLE = {name: f"SELECT doc_id, {', '.join(f'{x} AS {c}' for c, x in sql.items())} FROM {SAMPLES} s" for name, (_, sql) in SCALARS.items()} | {"str25_text_similarity": _SIM, "str12_six_digit_id": _ID, "str15_data_url": _URL}
