"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

from tessera.llm import chat, merkle, mixing, negatives, queries, urls


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op3() -> str:
    t = chat.INSTRUCT
    escaped = r"replace(text, '\', '\\')"
    role = r"replace(role, '\', '\\')"
    for mark in t.controls:
        escaped = f"replace({escaped}, {_sql(mark)}, {_sql(mark[0] + chr(92) + mark[1:])})"
        role = f"replace({role}, {_sql(mark)}, {_sql(mark[0] + chr(92) + mark[1:])})"
    marks = " ".join(f"WHEN {_sql(n)} THEN {len(x.before) + len(x.after)}" for n, x in t.roles.items())
    loss = ", ".join(_sql(n) for n, x in t.roles.items() if x.loss)
    then = " OR ".join(f"(before = {_sql(n)} AND role IN ({', '.join(map(_sql, x.then))}))" for n, x in t.roles.items())
    begin, end = (", ".join(map(_sql, x)) for x in (t.begin, t.end))
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    o AS (
      SELECT *, lag(role) OVER w AS before, row_number() OVER w = 1 AS first, lead(role) OVER w IS NULL AS last,
        length({escaped}) + CASE role {marks} ELSE {sum(map(len, t.other))} + length({role}) END AS chars
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({loss})), '')) AS loss_sha256,
      CAST(sum(chars) AS BIGINT) AS formatted_chars,
      bool_and(CASE WHEN first THEN role IN ({begin}) ELSE {then} END AND (NOT last OR role IN ({end}))) AS valid
    FROM o GROUP BY conv_id"""


def _op4() -> str:
    return f"""
    WITH r AS (
      SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
        (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) || '|{mixing.SEED}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
      FROM documents),
    w AS (SELECT *, -ln(u) / CASE WHEN size > 0 THEN 1 / (1 + abs(length(t) / size - 6)) ELSE 1.0 END AS draw FROM r),
    s0 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM w GROUP BY source),
    s1 AS (SELECT *, (place - 1) % 3 + 1 AS w, CAST({mixing.MOST} * source_size AS DOUBLE) AS most, sum(source_size) OVER () AS total FROM s0),
    s2 AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY most / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
    s3 AS (SELECT *, CASE WHEN most / w <= level THEN most ELSE max(CASE WHEN most / w > level THEN level END) OVER () * w END AS target FROM s2),
    s4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM s3),
    d AS (SELECT w.*, source_size, target, epochs, target - epochs * source_size AS rest,
        sum(size) OVER (PARTITION BY place ORDER BY draw) AS upto, sum(size) OVER (PARTITION BY place, draw) AS same
      FROM w JOIN s4 ON w.source IS NOT DISTINCT FROM s4.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
      CAST(size * (epochs + CASE WHEN rest > 0 AND 2 * upto - same <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM d"""


def _crc32(text: str) -> tuple[str, str]:
    """SQL for the CRC-32 of a text's bytes, by the table of the reversed polynomial 0xEDB88320."""
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    entry = "CAST(x AS BIGINT)"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda v: {step})[1]"
    table = f"(SELECT list_transform(range(256), lambda x: {entry}))"
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex({text}), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, crc_table[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)""", table


def _op10(shards: int = 24, groups: int = 64) -> str:
    crc, table = _crc32("t")
    return f"""
    WITH c AS (SELECT {table} AS crc_table),
    d AS (
      SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce(text, '') AS t,
        CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k1,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k2
      FROM documents),
    k AS (SELECT k1, k2, CAST(sum(size) AS HUGEINT) AS size FROM d GROUP BY k1, k2),
    b AS (SELECT k1, k2, size, sum(size) OVER (ORDER BY k1, k2) - size AS below, sum(size) OVER () AS total FROM k),
    s AS (SELECT d.*, CAST(least({shards} - 1, (2 * below + b.size) * {shards} // (2 * total)) AS INTEGER) AS shard FROM d JOIN b USING (k1, k2))
    SELECT doc_id, CAST(size AS BIGINT) AS size, {crc} AS text_crc32, 'bytes' AS law, shard,
      row_number() OVER (PARTITION BY shard ORDER BY k2 & {groups - 1}, k1, k2, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM s, c"""


def _op12() -> str:
    crc, table = _crc32("CAST(doc_id AS VARCHAR)")
    kept = "CASE WHEN doc_id IS NOT NULL AND (SELECT value FROM crcs WHERE crcs.id = doc_id) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    return merkle.sql(kept, f"c AS (SELECT {table} AS crc_table), crcs AS MATERIALIZED (SELECT DISTINCT doc_id AS id, {crc} AS value FROM documents, c WHERE doc_id IS NOT NULL),")


ORACLE: dict[str, str] = {
    "op3_chat_format": _op3(),
    "op4_mixing": _op4(),
    "op10_shards": _op10(),
    "op11_urls": urls.sql(queries.RULES),
    "op12_merkle": _op12(),
    "op13_hard_negatives": negatives.sql(),
}
