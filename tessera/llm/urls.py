"""URL filter: rules first, then a character language-model ratio; DataFrame functions only.

A rule is a host and the beginning of a path. It fits its host and all subdomains where
the url's path starts with the rule's; of those that fit, the longest decides (of equal
length the one with the longer host, then the one listed first). The host is what stands
behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case, the
path what follows up to ``?``, ``#`` or the end. A null url, or one without ``://``, has
an empty host and path, so no rule fits.

Urls that no rule fits are judged by two Markov models over characters, learned from the
urls that rules accept and reject. A model mixes all orders up to ``ORDER`` by Witten and
Bell's rule: where a context was followed ``n`` times by ``t`` different characters, the
next character has the probability (count + t * p) / (n + t), p being that of the context
without its first character; below the empty context all characters seen are equally
likely. A url's score is the mean over its characters, and an end mark, of the difference
of the log-probabilities. The threshold is calibrated on the ``HELD`` sixteenths of the
ruled urls that the models don't learn from: of the multiples of ``1 / BINS`` within
``FAR``, the one with the best balanced accuracy there (of equals the one nearest zero,
then the smaller one); 0 where they lack one of the classes. Log ratios are summed as
millionths, so scores don't depend on the order of the rows.

Every url's windows of ``ORDER + 1`` characters are counted, none is sampled or hashed,
and the tables of contexts are as large as the corpus makes them: they are joined, not
broadcast. Windows that hold at least one ``HOT``-th of all positions, at most ``HOT`` of
them, are broadcast; so no key of the join has more than that share, though all urls may
begin alike. Windows are counted before they are exchanged.

A null url counts as empty and is scored by its end mark alone. A long url is cut into
overlapping blocks of ``BLOCK`` characters for its windows, whose sums meet again. Rows
are judged one to one, repeated ones alike. Columns of ``pages`` with the names of new
ones keep them; the new ones get underscores in front. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import scratch, unused, written

ORDER = 4
#: Sixteenths of the ruled urls, by a hash, that calibrate the threshold.
HELD = 4
BINS, FAR = 100, 20
HOT = 1 << 14
BLOCK = 512
MILLION = 1_000_000
START, END = "\x02", "\x03"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host and the path of a url; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, SMALL), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def in_order(rules: Sequence[Rule]) -> list[tuple[str, str, str, str]]:
    """Rules (verdict, ``host/path``) as verdict, rule, host, path; the one that wins among those that fit stands first."""
    parts = [(verdict, rule, rule.partition("/")[0], "/" + rule.partition("/")[2]) for verdict, rule in rules]
    if any(verdict not in ("allow", "block") or "/" not in rule for verdict, rule in rules):
        raise ValueError("a rule is (allow or block, host/path)")
    return sorted(parts, key=lambda r: (-len(r[1]), -len(r[2])))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The rule that decides, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, name, top, begin in reversed(in_order(rules)):
        fits = ((host == top) | F.endswith(host, F.lit("." + top))) & F.startswith(path, F.lit(begin))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def windows(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` with every window ``gram`` of the column ``url``: each character, and the end mark, behind the ``ORDER`` before it."""
    blocks = rows.select(*keep, F.concat(F.lit(START * ORDER), "url", F.lit(END)).alias("said")).select(
        *keep, "said", F.explode(F.sequence(F.lit(0), F.floor((F.length("said") - ORDER - 1) / BLOCK).cast("int"))).alias("block")
    )
    cut = blocks.select(*keep, F.substring("said", F.col("block") * BLOCK + 1, F.lit(BLOCK + ORDER)).alias("said"))
    placed = cut.select(*keep, "said", F.explode(F.sequence(F.lit(1), F.length("said") - ORDER)).alias("at"))
    return placed.select(*keep, F.substring("said", F.col("at"), F.lit(ORDER + 1)).alias("gram"))


def counted(rows: DataFrame) -> DataFrame:
    """Per window of the rows (``url``, ``learn``: 1 accepted, 0 rejected, else null): counts ``a``, ``r`` in either class, and ``n`` in all rows."""
    of = lambda k: F.sum((F.col("learn") == k).cast("long"))
    return windows(rows, "learn").groupBy("gram").agg(F.coalesce(of(1), F.lit(0)).alias("a"), F.coalesce(of(0), F.lit(0)).alias("r"), F.count("*").alias("n"))


def ratios(grams: DataFrame) -> DataFrame:
    """Per window of :func:`counted`: ``millionths``, of the log ratio of the probabilities of its last character in the two models."""

    def level(k: int) -> DataFrame:
        return grams.groupBy(F.substring("gram", ORDER - k + 1, k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))

    def totals(counts: DataFrame) -> list[Column]:
        return [F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")]

    def mixed(count: str, n: Column, t: Column, p: Column) -> Column:
        return F.when(n > 0, (F.col(count) + t * p) / (n + t)).otherwise(p)

    single = level(0)
    whole = single.agg(*totals(single), F.count("*").alias("letters")).first()
    base = 1.0 / max(1, whole["letters"])
    of = lambda name: F.lit(whole[name] or 0)
    lower = single.select("g", mixed("a", of("na"), of("ta"), F.lit(base)).alias("pa"), mixed("r", of("nr"), of("tr"), F.lit(base)).alias("pr"))
    for k in range(1, ORDER + 1):
        counts = level(k) if k < ORDER else grams.select(F.col("gram").alias("g"), "a", "r")
        context = counts.groupBy(F.substring("g", 1, k).alias("before")).agg(*totals(counts))
        parts = counts.select("g", "a", "r", F.substring("g", 1, k).alias("before"), F.substring("g", 2, k).alias("short"))
        both = parts.join(context, "before").join(lower.withColumnRenamed("g", "short"), "short")
        lower = both.select("g", *[mixed(c, F.col(f"n{c}"), F.col(f"t{c}"), F.col(f"p{c}")).alias(f"p{c}") for c in ("a", "r")])
    return lower.select(F.col("g").alias("gram"), F.floor((F.log("pa") - F.log("pr")) * MILLION + 0.5).cast("long").alias("millionths"))


def scores(rows: DataFrame) -> DataFrame:
    """Per ``row`` of the rows (``row``, ``url``, ``learn``): its ``score``."""
    grams = written(counted(rows), "url-windows")
    known = written(grams.select("gram", "n").join(ratios(grams), "gram"), "url-ratios")
    positions = known.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT >= positions
    # at most HOT windows hold a HOT-th of all positions each
    hot = F.broadcast(known.where(often).select("gram", "millionths"))
    near = windows(rows, "row").join(hot, "gram", "left")
    sums = [F.sum("millionths").alias("millionths"), F.count("*").alias("n")]
    frequent = near.where("millionths IS NOT NULL").groupBy("row").agg(*sums)
    rest = near.where("millionths IS NULL").select("row", "gram").join(known.where(~often).select("gram", "millionths"), "gram").groupBy("row").agg(*sums)
    both = frequent.unionByName(rest).groupBy("row").agg(F.sum("millionths").alias("millionths"), F.sum("n").alias("n"))
    return written(both.select("row", (F.col("millionths").cast("double") / (F.col("n") * MILLION)).alias("score")), "url-scores")


def binned(score: Column) -> Column:
    """The score in units of ``1 / BINS``, cut at ``FAR``."""
    return F.greatest(F.lit(-FAR * BINS), F.least(F.lit(FAR * BINS), F.floor(score * BINS))).cast("int")


def threshold(marked: DataFrame) -> int:
    """From held rows (``score``, ``mark``: 1 accepted, 0 rejected): the bin from which urls are allowed. What is collected is one count a bin and class."""
    counts = {(r["bin"], r["mark"]): r["count"] for r in marked.groupBy(binned(F.col("score")).alias("bin"), "mark").count().collect()}
    bins = range(-FAR * BINS, FAR * BINS + 1)
    total = [sum(counts.get((b, mark), 0) for b in bins) for mark in (0, 1)]
    if not all(total):
        return 0
    right, best = total[1] * total[0], None
    for b in bins:  # allowed from b on: all accepted of b and above, all rejected below it
        if best is None or (right, -abs(b)) > best[:2]:
            best = right, -abs(b), b
        right += counts.get((b, 0), 0) * total[1] - counts.get((b, 1), 0) * total[0]
    return best[2]


def judged(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and the models' ``score``."""
    names = pages.columns
    own = [f"c{k}" for k in range(len(names))]
    host, path = host_and_path(F.col("_url"))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    table = pages.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)], F.col(f"`{url}`").alias("_url"))
    parsed = table.select(*own, F.coalesce("_url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    parsed = parsed.select("*", rule.alias("rule"), says.alias("says"))
    held = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 1), 16, 10).cast("int") < HELD
    mark = F.when(F.col("says") == "allow", 1).when(F.col("says") == "block", 0)
    # numbers are written with their rows, so a task that runs again finds the same ones
    with scratch() as keep:
        rows = keep(written(parsed.select("*", mark.alias("mark"), F.when(~held, mark).alias("learn"), F.monotonically_increasing_id().alias("row")), "urls"))
        scored = rows.join(keep(scores(rows.select("row", "url", "learn"))), "row")
    least = threshold(scored.where("mark IS NOT NULL AND learn IS NULL").select("score", "mark"))
    verdict = F.coalesce("says", F.when(binned(F.col("score")) >= least, "allow").otherwise("block"))
    made = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": verdict, "score": F.col("score")}
    return scored.select(*[F.col(o).alias(c) for c, o in zip(names, own, strict=True)], *[v.alias(unused(k, names)) for k, v in made.items()])


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql(rules: Sequence[Rule], key: str = "page_id") -> str:
    """DuckDB SQL of :func:`judged` over ``pages``."""
    fits = [(says, name, f"(host = {_text(top)} OR suffix(host, {_text('.' + top)})) AND prefix(path, {_text(begin)})") for says, name, top, begin in in_order(rules)]
    choice = lambda k: "CASE " + " ".join(f"WHEN {f[2]} THEN {_text(f[k])}" for f in fits) + " END"
    mixed = lambda c, n, t, p: f"CASE WHEN {n} > 0 THEN ({c} + {t} * {p}) / ({n} + {t}) ELSE {p} END"
    totals = "sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr"
    levels = [
        "c0 AS MATERIALIZED (SELECT right(gram, 1) AS g, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1)",
        f"t0 AS (SELECT {totals}, 1.0::DOUBLE / count(*) AS base FROM c0)",
        f"p0 AS MATERIALIZED (SELECT g, {mixed('a', 'na', 'ta', 'base')} AS pa, {mixed('r', 'nr', 'tr', 'base')} AS pr FROM c0, t0)",
    ]
    for k in range(1, ORDER + 1):
        levels += [
            f"c{k} AS MATERIALIZED (SELECT right(gram, {k + 1}) AS g, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1)",
            f"t{k} AS MATERIALIZED (SELECT left(g, {k}) AS before, {totals} FROM c{k} GROUP BY 1)",
            f"p{k} AS MATERIALIZED (SELECT c.g, {mixed('a', 'na', 'ta', 'pa')} AS pa, {mixed('r', 'nr', 'tr', 'pr')} AS pr FROM c{k} c JOIN t{k} t ON left(c.g, {k}) = t.before JOIN p{k - 1} p ON right(c.g, {k}) = p.g)",
        ]
    bin_ = f"CAST(greatest({-FAR * BINS}, least({FAR * BINS}, floor(score * {BINS}))) AS INTEGER)"
    return f"""
    WITH u0 AS (SELECT {key}, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u1 AS (SELECT {key}, url, translate(regexp_extract(rest, '^[^/?#]*'), '{CAPITALS}', '{SMALL}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u0),
    u AS MATERIALIZED (
      SELECT *, {choice(1)} AS rule, {choice(0)} AS says, CASE {choice(0)} WHEN 'allow' THEN 1 WHEN 'block' THEN 0 END AS mark,
        CAST('0x' || left(md5(url), 1) AS INTEGER) < {HELD} AS held, row_number() OVER () AS id FROM u1),
    w AS MATERIALIZED (
      SELECT id, CASE WHEN NOT held THEN mark END AS learn,
        substr(repeat(chr({ord(START)}), {ORDER}) || url || chr({ord(END)}), CAST(spot AS INTEGER), {ORDER + 1}) AS gram
      FROM (SELECT *, unnest(range(1, length(url) + 2)) AS spot FROM u)),
    g AS MATERIALIZED (SELECT gram, count(*) FILTER (learn = 1) AS a, count(*) FILTER (learn = 0) AS r FROM w GROUP BY 1),
    {", ".join(levels)},
    d AS MATERIALIZED (SELECT g, CAST(floor((ln(pa) - ln(pr)) * {MILLION} + 0.5) AS BIGINT) AS d FROM p{ORDER}),
    s AS (SELECT id, CAST(sum(d) AS DOUBLE) / (count(*) * {MILLION}) AS score FROM w JOIN d ON w.gram = d.g GROUP BY id),
    j AS MATERIALIZED (SELECT *, {bin_} AS bin FROM u JOIN s USING (id)),
    n AS (SELECT count(*) FILTER (mark = 1) AS accepted, count(*) FILTER (mark = 0) AS rejected FROM j WHERE held),
    e AS (SELECT b, (SELECT count(*) FROM j WHERE held AND mark = 1 AND bin >= b) * rejected + (SELECT count(*) FROM j WHERE held AND mark = 0 AND bin < b) * accepted AS correct
      FROM range({-FAR * BINS}, {FAR * BINS + 1}) x(b), n),
    l AS (SELECT CASE WHEN any_value(accepted) * any_value(rejected) = 0 THEN 0 ELSE arg_max(b, correct * {4 * FAR * BINS}::HUGEINT * 2 - abs(b) * 2 - CASE WHEN b > 0 THEN 1 ELSE 0 END) END AS least FROM e, n)
    SELECT {key}, host, path, rule, coalesce(says, CASE WHEN bin >= least THEN 'allow' ELSE 'block' END) AS verdict, score FROM j, l"""
