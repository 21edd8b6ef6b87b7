"""Queries of sequence functions, advantages, losses, rewards and similarity metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import lexer as X
from tessera.functions import maths as M
from tessera.functions import text as T
from tessera.operators import advantage as V
from tessera.operators import metrics as S
from tessera.operators import rewards as W
from tessera.plans.fixtures import AROUND, SAMPLES, documents, samples, table
from tessera.sources.scratch import kept

#: Responses: sixteen events in order of their ids each; four responses of a group.
_ROLL = """tok AS (SELECT event_id // 16 AS row_idx, event_id // 64 AS uid, event_id % 16 AS t, round(value, 2) AS r, (event_id % 7) / 10.0 AS v, CAST(event_id % 5 <> 3 AS INTEGER) AS m,
    -round(value % 3, 2) AS a, -round(value % 2, 2) AS b FROM events),
  resp AS (SELECT row_idx, any_value(uid) AS uid, sum(r) AS score, list(r ORDER BY t) AS rewards, list(m ORDER BY t) AS mask, count(*) AS n FROM tok GROUP BY row_idx)"""


def responses(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    key = F.col("event_id")
    tok = e.select(F.floor(key / 16).alias("row_idx"), F.floor(key / 64).alias("uid"), F.struct((key % 16).alias("t"), F.round("value", 2).alias("r"), ((key % 7) / 10).alias("v"), (key % 5 != 3).cast("int").alias("m"), (-F.round(F.col("value") % 3, 2)).alias("a"), (-F.round(F.col("value") % 2, 2)).alias("b")).alias("x"))
    g = tok.groupBy("row_idx").agg(F.min("uid").alias("uid"), F.sum("x.r").alias("score"), F.sort_array(F.collect_list("x")).alias("x"))
    pick = lambda c: F.transform("x", lambda s: s[c])
    return g.select("row_idx", "uid", "score", pick("r").alias("rewards"), pick("v").alias("values"), pick("m").alias("mask"), pick("a").alias("log_probs"), pick("b").alias("old_log_probs"))


#: Keeps decimal fractions off the middle between two rounded values, where engines differ.
_OFF = 0.0000123


def _scores(name: str, **options):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = responses(spark, folder).withColumn("baseline", F.col("uid") % 9 * 10.0)
        return V.compute(name, df, **options).select("row_idx", F.round("advantage", 6).alias("advantage"), F.round(A.total(F.col("advantages")), 5).alias("total"))

    return run


def _arrays(name: str, **options):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = responses(spark, folder).withColumn("baseline", F.col("uid") % 9 * 10.0)
        out = V.compute(name, df, **options)
        return out.select("row_idx", F.posexplode(F.arrays_zip("advantages", "returns")).alias("t", "x")).select("row_idx", "t", F.round(F.col("x.advantages") + _OFF, 4).alias("advantage"), F.round(F.col("x.returns") + _OFF, 4).alias("ret"))

    return run


_MASKED = "coalesce((SELECT sum(x) FROM (SELECT unnest(mask) AS x)), 0)"
_STD = "(stddev_samp(score) OVER w + 1e-6)"


def _group_sql(value: str) -> str:
    return f"WITH {_ROLL}, a AS (SELECT row_idx, mask, {value} AS v FROM resp WINDOW w AS (PARTITION BY uid)) SELECT row_idx, round(v, 6) AS advantage, round(v * list_sum(mask), 5) AS total FROM a"


def _whiten_sql(body: str) -> str:
    """``body`` defines x(row_idx, t, m, ret, adv)."""
    return f"""WITH RECURSIVE {_ROLL}, {body},
      mu AS (SELECT sum(adv * m) / (sum(m) + 1e-8) AS mu, sum(m) AS n FROM x),
      va AS (SELECT sum((adv - mu) ** 2 * m) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS va, any_value(mu) AS mu FROM x, mu)
      SELECT row_idx, CAST(t AS INTEGER) AS t, round((adv - mu) / sqrt(va + 1e-8) + {_OFF}, 4) AS advantage, round(ret + {_OFF}, 4) AS ret FROM x, va"""


_BACK = """s AS (SELECT row_idx, t, r, v, m, row_number() OVER (PARTITION BY row_idx ORDER BY t DESC) AS k FROM tok)"""
_REINFORCE = f"""{_BACK}, w AS (
    SELECT row_idx, t, m, k, r AS ret, r * m AS c FROM s WHERE k = 1
    UNION ALL SELECT s.row_idx, s.t, s.m, s.k, s.r + 0.9 * w.c, (s.r + 0.9 * w.c) * s.m FROM s JOIN w ON s.row_idx = w.row_idx AND s.k = w.k + 1),
  x AS (SELECT row_idx, t, m, ret, ret AS adv FROM w)"""
_GAE = f"""{_BACK}, w AS (
    SELECT row_idx, t, m, k, CASE WHEN m > 0 THEN v ELSE 0.0 END AS nv, CASE WHEN m > 0 THEN r - v ELSE 0.0 END AS last, v FROM s WHERE k = 1
    UNION ALL SELECT s.row_idx, s.t, s.m, s.k, CASE WHEN s.m > 0 THEN s.v ELSE w.nv END, CASE WHEN s.m > 0 THEN s.r + 0.9 * w.nv - s.v + 0.9 * 0.8 * w.last ELSE w.last END, s.v FROM s JOIN w ON s.row_idx = w.row_idx AND s.k = w.k + 1),
  x AS (SELECT row_idx, t, m, last + v AS ret, last AS adv FROM w)"""


def suffix(spark: SparkSession, folder: str) -> DataFrame:
    df = responses(spark, folder)
    ones = F.transform("mask", lambda m: F.lit(1))
    return df.select("row_idx", F.posexplode(A.suffix_sums(F.col("rewards"), ones)).alias("t", "x")).select("row_idx", "t", F.round("x", 6).alias("ret"))


def masks(spark: SparkSession, folder: str) -> DataFrame:
    ids = responses(spark, folder).select("row_idx", F.transform("values", lambda v: (v * 10).cast("int")).alias("ids"), "mask")
    two = ids.select("row_idx", A.response_mask(F.col("ids"), 3, 5).alias("rm"), A.position_ids(F.col("mask")).alias("pos"), F.size("ids").alias("n"))
    out = two.withColumn("after", A.response_positions(F.element_at("pos", -1), F.col("n")))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("row_idx", text("rm"), text("pos"), text("after"))


def ngram_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", T.tokens(F.col("text")).alias("t"))
    grams = F.transform(A.padded_ngrams(F.col("t"), 3, "<s>"), lambda g: F.array_join(g, " "))
    return docs.select("doc_id", F.array_join(grams, "|").alias("grams"))


def top_two(spark: SparkSession, folder: str) -> DataFrame:
    df = responses(spark, folder)
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "row_idx"))
    return df.withColumn("rank", rank).where("rank <= 2").select("uid", "rank", "row_idx", F.round("score", 6).alias("score"))


def first_last(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]{7,})"), F.lit(1))
    return docs.select("doc_id", F.regexp_extract("text", "([A-Za-z]{7,})", 1).alias("first"), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("last"))


def masked_stats(spark: SparkSession, folder: str) -> DataFrame:
    df = responses(spark, folder)
    per = df.select("row_idx", F.round(A.masked_mean(F.col("rewards"), F.col("mask")), 6).alias("mean"))
    white = V.whitened(df, "rewards").select("row_idx", F.round(A.total(F.col("rewards")), 4).alias("whitened"))
    return per.join(white, "row_idx")


def losses(spark: SparkSession, folder: str) -> DataFrame:
    df = responses(spark, folder)
    r = lambda mode: V.average_loss(df, "rewards", mode).select(F.lit(mode).alias("mode"), F.round("loss", 6).alias("loss"))
    return r("token").union(r("seq"))


def group_stats(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).groupBy("uid").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("std"), F.round(F.sum("score"), 6).alias("sum"), F.count("*").alias("n"))


def divergences(spark: SparkSession, folder: str) -> DataFrame:
    df = responses(spark, folder)
    each = [F.round(A.total(A.kl(F.col("log_probs"), F.col("old_log_probs"), k)), 5).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")]
    size = 4  # the values of a row by fours, as the distributions of its tokens
    rows = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(c) / size) - 1, F.lit(0)).cast("int")), lambda k: F.slice(c, k * size + 1, F.lit(size)))
    full = F.round(A.total(A.kl(rows("log_probs"), rows("old_log_probs"), "full")), 5).alias("full")
    return df.where(F.size("log_probs") >= size).select("row_idx", *each, full)


def shaped_rewards(spark: SparkSession, folder: str) -> DataFrame:
    df = responses(spark, folder)
    kld = A.product(A.kl(F.col("log_probs"), F.col("old_log_probs"), "kl"), F.col("mask"))
    return df.select("row_idx", F.round(A.total(F.zip_with("rewards", kld, lambda r, k: r - 0.05 * k)), 5).alias("shaped"))


def _policy(kind: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = responses(spark, folder).withColumn("advantages", F.transform("rewards", lambda r: r % 5 - 2))
        return V.policy_loss(df, kind=kind).select(*[F.round(c, 6).alias(c) for c in ("loss", "clipfrac_higher", "clipfrac_lower", "ppo_kl")])

    return run


def _policy_sql(kind: str) -> str:
    gap = "sum((a - b) * m) OVER (PARTITION BY row_idx) / (sum(m) OVER (PARTITION BY row_idx) + 1e-8)" if kind == "gspo" else "a - b"
    loss = "-adv * a * rc" if kind == "cispo" else "CASE WHEN adv < 0 THEN least(greatest(l1, l2), -adv * 3.0) ELSE greatest(l1, l2) END"
    return f"""WITH {_ROLL}, p AS (SELECT m, a, r - 5 * trunc(r / 5) - 2 AS adv, {gap} AS x FROM tok),
      q AS (SELECT *, exp(greatest(least(x, 20), -20)) AS ra, exp(greatest(least(x, ln(1.3)), ln(0.8))) AS rc FROM p), l AS (SELECT *, -adv * ra AS l1, -adv * rc AS l2 FROM q)
      SELECT round(sum(({loss}) * m) / (sum(m) + 1e-8), 6) AS loss, round(sum(CAST(l1 < l2 AS INTEGER) * m) / (sum(m) + 1e-8), 6) AS clipfrac_higher,
        round(sum(CAST(greatest(l1, l2) > -adv * 3.0 AND adv < 0 AS INTEGER) * m) / (sum(m) + 1e-8), 6) AS clipfrac_lower, round(sum(-x * m) / (sum(m) + 1e-8), 6) AS ppo_kl FROM l"""


def value_losses(spark: SparkSession, folder: str) -> DataFrame:
    df = responses(spark, folder).withColumn("predicted", F.zip_with("values", "rewards", lambda v, r: v + r % 2 - 1)).withColumn("returns", F.transform("rewards", lambda r: r % 3))
    return V.value_loss(df, 0.5).select(F.round("loss", 6).alias("loss"), F.round("clipfrac", 6).alias("clipfrac"))


def scalars(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("int").alias("n"), (F.col("p_partkey") % 100 / 100).alias("x"))
    size = M.resized(F.col("n") * 50, F.col("n") * 40 + 10, 1_000_000, 40_000)
    text = F.when(F.col("n") % 4 == 0, "inf").when(F.col("n") % 4 == 1, "x1").otherwise(F.col("x").cast("string"))
    return p.select(
        "p_partkey",
        F.round(M.from_distance(F.col("x") - 0.1), 9).alias("mt1"),
        F.round(M.held(F.col("x")), 9).alias("mt2"),
        F.round(M.visual(F.col("x"), 1 - F.col("x")), 9).alias("mt3"),
        F.round(M.code_score(F.col("x"), F.col("x") * 0.5), 9).alias("mt4"),
        F.round(M.overlong(F.col("n"), 40, 20), 9).alias("mt5"),
        size.w.alias("mt11_w"),
        size.h.alias("mt11_h"),
        M.points_to_pixels(F.col("n"), 100).alias("mt12"),
        M.ceildiv(F.col("n"), 7).alias("mt13"),
        F.round(M.edit_count(F.col("x"), F.col("n") - 3), 9).alias("mt15"),
        M.number(text, -1.0).alias("mt16"),
        T.empty(F.when(F.col("n") % 2 == 0, F.col("n"))).alias("mt17"),
    )


def cosines(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    c = M.cosine(F.col("embedding"), F.col("other"))
    return pairs.select("vec_id", F.round(c, 6).alias("cosine"), F.round(M.eval_similarity(c), 6).alias("evaluated"), F.round(M.reward_similarity(c), 6).alias("rewarded"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("ref"))
    return words.withColumn("hyp", F.slice("ref", F.lit(1) + (F.col("doc_id") % 4).cast("int"), F.greatest(F.size("ref") - 4, F.lit(0))))


_TOK = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
_PAIRS = f"pr AS (SELECT doc_id, ref, list_slice(ref, 1 + doc_id % 4, greatest(len(ref) - 4, 0) + doc_id % 4) AS hyp FROM (SELECT doc_id, {_TOK} AS ref FROM documents))"


def _unnest(side: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {n} AS n, unnest(list_transform(range(1, len({side}) - {n - 2}), lambda k: array_to_string(list_slice({side}, k, k + {n - 1}), chr(31)))) AS gram, {int(side == 'hyp')} AS h, {int(side == 'ref')} AS r FROM pr" for n in range(1, 5))


_TRIVIAL = "(SELECT n, gram FROM (SELECT n, gram, sum(r) AS c FROM g WHERE r = 1 GROUP BY n, gram) ORDER BY c DESC, n, gram LIMIT 50)"


def _bleu_sql(under: str, ignore: bool, corpus: bool = False) -> str:
    keep = f"WHERE (n, gram) NOT IN {_TRIVIAL}" if ignore else ""
    pool = "s" if not corpus else "(SELECT 0 AS doc_id, n, sum(matched) AS matched, sum(total) AS total FROM s GROUP BY n)"
    lens = "(SELECT doc_id, len(hyp) AS hl, len(ref) AS rl FROM pr)" if not corpus else "(SELECT 0 AS doc_id, sum(len(hyp)) AS hl, sum(len(ref)) AS rl FROM pr)"
    return f"""WITH {_PAIRS}, g AS ({_unnest('hyp')} UNION ALL {_unnest('ref')}),
      c AS (SELECT doc_id, n, gram, sum(h) AS h, sum(r) AS r FROM g {keep} GROUP BY ALL),
      s AS (SELECT doc_id, n, sum(least(h, r)) AS matched, sum(h) AS total, count(*) FILTER (h > 0) AS kinds FROM c GROUP BY ALL),
      l AS (SELECT doc_id, sum(ln(matched / {under})) FILTER (matched > 0) AS logs, count(*) FILTER (matched > 0) AS good FROM {pool} GROUP BY doc_id)
      SELECT {'' if corpus else 'doc_id, '}round(CASE WHEN good = 4 AND hl > 0 AND rl > 0 THEN CASE WHEN hl > rl THEN 1.0 ELSE exp(1 - rl / hl) END * exp(logs / 4) ELSE 0.0 END, 6) AS bleu FROM {lens} x LEFT JOIN l USING (doc_id)"""


def crystal(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.operators.stats import trivial_ngrams

    p = _pairs(spark, folder)
    trivial = trivial_ngrams(p, F.col("ref"), 50)
    return S.crystal_bleu(p, "doc_id", "hyp", "ref", trivial).withColumn("bleu", F.round("bleu", 6))


def fallback(spark: SparkSession, folder: str) -> DataFrame:
    return S.fallback_bleu(_pairs(spark, folder), "doc_id", "hyp", "ref").withColumn("bleu", F.round("bleu", 6))


def corpus_bleu(spark: SparkSession, folder: str) -> DataFrame:
    return S.corpus_bleu(_pairs(spark, folder), "doc_id", "hyp", "ref").withColumn("bleu", F.round("bleu", 6))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of a conversation as TeX, ``hyp``, with the turn before it, ``ref``."""
    c = table(spark, folder, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    tex = lambda x: F.concat(F.lit("\\documentclass{article} % c\n\\begin{document}\n\\draw (0,0); "), F.coalesce(x, F.lit("")), F.lit(" \\% $x_1$\\end{document}"))
    return c.select("conv_id", "turn", F.col("text"), before.alias("before")).select(F.concat_ws("/", "conv_id", "turn").alias("id"), tex(F.col("text")).alias("hyp"), tex(F.col("before")).alias("ref"))


def edit_distances(spark: SparkSession, folder: str) -> DataFrame:
    """The record of code metrics of every turn against the one before it."""
    from tessera.operators.stats import trivial_ngrams

    read = kept(S.code_tokens(_turns(spark, folder), "id", "hyp", "ref"))
    out = S.code_record(read, "id", trivial_ngrams(read, F.col("_rw"), 50))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("token_edit_dist_norm", "token_edit_dist", "token_edit_sim", "crystalbleu")])


def image_similarities(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as gray images of 32 columns, each against its own text turned round."""
    p = table(spark, folder, "pages").select("page_id", F.encode(F.regexp_replace("html", r"[^\x20-\x7e]", "~"), "ISO-8859-1").alias("a"), F.encode(F.reverse(F.regexp_replace("html", r"[^\x20-\x7e]", "~")), "ISO-8859-1").alias("b"))
    fill = lambda c: F.rpad(F.col(c), F.octet_length(c) + (32 - F.octet_length(c) % 32) % 32, F.lit(b" "))
    out = S.image_similarity(p.select("page_id", F.lit(32).alias("w"), fill("a").alias("a"), fill("b").alias("b")), "w", "a", "b")
    return out.select("page_id", F.round("ssim", 6).alias("ssim"), F.round(M.from_distance(1 - F.col("ssim"), 0.5), 6).alias("sim"))


def metric_table(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 10 / 10).alias("d"))
    return S.dispatched(p, {"lpips_sim": F.round(M.from_distance(F.col("d"), 0.5), 9), "dreamsim_sim": F.round(M.unit(1 - F.col("d")), 9)}, ("lpips_sim", "dreamsim_sim", "ssim")).drop("d")


def metric_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records from what was taken of some rows only."""
    k = F.col("p_partkey")
    p = table(spark, folder, "part").select(k, F.when(k % 3 == 0, float("nan")).otherwise(k / 100).alias("lpips_dist"), F.when(k % 4 != 0, k / 200).alias("ssim"), F.when(k % 5 == 0, float("nan")).otherwise(k / 300).alias("crystalbleu"))
    return S.recorded(S.recorded(p, S.IMAGE_RECORD), S.CODE_RECORD)


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    s = samples(spark, folder)
    truth = F.when(F.col("doc_id") % len(AROUND) == 8, "1234").when(F.col("doc_id") % len(AROUND) == 9, "1").when(F.col("doc_id") % len(AROUND) == 11, r"\frac{1}{2}").otherwise("7")
    return s.select("doc_id", F.concat("tex", F.lit("\nAnswer: 1,234 dollars")).alias("response"), F.col("tex").alias("plain"), truth.alias("ground_truth"), F.length("tex").alias("response_length"))


_ANSWERS = f"ans AS (SELECT doc_id, tex || chr(10) || 'Answer: 1,234 dollars' AS response, tex AS plain, CASE doc_id % {len(AROUND)} WHEN 8 THEN '1234' WHEN 9 THEN '1' WHEN 11 THEN '\\frac{{1}}{{2}}' ELSE '7' END AS ground_truth, length(tex) AS response_length FROM {SAMPLES} s)"


def dapo(spark: SparkSession, folder: str) -> DataFrame:
    out = W.scored(_answers(spark, folder), "dapo", max_length=180, buffer=60, factor=0.5)
    return out.select("doc_id", *[F.round(f"reward.{c}", 6).alias(c) for c in ("overall", "accuracy", "overlong", "accuracy_normalized")])


def math_reward(spark: SparkSession, folder: str) -> DataFrame:
    df = _answers(spark, folder).withColumn("response", F.col("plain"))
    return W.scored(df, "math").select("doc_id", *[F.round(f"reward.{c}", 6).alias(c) for c in ("overall", "format", "accuracy")])


def equal_fractions(spark: SparkSession, folder: str) -> DataFrame:
    """Fractions in several spellings, half of which are equal."""
    a, b = F.col("p_partkey") % 40 + 1, F.col("p_size") % 12 + 1
    c, d = F.when(F.col("p_partkey") % 2 == 0, a * 3).otherwise(a + 1), F.when(F.col("p_partkey") % 2 == 0, b * 3).otherwise(b)
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    given = F.when(F.col("p_partkey") % 3 == 0, text("\\frac{", a, "}{", b, "}")).when(F.col("p_partkey") % 3 == 1, text("x = ", a * 100, "\\% / ", b)).otherwise(text("(", a, "\\cdot\\sqrt{4}, -\\sqrt{", b * b * 2, "})"))
    truth = F.when(F.col("p_partkey") % 3 != 2, text("$\\dfrac{", c, "}{", d, "}$")).otherwise(text("\\left(", a * 2, ", -", F.when(F.col("p_partkey") % 2 == 0, b).otherwise(b + 1), "\\sqrt2\\right)"))
    rows = table(spark, folder, "part").select("p_partkey", given.alias("given"), truth.alias("truth"))
    return W.same_answers(rows, "given", "truth", "same").select("p_partkey", "same")


def r1v(spark: SparkSession, folder: str) -> DataFrame:
    df = _answers(spark, folder).withColumn("response", F.when(F.col("doc_id") % 2 == 0, "<think> a </think> <answer>1</answer>").otherwise(F.col("plain")))
    return W.scored(df, "r1v").select("doc_id", *[F.round(f"reward.{c}", 6).alias(c) for c in ("overall", "format", "accuracy")])


def choice(spark: SparkSession, folder: str) -> DataFrame:
    return W.scored(_answers(spark, folder).withColumn("response", F.col("plain")), "choice").select("doc_id", "reward.overall", "reward.accuracy")


def consistency(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, folder, "part").select(
        k, (k % 5 != 0).alias("compiled"), (k % 50 / 50).alias("semantic"), (k % 40 / 40).alias("structural"), (k % 300 * 4 + 1).alias("width"), (F.lit(0) * k + 60).alias("height"),
        F.col("p_name").alias("code"), F.when(k % 3 != 0, F.col("p_name")).alias("code_prime"), (k % 20 / 20).alias("bleu"), (k % 10 / 10).alias("edit_sim"), F.when(k % 7 == 0, "").otherwise("x.png").alias("image_path"),
    )
    keep = ("score", "r_compile", "r_visual", "r_code", "cycle_enter", "cycle_aspect_ok", "cycle_code_len", "code_similarity", "visual_consistency", "compile_success")
    return W.scored(p, "self_consistency").select("p_partkey", *[F.round(f"reward.{c}", 9).alias(c) for c in keep])


def reward_tensor(spark: SparkSession, folder: str) -> DataFrame:
    df = responses(spark, folder).select("row_idx", F.round("score", 2).alias("score"), F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("length"), F.size("mask").alias("n"))
    out = df.select("row_idx", F.posexplode(A.placed_score(F.col("score"), F.col("length"), F.col("n"))).alias("t", "x"))
    return out.where("x <> 0")


def judge(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(F.lit('Fine.\n{"correctness": '), (F.col("p_partkey") % 7).cast("string"), F.lit(', "layout_precision": 3, "readability": 4, "scientific_plausibility": 5, "visual_complexity": 1, "total_score": '), (F.col("p_partkey") % 7 + F.lit(13) + (F.col("p_partkey") % 11 == 0).cast("int")).cast("string"), F.lit("}\n"))
    p = table(spark, folder, "part").select("p_partkey", W.judged(line).alias("j"))
    return p.select("p_partkey", "j.correctness", "j.total_score", "j.valid")


_R = "round({0}, 9)"
_SCALARS = """SELECT p_partkey, round(exp(-greatest(0, x - 0.1) / 0.3), 9) AS mt1, round(h, 9) AS mt2, round(least(greatest(0.4 * h + 0.6 * (1 - x), 0), 1), 9) AS mt3, round(least(greatest(0.7 * x + 0.3 * x * 0.5, 0), 1), 9) AS mt4,
  round(CASE WHEN n <= 20 THEN 0.0::DOUBLE WHEN n <= 40 THEN (20 - n) / 20 ELSE -1.0 END, 9) AS mt5,
  CAST(CASE WHEN w1 * h1 < 40000 THEN trunc(w1 * sqrt(40000.0 / (w1 * h1))) ELSE w1 END AS INTEGER) AS mt11_w, CAST(CASE WHEN w1 * h1 < 40000 THEN trunc(h1 * sqrt(40000.0 / (w1 * h1))) ELSE h1 END AS INTEGER) AS mt11_h,
  CAST(round_even(n * 100 / 72, 0) AS INTEGER) AS mt12, CAST(ceil(n / 7) AS BIGINT) AS mt13, round(x * greatest(n - 3, 1), 9) AS mt15, CASE n % 4 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN -1.0 ELSE x END AS mt16, CASE WHEN n % 2 = 0 THEN CAST(n AS VARCHAR) ELSE '' END AS mt17
  FROM (SELECT *, least(greatest((x - 0.8) / (1 - 0.8::DOUBLE), 0), 1) AS h, CASE WHEN w0 * h0 > 1000000 THEN trunc(w0 * sqrt(1000000.0 / (w0 * h0))) ELSE w0 END AS w1, CASE WHEN w0 * h0 > 1000000 THEN trunc(h0 * sqrt(1000000.0 / (w0 * h0))) ELSE h0 END AS h1
    FROM (SELECT p_partkey, CAST(p_size AS INTEGER) AS n, (p_partkey % 100) / 100 AS x, CAST(p_size AS INTEGER) * 50 AS w0, CAST(p_size AS INTEGER) * 40 + 10 AS h0 FROM part))"""


def _answer_sql(x: str) -> str:
    from tessera.plans.strings import _answer

    return _answer(x)


_LAST = "substr(response, greatest(length(response) - 299, 1), 300)"
_FOUND = rf"regexp_extract_all({_LAST}, '(?i)Answer\s*:\s*([^\n]+)', 1)"
_RIGHT = f"CASE WHEN {_answer_sql(f'list_last({_FOUND})')} = {_answer_sql('ground_truth')} THEN 1.0::DOUBLE ELSE -1.0 END"
_LONG = "CASE WHEN response_length <= 120 THEN 0.0::DOUBLE WHEN response_length <= 180 THEN (120 - response_length) / 60 ELSE -1.0 END"
_SQUEEZED = r"regexp_replace(plain, '\s*([<>/])\s*', '\1', 'g')"
_BOXED = rf"coalesce(list_last(regexp_extract_all({_SQUEEZED}, '\\boxed\{{([^{{}}]*)\}}', 1)), '')"
_GOOD = rf"CAST(regexp_matches({_SQUEEZED}, '(?s)\A<think>.*</think>.*\\boxed\{{.*\}}.*\z') AS DOUBLE)"
_R1 = "CASE WHEN doc_id % 2 = 0 THEN '<think> a </think> <answer>1</answer>' ELSE plain END"
_R1G = rf"CAST(regexp_matches(q, '(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z') AS DOUBLE)"
_R1A = r"CAST(trim(CASE WHEN regexp_matches(q, '<answer>(.*?)</answer>') THEN regexp_extract(q, '<answer>(.*?)</answer>', 1) ELSE regexp_replace(q, '\A\s+|\s+\z', '', 'g') END) = ground_truth AS DOUBLE)"
_CONS = """WITH p AS (SELECT p_partkey, p_name, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS ok, (p_partkey % 50) / 50 AS sem, (p_partkey % 40) / 40 AS str, p_partkey % 300 * 4 + 1 AS w, p_partkey % 3 <> 0 AS second, (p_partkey % 20) / 20 AS bleu, (p_partkey % 10) / 10 AS es FROM part),
  v AS (SELECT *, least(greatest((0.4 * least(greatest((sem - 0.8) / (1 - 0.8::DOUBLE), 0), 1) + 0.6 * str) / (0.4::DOUBLE + 0.6), 0), 1) AS vis, greatest(w, 60) / least(w, 60) <= 15 AS shaped FROM p),
  e AS (SELECT *, vis > 0.5 AND second AND shaped AS enter FROM v), c AS (SELECT *, CASE WHEN enter THEN least(greatest(0.7 * bleu + 0.3 * es, 0), 1) ELSE 0.0 END AS c FROM e),
  r AS (SELECT *, CASE WHEN NOT enter THEN 0.0 WHEN c >= 0.6 THEN (c - 0.6) / (1 - 0.6::DOUBLE) * 0.15 ELSE greatest(-(0.6 - c) / 0.6 * 0.1, -0.1) END AS rc FROM c)
  SELECT p_partkey, round(CASE WHEN ok THEN greatest(least(0.1 + vis * 0.8 + rc, 1), -1) ELSE -0.8 END, 9) AS score, CASE WHEN ok THEN 0.1::DOUBLE ELSE -0.8 END AS r_compile, round(CASE WHEN ok THEN vis * 0.8 ELSE 0 END, 9) AS r_visual, round(CASE WHEN ok THEN rc ELSE 0 END, 9) AS r_code,
    CAST(ok AND enter AS DOUBLE) AS cycle_enter, CAST(ok AND shaped AS DOUBLE) AS cycle_aspect_ok, CASE WHEN ok THEN CAST(length(p_name) AS DOUBLE) ELSE 0 END AS cycle_code_len, round(CASE WHEN ok THEN c ELSE 0 END, 9) AS code_similarity, round(CASE WHEN ok THEN vis ELSE 0 END, 9) AS visual_consistency, CAST(ok AS DOUBLE) AS compile_success FROM r"""

QUERIES = {
    "wn1_wn3_suffix_sums": suffix,
    "wn4_wn5_masks_positions": masks,
    "wn6_padded_ngrams": ngram_windows,
    "wn7_top_two": top_two,
    "wn8_first_last_match": first_last,
    "adv1_grpo": _scores("grpo"),
    "adv2_grpo_passk": _scores("grpo_passk"),
    "adv3_rloo": _scores("rloo"),
    "adv4_wn1_reinforce_plus_plus": _arrays("reinforce_plus_plus", gamma=0.9),
    "adv5_remax": _scores("remax"),
    "adv6_wn2_gae": _arrays("gae", gamma=0.9, lam=0.8),
    "ag11_masked_stats": masked_stats,
    "ag12_average_loss": losses,
    "ag13_group_stats": group_stats,
    "mt6_kl_estimators": divergences,
    "mt7_kl_shaped_rewards": shaped_rewards,
    "mt9_policy_loss": _policy("default"),
    "mt9_policy_loss_gspo": _policy("gspo"),
    "mt9_policy_loss_cispo": _policy("cispo"),
    "mt10_value_loss": value_losses,
    "mt1_mt17_scalars": scalars,
    "sm5_cosine": cosines,
    "sm2_crystal_bleu": crystal,
    "sm3_sm4_fallback_bleu": fallback,
    "ag16_corpus_bleu": corpus_bleu,
    "sm1_sm10_edit_distance": edit_distances,
    "sm7_image_similarity": image_similarities,
    "sm6_sm8_sm9_metric_table": metric_table,
    "rec1_metric_records": metric_records,
    "mt9_policy_loss_gspo_token": _policy("gspo_token"),
    "rw2_dapo": dapo,
    "rw3_math": math_reward,
    "rw3_equal_fractions": equal_fractions,
    "rw4_ux1_ux7_r1v": r1v,
    "rw5_choice": choice,
    "rw1_self_consistency": consistency,
    "rw6_reward_tensor": reward_tensor,
    "rw7_judge": judge,
}
ORACLE = {
    "wn1_wn3_suffix_sums": f"WITH {_ROLL} SELECT row_idx, CAST(t AS INTEGER) AS t, round(sum(r) OVER (PARTITION BY row_idx ORDER BY t DESC), 6) AS ret FROM tok",
    "wn4_wn5_masks_positions": f"""WITH {_ROLL}, x AS (SELECT row_idx, t, CAST(sum(CAST(CAST(v * 10 AS INTEGER) IN (3, 5) AS INTEGER)) OVER w - CAST(CAST(v * 10 AS INTEGER) IN (3, 5) AS INTEGER) = 0 AS INTEGER) AS rm, greatest(sum(m) OVER w - 1, 0) AS pos, count(*) OVER (PARTITION BY row_idx) AS n FROM tok WINDOW w AS (PARTITION BY row_idx ORDER BY t))
      SELECT row_idx, string_agg(CAST(rm AS VARCHAR), ',' ORDER BY t) AS rm, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY t) AS pos, array_to_string(range(max(pos)::BIGINT + 1, max(pos)::BIGINT + 1 + max(n)), ',') AS after FROM x GROUP BY row_idx""",
    "wn6_padded_ngrams": r"WITH d AS (SELECT doc_id, list_concat(list_concat(['<s>', '<s>'], list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')), ['<s>', '<s>']) AS t FROM documents) SELECT doc_id, array_to_string(list_transform(range(1, len(t) - 1), lambda k: array_to_string(list_slice(t, k, k + 2), ' ')), '|') AS grams FROM d",
    "wn7_top_two": f"WITH {_ROLL} SELECT uid, rank, row_idx, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_idx) AS INTEGER) AS rank FROM resp) WHERE rank <= 2",
    "wn8_first_last_match": "SELECT doc_id, regexp_extract(text, '([A-Za-z]{7,})', 1) AS first, coalesce(list_last(regexp_extract_all(text, '([A-Za-z]{7,})', 1)), '') AS last FROM documents",
    "adv1_grpo": _group_sql(f"(score - avg(score) OVER w) / {_STD}"),
    "adv2_grpo_passk": f"WITH {_ROLL}, k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_idx) AS k, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, row_idx) AS second, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM resp), a AS (SELECT row_idx, mask, CASE WHEN k = 1 THEN (score - second) / (sd + 1e-6) ELSE 0.0 END AS v FROM k) SELECT row_idx, round(v, 6) AS advantage, round(v * list_sum(mask), 5) AS total FROM a",
    "adv3_rloo": _group_sql("score - (sum(score) OVER w - score) / nullif(count(*) OVER w - 1, 0)"),
    "adv4_wn1_reinforce_plus_plus": _whiten_sql(_REINFORCE),
    "adv5_remax": _group_sql("score - uid % 9 * 10.0"),
    "adv6_wn2_gae": _whiten_sql(_GAE),
    "ag11_masked_stats": f"WITH {_ROLL}, mu AS (SELECT sum(r * m) / (sum(m) + 1e-8) AS mu, sum(m) AS n FROM tok), va AS (SELECT sum((r - mu) ** 2 * m) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS va, any_value(mu) AS mu FROM tok, mu) SELECT row_idx, round(sum(r * m) / (sum(m) + 1e-8), 6) AS mean, round(sum((r - mu) / sqrt(va + 1e-8)), 4) AS whitened FROM tok, va GROUP BY row_idx",
    "ag12_average_loss": f"WITH {_ROLL}, q AS (SELECT sum(r * m) AS x, sum(m) AS m FROM tok GROUP BY row_idx) SELECT 'token' AS mode, round(sum(x) / (sum(m) + 1e-8), 6) AS loss FROM q UNION ALL SELECT 'seq', round(avg(x / (m + 1e-8)), 6) FROM q",
    "ag13_group_stats": f"WITH {_ROLL} SELECT uid, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(sum(score), 6) AS sum, count(*) AS n FROM resp GROUP BY uid",
    "mt6_kl_estimators": f"WITH {_ROLL} SELECT row_idx, round(sum(a - b), 5) AS kl, round(sum(abs(a - b)), 5) AS abs, round(sum(0.5 * (a - b) ** 2), 5) AS mse, round(sum(greatest(least(exp(greatest(least(b - a, 20), -20)) - greatest(least(b - a, 20), -20) - 1, 10), -10)), 5) AS low_var_kl, round(sum(exp(a) * (a - b)) FILTER (t < n // 4 * 4), 5) AS full FROM (SELECT *, count(*) OVER (PARTITION BY row_idx) AS n FROM tok) WHERE n >= 4 GROUP BY row_idx",
    "mt7_kl_shaped_rewards": f"WITH {_ROLL} SELECT row_idx, round(sum(r - 0.05 * (a - b) * m), 5) AS shaped FROM tok GROUP BY row_idx",
    "mt9_policy_loss": _policy_sql("default"),
    "mt9_policy_loss_gspo": _policy_sql("gspo"),
    "mt9_policy_loss_cispo": _policy_sql("cispo"),
    "mt10_value_loss": f"WITH {_ROLL}, p AS (SELECT m, v, v + (r - 2 * trunc(r / 2)) - 1 AS p, r - 3 * trunc(r / 3) AS ret FROM tok), q AS (SELECT m, (p - ret) ** 2 AS x, (greatest(least(p, v + 0.5), v - 0.5) - ret) ** 2 AS y FROM p) SELECT round(0.5 * sum(greatest(x, y) * m) / (sum(m) + 1e-8), 6) AS loss, round(sum(CAST(x < y AS INTEGER) * m) / (sum(m) + 1e-8), 6) AS clipfrac FROM q",
    "mt1_mt17_scalars": _SCALARS,
    "sm5_cosine": "WITH p AS (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(c, 6) AS cosine, round(least(greatest(c, 0), 1), 6) AS evaluated, round((c + 1) / 2, 6) AS rewarded FROM p",
    "sm2_crystal_bleu": _bleu_sql("total", True),
    "sm3_sm4_fallback_bleu": _bleu_sql("kinds", False),
    "ag16_corpus_bleu": _bleu_sql("total", False, True),
    "sm6_sm8_sm9_metric_table": "SELECT p_partkey, round(exp(-d / 0.5), 9) AS lpips_sim, round(1 - d, 9) AS dreamsim_sim, CAST(NULL AS DOUBLE) AS ssim FROM (SELECT p_partkey, (p_partkey % 10) / 10 AS d FROM part)",
    "rec1_metric_records": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey / 100 END AS lpips_dist, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey / 200 ELSE 0.0 END AS ssim, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_partkey / 300 END AS crystalbleu, "
    + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("siglip_cos", "clip_cos", "dreamsim_dist", "token_edit_dist", "token_edit_dist_norm"))
    + ", "
    + ", ".join(f"0.0::DOUBLE AS {c}" for c in ("siglip_sim", "clip_sim", "lpips_sim", "dreamsim_sim", "token_edit_sim"))
    + " FROM part",
    "mt9_policy_loss_gspo_token": _policy_sql("gspo"),
    "rw2_dapo": f"WITH {_ANSWERS} SELECT doc_id, round({_RIGHT} + ({_LONG}) * 0.5, 6) AS overall, {_RIGHT} AS accuracy, round({_LONG}, 6) AS overlong, 0.5 * ({_RIGHT} + 1) AS accuracy_normalized FROM ans",
    "rw3_equal_fractions": "SELECT p_partkey, p_partkey % 2 = 0 AS same FROM part",
    "rw3_math": f"WITH {_ANSWERS}, t AS (SELECT doc_id, ground_truth, {_GOOD} AS format, contains({_SQUEEZED}, '\\boxed{{') AS boxed, list_last(string_split({_SQUEEZED}, '\\boxed{{')) AS tail FROM ans), p AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM (SELECT doc_id, regexp_extract_all(tail, '[^{{}}]*[{{}}]') AS pieces FROM t WHERE boxed)), d AS (SELECT doc_id, sum(length(piece)) OVER w AS n, sum(CASE WHEN ends_with(piece, '{{') THEN 1 ELSE -1 END) OVER w AS depth FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)), e AS (SELECT doc_id, min(n) - 1 AS stop FROM d WHERE depth = -1 GROUP BY doc_id), q AS (SELECT doc_id, format, CAST({_answer_sql("coalesce(regexp_replace(substr(tail, 1, CAST(stop AS BIGINT)), '^[ \t\n]+|[ \t\n]+$', '', 'g'), 'None')")} = {_answer_sql('ground_truth')} AS DOUBLE) AS accuracy FROM t LEFT JOIN e USING (doc_id)) SELECT doc_id, round(0.9 * accuracy + 0.1 * format, 6) AS overall, format, accuracy FROM q",
    "rw4_ux1_ux7_r1v": f"WITH {_ANSWERS}, p AS (SELECT doc_id, ground_truth, {_R1} AS q FROM ans), q AS (SELECT doc_id, {_R1G} AS format, {_R1A} AS accuracy FROM p) SELECT doc_id, 0.5 * accuracy + 0.5 * format AS overall, format, accuracy FROM q",
    "rw5_choice": f"WITH {_ANSWERS} SELECT doc_id, CAST(regexp_extract(plain, '[012]', 0) = ground_truth AS DOUBLE) AS overall, CAST(regexp_extract(plain, '[012]', 0) = ground_truth AS DOUBLE) AS accuracy FROM ans",
    "rw1_self_consistency": _CONS,
    "rw6_reward_tensor": f"WITH {_ROLL}, s AS (SELECT row_idx, CAST(sum(m) - 1 AS INTEGER) AS t, round(sum(r), 2) AS x FROM tok GROUP BY row_idx) SELECT * FROM s WHERE t >= 0 AND x <> 0",
    "rw7_judge": "SELECT p_partkey, CAST(p_partkey % 7 AS INTEGER) AS correctness, CAST(p_partkey % 7 + 13 + CAST(p_partkey % 11 = 0 AS INTEGER) AS INTEGER) AS total_score, p_partkey % 7 <= 5 AND p_partkey % 11 <> 0 AS valid FROM part",
}
