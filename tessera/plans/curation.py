"""Queries of filters, joins, batch algebra and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import filters as L
from tessera.operators import permutation as E
from tessera.operators import relational as R
from tessera.operators import stats as S
from tessera.plans.fixtures import documents, table

N, THRESHOLD = 3, 5
#: Parts of padded batches; no factor of the orders' number.
PARTS = 7
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
#: DuckDB: the largest number of equal n-grams of each document, without a join on whole texts.
_REPEATS = f"""rep AS (
  SELECT doc_id, max(n) AS most FROM (
    SELECT doc_id, g, count(*) AS n FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(t) - {N - 2}), lambda k: array_to_string(list_slice(t, k, k + {N - 1}), chr(31)))) AS g FROM tok)
    GROUP BY doc_id, g) GROUP BY doc_id)"""


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), L.max_repeats(F.col("t"), N).alias("repeats"))


def curation_report(spark: SparkSession, folder: str) -> DataFrame:
    """Length profile of the documents and how many the filters flag, in one pass."""
    flags = _flags(spark, folder).withColumn("bad", (F.col("repeats") >= THRESHOLD) | (F.col("n_tokens") > 2000))
    cut = [F.coalesce(F.percentile("n_tokens", F.lit(p / 100)).cast("int"), F.lit(0)).alias(f"p{p}") for p in S.PERCENTILES]
    return flags.agg(F.count("*").alias("docs"), F.count_if("bad").alias("flagged"), *cut, F.max("n_tokens").alias("longest"), F.round(F.avg("n_tokens"), 6).alias("mean"))


def repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the documents in a fence, some without an id."""
    key = F.when(F.col("doc_id") % 13 != 0, F.col("doc_id")).alias("doc_id")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Sure: ```latex\n"), "text", F.lit("\n``` done"))).otherwise(F.col("text")).alias("text")
    return L.repetitive(documents(spark, folder).select(key, text), "doc_id", "text", fenced=True, n=N, threshold=THRESHOLD)


def token_length(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.where(L.too_long(F.col("text"), 500)).select("doc_id")


def overlong_prompts(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").where("role = 'user'")
    return turns.where(F.size(T.tokens(F.col("text"))) <= 20).select("conv_id", "turn")


def overlong_media(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as prompts with one to three images, every third with a video; sizes from ids, some missing."""
    k = F.col("doc_id")
    size = lambda n: F.struct((k * (37 + n) % 5000).alias("width"), F.when(k % 97 != 96, k * (53 + n) % 4000).alias("height"), (k % 30).alias("frames"))
    images = F.slice(F.array(size(1), size(2), size(3)), F.lit(1), (k % 3 + 1).cast("int"))
    videos = F.when(k % 3 == 0, F.array(F.struct((k % 800).alias("width"), (k % 600).alias("height"), (k % 30).alias("frames"))))
    return documents(spark, folder).select("doc_id", L.overlong(F.col("text"), 9000, images, videos).alias("overlong"))


_GEOMETRY = "CAST(p_size * 13 AS INTEGER) AS w, CAST(p_partkey % 700 * 10 AS INTEGER) AS h"


def _images(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", (F.col("p_size") * 13).cast("int").alias("w"), (F.col("p_partkey") % 700 * 10).cast("int").alias("h"))


def geometry(spark: SparkSession, folder: str) -> DataFrame:
    return _images(spark, folder).select("p_partkey", L.bad_geometry(F.col("w"), F.col("h")).alias("bad"))


def second_stage(spark: SparkSession, folder: str) -> DataFrame:
    i = _images(spark, folder)
    return i.select("p_partkey", L.ready_for_second_stage(F.col("p_partkey") % 3 != 0, F.col("h") * 3, F.col("w"), F.col("h")).alias("ready"))


def status_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "OK").when(F.col("doc_id") % 3 == 1, "api_error: x").alias("status"))
    ok, bad = L.only_ok(rows)
    return ok.withColumn("kept", F.lit(True)).unionByName(bad.withColumn("kept", F.lit(False)))


def online_filter(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", (F.col("value") > 20).cast("double").alias("score"))
    return L.informative_groups(events, "user_id", "score", 0.3, 0.5).select("event_id", "user_id")


def usable_code(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit(" \n ")).when(F.col("doc_id") % 4 != 1, F.col("text")).alias("code"))
    return docs.select("doc_id", L.usable_code(F.col("code")).alias("code"))


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    return L.row_numbers(table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price")), "o_orderkey")


_BATCH = "b AS (SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders)"


def row_range(spark: SparkSession, folder: str) -> DataFrame:
    return R.range_of(_batch(spark, folder), 100, 250)


def projection(spark: SparkSession, folder: str) -> DataFrame:
    b = R.selected(_batch(spark, folder), ["row_idx", "price", "absent"])
    return R.renamed(R.merged_record(b, {"price": F.col("price") + 1}), {"price": "cost"})


def mask_select(spark: SparkSession, folder: str) -> DataFrame:
    b = _batch(spark, folder)
    return b.where((F.col("row_idx") % 7 == 3) & (F.col("price") > 1000)).select("row_idx", "o_orderkey")


def resume_anti(spark: SparkSession, folder: str) -> DataFrame:
    docs, done = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    return R.remaining(docs, done, "id", retry="quality = 0")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("doc_id") % 100 / 100).cast("double")).alias("similarity"), "toxic")
    image = labels.where("toxic = 0").select("id", "similarity")
    return R.against_truth(docs, (image, "pred_image"), (labels.select("id"), "pred_tex"))


_PAIRS = """pairs AS (SELECT d.doc_id AS id, n_chars, CASE WHEN l.toxic = 0 AND d.doc_id % 5 <> 0 THEN (d.doc_id % 100) / 100 END AS similarity,
  CAST(l.doc_id IS NOT NULL AND l.toxic = 0 AS INTEGER) AS has_pred_image, CAST(l.doc_id IS NOT NULL AS INTEGER) AS has_pred_tex
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def truth_join(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("id", "has_pred_image", "has_pred_tex", S.known(F.col("similarity")).alias("similarity"))


def missing(spark: SparkSession, folder: str) -> DataFrame:
    return R.missing_keys(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id")


def zip_union(spark: SparkSession, folder: str) -> DataFrame:
    b = _batch(spark, folder)
    return R.zipped(b.select("row_idx", "o_orderkey", "price"), b.select("row_idx", "price", "o_custkey")).select("row_idx", "o_orderkey", "price", "o_custkey")


def scatter(spark: SparkSession, folder: str) -> DataFrame:
    b = _batch(spark, folder)
    part = b.where("row_idx % 3 = 0").select("row_idx", F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("answer"))
    return R.scattered(b.select("row_idx"), part, "answer")


def repeat_rows(spark: SparkSession, folder: str) -> DataFrame:
    b = _batch(spark, folder).select("row_idx")
    a = R.repeated(b, 3).select("row_idx", "copy", "new_idx", F.lit("interleave").alias("mode"))
    return a.unionByName(R.repeated(b, 3, interleave=False).select("row_idx", "copy", "new_idx", F.lit("tile").alias("mode")))


def path_resolution(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("img"), F.col("c_custkey").cast("string")).alias("path"))
    listing = keys.where("id % 2 = 0").select(F.concat(F.lit("a/"), "path").alias("full")).union(keys.where("id % 3 = 0").select(F.concat(F.lit("b/"), "path")))
    return R.first_existing(keys, listing, ["a", "b"])


def permutation_inverse(spark: SparkSession, folder: str) -> DataFrame:
    """A batch is shuffled, and both the inverse order and the rows that it puts back are given."""
    b = _batch(spark, folder)
    order = L.row_numbers(b.select("row_idx", "o_orderkey", R.shuffled_key(F.col("o_orderkey"), 7).alias("k")), "k", "o_orderkey", name="new_idx").select("row_idx", "new_idx")
    inverse = R.inverse(order)
    back = R.reordered(R.reordered(b, order), inverse).select("row_idx", F.col("o_orderkey").alias("restored"))
    return inverse.join(back, "row_idx")


def profile(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.size(T.tokens(F.col("text"))).alias("n"))
    return S.length_profile(docs, "n").withColumn("mean", F.round("mean", 6))


def conditional_means(spark: SparkSession, folder: str) -> DataFrame:
    x, image, tex = F.col("similarity"), F.col("has_pred_image") == 1, F.col("has_pred_tex") == 1
    r = lambda c: F.round(c, 9)
    return _pairs(spark, folder).agg(r(S.mean_where(image, x)).alias("compiled_only"), r(S.mean_where(tex, x)).alias("all_tex"), r(S.mean_or_worst(x, 0.0)).alias("overall"), r(S.rate(image)).alias("compile_rate"), F.count("*").alias("n"))


def value_counter(spark: SparkSession, folder: str) -> DataFrame:
    return S.counter(table(spark, folder, "documents"), "lang")


def trivial(spark: SparkSession, folder: str) -> DataFrame:
    return S.trivial_ngrams(documents(spark, folder), T.tokens(F.col("text")), 100).select("n", F.replace("gram", F.lit("\x1f"), F.lit(" ")).alias("gram"), "count")


def corpus_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return S.fingerprint(table(spark, folder, "documents"), "text")


def reduced_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


def length_metrics(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.least("n_chars", F.lit(4000)).alias("n"))
    return S.length_metrics(docs, "n", 4000, "response").withColumns({"response_mean": F.round("response_mean", 6), "response_clip_ratio": F.round("response_clip_ratio", 9)})


def data_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics of a batch: sixteen events in order of their ids are a response."""
    k, v = F.col("event_id"), F.col("value")
    tok = table(spark, folder, "events").select(F.floor(k / 16).alias("row_idx"), F.struct((k % 16).alias("t"), v.alias("s"), (v - k % 3).alias("r"), (v / 2).alias("a"), (v * 0.9 + k % 3).alias("ret"), (k % 5 != 3).cast("int").alias("m")).alias("x"))
    g = tok.groupBy("row_idx").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pick = lambda c: F.transform("x", lambda s: s[c])
    batch = g.select(pick("s").alias("scores"), pick("r").alias("rewards"), pick("a").alias("advantages"), pick("ret").alias("returns"), pick("s").alias("values"), pick("m").alias("mask"))
    out = S.data_metrics(batch, critic=True)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_METRICS = ", ".join(f"round({f}({x}), 6) AS {name}_{c}" for x, name in (("a", "advantages"), ("ret", "returns"), ("s", "values")) for f, c in (("avg", "mean"), ("max", "max"), ("min", "min")))
_SUMS = ", ".join(f"round({f}({x}), 6) AS {name}_{c}" for x, name in (("s", "score"), ("r", "rewards")) for f, c in (("avg", "mean"), ("max", "max"), ("min", "min")))
SECONDS = {"gen": 12.5, "adv": 2.0, "other": 1.0, "step": 16.0}


def throughput(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select((F.col("n_chars") / 2).cast("bigint").alias("r"), "n_chars")
    out = S.timing_metrics(docs, "r", "n_chars", SECONDS, 8)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def batch_rates(spark: SparkSession, folder: str) -> DataFrame:
    code = L.usable_code(F.when(F.col("doc_id") % 4 == 0, F.lit(" ")).otherwise(F.col("text")))
    docs = table(spark, folder, "documents").select((F.col("doc_id") % 3 != 0).alias("rendered"), code.alias("code"))
    return docs.agg(F.round(S.rate(F.col("rendered")), 9).alias("p_render_ok"), F.round(S.rate(F.col("code").isNotNull()), 9).alias("p_codeprime_nonempty"), F.round(F.avg(F.length("code")), 6).alias("mean_length"))


def planned(spark: SparkSession, folder: str) -> DataFrame:
    return S.planned_ranges(_batch(spark, folder), 7).groupBy("part").agg(F.min("row_idx").alias("start"), F.max("row_idx").alias("end"))


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.size(T.tokens(F.col("text"))).alias("n"))
    return S.histogram(docs, "n", 120, 0, 4096)


MODELS = (S.Model("llama", 2048, 32000, 16, 16, 4, 5632), S.Model("qwen3_moe", 1024, 50000, 12, 16, 2, 768, head=128, experts=64, top=8), S.Model("other", 1, 1, 1, 1, 1, 1))


def flops(spark: SparkSession, folder: str) -> DataFrame:
    """A dense model, a mixture and an unknown family over all documents."""
    docs = table(spark, folder, "documents")
    return R.concatenated([S.tflops(docs, "n_chars", m, 10.0).select(F.lit(m.kind).alias("kind"), F.round("tflops", 3).alias("tflops"), F.lit(S.peak_tflops("NVIDIA A100")).alias("peak")) for m in MODELS])


def top_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return docs.withColumn("k", R.shuffled_key(F.col("doc_id"), 42)).orderBy("k", "doc_id").limit(25).select("doc_id", "k")


def truncated_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").where("value > 5").select("event_id")
    return rows.orderBy("event_id").limit(8 * 5)


def reorder(spark: SparkSession, folder: str) -> DataFrame:
    b = _batch(spark, folder)
    order = b.select("row_idx", (F.col("row_idx") * 37 % b.count()).alias("new_idx"))
    return R.reordered(b, order).select("row_idx", "o_orderkey")


def concat_batches(spark: SparkSession, folder: str) -> DataFrame:
    b = _batch(spark, folder)
    return R.concatenated([b.where("row_idx % 2 = 0"), b, b.where("row_idx % 2 = 1")]).select("row_idx", "price")


def pad_unpad(spark: SparkSession, folder: str) -> DataFrame:
    p = R.padded(_batch(spark, folder), PARTS)
    return p.select("row_idx", "o_orderkey", "is_pad").unionByName(R.unpadded(p).select((-F.col("row_idx") - 1).alias("row_idx"), "o_orderkey", F.lit(False).alias("is_pad")))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return R.chunked(R.padded(_batch(spark, folder), PARTS), PARTS).select("row_idx", "chunk")


def folds(spark: SparkSession, folder: str) -> DataFrame:
    return R.folded(_batch(spark, folder), 10, "o_orderkey").select("fold", F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("keys"))


def minibatches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return R.minibatches(docs, 16, 2, 5, "doc_id", L.row_numbers).select("epoch", "batch", "place", "doc_id")


def permuted(spark: SparkSession, folder: str) -> DataFrame:
    """Three epochs in orders of their own, from the tenth batch on: where an earlier run ended."""
    docs = L.row_numbers(table(spark, folder, "documents").select("doc_id"), "doc_id")
    return E.permuted_batches(docs, 16, 3, 5, done=10).select("epoch", "batch", "place", "doc_id")


def chained(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint of the documents in the order of their ids, and in that of their lengths."""
    docs = documents(spark, folder).select("doc_id", "text", "n_chars")
    by_id = S.ordered_fingerprint(docs, "text", "doc_id").select("rows", "chain", F.lit("id").alias("sorted"))
    return by_id.unionByName(S.ordered_fingerprint(docs, "text", "n_chars", "doc_id").select("rows", "chain", F.lit("length").alias("sorted")))


def accumulate(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that inform, from batch after batch of 250 events, until there are 64 rows; as the SQL, batches may leave nothing."""
    e = table(spark, folder, "events").select("event_id", "user_id", (F.col("value") > 20).cast("double").alias("score"))
    keep = lambda b: L.informative_groups(b, ["batch", "user_id"], "score", 0.05, 0.95)
    return L.accumulated(L.ranges_of_batches(e, "event_id", 250), keep, 64, "event_id", strict=False).select("event_id")


_NGRAMS = " UNION ALL ".join(f"SELECT {n} AS n, unnest(list_transform(range(1, len(t) - {n - 2}), lambda k: array_to_string(list_slice(t, k, k + {n - 1}), chr(31)))) AS gram FROM tok" for n in range(1, 5))
_TOK = f"tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents)"
_CUT = ", ".join(f"coalesce(CAST(trunc(quantile_cont(n_tokens, {p / 100})) AS INTEGER), 0) AS p{p}" for p in S.PERCENTILES)

QUERIES = {
    "curation_report": curation_report,
    "flt1_flt2_repetition": repetition,
    "flt3_image_geometry": geometry,
    "flt5_token_length": token_length,
    "flt6_overlong_prompts": overlong_prompts,
    "flt7_status_filter": status_filter,
    "flt9_online_filter": online_filter,
    "flt10_second_stage": second_stage,
    "flt11_usable_code": usable_code,
    "src4_row_range": row_range,
    "prj1_prj3_projection": projection,
    "prj2_mask_select": mask_select,
    "jn1_resume_anti_join": resume_anti,
    "jn2_truth_join": truth_join,
    "jn3_snk11_missing": missing,
    "jn4_zip_union": zip_union,
    "jn5_scatter_back": scatter,
    "jn6_so2_repeat": repeat_rows,
    "jn7_path_resolution": path_resolution,
    "jn8_permutation_inverse": permutation_inverse,
    "ag1_length_profile": profile,
    "ag2_ag3_conditional_means": conditional_means,
    "ag4_value_counter": value_counter,
    "ag5_trivial_ngrams": trivial,
    "ag6_corpus_fingerprint": corpus_fingerprint,
    "ag6_ordered_fingerprint": chained,
    "ag7_reduce_metrics": reduced_metrics,
    "ag8_length_metrics": length_metrics,
    "ag9_data_metrics": data_metrics,
    "ag10_throughput": throughput,
    "ag14_batch_rates": batch_rates,
    "ag17_flops": flops,
    "ag19_planned_ranges": planned,
    "snk18_histogram": histogram,
    "st2_seeded_top": top_shuffled,
    "st3_truncated_batch": truncated_batch,
    "st4_accumulate_until_full": accumulate,
    "st5_reorder": reorder,
    "so1_concat": concat_batches,
    "so3_pad_unpad": pad_unpad,
    "so4_chunk": chunks,
    "so5_fold": folds,
    "so6_src13_minibatches": minibatches,
    "so6_src13_permuted_batches": permuted,
    "flt6_overlong_media": overlong_media,
}
ORACLE = {
    "curation_report": f"WITH {_TOK}, {_REPEATS}, f AS (SELECT len(t) AS n_tokens, coalesce(most, 0) >= {THRESHOLD} OR len(t) > 2000 AS bad FROM tok LEFT JOIN rep USING (doc_id)) SELECT count(*) AS docs, count(*) FILTER (bad) AS flagged, {_CUT}, max(n_tokens) AS longest, round(avg(n_tokens), 6) AS mean FROM f",
    "flt1_flt2_repetition": f"WITH {_TOK}, {_REPEATS} SELECT doc_id, most AS repeats FROM rep WHERE most >= {THRESHOLD} AND doc_id % 13 <> 0",
    "flt3_image_geometry": f"SELECT p_partkey, w * h = 0 OR least(w, h) < 32 OR w * h >= 20000000 OR greatest(w, h) >= 6000 OR (least(w, h) > 0 AND greatest(w, h) / least(w, h) >= 15.0) AS bad FROM (SELECT p_partkey, {_GEOMETRY} FROM part)",
    "flt5_token_length": f"WITH {_TOK} SELECT doc_id FROM tok WHERE len(t) > 500",
    "flt6_overlong_prompts": f"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND len({_TOKENS}) <= 20",
    "flt7_status_filter": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'api_error: x' END AS status, doc_id % 3 <> 1 AS kept FROM labels",
    "flt9_online_filter": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING avg(CAST(value > 20 AS DOUBLE)) > 0.3 AND avg(CAST(value > 20 AS DOUBLE)) < 0.5)",
    "flt10_second_stage": f"SELECT p_partkey, coalesce(p_partkey % 3 <> 0 AND h * 3 >= 1024 AND greatest(w, h) / nullif(least(w, h), 0) <= 15.0, false) AS ready FROM (SELECT p_partkey, {_GEOMETRY} FROM part)",
    "flt11_usable_code": "SELECT doc_id, CASE WHEN doc_id % 4 > 1 THEN text END AS code FROM documents",
    "src4_row_range": f"WITH {_BATCH} SELECT * FROM b WHERE row_idx >= 100 AND row_idx < 250",
    "prj1_prj3_projection": f"WITH {_BATCH} SELECT row_idx, price + 1 AS cost FROM b",
    "prj2_mask_select": f"WITH {_BATCH} SELECT row_idx, o_orderkey FROM b WHERE row_idx % 7 = 3 AND price > 1000",
    "jn1_resume_anti_join": "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE NOT quality = 0)",
    "jn2_truth_join": f"WITH {_PAIRS} SELECT id, has_pred_image, has_pred_tex, similarity FROM pairs",
    "jn3_snk11_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "jn4_zip_union": f"WITH {_BATCH} SELECT row_idx, o_orderkey, price, o_custkey FROM b",
    "jn5_scatter_back": f"WITH {_BATCH} SELECT row_idx, CASE WHEN row_idx % 3 = 0 THEN 'r' || o_custkey ELSE '' END AS answer FROM b",
    "jn6_so2_repeat": "WITH r AS (SELECT i.range AS row_idx, c.range AS copy FROM range((SELECT count(*) FROM orders)) i, range(3) c) SELECT row_idx, CAST(copy AS INTEGER) AS copy, row_idx * 3 + copy AS new_idx, 'interleave' AS mode FROM r UNION ALL SELECT row_idx, CAST(copy AS INTEGER), copy * (SELECT count(*) FROM orders) + row_idx, 'tile' FROM r",
    "jn7_path_resolution": "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'a/img' || c_custkey WHEN c_custkey % 3 = 0 THEN 'b/img' || c_custkey END AS full FROM customer".replace(" AS full ", ' AS "full" '),
    "jn8_permutation_inverse": f"WITH {_BATCH} SELECT s.i AS row_idx, s.row_idx AS new_idx, b.o_orderkey AS restored FROM (SELECT row_idx, row_number() OVER (ORDER BY md5(o_orderkey || '/7'), o_orderkey) - 1 AS i FROM b) s JOIN b ON b.row_idx = s.i",
    "ag1_length_profile": f"WITH {_TOK}, f AS (SELECT len(t) AS n_tokens FROM tok) SELECT count(*) AS count, CAST(min(n_tokens) AS INTEGER) AS min, {_CUT}, CAST(max(n_tokens) AS INTEGER) AS max, round(avg(n_tokens), 6) AS mean FROM f",
    "ag2_ag3_conditional_means": f"WITH {_PAIRS} SELECT round(avg(similarity) FILTER (has_pred_image = 1), 9) AS compiled_only, round(avg(similarity) FILTER (has_pred_tex = 1), 9) AS all_tex, round(avg(coalesce(similarity, 0)), 9) AS overall, round(avg(has_pred_image), 9) AS compile_rate, count(*) AS n FROM pairs",
    "ag4_value_counter": "SELECT lang, count(*) AS count FROM documents GROUP BY lang",
    "ag5_trivial_ngrams": f"WITH {_TOK}, g AS ({_NGRAMS}) SELECT n, replace(gram, chr(31), ' ') AS gram, count(*) AS count FROM g GROUP BY g.n, g.gram ORDER BY count(*) DESC, n, g.gram LIMIT 100",
    "ag6_ordered_fingerprint": " UNION ALL ".join(
        f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(list_reduce(list_prepend(0::HUGEINT, list(CAST('0x' || substr(md5(coalesce('t' || text, 'n')), 1, 15) AS HUGEINT) ORDER BY {order})), lambda a, b: (a * {S.CHAIN_BASE}::HUGEINT + b) % {S.CHAIN_PRIME}::HUGEINT) AS BIGINT) AS chain, '{name}' AS sorted FROM documents"
        for name, order in (("id", "doc_id"), ("length", "n_chars, doc_id"))
    ),
    "ag6_corpus_fingerprint": "SELECT count(*) AS rows, coalesce(sum(CAST('0x' || substr(md5(text), 1, 8) AS BIGINT)), 0)::BIGINT AS high, coalesce(sum(CAST('0x' || substr(md5(text), 9, 8) AS BIGINT)), 0)::BIGINT AS low, coalesce(sum(CAST('0x' || substr(md5(text), 17, 8) AS BIGINT)), 0)::BIGINT AS third FROM documents",
    "ag7_reduce_metrics": "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "ag8_length_metrics": "SELECT round(avg(n), 6) AS response_mean, max(n) AS response_max, min(n) AS response_min, round(avg(CAST(n = 4000 AS INTEGER)), 9) AS response_clip_ratio FROM (SELECT least(n_chars, 4000) AS n FROM documents)",
    "ag9_data_metrics": f"WITH t AS (SELECT event_id // 16 AS i, value AS s, value - event_id % 3 AS r, value / 2 AS a, value * 0.9 + event_id % 3 AS ret, event_id % 5 <> 3 AS m FROM events), q AS (SELECT sum(s) AS s, sum(r) AS r FROM t GROUP BY i) SELECT * FROM (SELECT {_SUMS} FROM q), (SELECT {_METRICS}, round(1 - var_samp(ret - s) / (var_samp(ret) + 1e-5), 6) AS vf_explained_var FROM t WHERE m)",
    "ag10_throughput": "SELECT 12.5::DOUBLE AS timing_s_gen, 2.0::DOUBLE AS timing_s_adv, 1.0::DOUBLE AS timing_s_other, 16.0::DOUBLE AS timing_s_step, round(12500.0 / sum(n_chars // 2), 9) AS timing_per_token_ms_gen, round(2000.0 / sum(n_chars), 9) AS timing_per_token_ms_adv, CAST(sum(n_chars) AS BIGINT) AS total_num_tokens, 16.0::DOUBLE AS time_per_step, round(sum(n_chars) / 128.0, 9) AS throughput FROM documents",
    "ag14_batch_rates": "SELECT round(avg(CAST(doc_id % 3 <> 0 AS INTEGER)), 9) AS p_render_ok, round(avg(CAST(doc_id % 4 <> 0 AS INTEGER)), 9) AS p_codeprime_nonempty, round(avg(length(text)) FILTER (doc_id % 4 <> 0), 6) AS mean_length FROM documents",
    "ag17_flops": "WITH d AS (SELECT CAST(sum(n_chars) AS DOUBLE) AS t, sum(CAST(n_chars AS DOUBLE) * n_chars) AS q FROM documents) SELECT 'llama' AS kind, round((6.0 * (16 * (3 * 2048 * 5632 + 2 * 2048 * 128 * 20) + 2 * 32000 * 2048) * t + 12.0 * 128 * 16 * 16 * q) / 1e13, 3) AS tflops, 312.0::DOUBLE AS peak FROM d UNION ALL SELECT 'qwen3_moe', round((6.0 * (12 * (8 * 768 * 3 * 1024 + 1024 * 64 + 2 * 1024 * 128 * 18) + 2 * 50000 * 1024) * t + 12.0 * 128 * 16 * 12 * q) / 1e13, 3), 312.0 FROM d UNION ALL SELECT 'other', 0.0, 312.0",
    "ag19_planned_ranges": f"WITH {_BATCH}, p AS (SELECT row_idx, CAST(row_idx // CAST(ceil((SELECT count(*) FROM orders) / 7) AS BIGINT) AS INTEGER) AS part FROM b) SELECT part, min(row_idx) AS start, max(row_idx) AS \"end\" FROM p GROUP BY part",
    "snk18_histogram": f"WITH {_TOK} SELECT CAST(least(floor(len(t) / (4096 / 120)), 119) AS INTEGER) AS bin, count(*) AS count FROM tok WHERE len(t) BETWEEN 0 AND 4096 GROUP BY 1",
    "st2_seeded_top": "SELECT doc_id, md5(doc_id || '/42') AS k FROM documents ORDER BY k, doc_id LIMIT 25",
    "st3_truncated_batch": "SELECT event_id FROM events WHERE value > 5 ORDER BY event_id LIMIT 40",
    "st4_accumulate_until_full": "WITH e AS (SELECT event_id, user_id, event_id // 250 AS b, CAST(value > 20 AS DOUBLE) AS s FROM events), k AS (SELECT b, user_id FROM e GROUP BY b, user_id HAVING avg(s) > 0.05 AND avg(s) < 0.95) SELECT event_id FROM e JOIN k USING (b, user_id) ORDER BY event_id LIMIT 64",
    "st5_reorder": f"WITH {_BATCH} SELECT row_idx * 37 % (SELECT count(*) FROM b) AS row_idx, o_orderkey FROM b",
    "so1_concat": f"WITH {_BATCH} SELECT row_idx, price FROM b WHERE row_idx % 2 = 0 UNION ALL SELECT row_idx, price FROM b UNION ALL SELECT row_idx, price FROM b WHERE row_idx % 2 = 1",
    "so3_pad_unpad": f"WITH {_BATCH} SELECT row_idx, o_orderkey, false AS is_pad FROM b UNION ALL SELECT row_idx + n, o_orderkey, true FROM b, (SELECT count(*) AS n FROM b) WHERE row_idx < (7 - n % 7) % 7 UNION ALL SELECT -row_idx - 1, o_orderkey, false FROM b",
    "so4_chunk": f"WITH {_BATCH} SELECT i.range AS row_idx, CAST(i.range // ((n + 6) // 7) AS INTEGER) AS chunk FROM (SELECT count(*) AS n FROM b), range((SELECT (count(*) + 6) // 7 * 7 FROM b)) i",
    "so5_fold": f"WITH {_BATCH} SELECT row_idx // 10 AS fold, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY row_idx) AS keys FROM b GROUP BY 1",
    "flt6_overlong_media": f"""WITH m AS (SELECT doc_id, 'i' AS kind, doc_id * (37 + n) % 5000 AS w, CASE WHEN doc_id % 97 <> 96 THEN doc_id * (53 + n) % 4000 END AS h, 0 AS f FROM documents, (VALUES (1), (2), (3)) v(n) WHERE n <= doc_id % 3 + 1
        UNION ALL SELECT doc_id, 'v', doc_id % 800, doc_id % 600, doc_id % 30 FROM documents WHERE doc_id % 3 = 0),
      a AS (SELECT *, greatest(round_even(w / 28, 0), 1) * greatest(round_even(h / 28, 0), 1) * 784 AS area FROM m),
      t AS (SELECT doc_id, CASE WHEN kind = 'v' THEN ceil(f / 2) ELSE 1 END * CASE WHEN NOT (w * h > 0) OR w * h IS NULL THEN NULL
        WHEN area > 12845056 THEN greatest(floor(w / sqrt(w::DOUBLE * h / 12845056) / 28), 1) * greatest(floor(h / sqrt(w::DOUBLE * h / 12845056) / 28), 1)
        WHEN area < 3136 THEN ceil(w * sqrt(3136.0::DOUBLE / (w * h)) / 28) * ceil(h * sqrt(3136.0::DOUBLE / (w * h)) / 28) ELSE area / 784 END AS n FROM a),
      s AS (SELECT doc_id, sum(n) AS n, count(*) = count(n) AS sized FROM t GROUP BY doc_id)
      SELECT d.doc_id, NOT sized OR len({_TOKENS}) + n > 9000 AS overlong FROM documents d JOIN s ON s.doc_id = d.doc_id""",
    "so6_src13_permuted_batches": "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), g AS (SELECT *, CAST(ceil(n / wide) AS BIGINT) AS high FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS wide FROM d)), p AS ("
    + " UNION ALL ".join(f"SELECT {e}::INTEGER AS epoch, doc_id, n, {E.sql_place('i', 5, e)} AS place FROM g" for e in range(3))
    + ") SELECT epoch, CAST(place // 16 AS INTEGER) AS batch, place, doc_id FROM p WHERE place < n // 16 * 16 AND place // 16 + epoch * (n // 16) >= 10",
    "so6_src13_minibatches": "WITH p AS (SELECT doc_id, e.range AS epoch, row_number() OVER (PARTITION BY e.range ORDER BY md5(doc_id || '/' || (5 + e.range)), doc_id) - 1 AS place, count(*) OVER (PARTITION BY e.range) AS n FROM documents, range(2) e) SELECT CAST(epoch AS INTEGER) AS epoch, CAST(place // 16 AS INTEGER) AS batch, place, doc_id FROM p WHERE place < n // 16 * 16",
}
