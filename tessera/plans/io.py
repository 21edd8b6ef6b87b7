"""Queries of sources, sinks, outside calls, balancing and streams: tables written, read again and compared."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import maths as M
from tessera.functions import templates as P
from tessera.functions import text as T
from tessera.operators import advantage as V
from tessera.operators import balance as B
from tessera.operators import dispatch as D
from tessera.operators import external as E
from tessera.operators import metrics as S
from tessera.operators import relational as R
from tessera.operators import rewards as W
from tessera.operators.filters import row_numbers
from tessera.plans.fixtures import SAMPLES, quoted, samples, table
from tessera.plans.strings import _normalized as normalized
from tessera.plans.strings import extracted_sql as str1
from tessera.sources import ordered, readers, writers
from tessera.sources.scratch import kept, scratch_dir
from tessera.streaming import resume

_SCHEMA = "doc_id BIGINT, lang STRING, n BIGINT"


def _jsonl(spark: SparkSession, folder: str) -> str:
    """Documents as JSON lines, with blank lines and lines that are no record between."""
    path = scratch_dir(spark)
    docs = table(spark, folder, "documents")
    good = docs.select(F.to_json(F.struct("doc_id", "lang", F.col("n_chars").alias("n"))).alias("value"))
    odd = docs.where("doc_id % 10 = 0").select(F.when(F.col("doc_id") % 20 == 0, "  ").otherwise('{"doc_id": oops').alias("value"))
    good.union(odd).write.text(path)
    return path


def tolerant(spark: SparkSession, folder: str) -> DataFrame:
    return readers.jsonl(spark, _jsonl(spark, folder), _SCHEMA)


def counted(spark: SparkSession, folder: str) -> DataFrame:
    return readers.jsonl_counts(spark, _jsonl(spark, folder), _SCHEMA)


def strict(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark)
    table(spark, folder, "documents").select("doc_id", "lang", F.col("n_chars").alias("n")).write.json(path)
    try:
        readers.jsonl(spark, _jsonl(spark, folder), _SCHEMA, "strict").write.format("noop").mode("overwrite").save()
        raised = False
    except Exception:
        raised = True
    return readers.jsonl(spark, path, _SCHEMA, "strict").withColumn("bad_line_raises", F.lit(raised))


def projected(spark: SparkSession, folder: str) -> DataFrame:
    return readers.parquet(spark, f"{folder}/documents.parquet", ["doc_id", "lang"])


def required_anti(spark: SparkSession, folder: str) -> DataFrame:
    docs = readers.parquet(spark, f"{folder}/documents.parquet", ["doc_id", "source"])
    return R.remaining(docs, table(spark, folder, "labels"), "doc_id")


def _images(spark: SparkSession, folder: str) -> DataFrame:
    """``k``, ``path`` and ``content``: image headers of four kinds, and bytes that are none."""
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    turned = lambda x, n: F.concat(*[F.substring(x, 2 * i + 1, 2) for i in reversed(range(n))])
    k = F.col("p_partkey")
    w, h = (k * 3 % 16000 + 1).cast("int"), ((k + 7) % 16000 + 1).cast("int")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(w, 8), hexed(h, 8))
    jpeg = F.concat(F.lit("FFD8FFE00010" + "00" * 14 + "FFDB0003FFFFC2000B08"), hexed(h, 4), hexed(w, 4), F.lit("0301110002"))
    riff = lambda kind: F.lit("52494646FFFFFFFF57454250" + kind.encode().hex())
    extended = F.concat(riff("VP8X"), F.lit("0A00000000000000"), turned(hexed(w - 1, 6), 3), turned(hexed(h - 1, 6), 3))
    lossless = F.concat(riff("VP8L"), F.lit("000000002F"), turned(hexed((w - 1).cast("long") + F.shiftleft((h - 1).cast("long"), 14), 8), 4))
    plain = F.concat(riff("VP8 "), F.lit("0000000000000" + "09D012A"), turned(hexed(w, 4), 2), turned(hexed(h, 4), 2))
    hexes = F.element_at(F.array(F.lit("00000D0A"), png, jpeg, extended, lossless, plain), (k % 6 + 1).cast("int"))
    return table(spark, folder, "part").select(k.alias("k"), F.concat(F.lit("p"), k.cast("string")).alias("path"), F.unhex(hexes).alias("content"))


def image_headers(spark: SparkSession, folder: str) -> DataFrame:
    return _images(spark, folder).select("k", readers.image_size(F.col("content")).alias("s")).select("k", "s.w", "s.h")


def bad_images(spark: SparkSession, folder: str) -> DataFrame:
    """Records without an id or path don't count; files that aren't there or are no image are bad."""
    k = F.col("p_partkey")
    records = table(spark, folder, "part").select(F.when(k % 11 == 0, "x").otherwise(k.cast("string")).alias("id"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("image_path"))
    return readers.image_counts(records, _images(spark, folder).where("k % 7 <> 0"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of a folder's files and whether each has a text."""
    path = scratch_dir(spark)
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    nations.repartitionByRange(25, "n_nationkey").select("n_name").write.text(path)
    found = readers.files(spark, path, ".txt").select("id", F.trim(F.col("content").cast("string"), F.lit("\n")).alias("text"))
    named = found.join(nations, found.text == nations.n_name).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.when(F.col("id").startswith("part-"), F.col("text")).alias("text"))
    wanted = nations.select(F.concat(F.lit("n"), (F.col("n_nationkey") * 2).cast("string")).alias("id"))
    return readers.texts(wanted, named)


def stems(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", readers.stem(F.col("url")).alias("stem"))


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark)
    for split, rest in (("train", 0), ("test", 1)):
        table(spark, folder, "customer").where(f"c_custkey % 2 = {rest}").select("c_custkey").write.parquet(f"{path}/{split}")
    a, b = readers.dataset(spark, path), readers.dataset(spark, f"{path}@test")
    return a.withColumn("split", F.lit("train")).union(b.withColumn("split", F.lit("test")))


def corpus_loader(spark: SparkSession, folder: str) -> DataFrame:
    s = samples(spark, folder).select("doc_id", F.col("tex").alias("code"), F.lit("x").alias("other"))
    return readers.corpus(s, 10, tex=True).groupBy(F.length("text").alias("n")).count()


def text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Samples in text files with empty lines between; the parts that look like TeX."""
    path = scratch_dir(spark)
    samples(spark, folder).select("tex").write.option("lineSep", "\n\n").text(path)
    return readers.blocks(spark, path).groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).count()


def line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Without any TeX, runs of lines that aren't blank."""
    path = scratch_dir(spark)
    table(spark, folder, "nation").select(F.concat("n_name", F.lit(" first line\nsecond\n \t\n"), F.when(F.col("n_nationkey") % 2 == 0, "short").otherwise("a longer third line"))).write.option("lineSep", "\n\n").text(path)
    return readers.blocks(spark, path)


def json_texts(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines whose text is in one of several fields, or in none."""
    path = scratch_dir(spark)
    k = F.col("doc_id")
    table(spark, folder, "documents").select(F.when(k % 4 == 0, F.col("text")).alias("response"), F.when(k % 4 == 1, "").otherwise(F.col("lang")).alias("content"), F.when(k % 8 == 0, "").alias("code")).write.json(path)
    return readers.json_corpus(spark, path).groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).count()


def shared_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as arrays of messages with names of their own, through the registry."""
    path = scratch_dir(spark)
    turn = F.struct("turn", F.struct(F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("role"), F.col("text").alias("said")).alias("m"))
    chats = table(spark, folder, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t.m).alias("talk"))
    chats.withColumn("system", F.when(F.col("conv_id") % 2 == 0, "Be brief.")).write.parquet(f"{path}/sets/talks/test")
    tags = {"role_tag": "role", "content_tag": "said", "user_tag": "user", "assistant_tag": "assistant"}
    config = {"talks": {"file_name": "talks", "folder": f"{path}/sets", "split": "test", "formatting": "sharegpt", "columns": {"messages": "talk"}, "tags": tags}}
    out = readers.read(spark, readers.registry(config)["talks"])
    return out.select("conv_id", F.posexplode("messages").alias("place", "m")).select("conv_id", "place", "m.role", "m.content")


def template_file(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark)
    spark.createDataFrame([("Question: {content}\n{<|image_pad|>}",)], "value string").coalesce(1).write.text(f"{path}/plain.txt")
    text = readers.template(spark, path, "plain")
    try:
        readers.template(spark, path, "absent")
        raised = False
    except FileNotFoundError:
        raised = True
    c = table(spark, folder, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", T.filled(text.rstrip("\n"), content=F.col("text")).alias("prompt"), F.lit(readers.uses_image(text)).alias("image"), F.lit(raised).alias("absent_raises"))


def fanned_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark)
    writers.fan_out(table(spark, folder, "nation").select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("id"), F.concat("n_name", F.lit("\nline")).alias("content")), path)
    return writers.fanned(spark, path)


def generation_log(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as generation samples in two steps of one log; how often each line stands there."""
    path = scratch_dir(spark)
    c = table(spark, folder, "conversations").select(F.col("turn"), F.col("role").alias("prompt"), F.col("text").alias("output"), F.col("conv_id").cast("string").alias("ground_truth"), (F.col("turn") / 4).alias("score"))
    for half in (0, 1):
        writers.sample_log(c.where(f"turn % 2 = {half}"), path)
    return spark.read.option("lineSep", "\n").text(path).groupBy("value").count()


def registered(spark: SparkSession, folder: str) -> DataFrame:
    config = {"pages": {"file_name": f"{folder}/conversations.parquet", "columns": {"prompt": "role", "query": "text", "response": "role"}}}
    entry = readers.registry(config)["pages"]
    out = readers.alpaca(readers.dataset(spark, entry.path), entry)
    return out.select("conv_id", "turn", F.col("messages")[0].content.alias("user"), F.col("messages")[1].content.alias("assistant"))


def chat_parts(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    text = F.concat(F.when(F.col("turn") % 2 == 0, "<image>").otherwise(""), F.col("text"), F.lit("<video>end"))
    parts = F.transform(readers.messages(text), lambda p: F.concat_ws(":", p.type, p.text))
    return c.select("conv_id", "turn", F.array_join(parts, "|").alias("parts"))


def api_chat(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    said = readers.api_messages("Draw.", T.without_image_mark(F.concat(F.lit("<image>"), F.col("role"))), F.lit("data:x"), "One block.")
    return c.select("conv_id", "turn", F.get_json_object(said, "$[1].content[1].text").alias("text"), F.get_json_object(said, "$[1].content[0].image_url.url").alias("url"))


def sinks(spark: SparkSession, folder: str) -> DataFrame:
    """Ids, JSON lines appended twice, CSV, status folders: what comes back from each."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", (F.col("doc_id") % 4 != 0).alias("good"))
    path = scratch_dir(spark)
    writers.ids(docs, f"{path}/ids")
    for half in (0, 1):
        writers.append_jsonl(docs.where(f"id % 2 = {half}"), f"{path}/jsonl")
    writers.csv(docs, f"{path}/csv")
    writers.by_status(docs, f"{path}/status", F.col("good"))
    out = [
        spark.read.text(f"{path}/ids").select(F.lit("ids").alias("sink"), F.col("value").cast("bigint").alias("id")),
        readers.jsonl(spark, f"{path}/jsonl", "id BIGINT").select(F.lit("jsonl"), "id"),
        spark.read.option("header", True).csv(f"{path}/csv").select(F.lit("csv"), F.col("id").cast("bigint")),
        spark.read.schema("id BIGINT, status STRING").json(f"{path}/status").select("status", "id"),
    ]
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]


def sorted_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.lit("x1")).otherwise((F.col("doc_id") % 50).cast("string")).alias("id"))
    return writers.sorted_ids(docs)


def validated(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark)
    writers.validated(samples(spark, folder).select(F.col("doc_id").alias("id"), F.col("tex").alias("image_bytes"), F.col("tex").alias("code")), path)
    back = spark.read.parquet(path)
    return back.select("id", F.hex("image.bytes").alias("bytes"), F.col("image.path").alias("path"), F.length("code").alias("n"))


def summarised(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"))
    return writers.report(docs, {"languages": ["en", "de"]})


def merged_parts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return writers.merged([docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")], "doc_id")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("step"), F.round("o_totalprice", 2).alias("reward"))
    return writers.retained(runs, 3, "reward")


def flattened(spark: SparkSession, folder: str) -> DataFrame:
    """Nested metrics of the documents, logged by language and read again."""
    path = scratch_dir(spark)
    log = writers.MetricLog.open("file", spark, path)
    found = table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.min("n_chars").alias("shortest")).orderBy("lang").collect()
    for step, r in enumerate(found):
        log.log({"length": {"max": r.longest, "bounds": {"min": r.shortest}}, "n": r.n}, step)
    back = spark.read.schema("step INT, metrics MAP<STRING, DOUBLE>").json(path)
    return back.select("step", F.explode("metrics").alias("key", "value"))


def rendered(spark: SparkSession, folder: str) -> DataFrame:
    s = samples(spark, folder).select(F.col("doc_id").alias("id"), T.extract_latex(F.col("tex")).alias("code"))
    return E.rendered(s, E.StubRenderer()).select("id", F.col("image").isNotNull().alias("ok"), "error")


def repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt, answer, checks: the repair loop over what isn't done yet."""
    s = samples(spark, folder).select(F.col("doc_id").alias("id"), F.col("tex").alias("code"))
    todo = R.remaining(s, table(spark, folder, "labels").select(F.col("doc_id").alias("id")))
    asked = todo.withColumn("prompt", T.repair_prompt(F.col("code"), F.lit("! oops")))
    out = E.generated(asked, E.StubGenerator())
    code = T.single_fence(F.col("output"))
    status = F.when(F.col("error").isNotNull(), F.col("error")).when(code.isNull(), "bad_output_format").when(~T.is_complete(code), "not_complete_doc").otherwise("ok")
    return out.select("id", status.alias("status"))


def deduped_calls(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("prompt"))

    def call(few: DataFrame) -> DataFrame:
        got = E.generated(few.withColumn("id", F.col("prompt")), E.StubGenerator())
        return got.select(F.col("id").alias("prompt"), F.length("output").alias("n"))

    return E.once(docs, ["prompt"], call)


def _by_64(spark: SparkSession, folder: str) -> DataFrame:
    docs = row_numbers(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return docs.withColumn("g", F.floor(F.col("row_idx") / 64))


def balanced(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of equal size in groups of 64 documents, the last one filled up: that nothing is lost, and that no two sums differ by more than the longest document, as the method promises."""
    whole = R.padded(_by_64(spark, folder).drop("g"), 64).withColumn("g", F.floor(F.col("row_idx") / 64))
    parts = B.balanced(whole, "n_chars", 8, group="g", equal=True).groupBy("g", "part").agg(F.sum("n_chars").alias("s"), F.count("*").alias("n"), F.max("n_chars").alias("long"), F.min("n_chars").alias("short"))
    return parts.groupBy("g").agg(F.sum("n").alias("docs"), F.sum("s").alias("chars"), F.max("n").alias("most"), F.count("*").alias("parts"), (F.max("s") - F.min("s") <= F.max("long")).alias("even"))


def micro(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of 64 documents in micro-batches by tokens: their number, that the heaviest comes first, that sums differ by no more than the longest; and that putting the sets behind each other and the inverse order give every row its place again."""
    docs = _by_64(spark, folder)
    most = 2 * docs.agg(F.max("n_chars")).first()[0]
    sets = kept(B.dealt(docs, "n_chars", lambda lengths: B.micro_batches(lengths, most), group="g"))
    sums = sets.groupBy("g", "part").agg(F.sum("n_chars").alias("s"), F.sum(F.col("n_chars") * F.col("n_chars")).alias("q"), F.max("n_chars").alias("long"), F.count("*").alias("n"))
    falls = F.collect_list(F.struct("part", "q"))
    order = F.transform(F.sort_array(falls), lambda x: x.q)
    out = sums.groupBy("g").agg(F.count("*").alias("parts"), F.sum("n").alias("docs"), (order == F.sort_array(order, False)).alias("heaviest_first"), (F.max("s") - F.min("s") <= F.max("long")).alias("even"))
    placed = B.ordered(sets.withColumn("part", F.col("g") * 64 + F.col("part")))
    back = R.reordered(R.reordered(placed.select("row_idx", "new_idx", F.col("row_idx").alias("was")), placed.select("row_idx", "new_idx")).drop("new_idx"), R.inverse(placed.select("row_idx", "new_idx")))
    right = back.groupBy(F.floor(F.col("row_idx") / 64).alias("g")).agg(F.count_if(F.col("row_idx") == F.col("was")).alias("restored"))
    return out.join(right, "g")


def ordered_log(spark: SparkSession, folder: str) -> DataFrame:
    """Answers logged in three batches, by falling ids each; the second is handed over again, and once it dies before its commit."""
    path = scratch_dir(spark)
    docs = table(spark, folder, "documents").select("doc_id", "lang").withColumn("back", -F.col("doc_id"))
    docs.where("doc_id % 3 = 1").write.mode("overwrite").json(f"{path}/batch=1")
    for batch in (0, 1, 1, 2):
        ordered.commit_batch(docs.where(F.col("doc_id") % 3 == batch), path, batch, "back")
    return ordered.log(spark, path, "doc_id long, lang string").withColumnRenamed(ordered.PLACE, "place")


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users without a gap of six hours or more; times as whole microseconds."""
    found = resume.sessions(table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "6 hours")
    return found.select("user_id", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n")


def imbalance(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of eight runs of all documents as they come, and of eight sets dealt forth and back by length."""
    docs = row_numbers(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return B.imbalance(B.snaked(docs, "n_chars", 8), "n_chars", 8).withColumn("mean", F.round("mean", 6))


def streamed(spark: SparkSession, folder: str) -> DataFrame:
    """Events in two runs over growing files, some twice; every event comes out once."""
    path = scratch_dir(spark)
    events = table(spark, folder, "events").select(F.col("event_id").alias("id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for k, part in enumerate(("id % 2 = 0", "id % 3 = 0 OR id % 2 = 1")):
        events.where(part).repartition(2).write.mode("append").parquet(f"{path}/in")
        work = lambda df: df.withColumn("n", F.length("event_type"))
        query = resume.processed(spark, f"{path}/in", events.schema, work, f"{path}/out", f"{path}/checkpoint", time="ts", late="1000 days")
        query.awaitTermination()
        query.stop()
    return spark.read.schema("id BIGINT, event_type STRING, n INT").json(f"{path}/out")


def windows(spark: SparkSession, folder: str) -> DataFrame:
    e = resume.windowed_counts(table(spark, folder, "events"))
    return e.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def tex_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """TeX tokens of normalised samples, and those of comments-free text that the other metric's normal form gives: one rule for both."""
    s = samples(spark, folder)
    return s.select("doc_id", F.array_join(S.tex_tokens_of(T.normalize_tex(F.col("tex"))), " ").alias("tokens"))


def greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of 64 documents, each in turn to the lightest of eight sets."""
    return B.dealt(_by_64(spark, folder), "n_chars", lambda lengths: B.greedy(lengths, 8), group="g").select("doc_id", "part")


def appended_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Records with their answers appended to one folder and the errors to another; what both hold."""
    path = scratch_dir(spark)
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 6 != 0, F.col("source")).alias("prompt"))
    asked = E.generated(docs.where("prompt IS NOT NULL"), E.StubGenerator())
    out = R.merged_record(docs.join(asked, "id"), {"outputs": F.array("output"), "prompt_name": F.lit("plain")}).drop("output", "error")
    writers.append_jsonl(out, f"{path}/answers")
    writers.append_jsonl(docs.where("prompt IS NULL").select("id", F.lit("no prompt").alias("error")), f"{path}/errors")
    a = spark.read.schema("id BIGINT, lang STRING, prompt_name STRING, outputs ARRAY<STRING>").json(f"{path}/answers")
    b = spark.read.schema("id BIGINT, error STRING").json(f"{path}/errors")
    return a.select("id", "lang", "prompt_name", F.size("outputs").alias("n")).unionByName(b.select("id", F.lit(None).cast("string").alias("lang"), F.col("error").alias("prompt_name"), F.lit(0).alias("n")))


def saved_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A batch saved and read again, with its sizes checked; whether unequal ones raise."""
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    back = kept(turns)
    try:
        back.select(R.equal_sizes(F.col("turns"), F.slice("turns", 2, 100))).write.format("noop").mode("overwrite").save()
        raised = False
    except Exception:
        raised = True
    return back.select("conv_id", F.size(R.equal_sizes(F.col("turns"), F.transform("turns", lambda t: t + 1))).alias("n"), F.lit(raised).alias("unequal_raises"))


def kl_controllers(spark: SparkSession, folder: str) -> DataFrame:
    """The coefficients of both controllers over steps of divergence, one a nation."""
    fixed, adaptive, rows = V.FixedKL(0.1), V.AdaptiveKL(0.1, 0.05, 1000), []
    steps = table(spark, folder, "nation").select(F.col("n_nationkey").alias("step"), (F.col("n_regionkey") / 40 + 0.01).alias("kl")).orderBy("step").collect()
    for r in steps:
        fixed.update(r.kl, 64)
        adaptive.update(r.kl, 64)
        rows.append((r.step, fixed.coef, round(adaptive.coef, 9)))
    return spark.createDataFrame(rows, "step long, fixed double, adaptive double")


def model_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with an image mark and a place for an image, as every model family wants them."""
    c = table(spark, folder, "conversations").where("role = 'user'")
    asked = F.concat(F.lit(P.IMAGE_MARK + P.IMAGE_PLACE), F.col("text"))
    return c.select("conv_id", "turn", *[P.for_family(asked, n).alias(n) for n in P.FAMILIES])


#: A conversation as one prompt: a loop with its state, a choice, filters, trimmed marks and a quoted name that isn't one.
CHAT = """
{%- for m in messages %}
{%- if loop.first %}<{{ loop.index }}>{% elif m.role == 'assistant' and not loop.last %}[A]{% else %}{{ m.role | upper }}{% endif %} {{ m.text | replace("e", "{{ m }}") | trim }}{# gone #}
{% endfor -%}
{{ '{{ conv }}' }} {{ conv }}: {{ messages[0].role | default('none') }}, {{ messages | count }}
"""


def rendered_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation by a template with loops and choices."""
    turn = F.struct("turn", "role", "text")
    chats = table(spark, folder, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("messages"))
    return chats.select("conv_id", P.rendered(CHAT, {"messages": F.col("messages"), "conv": F.col("conv_id")}).alias("prompt"))


def lazy_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Batches joined, cut and picked from without a computation until the end; the picked chunk collated."""
    b = row_numbers(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")
    both = R.concatenated([b, b.withColumn("row_idx", F.col("row_idx") + b.count())])
    chunk = R.split(both, 300).where("chunk % 2 = 1").select("row_idx", "o_orderkey")
    out = R.collated(chunk, 50)
    return out.select("batch", F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("keys"), F.size("row_idx").alias("n"))


def dispatched(spark: SparkSession, folder: str) -> DataFrame:
    """Nations to five workers: all to all of them, and in equal runs whose sums come together."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("row_idx"), F.col("n_regionkey").alias("x"))
    def work(run):
        return run.assign(x=run["x"].sum())

    every = D.one_to_all(nations, 5).select("row_idx", F.col("worker").cast("long").alias("x"), F.lit("all").alias("mode"))
    each = D.data_parallel(nations, 5, work, "row_idx long, x long").select("row_idx", "x", F.lit("runs").alias("mode"))
    own = D.all_to_all(nations, 25).select("row_idx", F.col("worker").cast("long").alias("x"), F.lit("own").alias("mode"))
    return every.union(each).union(own)


def learning_rates(spark: SparkSession, folder: str) -> DataFrame:
    step = F.col("p_partkey")
    return table(spark, folder, "part").select("p_partkey", F.round(M.warmup_constant(step, 50), 9).alias("constant"), F.round(M.warmup_cosine(step, 50, 150, 0.1, 0.5, 0.2), 9).alias("cosine"))


def reward_file(spark: SparkSession, folder: str) -> DataFrame:
    """A reward that a Python file defines, over every turn; equal records are scored once."""
    with tempfile.TemporaryDirectory() as place:  # read by the driver alone
        file = Path(place) / "length_reward.py"
        file.write_text(REWARD_FILE, encoding="utf-8")
        W.loaded(str(file), "score")
    c = table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("response"), F.col("role").alias("ground_truth"))
    return W.scored(c, "length").select("conv_id", "turn", "reward.overall", "reward.accuracy")


#: A reward as a user writes it.
REWARD_FILE = """
REWARD_NAME, REWARD_TYPE = "length", "sequential"


def score(record):
    n = len(record["response"])
    return {"overall": n / 100, "format": 1.0, "accuracy": float(record["ground_truth"] == "user")}
"""


def second_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Only the rows that are ready get a second call; the others keep an empty answer."""
    docs = row_numbers(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    ready = docs.where("row_idx % 4 = 1").select(F.col("row_idx").alias("id"), F.col("lang").alias("prompt"))
    part = E.generated(ready, E.StubGenerator()).select(F.col("id").alias("row_idx"), F.col("output").alias("code_prime"))
    return R.scattered(docs.select("row_idx", "doc_id"), part, "code_prime").select("doc_id", (F.col("code_prime") != "").alias("asked"))


QUERIES = {
    "src1_tolerant_jsonl": tolerant,
    "src2_counting_jsonl": counted,
    "src3_strict_jsonl": strict,
    "src5_projected_parquet": projected,
    "src6_required_anti": required_anti,
    "src7_image_headers": image_headers,
    "src2_bad_images": bad_images,
    "src8_src9_listing_texts": listing,
    "src11_text_blocks": text_blocks,
    "src11_line_blocks": line_blocks,
    "src11_json_texts": json_texts,
    "src12_shared_chats": shared_chats,
    "src15_template_file": template_file,
    "snk9_fanned_files": fanned_files,
    "snk15_generation_log": generation_log,
    "ag15_imbalance": imbalance,
    "so7_so8_lz1_lazy_chunks": lazy_chunks,
    "ux3_dispatched": dispatched,
    "mt14_learning_rates": learning_rates,
    "ux1_reward_file": reward_file,
    "src8_stems": stems,
    "src10_dataset_resolver": resolved,
    "src11_corpus_loader": corpus_loader,
    "src12_dataset_registry": registered,
    "src14_chat_parts": chat_parts,
    "str37_api_messages": api_chat,
    "snk1_snk3_snk8_snk10_sinks": sinks,
    "snk2_sorted_ids": sorted_ids,
    "snk6_validated_parquet": validated,
    "snk12_summary": summarised,
    "snk13_merged_parts": merged_parts,
    "snk14_flattened_metrics": flattened,
    "snk17_manifest_retention": manifest,
    "ux4_rendered": rendered,
    "ux5_repair_loop": repaired,
    "ux7_ux8_deduped_calls": deduped_calls,
    "bl1_bl2_bl5_balanced": balanced,
    "bl4_micro_batches": micro,
    "sx1_sx2_resumed_stream": streamed,
    "extension_tumbling_windows": windows,
    "str35_str36_tex_tokens": tex_tokens,
    "bl3_greedy": greedy,
    "snk4_snk5_snk7_appended_answers": appended_answers,
    "snk4_snk7_ordered_log": ordered_log,
    "sx1_user_sessions": user_sessions,
    "snk16_ck3_saved_batch": saved_batch,
    "mt8_kl_controllers": kl_controllers,
    "str30_model_templates": model_templates,
    "str29_rendered_chats": rendered_chats,
    "ux6_jn5_second_answers": second_answers,
}
#: Groups of 64 documents dealt in turn to the lightest of eight sets.
_GREEDY = """WITH RECURSIVE docs AS (SELECT doc_id, n_chars, k // 64 AS g, k % 64 AS i FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents)),
  r AS (SELECT g, CAST(-1 AS BIGINT) AS i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS sums, CAST(-1 AS BIGINT) AS part FROM docs WHERE i = 0
    UNION ALL SELECT r.g, docs.i, list_transform(range(1, 9), lambda j: sums[j] + CASE WHEN j = list_position(sums, list_min(sums)) THEN n_chars ELSE 0 END), list_position(sums, list_min(sums)) - 1 FROM r JOIN docs ON docs.g = r.g AND docs.i = r.i + 1)"""
_DOC = "SELECT doc_id, lang, n_chars AS n FROM documents"
ORACLE = {
    "src1_tolerant_jsonl": _DOC,
    "src2_counting_jsonl": "SELECT count(*) + count(*) FILTER (doc_id % 20 = 10) AS scanned, count(*) FILTER (doc_id % 20 = 10) AS bad_json FROM documents",
    "src3_strict_jsonl": _DOC.replace(" FROM", ", true AS bad_line_raises FROM"),
    "src5_projected_parquet": "SELECT doc_id, lang FROM documents",
    "src6_required_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "src7_image_headers": "SELECT p_partkey AS k, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey * 3 % 16000 + 1 AS INTEGER) END AS w, CASE WHEN p_partkey % 6 <> 0 THEN CAST((p_partkey + 7) % 16000 + 1 AS INTEGER) END AS h FROM part",
    "src2_bad_images": "SELECT count(*) AS with_image, count(*) FILTER (p_partkey % 6 = 0 OR p_partkey % 7 = 0) AS bad_image FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 10 <> 0",
    "src8_src9_listing_texts": "SELECT 'n' || (a.n_nationkey * 2) AS id, coalesce(b.n_name, '') AS text FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey * 2",
    "src8_stems": r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)\z', 1), '\.[^.]*\z', '') AS stem FROM pages",
    "src10_dataset_resolver": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM customer",
    "src11_corpus_loader": f"SELECT CAST(length(tex) AS INTEGER) AS n, count(*) AS count FROM {SAMPLES} s WHERE length(tex) > 10 AND (contains(tex, '\\') OR contains(lower(tex), 'tikz') OR contains(lower(tex), 'document')) GROUP BY 1",
    "src11_text_blocks": f"SELECT md5(p) AS digest, count(*) AS count FROM (SELECT regexp_replace(unnest(string_split(tex, chr(10) || chr(10))), '\\A\\s+|\\s+\\z', '', 'g') AS p FROM {SAMPLES} s) WHERE length(p) > 10 AND (contains(p, '\\') OR contains(lower(p), 'tikz') OR contains(lower(p), 'document')) GROUP BY 1",
    "src11_line_blocks": "SELECT n_name || ' first line' || chr(10) || 'second' AS text FROM nation UNION ALL SELECT 'a longer third line' FROM nation WHERE n_nationkey % 2 = 1",
    "src11_json_texts": "SELECT md5(t) AS digest, count(*) AS count FROM (SELECT CASE WHEN doc_id % 4 = 0 AND text <> '' THEN text WHEN doc_id % 4 <> 1 AND lang <> '' THEN lang END AS t FROM documents) WHERE t IS NOT NULL GROUP BY 1",
    "src12_dataset_registry": "SELECT conv_id, turn, role || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END AS user, role AS assistant FROM conversations".replace("AS user", 'AS "user"'),
    "src12_shared_chats": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY t) - 1 AS INTEGER) AS place, role, content FROM (SELECT conv_id, turn AS t, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, text AS content FROM conversations UNION ALL SELECT DISTINCT conv_id, -1, 'system', 'Be brief.' FROM conversations WHERE conv_id % 2 = 0)",
    "src15_template_file": "SELECT conv_id, turn, 'Question: ' || text || chr(10) || '{<|image_pad|>}' AS prompt, true AS image, true AS absent_raises FROM conversations WHERE role = 'user'",
    "snk9_fanned_files": "SELECT 'n_' || n_nationkey AS id, n_name || chr(10) || 'line' AS content FROM nation",
    "snk15_generation_log": "SELECT value, count(*) AS count FROM (SELECT unnest(string_split('[prompt] ' || role || chr(10) || '[output] ' || text || chr(10) || '[ground_truth] ' || conv_id || chr(10) || '[score] ' || CAST(turn / 4 AS DOUBLE) || chr(10), chr(10))) AS value FROM conversations) GROUP BY value",
    "so7_so8_lz1_lazy_chunks": "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), b AS (SELECT i, o_orderkey FROM o UNION ALL SELECT i + n, o_orderkey FROM o) SELECT i // 50 AS batch, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY i) AS keys, CAST(count(*) AS INTEGER) AS n FROM b WHERE i // 300 % 2 = 1 GROUP BY 1",
    "ux3_dispatched": "SELECT n_nationkey AS row_idx, w.range AS x, 'all' AS mode FROM nation, range(5) w UNION ALL SELECT n_nationkey, CAST(sum(n_regionkey) OVER (PARTITION BY n_nationkey // 5) AS BIGINT), 'runs' FROM nation UNION ALL SELECT n_nationkey, n_nationkey, 'own' FROM nation",
    "mt14_learning_rates": "SELECT p_partkey, round(CASE WHEN p_partkey < 50 THEN p_partkey / 50 ELSE 1.0::DOUBLE END, 9) AS constant, round(CASE WHEN p_partkey < 50 THEN 0.2 + 0.8 * p_partkey / 50 ELSE greatest(0.1::DOUBLE, cos(pi() * (p_partkey - 50) / 100) * 0.45 + 0.55) END, 9) AS cosine FROM part",
    "ux1_reward_file": "SELECT conv_id, turn, length(text) / 100 AS overall, CAST(role = 'user' AS DOUBLE) AS accuracy FROM conversations",
    "ag15_imbalance": """WITH d AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
      p AS (SELECT sum(n_chars) AS s FROM d GROUP BY i // greatest(n // 8, 1)), e AS (SELECT sum(n_chars) AS s FROM d GROUP BY least(pos % 16, 15 - pos % 16))
      SELECT CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max, CAST(max(s) - min(s) AS BIGINT) AS minmax_diff, round(sum(s) / 8, 6) AS mean, (SELECT CAST(min(s) AS BIGINT) FROM e) AS balanced_min, (SELECT CAST(max(s) AS BIGINT) FROM e) AS balanced_max FROM p""",
    "bl3_greedy": f"{_GREEDY} SELECT doc_id, CAST(part AS INTEGER) AS part FROM docs JOIN r USING (g, i)",
    "ux4_rendered": f"SELECT id, ok, CASE WHEN NOT ok THEN '! Missing document' END AS error FROM (SELECT doc_id AS id, contains(c, '\\begin{{document}}') AND contains(c, '\\end{{document}}') AS ok FROM (SELECT doc_id, {str1('tex')} AS c FROM {SAMPLES} s))",
    "ux5_repair_loop": f"SELECT id, CASE WHEN contains(lower(w), '\\documentclass') AND regexp_matches(w, '(?i)\\\\begin\\s*\\{{document\\}}') AND regexp_matches(w, '(?i)\\\\end\\s*\\{{document\\}}') THEN 'ok' ELSE 'not_complete_doc' END AS status FROM (SELECT id, CASE WHEN contains(c, '\\documentclass') THEN c ELSE '\\documentclass \\begin{{document}} ' || c || ' \\end{{document}}' END AS w FROM (SELECT doc_id AS id, trim(substr(tex, 1, 10000), '`' || chr(10)) AS c FROM {SAMPLES} s WHERE doc_id NOT IN (SELECT doc_id FROM labels)))",
    "ux7_ux8_deduped_calls": f"SELECT doc_id, lang AS prompt, CAST({len(E.StubGenerator().generate(''))} + length(coalesce(lang, '')) AS INTEGER) AS n FROM documents",
    "str35_str36_tex_tokens": f"SELECT doc_id, array_to_string(regexp_extract_all({normalized('tex')}, {quoted(S._TEX.pattern)}), ' ') AS tokens FROM {SAMPLES} s",
    "src14_chat_parts": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'image|' ELSE '' END || CASE WHEN text <> '' THEN 'text:' || text || '|' ELSE '' END || 'video|text:end' AS parts FROM conversations",
    "str37_api_messages": "SELECT conv_id, turn, role || chr(10) || chr(10) || 'One block.' AS text, 'data:x' AS url FROM conversations",
    "snk1_snk3_snk8_snk10_sinks": "SELECT s.sink, doc_id AS id FROM documents, (SELECT unnest(['ids', 'jsonl', 'csv']) AS sink) s UNION ALL SELECT CASE WHEN doc_id % 4 <> 0 THEN 'success' ELSE 'failed' END, doc_id FROM documents",
    "snk2_sorted_ids": "SELECT DISTINCT doc_id % 50 AS id FROM documents WHERE doc_id % 3 <> 0 ORDER BY 1",
    "snk6_validated_parquet": f"SELECT CAST(doc_id AS VARCHAR) AS id, hex(tex) AS bytes, doc_id || '.png' AS path, CAST(length(tex) AS INTEGER) AS n FROM {SAMPLES} s",
    "snk12_summary": """SELECT '{"n":' || count(*) || ',"longest":' || max(n_chars) || ',"languages":{"en":' || count(*) FILTER (lang = 'en') || ',"de":' || count(*) FILTER (lang = 'de') || '}}' AS summary FROM documents""",
    "snk13_merged_parts": "SELECT doc_id, lang FROM documents",
    "snk14_flattened_metrics": "WITH m AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS INTEGER) AS step, count(*) AS n, max(n_chars) AS a, min(n_chars) AS b FROM documents GROUP BY lang) SELECT step, 'n' AS key, CAST(n AS DOUBLE) AS value FROM m UNION ALL SELECT step, 'length/max', a FROM m UNION ALL SELECT step, 'length/bounds/min', b FROM m",
    "snk17_manifest_retention": "WITH r AS (SELECT o_orderkey AS step, round(o_totalprice, 2) AS reward, row_number() OVER (ORDER BY o_orderkey DESC) AS a, row_number() OVER (ORDER BY round(o_totalprice, 2) DESC, o_orderkey DESC) AS b FROM orders) SELECT step, reward FROM r WHERE a <= 3 OR b = 1",
    "bl1_bl2_bl5_balanced": "WITH d AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), p AS (SELECT i, n_chars FROM d UNION ALL SELECT i + n, n_chars FROM d WHERE i < (64 - n % 64) % 64) SELECT i // 64 AS g, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(8 AS BIGINT) AS most, CAST(8 AS BIGINT) AS parts, true AS even FROM p GROUP BY 1",
    "bl4_micro_batches": "WITH d AS (SELECT n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS g, 2 * max(n_chars) OVER () AS most FROM documents) SELECT g, least(count(*), CAST(ceil(sum(n_chars) / any_value(most)) AS BIGINT)) AS parts, count(*) AS docs, true AS heaviest_first, true AS even, count(*) AS restored FROM d GROUP BY g",
    "sx1_sx2_resumed_stream": "SELECT event_id AS id, event_type, CAST(length(event_type) AS INTEGER) AS n FROM events",
    "sx1_user_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 21600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
      SELECT user_id, min(t) AS start, max(t) + 21600000000 AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "snk4_snk7_ordered_log": "SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id % 3, doc_id DESC) - 1 AS place FROM documents",
    "snk4_snk5_snk7_appended_answers": "SELECT doc_id AS id, CASE WHEN doc_id % 6 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 6 <> 0 THEN 'plain' ELSE 'no prompt' END AS prompt_name, CAST(doc_id % 6 <> 0 AS INTEGER) AS n FROM documents",
    "snk16_ck3_saved_batch": "SELECT conv_id, CAST(count(*) AS INTEGER) AS n, true AS unequal_raises FROM conversations GROUP BY conv_id",
    "mt8_kl_controllers": "SELECT n_nationkey AS step, 0.1::DOUBLE AS fixed, round(0.1 * exp(sum(ln(1 + greatest(-0.2, least(0.2, (n_regionkey / 40 + 0.01) / 0.05 - 1)) * 0.064)) OVER (ORDER BY n_nationkey)), 9) AS adaptive FROM nation",
    "str30_model_templates": "SELECT conv_id, turn, " + ", ".join(f"{quoted(before)} || {quoted('<image>{<|image_pad|>}' if image is None else image)} || {'text' if image is None else 'replace(replace(text, ' + quoted(P.IMAGE_MARK) + chr(44) + chr(39) * 2 + '), ' + quoted(P.IMAGE_PLACE) + chr(44) + quoted(image) + ')'} || {quoted(behind)} AS {n}" for n, (before, behind, image) in P.FAMILIES.items()) + " FROM conversations WHERE role = 'user'",
    "str29_rendered_chats": """WITH m AS (SELECT *, row_number() OVER w AS k, lead(turn) OVER w IS NULL AS last, count(*) OVER (PARTITION BY conv_id) AS n, first_value(role) OVER w AS r0 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
      SELECT conv_id, string_agg(CASE WHEN k = 1 THEN '<1>' WHEN role = 'assistant' AND NOT last THEN '[A]' ELSE upper(role) END || ' ' || trim(replace(text, 'e', '{{ m }}'), ' ' || chr(9) || chr(10) || chr(13)) || chr(10), '' ORDER BY k)
        || '{{ conv }} ' || conv_id || ': ' || any_value(r0) || ', ' || any_value(n) AS prompt FROM m GROUP BY conv_id""",
    "ux6_jn5_second_answers": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 = 1 AS asked FROM documents",
    "extension_tumbling_windows": "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
