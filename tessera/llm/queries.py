"""The queries of this subpackage over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, langid, lines, lsh, merkle, mixing, negatives, pivots, quality, sharding, simhash, urls
from tessera.sources.readers import spread

SHARDS = 24
RANKS = "byte_bpe_multi_50k.tiktoken"
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def op1_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang", langid.remainder(F.col("doc_id"), 3).alias("part"))
    model = langid.fit(docs.where("part <> 1"))
    held = docs.select("doc_id", "text", F.coalesce(F.col("part") == 1, F.lit(False)).alias("held_out"))
    return langid.predict(held, model, keep=("doc_id", "held_out"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from the labelled rows whose remainder modulo 4 isn't 2."""
    return quality.fit(docs, labels.where(langid.remainder(F.col("doc_id"), 4) != 2))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every document, learned from labels that aren't held out."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model(docs, _table(spark, folder, "labels"))
    held = docs.withColumn("held_out", F.coalesce(langid.remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    scored = quality.score(held, model, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings."""
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixing.decided(_table(spark, folder, "documents").select("doc_id", "text", "source"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint and the near-duplicate component of every document.

    Shard trees go to the queries of their shard by an exchange, not by broadcast: all of
    them are the fingerprints of all documents, which must not pass the driver.
    """
    return simhash.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def op6_pivots(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of equal label with a cosine of 0.98 or more."""
    return pivots.near_vectors(_table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


def op7_lsh(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest found of every vector whose id is divisible by 100."""
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return lsh.nearest(vectors, F.col("vec_id") % 100 == 0)


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded with the multilingual ranks and decoded again."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, ranks, pattern, decoded="decoded"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with one line kept of each component of similar lines."""
    found = lines.dedup_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.withColumnsRenamed({"__lines": "n_lines", "__kept": "n_kept"})


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of equal bytes."""
    return sharding.shards(_table(spark, folder, "documents").select("doc_id", "text"), SHARDS)


def op11_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url judged by the rules, else by models learned from the urls that the rules settle."""
    return urls.judged(_table(spark, folder, "pages").select("page_id", "url"), RULES).drop("url")


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the manifest proved, with the line breaks of every second one's text gone by the CRC-32 of its id."""
    docs = _table(spark, folder, "documents").select(*merkle.FIELDS)
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return merkle.manifest(docs, tampered={"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five hard negatives for each of the five positives of every vector whose id is divisible by 100; every seventh id's label moves on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, folder, "embeddings").select("vec_id", "embedding", "label"), F.col("vec_id") % 100 == 0, label=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_quality": op2_quality,
    "op3_chat_format": op3_chat_format,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_pivots": op6_pivots,
    "op7_lsh": op7_lsh,
    "op8_bpe": op8_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_shards": op10_shards,
    "op11_urls": op11_urls,
    "op12_merkle": op12_merkle,
    "op13_hard_negatives": op13_hard_negatives,
}
