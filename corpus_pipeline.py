"""The corpus pipeline: documents in, token ids of a cleaned and mixed corpus out.

Every stage takes (session, the documents its predecessor kept, folder of the tables).
All but the last return the columns of ``documents``; ``n_chars`` follows the text.

1. ``quality``: documents go whose quality score is under the classifier's threshold.
2. ``line_dedup``: of each component of similar lines one line stays.
3. ``near_dedup``: of each SimHash component the document with the least id stays (of
   rows that share it, the one whose text hash is least; of rows that agree in both, one).
4. ``mixing``: rows repeat as often as the mix of sources takes the document.
5. ``tokens``: ids and digests of the encoded texts, in the order of the columns of op8.

Null and empty texts are judged like others: the classifier gives them the share of label
1 among its rows, so they stay where that share is at the threshold or above and go
in the first stage where it isn't; those that stay leave at the fourth, as they have no words.
Very long texts are worked on whole; a task holds a few copies of one. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, lines, mixing, quality, queries, simhash
from tessera.llm.storage import dropped, unused, written


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Learned from these documents' labels that aren't held out."""
    return queries.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier doesn't reject, learned from the labels that aren't held out."""
    names = docs.columns
    score = unused("score", names)
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), keep=tuple(names), out=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*[F.col(f"`{c}`") for c in names])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere."""
    return _counted(lines.dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns]))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col("text"))
    rows = written(simhash.fingerprints(keyed, keep=("id", "hash")), "texts")
    known = simhash.rooted(rows, key="id").select("fp", "root")
    placed = rows.join(known, "fp").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("least"))
    stay = lines.small(written(placed.select("least.id", "least.hash"), "stay"))
    kept = docs.join(stay, docs.doc_id.eqNullSafe(stay.id) & (F.xxhash64(docs.text) == stay.hash), "left_semi")
    alone = rows.groupBy("id", "hash").count().where("count > 1").isEmpty()
    if alone:
        return kept
    row = F.struct(*names)  # its JSON orders rows of any types, maps too
    whole = kept.groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return whole.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, by the default weight: the classifier's score is no column of documents, and taking it again here would be Python in a native stage."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with their number and digests, read back through the decoder."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), ranks, pattern, decoded="decoded"))


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where there is such a column, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: The classifier, MinHash, XXH64 and the byte-pair merges have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage has read goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
