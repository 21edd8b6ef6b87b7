"""Sinks: id lists, JSON lines, validated images, status splits, reports, run manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T


def ids(df: DataFrame, path: str, key: str = "id") -> None:
    """One id a line, as they come."""
    df.select(F.col(key).cast("string")).write.text(path)


def sorted_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Different whole-number ids in order; ids that are none go."""
    return df.select(F.col(key).try_cast("bigint").alias(key)).where(F.col(key).isNotNull()).distinct().orderBy(key)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def validated(df: DataFrame, path: str) -> None:
    """``id``, ``image`` (bytes, path) and ``code`` as Parquet with zstd."""
    image = F.struct(F.col("image_bytes").cast("binary").alias("bytes"), F.concat(F.col("id").cast("string"), F.lit(".png")).alias("path"))
    df.select(F.col("id").cast("string").alias("id"), image.alias("image"), "code").write.option("compression", "zstd").parquet(path)


def by_status(df: DataFrame, path: str, ok: Column) -> None:
    """Rows as JSON lines in the folders ``status=success`` and ``status=failed``."""
    df.withColumn("status", F.when(ok, "success").otherwise("failed")).write.partitionBy("status").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def summary(df: DataFrame) -> DataFrame:
    """One-row tables as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("summary"))


def merged(parts: list[DataFrame], order: str) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(order)


def retained(manifest: DataFrame, limit: int, best: str | None = None, step: str = "step") -> DataFrame:
    """Rows of a run manifest that stay: the latest ``limit`` steps and the best one by ``best``. Top rows come from partial sorts."""
    latest = manifest.orderBy(F.desc(step)).limit(limit)
    if not best:
        return latest
    top = manifest.orderBy(F.desc(best), F.desc(step)).limit(1)
    return latest.union(top.join(latest.select(step), step, "left_anti").select(manifest.columns))


def report(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """A one-row table as JSON text, with the named columns in nested groups and the others at the top."""
    inner = {c for cs in groups.values() for c in cs}
    nested = [F.struct(*cs).alias(g) for g, cs in groups.items()]
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in inner], *nested)).alias("summary"))


def fan_out(df: DataFrame, folder: str, key: str = "id", content: str = "content", suffix: str = ".txt") -> None:
    """One file a row, named by a safe form of its key, through Hadoop's file systems. A file that is there is overwritten, so a task may run again."""
    name = F.concat(T.safe_name(F.col(key).cast("string")), F.lit(suffix))
    rows = df.select(name.alias("_name"), F.col(content).cast("string").alias("value"))
    rows.write.mode("overwrite").partitionBy("_name").option("maxRecordsPerFile", 1).text(folder)


def fanned(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """``id``, ``content`` of what :func:`fan_out` wrote."""
    found = spark.read.text(folder, wholetext=True)
    return found.select(F.regexp_replace(F.col("_name").cast("string"), T.literal(suffix) + r"\z", "").alias("id"), F.regexp_replace("value", r"\n\z", "").alias("content"))


def sample_log(samples: DataFrame, path: str) -> None:
    """Appends prompt, output, ground truth and score of generation samples as text, one block each."""
    score = F.col("score").cast("string")
    samples.select(F.concat(F.lit("[prompt] "), "prompt", F.lit("\n[output] "), "output", F.lit("\n[ground_truth] "), "ground_truth", F.lit("\n[score] "), score, F.lit("\n")).alias("value")).write.mode("append").text(path)


class MetricLog:
    """Appends flattened metrics as JSON lines; other places plug in by ``add``."""

    KINDS: dict[str, type] = {}

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def log(self, metrics: dict, step: int) -> None:
        flat = flattened(metrics)
        row = self.spark.range(1).select(F.lit(step).alias("step"), F.create_map(*[x for k, v in flat.items() for x in (F.lit(k), F.lit(float(v)))]).alias("metrics"))
        append_jsonl(row, self.path)

    @classmethod
    def add(cls, name: str, kind: type) -> None:
        cls.KINDS[name] = kind

    @classmethod
    def open(cls, name: str, spark, path: str) -> MetricLog:
        if name != "file" and name not in cls.KINDS:
            raise ValueError(f"unknown logger {name!r}")
        return cls.KINDS.get(name, cls)(spark, path)


class ConsoleLog(MetricLog):
    """Prints metrics by step."""

    def log(self, metrics: dict, step: int) -> None:
        print(f"step {step}: " + ", ".join(f"{k}={v}" for k, v in flattened(metrics).items()))


MetricLog.add("console", ConsoleLog)


def flattened(nested: dict, sep: str = "/") -> dict:
    """A nested mapping with joined keys."""
    out = {}
    for key, value in nested.items():
        out |= {f"{key}{sep}{k}": v for k, v in flattened(value, sep).items()} if isinstance(value, dict) else {key: value}
    return out


def unflattened(flat: dict, sep: str = "/") -> dict:
    out: dict = {}
    for key, value in flat.items():
        *path, last = key.split(sep)
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out
