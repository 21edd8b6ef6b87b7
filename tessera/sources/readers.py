"""Readers: JSON lines in three tempers, Parquet with required columns, folders of files, dataset names, corpora, chat records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrays import let
from tessera.operators.relational import required

_BAD = "_corrupt_record"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value", F.lit(" \t\r")) != "")


def _parsed(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, list[str]]:
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*struct.fields, T.StructField(_BAD, T.StringType())])
    record = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    return _lines(spark, path).select(record.alias("r")), struct.names


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, mode: str = "tolerant") -> DataFrame:
    """Records of a file of JSON lines; blank lines don't count.

    ``tolerant`` leaves unreadable lines out, ``strict`` raises at the first one.
    """
    rows, names = _parsed(spark, path, schema)
    bad = F.col(f"r.{_BAD}").isNotNull()
    if mode == "tolerant":
        return rows.where(~bad).select(*[f"r.`{c}`" for c in names])
    if mode == "strict":
        checked = F.when(bad, F.raise_error(F.concat(F.lit("no record: "), F.col(f"r.{_BAD}"))).cast(rows.schema["r"].dataType)).otherwise(F.col("r"))
        return rows.select(checked.alias("r")).select(*[f"r.`{c}`" for c in names])
    raise ValueError(f"unknown mode {mode!r}")


def jsonl_counts(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One row: lines scanned and lines that are no record."""
    rows, _ = _parsed(spark, path, schema)
    return rows.agg(F.count("*").alias("scanned"), F.count_if(F.col(f"r.{_BAD}").isNotNull()).alias("bad_json"))


def parquet(spark: SparkSession, path: str, columns: Sequence[str], need: bool = True) -> DataFrame:
    """The named columns of a Parquet table; raises KeyError if one is missing."""
    df = spark.read.parquet(path)
    return (required(df, *columns) if need else df).select(*[c for c in columns if c in df.columns])


#: Bytes a core up to which a table is dealt anew.
SPREAD = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt evenly to all cores, for work on its rows: a file of one row group is one task however many cores there are. A larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SPREAD * cores else df


def stem(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.[^.]*\z", "")


def files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """``id`` (stem) and ``content`` of the files with a suffix; without ``content`` selected only the listing is read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return df.select(stem(F.col("path")).alias("id"), "path", "content")


def texts(truth: DataFrame, found: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Every key with its text, empty where there is none."""
    return truth.select(key).join(found.select(key, text), key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def _number(bytes_: Column) -> Column:
    return F.conv(F.hex(bytes_), 16, 10).cast("int")


def _little(content: Column, at: int, count: int) -> Column:
    """The number in ``count`` bytes from the 1-based place ``at``, least byte first."""
    return _number(F.concat(*[F.substring(content, at + k, 1) for k in reversed(range(count))]))


#: Segments of a JPEG header that are walked before it is known whether there are more.
_SEGMENTS = 64


def _jpeg_size(content: Column) -> Column:
    """Struct of ``w`` and ``h`` in the first frame header, found from segment to segment; the walk ends at a frame header, where the scan starts, or where no segment is. Only headers of more than ``_SEGMENTS`` segments are walked on, as far as the file could hold any."""
    start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("int").alias("h"), F.lit(False).alias("ended"))

    def step(s: Column, _: Column) -> Column:
        mark = F.hex(F.substring(content, s.at, F.lit(2)))
        number = lambda k: _number(F.substring(content, s.at + k, F.lit(2)))
        frame = mark.rlike("^FFC[0-35-79-BD-F]$")
        goes_on = ~frame & mark.startswith("FF") & (mark != "FFDA") & (F.octet_length(content) > s.at + 4)
        moved = F.struct(F.when(goes_on, s.at + 2 + number(2)).otherwise(s.at).alias("at"), F.when(frame, number(7)).alias("w"), F.when(frame, number(5)).alias("h"), (~goes_on).alias("ended"))
        return F.when(s.ended, s).otherwise(moved)

    def walked(s: Column) -> Column:
        more = F.sequence(F.lit(1), F.greatest((F.octet_length(content) / 4).cast("int"), F.lit(1)))
        return F.when(s["ended"], s).otherwise(F.aggregate(more, s, step))

    whole = let(F.aggregate(F.sequence(F.lit(1), F.lit(_SEGMENTS)), start, step), walked)
    return F.struct(whole["w"].alias("w"), whole["h"].alias("h"))


def image_size(content: Column) -> Column:
    """Struct of ``w`` and ``h`` from the header of a PNG, JPEG or WebP image; nulls if it is none."""
    size = lambda w, h: F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))
    first = F.hex(F.substring(content, 1, 16))
    long = F.octet_length(content)
    png = size(_number(F.substring(content, 17, 4)), _number(F.substring(content, 21, 4)))
    plain = size(_little(content, 27, 2).bitwiseAND(F.lit(0x3FFF)), _little(content, 29, 2).bitwiseAND(F.lit(0x3FFF)))
    bits = F.conv(F.hex(F.concat(*[F.substring(content, 22 + k, 1) for k in (3, 2, 1, 0)])), 16, 10).cast("bigint")
    lossless = size(bits.bitwiseAND(F.lit(0x3FFF)) + 1, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1)
    extended = size(_little(content, 25, 3) + 1, _little(content, 28, 3) + 1)
    webp = first.startswith("52494646") & (F.substring(first, 17, 8) == "57454250")
    kind = F.substring(first, 25, 8)
    return (
        F.when(first.startswith("89504E470D0A1A0A") & (long >= 24), png)
        .when(first.startswith("FFD8"), _jpeg_size(content))
        .when(webp & (kind == "56503820") & (long >= 30), plain)
        .when(webp & (kind == "5650384C") & (long >= 25), lossless)
        .when(webp & (kind == "56503858") & (long >= 30), extended)
        .otherwise(size(F.lit(None), F.lit(None)))
    )


def image_counts(records: DataFrame, images: DataFrame, key: str = "id", path: str = "image_path") -> DataFrame:
    """One row: ``with_image``, the records with a whole-number id and an image path, and ``bad_image``, those whose file isn't there or is no image. ``images``: ``path``, ``content``."""
    named = records.where(F.col(key).cast("string").try_cast("bigint").isNotNull() & (F.col(path) != ""))
    sizes = images.select(F.col("path").alias("_path"), image_size(F.col("content")).alias("_size"))
    found = named.join(sizes, F.col(path) == F.col("_path"), "left")
    return found.agg(F.count("*").alias("with_image"), F.count_if(F.col("_size.w").isNull()).alias("bad_image"))


def dataset(spark: SparkSession, name: str) -> DataFrame:
    """``path`` or ``path@split``: a file or folder, the split (train unless given) as a subfolder or a file of that name if there is one."""
    path, _, split = name.partition("@")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(conf)
    if not system.exists(hadoop):
        raise FileNotFoundError(path)
    if system.getFileStatus(hadoop).isDirectory():
        names = sorted(s.getPath().getName() for s in system.listStatus(hadoop))
        mine = [n for n in names if n == (split or "train") or n.rpartition(".")[0] == (split or "train")]
        if mine:
            return dataset(spark, f"{path.rstrip('/')}/{mine[0]}")
        shown = [n for n in names if not n.startswith(("_", "."))]
        path, kind = path, (shown[0] if shown else "").rpartition(".")[2]
    else:
        kind = path.rpartition(".")[2]
    kind = {"jsonl": "json", "txt": "text"}.get(kind, kind)
    if kind not in ("parquet", "json", "csv", "text"):
        raise ValueError(f"can't tell the format of {name!r}")
    return spark.read.format(kind).options(header=True).load(path)


#: Column names that hold a corpus's text, by preference, in tables and in JSON lines.
TEXT_COLUMNS = ("answer", "code", "response", "text", "content", "output", "generated_code")
JSON_FIELDS = ("code", "response", "text", "content")


def text_column(df: DataFrame, names: Sequence[str] = TEXT_COLUMNS) -> str:
    """The first preferred column, else the first of strings; raises ValueError without any."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for name in names:
        if name in strings:
            return name
    if not strings:
        raise ValueError("no column of strings")
    return strings[0]


def looks_like_tex(text: Column) -> Column:
    return text.contains("\\") | F.lower(text).contains("tikz") | F.lower(text).contains("document")


def corpus(df: DataFrame, least: int = 10, tex: bool = False) -> DataFrame:
    """``text``: the texts of more than ``least`` characters; ``tex``: only what looks like TeX."""
    text = F.col(text_column(df))
    out = df.select(text.alias("text")).where(F.length("text") > least)
    return out.where(looks_like_tex(F.col("text"))) if tex else out


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``text``: of each JSON line the first field of ``JSON_FIELDS`` that isn't empty; unreadable lines and lines without one go."""
    rows = jsonl(spark, path, ", ".join(f"{c} string" for c in JSON_FIELDS))
    return rows.select(F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in JSON_FIELDS]).alias("text")).where("text IS NOT NULL")


def blocks(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """``text`` of text files: the trimmed parts between empty lines that look like TeX; if there are none, runs of lines that aren't blank. Shorter ones than ``least`` + 1 go."""
    parts = spark.read.text(path, lineSep="\n\n")
    whole = parts.select(F.regexp_replace("value", r"\A\s+|\s+\z", "").alias("text")).where((F.length("text") > least) & looks_like_tex(F.col("text")))
    if len(parts.take(2)) > 1 and not whole.isEmpty():
        return whole
    runs = parts.select(F.explode(F.split("value", r"(?:\A|\n)[^\S\n]*(?:\n[^\S\n]*)*(?:\n|\z)")).alias("text"))
    return runs.where(F.length("text") > least)


def template(spark: SparkSession, folder: str, name: str) -> str:
    """The text of the template ``name``.txt of a folder; raises FileNotFoundError without one."""
    path = f"{folder.rstrip('/')}/{name}.txt"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()[0]


def uses_image(text: str) -> bool:
    return "{<|image_pad|>}" in text


@dataclass(frozen=True)
class Entry:
    """A dataset of a registry: where it is, its layout (alpaca or sharegpt), and how its columns and roles are named."""

    path: str
    formatting: str = "alpaca"
    columns: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    subset: str | None = None
    split: str = "train"
    ranking: bool = False
    samples: int | None = None


def registry(config: dict[str, dict]) -> dict[str, Entry]:
    """Entries from a configuration; raises ValueError for an unknown layout. A ``folder`` stands before the file's name."""
    out = {}
    for name, raw in config.items():
        path = raw.get("file_name") or raw.get("hf_hub_url") or raw.get("script_url", "")
        path = f"{raw['folder'].rstrip('/')}/{path}" if raw.get("folder") else path
        entry = Entry(path, raw.get("formatting", "alpaca"), raw.get("columns", {}), raw.get("tags", {}), raw.get("subset"), raw.get("split", "train"), bool(raw.get("ranking")), raw.get("num_samples"))
        if entry.formatting not in ("alpaca", "sharegpt"):
            raise ValueError(f"{name}: unknown formatting {entry.formatting!r}")
        out[name] = entry
    return out


def read(spark: SparkSession, entry: Entry) -> DataFrame:
    """The entry's table with ``messages``; with ``ranking`` also ``chosen`` and ``rejected``."""
    path = f"{entry.path.rstrip('/')}/{entry.subset}" if entry.subset else entry.path
    df = dataset(spark, path if entry.split == "train" else f"{path}@{entry.split}")
    # which rows are taken is a matter of what they hold, so reruns agree
    df = df.orderBy(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).cast("binary"))).limit(entry.samples) if entry.samples else df
    df = alpaca(df, entry) if entry.formatting == "alpaca" else sharegpt(df, entry)
    return df.withColumns({c: F.col(entry.columns.get(c, c)) for c in ("chosen", "rejected")}) if entry.ranking else df


def sharegpt(df: DataFrame, entry: Entry) -> DataFrame:
    """``messages`` (array of role, content) of rows with an array of messages, a system text in front; raises where a role is unknown."""
    tag = lambda k, d: entry.tags.get(k, d)
    names = {tag("user_tag", "human"): "user", tag("assistant_tag", "gpt"): "assistant", tag("observation_tag", "observation"): "observation", tag("function_tag", "function_call"): "function", tag("system_tag", "system"): "system"}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def turn(m: Column) -> Column:
        said = m[tag("role_tag", "from")]
        role = F.coalesce(F.try_element_at(known, said), F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(said, F.lit("none")))).cast("string"))
        return F.struct(role.alias("role"), m[tag("content_tag", "value")].alias("content"))

    turns = F.transform(F.col(entry.columns.get("messages", "conversations")), turn)
    system = entry.columns.get("system", "system")
    if system in df.columns:
        front = F.when(F.col(system) != "", F.array(F.struct(F.lit("system").alias("role"), F.col(system).alias("content"))))
        turns = F.when(front.isNotNull(), F.concat(front, turns)).otherwise(turns)
    return df.withColumn("messages", turns)


def alpaca(df: DataFrame, entry: Entry) -> DataFrame:
    """``messages`` (array of role, content) of rows with prompt, query and response columns."""
    name = lambda k, d: entry.columns.get(k, d)
    query = F.coalesce(F.col(name("query", "input")), F.lit("")) if name("query", "input") in df.columns else F.lit("")
    prompt = F.concat_ws("\n", F.col(name("prompt", "instruction")), F.when(query != "", query))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.withColumn("messages", F.array(turn("user", prompt), turn("assistant", F.col(name("response", "output")))))


def messages(question: Column) -> Column:
    """One user message as parts: text and ``<image>`` or ``<video>`` marks in order, empty texts left out."""
    marked = F.regexp_replace(question, "(<image>|<video>)", "\x1e$1\x1e")
    parts = F.filter(F.split(marked, "\x1e"), lambda p: p != "")
    kind = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text")))


def api_messages(system: str, question: Column, url: Column, contract: str) -> Column:
    """JSON of a system message, an image and a question with the output contract."""
    user = F.concat(question, F.lit("\n\n" + contract))
    image = F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url"), F.lit(None).cast("string").alias("text"))
    text = F.struct(F.lit("text").alias("type"), F.lit(None).cast("struct<url:string>").alias("image_url"), user.alias("text"))
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("struct<url:string>").alias("image_url"), F.lit(system).alias("text"))).alias("content")), F.struct(F.lit("user").alias("role"), F.array(image, text).alias("content"))))
