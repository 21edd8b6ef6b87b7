"""Fuzzy line deduplication by MinHash.

A line is a part of a text between line feeds, compared in lower case without blanks,
tabs and carriage returns at its ends. Equal lines are the same line. Different lines
are linked when the Jaccard similarity of their character shingles is ``JACCARD`` or
more, and of every component of lines the first one stays: the least (id, text hash,
position). Blank lines stay where they are and take no part.

DataFrame functions only. Of every different line the shingles are hashed ``STEP`` positions
a row, and the least of their hashes in each of ``TURNS`` orders are taken in compiled code;
lines are dealt by their numbers before, so these rows are never shuffled.

Lines that share a band are candidates. Bands with the same lines count once. The lines
of a band form a cell, in which all pairs are settled by their exact similarity; a band
of more than about ``BLOCK`` characters or ``LINES`` lines is cut into blocks, each pair
of blocks being a cell of its own, so no task holds more and no pair is left out. In a cell
of more than ``FEW`` lines one is compared with all first; of two lines that are both
similar to it, the pair needs no look of its own. Components come from repeated contraction
of the links, on all machines.

A line's number is a 64-bit hash. A second hash tells different lines of one number
apart; such lines take their second hash as number.

Only hashes are shuffled before the verification, then the texts of lines that share a
band. A table that the rest is joined with is broadcast when its rows take at most
``SMALL`` bytes; a larger one is shuffled.

A null text stays null, an empty one empty. A text that loses all its lines becomes
empty; its row stays. Rows that agree in id and text are one document: they keep the
same lines. Further columns pass through. A line is worked on whole, so a task's memory
grows with its longest line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let
from tessera.llm.components import components
from tessera.llm.storage import dropped, unused, written

JACCARD = 0.8
#: Code points of a shingle; a shorter line is its only one. ``BANDS`` bands of ``ROWS`` least hashes.
CHARS, BANDS, ROWS = 9, 10, 3
#: Shingles that are hashed in one row: with more, the compiled method gets too long for the JIT.
STEP = 4
#: The same where they are gathered in an array.
WIDE = 16
#: Lines of a cell up to which all its pairs are looked at.
FEW = 8
#: Characters and lines of a block of a band.
BLOCK, LINES = 1 << 18, 512
#: Bytes of rows up to which a table of ids is broadcast.
SMALL = 16 << 20
_TRIMMED = " \t\r"
#: Masks that put the hashes in as many orders: the least is the one nearest to a turn of the circle.
TURNS = [(k * ((1 << 64) // (BANDS * ROWS)) + 0x1234567890AB) % (1 << 64) - (1 << 63) for k in range(BANDS * ROWS)]
#: Bytes of a code point and of a shingle in UTF-32, where any place is found without a walk.
_WIDTH = 4
_SHINGLE = CHARS * _WIDTH


def _named(column: str) -> Column:
    return F.col(f"`{column}`")


def compared(line: str) -> str:
    """A line as it is compared."""
    return line.strip(_TRIMMED).lower()


def blank(line: Column) -> Column:
    return F.trim(line, F.lit(_TRIMMED)) == ""


def shown(line: Column) -> Column:
    """:func:`compared` as a column."""
    return F.lower(F.trim(line, F.lit(_TRIMMED)))


def _steps(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """``keys``, ``code`` of the ``line`` and ``at``: every ``step``-th position up to the ``last`` shingle."""
    last = F.greatest(F.length("line") - CHARS, F.lit(0))
    whole = rows.select(*keys, F.encode("line", "UTF-32").alias("code"), last.alias("last"))
    return whole.select(*keys, "code", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(step))).alias("at"))


def _hashed(k: int) -> Column:
    """The hash of the shingle ``k`` behind ``at``; behind the end the last one again."""
    return F.xxhash64(F.substring("code", F.least(F.col("at") + k, F.col("last")) * _WIDTH + 1, F.lit(_SHINGLE)))


def banded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the different ``bands`` of each ``line``, which isn't empty; nothing is shuffled if rows are dealt by some of the keys.

    A band is a hash of ``ROWS`` shingles' hashes, each the least in an order of its own.
    """
    steps = _steps(rows, keys, STEP)
    hashed = steps.select(*keys, *[_hashed(k).alias(f"h{k}") for k in range(STEP)])
    least = [F.min(F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(turn)) for k in range(STEP)])).alias(f"m{i}") for i, turn in enumerate(TURNS)]
    found = hashed.groupBy(*keys).agg(*least)
    band = lambda b: F.xxhash64(*[F.col(f"m{i}").bitwiseXOR(F.lit(TURNS[i])) for i in range(b, len(TURNS), BANDS)])
    return found.select(*keys, F.array_distinct(F.array(*[band(b) for b in range(BANDS)])).alias("bands"))


def signatures(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Per different line that isn't blank ``line_id``, ``second``, ``bands`` and where it stands ``first``: ``doc``, ``hash`` of the document's text, ``pos``."""
    rows = docs.select(_named(key).alias("doc"), F.xxhash64(_named(text)).alias("hash"), _named(text).alias("text")).where("text <> ''")
    parts = rows.select("doc", "hash", F.posexplode(F.split("text", "\n")).alias("pos", "part")).where(~blank(F.col("part")))
    lines = parts.select(F.struct("doc", "hash", "pos").alias("place"), shown(F.col("part")).alias("line"))
    once = lines.groupBy(F.xxhash64("line").alias("line_id"), F.xxhash64(F.lit("second"), "line").alias("second")).agg(F.min(F.struct("place", "line")).alias("least"))
    return banded(once.select("line_id", "second", F.col("least.place").alias("first"), F.col("least.line").alias("line")), ["line_id", "second", "first"])


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few enough for that."""
    width = 8 + sum(64 if f.dataType.simpleString() in ("string", "array<bigint>") else 8 for f in table.schema)
    return F.broadcast(table) if table.count() * width <= SMALL else table


def _shared(keys: DataFrame) -> DataFrame:
    """``band``, ``line_id``: the lines of every band that has different ones, of bands with the same lines one."""
    dealt = keys.select("line_id", F.explode("bands").alias("band"))
    least = dealt.groupBy("band").agg(F.min("line_id").alias("one"), F.max("line_id").alias("two")).where("one <> two")
    shared = written(least.select("band"), "bands", hashes=True)
    members = written(dealt.join(small(shared), "band").distinct(), "members", hashes=True)
    named = members.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("line_id")).alias("all"), F.min("line_id").alias("one"), F.max("line_id").alias("two"))
    once = written(named.groupBy("n", "all", "one", "two").agg(F.min("band").alias("band")).select("band"), "bands", hashes=True)
    out = written(members.join(small(once), "band"), "members", hashes=True)
    dropped(shared, members, once)
    return out


def _texts(docs: DataFrame, asked: DataFrame, firsts: DataFrame, text: str, key: str) -> DataFrame:
    """``line_id``, ``line`` and ``chars`` of the lines ``asked`` for, read from where they stand first."""
    at = written(firsts.join(small(asked).drop("bands"), "line_id").select("line_id", "first.*"), "at", hashes=True)
    held = written(at.select("doc", "hash").distinct(), "holders", hashes=True)
    some = docs.select(_named(key).alias("_id"), _named(text).alias("_text"), F.xxhash64(_named(text)).alias("_code"))
    some = some.join(small(held), some._id.eqNullSafe(F.col("doc")) & (F.col("_code") == F.col("hash")), "left_semi")
    lines = some.select("_id", "_code", F.posexplode(F.split("_text", "\n")).alias("_pos", "line"))
    there = small(at)
    found = lines.join(there, (lines._pos == there.pos) & (lines._code == there.hash) & lines._id.eqNullSafe(there.doc))
    whole = written(found.select("line_id", "line", F.length("line").alias("chars")), "line-texts", hashes=True)
    if whole.count() > at.count():  # rows that agree in id and text stand for the same lines
        once = written(whole.dropDuplicates(["line_id"]), "line-texts", hashes=True)
        dropped(whole)
        whole = once
    dropped(at, held)
    return whole


def _cells(members: DataFrame, texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``band``, ``i``, ``j``, ``side``, ``line_id``, ``line`` and all ``bands`` of the line: the lines of each cell; ``side`` is 0 in a block with itself, else 1 and 2."""
    sized = members.join(texts.select("line_id", "chars"), "line_id").groupBy("band").agg(F.greatest(F.ceil(F.sum("chars") / BLOCK), F.ceil(F.count("*") / LINES)).cast("int").alias("blocks"))
    large = written(sized.where("blocks > 1"), "large-bands", hashes=True)
    if large.isEmpty():
        zero = F.col("band").bitwiseAND(F.lit(0)).cast("int")  # no literal, which would leave the groups' keys but not those that rows are dealt by
        cells = members.select("band", "line_id", zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"))
    else:
        own = F.pmod(F.xxhash64("line_id", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int")
        each = members.join(small(large), "band", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        cells = each.select("band", "line_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    return cells.join(texts.select("line_id", "line").join(asked, "line_id"), "line_id")


def _near(a: Column, b: Column, jaccard: float) -> Column:
    """Whether two sets have this Jaccard similarity or more; sets whose sizes are too far apart aren't met."""
    size = F.size(a) + F.size(b)
    apart = F.least(F.size(a), F.size(b)) < F.greatest(F.size(a), F.size(b)) * jaccard - 0.5
    return ~apart & (F.size(F.array_intersect(a, b)) >= size * (jaccard / (1 + jaccard)) - 1e-6)  # common >= jaccard * (size - common), the sets met once


def similar(cells: DataFrame, jaccard: float) -> DataFrame:
    """Links ``a``, ``b`` that connect the similar lines of every cell.

    Of a cell with more than ``FEW`` lines, all are compared with the first; then the ones
    that aren't like it with every other, so pairs of two that are need no row. Other pairs
    are settled in the least of the bands that both lines have.
    """
    places = ["band", "i", "j"]
    count = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select(*places, "side", "line_id", "bands", shown(F.col("line")).alias("line")).repartition(count, *places)
    whole = [*places, "side", "line_id"]
    hashed = _steps(dealt, [*whole, "bands"], WIDE).select(*whole, "bands", F.array(*[_hashed(k) for k in range(WIDE)]).alias("hashes"))
    sets = hashed.groupBy(*whole).agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("set"), F.first("bands").alias("bands"))
    read = sets.groupBy(*places).agg(F.collect_list(F.struct("line_id", "side", "bands", "set")).alias("cell"))
    n = F.size("cell")
    alike = F.when(n > FEW, let(F.get("cell", F.lit(0)).set, lambda first: F.transform("cell", lambda x: _near(x.set, first, jaccard)))).otherwise(F.array_repeat(F.lit(False), n))
    flagged = read.select("band", "cell", alike.alias("alike"), F.transform("cell", lambda x: x.side).alias("side"))
    apart = lambda sides, k, v: (F.get(sides, k) == 0) | (F.get(sides, k) != F.get(sides, v))
    open_ = lambda flags, sides, k: F.filter(F.sequence(F.lit(0), F.size(flags) - 1), lambda v: (v != k) & (F.get(flags, v) | (v < k)) & apart(sides, k, v))
    others = lambda flags, sides: F.transform(flags, lambda like, k: F.struct(k.alias("k"), like.alias("like"), F.when(like, F.array(F.lit(0))).otherwise(open_(flags, sides, k)).alias("with")))
    todo = let(F.col("alike"), lambda flags: let(F.col("side"), lambda sides: others(flags, sides)))
    asked = flagged.select("band", "cell", todo.alias("todo")).select("band", "cell", F.explode_outer("todo").alias("one"))
    pairs = asked.select("band", "cell", F.col("one.k").alias("k"), F.col("one.like").alias("like"), F.explode_outer("one.with").alias("v")).where("v IS NOT NULL")
    a, b = F.get("cell", F.col("k")), F.get("cell", F.col("v"))
    here = F.array_min(F.array_intersect(a.bands, b.bands)) == F.col("band")
    return pairs.where(F.col("like") | (here & _near(a.set, b.set, jaccard))).select(a.line_id.alias("a"), b.line_id.alias("b"))


def _numbered(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keys`` and, by ``line_id``, where each line stands ``first``; different lines of one number get their second hash for it."""
    clashes = keys.groupBy("line_id").count().where("count > 1").select(F.col("line_id").alias("number"))
    if not clashes.isEmpty():
        apart = keys.join(clashes, keys.line_id == clashes.number, "left")
        again = written(apart.withColumn("line_id", F.when(F.col("number").isNotNull(), F.col("second")).otherwise(F.col("line_id"))).drop("number"), "signatures", hashes=True)
        dropped(keys)
        keys = again
    return keys, keys.select("line_id", "first")


def kept_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", jaccard: float = JACCARD) -> DataFrame:
    """Per document (``doc``, ``hash``) that keeps lines: ``kept``, the ascending positions of its kept lines that aren't blank."""
    keys, firsts = _numbered(written(signatures(docs, text, key), "signatures", hashes=True))
    members = _shared(keys)
    asked = written(members.groupBy("line_id").agg(F.collect_list("band").alias("bands")), "asked", hashes=True)
    texts = _texts(docs, asked, firsts, text, key)
    links = written(similar(_cells(members, texts, asked), jaccard), "line-links", hashes=True)
    roots = written(components(links), "line-roots", hashes=True)
    dropped(members, asked, texts, links)
    rooted = firsts.join(small(roots), firsts.line_id == roots.node, "left")
    alone = rooted.where("root IS NULL").select("first.*")
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return alone.union(least).groupBy("doc", "hash").agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", jaccard: float = JACCARD, counts: tuple[str, str] = ("__lines", "__kept")) -> DataFrame:
    """``docs`` with only the kept lines in ``text``, and as ``counts`` the number of lines before and after; a name that ``docs`` has gets underscores before it."""
    kept = kept_lines(docs, text, key, jaccard)
    names = docs.columns
    before, after = (unused(c, names) for c in counts)
    whole = docs.select(F.struct(*[_named(c) for c in names]).alias("row"), _named(key).alias("_id"), F.xxhash64(_named(text)).alias("_hash"))
    joined_ = whole.join(kept.hint("shuffle_hash"), whole._id.eqNullSafe(kept.doc) & (whole._hash == kept.hash), "left")
    said = F.col("row").getField(text)
    parts = F.split(said, "\n")
    empty = F.filter(F.transform(parts, lambda x, k: F.when(blank(x), k)), lambda k: k.isNotNull())
    stay = F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), F.col("blank")))
    cut = joined_.withColumn("parts", parts).withColumn("blank", empty).withColumn("stay", stay)
    rest = F.array_join(F.transform("stay", lambda k: F.get("parts", k)), "\n")
    rest = F.when(F.col("kept").isNull() & (F.size("blank") < F.size("parts")), F.lit("")).otherwise(rest)
    out = [F.when(said.isNotNull(), rest).alias(text) if c == text else F.col("row").getField(c).alias(c) for c in names]
    return cut.select(*out, F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias(before), F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias(after))
