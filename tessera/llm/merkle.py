"""A Merkle manifest of a table, with proofs looked up by coordinates; DataFrame functions only.

H is the lowercase hex SHA-256 of its inputs one behind the other, digests as hex text.
A row's leaf is H of its fields, each its UTF-8 bytes behind their number and ``:``, or
``-`` if null. The leaves of a group, ascending by key, make a tree: every ``FAN``
consecutive nodes of a level (the last run may be shorter, even a single node) become
their H, until one node is left, the group's subroot. The subroots, by group (null first,
else by UTF-8 bytes), make a tree of the same kind, whose last node is the root.

All nodes of all trees are one table: tree (number of the group, -1 for the tree over the
groups), level, place, digest. ``STEP`` levels are made at a time, from groups of
``FAN ** STEP`` nodes, so no task holds a tree. A leaf's proof is looked up: from its place
and its group's size follow the coordinates of its siblings, which are exploded, joined
with the table of nodes, put in order and folded. Nodes above ``HOT``-ths of the leaves are
asked for by many; there are at most ``6 * HOT`` of them whatever the sizes of the groups,
so they are broadcast, and no key of the exchanged join is asked for by more than about
``2 / HOT`` of the leaves. Proofs of the groups within their tree are looked up once a group.

Rows are numbered by ranges of (group, key, leaf), so a hot group is dealt to many tasks.
Rows with a null key stand first in their group; rows of equal key go by their leaf, and
repeated rows, which have equal leaves, stand side by side, each with its own place. Null
and empty texts have different leaves. A very long text is hashed in one piece, once. An
empty table has no root: nothing is returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lines import small
from tessera.llm.storage import scratch, written

FAN = 3
#: Levels made from one grouping.
STEP = 4
HOT = 1 << 13
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """The SHA-256 as bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def shown(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields."""
    said = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]))


def height(count: Column) -> Column:
    """The levels above ``count`` leaves: how often their number, rounded up, is divided by ``FAN`` until one is left."""
    powers = F.array(*[F.lit(FAN**k) for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < count))


def power(level: Column) -> Column:
    """``FAN`` to a level that is a column."""
    return F.element_at(F.array(*[F.lit(FAN**k) for k in range(40)]), level + 1)


def numbered(rows: DataFrame, group: str, order: Sequence[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the number ``tree`` of their group, in the order of groups, and ``place`` in it; and the groups with ``tree`` and ``count``.

    Ranges of the whole order are counted, so a group may lie in many tasks. Equal rows of
    the order are dealt to ranges by the column ``row``, a number that differs in all rows.
    """
    whole = [group, *order, "row"]
    ranged = written(rows.repartitionByRange(parts, *whole).withColumn("_part", F.spark_partition_id()), "ranges")
    pieces = written(ranged.groupBy(group, "_part").agg(F.count("*").alias("n")), "pieces")
    # a group's pieces are at most the ranges, a range's pieces are what it holds
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), before.alias("_before"))
    counts = pieces.groupBy(group).agg(F.sum("n").alias("count"), F.min("_part").alias("_part"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(group)) - 1
    first = counts.groupBy("_part").agg(F.count("*").alias("n"))
    ahead = first.select(F.col("_part").alias("_first"), (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_ahead"))
    placed = counts.withColumn("_inside", inside).join(F.broadcast(ahead), F.col("_part") == F.col("_first"))
    groups = written(placed.select(F.col(group).alias("_named"), (F.col("_ahead") + F.col("_inside")).cast("long").alias("tree"), "count"), "groups")
    own = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order, "row")) - 1
    there = ranged.withColumn("_own", own).join(small(written(starts, "starts")), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    out = there.join(small(groups.select("_named", "tree", "count")), F.col(group).eqNullSafe(F.col("_named")))
    return written(out.select(*rows.columns, "tree", (F.col("_own") + F.col("_before")).cast("long").alias("place"), "count"), "numbered"), groups


def _runs(below: Column) -> Column:
    """The digests of every ``FAN`` consecutive ones."""
    places = F.sequence(F.lit(0), F.ceil(F.size(below) / FAN).cast("int") - 1)
    return F.transform(places, lambda i: digest(F.array_join(F.transform(F.slice(below, i * FAN + 1, F.lit(FAN)), shown), "")))


def trees(leaves: DataFrame) -> DataFrame:
    """For leaves (``tree``, ``place``, ``digest``, ``count`` of the tree): the nodes of all levels below each tree's last one, and those, as ``tree``, ``level``, ``place``, ``digest``."""
    level, out = 0, None
    live = leaves.select("tree", "place", "digest", "count")
    while True:
        nodes = live.select("tree", F.lit(level).alias("level"), "place", "digest")
        out = nodes if out is None else out.unionByName(nodes)
        more = live.where("count > 1")
        if more.isEmpty():
            return out
        members = more.groupBy("tree", "count", F.floor(F.col("place") / FAN**STEP).cast("long").alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        levels = members.select("tree", "count", "run", F.transform("nodes", lambda x: x["digest"]).alias("d0"))
        for k in range(1, STEP + 1):
            # a tree ends at the level that has one node
            more = (F.col("count") > FAN ** (k - 1)) & (F.size(f"d{k - 1}") > 0)
            levels = levels.withColumn(f"d{k}", F.when(more, _runs(F.col(f"d{k - 1}"))).otherwise(F.array().cast("array<binary>")))
        made = written(levels.drop("d0"), "levels")
        for k in range(1, STEP):
            inner = made.select("tree", F.lit(level + k).alias("level"), (F.col("run") * FAN ** (STEP - k)).alias("first"), F.posexplode(f"d{k}").alias("at", "digest"))
            out = out.unionByName(inner.select("tree", "level", (F.col("first") + F.col("at")).alias("place"), "digest"))
        last = F.posexplode(f"d{STEP}").alias("at", "digest")
        live = made.select("tree", F.col("run").alias("place"), F.ceil(F.col("count") / FAN**STEP).cast("long").alias("count"), last).drop("at")
        live = live.select("tree", "place", "digest", "count")
        level += STEP


def siblings(leaves: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """For leaves (``row``, ``tree``, ``place``, ``count``; ``total`` of them): ``row`` and its ``siblings``, an array of level, place, digest in order; leaves without any are left out."""
    levels = F.when(F.col("count") > 1, F.sequence(F.lit(0), height(F.col("count")) - 1)).otherwise(F.array().cast("array<int>"))
    at = leaves.select("row", "tree", "place", "count", F.explode(levels).alias("level"))
    at = at.select("row", "tree", "level", F.floor(F.col("place") / power(F.col("level"))).cast("long").alias("own"), F.ceil(F.col("count") / power(F.col("level"))).cast("long").alias("width"))
    first = F.col("own") - F.col("own") % FAN
    run = F.filter(F.sequence(first, F.least(first + FAN - 1, F.col("width") - 1)), lambda p: p != F.col("own"))
    asked = at.select("row", "tree", "level", F.explode(run).alias("place"))
    # a node of level k is asked for by at most 2 * FAN**k leaves, and trees above have at most 2 * total / FAN**k nodes there
    cut = 0
    while FAN**cut * HOT < total:
        cut += 1
    places = ["tree", "level", "place"]
    often = asked.where(F.col("level") >= cut).join(F.broadcast(nodes.where(F.col("level") >= cut)), places)
    seldom = asked.where(F.col("level") < cut).join(nodes.where(F.col("level") < cut), places)
    return often.unionByName(seldom).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("level", "place", "digest"))).alias("siblings"))


def folded(start: Column, place: Column, count: Column, found: Column) -> Column:
    """The root that a leaf's digest leads to with its siblings."""
    levels = F.when(count > 1, F.sequence(F.lit(0), height(count) - 1)).otherwise(F.array().cast("array<int>"))

    def step(own: Column, level: Column) -> Column:
        at = F.floor(place / power(level)).cast("long")
        side = lambda keep: F.array_join(F.transform(F.filter(found, lambda s: (s["level"] == level) & keep(s["place"], at)), lambda s: shown(s["digest"])), "")
        return digest(F.concat(side(lambda p, a: p < a), shown(own), side(lambda p, a: p > a)))

    return F.aggregate(levels, start, step)


def joined_digests(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: shown(s["digest"])), "")


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "source", tampered: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (H of all siblings up to the root), ``folded_root`` and ``verified``.

    ``folded_root`` is folded from the leaf with the fields ``tampered`` (name: column of
    ``rows``) in place of its own, and the siblings of the manifest.
    """
    spark = rows.sparkSession
    changed = [(tampered or {}).get(f, F.col(f"`{f}`")) for f in fields]
    both = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("group"), leaf([F.col(f"`{f}`") for f in fields]).alias("leaf"), leaf(changed).alias("other"))
    # numbers are written with their rows, so a task that runs again finds the same ones
    with scratch() as keep:
        leaves = written(both.withColumn("row", F.monotonically_increasing_id()), "leaves", hashes=True)
        total = leaves.count()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed, groups = numbered(leaves, "group", ["key", "leaf"], parts)
        keep(placed)
        nodes = keep(written(trees(placed.withColumnRenamed("leaf", "digest")), "nodes", hashes=True))
        tops = nodes.join(groups.select("tree", height(F.col("count")).alias("level")), ["tree", "level"]).select("tree", F.col("digest").alias("subroot"))
        subroots = written(groups.join(tops, "tree").select("tree", "count", "subroot"), "subroots", hashes=True)
        among = subroots.count()
        upper = subroots.select(F.col("tree").alias("row"), F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("digest"), F.lit(among).cast("long").alias("count"))
        above = written(trees(upper), "upper-nodes", hashes=True)
        none = F.array().cast("array<struct<level:int,place:bigint,digest:binary>>")
        top = above.where(F.col("level") == height(F.lit(among))).select("digest").first()
        root = F.lit(bytes(top[0]) if top else b"")
        ways = siblings(upper, above, among).withColumnsRenamed({"row": "tree", "siblings": "_upper"})
        known = small(keep(written(subroots.select("tree", "subroot").join(ways, "tree", "left").withColumn("_upper", F.coalesce("_upper", none)), "ways", hashes=True)))
    found = siblings(placed, nodes, total)
    whole = placed.join(found, "row", "left").join(known, "tree").withColumn("siblings", F.coalesce("siblings", none))
    lower = folded(F.col("other"), F.col("place"), F.col("count"), F.col("siblings"))
    last = whole.select("key", "leaf", "subroot", "siblings", "_upper", "tree", lower.alias("lower"))
    ended = folded(F.col("lower"), F.col("tree"), F.lit(among).cast("long"), F.col("_upper"))
    proof = F.sha2(F.concat(joined_digests(F.col("siblings")), joined_digests(F.col("_upper"))).cast("binary"), 256)
    out = last.select(F.col("key").alias(key), shown(F.col("leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(root).alias("root"), proof.alias("proof_sha256"), shown(ended).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def sql(tampered_text: str, before: str = "", levels: int = 12) -> str:
    """DuckDB SQL of :func:`manifest` over ``documents``, for at most ``FAN ** levels`` rows a source; ``tampered_text`` is SQL of the text."""
    said = lambda f: f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || {f} END"
    leaf_ = lambda text: "sha256(" + " || ".join(said(text if f == "text" else f) for f in FIELDS) + ")"
    tree = lambda name, start: ", ".join(
        [f"{name}0 AS MATERIALIZED ({start})"]
        + [
            f"{name}{k} AS MATERIALIZED (SELECT tree, place // {FAN} AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest, (any_value(count) + {FAN - 1}) // {FAN} AS count FROM {name}{k - 1} WHERE count > 1 GROUP BY tree, place // {FAN})"
            for k in range(1, levels + 1)
        ]
        + [f"{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT *, {k} AS level FROM {name}{k}" for k in range(levels + 1)) + ")"]
    )
    near = lambda name, rows: f"SELECT l.id, string_agg(n.digest, '' ORDER BY n.level, n.place) AS proof FROM {rows} l JOIN {name} n ON n.tree = l.tree AND n.count > 1 AND (l.place // ({FAN} ** n.level)::BIGINT) // {FAN} = n.place // {FAN} AND l.place // ({FAN} ** n.level)::BIGINT <> n.place GROUP BY l.id"

    def climbed(name: str, nodes: str, start: str) -> str:
        steps = [f"{name}0 AS MATERIALIZED ({start})"]
        for k in range(levels):
            run = f"SELECT string_agg(CASE WHEN n.place = a.place // {FAN**k} THEN a.digest ELSE n.digest END, '' ORDER BY n.place) FROM {nodes}{k} n WHERE n.tree = a.tree AND n.count > 1 AND n.place // {FAN} = a.place // {FAN ** (k + 1)}"
            steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT id, tree, place, CASE WHEN run IS NULL THEN digest ELSE sha256(run) END AS digest FROM (SELECT a.*, ({run}) AS run FROM {name}{k} a))")
        return ", ".join(steps)

    return f"""
    WITH {before} l0 AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS count, row_number() OVER () AS id
      FROM (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf_('text')} AS leaf, {leaf_(tampered_text)} AS other FROM documents)),
    {tree('n', 'SELECT tree, place, leaf AS digest, count FROM l0')},
    s AS MATERIALIZED (SELECT tree, digest, (SELECT count(DISTINCT tree) FROM l0) AS among FROM n WHERE count = 1),
    {tree('m', 'SELECT -1 AS tree, tree AS place, digest, among AS count FROM s')},
    t AS (SELECT digest AS root FROM m WHERE count = 1),
    p AS MATERIALIZED ({near('n', 'l0')}),
    q AS MATERIALIZED ({near('m', '(SELECT tree AS id, -1 AS tree, tree AS place FROM s)')}),
    {climbed('f', 'n', 'SELECT id, tree, place, other AS digest FROM l0')},
    {climbed('h', 'm', f'SELECT id, -1 AS tree, tree AS place, digest FROM f{levels}')}
    SELECT l0.doc_id, l0.leaf, s.digest AS subroot, t.root, sha256(coalesce(p.proof, '') || coalesce(q.proof, '')) AS proof_sha256,
      h{levels}.digest AS folded_root, h{levels}.digest = t.root AS verified
    FROM l0 JOIN s ON s.tree = l0.tree JOIN h{levels} ON h{levels}.id = l0.id LEFT JOIN p ON p.id = l0.id LEFT JOIN q ON q.id = l0.tree, t"""
