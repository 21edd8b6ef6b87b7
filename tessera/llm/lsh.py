"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the integer parts of ``HASHES`` random Gaussian projections
over the bucket width. A query visits, table by table, perturbed buckets (up to two steps
in each place) in order of their estimated success: the probability that a neighbour at
the usual distance lies there, as its projections differ from the query's by Gaussians of
that size. It goes on until the buckets' success adds up to what ``TABLES`` tables need to
miss a neighbour with probability 1 - ``SUCCESS``, or all ``HALF`` x ``HALF`` likeliest
ones are visited. The candidates of all tables are merged and reranked by their exact
distance on the original vectors.

The usual distance is that of the ``k``-th neighbour, from a bounded sample that is drawn
by hash: in a sample of a share s of the vectors it is that of the neighbour number k * s
(the first at least), which errs to more probes. The width is ``WIDTH`` times it.

Buckets are dealt to parts by a hash of the bucket; a bucket of more than ``HOT`` vectors
is dealt to several. A vector goes to the parts of its buckets, one a table, and a query
to the parts of the buckets it visits, with their list; a part returns the ``k`` nearest of
each query there. So nothing is broadcast but the sample's distances, no task holds more
than a part's vectors, and the result depends neither on the number of parts nor on how
the table is stored.

Queries that found fewer than ``k`` vectors are searched among all vectors, in blocks of
``BLOCK`` queries; with ``exact`` all queries are.

Vectors that are null, zero or hold null or non-finite components, and rows with
a null id, take no part; vectors of another length than the query's are no candidates.
A query that is repeated counts once; repeated candidates are candidates each. Ties go to
the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lines import small
from tessera.llm.storage import dropped, scratch, written
from tessera.llm.vectors import matrix, usable
from tessera.shipping import ship

TABLES = 6
HASHES = 12
WIDTH = 2.0
SUCCESS = 0.95
HALF = 256
#: Vectors of a bucket from which it is dealt to several parts, and entries of a part.
HOT, PART = 1 << 14, 1 << 16
BLOCK = 4096
SAMPLE, ASKED = 4096, 128
SEED = 11
_STEPS = np.arange(-2, 3)
_ALL = np.stack(np.meshgrid(*[_STEPS] * (HASHES // 2), indexing="ij"), -1).reshape(-1, HASHES // 2)
_CDF = np.array([0.5 * (1 + erf(z / sqrt(2))) for z in np.linspace(-8, 8, 4097)])


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, between 4097 places."""
    return np.interp(z, np.linspace(-8, 8, 4097), _CDF)


@lru_cache(maxsize=8)
def projections(dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every table: projections, offsets, and multipliers that fold a bucket into one number."""
    rng = np.random.default_rng([SEED, dims])
    fold = rng.integers(1, 1 << 63, (TABLES, HASHES), np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.standard_normal((TABLES, dims, HASHES)), rng.uniform(0, 1, (TABLES, HASHES)), fold


def places(x: np.ndarray, width: float) -> np.ndarray:
    """Where vectors lie, counted in buckets: table, vector, hash."""
    project, offset, _ = projections(x.shape[1])
    return np.clip(np.nan_to_num((x / width) @ project + offset[:, None]), -(2.0**52), 2.0**52)


def folded(cells: np.ndarray, table: int, dims: int) -> np.ndarray:
    return (cells.astype(np.int64).view(np.uint64) * projections(dims)[2][table]).sum(-1, dtype=np.uint64) + np.uint64(table)


def keys(x: np.ndarray, width: float) -> np.ndarray:
    """The bucket of every vector in every table, folded."""
    cells = np.floor(places(x, width))
    return np.stack([folded(cells[t], t, x.shape[1]) for t in range(TABLES)], 1)


def probes(query: np.ndarray, width: float, success: float = SUCCESS) -> np.ndarray:
    """The buckets that a query visits in all tables, each table's likeliest first."""
    need = 1 - (1 - success) ** (1 / TABLES)
    out = []
    for table, at in enumerate(places(query[None], width)[:, 0]):
        own = np.floor(at)
        low = (_STEPS[None] - (at - own)[:, None]) * WIDTH
        mass = normal(low + WIDTH) - normal(low)
        halves = []
        for first in (0, HASHES // 2):
            chance = mass[first]
            for k in range(first + 1, first + HASHES // 2):
                chance = np.multiply.outer(chance, mass[k]).ravel()
            top = np.argpartition(-chance, HALF - 1)[:HALF]
            halves.append((top, chance[top]))
        chance = np.outer(halves[0][1], halves[1][1]).ravel()
        falling = np.sort(chance)[::-1]
        last = falling[min(int(np.searchsorted(np.cumsum(falling), need)), len(falling) - 1)]
        order = np.flatnonzero(chance >= last)
        order = order[np.argsort(-chance[order], kind="stable")]
        steps = np.hstack([_ALL[halves[0][0][order // HALF]], _ALL[halves[1][0][order % HALF]]])
        out.append(folded(own + steps, table, len(query)))
    return np.concatenate(out)


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, of scaled differences."""
    gap = x - query
    with np.errstate(over="ignore", under="ignore"):
        found = np.sqrt((gap * gap).sum(1))
    odd = ~np.isfinite(found) | (found < 1e-140)
    if odd.any():
        most = np.abs(gap[odd]).max(1)
        scale = np.where(most > 0, most, 1)
        found[odd] = scale * np.sqrt(((gap[odd] / scale[:, None]) ** 2).sum(1))
    return found


def best(ids: np.ndarray, n: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """The places of the nearest rows that hold the ``k`` nearest vectors; row j stands for ``n[j]`` of them."""
    if len(ids) > k:
        at = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
    else:
        at = np.arange(len(ids))
    at = at[np.lexsort((ids[at], distance[at]))]
    return at[: int(np.searchsorted(np.cumsum(n[at]), k)) + 1]


def usual_distance(rows: DataFrame, count: int, k: int) -> dict[int, float]:
    """By vector length: the distance in which a query's ``k``-th neighbour is expected, from a sample of at most about ``SAMPLE`` vectors."""
    share = F.pmod(F.xxhash64("node", F.lit("width")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(share < SAMPLE / max(1, count)).orderBy("node").select("v").toArrow()
    lengths = np.diff(drawn["v"].combine_chunks().offsets.to_numpy()) if len(drawn) else np.zeros(0, np.int64)
    out = {}
    for dims in np.unique(lengths).tolist():
        x = matrix(drawn.filter(pa.array(lengths == dims))["v"], dims)
        rank = min(max(1, round(k * min(1.0, SAMPLE / max(1, count)))), max(1, len(x) - 1))
        near = [np.sort(distances(x, q))[min(rank, len(x) - 1)] for q in x[:ASKED]]
        out[dims] = float(np.median(near)) or float(np.median(distances(x, np.zeros(dims))))
    return out


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A part's index rows, in order of their buckets, then its queries: the nearest of every query."""
    part, held, index = None, [], None

    def built() -> dict[int, tuple]:
        """By vector length: buckets, the distinct row of each, and the rows' ids, numbers, counts and vectors."""
        table, out = pa.Table.from_batches(held).combine_chunks(), {}
        lengths = np.diff(table["v"].combine_chunks().offsets.to_numpy())
        for dims in np.unique(lengths).tolist():
            some = table.filter(pa.array(lengths == dims)).combine_chunks()
            node, first, which = np.unique(some["node"].to_numpy(), return_index=True, return_inverse=True)
            few = some.take(pa.array(first))
            out[dims] = some["key"].to_numpy().view(np.uint64), which, few["id"].to_numpy(), node, few["n"].to_numpy(), matrix(few["v"], dims)
        return out

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            end = at + int(np.argmin(np.r_[(parts[at:] == parts[at]) & (kinds[at:] == kinds[at]), False]))
            if parts[at] != part:
                part, held, index = parts[at], [], None
            run, at = batch.slice(at, end - at), end
            if not kinds[at - 1]:
                held.append(run)
                continue
            index = (built() if held else {}) if index is None else index
            for row in range(run.num_rows):
                query = np.array(run.column("v")[row].values, np.float64)
                if len(query) not in index:
                    continue
                bucket, which, ids, node, n, x = index[len(query)]
                asked = np.array(run.column("keys")[row].values, np.int64).view(np.uint64)
                low, high = np.searchsorted(bucket, asked), np.searchsorted(bucket, asked, side="right")
                size = high - low
                own = run.column("id")[row].as_py()
                place = _distinct(which[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)], len(ids))
                place = place[ids[place] != own]
                distance = distances(x[place], query)
                top = best(ids[place], n[place], distance, k)
                place = place[top]
                full = np.full(len(place), 1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(full * run.column("node")[row].as_py()), pa.array(full * own), pa.array(node[place]), pa.array(ids[place]), pa.array(n[place]), pa.array(distance[top]), pa.array(full * len(ids))], _FOUND)


def _distinct(places: np.ndarray, count: int) -> np.ndarray:
    """Different places below ``count`` in order; by marks where most are there, else without a look at all of them."""
    if 8 * len(places) < count:
        return np.unique(places)
    marks = np.zeros(count, np.bool_)
    marks[places] = True
    return np.flatnonzero(marks)


_FOUND = ["query", "query_id", "node", "vec_id", "n", "score", "seen"]
_SCHEMA = ", ".join(f"{c} {'double' if c == 'score' else 'long'}" for c in _FOUND)


def _probed(rows: DataFrame, asked: DataFrame, count: int, k: int) -> DataFrame:
    """What each part finds for each query."""
    widths = {dims: WIDTH * r for dims, r in usual_distance(rows, count, k).items()}
    kind = rows.schema["v"].dataType.simpleString()
    usual = float(np.median(list(widths.values()))) if widths else 1.0

    def hashed(batches: Iterator[pa.RecordBatch], visit: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            lengths = np.diff(v.offsets.to_numpy())
            lists: list[np.ndarray] = [np.zeros(0, np.uint64)] * batch.num_rows
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                x, width = matrix(v.take(pa.array(at)), dims), max(widths.get(dims, usual), 1e-300)
                found = [probes(q, width) for q in x] if visit else keys(x, width)
                for place, each in zip(at, found, strict=True):
                    lists[place] = each
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], [*batch.schema.names, "keys"])

    fields = f"node long, id long, v {kind}, n long, keys array<long>"
    stored = written(rows.mapInArrow(lambda b: hashed(b, False), fields), "hashed")
    visits = written(asked.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node").mapInArrow(lambda b: hashed(b, True), fields), "probes", hashes=True)
    entries = stored.select("node", "id", "v", "n", F.explode("keys").alias("key"))
    hot = written(entries.groupBy("key").count().where(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("split")), "hot-buckets", hashes=True)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * TABLES // PART))
    place = F.pmod(F.xxhash64("key", "salt"), F.lit(parts)).cast("int").alias("part")
    splits = F.coalesce("split", F.lit(1))
    salted = entries.join(small(hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), splits).cast("int"))
    index = salted.select(place, F.lit(0).alias("kind"), "key", "node", "id", "n", "v", F.array().cast("array<bigint>").alias("keys"))
    asked_keys = visits.select("node", F.explode("keys").alias("key")).join(small(hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), splits - 1)))
    lists = asked_keys.select("node", "key", place).groupBy("node", "part").agg(F.collect_set("key").alias("keys"))
    queries = lists.join(visits.select("node", "id", "n", "v"), "node").select("part", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("key"), "node", "id", "n", "v", "keys")
    # the key's sign is turned so that its order is that of an unsigned number
    both = index.unionByName(queries).repartition(parts, "part").sortWithinPartitions("part", "kind", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    out = written(both.mapInArrow(lambda b: _search(b, k), _SCHEMA), "found")
    dropped(stored, visits, hot)
    return out


def _exact(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The nearest of every query in each task's vectors, block by block of queries."""
    spark = rows.sparkSession
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("node", F.lit("block")), F.lit(blocks)) == block).toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast([(q["node"], q["id"], np.array(q["v"], np.float64)) for q in mine.to_pylist()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = np.diff(batch.column("v").offsets.to_numpy())
                x = {dims: (at := np.flatnonzero(lengths == dims), matrix(batch.column("v").take(pa.array(at)), dims)) for dims in np.unique(lengths).tolist()}
                ids, node, n = (batch.column(c).to_numpy() for c in ("id", "node", "n"))
                for number, own, query in shared.value:
                    if len(query) in x:
                        at, vectors = x[len(query)]
                        good = ids[at] != own
                        at, distance = at[good], distances(vectors[good], query)
                        top = best(ids[at], n[at], distance, k)
                        full = np.full(len(top), 1, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(full * number), pa.array(full * own), pa.array(node[at[top]]), pa.array(ids[at[top]]), pa.array(n[at[top]]), pa.array(distance[top]), pa.array(full * len(ids))], _FOUND)

        found = written(rows.mapInArrow(run, _SCHEMA), "found")
        out = found if out is None else out.union(found)
        shared.unpersist()
    return out


def nearest(df: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance): the ``k`` nearest found of each row that ``queries`` picks."""
    spark = df.sparkSession
    ship(spark)
    fit = usable(F.col(f"`{vector}`")) & F.col(f"`{key}`").isNotNull()
    named = [F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")]
    number = F.xxhash64("id", "v").alias("node")
    with scratch() as keep:
        rows = written(df.where(fit).select(*named).groupBy("id", "v").agg(F.count("*").alias("n")).select(number, "id", "v", "n"), "vectors")
        asked = written(df.where(fit & queries).select(*named).distinct().select(number, "id", "v", F.lit(1).cast("bigint").alias("n")), "queries")
        if asked.isEmpty():
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        count = rows.count()
        found = None if exact else _probed(rows, asked, count, k)
        once = lambda x: x.groupBy("query", "node").agg(*[F.min(c).alias(c) for c in ("query_id", "vec_id", "n", "score")])
        if found is not None:
            enough = once(found).groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
            short = written(asked.join(enough, asked.node == enough["query"], "left_anti"), "short-queries")
            found = found if short.isEmpty() else found.union(_exact(rows, short, k))
        else:
            found = _exact(rows, asked, k)
        each = once(found).select("query", "query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
        return keep(written(each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest"))


def visited(df: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> tuple[float, float]:
    """Recall against all vectors, and the share of the vectors that stand in the buckets a query visits; for tables small enough to be collected."""
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull())
    all_, asked = rows.select(key, vector).toArrow(), rows.where(queries).select(key, vector).toArrow()
    dims = int(np.diff(all_[vector].combine_chunks().offsets.to_numpy()).max())
    x, ids, q, own = matrix(all_[vector], dims), all_[key].to_numpy(), matrix(asked[vector], dims), asked[key].to_numpy()
    number = rows.select(F.xxhash64(key, vector).alias("node"), F.col(vector).alias("v"))
    width = WIDTH * usual_distance(number, len(x), k)[dims]
    stored = keys(x, width)
    got = {}
    for r in nearest(df, queries, k, key, vector).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = share = 0.0
    for query, me in zip(q, own, strict=True):
        share += np.isin(stored, probes(query, width)).any(1).mean()
        distance = np.where(ids == me, np.inf, distances(x, query))
        want = ids[np.lexsort((ids, distance))[:k]].tolist()
        hits += len(got[me] & set(want)) / len(want)
    return hits / len(q), share / len(q)
