"""Hard negatives by a pivot table: exact inner products of what triangle inequality leaves.

Components are multiplied by ``SCALE`` and rounded down, so scores are integer inner
products. With M the greatest norm of all rows, a row x becomes (x, sqrt(M^2 - |x|^2)) and
an anchor a becomes (a, 0): their Euclidean distance d gives the score (|a|^2 + M^2 - d^2) / 2,
so high scores are near rows. Of every row the distances to ``PIVOTS`` augmented reference
rows are stored; for an anchor at distance e from a pivot, a row at distance d' from it lies
between |e - d'| and e + d', which brackets the score from both sides. Exact scores are taken
of rows whose bracket meets what the anchor still looks for, first of whole blocks by the
least and greatest stored distances in them, then row by row.

Anchors look for two things, one after the other: the ``positives`` nearest rows of their own
label, then for each of these positives the ``k`` nearest rows of other labels whose score is at most the
positive's and at least ``SHARE`` hundredths of it. A search begins with a floor: the score that the
sample's rows reach already, for the first search. Each task keeps the best of its rows and
raises its floors as it goes on, so it returns at most that many rows an anchor.

The index is written once, dealt by the nearest pivot, so that blocks hold rows that are
near each other; a pivot with many rows is dealt to several tasks. Anchors go round in
blocks of ``ASKED`` (a broadcast of bounded size) against all rows of the index.

Rows with a null label, a null vector, a null or non-finite component or a null id take no
part. Zero and empty vectors do: their scores are 0. Rows of another length than the anchor's
are no candidates. A row repeated in id, label and vector counts once; rows that share the
anchor's id are neither positives nor negatives. Components beyond sqrt(2^62 / length) after
scaling count as that bound, so that every score fits a long. Negative positives have no
negatives, as 80 hundredths of them lie above them. Ties go to the smaller id.
An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import scratch, written
from tessera.shipping import ship

SCALE = 256
PIVOTS = 24
#: Rows drawn for pivots and floors, and how many of the drawn ones are looked at for the next pivot.
SAMPLE = 2048
ASKED = 4096
#: Rows of an index task, rows of a block and anchors that are compared at once.
PART, ROWS, AT_ONCE = 1 << 17, 4096, 256
SHARE = 80
#: Below all scores; the range of longs is symmetric from here on.
LEAST = int(np.iinfo(np.int64).min) + 1
_OUT = "anchor long, number long, goal long, score long, id long"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vector: Column) -> Column:
    """The components as doubles, times ``SCALE`` and rounded down, within the bound that keeps inner products in a long."""
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(vector), F.lit(1)))).cast("long")
    return F.transform(vector, lambda x: F.greatest(-most.cast("double"), F.least(most.cast("double"), F.floor(x.cast("double") * SCALE).cast("double"))).cast("long"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where every sum stays below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Space:
    """The augmented space of the rows of one length: the greatest norm's square, and the pivots."""

    def __init__(self, drawn: np.ndarray, labels: np.ndarray, ids: np.ndarray, square: float):
        self.square, self.rows, self.labels, self.ids = square, drawn, labels, ids
        self.pivots = self._far_apart(self.augmented(drawn))

    def augmented(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0, self.square - (x * x).sum(1)))[:, None]])

    def _far_apart(self, points: np.ndarray) -> np.ndarray:
        """The first point, then again and again the one farthest from those chosen."""
        chosen = [0] if len(points) else []
        away = np.full(len(points), np.inf)
        while chosen and len(chosen) < min(PIVOTS, len(points)):
            away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
            if not away.max() > 0:
                break
            chosen.append(int(away.argmax()))
        return points[chosen]

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        """The distances of augmented points to the pivots."""
        return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in self.pivots], 1)

    def scores(self, norms: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """What scores anchors of the squared norms have at a distance."""
        return (norms + self.square - distance * distance) / 2


def spaces(rows: DataFrame) -> dict[int, Space]:
    """By vector length: the greatest norm of all its rows, and pivots from a sample by hash, of about ``SAMPLE`` rows of all lengths, at least one of each."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = {r["dims"]: r["square"] for r in rows.groupBy(F.size("v").alias("dims")).agg(F.max(square).alias("square")).collect()}
    count, out = rows.count(), {}
    for dims, most in sizes.items():
        share = F.pmod(F.xxhash64("id", "v", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
        mine = rows.where(F.size("v") == dims)
        drawn = mine.where(share < SAMPLE / count).select("id", "label", "v").orderBy("id", "label", "v").limit(2 * SAMPLE).toArrow()
        drawn = drawn if len(drawn) else mine.select("id", "label", "v").orderBy("id", "label", "v").limit(1).toArrow()
        [(_, _, points)] = _by_length(drawn["v"].combine_chunks())
        out[dims] = Space(points, drawn["label"].to_numpy(), drawn["id"].to_numpy(), most * (1 + 1e-12) + 1)
    return out


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the places of the vectors that have it, and these as rows of integers."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    start = vectors.offsets.to_numpy()[:-1] - vectors.offsets.to_numpy()[0]
    for dims in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dims)
        yield dims, at, flat[start[at][:, None] + np.arange(dims)[None]].astype(np.int64)


class Goals:
    """What anchors of one length look for: rows with a score in [low, high], of their own label or of others; the best found so far.

    Each goal has a ``low`` and a ``high``; ``owner`` is its anchor, by place. ``number`` names the anchors."""

    def __init__(self, space: Space, number: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.space, self.number, self.ids, self.labels, self.rows, self.owner, self.low, self.high, self.same, self.k = space, number, ids, labels, rows, owner, low, high, same, k
        x = rows.astype(np.float64)
        self.norms = (x * x).sum(1)
        self.away = space.to_pivots(np.hstack([x, np.zeros((len(x), 1))]))
        # anchors that are near each other are compared at once, with the rows that any of them may want
        self.order = np.argsort(self.away.argmin(1), kind="stable")
        self.slack = 1e-9 * (self.norms + space.square) + 1
        self.score = np.full((len(low), k), LEAST)
        self.best = np.full((len(low), k), np.iinfo(np.int64).max)

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor: the least and greatest score that any of its goals has use for."""
        low, high = np.full(len(self.ids), np.inf), np.full(len(self.ids), -np.inf)
        np.minimum.at(low, self.owner, np.maximum(self.low, self.score[:, -1]).astype(np.float64))
        np.maximum.at(high, self.owner, self.high.astype(np.float64))
        return low, high

    def see(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, away: np.ndarray) -> None:
        """Take in a block of rows with their distances to the pivots."""
        low, high = self.wanted()
        least, most = away.min(0), away.max(0)
        near = np.maximum(0, np.maximum(self.away - most, least - self.away)).max(1, initial=0)
        far = (self.away + most).min(1, initial=np.inf)
        hope = (self.space.scores(self.norms, near) + self.slack >= low) & (self.space.scores(self.norms, far) - self.slack <= high)
        asked = self.order[hope[self.order]]
        for start in range(0, len(asked), AT_ONCE):
            self._compare(asked[start : start + AT_ONCE], low, high, ids, labels, rows, away)

    def _compare(self, some: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, away: np.ndarray) -> None:
        near, far = np.zeros((len(some), len(ids))), np.full((len(some), len(ids)), np.inf)
        for p in range(away.shape[1]):
            mine, theirs = self.away[some, p][:, None], away[:, p][None]
            np.maximum(near, np.abs(mine - theirs), out=near)
            np.minimum(far, mine + theirs, out=far)
        norms, slack = self.norms[some][:, None], self.slack[some][:, None]
        left = (self.space.scores(norms, near) + slack >= low[some][:, None]) & (self.space.scores(norms, far) - slack <= high[some][:, None])
        left &= ((self.labels[some][:, None] == labels[None]) == self.same) & (self.ids[some][:, None] != ids[None])
        kept = np.flatnonzero(left.any(0))
        if not len(kept):
            return
        left, ids = left[:, kept], ids[kept]
        exact = products(self.rows[some], rows[kept])
        place = np.full(len(self.ids), -1)
        place[some] = np.arange(len(some))
        for goal in np.flatnonzero(np.isin(self.owner, some)):
            at = place[self.owner[goal]]
            score = exact[at]
            good = np.flatnonzero(left[at] & (score >= max(self.low[goal], self.score[goal, -1])) & (score <= self.high[goal]))
            if len(good) > self.k:
                good = good[score[good] >= np.partition(score[good], len(good) - self.k)[len(good) - self.k]]
            if len(good):
                score, named = np.r_[self.score[goal], score[good]], np.r_[self.best[goal], ids[good]]
                top = np.lexsort((named, -score))[: self.k]
                self.score[goal], self.best[goal] = score[top], named[top]

    def found(self) -> pa.RecordBatch:
        goal, rank = np.nonzero(self.best < np.iinfo(np.int64).max)
        columns = self.ids[self.owner[goal]], self.number[self.owner[goal]], self.high[goal], self.score[goal, rank], self.best[goal, rank]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "number", "goal", "score", "id"])


def _floors(space: Space, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th best score that anchors reach in the sample, among their label's rows; the least number if it has fewer."""
    out = np.full(len(ids), LEAST)
    for start in range(0, len(ids), AT_ONCE):
        s = slice(start, start + AT_ONCE)
        score = np.where((labels[s, None] == space.labels[None]) & (ids[s, None] != space.ids[None]), products(rows[s], space.rows), LEAST)
        if score.shape[1] >= k:
            out[s] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return out


def _searched(index: DataFrame, asked: DataFrame, known: dict[int, Space], same: bool, k: int) -> DataFrame:
    """``anchor``, ``number``, ``goal`` (its greatest score), ``score``, ``id``, ``rank``: the best rows for every goal of the anchors (``number``, ``id``, ``label``, ``v``, and ``goals``: low, high)."""
    spark = index.sparkSession
    blocks = max(1, -(-asked.count() // ASKED))
    out: list[DataFrame] = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("number", F.lit("block")), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not len(mine):
            continue
        shared = spark.sparkContext.broadcast((mine, known))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, spaces_ = shared.value
            goals: dict[int, Goals] = {}

            def begun(dims: int) -> Goals | None:
                for size, at, rows in _by_length(table["v"].combine_chunks()):
                    if size == dims:
                        lists = table["goals"].combine_chunks().take(pa.array(at))
                        owner = np.repeat(np.arange(len(at)), np.diff(lists.offsets.to_numpy()))
                        low, high = (lists.flatten().field(c).to_numpy() for c in ("low", "high"))
                        number, ids, labels = (table[c].to_numpy()[at] for c in ("number", "id", "label"))
                        low = np.maximum(low, _floors(spaces_[dims], ids, labels, rows, k)[owner]) if same else low
                        return Goals(spaces_[dims], number, ids, labels, rows, owner, low, high, same, k)
                return None

            for batch in batches:
                for dims, at, rows in _by_length(batch.column("v")):
                    if dims not in goals:
                        goals[dims] = begun(dims)
                    if goals[dims] is not None:
                        ids, labels = (batch.column(c).to_numpy()[at] for c in ("id", "label"))
                        away = batch.column("away").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                        for start in range(0, len(at), ROWS):
                            s = slice(start, start + ROWS)
                            goals[dims].see(ids[s], labels[s], rows[s], away[s])
            yield from (g.found() for g in goals.values() if g is not None)

        out.append(written(index.mapInArrow(run, _OUT), "negatives-found"))
        shared.unpersist()
    whole = spark.createDataFrame([], _OUT)
    for more in out:
        whole = whole.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("number", "goal").orderBy(F.desc("score"), "id"))
    return written(whole.withColumn("rank", rank).where(F.col("rank") <= k), "negatives-best")


def pivot_table(rows: DataFrame, known: dict[int, Space]) -> DataFrame:
    """Rows (``id``, ``label``, ``v``) with ``away``, their distances to the pivots, dealt to tasks by the nearest one and written."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away: list[np.ndarray] = [np.zeros(0)] * batch.num_rows
            for dims, at, x in _by_length(batch.column("v")):
                space = shared.value[dims]
                for place, each in zip(at, space.to_pivots(space.augmented(x)), strict=True):
                    away[place] = each
            offsets = np.r_[0, np.cumsum([len(a) for a in away])].astype(np.int32)
            nearest = np.array([a.argmin() for a in away], np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0), *away]))), pa.array(nearest)], ["id", "label", "v", "away", "pivot"])

    stored = written(rows.select("id", "label", "v").mapInArrow(described, "id long, label long, v array<long>, away array<double>, pivot int"), "pivot-distances", hashes=True)
    sizes = stored.groupBy("pivot").agg(F.count("*").alias("n"))
    split = F.ceil(F.col("n") / PART).cast("int")
    salted = stored.join(F.broadcast(sizes), "pivot").withColumn("salt", F.pmod(F.xxhash64("id", "v"), split).cast("int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = stored.count()
    dealt = salted.repartition(max(parts, -(-count // PART)), "pivot", "salt").sortWithinPartitions("pivot", F.element_at("away", F.col("pivot") + 1))
    return written(dealt.select("id", "label", "v", "away"), "pivot-table", hashes=True)


def hard_negatives(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = 5, k: int = 5, share: int = SHARE) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for the rows that ``anchors`` picks; ``label``: a column that says which rows are alike."""
    spark = df.sparkSession
    ship(spark)
    v, kind = F.col(f"`{vector}`"), F.col(f"`{label}`") if isinstance(label, str) else label
    named = df.where(finite(v) & kind.isNotNull() & F.col(f"`{key}`").isNotNull())
    picked = named.select(F.col(f"`{key}`").cast("long").alias("id"), kind.cast("long").alias("label"), scaled(v).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    with scratch() as keep:
        rows = written(picked.groupBy("id", "label", "v").agg(F.max("asked").alias("asked")).withColumn("number", F.monotonically_increasing_id()), "vectors")
        asked = rows.where("asked").select("number", "id", "label", "v")
        if asked.isEmpty():
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        known = spaces(rows)
        index = pivot_table(rows, known)
        wide = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(-LEAST).alias("high")))
        first = keep(_searched(index, asked.withColumn("goals", wide), known, True, positives))
        # a goal is an anchor and a positive's score; 80 hundredths are taken without leaving the range of a long
        sought = first.where("score >= 0").select("number", "score").distinct()
        least = F.expr(f"score div 100 * {share}") + F.ceil(F.col("score") % 100 * share / 100).cast("long")
        goals = sought.groupBy("number").agg(F.collect_list(F.struct(least.alias("low"), F.col("score").alias("high"))).alias("goals"))
        second = keep(_searched(index, asked.join(goals, "number"), known, False, k))
        pairs = first.select("anchor", "number", F.col("score").alias("goal"), F.col("id").alias("positive_id"))
        out = pairs.join(second.select("number", "goal", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["number", "goal"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("goal").alias("positive_score"), "negative_score")


def sql(share: int = SHARE, positives: int = 5, k: int = 5) -> str:
    """DuckDB SQL of the query over ``embeddings``: all scores of all anchors."""
    return f"""
    WITH q AS MATERIALIZED (
      SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (
      SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM q a JOIN q x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id AND len(a.v) = len(x.v)),
    p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives})
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {share} * p.score <= 100 * s.score AND s.score <= p.score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= {k}"""
