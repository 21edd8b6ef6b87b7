"""Connected components of a link table by repeated contraction; DataFrame functions only.

Each round every node moves to the smallest of itself and its neighbours, in an order
that a fresh mask scrambles, and the links move along. A constant share of the nodes
goes in a round whatever the shape (a chain takes logarithmically many), no round holds
a node's neighbours together, and nothing is collected: each round's map is a written
table. At the end the maps are composed, last first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import dropped, written

#: Masks that scramble the order of nodes, one a round.
_MASKS = [(k * 0x9E3779B97F4A7C15 + 0x165667B19E3779F9) % (1 << 63) for k in range(1, 65)]


def components(links: DataFrame) -> DataFrame:
    """For links ``a``, ``b`` (long): every node that has a link to another, with ``root``, a node that its component agrees on.

    Links may repeat, run either way or lead from a node to itself; null ends are left out.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    live = written(links.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "links")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        mask = F.lit(_MASKS[len(maps) % len(_MASKS)])
        both = live.union(live.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        to = written(nearest.select(F.col("a").alias("node"), F.least(F.col("a").bitwiseXOR(mask), "m").bitwiseXOR(mask).alias("root")), "map")
        maps.append(to)
        one = live.join(to, live.a == to.node).select(F.col("root").alias("a"), "b")
        two = one.join(to, one.b == to.node).select("a", F.col("root").alias("b")).where("a <> b")
        last, live = live, written(two.select(low.alias("a"), high.alias("b")).distinct(), "links")
        dropped(last)
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[-1]
    for to in reversed(maps[:-1]):
        after = found.select(F.col("node").alias("root"), F.col("root").alias("end"))
        found = to.join(after, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    out = written(found, "components") if len(maps) > 1 else found
    if len(maps) > 1:
        dropped(*maps, live)
    return out
