"""``python -m tessera.llm.measure FOLDER...``: recall of the approximate operators against brute force, one JSON line a folder. Everything is collected, so only for small tables."""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import lines, lsh, pivots, shingles
from tessera.llm.simhash import joined
from tessera.llm.vectors import matrix, units, usable


def pivot_links(vectors: DataFrame) -> tuple[int, int]:
    """Directed links that the pivot index finds, and all there are."""
    found = pivots.near_vectors(vectors).agg(F.sum("n_links")).first()[0]
    some = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull()).select("embedding", "label").toArrow()
    lengths, label = np.diff(some["embedding"].combine_chunks().offsets.to_numpy()), some["label"].to_numpy()
    total = 0
    for dims in np.unique(lengths):
        for name in np.unique(label):
            x = units(matrix(some.filter(np.logical_and(lengths == dims, label == name))["embedding"], int(dims)))
            for start in range(0, len(x), 1024):
                total += int(((x[start : start + 1024] @ x.T) >= pivots.COSINE).sum()) - len(x[start : start + 1024])
    return found, total


def line_pairs(docs: DataFrame) -> tuple[int, int, int, int]:
    """Pairs of similar lines that share a band and all there are; lines that the operator keeps and the components there are."""
    texts = [r.text for r in docs.select("text").where("text IS NOT NULL").collect()]
    every = list(dict.fromkeys(x for t in texts for p in t.split("\n") if (x := lines.compared(p))))
    flat, sizes = shingles.sets(every)
    zeros = np.zeros(len(every), np.int64)
    a, b = shingles.near(zeros, zeros, np.arange(len(every)), flat, sizes, lines.JACCARD)
    rows = docs.sparkSession.createDataFrame(list(enumerate(every)), "line_id long, line string")
    each = {r.line_id: r.bands for r in lines.banded(rows, ["line_id"]).collect()}
    shared = sum(not set(each[x]).isdisjoint(each[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    labels = np.arange(len(every))
    joined(labels, a, b)
    kept = lines.dedup_lines(docs.select("doc_id", "text")).agg(F.sum("__kept")).first()[0]
    return shared, len(a), kept, len(np.unique(labels))


def main() -> None:
    spark = SparkSession.builder.getOrCreate()
    for folder in sys.argv[1:]:
        vectors, docs = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("embeddings", "documents"))
        recall, share = lsh.visited(vectors, F.col("vec_id") % 100 == 0)
        links, all_links = pivot_links(vectors)
        told = {"folder": folder, "op6 links found, all": [links, all_links], "op7 recall, share visited": [round(recall, 4), round(float(share), 4)]}
        if docs.count() <= 2000:
            told["op9 pairs that share a band, all; lines kept, components"] = list(map(int, line_pairs(docs)))
        print(json.dumps(told), flush=True)


if __name__ == "__main__":
    main()
