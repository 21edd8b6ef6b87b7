"""Code samples derived from the tables, as DataFrame and as SQL, for queries on code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import spread

#: Strings around a document's text, by its id modulo their number.
AROUND = [
    ("```latex\n", "\n```"),
    ("Sure:\n```latex\n\\documentclass{article}\n\\begin{document}\n", "% cut"),
    ("", ""),
    ("\\documentclass{article}\n\\begin{document}\n", " % note\n\\end{document}\n"),
    ("```latex\n\\documentclass[tikz]{standalone}\n\\usepackage{tikz}\n\\begin{document}\n\\begin{tikzpicture}\\draw (0,0); \\node{", "};\\end{tikzpicture}\n\\end{document}\n```"),
    ("a\\% kept % gone\n\\\\% gone too\n% whole line\n", "\\input{x}  \t %\n\n\n\nend"),
    ("\\includegraphics[width=1cm]{a.png} ", " \\begin{document}\\end {document}"),
    ("```tex\n", "```\nand\n```latex\nx=2\n```"),
    ("Think. Answer: $\\frac12$\nAnswer: ", " = 1,234 dollars"),
    ("<think> a </think> <answer>1</answer>", "\\boxed{7}"),
    ("! Undefined control sequence\n  l.3 \\foo\nFile `x' not found\n", "\n! Emergency stop\n"),
    ("<think> \\boxed{3} </think> ", " so \\boxed{ \\frac{1}{2} } holds"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, on all cores."""
    return spread(table(spark, folder, "documents"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id`` and ``tex``, a code sample of each document."""
    docs = documents(spark, folder).select("doc_id", F.col("text").alias("part"))
    tex = None
    for k, (before, after) in enumerate(AROUND):
        tex = (F if tex is None else tex).when(F.col("doc_id") % len(AROUND) == k, F.concat(F.lit(before), "part", F.lit(after)))
    return docs.select("doc_id", tex.alias("tex"))


def quoted(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


SAMPLES = "(SELECT doc_id, CASE " + " ".join(f"WHEN doc_id % {len(AROUND)} = {k} THEN {quoted(a)} || text || {quoted(b)}" for k, (a, b) in enumerate(AROUND)) + " END AS tex FROM documents)"
