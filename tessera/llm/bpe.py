"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

``encode`` turns each text into ids, and on request these back into raw bytes in the same
pass; ``decode`` does that with ids from elsewhere.

The merges run on one match of the split pattern at a time, so a text may be cut
wherever no match can cross and no look-ahead changes. Such a place is a
white-space character after one that is none: the pattern has no look-behind, no
alternative runs from other characters into white space, and ``\\s+(?!\\S)`` only
looks at the character behind its run. Long texts are cut there, which bounds what
one call holds. A very long run of white space would overflow the stack of the
regex engine; its match is known without the engine (the whole run at the end of a
text, else all but its last character), so it goes to the merges directly.

Null texts count as empty: no ids, no bytes. Null id lists decode to no bytes.
Order and number of rows are kept, repeated rows included; further columns pass
through, except one named like an output column, which the output replaces. A step holds
a megabyte of text and its ids, or one longer text, whatever the batch.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import unused
from tessera.shipping import ship

#: Code points with the Unicode property White_Space: what ``\s`` means to tiktoken's regex engine.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_TEXT = 1 << 16
#: Bytes of text of a step: its ids, objects in Python, take some ten times as much.
PIECE = 1 << 20
LONG_RUN = 2000
_runs = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
_edge = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
_codecs: dict[tuple[str, str], object] = {}


def codec(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once a process."""
    key = (rank_file, pattern)
    if key not in _codecs:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _codecs[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _codecs[key]


def spans(text: str, longest: int = LONG_TEXT) -> Iterator[tuple[str, bool]]:
    """Parts of ``text`` in order; True marks a part that is a single match by itself."""
    at = 0
    for run in _runs.finditer(text) if len(text) >= LONG_RUN else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((part, False) for part in _cut(text[at : run.start()], longest))
        yield text[run.start() : end], True
        at = end
    yield from ((part, False) for part in _cut(text[at:], longest))


def _cut(text: str, longest: int) -> Iterator[str]:
    at = 0
    while len(text) - at > longest:
        edge = _edge.search(text, at + longest)
        if edge is None:
            break
        yield text[at : edge.start()]
        at = edge.start()
    if at < len(text):
        yield text[at:]


def encode_text(enc, text: str) -> list[int]:
    """The ids that ``enc.encode_ordinary(text)`` gives, for texts of any length."""
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, single in spans(text):
        ids += enc._encode_single_piece(part) if single else enc.encode_ordinary(part)
    return ids


def _lists(values: list, kind) -> pa.Array:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.fromiter((x for v in values for x in v), kind, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of the column each: bounds what a step holds."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.column(column).nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` without ``text`` but with ``out``, the array of its ids; ``decoded`` names a column for the bytes that these ids give back."""
    ship(df.sparkSession)
    added = [c for c in (out, decoded) if c]
    rest = [c for c in df.columns if c not in (text, *added)]
    fields = [*df.select(*[F.col(f"`{c}`") for c in rest]).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField(decoded, T.BinaryType())] if decoded else []
    source = unused("text", [*rest, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(rank_file, pattern)
        for whole in batches:
            for batch in _pieces(whole, source, PIECE):
                ids = [encode_text(enc, t.as_py()) if t.is_valid else [] for t in batch.columns[-1]]
                back = [pa.array(map(enc.decode_bytes, ids), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(ids, np.int32), *back], [*rest, *added])

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias(source)).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the raw bytes of ``ids``: bytes, as a slice of ids need not end between characters."""
    ship(df.sparkSession)
    schema = T.StructType([*df.drop(out).schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(rank_file, pattern)
        for whole in batches:
            for batch in _pieces(whole, ids, 1 << 24):
                kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != out]
                lists = batch.column(ids)
                found = pa.array([enc.decode_bytes(lists[i].values.to_numpy(zero_copy_only=False).tolist()) if lists[i].is_valid and len(lists[i]) else b"" for i in range(len(lists))], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), found], [*(n for n, _ in kept), out])

    return df.mapInArrow(run, schema)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: count of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
