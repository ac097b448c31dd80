"""Overlapping chunks with exact character offsets.

A chunk ends at the last line feed or space of its window, if there is one after its start; the next
one starts ``overlap`` characters before that end and skips white space.  Chunks of white space are
left out and not counted.  Each start depends on the previous end, so a document's offsets are a
sequential scan: it runs in Arrow batches, one pass per document, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE, DEFAULT_OVERLAP = 1500, 200
_OFFSETS = "array<struct<chunk_index:int,start_char:int,end_char:int>>"


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk_size must be greater than zero")
    if overlap < 0:
        raise ValueError("chunk_overlap must not be negative")
    if overlap >= size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")


def offsets(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of the chunks of a text."""
    n, start = len(text), 0
    while start < n:
        end = min(start + size, n)
        if end < n:
            cut = max(text.rfind(" ", start, end), text.rfind("\n", start, end))
            end = cut if cut > start else end
        if not text[start:end].isspace():
            yield start, end
        if end == n:
            return
        start = max(end - overlap, start + 1)
        while start < n and text[start].isspace():
            start += 1


def chunk_offsets(text: Column, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> Column:
    """Array of (chunk_index, start_char, end_char); empty for null and blank texts."""
    check_sizes(size, overlap)
    kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32())]))

    @F.arrow_udf(_OFFSETS)
    def run(text: pa.Array) -> pa.Array:
        return pa.array([[{"chunk_index": i, "start_char": a, "end_char": b} for i, (a, b) in enumerate(offsets(x.as_py() or "", size, overlap))] for x in text], kind)

    return run(text)


def chunk(documents: DataFrame, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, text: str = "text") -> DataFrame:
    """One row for each chunk: the document's columns without its text, and the chunk's fields.

    Only offsets come back from Python; the chunk's text is a substring taken by the JVM.
    """
    keep = [c for c in documents.columns if c != text]
    return (
        documents.withColumn("sw_chunk", F.explode(chunk_offsets(F.col(text), size, overlap)))
        .select(*keep, F.col("sw_chunk.chunk_index").alias("chunk_index"), F.col("sw_chunk.start_char").alias("start_char"), F.col("sw_chunk.end_char").alias("end_char"), F.expr(f"substring(`{text}`, sw_chunk.start_char + 1, sw_chunk.end_char - sw_chunk.start_char)").alias("chunk_text"))
    )
