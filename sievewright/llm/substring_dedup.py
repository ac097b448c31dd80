"""Substring dedup by level-wise doubling.

A window of ``min_words`` words that repeats holds windows of half that length that repeat, so the
half-length level is searched first and only what repeats there is extended to the full length.

Level 1 (half length).  Every full window is owned by the least-hashed half-length window inside it
(a minimizer), which depends on the words alone: equal full windows own through equal half windows.
About one position in thirteen is an owner, so the level needs one short row for every thirteen
words.  Half windows found in one document only are dropped here.

Level 2 (full length).  A surviving occurrence stands for the run of at most 26 full windows that it
owns.  Occurrences with the same run (a class) are answered together: all members but those of the
least document are repeats as a whole.  Only the classes' first members, and only where one half
window has several classes, have their full windows hashed and compared one by one.

``longest_levels`` goes on doubling (100, 200, ... words) until no candidate survives and tells the
longest level of each document; the removed words don't depend on it, since every longer repeat is
a union of full windows.

Skew: all groupings are partial aggregates (min, bit_or); rows return to their groups by joins whose
other side has one row a key, which adaptive execution can split.  Nothing is grouped into a list
but the spans of one document.  Keys of compared windows have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import kernels as K
from sievewright.llm.durable import written

_LAST = (1 << 63) - 1
_OCCURRENCE = "sw_a long, sw_c long, sw_k long, sw_t long, sw_lo int, sw_n int"
_WINDOW = "sw_a long, sw_w long, sw_k long, sw_c long, sw_j int"
_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with an address of each row: order key (null after all ids) and text hash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).select(
        "doc_id",
        F.coalesce("doc_id", F.lit(_LAST)).alias("sw_k"),
        F.xxhash64("text").alias("sw_t"),
        "text",
    )


def _owners(first: np.ndarray, half: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner positions, first full window and number of full windows that each owns."""
    width = size - size // 2 + 1
    keys = ((half >> K.U(28)) << K.U(28)) | np.arange(len(half), dtype=K.U)
    least = K.sliding_min(keys, width)
    full = np.zeros(first[-1] + 1, np.int32)
    counts = np.diff(first)
    long = counts >= size
    np.add.at(full, first[:-1][long], 1)
    np.add.at(full, first[:-1][long] + counts[long] - size + 1, -1)
    at = np.flatnonzero(np.cumsum(full)[:-1] > 0)
    if not len(at):
        return at, at, at
    own = (least[at] & K.U((1 << 28) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    return own[cut], at[cut], np.diff(np.r_[cut, len(at)])


def _hashed(text: pa.Array) -> tuple[np.ndarray, K.Prefix, K.Prefix]:
    data, offsets = K.utf8(text)
    start, end, first = K.words(data, offsets)
    return first, K.Prefix(K.word_hashes(data, start, end, 0), 2), K.Prefix(K.word_hashes(data, start, end, 1), 3)


def _occurrences(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            ids = [batch.column(c).to_numpy() for c in ("sw_k", "sw_t")]
            for at, to in K.slices(text):
                first, one, two = _hashed(text.slice(at, to - at))
                total, h = int(first[-1]), size // 2
                if total < size:
                    continue
                begin = np.arange(total - h + 1)
                half = one.spans(begin, begin + h)
                own, lo, n = _owners(first, half, size)
                row = K.row_of(first, lo)
                run_hash = K.mix(two.spans(lo, lo + n - 1 + size) ^ K.mix(((own - lo) * 4096 + n).astype(K.U)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(K.signed(half[own])),
                        pa.array(K.signed(run_hash)),
                        *(pa.array(x[at:to][row]) for x in ids),
                        pa.array((lo - first[row]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=["sw_a", "sw_c", "sw_k", "sw_t", "sw_lo", "sw_n"],
                )

    return run


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, asked = batch.column("text"), batch.column("sw_asked")
            keys = batch.column("sw_k").to_numpy()
            for at, to in K.slices(text):
                first, _, two = _hashed(text.slice(at, to - at))
                part = asked.slice(at, to - at)
                flat = part.flatten()
                sizes = np.diff(part.offsets.to_numpy())
                row = np.repeat(np.arange(to - at), sizes)
                lo = flat.field("sw_lo").to_numpy().astype(np.int64) + first[row]
                n = flat.field("sw_n").to_numpy().astype(np.int64)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(lo, n) + j
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(flat.field("sw_a").to_numpy(), n)),
                        pa.array(K.signed(two.spans(start, start + size))),
                        pa.array(np.repeat(keys[at:to][row], n)),
                        pa.array(np.repeat(flat.field("sw_c").to_numpy(), n)),
                        pa.array(j.astype(np.int32)),
                    ],
                    names=["sw_a", "sw_w", "sw_k", "sw_c", "sw_j"],
                )

    return run


def _kept(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        )
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text, spans in zip(batch.column("doc_id"), batch.column("text"), batch.column("sw_spans"), strict=True):
                w = text.as_py().encode("utf-8", "surrogatepass").split()
                total, cut = len(w), []
                for s in sorted((x["sw_lo"], x["sw_n"], x["sw_mask"]) for x in spans.as_py() or ()):
                    for j in range(s[1]):
                        if s[2] >> j & 1:
                            if cut and s[0] + j <= cut[-1][1]:
                                cut[-1][1] = max(cut[-1][1], s[0] + j + size)
                            else:
                                cut.append([s[0] + j, s[0] + j + size])
                for b, e in reversed(cut):
                    del w[b:e]
                kept = b" ".join(w)
                out.append((doc_id.as_py(), total, total - len(w), kept.decode(), [{"start": b, "end": e} for b, e in cut]))
                held += len(kept)
                if held > K.SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def repeated_occurrences(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Level 1: occurrences of half-length windows that start in two documents at least."""
    occurrences = docs.select("sw_k", "sw_t", "text").mapInArrow(_occurrences(min_words), _OCCURRENCE)
    repeated = (
        occurrences.groupBy("sw_a").agg(F.min("sw_k").alias("sw_least"), F.max("sw_k").alias("sw_most")).where("sw_least < sw_most").select("sw_a")
    )
    # written, so that the join's both sides are plain shuffles and a half that stands everywhere is split
    return written(occurrences.join(written(repeated, "repeated"), "sw_a"), "repeated-halves")


def substring_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Remove the words of windows that also start in a document with a smaller doc_id.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Returns one row for each input row:
    doc_id, n_words, n_removed, kept_text (kept words joined by one space) and the removed word spans [start, end).
    Words are ``[^\\x20\\x09-\\x0D]+``.  Null text counts as empty (no words); a document of fewer
    than ``min_words`` words is kept whole.  A null doc_id counts as larger than every id; rows that
    repeat a doc_id are rows of one document, so they don't remove each other's words.  An empty
    table gives an empty result.
    """
    if min_words < 4 or min_words % 2 or min_words > 120:
        raise ValueError("min_words is an even number from 4 to 120")
    all_docs = keyed(docs)
    found = repeated_occurrences(all_docs, min_words)
    classes = found.groupBy("sw_a", "sw_c").agg(F.min(F.struct("sw_k", "sw_t", "sw_lo", "sw_n")).alias("sw_m")).select("sw_a", "sw_c", "sw_m.*")
    mixed = classes.groupBy("sw_a").agg(F.min("sw_k").alias("sw_least"), F.max("sw_k").alias("sw_most")).where("sw_least < sw_most").select("sw_a")
    asked = (
        classes.join(mixed, "sw_a").groupBy("sw_k", "sw_t").agg(F.collect_list(F.struct("sw_a", "sw_c", "sw_lo", "sw_n")).alias("sw_asked"))
    )
    windows = all_docs.join(asked, ["sw_k", "sw_t"]).select("sw_k", "text", "sw_asked").mapInArrow(_windows(min_words), _WINDOW)
    windows = written(windows, "full-windows")
    least = windows.groupBy("sw_a", "sw_w").agg(F.min("sw_k").alias("sw_least"), F.max("sw_k").alias("sw_most")).where("sw_least < sw_most")
    masks = (
        windows.join(least, ["sw_a", "sw_w"])
        .where("sw_least < sw_k")
        .groupBy("sw_a", "sw_c")
        .agg(F.bit_or(F.expr("shiftleft(1L, sw_j)")).alias("sw_mask"))
    )
    answers = classes.select("sw_a", "sw_c", F.col("sw_k").alias("sw_first")).join(masks, ["sw_a", "sw_c"], "left")
    spans = (
        found.join(answers, ["sw_a", "sw_c"])
        .withColumn("sw_mask", F.when(F.col("sw_first") < F.col("sw_k"), F.expr("shiftleft(1L, sw_n) - 1")).otherwise(F.coalesce("sw_mask", F.lit(0).cast("long"))))
        .where("sw_mask <> 0")
        .groupBy("sw_k", "sw_t")
        .agg(F.collect_set(F.struct("sw_lo", "sw_n", "sw_mask")).alias("sw_spans"))
    )
    return all_docs.join(spans, ["sw_k", "sw_t"], "left").select("doc_id", "text", "sw_spans").mapInArrow(_kept(min_words), _RESULT)


def longest_levels(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Go on doubling until no candidate survives: doc_id and the longest level that repeats in it.

    Levels are min_words, twice that, and so on; 0 where not even ``min_words`` words repeat.  Only
    documents that repeat at one level are read at the next.
    """
    all_docs = keyed(docs)
    here = repeated_occurrences(all_docs, min_words).select("sw_k").distinct()
    level, longest = min_words, None
    while True:
        candidates = written(all_docs.join(here, "sw_k", "left_semi"), "candidates")
        here = written(_repeated_whole(candidates, level).distinct(), f"level-{level}")
        if not here.head(1):
            break
        found = here.withColumn("sw_level", F.lit(level))
        longest = found if longest is None else longest.unionByName(found)
        level *= 2
    if longest is None:
        return all_docs.select("doc_id", F.lit(0).alias("longest_level"))
    longest = longest.groupBy("sw_k").agg(F.max("sw_level").alias("sw_level"))
    return all_docs.join(longest, "sw_k", "left").select("doc_id", F.coalesce("sw_level", F.lit(0)).alias("longest_level"))


def _repeated_whole(docs: DataFrame, level: int) -> DataFrame:
    """Windows of ``level`` words that two documents hold, of documents that repeat at half of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keys = batch.column("text"), batch.column("sw_k").to_numpy()
            for at, to in K.slices(text):
                first, one, two = _hashed(text.slice(at, to - at))
                start = np.concatenate([np.arange(b, max(b, e - level + 1)) for b, e in zip(first[:-1], first[1:], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(K.signed(p.spans(start, start + level))) for p in (one, two)] + [pa.array(keys[at:to][K.row_of(first, start)])],
                    names=["sw_a", "sw_c", "sw_k"],
                )

    windows = docs.select("sw_k", "text").mapInArrow(run, "sw_a long, sw_c long, sw_k long")
    twice = windows.groupBy("sw_a", "sw_c").agg(F.min("sw_k").alias("sw_least"), F.max("sw_k").alias("sw_most")).where("sw_least < sw_most")
    return windows.join(twice, ["sw_a", "sw_c"]).select("sw_k")
