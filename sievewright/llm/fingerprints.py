"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps the polynomial hashes of all prefixes of a text, modulo two primes below 2**31,
so the hash of any span is one subtraction and multiplication, span equality is one comparison, and
the longest common extension of two positions is found by binary search over span equalities.

A document's fingerprint is its length, the hash of the whole text, and a sketch: the ``SKETCH``
smallest mixed hashes of its distinct ``SPAN``-character spans, all read from the prefix arrays.
Equal texts have equal fingerprints; ``likeness`` estimates from two fingerprints alone the share of
spans that the texts have in common (Dice), 1 for equal and 0 for unrelated texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import kernels as K
from sievewright.llm.durable import bounded_batches, partitions

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525893)
SPAN, SKETCH = 16, 48
#: Powers that a worker keeps between texts; a longer text's are made for it alone.
KEPT_POWERS = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(which: int, n: int) -> np.ndarray:
    """Powers of a base modulo its prime, grown by doubling."""
    have = _powers[which]
    while len(have) < n:
        step = pow(BASES[which], len(have), PRIMES[which])
        have = np.concatenate([have, have * np.uint64(step) % np.uint64(PRIMES[which])])
    _powers[which] = have[:KEPT_POWERS]
    return have[:n]


class PrefixHash:
    """Prefix arrays of one text (a str; positions are code points)."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for which, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            sums = np.zeros(self.n + 1, np.uint64)
            # terms are below 2**31, so their running sum stays exact up to 2**33 characters
            np.cumsum(codes % p * _power_table(which, self.n) % p, out=sums[1:])
            self.sums.append(sums % p)

    @classmethod
    def joined(cls, a: PrefixHash, cut: int, b: PrefixHash, take: int) -> PrefixHash:
        """Prefix arrays of a's first ``cut`` and b's first ``take`` characters, from their arrays."""
        out = cls.__new__(cls)
        out.n, out.sums = cut + take, []
        for which, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            shift = _power_table(which, cut + 1)[cut]
            out.sums.append(np.concatenate([a.sums[which][: cut + 1], (a.sums[which][cut] + b.sums[which][1 : take + 1] * shift % p) % p]))
        return out

    def windows(self, length: int, which: int = 0) -> np.ndarray:
        """Hashes of all spans of one length, shifted so that equal spans have equal hashes anywhere."""
        p, sums = np.uint64(PRIMES[which]), self.sums[which]
        inverse = _inverse_table(which, self.n + 1)
        return (sums[length:] + p - sums[: self.n + 1 - length]) % p * inverse[: self.n + 1 - length] % p

    def span(self, start: int, length: int) -> tuple[int, int]:
        """Hash of any span, under both primes."""
        got = []
        for which, p in enumerate(PRIMES):
            sums = self.sums[which]
            got.append((sums.item(start + length) - sums.item(start)) * (_inverse_table(which, start + 1).item(start) if start else 1) % p)
        return got[0], got[1]

    def whole(self) -> int:
        return (int(self.sums[0][-1]) << 32) | int(self.sums[1][-1])


_inverse: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _inverse_table(which: int, n: int) -> np.ndarray:
    have, p = _inverse[which], PRIMES[which]
    while len(have) < n:
        step = pow(pow(BASES[which], -1, p), len(have), p)
        have = np.concatenate([have, have * np.uint64(step) % np.uint64(p)])
    _inverse[which] = have[:KEPT_POWERS]
    return have[:n]


def longest_common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common span of ``a`` from ``i`` and ``b`` from ``j``, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, mid) == b.span(j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def fingerprint(h: PrefixHash) -> str:
    """Hex fields: length, whole hash, sketch (the leading 32 bits of each value)."""
    size = min(SPAN, max(h.n, 1))
    if h.n:
        values = K.mix(h.windows(size))
        if len(values) > 8 * SKETCH:  # only values that can be among the smallest are sorted
            cut = np.partition(values, 4 * SKETCH)[4 * SKETCH]
            few = np.unique(values[values <= cut])
            values = few if len(few) >= SKETCH else np.unique(values)
        else:
            values = np.unique(values)
    else:
        values = np.zeros(0, np.uint64)
    return f"{h.n:x}-{h.whole():016x}-" + (values[:SKETCH] >> np.uint64(32)).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated share of spans in common, from 0 to 1, of two fingerprints."""
    if a == b:
        return 1.0
    x, y = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (a.rpartition("-")[2], b.rpartition("-")[2]))
    if not x or not y:
        return 0.0
    union = sorted(x | y)[:SKETCH]
    jaccard = sum(v in x and v in y for v in union) / len(union)
    return 2 * jaccard / (1 + jaccard)


#: Ranges of ids for each partition, so that ranges of long texts can be dealt evenly by bytes.
RANGES = 4


def _boundaries(rows: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``ranges`` - 1 keys (sw_k, sw_t) that cut the rows into even ranges.

    A key that several cuts fall on holds many rows; these are cut by their text's hash, which is even.
    """
    cuts = rows.agg(F.percentile_approx("sw_k", [i / ranges for i in range(1, ranges)], 10000).alias("c")).collect()[0]["c"]
    keys, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    of = np.repeat(np.arange(len(keys)), times)
    step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    return keys[of], np.array([-(1 << 63) + (int(i) << 64) // int(times[j]) for i, j in zip(step, of, strict=True)], np.int64)


def _range_of(cuts: tuple[np.ndarray, np.ndarray], k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Range of each key; the first range has the largest ones."""
    low, high = (np.searchsorted(cuts[0], k, side) for side in ("left", "right"))
    below = low.copy()
    for at in np.unique(low[high > low]):
        own = (low == at) & (high > low)
        below[own] = at + np.searchsorted(cuts[1][at : high[own][0]], t[own], "right")
    return len(cuts[0]) - below


def _dealt(sizes: list[int], parts: int) -> list[int]:
    """Partition of each range: consecutive ones together, about as many bytes in each."""
    ends = np.cumsum([x + 1 for x in sizes])
    return ((ends - 1) * parts // ends[-1]).tolist()


def in_descending_order(rows: DataFrame) -> DataFrame:
    """Rows of each id range sorted in one partition, each range followed by a copy of the next one's head.

    ``rows`` has sw_k, sw_t and text; sw_copy marks the copies.  Texts are shuffled once.  The driver
    holds one key and one size for each range (RANGES a partition), never a text.
    """
    n = partitions(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    cuts = _boundaries(rows.select("sw_k"), RANGES * n)

    @F.arrow_udf("int")
    def range_of(k: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array(_range_of(cuts, k.to_numpy(), t.to_numpy()).astype(np.int32))

    sized = rows.select("sw_k", "sw_t", F.octet_length("text").cast("long").alias("size"))
    found = sized.groupBy(range_of("sw_k", "sw_t").alias("sw_b")).agg(F.max(F.struct("sw_k", "sw_t")).alias("h"), F.sum("size").alias("size")).orderBy("sw_b").collect()
    if not found:
        return rows.withColumn("sw_b", F.lit(0)).withColumn("sw_copy", F.lit(False))
    order = np.array([r["sw_b"] for r in found])
    heads = np.array([[r["h"][0], r["h"][1]] for r in found], np.int64)
    part = np.array(_dealt([r["size"] for r in found], n))
    kind = pa.list_(pa.struct([("p", pa.int32()), ("b", pa.int32()), ("c", pa.bool_())]))

    @F.arrow_udf("array<struct<p:int,b:int,c:boolean>>")
    def places(k: pa.Array, t: pa.Array) -> pa.Array:
        k, t = k.to_numpy(), t.to_numpy()
        at = np.searchsorted(order, _range_of(cuts, k, t))
        head = (heads[at, 0] == k) & (heads[at, 1] == t)
        out = [[{"p": int(part[i]), "b": int(order[i]), "c": False}] for i in at]
        for x in np.flatnonzero(head):
            i = at[x] - 1  # the range before; the first range's head follows the last range
            out[x].append({"p": int(part[i]), "b": int(order[i]), "c": True})
        return pa.array(out, kind)

    placed = rows.withColumn("sw_at", F.explode(places("sw_k", "sw_t"))).select(*rows.columns, F.col("sw_at.p").alias("sw_p"), F.col("sw_at.b").alias("sw_b"), F.col("sw_at.c").alias("sw_copy"))
    return placed.repartitionById(n, F.col("sw_p")).sortWithinPartitions("sw_b", "sw_copy", F.desc("sw_k"), F.desc("sw_t"))


class _Document:
    __slots__ = ("doc_id", "hash", "print", "text")

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.hash = PrefixHash(text)
        self.print = fingerprint(self.hash)


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("shared_prefix", pa.int64())]
_RESULT = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending: _Document | None = None
    bucket = None
    out: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal held
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])
        out.clear()
        held = 0
        return batch

    for batch in batches:
        for doc_id, text, b, copy in zip(*(batch.column(c) for c in ("doc_id", "text", "sw_b", "sw_copy")), strict=True):
            doc = _Document(doc_id.as_py(), text.as_py())
            if pending is not None and bucket == b.as_py():
                n = pending.hash.n
                swap = n // 2
                edited = pending.text[: n - swap] + doc.text[:swap]
                joined = PrefixHash.joined(pending.hash, n - swap, doc.hash, min(swap, doc.hash.n))
                changed = fingerprint(joined)
                out.append((pending.doc_id, n, edited, pending.print, changed, likeness(pending.print, changed), likeness(pending.print, doc.print), longest_common_extension(pending.hash, 0, joined, 0)))
                held += len(edited)
                if held > K.SLICE_BYTES:
                    yield flush()
            pending, bucket = (None, None) if copy.as_py() else (doc, b.as_py())
    if out:
        yield flush()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has the last floor(n_chars/2) code points replaced by the first as many (or all)
    of the next document in descending doc_id order (after the last: the first).  Returns doc_id,
    n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next and shared_prefix
    (longest common extension of text and edited text from their starts).

    Takes doc_id and text; other columns are ignored.  Null text is empty.  A null doc_id counts as
    larger than every id.  Rows with one doc_id are ordered by their text's hash; equal rows follow
    each other and are returned once each; an id that holds very many rows is cut by that hash.  A single row is its own next document; an empty table
    gives no rows.  A worker holds two documents at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("sw_k"), F.xxhash64("text").alias("sw_t"), "text"
    )
    return in_descending_order(rows).select("doc_id", "text", "sw_b", "sw_copy").mapInArrow(_compare, _RESULT)
