"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is embedded into 64 minwise values.  Independent trees branch it: a node of a tree
(named by the path that led there) draws one or two of the values still unused on its path, and the
document goes on to the child named by each drawn value, so a pair of similarity s shares
1.25 * s children of a shared node on average, one at the threshold of 0.8.  The draw depends on the
path alone, so every document finds its own leaves without seeing others, and pairs meet in a tree
with probability above one half; ``trees`` independent trees miss a pair at the threshold with
probability below 1e-6 (``recall`` computes it).

Depth grows with the logarithm of the number of sets, so leaves stay small unless their documents are alike.  Leaves are worked off by
``linkage.connected``: small ones exhaustively, large ones (groups of near copies) by comparing each
document with the leaf's centre, then only across groups that aren't connected yet.  All links are
confirmed on the full sets.  Documents with equal sets are one member throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import kernels as K
from sievewright.llm.durable import released, written
from sievewright.llm.linkage import connected, in_sample

VALUES = 64
SECOND = 0.25  # chance of a second branch: 1.25 branches on average
_LAST = (1 << 63) - 1
_SETS = "sw_k long, sw_t long, n_shingles long, member long, check long, signature binary"


def recall(trees: int, depth: int, similarity: float) -> float:
    """Chance that two sets meet in a leaf of one of the trees at least."""
    lost = 0.0
    for _ in range(depth):
        x = 1 - similarity + similarity * lost
        lost = (1 - SECOND) * x + SECOND * x * x
    return 1 - lost**trees


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and each text's first one (with the total at the end)."""
    data, offsets = K.utf8(text)
    data = K.ascii_lower(data)
    start, end, first = K.words(data, offsets)
    prefix = K.Prefix(K.word_hashes(data, start, end), 2)
    words = np.diff(first)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    at = np.r_[0, np.cumsum(count)]
    begin = np.repeat(first[:-1], count) + np.arange(at[-1]) - np.repeat(at[:-1], count)
    length = np.repeat(np.minimum(words, size), count)
    return K.mix(prefix.spans(begin, begin + length) + length.astype(K.U)), at


def _signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 minwise values (32 bits each) of every non-empty set."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, VALUES), np.uint32)
    if len(full):
        keys = K.mix(np.arange(1, 2 * VALUES + 1, dtype=K.U))
        for i in range(VALUES):
            x = (hashes ^ keys[i]) * (keys[VALUES + i] | K.U(1))
            out[full, i] = np.minimum.reduceat(x, at[full]) >> K.U(32)
    return out


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for lo, hi in K.slices(text):
                hashes, at = shingle_sets(text.slice(lo, hi - lo), size)
                n, one, two = (np.zeros(hi - lo, t) for t in (np.int64, K.U, K.U))
                for i in range(hi - lo):
                    distinct = np.unique(hashes[at[i] : at[i + 1]])
                    n[i] = len(distinct)
                    one[i] = distinct.sum(dtype=K.U)
                    two[i] = K.mix(distinct).sum(dtype=K.U)
                signature = _signatures(hashes, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("sw_k").slice(lo, hi - lo), batch.column("sw_t").slice(lo, hi - lo), pa.array(n), pa.array(K.signed(K.mix(one))), pa.array(K.signed(K.mix(two ^ n.astype(K.U)))), pa.array([x.tobytes() for x in signature], pa.binary())],
                    names=["sw_k", "sw_t", "n_shingles", "member", "check", "signature"],
                )

    return run


def paths(signature: np.ndarray, trees: int, depth: int, branch: float = SECOND) -> tuple[np.ndarray, np.ndarray]:
    """Row and leaf of every path of every signature."""
    rows, nodes = [], []
    for tree in range(trees):
        row = np.arange(len(signature))
        node = np.full(len(row), K.mix(np.array([tree + 1], K.U))[0])
        used = np.zeros(len(row), K.U)
        for level in range(depth):
            draw = K.mix(node + K.U(level * 1000003 + 17))
            next_row, next_node, next_used = [], [], []
            pick, taken = draw & K.U(63), used
            second = (draw >> K.U(40)) < K.U(int(branch * (1 << 24)))
            for turn in range(2):
                who = np.flatnonzero(second) if turn else np.arange(len(row))
                p = (pick[who] + K.U(turn) * (K.U(1) + ((draw[who] >> K.U(8)) & K.U(31)))) & K.U(63)
                t = taken[who]
                while (clash := (t >> p) & K.U(1) == 1).any():
                    p = np.where(clash, (p + K.U(1)) & K.U(63), p)
                value = signature[row[who], p.astype(np.int64)].astype(K.U)
                next_row.append(row[who])
                next_node.append(K.mix(node[who] ^ K.mix((value << K.U(7)) + p)))
                next_used.append(t | (K.U(1) << p))
                if not turn:
                    taken = taken | (K.U(1) << p)
            row, node, used = (np.concatenate(x) for x in (next_row, next_node, next_used))
        rows.append(row)
        nodes.append(node)
    return np.concatenate(rows), np.concatenate(nodes)


def _leaves(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("member").to_numpy()
            for lo in range(0, len(members), 1024):
                part = members[lo : lo + 1024]
                signature = np.stack([np.frombuffer(x.as_py(), np.uint32) for x in batch.column("signature").slice(lo, 1024)])
                row, node = paths(signature, trees, depth)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(node)), pa.array(part[row])], names=["node", "member"])

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        small = [np.frombuffer(x.as_py(), np.uint32).astype(np.uint8).tobytes() for x in batch.column("signature")]
        yield pa.RecordBatch.from_arrays([batch.column("member"), pa.array(small, pa.binary())], names=["member", "sketch"])


def _may_link(least: int):
    def compare(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x == y).sum(axis=-1) >= least

    return compare


def _set_links(size: int, percent: int):
    """Exact links of packed texts: 100 * intersection >= percent * union of their full sets."""

    def links(left: list[bytes], right: list[bytes], asked: int):
        unpack = zstandard.ZstdDecompressor()

        def sets(packed: list[bytes]) -> list[np.ndarray]:
            hashes, at = shingle_sets(pa.array([unpack.decompress(x) for x in packed], pa.binary()), size)
            return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

        x, y = sets(left), sets(right)
        if asked < 64:
            def both(i: int, j: int) -> int:
                return len(np.intersect1d(x[i], y[j], assume_unique=True))
        else:
            counts = _intersections(x, y)

            def both(i: int, j: int) -> int:
                return int(counts[i, j])

        def linked(i: int, j: int) -> bool:
            n = both(i, j)
            return 100 * n >= percent * (len(x[i]) + len(y[j]) - n)

        return linked

    return links


def _intersections(x: list[np.ndarray], y: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of 0/1 matrices (exact in floats)."""
    values, number = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    del values
    cut = sum(map(len, x))
    rows = [np.repeat(np.arange(len(z)), list(map(len, z))) for z in (x, y)]
    ids = [number[:cut], number[cut:]]
    shared = np.intersect1d(ids[0], ids[1])
    out = np.zeros((len(x), len(y)), np.float32)
    sides = []
    for r, i in zip(rows, ids, strict=True):
        at = np.searchsorted(shared, i)
        ok = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == i) if len(shared) else np.zeros(len(i), bool)
        order = np.argsort(at[ok], kind="stable")
        sides.append((r[ok][order], at[ok][order]))
    for lo in range(0, len(shared), columns):
        hi = min(lo + columns, len(shared))
        parts = []
        for (r, i), z in zip(sides, (x, y), strict=True):
            a, b = np.searchsorted(i, [lo, hi])
            m = np.zeros((len(z), hi - lo), np.float32)
            m[r[a:b], i[a:b] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([pack.compress(x.as_buffer()) for x in batch.column("text").cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("sw_k"), batch.column("sw_t"), packed, batch.column("sw_n")], names=["sw_k", "sw_t", "sw_z", "sw_n"])


def address() -> list:
    """A row's address: order key sw_k (a null id after all) and text hash sw_t."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("sw_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sw_t")]


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, trees: int = 20) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Links documents with 100 * intersection >= percent * union of their sets of word shingles (words
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text of fewer words is one shingle).  component_id is
    the smallest doc_id reachable over links, itself included; kept tells whether that is its own.

    Takes doc_id and text; other columns are ignored.  Null, empty and white-space texts have no
    shingles and no links: component_id is their own id.  A null doc_id counts as larger than every
    id and is returned as null; repeated rows and equal sets are linked as copies and returned each.
    """
    found = near_duplicate_groups(docs, shingle_words, percent, trees)
    return found.select(F.nullif(F.col("sw_k"), F.lit(_LAST)).alias("doc_id"), "n_shingles", F.nullif(F.col("sw_c"), F.lit(_LAST)).alias("component_id"), (F.col("sw_k") == F.col("sw_c")).alias("kept"))


def near_duplicate_groups(docs: DataFrame, shingle_words: int, percent: int, trees: int) -> DataFrame:
    """sw_k, sw_t (the row's address), n_shingles, sw_c (least order key of its group) and sw_g (the group; null without shingles)."""
    spark = docs.sparkSession
    keyed = docs.select(*address(), F.coalesce("text", F.lit("")).alias("text"))
    sets = written(keyed.mapInArrow(_sets(shingle_words), _SETS), "sets")
    some = sets.where("n_shingles > 0")
    members = written(
        some.groupBy("member").agg(F.min("sw_k").alias("least"), F.min_by(F.struct("sw_k", "sw_t"), F.struct("sw_k", "sw_t")).alias("where"), F.first("signature").alias("signature")),
        "members",
    )
    n = members.count()
    depth = max(3, math.ceil(math.log(max(n, 1)) / 3.2))
    leaves, sampled = (some.select("member", "signature").mapInArrow(_leaves(trees, depth), "node long, member long") for some in (members, members.where(in_sample())))
    sketches = members.select("member", "signature").mapInArrow(_sketch, "member long, sketch binary")
    packed = keyed.withColumn("sw_n", F.octet_length("text")).mapInArrow(_pack, "sw_k long, sw_t long, sw_z binary, sw_n int")
    places = members.select("member", F.col("where.sw_k").alias("sw_k"), F.col("where.sw_t").alias("sw_t"))

    def payloads(asked: DataFrame) -> DataFrame:
        wanted = asked.join(places, "member").hint("merge")  # alike at every size, so that growth can be told
        return written(packed.join(wanted, ["sw_k", "sw_t"]).dropDuplicates(["member"]).select("member", F.col("sw_z").alias("payload"), F.col("sw_n").alias("weight")), "asked-texts")

    # equal minwise values of a linked pair: at least this many, but for a chance of some 1e-6
    share = percent / 100
    least = math.floor(VALUES * share - 4.7 * math.sqrt(VALUES * share * (1 - share)))
    found = connected(leaves, sampled, sketches, payloads, _may_link(least), _set_links(shingle_words, percent))
    if found is None:
        groups = members.select("member", F.col("least").alias("sw_c"), F.col("member").alias("sw_g"))
    else:
        labelled = members.select("member", "least").join(found, "member", "left").select("member", "least", F.coalesce("component", "member").alias("sw_g"))
        least_of = labelled.groupBy("sw_g").agg(F.min("least").alias("sw_c"))
        groups = labelled.join(least_of, "sw_g").select("member", "sw_c", "sw_g")
    groups = written(groups, "groups")  # a side that was written lets the join split a set that a third of the rows have
    released(spark)
    joined = sets.select("sw_k", "sw_t", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("member")).alias("member")).join(groups, "member", "left")
    return joined.select("sw_k", "sw_t", "n_shingles", F.coalesce("sw_c", "sw_k").alias("sw_c"), "sw_g")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, trees: int = 20) -> DataFrame:
    """All columns of the documents that stay: of each group the one with the smallest doc_id (null last).

    Of several texts with that id the one with the least hash stays.  Rows that repeat the doc_id and
    text of one that stays are the same document and stay with it.  Null, empty and white-space texts
    stay.  Columns pass through whatever their names are.
    """
    groups = written(near_duplicate_groups(docs, shingle_words, percent, trees), "groups")
    kept = written(groups.groupBy("sw_g").agg(F.min(F.struct("sw_k", "sw_t")).alias("sw_kept")), "kept")
    lost = groups.join(kept, "sw_g").where(F.struct("sw_k", "sw_t") != F.col("sw_kept")).select("sw_k", "sw_t").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("sw_row"), *address())
    return rows.join(written(lost, "lost"), ["sw_k", "sw_t"], "left_anti").select(*[F.col("sw_row")[c].alias(c) for c in docs.columns])
