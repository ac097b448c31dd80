"""Mixing sources to target weights.

Each source's documents are packed, in a pseudorandom order, into fixed-length blocks of words.  The
mix is a sequence of slots cut into output shards; every shard draws its source counts from a
multinomial over what the sources still lack, so the totals meet their targets exactly.  A source's
slots are numbered through all shards, and slot number i takes the block that a pseudorandom index
permutation of the source's blocks (a Feistel network with cycle walking, one per pass over the
source) maps i to.  Slots and blocks meet in a join by (source, block index).

Prefix sums that place documents in their source's stream run in two levels, over hash buckets and
then inside each bucket, so a source with a third of all rows is spread over many tasks.  The driver
holds one row for each source and, while it draws, one for each shard and source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm import kernels as K
from sievewright.llm.durable import partitions, written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 2048


@dataclass(frozen=True)
class Mix:
    """``taken``: a row for each document; ``slots``: shard, source number, block of every slot."""

    taken: DataFrame
    slots: DataFrame
    sources: list[dict]


def target_sizes(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Share the total by weight; what exceeds cap * size is shared again by weight among the rest."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    open_sources = [i for i, n in enumerate(sizes)]
    left = total
    while open_sources:
        weight = sum(weights[i] for i in open_sources)
        over = [i for i in open_sources if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_sources:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        open_sources = [i for i in open_sources if i not in set(over)]
    return out


def shard_counts(totals: np.ndarray, shard_slots: int, seed: int) -> Iterator[np.ndarray]:
    """Slots of each source in each shard: multinomial over what is left, never more than is left."""
    rng = np.random.default_rng(seed)
    left = totals.astype(np.int64).copy()
    while left.sum():
        want = int(min(shard_slots, left.sum()))
        drawn = np.zeros(len(left), np.int64)
        while want:
            rest = left - drawn
            drawn += np.minimum(rng.multinomial(want, rest / rest.sum()), rest)
            want = int(min(shard_slots, left.sum()) - drawn.sum())
        left -= drawn
        yield drawn


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1: four Feistel rounds, walked until the value is in range."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = K.U((1 << half) - 1)
    out = index.astype(K.U)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> K.U(half), x & mask
        for r in range(4):
            left, right = right, left ^ (K.mix(right + K.U((key * 4 + r) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))) & mask)
        out[todo] = (left << K.U(half)) | right
        todo = todo[out[todo] >= K.U(n)]
    return out.astype(np.int64)


def _slots(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                for lo in range(r.first, r.first + r.n, 1 << 16):
                    index = np.arange(lo, min(lo + (1 << 16), r.first + r.n))
                    turn, block = index // r.blocks, np.zeros(len(index), np.int64)
                    for t in np.unique(turn):
                        own = turn == t
                        block[own] = permuted(index[own] % r.blocks, r.blocks, seed * 1000003 + r.source * 64 + int(t))
                    yield pd.DataFrame({"shard": np.full(len(index), r.shard), "sw_s": np.full(len(index), r.source, np.int32), "block": block})

    return run


def mix(docs: DataFrame, block_words: int = 32, shard_slots: int = 1 << 18, cap: int = 3, seed: int = 7) -> Mix:
    """Mix all documents; weights of the sources are 1, 2, 3 and so on repeating, by code point order.

    Takes doc_id, source and text; other columns are ignored.  Size is the number of words
    ``[^\\x20\\x09-\\x0D]+`` (null text: 0).  A null source is a source of its own that comes last.
    ``taken`` has doc_id, source, size, source_size, target (its source's) and taken: the words that
    the mix takes from the row, repeats counted, at most cap * size.  Null ids and repeated rows are
    documents of their own; equal rows may be taken differently often, but reruns agree on the rows
    as a whole.  Sources without words have target 0.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size")), "sizes")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    totals = [int(r["source_size"]) for r in per_source]
    targets = target_sizes(totals, [1.0 + i % 3 for i in range(len(totals))], float(cap))
    blocks = [-(-t // block_words) for t in totals]
    count = np.array([min(cap * b, round(t * b / s)) if s else 0 for t, b, s in zip(targets, blocks, totals, strict=True)], np.int64)
    schema = "source string, sw_s int, source_size long, target double, sw_buckets long"
    sources = spark.createDataFrame([(r["source"], i, totals[i], float(targets[i]), max(1, -(-r["n"] // BUCKET_ROWS))) for i, r in enumerate(per_source)], schema)

    first = np.zeros(len(totals), np.int64)
    plan = []
    for shard, drawn in enumerate(shard_counts(count, shard_slots, seed)):
        plan += [(shard, i, int(first[i]), int(drawn[i]), blocks[i]) for i in np.flatnonzero(drawn).tolist()]
        first += drawn
    parts = spark.createDataFrame(plan, "shard long, source long, first long, n long, blocks long").repartition(partitions(spark), "shard", "source")
    slots = parts.mapInPandas(_slots(seed), "shard long, sw_s int, block long")
    # slots come from a small plan but are as many as blocks; without the hint their size is misjudged
    uses = slots.groupBy("sw_s", "block").agg(F.count(F.lit(1)).alias("sw_uses")).hint("merge")

    rows = sizes.join(sources.withColumnRenamed("source", "sw_source"), F.col("source").eqNullSafe(F.col("sw_source"))).drop("sw_source")
    rows = rows.withColumn("sw_b", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "sw_buckets"))
    order = Window.partitionBy("sw_s", "sw_b").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("sw_s", "sw_b").agg(F.sum("size").alias("sw_n"))
    starts = buckets.withColumn("sw_start", F.coalesce(F.sum("sw_n").over(Window.partitionBy("sw_s").orderBy("sw_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("sw_s", "sw_b", "sw_start").hint("merge")
    placed = rows.withColumn("sw_in", F.coalesce(F.sum("size").over(order), F.lit(0))).join(starts, ["sw_s", "sw_b"]).withColumn("sw_o", F.col("sw_start") + F.col("sw_in"))
    result = ["doc_id", "source", "size", "source_size", "target"]
    full = placed.where("size > 0")
    pieces = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("sw_o") / block_words), F.floor((F.col("sw_o") + F.col("size") - 1) / block_words))))
    overlap = F.least(F.col("sw_o") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("sw_o", F.col("block") * block_words)
    joined = pieces.withColumn("sw_w", overlap).join(uses, ["sw_s", "block"], "left")
    taken = joined.groupBy(*result, "sw_s", "sw_o").agg(F.sum(F.col("sw_w") * F.coalesce("sw_uses", F.lit(0))).cast("long").alias("taken")).select(*result, "taken")
    empty = placed.where("size = 0").select(*result, F.lit(0).cast("long").alias("taken"))
    named = [{"source": r["source"], "size": totals[i], "target": targets[i], "slots": int(count[i])} for i, r in enumerate(per_source)]
    return Mix(taken.unionByName(empty), slots, named)
