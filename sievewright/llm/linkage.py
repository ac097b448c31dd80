"""Connected groups of members that share nodes, without pairs inside a large group.

Near-duplicate operators put their members (distinct texts, never copies) into nodes: buckets whose
members may be alike.  Wanted are the connected groups of the exact links.

1. Nodes of up to ``SMALL`` members: their pairs are compared by sketches, which leaves few.  Each
   member's full text is compared with its least partner's first, then with those of the partners
   that aren't linked to that one.
2. Larger nodes: every member is paired with the centre of one of its nodes only, the member nearest to
   the coordinate-wise mode of the node's sketches, which in a group of edited copies is the text that
   they come from.  Nodes whose members are all in one group by now are done.  In the others all
   members outside the node's largest group are compared with each other and with that group, first by
   sketches, then exactly.  They are cut into blocks and each pair of blocks is a task of its own, so
   no task grows with a node, and members of the largest group aren't compared with each other.

No link between two groups is lost, and a node of n members of one group costs n comparisons.  A
node that a sample shows to have more than ``HOT`` members is known as large before it is dealt to one task,
and is never dealt so.  Intermediate tables are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.durable import partitions, released, written
from sievewright.llm.kernels import slices

#: Members of a node whose pairs are formed directly; of one whose members without a plausible partner are left out at once.
SMALL, MIDDLE = 16, 1024
#: Members of a node that isn't dealt to one task, and one in so many members shows it.
HOT, SAMPLED = 1 << 20, 64
#: Bounds of a block: members, and bytes of payload.
BLOCK, BLOCK_BYTES = 1024, 1 << 20
#: Members whose sketches one salt of a node's mode takes.
SALTED = 1 << 14
#: Pairs that are compared before it is looked which of the others are in one group by now.
AT_ONCE = 256
#: Rows of a bucket that are sorted at once, and those that a task holds before it packs them.
PACKED = 1 << 18
_PAIRS = "a long, b long"

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and member: distinct members of nodes that have two at least."""
    last_node = last_member = first = None
    emitted = True  # whether the open node's first member is out
    for batch in batches:
        node, member = batch.column("node").to_numpy(), batch.column("member").to_numpy()
        if not len(node):
            continue
        new_node = np.r_[last_node is None or node[0] != last_node, node[1:] != node[:-1]]
        same_member = np.r_[last_member is not None and not new_node[0] and member[0] == last_member, (member[1:] == member[:-1]) & ~new_node[1:]]
        starts = np.flatnonzero(new_node)
        run = np.cumsum(new_node) - 1
        firsts = np.where(run >= 0, member[starts[np.maximum(run, 0)]] if len(starts) else 0, first if first is not None else 0)
        later = ~new_node & ~same_member
        out_node, out_member, out_first = node[later], member[later], firsts[later]
        # a node's first member goes out with its second one
        opened = np.flatnonzero(later & (run < 0))
        if len(opened) and not emitted:
            out_node, out_member, out_first = np.r_[last_node, out_node], np.r_[first, out_member], np.r_[first, out_first]
            emitted = True
        runs = np.unique(run[later & (run >= 0)])
        if len(runs):
            heads = starts[runs]
            out_node, out_member, out_first = np.r_[out_node, node[heads]], np.r_[out_member, member[heads]], np.r_[out_first, member[heads]]
        if len(starts):
            first, emitted = int(member[starts[-1]]), bool(len(runs) and runs[-1] == run[-1])
        last_node, last_member = int(node[-1]), int(member[-1])
        if len(out_node):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (out_node, out_member, out_first)], names=["node", "member", "first"])


def in_sample() -> Column:
    """Whether a member is in the sample that shows hot nodes."""
    return F.pmod(F.xxhash64("member"), F.lit(SAMPLED)) == 0


def hot_nodes(sampled: DataFrame) -> DataFrame | None:
    """Nodes that have some ``HOT`` members or more by the nodes of a sample of the members, or None where there are none."""
    counts = sampled.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    found = written(counts.where(F.col("n") * SAMPLED >= HOT).select("node"), "hot-nodes")
    return found if found.head(1) else None


def shared_nodes(nodes: DataFrame) -> DataFrame:
    """(node, member, first) of nodes with several members; streams over sorted partitions."""
    return nodes.select("node", "member").repartition("node").sortWithinPartitions("node", "member").mapInArrow(_several, "node long, member long, first long")


def plausible_pairs(rows: DataFrame, near: Near, small: int | None = None) -> DataFrame:
    """Plausible pairs (a, b) of small nodes, and (a, node) for members of larger ones, of rows (node, member, sketch).

    Up to ``MIDDLE`` members are compared by sketches here, so members without a plausible partner go no further.
    """
    dealt = rows.repartition(partitions(rows.sparkSession), "node").sortWithinPartitions("node", "member")
    return dealt.select("node", "member", "sketch").mapInArrow(_paired(near, SMALL if small is None else small), "a long, b long, node long")


def _paired(near: Near, small: int, sketched: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        node, member, sketch = none, none, None
        hot = None  # the open node, once it is known to be large
        for batch in _then_none(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                node = np.r_[node, batch.column("node").to_numpy()]
                member = np.r_[member, batch.column("member").to_numpy()]
                more = matrix(batch.column("sketch"))
                sketch = more if sketch is None else np.r_[sketch, more]
            if not len(node):
                continue
            new = np.r_[True, (node[1:] != node[:-1]) | (member[1:] != member[:-1])]
            node, member, sketch = node[new], member[new], sketch[new]
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            held = np.diff(np.r_[starts, len(node)])
            large = (held > MIDDLE) | (node[starts] == hot if hot is not None else False)
            hot = int(node[-1]) if large[-1] else None
            end = len(node) if batch is None or large[-1] else starts[-1]  # any other open node waits
            run_of = np.repeat(np.arange(len(starts)), held)
            a, b = [none], [none]
            at = np.flatnonzero(((held > 1) & (held <= small) & ~large)[run_of] & (np.arange(len(node)) < end))
            for s in range(1, small):  # each step looks at those that have another member so far behind them
                at = at[at + s < end]
                at = at[run_of[at] == run_of[at + s]]
                if not len(at):
                    break
                for lo in range(0, len(at), 16384):
                    some = at[lo : lo + 16384]
                    some = some[near(sketch[some], sketch[some + s])]
                    a.append(member[some])
                    b.append(member[some + s])
            out = large[run_of][:end]
            for run in np.flatnonzero((held > small) & ~large & (starts < end)).tolist():
                lo, hi = starts[run], starts[run] + held[run]
                for row in range(lo, hi, 64):
                    ok = near(sketch[row : min(row + 64, hi), None], sketch[None, lo:hi])
                    out[row : min(row + 64, hi)] = ok.sum(axis=1) > 1  # each is near itself
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            columns = [pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(member[:end][out])]), pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(int(out.sum()), pa.int64())]), pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(node[:end][out])])]
            if sketched:
                columns.append(pa.concat_arrays([pa.nulls(len(pairs), pa.binary()), _binary(sketch[:end][out])]))
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "node", "sketch"][: len(columns)])
            node, member, sketch = node[end:], member[end:], sketch[end:]

    return run


Filed = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _row_batch(node: np.ndarray, member: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(member), _binary(sketch)], names=["node", "member", "sketch"])


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def packed_pairs(table: DataFrame, filed: Filed, n: int, near: Near, small: int | None = None) -> DataFrame:
    """``plausible_pairs`` of the rows that ``filed`` makes of ``table``, some ``n`` distinct ones; members of larger nodes come with their sketches.

    Rows go by bucket of nodes, many in one value, and are sorted where they arrive; a bucket has some
    ``PACKED`` rows.  A node of over ``MIDDLE`` members among the rows that a task packs at once is known as
    large by that: these members are spread over all buckets, and its own one is told.  No row may come twice.
    """
    buckets = max(4 * partitions(table.sparkSession), n // PACKED)
    packed = table.mapInArrow(_packed(filed, buckets), "bucket int, kind int, n int, rows binary")
    dealt = packed.repartition(partitions(table.sparkSession), "bucket").sortWithinPartitions("bucket")
    pairs = _paired(near, SMALL if small is None else small, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large: list[pa.RecordBatch] = []
        for out in pairs(_unpacked(batches, large)):
            yield out
            while large:
                yield large.pop()
        yield from large

    return dealt.mapInArrow(run, "a long, b long, node long, sketch binary")


#: Values of packed rows: of nodes in their bucket, of large nodes anywhere, and the large nodes of a bucket (without rows).
_OWN, _SPREAD, _TOLD = 0, 1, 2


def _packed(filed: Filed, buckets: int):
    def values(kind: int, bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts, len(rows)]
        held = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * rows.shape[1]).astype(np.int32)), pa.py_buffer(rows)])
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.full(len(starts), kind, np.int32)), pa.array(np.diff(ends).astype(np.int32)), held], names=["bucket", "kind", "n", "rows"])

    def bucket_of(x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) % np.uint64(buckets)).astype(np.int32)

    def close(held: list) -> Iterator[pa.RecordBatch]:
        node, member, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = np.hstack([node.view(np.uint8).reshape(-1, 8), member.view(np.uint8).reshape(-1, 8), sketch])
        in_order = np.sort(node)
        large = np.unique(in_order[MIDDLE:][in_order[MIDDLE:] == in_order[:-MIDDLE]])
        if len(large):
            spread = np.isin(node, large)
            yield values(_SPREAD, bucket_of(member[spread]), rows[spread])
            yield values(_TOLD, bucket_of(large), large.view(np.uint8).reshape(-1, 8))
            node, rows = node[~spread], rows[~spread]
        if len(node):
            yield values(_OWN, bucket_of(node), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for some in filed(batches):
            if len(some[0]):
                held.append(some)
                n += len(some[0])
            if n >= PACKED:
                yield from close(held)
                held, n = [], 0
        if held:
            yield from close(held)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], large: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket after the other, sorted by node and member; those of nodes that are known as large are put aside."""

    def aside(rows: np.ndarray) -> None:
        node, member = _ids(rows)
        none = pa.nulls(len(rows), pa.int64())
        large.append(pa.RecordBatch.from_arrays([pa.array(member), none, pa.array(node), _binary(rows[:, 16:])], names=["a", "b", "node", "sketch"]))

    for _, found in _groups(batches, ("bucket",), ("kind", "n", "rows")):
        for kind, n, x in found:
            if kind == _SPREAD:
                aside(np.frombuffer(x, np.uint8).reshape(n, -1))
        told = np.frombuffer(b"".join(x for kind, _, x in found if kind == _TOLD), np.int64)
        own = [(n, x) for kind, n, x in found if kind == _OWN]
        if not own:
            continue
        rows = np.frombuffer(b"".join(x for _, x in own), np.uint8).reshape(sum(n for n, _ in own), -1)
        if len(told):
            known = np.isin(_ids(rows)[0], told)
            if known.any():
                aside(rows[known])
                rows = rows[~known]
        node, member = _ids(rows)
        order = np.lexsort((member, node))
        yield _row_batch(node[order], member[order], rows[order, 16:])


def _ids(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes and members of packed rows."""
    return tuple(np.ascontiguousarray(rows[:, i : i + 8]).view(np.int64).ravel() for i in (0, 8))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """(member, component) of all members of ``edges`` (a, b); a component is named by its least member.

    Every member points to the least of its neighbours and itself, in an order that differs by level, and
    edges between members that point to different ones are worked on likewise, until there are none.  Each
    level is a part of the one before; tables are written to the shared folder.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    levels: list[DataFrame] = []
    while not levels or both.head(1):
        order = F.lit((len(levels) * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63))
        least = F.least(F.min(F.col("b").bitwiseXOR(order)), F.col("a").bitwiseXOR(order)).bitwiseXOR(order)
        levels.append(written(both.groupBy("a").agg(least.alias("head")), "heads"))
        heads = levels[-1]
        met = both.join(heads.withColumnRenamed("head", "x"), "a").join(heads.select(F.col("a").alias("b"), F.col("head").alias("y")), "b")
        new = written(met.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        released(spark, both)
        both = new
    labels = levels.pop()
    while levels:
        upper = labels.select(F.col("a").alias("head"), F.col("head").alias("top"))
        labels = written(levels.pop().join(upper, "head", "left").select("a", F.coalesce("top", "head").alias("head")), "heads")
    names = written(labels.groupBy("head").agg(F.min("a").alias("component")), "names")
    return written(labels.join(names, "head").select(F.col("a").alias("member"), "component"), "labels")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], fields: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows sorted by ``keys``; callers see one group at a time."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*keys, *fields)]
        for row in zip(*columns, strict=True):
            if row[: len(keys)] != key:
                if rows:
                    yield key, rows
                key, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if rows:
        yield key, rows


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Groups of rows sorted by ``keys`` (numbers), as batches; callers see one group at a time."""
    key, held = None, []

    def close() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
        starts = np.flatnonzero(np.r_[True, (columns[1:] != columns[:-1]).any(axis=1)])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            if held and key != columns[lo].tolist():
                yield close()
                held = []
            key = columns[lo].tolist()
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield close()


def _modes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Most frequent byte of every coordinate, with its count, of sorted (node, salt, sketch, weight) rows."""
    out: list[tuple] = []
    key, counts = None, None

    def close() -> None:
        if key is not None:
            top = counts.argmax(axis=1)
            out.append((key, top.astype(np.uint8).tobytes(), counts[np.arange(len(top)), top].astype(np.int32).tobytes()))

    for batch in batches:
        for node, salt, sketch, weight in zip(*(batch.column(c).to_pylist() for c in ("node", "salt", "sketch", "weight")), strict=True):
            if (node, salt) != key:
                close()
                key, counts = (node, salt), np.zeros((len(sketch), 256), np.int64)
            counts[np.arange(len(sketch)), np.frombuffer(sketch, np.uint8)] += 1 if weight is None else np.frombuffer(weight, np.int32)
        if len(out) > 4096:
            yield _mode_batch(out)
            out.clear()
    close()
    if out:
        yield _mode_batch(out)


def _mode_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["node", "sketch", "weight"])


_MODE = "node long, sketch binary, weight binary"


def matrix(sketches: pa.Array) -> np.ndarray:
    """Equally long binary values as the rows of a matrix of bytes."""
    if not len(sketches):
        return np.zeros((0, 1), np.uint8)
    offsets = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1]
    return np.frombuffer(sketches.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(sketches), -1)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            same = (matrix(batch.column("sketch")) == matrix(batch.column("mode"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("member"), pa.array(same.astype(np.int32))], names=["node", "member", "same"])


def _near_centre(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = pa.array(near(matrix(batch.column("sketch")), matrix(batch.column("centre_sketch"))))
                yield pa.RecordBatch.from_arrays([batch.column("centre").filter(ok), batch.column("member").filter(ok)], names=["a", "b"])

    return run


def first_pairs(sketched: DataFrame, near: Near) -> DataFrame:
    """Distinct pairs (a, b) of each node's centre with its members that may be links.

    The mode is taken in two levels, over salts (as many as the node's size asks for) and then over the
    salts' modes, so a hot node is spread; it only serves to choose the centre.
    """
    sizes = written(sketched.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SALTED).alias("salts")), "salts")
    salted = sketched.join(sizes, "node").select("node", F.pmod(F.xxhash64("member"), "salts").alias("salt"), "sketch", F.lit(None).cast("binary").alias("weight"))
    parts = salted.repartition("node", "salt").sortWithinPartitions("node", "salt").mapInArrow(_modes, _MODE)
    modes = parts.select("node", F.lit(0).cast("long").alias("salt"), "sketch", "weight").repartition("node").sortWithinPartitions("node").mapInArrow(_modes, _MODE)
    modes = written(modes.select("node", F.col("sketch").alias("mode")), "modes")
    scored = sketched.join(modes, "node").select("node", "member", "sketch", "mode").mapInArrow(_agreement, "node long, member long, same int")
    centres = scored.groupBy("node").agg(F.max(F.struct(F.col("same"), (-F.col("member")).alias("least"))).alias("c")).select("node", (-F.col("c.least")).alias("centre"))
    centres = written(centres, "centres")
    centre_sketches = centres.join(sketched.select("node", F.col("member").alias("centre"), F.col("sketch").alias("centre_sketch")), ["node", "centre"])
    pairs = sketched.join(written(centre_sketches, "centres"), "node").where("member <> centre").select("centre", "member", "sketch", "centre_sketch")
    return pairs.mapInArrow(_near_centre(near), _PAIRS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_tasks(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` (main, member, component, ...) dealt to tasks (main, i, j), one for each pair of blocks that has to be compared.

    The blocks of the group that all are compared with come last and meet only the others.
    """
    held = F.sum("weight") if "payload" in columns else F.sum(F.lit(0))
    in_blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, held / BLOCK_BYTES))
    is_main = F.col("component") == F.col("main")
    sizes = rows.groupBy("main", is_main.alias("own")).agg(in_blocks.alias("n"))
    sizes = sizes.groupBy("main").agg(F.coalesce(F.max(F.when(~F.col("own"), F.col("n"))), F.lit(0)).alias("others"), F.coalesce(F.max(F.when(F.col("own"), F.col("n"))), F.lit(0)).alias("mains"))
    rows = rows.join(written(sizes, "block-counts"), "main")
    rows = rows.withColumn("block", F.when(is_main, F.col("others") + F.pmod(F.xxhash64("member"), "mains")).otherwise(F.pmod(F.xxhash64("member"), "others")))
    met = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    rows = rows.where("others > 0").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), met - 1)))
    rows = rows.select("main", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
    return rows.repartition(partitions(rows.sparkSession), "main", "i", "j").sortWithinPartitions("main", "i", "j")


def _sides(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a task (twice the same ones for a block with itself)."""
    left = block == block.min()
    return np.flatnonzero(left), np.flatnonzero(left) if left.all() else np.flatnonzero(~left)


def _across(near: Near, sketch: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Plausible pairs of members of different groups, a few rows of the left block at a time."""
    for lo in range(0, len(left), 64):
        part = left[lo : lo + 64]
        ok = near(sketch[part][:, None], sketch[right][None]) & (group[part][:, None] != group[right][None, :])
        x, y = np.nonzero(ok)
        yield x + lo, y


def _partnered(near: Near):
    """(main, member) of members with a plausible partner in another group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("main", "i", "j")):
            left, right = _sides(rows.column("block").to_numpy())
            group, sketch = rows.column("component").to_numpy(), matrix(rows.column("sketch"))
            hit = np.zeros(rows.num_rows, bool)
            for x, y in _across(near, sketch, group, left, right):
                hit[left[x]] = hit[right[y]] = True
            if hit.any():
                yield rows.select(["main", "member"]).filter(pa.array(hit))

    return run


def _possible(compared, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of many pairs may be links by what the comparison can tell of all at once, if it can."""
    return compared.may_link(x, y) if hasattr(compared, "may_link") and len(x) else np.ones(len(x), bool)


def _compared(compared, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs are links, compared all at once where the comparison can do that."""
    if hasattr(compared, "several"):
        return compared.several(x, y)
    return np.array([compared(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)


def _joining(near: Near, links):
    """Links (a, b) that join groups, by comparing the full texts of plausible pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("main", "i", "j")):
            left, right = _sides(rows.column("block").to_numpy())
            head: dict[int, int] = {}

            def root(x: int, head=head) -> int:
                while (up := head.get(x, x)) != x:
                    head[x] = head.get(up, up)
                    x = up
                return x

            group, member, sketch = rows.column("component").to_numpy(), rows.column("member").to_numpy(), matrix(rows.column("sketch"))
            pairs = list(_across(near, sketch, group, left, right))
            n = sum(len(x) for x, _ in pairs)
            if not n:
                continue
            payload = rows.column("payload")
            compared = links(payload.take(pa.array(left)).to_pylist(), payload.take(pa.array(right)).to_pylist(), n)
            out = []
            for x, y in pairs:
                ok = _possible(compared, x, y)
                x, y = x[ok], y[ok]
                for lo in range(0, len(x), AT_ONCE):
                    p, q = (np.array([root(g) for g in of.tolist()], np.int64) for of in (group[left[x[lo : lo + AT_ONCE]]], group[right[y[lo : lo + AT_ONCE]]]))
                    apart = np.flatnonzero(p != q)
                    is_link = _compared(compared, x[lo:][apart], y[lo:][apart])
                    for at in apart[is_link].tolist():
                        one, other = root(int(p[at])), root(int(q[at]))
                        if one != other:
                            head[max(one, other)] = min(one, other)
                            a, b = int(member[left[x[lo + at]]]), int(member[right[y[lo + at]]])
                            out.append((min(a, b), max(a, b)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _verified(links):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("x"), BLOCK_BYTES // 4):
                x, y = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("x", "y"))
                linked = links(x, y, 1)
                every = np.arange(hi - lo)
                ok = _possible(linked, every, every)
                ok[ok] = _compared(linked, every[ok], every[ok])
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, links) -> DataFrame:
    """The links among ``pairs`` (a, b), by full texts."""
    both = pairs.join(texts.select(F.col("member").alias("a"), F.col("payload").alias("x")), "a").join(texts.select(F.col("member").alias("b"), F.col("payload").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(_verified(links), _PAIRS), "links")


def grouped(met: DataFrame, sketches: DataFrame | None, payloads: Callable[[DataFrame], DataFrame], near: Near, links, hot: DataFrame | None = None) -> DataFrame | None:
    """(member, component) of members with a link, or None where there is no link.

    met: what ``plausible_pairs`` or ``packed_pairs`` gives, written; with the latter, sketches is None.
    hot: (node, member), with sketches then, of large nodes that weren't dealt.
    See ``connected`` for the others.
    """
    spark = met.sparkSession
    pairs = written(met.where("node is null").select("a", "b").distinct(), "pairs")
    own = [] if sketches is not None else ["sketch"]
    large = met.where("node is not null").select("node", F.col("a").alias("member"), *own)
    if hot is not None:
        large = large.unionByName(hot.select("node", "member", *own))
    some = large.head(1)
    members = pairs.select(F.col("a").alias("member")).union(pairs.select("b"))
    if some:  # a row for each member: its nodes are as many as it has paths
        large = large.groupBy("member").agg(F.collect_set("node").alias("nodes"), *(F.first(c).alias(c) for c in own))
        large = written(large if sketches is None else large.join(sketches, "member"), "large-nodes")
        members = members.union(large.select("member"))
    texts = payloads(members.distinct())
    released(spark)
    # each member is compared with its least partner first, then with those that aren't linked to that one
    found = _confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")), texts, links)
    head = found.select(F.col("a").alias("head"), F.col("b").alias("line"))
    rest = pairs.join(head.select(F.col("line").alias("a"), F.col("head").alias("head_a")), "a", "left").join(head.select(F.col("line").alias("b"), F.col("head").alias("head_b")), "b", "left")
    rest = written(rest.where("head_b is null or head_b <> coalesce(head_a, a) and head_b <> a").select("a", "b"), "other-pairs")
    released(spark, pairs)
    found = found.unionByName(_confirmed(rest, texts, links))
    released(spark, rest)
    if some:
        centred = written(large.select(F.array_min("nodes").alias("node"), "member", "sketch"), "centred")
        found = found.unionByName(_confirmed(written(first_pairs(centred, near), "first-pairs"), texts, links))
        labels = components(found) if found.head(1) else None
        labelled = large.withColumn("component", F.col("member"))
        if labels is not None:
            labelled = large.join(labels, "member", "left").withColumn("component", F.coalesce("component", "member"))
        labelled = written(labelled, "labelled")
        released(spark, large)
        met_groups = _meetings(labelled)
        asked = written(_block_tasks(met_groups, ("member", "component", "sketch")).mapInArrow(_partnered(near), "main long, member long").distinct(), "partnered")
        released(spark)
        if asked.head(1):
            tasks = _block_tasks(written(met_groups.join(asked, ["main", "member"]).join(texts, "member"), "asked-rows"), ("member", "component", "sketch", "payload"))
            joined = written(tasks.mapInArrow(_joining(near, links), _PAIRS).distinct(), "links")
            released(spark, texts)
            return _merged(labels, joined) if labels is not None else components(joined) if joined.head(1) else None
        released(spark, texts)
        return labels
    released(spark, texts)
    return components(found) if found.head(1) else None


def _merged(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """``labels`` (member, component) once the links ``joined`` (a, b) hold as well; only components are worked on again."""
    if not joined.head(1):
        return labels
    for c in ("a", "b"):
        joined = joined.join(labels.select(F.col("member").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    upper = components(written(joined.where("a <> b"), "met-groups"))
    new = labels.join(upper.select(F.col("member").alias("component"), F.col("component").alias("upper")), "component", "left").select("member", F.coalesce("upper", "component").alias("component"))
    return written(new.unionByName(upper.join(labels.select("member"), "member", "left_anti")), "labels")


def _meetings(labelled: DataFrame) -> DataFrame:
    """Rows (main, member, component, sketch) to be compared across components, of members (member, nodes, sketch, component).

    A node's ``main`` is the component with most members there.  Its members of other components are to
    be compared with each other and with that component, whose members stand there once however many
    nodes they share.
    """
    placed = labelled.select(F.explode("nodes").alias("node"), "member", "component")
    counts = placed.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.groupBy("node").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("node").alias("open_node"), F.col("m.component").alias("main"))
    nodes = written(nodes, "open-nodes")
    others = placed.join(nodes, (F.col("node") == F.col("open_node")) & (F.col("component") != F.col("main"))).select("main", "member").distinct()
    mains = nodes.select("main").distinct()
    own = labelled.join(mains, F.col("component") == F.col("main"), "left_semi").select(F.col("component").alias("main"), "member")
    return written(others.unionByName(own).join(labelled.select("member", "component", "sketch"), "member"), "meetings")


def connected(nodes: DataFrame, sampled: DataFrame, sketches: DataFrame, payloads: Callable[[DataFrame], DataFrame], near: Near, links: Callable[[list, list, int], Callable[[int, int], bool]]) -> DataFrame | None:
    """(member, component) of members with a link, or None where there is no link.

    nodes: (node, member); sampled: those of members that are ``in_sample``.  sketches: (member, sketch),
    one row a member, equally many bytes each.  payloads: from a table of members to (member, payload,
    weight), one row each; weight is the bytes that a task needs for it.  near: two arrays of sketches
    (bytes along the last axis, the others broadcast) to whether they may be links (no link may be
    missed).  links: two lists of payloads, and the number of pairs that will be asked for at most, to
    a function that tells whether pair (i, j) is a link, exactly.
    """
    spark = nodes.sparkSession
    hot = hot_nodes(sampled)
    spread = None
    if hot is not None:
        spread = written(nodes.join(F.broadcast(hot), "node"), "hot-members")  # one node at most for every HOT rows
        nodes = nodes.join(F.broadcast(hot), "node", "left_anti")
    shared = written(shared_nodes(nodes).select("node", "member"), "shared-nodes")
    released(spark)
    met = written(plausible_pairs(shared.join(sketches, "member"), near), "met")
    released(spark, shared)
    return grouped(met, sketches, payloads, near, links, spread)
