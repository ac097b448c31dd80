"""Fingerprints, line dedup, mixing and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import fingerprints as P
from sievewright.llm import linkage
from sievewright.llm import line_dedup as N
from sievewright.llm import mixing as M
from tests.llm.data import documents, odd_rows, prose

# fingerprints


def test_span_equality_and_extension():
    rng = random.Random(1)
    x = "".join(rng.choice("abcé 😀") for _ in range(300))
    y = x[:100] + "Q" + x[:150]
    a, b = P.PrefixHash(x), P.PrefixHash(y)
    assert P.longest_common_extension(a, 0, b, 0) == 100 and P.longest_common_extension(a, 0, b, 101) == 150
    assert P.fingerprint(P.PrefixHash.joined(a, 77, b, 33)) == P.fingerprint(P.PrefixHash(x[:77] + y[:33]))
    assert a.span(3, 20) == P.PrefixHash("zz" + x[3:23]).span(2, 20)


def test_edited_texts(spark):
    rows = odd_rows() + [(30 + i, prose(i, 100 + 37 * i)) for i in range(25)]
    got = P.fingerprint_documents(documents(spark, rows)).collect()
    last = (1 << 63) - 1
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append(r)
    order = sorted(((last if d is None else d, t or "") for d, t in rows), key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        found = [r for r in texts[None if d == last else d] if r.edited_text == edited]
        assert found and found[0].n_chars == len(t)
        if len(t) > 300 and d >= 30:
            assert found[0].near_edited > 0.25 and found[0].shared_prefix >= len(t) - len(t) // 2
    assert len({r.fingerprint for r in got if r.doc_id == 9 or r.doc_id == 8}) == 1
    assert P.fingerprint_documents(documents(spark, [])).collect() == []
    assert P.fingerprint_documents(documents(spark, [(1, "abcd")])).collect()[0].edited_text == "abab"


def test_ranges_of_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(P, "KEPT_POWERS", 64)
    rows = [(None, prose(3000 + i, 20)) for i in range(300)] + [(5, "b" * 9), (5, "b" * 9)] + [(i, prose(i, 8)) for i in range(60)]
    ordered = P.in_descending_order(documents(spark, rows).select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("sw_k"), F.xxhash64("text").alias("sw_t"), "text"))
    placed = ordered.select(F.spark_partition_id().alias("p"), "sw_b", "sw_copy", "sw_k").collect()
    own = [r for r in placed if not r.sw_copy]
    assert len(own) == len(rows) and len({r.p for r in own if r.sw_k == (1 << 63) - 1}) > 2
    assert len({r.p for r in placed}) == 4 and all(len({r.p for r in placed if r.sw_b == b}) == 1 for b in {r.sw_b for r in placed})
    got = P.fingerprint_documents(documents(spark, rows)).collect()
    keyed = spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text")).collect()
    hashes = dict(map(tuple, keyed))
    order = sorted(((1 << 63) - 1 if d is None else d, hashes[t], t) for d, t in rows)[::-1]
    want = []
    for i, (_, _, t) in enumerate(order):
        following = order[(i + 1) % len(order)][2]
        want.append(t[: len(t) - len(t) // 2] + following[: len(t) // 2])
    assert sorted(r.edited_text for r in got) == sorted(want)


# line dedup


def brute_lines(rows, min_words=5, similarity=0.8):
    last = (1 << 63) - 1
    lines = sorted({(last if d is None else d, t, i): N.normal(x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))}.items())
    lines = [(k, x) for k, x in lines if x.count(" ") + 1 >= min_words]
    sims = [int(s) for s in N.simhashes([x for _, x in lines])[2]] if lines else []
    head = list(range(len(lines)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if (sims[i] ^ sims[j]).bit_count() <= N.BITS:
                x, y = lines[i][1].split(), lines[j][1].split()
                if x == y or N.edit_distance(x, y) <= (1 - similarity) * max(len(x), len(y)) + 1e-9:
                    a, b = sorted((find(i), find(j)))
                    head[b] = a
    gone = {k for i, (k, _) in enumerate(lines) if find(i) != i}
    out = []
    for d, t in rows:
        k = last if d is None else d
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, t, i) not in gone)))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    shared = [prose(400 + i, 12 + i) for i in range(8)]
    rows = odd_rows()
    for i in range(40):
        lines = [prose(500 + i, 9), shared[i % 8].upper() + "!" if i % 3 else shared[i % 8], "too short line", f"see page {i} of the long report number {i * 7} for more"]
        w = shared[(i + 3) % 8].split()
        if i % 2:
            w[i % len(w)] = "changed"
        rows.append((50 + i, "\n".join([*lines, " ".join(w)])))
    docs = documents(spark, rows)
    out = N.dedup_lines(docs)
    assert [c for c in docs.columns if c != "n_removed"] == [c for c in out.columns if c not in ("n_lines", "n_removed")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == brute_lines(rows)
    assert N.dedup_lines(documents(spark, [])).collect() == []


@pytest.mark.parametrize("small", [16, 128])
def test_lines_by_edit_similarity_alone(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    rng = random.Random(12)
    rows, lines = [], []
    for i in range(60):
        words = prose(2000 + i, rng.choice([5, 7, 10, 15, 20, 30, 60, 120]), 90).split()
        lines.append(" ".join(words))
        for _ in range(3 if i else 40):  # one group is larger than a small node
            edited = list(words)
            for _ in range(rng.randint(0, int(0.25 * len(words)))):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice([[], ["other"], [edited[at], "more"]])
            lines.append(" ".join(edited))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i::30])) for i in range(30)]
    order = [(i, j, x) for i, text in rows for j, x in enumerate(text.split("\n"))]
    words = [x.split() for _, _, x in order]
    head = list(range(len(order)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(order)):
        for j in range(i):
            longest = max(len(words[i]), len(words[j]))
            if min(len(words[i]), len(words[j])) >= 5 and 5 * abs(len(words[i]) - len(words[j])) <= longest and 5 * N.edit_distance(words[i], words[j]) <= longest:
                a, b = sorted((find(i), find(j)))
                head[b] = a
    stay = {(i, j) for at, (i, j, _) in enumerate(order) if find(at) == at}
    got = {r.doc_id: r.text for r in N.dedup_lines(documents(spark, rows), by_edits=True).collect()}
    assert len(stay) < len(order) - 60
    assert got == {i: "\n".join(x for j, x in enumerate(text.split("\n")) if (i, j) in stay) for i, text in rows}
    assert N.dedup_lines(documents(spark, []), by_edits=True).collect() == []


@pytest.mark.parametrize("by_edits", [True, False])
def test_repeated_lines_without_spaces(spark, by_edits):
    rows = [(1, "這條河流經過古老的城市\nแม่น้ำไหลผ่านเมือง\n你好"), (2, "這條河流經過古老的城市\nแม่น้ำไหลผ่านเมือง\n你好\n別的")]
    assert {r.doc_id: r.text for r in N.dedup_lines(documents(spark, rows), by_edits=by_edits).collect()} == {1: rows[0][1], 2: "你好\n別的"}


@pytest.mark.parametrize("words", [8, 12, 20, 40])
def test_recall_of_edited_lines(words):
    rng = random.Random(words)
    lines = [prose(7000 + i, words, 300).split() for i in range(150)]
    edited = [list(x) for x in lines]
    for x in edited:
        for i in rng.sample(range(words), words // 5):
            x[i] = f"new{rng.choice('abcdefgh')}"

    def filed(some):
        got = N.lines_of([" ".join(x) for x in some])
        hashes = N._hashed(got)
        line, key = N.block_keys(hashes, got.first, np.zeros(N.SLOTS, np.uint8), np.ones(len(some), bool))
        heads = N._distinct(hashes, got.first)
        sketch = N._sketches(N._sims(*heads), N._sims(N.K.mix(heads[0]), heads[1]), np.diff(got.first))
        return [set(key[line == i].tolist()) for i in range(len(some))], np.frombuffer(sketch.buffers()[2], np.uint8).reshape(len(some), -1)

    (a, x), (b, y) = filed(lines), filed(edited)
    found = np.array([bool(i & j) for i, j in zip(a, b, strict=True)]) & N._plausible(0.8)(x, y)
    assert all(5 * N.edit_distance(i, j) <= words for i, j in zip(lines, edited, strict=True)) and found.mean() >= 0.9


def lines_of_words(spark, lines, parts):
    """Rows (member, words) of lines, in so many partitions."""
    got = N.lines_of(["\n".join(lines)])
    words = N._words(N._hashed(got), got.first, np.arange(len(lines)), np.ones(len(lines), bool)).to_pylist()
    return spark.createDataFrame(list(enumerate(words)), "member long, words binary").repartition(parts, "member")


def test_common_blocks_are_counted_in_all_lines(spark):
    lines = [f"of the {prose(9000 + i, 6, 400)}" for i in range(N.COMMON)] + [f"by any {prose(9500 + i, 6, 400)}" for i in range(N.COMMON - 1)]
    got = N.lines_of(["\n".join(lines)])
    hashes = N.K.mix(N._hashed(got) >> N.K.U(32))
    counts = Counter()
    for a, b in zip(got.first[:-1], got.first[1:], strict=True):
        for n in (1, 2):
            counts.update((N._grams(hashes, np.arange(a, b - n + 1), n) & N.K.U(N.SLOTS - 1)).tolist())
    expected = {slot for slot, n in counts.items() if n >= N.COMMON}
    of, the, by = (int(N._grams(hashes, np.array([i]), n)[0]) % N.SLOTS for i, n in ((0, 1), (0, 2), (got.first[N.COMMON], 2)))
    assert of in expected and the in expected and by not in expected
    for parts in (1, 5):
        table = np.unpackbits(N.common_blocks(lines_of_words(spark, lines, parts), len(hashes)))
        assert set(np.flatnonzero(table).tolist()) == expected and len(table) == N.SLOTS


def test_pipeline_counts_blocks_in_every_document(spark, monkeypatch):
    import corpus_pipeline

    seen, count = [], N.common_blocks
    monkeypatch.setattr(N, "common_blocks", lambda words, n: seen.append((sorted(len(r.words) // 4 for r in words.select("words").collect()), n)) or count(words, n))
    rows = [(i, "\n".join([prose(300 + i, 5 + i % 7), prose(300 + i % 9, 30), "too short"])) for i in range(40)]
    corpus_pipeline.dedup_lines(spark, documents(spark, rows), "").collect()
    distinct = {N.normal(x) for _, text in rows for x in text.split("\n") if len(x.split()) >= 5}
    sizes = sorted(len(x.split()) for x in distinct)
    assert seen == [(sizes, sum(sizes))]


def test_lines_are_taken_out_where_the_text_is(spark):
    import corpus_pipeline

    texts = ["a\nb\n\nc", "a\n", "\n\n", "", "a", "ä\n\U0001f600\r\nz", "\n".join(map(str, range(3000)))]
    rows = [(i, x, sorted(g)) for i, x in enumerate(texts) for n in [x.count("\n") + 1] for g in (set(range(n)), {0}, {n - 1}, set(range(0, n, 2)))]
    got = spark.createDataFrame(rows, "i int, text string, gone array<int>").select("i", "gone", N._without(F.col("text"), F.col("gone")).alias("left")).collect()
    assert [r.left for r in got] == ["\n".join(p for i, p in enumerate(x.split("\n")) if i not in g) for _, x, g in rows]
    docs = documents(spark, [(i, prose(700, 8) + "\n" + prose(701 + i, 8)) for i in range(4)])
    # a Python function would run twice, for the filter and for the text, in workers of its own each time
    plan = corpus_pipeline.dedup_lines(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "ShuffledHashJoin" in plan


def test_packed_pairs_are_those_of_rows(spark):
    rng = np.random.default_rng(3)
    node, member = rng.integers(-40, 40, 3000), rng.permutation(3000)
    sketch = np.hstack([rng.integers(0, 2, (3000, 16)), np.full((3000, 1), 9), np.zeros((3000, 3), int)]).astype(np.uint8)
    rows = spark.createDataFrame([(int(n), int(m), s.tobytes()) for n, m, s in zip(node, member, sketch, strict=True)], "node long, member long, sketch binary")
    near = N._plausible(0.8)

    def filed(batches):
        for batch in batches:
            yield batch.column("node").to_numpy(), batch.column("member").to_numpy(), linkage.matrix(batch.column("sketch"))

    for small in (16, 64):
        got = linkage.packed_pairs(rows, filed, 3000, near, small).collect()
        assert sorted((r.a, r.b or -1, r.node or -99) for r in got) == sorted((r.a, r.b or -1, r.node or -99) for r in linkage.plausible_pairs(rows, near, small).collect())
        assert all((r.sketch is None) == (r.b is not None) and (r.b is not None or r.sketch == sketch[np.flatnonzero(member == r.a)[0]].tobytes()) for r in got)


def test_large_nodes_are_known_without_a_sample(spark):
    rng = np.random.default_rng(4)
    n = linkage.MIDDLE + 500
    node = np.r_[np.full(n, 7), rng.integers(-40, 40, 2000) * 2]  # node 7 is large where half of it is packed, and has a few rows elsewhere
    member = rng.permutation(len(node))
    sketch = np.hstack([rng.integers(0, 2, (len(node), 16)), np.full((len(node), 1), 9), np.zeros((len(node), 3), int)]).astype(np.uint8)
    rows = [(int(a), int(b), s.tobytes()) for a, b, s in zip(node, member, sketch, strict=True)]
    near = N._plausible(0.8)

    def filed(batches):
        for batch in batches:
            yield batch.column("node").to_numpy(), batch.column("member").to_numpy(), linkage.matrix(batch.column("sketch"))

    def table(some):
        return spark.createDataFrame(some, "node long, member long, sketch binary").coalesce(1)

    rest = rows[n - 200 : n] + rows[n + 100 :]
    got = linkage.packed_pairs(table(rows[: n - 200] + rows[n : n + 100]).union(table(rest)), filed, len(rows), near).collect()
    assert sorted((r.a, r.b or -1, r.node or -99) for r in got) == sorted((r.a, r.b or -1, r.node or -99) for r in linkage.plausible_pairs(table(rows), near).collect())
    batch = linkage._row_batch(node[: n - 200], member[: n - 200], sketch[: n - 200])
    packed = [r for b in linkage._packed(filed, 8)(iter([batch])) for r in b.to_pylist()]
    assert {r["bucket"] for r in packed if r["kind"] == linkage._SPREAD} == set(range(8)) and sum(r["n"] for r in packed if r["kind"] == linkage._SPREAD) == n - 200
    assert [(r["bucket"], np.frombuffer(r["rows"], np.int64).tolist()) for r in packed if r["kind"] != linkage._SPREAD] == [(7, [7])]


def test_words_of_lines_that_several_tasks_bring_are_taken_once(spark):
    members = N.K.signed(N.K.mix(np.arange(1, 3001, dtype=np.uint64))).tolist()
    words = {m: np.array([i, i + 1], np.uint32).tobytes() for i, m in enumerate(members)}
    tasks = [members[:2000], members[1500:2500], members[1900:] + members[:3]]
    rows = [spark.createDataFrame([(m, words[m]) for m in some] + [(m, None) for m in some[:50]], "member long, words binary").coalesce(1) for some in tasks]
    lines = linkage.written(rows[0].union(rows[1]).union(rows[2]), "lines")
    distinct = linkage.written(lines.groupBy("member").agg(F.count("words").alias("brought")), "distinct-lines")
    got = N._distinct_words(lines, distinct)
    assert sorted(map(tuple, got.collect())) == sorted(words.items())
    made, once = N._rows_of(got)
    assert sorted(r.member for r in made.mapInArrow(once, "member long, words binary").collect()) == sorted(members)
    asked = linkage.written(spark.createDataFrame([(m,) for m in members[::7]], "member long"), "asked")
    marks = spark.sparkContext.broadcast(N.marks_of(asked))
    some = [r.member for r in made.mapInArrow(N._asked(once, marks), "member long, payload binary").collect()]
    assert set(members[::7]) <= set(some) and len(set(some)) == len(some) < 600


def test_line_links_are_those_of_the_edit_distance():
    rng = random.Random(6)
    lines = []
    for k in range(12):
        base = [rng.randrange(1 << 32) for _ in range(rng.choice([5, 9, 30, 130]))]
        for _ in range(6):
            x = list(base)
            for _ in range(rng.randrange(0, len(x) // 4 + 2)):
                i = rng.randrange(len(x))
                rng.choice([lambda: x.pop(i), lambda: x.insert(i, rng.choice(base)), lambda: x.__setitem__(i, rng.randrange(1 << 32)), lambda: x.append(x.pop(i))])()
                x = x or [1]
            lines.append(x)
        lines.append(rng.sample(base, len(base)))
    packed = [np.array(x, np.uint32).tobytes() for x in lines]
    linked = N._line_links(0.8)(packed, packed, 1)
    i, j = (x.ravel() for x in np.indices((len(lines), len(lines))))
    expected = [x == y or N.edit_distance(lines[x], lines[y]) <= int(N.most_edits(max(len(lines[x]), len(lines[y])), 0.8)) for x, y in zip(i, j, strict=True)]
    got = [linked(int(x), int(y)) for x, y in zip(i, j, strict=True)]
    assert got == expected and sum(got) > len(lines) * 2
    may = linked.may_link(i, j)
    assert all(m or not e for m, e in zip(may, expected, strict=True)) and may.sum() < len(may) / 4
    assert linked.several(i, j).tolist() == expected


def test_distances_of_many_pairs():
    rng = np.random.default_rng(8)
    for width in (8, 16, 32, 64):
        n, m = rng.integers(1, width + 1, (2, 40))
        n[:2] = m[1:3] = width
        x, y = rng.integers(0, 4, (2, 40, width)).astype(np.uint32)
        y[::3] = x[::3]
        got = N._distances(x, y, n, m).tolist()
        assert got == [N.edit_distance(a[:i].tolist(), b[:j].tolist()) for a, b, i, j in zip(x, y, n, m, strict=True)]


def test_hashes_of_short_words():
    words = [b"a" * n for n in range(1, 140)] + [b"a" * n + b"b" for n in range(140)] + [b"\0" * n for n in range(1, 20)] + [b"", b"word", b"word\0"]
    for order in (words, words[::-1]):  # wherever a word stands, last in the data as well
        sizes = np.array([len(w) for w in order])
        end = np.cumsum(sizes + 1) - 1
        got = N.K.short_hashes(np.frombuffer(b" ".join(order), np.uint8), end - sizes, end).tolist()
        seen = dict(zip(order, got, strict=True))
        assert len(set(got)) == len(words) and (order is words or seen == first)
        first = seen
    assert not len(N.K.short_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_simhashes_of_planes_are_those_of_lanes():
    rng = np.random.default_rng(5)
    size = np.r_[rng.integers(0, 40, 5000), rng.integers(100, 300, 200), 0, N.PLANED, N.PLANED + 1, 2000]
    first = np.r_[0, np.cumsum(size)]
    hashes = rng.integers(0, 1 << 63, first[-1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (N._sims(hashes, first) == N._sims_of_long(hashes, first)).all()


@pytest.mark.parametrize("later", [[], [(30, 61)], [(5, 900), (61, 901), (901, 30)]])
def test_components_of_paths_and_links_that_come_later(spark, later):
    edges = [(i, i + 1) for i in range(50)] + [(60, i) for i in range(61, 80)] + [(-7, 100), (-7, 200)]
    labels = linkage.components(spark.createDataFrame(edges, "a long, b long"))
    if later:
        labels = linkage._merged(labels, linkage.written(spark.createDataFrame(later, "a long, b long"), "links"))
    head = {x: x for e in edges + later for x in e}
    for _ in range(100):
        for a, b in edges + later:
            head[a] = head[b] = min(head[a], head[b])
    assert {r.member: r.component for r in labels.collect()} == head and labels.count() == len(head)


def test_lines_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f\nx 1", 5, "m", 7), (2, "a b c d e f\nx 2\nx  1!", 6, "n", 8), (None, None, 9, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sw_k long, N_Removed string, sw_gone long")
    got = {r.doc_id: tuple(r) for r in N.dedup_lines(docs, by_edits=True, exact_from=1).collect()}
    assert got == {1: (1, rows[0][1], 5, "m", 7, 2), 2: (2, "x 2", 6, "n", 8, 3), None: (*rows[2], 0)}


def test_edit_distance():
    def slow(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            new = [i]
            for j, b in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return row[-1]

    rng = random.Random(4)
    for _ in range(200):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert N.edit_distance(x, y) == slow(x, y)


@pytest.mark.parametrize("n", [1, 1000, 10**6, 10**9])
def test_pigeonhole_keys_cover_all_near_hashes(n):
    blocks = N.blocks_for(n)
    import pyarrow as pa

    rng = random.Random(n)
    for _ in range(30):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), N.BITS):
            y ^= 1 << b
        sims = np.array([x, y], np.uint64).view(np.int64)
        batch = pa.RecordBatch.from_arrays([pa.array(sims), pa.array([1, 2])], names=["sim", "member"])
        nodes = [set(np.array(c)[i] for c in [b.column("node").to_numpy() for b in N._nodes(blocks)(iter([batch]))]) for i in (0, 1)]
        assert nodes[0] & nodes[1]


# mixing


def test_targets():
    assert M.target_sizes([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    assert M.target_sizes([10, 1000, 0], [3, 1, 2]) == [30.0, 980.0, 0.0]
    assert M.target_sizes([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(M.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_shard_counts_meet_totals():
    totals = np.array([5, 0, 1000, 37])
    drawn = list(M.shard_counts(totals, 100, 1))
    assert (sum(drawn) == totals).all() and all(d.sum() == 100 for d in drawn[:-1])


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, prose(i, rng.randint(1, 400)), "en", f"s{min(i % 9, 4)}") for i in range(300)] + [(1000, None, "en", "s0"), (1001, "", "en", "s1"), (1002, prose(3, 900), "en", None), (5, "x y", "en", "s1"), (5, "x y", "en", "s1"), (None, prose(8, 50), "en", "s2")]
    docs = documents(spark, rows)
    got = M.mix(docs).taken.collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r[3], []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, M.target_sizes([sum(sizes[s]) for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    for s in order:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sum(sizes[s])} and abs(own[0].target - targets[s]) < 1e-6
        assert abs(sum(r.taken for r in own) - targets[s]) <= 64
    again = M.mix(docs.repartition(7)).taken.collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert M.mix(documents(spark, [])).taken.collect() == []


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    leak = prose(900, 60)
    line = prose(901, 12)
    base = prose(902, 200).split()
    near = list(base)
    near[50] = "changed"
    rows = [(i, prose(i, 120) + "\n" + prose(40 + i, 30), "aa", f"s{i % 3}") for i in range(30)]
    rows += [(100, prose(5, 20) + " " + leak, "aa", "s0"), (101, "12 34 56", "aa", "s0"), (102, line + "\n" + prose(6, 80), "aa", "s1"), (103, line + "\n" + prose(7, 80), "aa", "s1")]
    rows += [(104, " ".join(base), "aa", "s2"), (105, " ".join(near), "aa", "s2"), (106, rows[0][1], "aa", "s2"), (107, None, "aa", None)]
    docs = documents(spark, rows).drop("sw_x")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = set(range(30)) | {102, 103, 104}
    assert ids["language ID"] == {r[0] for r in rows} - {101, 107}
    assert 106 not in ids["line dedup"] and ids["source mixing"] - {105} == clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["source mixing"]
