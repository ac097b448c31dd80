import re
from itertools import combinations

import numpy as np

from sievewright.llm.linkage import components, shared_nodes
from sievewright.llm.minhash_near_dedup import drop_near_duplicates, near_duplicates, paths, recall
from tests.llm.data import documents, odd_rows, prose


def brute(rows, size, percent=80):
    last = (1 << 63) - 1
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    ids = [last if d is None else d for d, _ in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            head[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((d, len(s), None if least[find(i)] == last else least[find(i)], ids[i] == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_rows():
    rows = odd_rows()
    for g in range(6):
        base = prose(100 + g, 60 + 40 * g).split()
        for c in range(12):
            w = list(base)
            for e in range(c):
                w[(e * 17 + c * 5) % len(w)] = f"new{g}{c}{e}"
            rows.append((100 + g * 20 + c, " ".join(w).upper() if c == 3 else " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = near_rows()
    for size in (2, 5):
        got = near_duplicates(documents(spark, rows), size).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(rows, size)


def test_large_group_is_cut_into_blocks(spark):
    base = prose(7, 200).split()
    rows = []
    for i in range(700):  # a chain: each copy is close to its neighbours only
        w = list(base)
        for e in range(i // 4):
            w[(e * 3) % 200] = f"z{e}"
        w[199] = f"own{i}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(documents(spark, rows), 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(rows, 2)


def test_drop_keeps_columns_and_one_of_each_group(spark):
    docs = documents(spark, near_rows())
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    wanted = sorted([r[0] for r in brute(near_rows(), 5) if r[3]], key=repr)
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == wanted


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).collect() == []


def test_recall_of_paths():
    assert recall(20, 4, 0.8) > 1 - 1e-6
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(200):
        x = rng.integers(0, 1 << 32, (2, 64), dtype=np.uint32)
        x[1, : int(64 * 0.8)] = x[0, : int(64 * 0.8)]
        row, node = paths(x, 20, 4)
        met += bool(set(node[row == 0].tolist()) & set(node[row == 1].tolist()))
    assert met == 200


def test_shared_nodes_and_components(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 300), rng.integers(0, 25, 300), strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.node, r.member, r.first) for r in shared_nodes(spark.createDataFrame(rows, "node long, member long")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for n, m in rows:
        groups.setdefault(n, set()).add(m)
    assert got == {(n, m, min(s)) for n, s in groups.items() if len(s) > 1 for m in s}
    chain = [(i, i + 1) for i in range(1, 70)] + [(200, 100), (150, 200)]
    found = {r.member: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 71)} | {100: 100, 150: 100, 200: 100}
