import re

from sievewright.llm.substring_dedup import longest_levels, substring_dedup
from tests.llm.data import documents, odd_rows, prose


def brute(rows, size):
    last = (1 << 63) - 1
    docs = [(last if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in docs:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), (k, w) in zip(rows, docs, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < k:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), kept))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    passage = prose(5, 130)
    rows = odd_rows() + [(10 + i, f"{prose(20 + i, 40 + i)} {passage if i % 3 else passage[: 300 + i]}\n{prose(50 + i, 30)}") for i in range(30)]
    for size in (50, 6):
        assert rows_of(substring_dedup(documents(spark, rows), size)) == brute(rows, size)


def test_overlapping_shifted_repeats(spark):
    base = prose(3, 400).split()
    rows = [(i, " ".join(base[i * 7 : i * 7 + 90] + ["x" * i] + base[i * 3 : i * 3 + 60])) for i in range(40)]
    assert rows_of(substring_dedup(documents(spark, rows), 50)) == brute(rows, 50)


def test_empty_table(spark):
    assert substring_dedup(documents(spark, [])).collect() == []


def test_longest_levels(spark):
    a, b = prose(1, 230), prose(2, 90)
    rows = [(1, a), (2, "x " + a), (3, b), (4, b + " y"), (5, prose(3, 500, 5000))]
    assert {r.doc_id: r.longest_level for r in longest_levels(documents(spark, rows)).collect()} == {1: 200, 2: 200, 3: 50, 4: 50, 5: 0}
