"""Small documents with the cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, sw_x string, node string"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); the rest are extra columns with clashing names."""
    full = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or ""), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    names = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(words))


def odd_rows():
    """Nulls, empty and white-space texts, a null id, ties and repeated rows, and one long text."""
    long = prose(99, 20000, 5000)
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, prose(1, 120)), (5, prose(1, 120)), (6, "É ñ 日本  x"), (7, long), (8, "a " * 300), (9, "a " * 300)]
