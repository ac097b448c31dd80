"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps one bit per language in every slot, so a single probe of three slots
and two ANDs returns *all* languages that hold an n-gram.  A document's n-grams are probed at once;
the set bits are counted per language, each count is corrected for the filter's false positives of
that language (its fill to the power of the probes), and the language with the largest corrected
share of n-grams is the prediction.

Training reads a bounded sample: about ``rows_per_language`` labelled rows of each language, chosen
by a hash of the id, and keeps at most ``grams_per_language`` n-grams of each.  Prediction is a
row-wise Arrow function without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm import kernels as K
from sievewright.llm.durable import bounded_batches

UNDETERMINED = "und"
PROBES = 3
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class LanguageFilter:
    """Slots of language bitmasks and, for each language, its rate of false positives."""

    languages: tuple[str, ...]
    slots: np.ndarray  # uint64, (words of 64 languages, slots)
    false_rate: np.ndarray


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed letter trigrams of lower-cased texts, the text of each, and whether a text has letters.

    Runs of other characters count as one space; every text starts and ends with one.
    """
    joined = "\n" + "\n".join(x.lower().replace("\n", " ") for x in texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[cp]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    text_of, plain = (np.cumsum(cp == 10) - 1)[keep], np.where(letter, cp, 32)[keep].astype(K.U)
    has = np.zeros(len(texts), bool)
    has[text_of[plain != 32]] = True
    grams = (plain[:-2] << K.U(42)) | (plain[1:-1] << K.U(21)) | plain[2:]
    inner = plain[1:-1] != 32
    return grams[inner], text_of[1:-1][inner], has


def _slots_of(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    h = K.mix(grams)
    mask = K.U((1 << bits) - 1)
    return [((h >> K.U(i * 20)) & mask).astype(np.int64) for i in range(PROBES)]


def fit(docs: DataFrame, label: str = "lang", rows_per_language: int = 2000, grams_per_language: int = 20000, slot_bits: int = 18) -> LanguageFilter:
    """Learn from rows with a label and a text; an empty table gives a filter without languages.

    An n-gram belongs to a language if it was seen there twice at least and its share there is a
    quarter or more of its largest share in any language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("sw_id"), F.col(label).alias("sw_lang"), "text").where("sw_lang is not null and text is not null")
    counts = {r["sw_lang"]: r["n"] for r in rows.groupBy("sw_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageFilter((), np.zeros((1, 1 << slot_bits), K.U), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / counts[k]))])
    sample = rows.where(F.pmod(F.xxhash64("sw_id", F.lit("sample")), F.lit(1 << 20)) < share[F.col("sw_lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang = batch.column("text"), batch.column("sw_lang").to_pylist()
            for at, to in K.slices(text):
                grams, of, _ = trigrams(text.slice(at, to - at).to_pylist())
                names = sorted(set(lang[at:to]))
                code = np.array([names.index(x) for x in lang[at:to]])[of] if len(of) else of
                for i, name in enumerate(names):
                    keys, n = np.unique(grams[code == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(K.signed(keys)), pa.array(n)], names=["lang", "gram", "n"])

    grams = sample.select("sw_lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = F.sum("n").over(_by("lang"))
    shares = grams.withColumn("share", F.col("n") / totals)
    shares = shares.withColumn("top", F.max("share").over(_by("gram"))).where("n >= 2 and share * 4 >= top")
    shares = shares.withColumn("rank", F.row_number().over(_by("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= grams_per_language)
    slots = np.zeros((-(-len(languages) // 64), 1 << slot_bits), K.U)
    false_rate = np.zeros(len(languages))
    table = shares.select("lang", "gram").toPandas()
    for i, name in enumerate(languages):
        keys = table.gram[table.lang == name].to_numpy(np.int64).view(K.U)
        own = np.zeros(1 << slot_bits, bool)
        for s in _slots_of(keys, slot_bits):
            own[s] = True
        slots[i // 64][own] |= K.U(1) << K.U(i % 64)
        false_rate[i] = own.mean() ** PROBES
    return LanguageFilter(languages, slots, false_rate)


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def shares(model: LanguageFilter, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Corrected share of each text's n-grams that each language holds; whether it has letters."""
    bits = int(model.slots.shape[1]).bit_length() - 1
    grams, of, has = trigrams(texts)
    n = np.bincount(of, minlength=len(texts)).astype(float)
    probes = _slots_of(grams, bits)
    out = np.zeros((len(texts), len(model.languages)))
    for word in range(model.slots.shape[0]):
        table = model.slots[word]
        if len(model.languages) <= 8:
            table = table.astype(np.uint8)
        masks = table[probes[0]]
        for p in probes[1:]:
            masks &= table[p]
        for i in range(word * 64, min(len(model.languages), word * 64 + 64)):
            hits = np.bincount(of[(masks >> masks.dtype.type(i % 64)) & masks.dtype.type(1) == 1], minlength=len(texts))
            f = model.false_rate[i]
            out[:, i] = np.clip((hits - n * f) / np.maximum(n * (1 - f), 1e-9), 0, 1)
    return out, has


def predict(model: LanguageFilter, text: Column, spark) -> Column:
    """Struct of lang and score (the winning language's corrected share of the n-grams, 0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned.  Ties go
    to the language that sorts first.  Whole texts are read.
    """
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang string, score double>")
    def run(text: pa.Array) -> pa.Array:
        model, names, scores = shipped.value, [], []
        text = text.fill_null("")
        for at, to in K.slices(text):
            if not model.languages:
                names += [UNDETERMINED] * (to - at)
                scores += [0.0] * (to - at)
                continue
            got, has = shares(model, text.slice(at, to - at).to_pylist())
            best = got.argmax(axis=1)
            names += [model.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)]
            scores += np.where(has, got.max(axis=1), 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return run(text)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred and score of every row; repeated rows get the same answer each."""
    spark = docs.sparkSession
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), predict(model, F.col("text"), spark).alias("sw_p")).select(
        "doc_id", F.col("sw_p.lang").alias("lang_pred"), F.col("sw_p.score").alias("score")
    )
