"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes the documents that its predecessor kept, with all their columns, and returns the
documents that it keeps; the last one returns how much of each is taken.  Very long texts are worked on
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import decontamination, language_id, line_dedup, minhash_near_dedup, mixing
from sievewright.llm.durable import written

#: Share of a document's n-grams that its language must hold; below it, the text is in no known one.
LEAST_LANGUAGE_SCORE = 0.3


def _free(name: str, docs: DataFrame) -> str:
    """``name``, lengthened until no column of ``docs`` has it in any letter case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; those without letters or in none go.

    Null, empty and letterless texts go.  Rows with null ids, repeated rows and ties are judged each by
    their text; all columns stay as they are whatever their names; an empty table gives an empty one.
    """
    model, judgement = language_id.fit(docs), _free("sw_lang", docs)
    judged = docs.withColumn(judgement, language_id.predict(model, F.col("text"), spark))
    return judged.where((F.col(f"{judgement}.lang") != language_id.UNDETERMINED) & (F.col(f"{judgement}.score") >= LEAST_LANGUAGE_SCORE)).select(*_own(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those that have no text left go.

    Null and empty texts stay.  Null ids come last; rows with equal id and text lose the same lines.
    n_chars, if there, is counted again; all other columns stay as they are whatever their names.  An
    empty table gives an empty one.
    """
    removed = _free("n_removed", docs)
    out = line_dedup.dedup_lines(docs, by_edits=True, exact_from=1, counts=(_free("n_lines", docs), removed))
    out = out.where(F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)) | (F.col(removed) == 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    The one with the least id (null last) and then text hash stays, with all rows that repeat both.
    Null and empty texts have no copies.  All columns stay as they are; an empty table gives an empty one.
    """
    return minhash_near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none.  Rows are judged each; all columns stay as they are whatever their
    names; an empty table gives an empty one, an empty benchmark removes nothing.
    """
    leaks = _free("sw_leaks", docs)
    judged = decontamination.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), leaks)
    return judged.where(F.size(leaks) == 0).select(*_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, with its source's size and target.

    Null texts have size 0, a null source is one of its own; null ids and repeated rows are documents
    of their own.  An empty table gives an empty one.
    """
    return mixing.mix(docs).taken


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


#: The stages' models and pseudorandom draws can't be expressed in SQL.
ORACLE_SQL = None
