"""Chunk and document verdicts.

Layer 2 can raise a routed chunk to unsafe but never lower it below suspicious; a routed chunk
without an answer is suspicious.  A document is as bad as its worst chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.schemas import VERDICTS


def normal_verdict(verdict: Column) -> Column:
    """Trimmed and lower-cased; unknown ones are suspicious."""
    v = F.lower(F.trim(verdict))
    return F.when(v.isin(*VERDICTS), v).otherwise("suspicious")


def floor_verdict(routed: Column, verdict: Column) -> Column:
    """The answer of layer 2, not below the floor of a routed chunk."""
    v = normal_verdict(verdict)
    return F.when(routed & (v == "safe"), "suspicious").otherwise(v)


def chunk_results(decided: DataFrame, outcomes: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """``decided`` with the outcome's fields and final_verdict.

    outcomes: the keys and an ``outcome`` struct of routed chunks.  Only they are joined; the rest
    passes by.
    """
    if outcomes is None:
        joined = decided.withColumn("outcome", F.lit(None).cast("struct<classification:struct<verdict:string,confidence:double,reasons:array<string>>,error:string,error_type:string>"))
    else:
        joined = decided.join(outcomes.select(*keys, "outcome"), list(keys), "left")
    answered = F.col("outcome.classification").isNotNull()
    verdict = F.when(answered, floor_verdict(F.col("routed"), F.col("outcome.classification.verdict"))).when(F.col("routed"), "suspicious").otherwise("safe")
    return joined.withColumns(
        {
            "llm_verdict": F.when(answered, normal_verdict(F.col("outcome.classification.verdict"))),
            "llm_error": F.col("outcome.error"),
            "llm_error_type": F.col("outcome.error_type"),
            "llm_failed": F.col("routed") & ~answered,
            "final_verdict": verdict,
        }
    ).drop("outcome")


def _indices(condition: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(condition, F.col("chunk_index"))))


def _listed(indices: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(indices, lambda i: i.cast("string")), ", "), F.lit("]"))


def document_verdicts(results: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, verdict, index lists and reasons; a document's chunk numbers are all that is gathered."""
    v = F.col("final_verdict")
    out = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if("routed").alias("n_routed"),
        _indices(v == "unsafe").alias("unsafe_chunks"),
        _indices(v == "suspicious").alias("suspicious_chunks"),
        _indices(F.col("llm_failed")).alias("failed_chunks"),
    )
    verdict = F.when(F.size("unsafe_chunks") > 0, "unsafe").when(F.size("suspicious_chunks") > 0, "suspicious").otherwise("safe")
    named = F.array_compact(
        F.array(
            F.when(F.size("unsafe_chunks") > 0, F.concat(F.lit("Unsafe chunks: "), _listed(F.col("unsafe_chunks")))),
            F.when(F.size("suspicious_chunks") > 0, F.concat(F.lit("Suspicious chunks: "), _listed(F.col("suspicious_chunks")))),
            F.when(F.size("failed_chunks") > 0, F.concat(F.lit("Layer 2 failed for chunks: "), _listed(F.col("failed_chunks")))),
        )
    )
    return out.withColumn("verdict", verdict).withColumn("reasons", F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("No suspicious or unsafe chunks detected."))))
