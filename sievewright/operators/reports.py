"""Chunk, document and corpus reports, and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_report(results: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """Scores rounded to four places, verdicts, and findings counted by detector."""
    counts = findings.groupBy(*keys).agg(F.count_if(F.col("metadata")["detector"] == "YaraDetector").alias("n_rule_findings"), F.count_if(F.col("rule_id") == "prompt_guard").alias("n_score_findings"))
    out = results.join(counts, list(keys), "left")
    return out.select(
        *keys, "start_char", "end_char", "decision", *[F.round(c, 4).alias(c) for c in ("risk_score", "pg_score", "yara_score")], "routed", "llm_verdict", "llm_error_type", "final_verdict",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rule_findings", "n_score_findings")],
    )


def finding_reports(findings: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_index", "source")) -> DataFrame:
    """Findings as they are reported: all fields, and the detector out of the metadata."""
    return findings.select(*keys, "span", "category", "severity", "reason", "start_char", "end_char", "rule_id", F.coalesce("requires_llm_validation", F.lit(False)).alias("requires_llm_validation"), "score", F.try_element_at("metadata", F.lit("detector")).alias("detector"), "metadata")


def classification_reports(outcomes: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """Answers of layer 2 as they are reported: the raw response by its length only; failed chunks have none."""
    c = F.col("outcome.classification")
    return outcomes.where(c.isNotNull()).select(*keys, *[c[x].alias(x) for x in ("verdict", "confidence", "reasons", "findings")], F.coalesce(F.length(c["raw_response"]), F.lit(0)).cast("long").alias("raw_response_chars"))


def finding_sums(results: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings of the rules and of the score for each document; zeros where it has none."""
    every = results.select(*keys).distinct()
    counts = findings.groupBy(*keys).agg(F.count_if(F.try_element_at("metadata", F.lit("detector")) == "YaraDetector").alias("n_rule_findings"), F.count_if(F.col("rule_id") == "prompt_guard").alias("n_score_findings"))
    return every.join(counts, list(keys), "left").select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rule_findings", "n_score_findings")])


def document_report(results: DataFrame, keys: tuple[str, ...] = ("doc_id",), findings: DataFrame | None = None) -> DataFrame:
    """Counts by decision and verdict, largest scores, chunks that layer 2 didn't visit, and whether to forward.

    With ``findings``, their sums (n_rule_findings, n_score_findings) as well.
    """
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{c.split('_')[0]}_{v}")
    out = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if("routed").alias("n_routed"),
        *[count("decision", v) for v in ("safe", "review", "hold")],
        *[count("final_verdict", v) for v in ("safe", "suspicious", "unsafe")],
        *[count("llm_verdict", v) for v in ("safe", "suspicious", "unsafe")],
        F.count_if("llm_failed").alias("n_llm_failed"),
        *[F.round(F.max(c), 4).alias(f"max_{c}") for c in ("risk_score", "pg_score", "yara_score")],
        F.array_sort(F.collect_list(F.when(~F.col("routed"), F.col("chunk_index")))).alias("not_visited"),
    )
    verdict = F.when(F.col("n_final_unsafe") > 0, "unsafe").when(F.col("n_final_suspicious") > 0, "suspicious").otherwise("safe")
    out = out.withColumn("verdict", verdict).withColumn("safe_to_forward", (verdict == "safe") & (F.col("n_final_safe") == F.col("n_chunks")))
    return out if findings is None else out.join(finding_sums(results, findings, keys), list(keys), "left")


def check_expectations(report: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``report`` with expected values and ``matches``: null where nothing is expected of a document."""
    out = report.join(manifest.select(*keys, "expected_verdict", "expected_safe_to_forward"), list(keys), "left")
    good = F.coalesce(F.col("verdict") == F.col("expected_verdict"), F.lit(True)) & F.coalesce(F.col("safe_to_forward") == F.col("expected_safe_to_forward"), F.lit(True))
    return out.withColumn("matches", F.when(F.col("expected_verdict").isNotNull() | F.col("expected_safe_to_forward").isNotNull(), good))


def corpus_summary(checked: DataFrame, failed: Column | None = None) -> DataFrame:
    """One row: totals, failures, blocked documents, and counts by verdict.

    A row without a verdict is a document that failed.  Rows need verdict, safe_to_forward, matches.
    """
    verdict = F.coalesce("verdict", F.lit("failed"))
    broken = F.col("verdict").isNull() if failed is None else failed
    return checked.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(broken).alias("n_runtime_failures"),
        F.count_if(~F.coalesce("matches", F.lit(True))).alias("n_mismatches"),
        F.count_if(broken | ~F.coalesce("matches", F.lit(True))).alias("n_failed"),
        F.count_if(~F.coalesce("safe_to_forward", F.lit(False))).alias("n_blocked"),
        *[F.count_if(verdict == v).alias(f"n_{v}") for v in ("safe", "suspicious", "unsafe")],
    )


def passed(summary_row) -> bool:
    return summary_row["n_failed"] == 0
