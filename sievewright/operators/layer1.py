"""Layer 1: rules on the raw chunk, score on the normalised chunk, router, fail-closed floor.

Decisions are made on the chunk's own row.  Findings are a second table that joins nothing back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.scoring import Scorer
from sievewright.functions.text import normalize
from sievewright.operators.detection import FINDING_COLUMNS, RuleDetector
from sievewright.operators.router import Router, decision_log, evidence_of_rules, requires_layer2


@dataclass(frozen=True)
class Layer1:
    """``score`` maps a chunks table to a struct<score,error> column; None switches scoring off."""

    detector: RuleDetector = field(default_factory=RuleDetector)
    scorer: Scorer | Column | None = None
    router: Router = field(default_factory=Router)

    def _score(self) -> Column:
        if self.scorer is None:
            return F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("error"))
        if isinstance(self.scorer, Column):
            return self.scorer
        return self.scorer.score(normalize(F.col("chunk_text")))

    def decide(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with rule_ids, pg_raw, pg_score, pg_error, yara_score, risk_score, decision, route_reason, routed."""
        out = self.detector.with_hits(chunks).withColumn("sw_score", self._score())
        out = out.withColumn("pg_raw", F.coalesce(F.col("sw_score.score"), F.lit(0.0))).withColumn("pg_error", F.col("sw_score.error")).withColumn("pg_score", F.col("pg_raw"))
        out = out.withColumn("sw_evidence", evidence_of_rules(F.col("rule_ids"), self.detector.rules))
        return fail_closed(self.router.route(out, "sw_evidence")).withColumn("routed", requires_layer2(F.col("decision"))).drop("sw_evidence", "sw_score")

    def log(self, decided: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
        """The decision log of decided chunks."""
        return decision_log(decided.withColumn("sw_evidence", evidence_of_rules(F.col("rule_ids"), self.detector.rules)), self.router, "sw_evidence", keys)

    def findings(self, decided: DataFrame) -> DataFrame:
        """All findings of decided chunks: the rules', score errors of routed chunks, and synthetic ones.

        A finding needs validation if its chunk is routed, whatever its rule says.
        """
        keys = [c for c in decided.columns if c not in ("chunk_text", "start_char", "end_char", *FINDING_COLUMNS)]
        by_rule = self.detector.apply(decided)
        by_rule = by_rule.withColumn("requires_llm_validation", F.col("routed"))
        return by_rule.unionByName(score_error_findings(decided).select(*keys, *FINDING_COLUMNS)).unionByName(synthetic_findings(decided).select(*keys, *FINDING_COLUMNS))


def fail_closed(decided: DataFrame) -> DataFrame:
    """A chunk whose score failed isn't passed as safe."""
    failed = F.col("pg_error").isNotNull() & (F.col("decision") == "safe")
    return decided.withColumn("route_reason", F.when(failed, F.concat("route_reason", F.lit(" | score failed, held for review"))).otherwise(F.col("route_reason"))).withColumn("decision", F.when(failed, "review").otherwise(F.col("decision")))


def _whole_chunk(chunks: DataFrame, category: str, severity, reason: Column, rule_id: str, score: Column) -> DataFrame:
    return chunks.withColumns(
        {
            "span": F.lit(""), "category": F.lit(category), "severity": severity, "reason": reason, "rule_id": F.lit(rule_id),
            "requires_llm_validation": F.lit(True), "score": score, "metadata": F.create_map().cast("map<string,string>"),
        }
    )


def score_error_findings(decided: DataFrame) -> DataFrame:
    failed = decided.where("pg_error is not null and routed")
    return _whole_chunk(failed, "prompt_guard_error", F.lit("medium"), F.concat(F.lit("The classifier failed: "), F.col("pg_error")), "prompt_guard_error", F.lit(None).cast("double"))


def synthetic_findings(decided: DataFrame, strong: float = 0.75) -> DataFrame:
    """Routed chunks that only the score speaks against: their raw score as a finding."""
    alone = decided.where((F.col("pg_raw") > 0) & (F.size("rule_ids") == 0) & F.col("routed"))
    level = F.when(F.col("pg_raw") >= strong, "strong").otherwise("moderate")
    reason = F.format_string("Classifier score %s is a %s signal.", F.format_string("%.2f", F.col("pg_raw")), level)
    return _whole_chunk(alone, "prompt_guard_signal", F.when(F.col("pg_raw") >= strong, "high").otherwise("medium"), reason, "prompt_guard", F.col("pg_raw"))
