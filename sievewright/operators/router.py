"""The router: rule evidence and classifier score to a decision for each chunk.

Evidence is an array of (rule_id, category, severity, weight, route_hint) on the chunk's row, so
routing needs no shuffle: sums over categories and set tests are array expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.rules import Rule
from sievewright.schemas import SEVERITY_WEIGHTS

EVIDENCE = "array<struct<rule_id:string,category:string,severity:string,weight:double,route_hint:string>>"
#: Fixed combinations of categories that hold a chunk whatever the scores are.
HOLD_TOGETHER = (("tool_hijack", "instruction_override"), ("secret_exfiltration", "instruction_override"), ("secret_exfiltration", "tool_hijack"))
_UNKNOWN_WEIGHT, _MENTION, _MENTION_SCORE = 10.0, "topic_mention", 0.10


@dataclass(frozen=True)
class Router:
    """Thresholds and weights; validated like the decisions they stand for."""

    yara_review: float = 15.0
    yara_hold: float = 40.0
    pg_review: float = 0.40
    pg_hold: float = 0.75
    yara_weight: float = 0.50
    pg_weight: float = 0.50
    risk_review: float = 20.0
    risk_floor: float = 10.0

    def __post_init__(self) -> None:
        if not (0 <= self.yara_weight <= 1 and 0 <= self.pg_weight <= 1):
            raise ValueError("weights must lie between 0 and 1")
        if self.yara_weight == 0 and self.pg_weight == 0:
            raise ValueError("one weight must not be zero")
        if not 0 <= self.yara_review <= self.yara_hold <= 100:
            raise ValueError("rule thresholds must satisfy 0 <= review <= hold <= 100")
        if not 0 <= self.pg_review <= self.pg_hold <= 1:
            raise ValueError("score thresholds must satisfy 0 <= review <= hold <= 1")

    def route(self, chunks: DataFrame, evidence: str = "evidence", pg: str = "pg_score") -> DataFrame:
        """``chunks`` with decision, risk_score, pg_score (clamped), yara_score and route_reason."""
        e, wy, wp = F.col(evidence), self.yara_weight, self.pg_weight
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(pg)))
        out = chunks.withColumn("sw_pg", score).withColumn("yara_score", yara_score(e)).withColumn("sw_categories", categories(e))
        out = out.withColumn("risk_score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("yara_score") * wy + F.col("sw_pg") * 100.0 * wp)))
        cats, y, p, risk = F.col("sw_categories"), F.col("yara_score"), F.col("sw_pg"), F.col("risk_score")
        combined = combination(cats, p)
        strong_rules, some_rules = F.lit(wy > 0) & (y >= self.yara_hold), F.lit(wy > 0) & (y >= self.yara_review)
        strong_score, some_score = F.lit(wp > 0) & (p >= self.pg_hold), F.lit(wp > 0) & (p >= self.pg_review)
        hinted = F.exists(e, lambda x: x["route_hint"].isin("hold", "review"))
        strong, moderate = strong_rules | strong_score, some_rules | some_score | (risk >= self.risk_review) | hinted
        ladder = F.when(strong, "hold").when(moderate | (risk >= self.risk_floor), "review").otherwise("safe")
        decision = F.coalesce(combined, ladder)
        # which signals a reason names: the combination names none, a review names the moderate ones
        rules_named = combined.isNull() & F.when(strong, strong_rules).otherwise(moderate & some_rules)
        score_named = combined.isNull() & F.when(strong, strong_score).otherwise(moderate & some_score)
        weak = combined.isNull() & ~strong & ~moderate & (risk < self.risk_floor)
        numbers = F.format_string("YARA=%s, PG=%s", F.format_string("%.0f", y), F.format_string("%.2f", p))
        ids = F.array_sort(F.array_distinct(F.transform(e, lambda x: x["rule_id"])))
        reason = F.when(weak, F.concat(numbers, F.lit(" — both signals weak."))).otherwise(
            F.concat_ws(" | ", numbers, F.when(F.size(e) > 0, F.concat(F.lit("YARA hits: "), F.concat_ws(", ", ids))), F.when(rules_named, "YARA strong"), F.when(score_named, "PG strong"))
        )
        out = out.withColumn("decision", decision).withColumn("route_reason", reason).drop("sw_categories")
        return out.drop(pg).withColumnRenamed("sw_pg", pg)


def decision_log(routed: DataFrame, router: Router, evidence: str = "evidence", keys: Sequence[str] = ("doc_id", "chunk_index")) -> DataFrame:
    """What stands behind every decision, as one row for a log: rounded scores, categories, hints and signals.

    ``level`` is that of a log line: debug for safe chunks, info for others.
    """
    e, y, p = F.col(evidence), F.col("yara_score"), F.col("pg_score")
    signal = lambda weight, value, least, name: (F.lit(weight > 0) & (value >= least)).alias(name)
    hinted = lambda hint: F.exists(e, lambda x: x["route_hint"] == hint).alias(f"has_{hint}_hint")
    return routed.select(
        *keys, "decision", "route_reason", F.round("risk_score", 2).alias("risk_score"), F.round(p, 4).alias("pg_score"), F.round(y, 2).alias("yara_score"),
        F.size(e).cast("long").alias("n_evidence"), categories(e).alias("categories"), hinted("hold"), hinted("review"),
        signal(router.yara_weight, y, router.yara_hold, "yara_strong"), signal(router.yara_weight, y, router.yara_review, "yara_moderate"),
        signal(router.pg_weight, p, router.pg_hold, "pg_strong"), signal(router.pg_weight, p, router.pg_review, "pg_moderate"), F.when(F.col("decision") == "safe", "debug").otherwise("info").alias("level"),
    )


def evidence_of_rules(rule_ids: Column, rules: Sequence[Rule]) -> Column:
    """Evidence of the rules that hit, one element a rule (repeats don't change a score)."""
    every = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(float(r.weight)).alias("weight"), F.lit(r.route_hint).alias("route_hint")) for r in rules])
    return F.filter(every, lambda s: F.array_contains(rule_ids, s["rule_id"]))


def evidence_of_findings(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings gathered into evidence, one row for each chunk key (distinct rules: bounded by the pack)."""
    weight = F.coalesce(F.expr("try_cast(metadata['yara_weight'] as double)"), F.lit(0.0))
    one = F.struct("rule_id", "category", "severity", weight.alias("weight"), F.coalesce(F.col("metadata")["route_hint"], F.lit("evidence")).alias("route_hint"))
    return findings.groupBy(*keys).agg(F.array_sort(F.collect_set(one)).alias("evidence"))


def categories(evidence: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(evidence, lambda x: x["category"])))


def weight_of(x: Column) -> Column:
    """An element's weight, or its severity's where it has none."""
    by_severity = F.lit(_UNKNOWN_WEIGHT)
    for name, w in SEVERITY_WEIGHTS.items():
        by_severity = F.when(F.lower(F.trim(x["severity"])) == name, w).otherwise(by_severity)
    return F.when(x["weight"] > 0, x["weight"]).otherwise(by_severity)


def yara_score(evidence: Column) -> Column:
    """Largest weight of each category, summed, at most 100."""
    best = F.transform(F.array_distinct(F.transform(evidence, lambda x: x["category"])), lambda c: F.array_max(F.transform(F.filter(evidence, lambda x: x["category"] == c), weight_of)))
    return F.least(F.lit(100.0), F.aggregate(best, F.lit(0.0), lambda s, w: s + w))


def combination(categories: Column, pg: Column) -> Column:
    """Decision by category combination, or null; the first that applies wins."""
    out = F.when(F.array_contains(categories, HOLD_TOGETHER[0][0]) & F.array_contains(categories, HOLD_TOGETHER[0][1]), "hold")
    for a, b in HOLD_TOGETHER[1:]:
        out = out.when(F.array_contains(categories, a) & F.array_contains(categories, b), "hold")
    return out.when((F.size(categories) == 1) & F.array_contains(categories, _MENTION) & (pg < _MENTION_SCORE), "safe")


def requires_layer2(decision: Column) -> Column:
    return decision.isin("review", "hold")
