"""Rule findings with spans and offsets, detectors and their union, and deduplication.

Everything here is built from Catalyst expressions.  A chunk is first tested against the rules'
conditions; only for rules that hit are spans extracted, at every start offset (overlapping matches
included), by look-ahead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.text import is_blank
from sievewright.operators.rules import DEFAULT_RULES, Rule, byte_view, condition_column, read_rules, validate

_MARK = "\uE000"
FINDING_COLUMNS = ("span", "category", "severity", "reason", "start_char", "end_char", "rule_id", "requires_llm_validation", "score", "metadata")
KEY = ("rule_id", "source", "start_char", "end_char")


class Detector(Protocol):
    """Chunks in, findings out: the chunks' key columns and FINDING_COLUMNS."""

    name: str

    def apply(self, chunks: DataFrame) -> DataFrame: ...


def hit_rules(view: Column, lower: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Ids of the rules whose condition holds, in the pack's order."""
    return F.array_compact(F.array(*[F.when(condition_column(r, view, lower), F.lit(r.rule_id)) for r in rules]))


def _strings_of(rules: Sequence[Rule]) -> Column:
    numbered = enumerate((r, name) for r in rules for name in r.strings)
    return F.array(
        *[
            F.struct(F.lit(i).alias("at"), F.lit(r.rule_id).alias("rule_id"), F.lit(name).alias("name"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.reason).alias("reason"), F.lit(float(r.weight)).alias("weight"), F.lit(r.route_hint).alias("route_hint"), F.lit(r.requires_llm_validation).alias("llm"))
            for i, (r, name) in numbered
        ]
    )


def _by_string(rules: Sequence[Rule], of: Callable[[Column], Column]) -> Column:
    """``of(pattern)`` of the row's string: a branch a string, so that every pattern is compiled once."""
    at, out = F.col("sw_s.at"), F
    for i, pattern in enumerate(f"(?=({r.pattern(name)}))" for r in rules for name in r.strings):
        out = out.when(at == i, of(F.lit(pattern)))
    return out


class RuleDetector:
    """Findings of a rule pack.  A rule that hits gives a finding for each match of each of its strings."""

    name = "YaraDetector"

    def __init__(self, rules: Sequence[Rule] | None = None):
        self.rules = validate(DEFAULT_RULES if rules is None else rules)

    @classmethod
    def from_file(cls, path: str) -> RuleDetector:
        return cls(read_rules(path))

    def with_hits(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with rule_ids; blank chunks have none.

        The rules are evaluated behind a generator of one row: filters on what is derived from
        rule_ids stay above it, so no filter or projection evaluates the patterns a second time.
        """
        viewed = chunks.withColumn("sw_view", byte_view(F.coalesce("chunk_text", F.lit("")))).withColumn("sw_lower", F.lower("sw_view"))
        hits = F.when(is_blank(F.col("chunk_text")), F.array().cast("array<string>")).otherwise(hit_rules(F.col("sw_view"), F.col("sw_lower"), self.rules))
        return viewed.select(*[c for c in chunks.columns if c != "rule_ids"], F.explode_outer(F.array(hits)).alias("rule_ids"))

    def apply(self, chunks: DataFrame) -> DataFrame:
        given = chunks if "rule_ids" in chunks.columns else self.with_hits(chunks)
        hit = given.withColumn("sw_rule", F.explode_outer("rule_ids")).where("sw_rule is not null")
        one = hit.withColumn("sw_s", F.explode_outer(F.filter(_strings_of(self.rules), lambda s: s["rule_id"] == F.col("sw_rule")))).withColumn("sw_view", byte_view(F.col("chunk_text")))
        one = one.withColumn("sw_found", _by_string(self.rules, lambda p: F.regexp_extract_all("sw_view", p, F.lit(1)))).where(F.size("sw_found") > 0)
        # an empty match at every start, marked: the lengths between the marks are the offsets
        one = one.withColumn("sw_parts", F.split(_by_string(self.rules, lambda p: F.regexp_replace(F.col("sw_view"), p, F.lit(_MARK))), _MARK, -1))
        before = F.expr("transform(sequence(1, size(sw_found)), i -> aggregate(slice(sw_parts, 1, i), 0, (n, x) -> n + length(x)))")
        at = one.withColumn("sw_m", F.explode(F.arrays_zip(before.alias("at"), F.col("sw_found").alias("bytes")))).drop("sw_parts", "sw_found", "sw_view")
        # bytes back to characters
        start = F.expr("length(decode(substring(encode(chunk_text, 'UTF-8'), 1, sw_m.at), 'UTF-8'))")
        size = F.expr("length(decode(substring(encode(chunk_text, 'UTF-8'), sw_m.at + 1, length(sw_m.bytes)), 'UTF-8'))")
        at = at.withColumn("sw_at", start).withColumn("sw_n", size).withColumn("span", F.expr("substring(chunk_text, sw_at + 1, sw_n)")).where(~is_blank(F.col("span")))
        weight, s = F.col("sw_s.weight"), F.col("sw_s")
        keys = [c for c in chunks.columns if c not in ("chunk_text", "start_char", "end_char", *FINDING_COLUMNS)]
        return at.select(
            *keys, "span", s["category"].alias("category"), s["severity"].alias("severity"), s["reason"].alias("reason"), (F.col("start_char") + F.col("sw_at")).alias("start_char"), (F.col("start_char") + F.col("sw_at") + F.col("sw_n")).alias("end_char"),
            s["rule_id"].alias("rule_id"), s["llm"].alias("requires_llm_validation"), F.when(weight > 0, F.least(F.lit(1.0), weight / 100.0)).alias("score"),
            F.create_map(F.lit("detector"), F.lit(self.name), F.lit("yara_rule"), s["rule_id"], F.lit("yara_weight"), weight.cast("string"), F.lit("route_hint"), s["route_hint"]).alias("metadata"),
        )


class FunctionDetector:
    """A detector from a function of one chunk text, run in Arrow batches; its failures become findings.

    ``function(text)`` returns (start, end, category, severity, reason, rule_id, score) tuples with
    offsets in the chunk.
    """

    def __init__(self, name: str, function: Callable[[str], Iterable[tuple]]):
        self.name, self.function = name, function

    def apply(self, chunks: DataFrame) -> DataFrame:
        name, function = self.name, self.function
        kind = "array<struct<start:int,end:int,category:string,severity:string,reason:string,rule_id:string,score:double,failed:boolean>>"

        @F.arrow_udf(kind)
        def run(text: pa.Array) -> pa.Array:
            rows = []
            for x in text.to_pylist():
                try:
                    rows.append([(*f, False) for f in function(x)] if x and not x.isspace() else [])
                except Exception as e:  # a failing detector is a finding, not a failed job
                    rows.append([(0, len(x), "detector_error", "medium", f"{name} failed: {type(e).__name__}: {e}", f"{name.lower()}_error", None, True)])
            names = ("start", "end", "category", "severity", "reason", "rule_id", "score", "failed")
            types = [pa.int32(), pa.int32(), *[pa.string()] * 4, pa.float64(), pa.bool_()]
            return pa.array([[dict(zip(names, f, strict=True)) for f in row] for row in rows], pa.list_(pa.struct(list(zip(names, types, strict=True)))))

        keys = [c for c in chunks.columns if c not in ("chunk_text", "start_char", "end_char", *FINDING_COLUMNS)]
        at = chunks.withColumn("sw_f", F.explode(run(F.col("chunk_text"))))
        f = F.col("sw_f")
        return at.select(
            *keys, F.expr("substring(chunk_text, sw_f.start + 1, sw_f.end - sw_f.start)").alias("span"), f["category"].alias("category"), f["severity"].alias("severity"), f["reason"].alias("reason"),
            (F.col("start_char") + f["start"]).alias("start_char"), (F.col("start_char") + f["end"]).alias("end_char"), f["rule_id"].alias("rule_id"), f["failed"].alias("requires_llm_validation"), f["score"].alias("score"),
            F.create_map(F.lit("detector"), F.lit(name)).alias("metadata"),
        )


def detect_many(chunks: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """Findings of all detectors over all chunks, deduplicated across overlapping chunks and sorted."""
    if not detectors:
        raise ValueError("at least one detector is needed")
    found = detectors[0].apply(chunks)
    for d in detectors[1:]:
        found = found.unionByName(d.apply(chunks))
    return finalize(found)


def finalize(findings: DataFrame) -> DataFrame:
    """One finding for each (rule, source, start, end): the first chunk's; sorted by start, end, rule.

    The sort is a range partitioning by source first, so it scales with the number of documents.
    """
    first = Window.partitionBy(*KEY).orderBy("chunk_index", "span")
    return findings.withColumn("sw_n", F.row_number().over(first)).where("sw_n = 1").drop("sw_n").orderBy("source", "start_char", "end_char", "rule_id")
