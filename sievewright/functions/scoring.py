"""Score functions: classifier outputs to malicious and benign scores, thresholds, and scorers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed label names.
MALICIOUS = ("malicious", "jailbreak", "injection", "label_1")
BENIGN = ("benign", "safe", "label_0")


def label_scores(outputs: Column) -> tuple[Column, Column]:
    """Largest malicious and benign score of an array of (label, score); 0 where there is none."""

    def best(labels: tuple[str, ...]) -> Column:
        kept = F.filter(outputs, lambda x: F.lower(F.trim(x["label"])).isin(*labels) & x["score"].isNotNull() & ~F.isnan(x["score"]))
        return F.coalesce(F.array_max(F.transform(kept, lambda x: x["score"])), F.lit(0.0))

    return best(MALICIOUS), best(BENIGN)


def flatten_outputs(raw: object) -> list[dict]:
    """A classifier's raw output (one label, a list, or a list of lists) as one list of labels."""
    if isinstance(raw, dict):
        return [raw]
    if isinstance(raw, (list, tuple)):
        return [y for x in raw for y in flatten_outputs(x)]
    return []


def malicious_score(raw: object) -> float:
    """Largest malicious score of a raw output; booleans and non-numbers are passed over."""
    scores = [x["score"] for x in flatten_outputs(raw) if str(x.get("label", "")).strip().lower() in MALICIOUS and isinstance(x.get("score"), (int, float)) and not isinstance(x.get("score"), bool)]
    return max((float(s) for s in scores if not math.isnan(s)), default=0.0)


#: Parts of a loading error's text, and what helps.
LOAD_HINTS = (
    (("401", "unauthorized"), "The model is gated: set HF_TOKEN to a token."),
    (("403", "forbidden"), "The token in HF_TOKEN is missing or may not read the model."),
    (("connection", "network"), "The model's host can't be reached from here."),
    (("not found", "does not exist"), "There is no model of that name any more."),
)


class ScorerLoadError(RuntimeError):
    """A model that can't be loaded, with what may help."""


def load_hint(error: BaseException) -> str:
    text = str(error).lower()
    return next((hint for signs, hint in LOAD_HINTS if any(x in text for x in signs)), "Set HF_TOKEN in the environment.")


@dataclass(frozen=True)
class Scorer:
    """A text classifier.  ``build`` makes the callable once in each Python worker.

    The callable takes normalised text and returns labels with scores.  A text on which it raises
    gets score 0 and the error's text.
    """

    build: Callable[[], Callable[[str], object]]
    malicious: float = 0.80
    uncertain: float = 0.50

    def __post_init__(self) -> None:
        if not 0 <= self.uncertain <= self.malicious <= 1:
            raise ValueError("thresholds must satisfy 0 <= uncertain <= malicious <= 1")

    def load(self) -> Callable[[str], object]:
        """The callable, built now; ScorerLoadError with a hint if that fails."""
        try:
            return self.build()
        except Exception as e:
            raise ScorerLoadError(f"{type(e).__name__}: {e} ({load_hint(e)})") from e

    def eager(self) -> Scorer:
        """This scorer, after one trial build on the driver: a model that can't be had fails before any job."""
        self.load()
        return self

    def score(self, text: Column) -> Column:
        """struct<score, error> of every text; blank texts score 0."""
        load, kept = self.load, {}

        @F.arrow_udf("struct<score:double,error:string>")
        def run(text: pa.Array) -> pa.Array:
            if "model" not in kept:
                kept["model"] = load()
            scores, errors = [], []
            for x in text.to_pylist():
                try:
                    scores.append(malicious_score(kept["model"](x)) if x and not x.isspace() else 0.0)
                    errors.append(None)
                except Exception as e:
                    scores.append(0.0)
                    errors.append(f"{type(e).__name__}: {e}")
            return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(errors, pa.string())], names=["score", "error"])

        return run(text)


def threshold_findings(chunks: DataFrame, score: str = "pg_score", malicious: float = 0.80, uncertain: float = 0.50) -> DataFrame:
    """Stand-alone findings of scored chunks: whole-chunk spans at or above a threshold."""
    found = chunks.where(F.col(score) >= uncertain)
    high = F.col(score) >= malicious
    keys = [c for c in chunks.columns if c not in ("chunk_text", "start_char", "end_char", score)]
    return found.select(
        *keys, F.col("chunk_text").alias("span"), F.when(high, "prompt_guard_malicious").otherwise("prompt_guard_uncertain").alias("category"), F.when(high, "high").otherwise("medium").alias("severity"),
        F.when(high, "The classifier scores the chunk as malicious.").otherwise("The classifier is uncertain about the chunk.").alias("reason"), "start_char", "end_char", F.lit("prompt_guard").alias("rule_id"), F.lit(True).alias("requires_llm_validation"), F.col(score).alias("score"), F.create_map(F.lit("detector"), F.lit("PromptGuardDetector")).alias("metadata"),
    )
