"""Document screening and corpus preparation on Spark.

The names below are loaded when they are first used, so Python workers that need one module don't
load them all.
"""

from __future__ import annotations

import importlib

_NAMES = {
    "sievewright.operators.chunking": ("chunk", "chunk_offsets", "check_sizes"),
    "sievewright.operators.rules": ("DEFAULT_RULES", "Rule", "RuleError", "byte_view", "load_rules", "read_rules", "validate"),
    "sievewright.operators.yara_text": ("parse_rules",),
    "sievewright.operators.detection": ("Detector", "FunctionDetector", "RuleDetector", "detect_many", "finalize", "hit_rules"),
    "sievewright.operators.router": ("Router", "categories", "combination", "decision_log", "evidence_of_findings", "evidence_of_rules", "requires_layer2", "yara_score"),
    "sievewright.operators.layer1": ("Layer1", "fail_closed", "score_error_findings", "synthetic_findings"),
    "sievewright.operators.classification": ("Classifier", "ClassifierError", "DependencyError", "GenerationConfig", "PromptError", "build_classifier", "check_template", "classifier_from_env", "provider_name", "render_prompt", "retryable"),
    "sievewright.operators.verdict": ("chunk_results", "document_verdicts", "floor_verdict", "normal_verdict"),
    "sievewright.operators.reports": ("check_expectations", "chunk_report", "classification_reports", "corpus_summary", "document_report", "finding_reports", "finding_sums", "passed"),
    "sievewright.functions.scoring": ("Scorer", "label_scores", "malicious_score", "threshold_findings"),
    "sievewright.functions.text": ("is_blank", "normalize", "normalize_ascii", "strip", "substitute"),
    "sievewright.functions.responses": ("ResponseError", "parse_response", "parse_responses"),
    "sievewright.sources.readers": ("ConversionError", "Converter", "Registry", "UnsupportedDocumentError", "default_registry", "discover", "from_table", "ingest", "read_documents", "read_manifest", "rich_converter", "text_converter"),
    "sievewright.sources.sinks": ("write_reports", "write_summary"),
    "sievewright.plans.pipeline": ("Analysis", "ScreeningPipeline", "build_pipeline"),
    "sievewright.streaming.screening": ("decide_stream", "screen_stream"),
}
_HOME = {name: module for module, names in _NAMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module 'sievewright' has no attribute {name!r}")
    return getattr(importlib.import_module(_HOME[name]), name)
