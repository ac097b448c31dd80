"""Schemas of the screening tables.

documents -> chunks -> findings / decisions -> outcomes -> chunk_results -> document_results.
Offsets are code points, absolute in the document.
"""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.MapType(T.StringType(), T.StringType())

SEGMENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("metadata", METADATA)])

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("converter", T.StringType()),
        T.StructField("extension", T.StringType()),
        T.StructField("normalized_format", T.StringType()),
        T.StructField("segments", T.ArrayType(SEGMENT)),
        T.StructField("error", T.StringType()),
    ]
)

CHUNK_FIELDS = "chunk_index int, start_char int, end_char int, chunk_text string"

FINDING = T.StructType(
    [
        T.StructField("span", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("requires_llm_validation", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("metadata", METADATA),
    ]
)

CLASSIFIED_FINDING = "struct<span:string,attack_type:string,severity:string,reason:string,start_char:int,end_char:int>"
CLASSIFICATION = f"struct<verdict:string,confidence:double,reasons:array<string>,findings:array<{CLASSIFIED_FINDING}>,raw_response:string>"
OUTCOME = f"struct<classification:{CLASSIFICATION},error:string,error_type:string>"
SCORE = "struct<score:double,error:string>"

#: Fixed vocabularies.
DECISIONS = ("safe", "review", "hold")
VERDICTS = ("safe", "suspicious", "unsafe")
SEVERITIES = ("low", "medium", "high", "critical")
SEVERITY_WEIGHTS = {"low": 5.0, "medium": 10.0, "high": 25.0, "critical": 40.0}
