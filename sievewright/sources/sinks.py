"""Report sinks."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import truncate


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports of any number of documents as JSON lines, written by the executors."""
    reports.write.mode("overwrite").json(path)


def write_summary(summary: dict, path: str) -> None:
    """One pretty JSON object with sorted keys, on the driver."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(summary, indent=2, sort_keys=True, default=str) + "\n")


def utc_now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds").replace("+00:00", "Z")


def console_lines(reports: DataFrame, limit: int = 1000) -> list[str]:
    """A status line for each of the first documents, for a terminal."""
    line = F.concat_ws(" ", F.upper(F.coalesce("verdict", F.lit("failed"))), F.col("doc_id").cast("string"), F.concat(F.col("n_routed").cast("string"), F.lit("/"), F.col("n_chunks").cast("string"), F.lit(" routed")))
    return [r[0] for r in reports.orderBy("doc_id").limit(limit).select(truncate(line)).collect()]


def load_env_file(path: str) -> dict[str, str]:
    """KEY=value lines of a file; quotes are stripped, comments and blank lines passed over."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, sign, value = line.strip().partition("=")
            if sign and key and not key.startswith("#"):
                out[key.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return out
