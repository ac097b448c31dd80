"""The declarative rule pack: data, validation, and compilation to Catalyst expressions.

Rules match UTF-8 bytes: gaps count bytes, and ``\\s \\w \\b`` know ASCII only.  Columns see that as
the *byte view* of a text, in which every code point of n > 1 bytes is n copies of U+0001: distances
become byte distances and non-ASCII characters are neither word nor space characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule pack that can't be read or compiled."""


@dataclass(frozen=True)
class Rule:
    """One rule.  ``strings`` maps names to patterns; ``condition`` is ``any``, ``all``, or an
    expression of string names with and, or, not and parentheses."""

    rule_id: str
    strings: dict[str, str]
    category: str = "unknown"
    severity: str = "medium"
    weight: float = 0.0
    route_hint: str = "evidence"
    requires_llm_validation: bool = False
    reason: str = "YARA rule matched."
    condition: str = "any"
    nocase: bool = True

    def pattern(self, name: str) -> str:
        return ("(?i)" if self.nocase else "") + self.strings[name]


# The default rules' identifiers, metadata and patterns.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "instruction_override",
        {
            "a": r"ignore\s+(all\s+)?previous\s+instructions?",
            "b": r"disregard\s+(all\s+)?previous\s+instructions?",
            "c": r"forget\s+(all\s+)?previous\s+instructions?",
        },
        "instruction_override", "high", 40, "hold", True, "Attempts to override existing instructions.",
    ),
    Rule(
        "system_override",
        {
            "a": r"system\s+(override|instruction|prompt)s?",
            "b": r"developer\s+(override|instruction|prompt)s?",
            "verb": r"(\bignore\b|\bdisregard\b|\boverride\b|\bbypass\b|\breplace\b)",
        },
        "instruction_override", "high", 40, "hold", True, "References higher-priority system or developer instructions.", "(a or b) and verb",
    ),
    Rule(
        "hidden_prompt_exfiltration",
        {
            "a": r"\b(show|print|reveal|dump|repeat|leak|output|expose|tell)\b[\s\S]{0,80}\b(system|developer)\s+(prompt|message|instructions?)\b",
            "b": r"\b(system|developer)\s+(prompt|message|instructions?)\b[\s\S]{0,80}\b(show|print|reveal|dump|repeat|leak|output|expose|tell)\b",
            "c": r"\b(show|print|reveal|dump|list|expose)\b[\s\S]{0,80}\bhidden\s+instructions?\b",
            "d": r"\b(show|print|reveal|dump|list|expose)\b[\s\S]{0,80}\bprivate\s+tool\s+schemas?\b",
            "e": r"\b(include|collect|copy|extract|export|list|append|attach|embed|dump)\b[\s\S]{0,120}\b(any\s+available\s+)?(system|developer)\s+prompts?\b",
            "f": r"\b(include|collect|copy|extract|export|list|append|attach|embed|dump)\b[\s\S]{0,120}\bhidden\s+instructions?\b",
            "g": r"\b(include|collect|copy|extract|export|list|append|attach|embed|dump)\b[\s\S]{0,120}\bprivate\s+tool\s+schemas?\b",
            "h": r"\b(all_internal_prompts\.xlsx|hidden_tool_schemas\.csv)\b",
            "i": r"\b(include|collect|copy|extract|export|list|append|attach|embed|dump|forward|send|share)\b[\s\S]{0,80}\b\w*(prompts?|instructions?|schemas?)\w*\.(xlsx|csv|json|yaml|yml|txt|tsv)\b",
        },
        "secret_exfiltration", "critical", 50, "hold", True, "Requests hidden prompts, hidden instructions, or private tool schema details.",
    ),
    Rule(
        "credential_exfiltration",
        {
            "a": r"\b(show|print|dump|leak|reveal|export|extract|tell)\b[\s\S]{0,80}\bapi\s+keys?\b",
            "b": r"\bapi\s+keys?\b[\s\S]{0,80}\b(show|print|dump|leak|reveal|export|extract|tell)\b",
            "c": r"\b(show|print|dump|leak|reveal|export|extract|tell)\b[\s\S]{0,80}\bdatabase\s+connection\s+strings?\b",
            "d": r"\bdatabase\s+connection\s+strings?\b[\s\S]{0,80}\b(show|print|dump|leak|reveal|export|extract|tell)\b",
            "e": r"\b(show|print|dump|leak|reveal|export|extract|tell)\b[\s\S]{0,80}\benvironment\s+variables?\b",
            "f": r"\benvironment\s+variables?\b[\s\S]{0,80}\b(show|print|dump|leak|reveal|export|extract|tell)\b",
            "g": r"\b(show|print|dump|leak|reveal|export|extract|tell)\b[\s\S]{0,80}\bsecrets?\.(csv|xlsx)\b",
            "h": r"\bsecrets?\.(csv|xlsx)\b[\s\S]{0,80}\b(show|print|dump|leak|reveal|export|extract|tell)\b",
            "i": r"\b(include|collect|copy|extract|export|list)\b[\s\S]{0,120}\b(api\s+keys?|database\s+connection\s+strings?|environment\s+variables?)\b",
            "j": r"\benvironment\s+variables?\b[\s\S]{0,80}\b(exports?|extracts?|prints?|dumps?|leaks?|reveals?|shows?|tells?)\b",
        },
        "secret_exfiltration", "critical", 50, "hold", True, "Requests credentials, environment values, or secret exports.",
    ),
    Rule(
        "tool_hijack",
        {
            "a": r"call\s+(the\s+)?(available\s+)?write\s+tool",
            "b": r"use\s+(the\s+)?(available\s+)?write\s+tool",
            "c": r"invoke\s+(the\s+)?(available\s+)?write\s+tool",
            "d": r"run\s+(the\s+)?(available\s+)?write\s+tool",
            "e": r"\b(use|call|invoke|run|execute)\s+(the\s+)?(available\s+)?[a-z0-9_]*(write|delete|send|post|exec|dispatch|upload|put|patch|destroy|drop|modify|exfil)[a-z0-9_]*\s+tool\b",
        },
        "tool_hijack", "high", 35, "hold", True, "Attempts to make an agent call tools from uploaded content.",
    ),
    Rule(
        "unsafe_mutation_request",
        {
            "a": r"\b(assistant|chatgpt|model|agent|you)\b[\s\S]{0,80}\b(write|update|delete|remove|create|export|send)\b[\s\S]{0,80}\b(file|database|record|email|message|url|endpoint|csv|xlsx)\b",
            "b": r"\b(use|call|invoke|run)\b[\s\S]{0,60}\b(tool|function|api|endpoint)\b[\s\S]{0,80}\b(write|update|delete|remove|create|export|send)\b",
            "c": r"\b(write|update|delete|remove|create|export|send)\b[\s\S]{0,60}\b(file|database|record|email|message|url|endpoint|csv|xlsx)\b",
        },
        "unsafe_action", "high", 25, "review", True, "Requests write, delete, export, send, or mutation behavior.",
    ),
    Rule(
        "safety_bypass",
        {
            "a": r"return\s+(this\s+)?(as\s+)?(safe|benign)",
            "b": r"mark\s+(this\s+)?(as\s+)?(safe|benign)",
            "c": r"classify\s+(this\s+)?(as\s+)?(safe|benign)",
            "d": r"safe_to_forward\s*=\s*true",
        },
        "safety_bypass", "high", 40, "hold", True, "Attempts to control safety classification.",
    ),
    Rule(
        "concealment",
        {"a": r"do\s+not\s+(reveal|mention|explain|classify)", "b": r"don't\s+(reveal|mention|explain|classify)"},
        "concealment", "medium", 15, "review", False, "Attempts to hide or suppress evidence of the instruction.",
    ),
    Rule(
        "authority_claim",
        {
            "a": r"this\s+document\s+wins",
            "b": r"new\s+authority",
            "c": r"mandatory\s+instruction",
            "d": r"supersedes?\s+any\s+previous\s+instruction",
            "e": r"\bI\s+am\s+(the\s+)?(system\s+)?(admin(istrator)?|owner|developer|sysadmin|root|operator|maintainer)\b",
            "f": r"\byou\s+must\s+obey\s+(my|me|this|these)\b",
        },
        "instruction_override", "high", 30, "hold", True, "Claims authority over system, developer, or policy instructions.",
    ),
)

_TRUE, _FALSE = {"true", "yes", "1", "on"}, {"false", "no", "0", "off", ""}


def as_bool(value: object, default: bool = False) -> bool:
    """Tolerant reading of a boolean metadata value."""
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return bool(value)
    text = str(value).strip().lower() if value is not None else None
    return True if text in _TRUE else False if text in _FALSE else default


def as_float(value: object, default: float = 0.0) -> float:
    """Tolerant reading of a numeric metadata value; booleans and non-numbers give the default."""
    if value is None or isinstance(value, bool):
        return default
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def required_literals(pattern: str, least: int = 3) -> frozenset[str] | None:
    """Lower-case literals of which every match holds one, or None if the pattern has no such set.

    Of the parts that a match must have, the one whose shortest literal is longest is chosen.
    """

    def of(parts) -> frozenset[str] | None:
        found: list[frozenset[str]] = []
        run = ""
        for op, arg in [*parts, (None, None)]:
            if op is parser.LITERAL:
                run += chr(arg).lower()
                continue
            if len(run) >= least:
                found.append(frozenset({run}))
            run = ""
            if op is parser.SUBPATTERN and (inner := of(arg[3])) is not None:
                found.append(inner)
            elif op is parser.MAX_REPEAT and arg[0] > 0 and (inner := of(arg[2])) is not None:
                found.append(inner)
            elif op is parser.BRANCH and all(sets := [of(x) for x in arg[1]]):
                found.append(frozenset().union(*sets))
        return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)

    from re import _parser as parser

    return of(parser.parse(pattern))


_NAME = re.compile(r"\(|\)|\w+|\S")


def _condition(rule: Rule) -> list[str]:
    """Tokens of a rule's condition, with any and all spelled out."""
    names = list(rule.strings)
    if rule.condition in ("any", "all"):
        return f" {'or' if rule.condition == 'any' else 'and'} ".join(names).split()
    tokens = _NAME.findall(rule.condition)
    unknown = [t for t in tokens if t not in {"and", "or", "not", "(", ")"} and t not in rule.strings]
    if unknown:
        raise RuleError(f"rule {rule.rule_id}: condition names unknown strings {unknown}")
    return tokens


def condition_sql(rule: Rule, match) -> str:
    """The condition as SQL text, where ``match(pattern)`` is the SQL of one string's match."""
    return "(" + " ".join(f"({match(rule.pattern(t))})" if t in rule.strings else t for t in _condition(rule)) + ")"


def match_column(rule: Rule, name: str, view: Column, lower: Column) -> Column:
    """Whether one string matches; literals that a match must hold are looked for first, which is cheap."""
    hit = view.rlike(rule.pattern(name))
    needed = required_literals(rule.strings[name])
    if not needed:
        return hit
    held = F.lit(False)
    for x in sorted(needed):
        held = held | lower.contains(x)
    return held & hit


def condition_column(rule: Rule, view: Column, lower: Column) -> Column:
    """The condition over a byte view and its lower case, by precedence: not, and, or."""
    tokens = _condition(rule)

    def either(at: int) -> tuple[Column, int]:
        left, at = both(at)
        while at < len(tokens) and tokens[at] == "or":
            right, at = both(at + 1)
            left = left | right
        return left, at

    def both(at: int) -> tuple[Column, int]:
        left, at = single(at)
        while at < len(tokens) and tokens[at] == "and":
            right, at = single(at + 1)
            left = left & right
        return left, at

    def single(at: int) -> tuple[Column, int]:
        if at >= len(tokens):
            raise RuleError(f"rule {rule.rule_id}: condition ends too early")
        if tokens[at] == "not":
            inner, at = single(at + 1)
            return ~inner, at
        if tokens[at] == "(":
            inner, at = either(at + 1)
            if at >= len(tokens) or tokens[at] != ")":
                raise RuleError(f"rule {rule.rule_id}: missing )")
            return inner, at + 1
        if tokens[at] not in rule.strings:
            raise RuleError(f"rule {rule.rule_id}: unexpected {tokens[at]!r}")
        return match_column(rule, tokens[at], view, lower), at + 1

    out, at = either(0)
    if at != len(tokens):
        raise RuleError(f"rule {rule.rule_id}: unexpected {tokens[at]!r}")
    return out


def validate(rules: Sequence[Rule]) -> tuple[Rule, ...]:
    """Check identifiers, patterns and conditions; returns the pack."""
    seen: set[str] = set()
    for rule in rules:
        if not rule.rule_id or rule.rule_id in seen:
            raise RuleError(f"rule ids must be unique and not empty: {rule.rule_id!r}")
        seen.add(rule.rule_id)
        if not rule.strings:
            raise RuleError(f"rule {rule.rule_id} has no strings")
        for name, pattern in rule.strings.items():
            if any(ord(c) > 127 for c in pattern):
                raise RuleError(f"rule {rule.rule_id}, string {name}: patterns are ASCII (non-ASCII text is matched byte by byte)")
            try:
                re.compile(pattern)
            except re.error as e:
                raise RuleError(f"rule {rule.rule_id}, string {name}: {e}") from e
        condition_column(rule, F.lit(""), F.lit("")) if _has_session() else _condition(rule)
    return tuple(rules)


def _has_session() -> bool:
    from pyspark import SparkContext

    return SparkContext._active_spark_context is not None


def load_rules(source: str, origin: str = "rule pack") -> tuple[Rule, ...]:
    """Rules from JSON text: a list of objects with the fields of ``Rule``.

    ``strings`` is a list or an object of patterns; weight and requires_llm_validation are read
    tolerantly.  Anything that can't be read raises RuleError.
    """
    try:
        raw = json.loads(source)
    except ValueError as e:
        raise RuleError(f"{origin}: {e}") from e
    if not isinstance(raw, list) or not raw:
        raise RuleError(f"{origin}: a list of rules is needed")
    out = []
    for item in raw:
        if not isinstance(item, dict) or "rule_id" not in item or not item.get("strings"):
            raise RuleError(f"{origin}: a rule needs rule_id and strings")
        strings = item["strings"] if isinstance(item["strings"], dict) else {f"s{i}": s for i, s in enumerate(item["strings"])}
        out.append(
            Rule(
                str(item["rule_id"]), {str(k): str(v) for k, v in strings.items()}, str(item.get("category") or "unknown"), str(item.get("severity") or "medium"), as_float(item.get("weight")),
                str(item.get("route_hint") or "evidence"), as_bool(item.get("requires_llm_validation")), str(item.get("reason") or "YARA rule matched."), str(item.get("condition") or "any"), as_bool(item.get("nocase", True), True),
            )
        )
    return validate(out)


def read_rules(path: str) -> tuple[Rule, ...]:
    """Rules from a file on the driver: JSON where it begins with a bracket, else YARA text."""
    from sievewright.operators.yara_text import parse_rules

    try:
        with open(path, encoding="utf-8") as f:
            source = f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise RuleError(f"{path}: {e}") from e
    return (load_rules if source.lstrip()[:1] in ("[", "{") else parse_rules)(source, path)


def byte_view(text: Column) -> Column:
    """One character for every UTF-8 byte; see the module's docstring."""
    view = F.regexp_replace(text, r"[\x{80}-\x{7FF}]", "\u0001\u0001")
    view = F.regexp_replace(view, r"[\x{800}-\x{FFFF}]", "\u0001\u0001\u0001")
    view = F.regexp_replace(view, r"[\x{10000}-\x{10FFFF}]", "\u0001\u0001\u0001\u0001")
    return F.when(text.rlike(r"[^\x00-\x7F]"), view).otherwise(text)


def byte_view_sql(text: str) -> str:
    """The same in DuckDB."""
    for low, high, n in (("80", "7FF", 2), ("800", "FFFF", 3), ("10000", "10FFFF", 4)):
        text = f"regexp_replace({text}, '[\\x{{{low}}}-\\x{{{high}}}]', repeat(chr(1), {n}), 'g')"
    return text
