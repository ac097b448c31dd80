"""Rule packs in YARA's text form.

Read are rules with tags, ``meta``, ``strings`` (text and regular expressions with nocase, ascii,
fullword, private, and the flags i and s) and conditions of strings, ``N|any|all of (them|a list)``, and,
or, not and parentheses.  Hex strings, modules, counts, offsets and global rules raise RuleError: a rule
that is read means what it says.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

from sievewright.operators.rules import Rule, RuleError, as_bool, as_float, validate

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<text>"(?:[^"\\\n]|\\.)*")
    |(?P<regex>/(?:[^/\\\n]|\\[^\n])+/[is]*)
    |(?P<string>\$\w*\*?)
    |(?P<number>-?\d+)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<mark>[{}():=,])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{2}|.)", re.DOTALL)
#: Fixed names: what a backslash and a letter stand for in text strings.
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
_MODIFIERS = {"nocase", "ascii", "fullword", "private"}
#: Alternatives that ``N of`` may be spelled out as.
MOST_CHOICES = 1000


def _tokens(source: str, origin: str) -> list[tuple[str, str, int]]:
    out, at, line = [], 0, 1
    while at < len(source):
        found = _TOKEN.match(source, at)
        if not found:
            raise RuleError(f"{origin}, line {line}: unexpected {source[at]!r}")
        if found.lastgroup != "skip":
            out.append((found.lastgroup, found.group(), line))
        line += found.group().count("\n")
        at = found.end()
    return out


def _unescaped(text: str, origin: str) -> str:
    def one(found: re.Match) -> str:
        code = found.group(1)
        if len(code) == 3:
            return chr(int(code[1:], 16))
        if code not in _ESCAPED:
            raise RuleError(f"{origin}: unknown escape \\{code}")
        return _ESCAPED[code]

    return _ESCAPE.sub(one, text[1:-1])


class _Reader:
    def __init__(self, source: str, origin: str):
        self.tokens, self.at, self.origin = _tokens(source, origin), 0, origin

    def fail(self, why: str) -> RuleError:
        line = self.tokens[min(self.at, len(self.tokens) - 1)][2] if self.tokens else 1
        return RuleError(f"{self.origin}, line {line}: {why}")

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead][:2] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v = self.peek()
        if (value is not None and v != value) or (kind is not None and k != kind) or k == "end":
            raise self.fail(f"{value or kind} expected, not {v or 'the end'!r}")
        self.at += 1
        return v

    def rules(self) -> list[Rule]:
        out = []
        while self.peek()[0] != "end":
            while self.peek()[1] == "private":
                raise self.fail("private rules report nothing and aren't read")
            out.append(self.rule())
        return out

    def rule(self) -> Rule:
        self.take("rule")
        name = self.take(kind="word")
        if self.peek()[1] == ":":
            self.take(":")
            while self.peek()[0] == "word":
                self.take()
        self.take("{")
        meta: dict[str, object] = {}
        strings: dict[str, str] = {}
        if self.peek()[1] == "meta":
            self.section("meta")
            while self.peek()[0] == "word" and self.peek(1)[1] == "=":
                key = self.take()
                self.take("=")
                meta[key] = self.value()
        if self.peek()[1] == "strings":
            self.section("strings")
            while self.peek()[0] == "string":
                key = self.take()[1:] or f"anonymous{len(strings)}"
                if not key.isidentifier() and not key.isalnum() or key in strings:
                    raise self.fail(f"bad or repeated string name ${key}")
                self.take("=")
                strings[key] = self.pattern()
        if not strings:
            raise self.fail(f"rule {name} has no strings")
        self.section("condition")
        # names are numbered, so that a string may be called like an operator
        names = {key: f"s{i}" for i, key in enumerate(strings)}
        condition = self.either(names)
        self.take("}")
        return Rule(
            str(meta.get("rule_id", name)), {names[k]: p for k, p in strings.items()}, str(meta.get("category", "unknown")), str(meta.get("severity", "medium")), as_float(meta.get("weight")),
            str(meta.get("route_hint", "evidence")), as_bool(meta.get("requires_llm_validation")), str(meta.get("reason", "YARA rule matched.")), condition, False,
        )

    def section(self, name: str) -> None:
        self.take(name)
        self.take(":")

    def value(self) -> object:
        kind, text = self.peek()
        if kind == "text":
            return _unescaped(self.take(), self.origin)
        if kind == "number":
            return int(self.take())
        if text in ("true", "false"):
            return self.take() == "true"
        raise self.fail(f"a metadata value expected, not {text!r}")

    def pattern(self) -> str:
        kind, text = self.peek()
        if kind not in ("text", "regex"):
            raise self.fail(f"a text or a regular expression expected, not {text!r}")
        self.take()
        if kind == "text":
            flags, body = "", re.escape(_unescaped(text, self.origin))
        else:
            end = text.rindex("/")
            flags, body = text[end + 1 :], text[1:end].replace("{,", "{0,")
        modifiers = set()
        while self.peek()[0] == "word" and self.peek()[1] != "condition":
            modifiers.add(self.take())
        if unknown := modifiers - _MODIFIERS:
            raise self.fail(f"modifiers that aren't read: {', '.join(sorted(unknown))}")
        if "fullword" in modifiers:
            body = rf"(?<![A-Za-z0-9])(?:{body})(?![A-Za-z0-9])"
        flags = "".join(sorted({*flags, *("i" if "nocase" in modifiers else "")}))
        return (f"(?{flags})" if flags else "") + body

    def either(self, names: dict[str, str]) -> str:
        parts = [self.both(names)]
        while self.peek()[1] == "or":
            self.take()
            parts.append(self.both(names))
        return " or ".join(parts)

    def both(self, names: dict[str, str]) -> str:
        parts = [self.single(names)]
        while self.peek()[1] == "and":
            self.take()
            parts.append(self.single(names))
        return " and ".join(parts)

    def single(self, names: dict[str, str]) -> str:
        kind, text = self.peek()
        if text == "not":
            self.take()
            return f"not {self.single(names)}"
        if text == "(":
            self.take()
            inner = self.either(names)
            self.take(")")
            return f"({inner})"
        if kind == "string":
            self.take()
            if text[1:] not in names:
                raise self.fail(f"undefined string {text}")
            return names[text[1:]]
        if text in ("any", "all") or kind == "number":
            self.take()
            self.take("of")
            return self.of(text, self.chosen(names))
        raise self.fail(f"a condition that isn't read: {text!r}")

    def chosen(self, names: dict[str, str]) -> list[str]:
        if self.peek()[1] == "them":
            self.take()
            return list(names.values())
        out: list[str] = []
        self.take("(")
        while True:
            text = self.take(kind="string")[1:]
            found = [n for key, n in names.items() if (key.startswith(text[:-1]) if text.endswith("*") else key == text)]
            if not found:
                raise self.fail(f"undefined string ${text}")
            out += [n for n in found if n not in out]
            if self.peek()[1] != ",":
                break
            self.take(",")
        self.take(")")
        return out

    def of(self, quantity: str, names: list[str]) -> str:
        least = {"any": 1, "all": len(names)}.get(quantity)
        least = int(quantity) if least is None else least
        if not 1 <= least <= len(names) or comb(len(names), least) > MOST_CHOICES:
            raise self.fail(f"{quantity} of {len(names)} strings isn't read")
        return "(" + " or ".join("(" + " and ".join(x) + ")" for x in combinations(names, least)) + ")"


def parse_rules(source: str, origin: str = "rule pack") -> tuple[Rule, ...]:
    """Rules of YARA text, checked; RuleError with the line where it can't be read."""
    found = _Reader(source, origin).rules()
    if not found:
        raise RuleError(f"{origin}: no rules")
    return validate(found)
