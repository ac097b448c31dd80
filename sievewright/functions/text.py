"""Text functions: Unicode white space, normalisation, literal prompt substitution."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as white space, and those that are invisible.
WHITESPACE = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
INVISIBLE = "\u200B\u200C\u200D\uFEFF\u00AD"
_CLASS = "".join(f"\\x{{{ord(c):X}}}" for c in WHITESPACE)


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, f"^[{_CLASS}]+|[{_CLASS}]+\\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~text.rlike(f"[^{_CLASS}]"), F.lit(True))


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in text.to_pylist()], pa.string())


def squeeze(text: Column) -> Column:
    """Runs of spaces and tabs to one space, three or more line feeds to two, invisible characters gone."""
    text = F.translate(text, INVISIBLE, "")
    text = F.regexp_replace(text, "[ \t]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def normalize_ascii(text: Column) -> Column:
    """Normalisation of text that is known to be ASCII: the Unicode step changes nothing there."""
    return squeeze(text)


def normalize(text: Column) -> Column:
    """Compatibility composition (NFKC), then ``squeeze``.

    ASCII texts are not changed by the first step, but a Python function runs for all rows of a
    batch; split tables by ``is_ascii`` first if few rows have other characters.
    """
    return squeeze(_nfkc(text))


def is_ascii(text: Column) -> Column:
    return text.rlike("^[\\x00-\\x7F]*\\z")


def truncate(text: Column, width: int = 180) -> Column:
    """At most ``width`` characters on one line, with dots where something was cut."""
    line = strip(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(line) <= width, line).otherwise(F.concat(F.substring(line, 1, width - 3), F.lit("...")))


def substitute(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{{ name }}`` placeholders in one pass: values that hold placeholders stay as they are."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min(((rest.find(f"{{{{ {n} }}}}"), n) for n in values if f"{{{{ {n} }}}}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        if at[0]:
            parts.append(F.lit(rest[: at[0]]))
        parts.append(values[at[1]])
        rest = rest[at[0] + len(at[1]) + 6 :]
    return strip(F.concat(*parts)) if parts else F.lit("")
