"""Benchmark decontamination by template canonicalisation.

Words are lower-cased, stripped of punctuation, and numbers, names and units become typed
placeholders, so a question whose figures, people or units were changed keeps its template.  Windows
of template tokens are hashed; the windows of all documents are matched against the hashed windows
of the benchmark (a hash join whose build side is one bounded block of the benchmark at a time, so
nothing grows with the benchmark, and documents aren't shuffled).

A capitalised word that opens a sentence is a word in one reading and a name in another, and both are
matched, as a copy may stand behind a comma or a line break.  Windows of mostly placeholders say too
little as templates and are matched by their literal words.

Names and numbers of several words are matched word by word and, where a text has such runs, a second
time with each run as one placeholder, so "Anna" may have become "Mary Ann".

Matches of one document and item that lie on one diagonal form a passage.  Its slots must be
consistent: the same name or unit of the item must stand for the same one of the document throughout;
equal numbers may be equal by chance and may part.  An item leaks if passages cover ``min_share`` of its tokens, or one of them has ``min_run``
tokens.  An inconsistent passage is cut before each slot that contradicts an earlier one, and counts
only if a part has ``min_run`` tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm import kernels as K
from sievewright.llm.durable import bounded_batches

WINDOW, LEAST = 8, 5
#: Characters of benchmark text that are matched in one pass over the documents.
BLOCK_CHARS = 4_000_000
#: Fixed words for units of measure and money.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz "
    "ml l litre litres liter liters gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit kelvin watt watts volt volts joule joules newton newtons hertz hz mph kmh"
).split()
#: Fixed words for numbers ("one" is mostly a pronoun).
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_ONES = "one two three four five six seven eight nine".split()
COUNTS = [*_ONES[1:], *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen".split(), *_TENS, *(f"{a}-{b}" for a in _TENS for b in _ONES)]
_MARKS = np.zeros(256, bool)
_MARKS[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?:"]] = True
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_NUMBER, _NAME, _UNIT = (K.mix(np.array([x], K.U))[0] for x in (101, 102, 103))
_known: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Templates:
    """Template tokens of a slice of texts: codes, bytes, first token of each text, placeholder flags."""

    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    slot: np.ndarray
    data: np.ndarray
    #: Codes and flags with all capitalised words as names, and codes of the literal words.
    named: np.ndarray
    any_slot: np.ndarray
    literal: np.ndarray
    #: Numbers, and texts with runs of names or numbers.
    number: np.ndarray
    runs: np.ndarray


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and the Latin-1 letters of UTF-8 text."""
    out = K.ascii_lower(data)
    if len(out) > 1:
        second = np.r_[False, data[:-1] == 0xC3]
        out = np.where(second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + np.uint8(32), out)
    return out


def _among(code: np.ndarray, name: str, words: list[str]) -> np.ndarray:
    if name not in _known:
        b, o = K.utf8(pa.array(words))
        s, e, _ = K.words(b, o)
        _known[name] = np.sort(K.word_hashes(b, s, e))
    known = _known[name]
    at = np.searchsorted(known, code)
    return (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == code)


def templates(text: pa.Array, merged: bool = False) -> Templates:
    """Template tokens of texts; ``merged`` makes each run of capitalised words or of numbers one token."""
    data, offsets = K.utf8(text)
    start, end, first = K.words(data, offsets)
    stops = np.zeros(len(start), bool)
    if len(start):  # punctuation around words, however much it is
        place, mark = np.arange(len(data)), _MARKS[data]
        before = np.maximum.accumulate(np.where(mark, -1, place))
        behind = np.minimum.accumulate(np.where(mark, len(data), place)[::-1])[::-1]
        stop = np.r_[0, np.cumsum(_STOPS[data])]
        bare = np.maximum(start, before[end - 1] + 1)
        stops = stop[end] > stop[bare]
        start, end = np.minimum(bare, behind[start]), bare
    opens = np.ones(len(start), bool)
    opens[1:] = stops[:-1]
    opens[first[:-1][first[:-1] < len(start)]] = True
    keep = end > start
    row = K.row_of(first, np.arange(len(start)))[keep]
    start, end, opens = start[keep], end[keep], opens[keep]
    first = np.searchsorted(row, np.arange(len(offsets)))
    lower = _lower(data)
    code = K.word_hashes(lower, start, end)
    digits = np.r_[0, np.cumsum(_DIGIT[data])]
    number = digits[end] > digits[start]
    if not len(start):
        return Templates(code, start, end, first, number, data, code, number, code, number, np.zeros(len(text), bool))
    head, after = data[start], data[np.minimum(start + 1, len(data) - 1)]
    upper = (head >= 65) & (head <= 90) | (head == 0xC3) & (after >= 0x80) & (after <= 0x9E)
    follows = np.where(head == 0xC3, data[np.minimum(start + 2, len(data) - 1)], after)
    shout = (follows >= 65) & (follows <= 90)
    unit, spelled = _among(code, "units", UNITS), _among(code, "counts", COUNTS)
    number |= spelled
    capital = upper & ~shout & (end - start > 1)
    row = np.repeat(np.arange(len(text)), np.diff(first))
    joins = np.zeros(len(start), bool)
    joins[1:] = (row[1:] == row[:-1]) & ~stops[keep][:-1] & (capital[1:] & capital[:-1] | spelled[1:] & number[:-1])
    runs = np.bincount(row, joins, len(text)) > 0
    if merged:
        head = np.flatnonzero(~joins)
        nth = (np.arange(len(start)) - np.repeat(head, np.diff(np.r_[head, len(start)]))).astype(K.U)
        several = np.diff(np.r_[head, len(start)]) > 1
        code = np.where(several, np.add.reduceat(K.mix(code + nth), head), code[head])
        start, end, opens, row = start[head], end[np.r_[head[1:], len(start)] - 1], opens[head] & ~several, row[head]
        number, unit, capital = number[head], unit[head], capital[head]
        first = np.searchsorted(row, np.arange(len(offsets)))
    name = capital & ~opens
    literal = code
    code, named = (np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(x, _NAME, literal))) for x in (name, capital))
    return Templates(code, start, end, first, number | unit | name, data, named, number | unit | capital, literal, number, runs)


def _spans(t: Templates, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and size of every window of ``most`` tokens; shorter texts of LEAST at least are one."""
    counts = np.diff(t.first)
    size = np.minimum(counts, most)
    n = np.where(counts >= min(LEAST, most), counts - size + 1, 0)
    begin = np.repeat(t.first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return begin, np.repeat(size, n)


def windows(t: Templates, most: int = WINDOW, indexed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first token and size of every window, and whether it rests on a capital read as a name.

    Templates of mostly placeholders are left out; for these, an index has the literal words, which are
    looked for at every window of a document.
    """
    begin, size = _spans(t, most)
    slots, any_slots = (np.r_[0, np.cumsum(x)] for x in (t.slot, t.any_slot))
    own, full = slots[begin + size] - slots[begin], any_slots[begin + size] - any_slots[begin]
    literal = 2 * full > size if indexed else np.ones(len(begin), bool)
    parts = []
    for codes, ok, tag, read in ((t.code, 2 * own <= size, 0, False), (t.named, (2 * full <= size) & (full > own), 0, True), (t.literal, literal, 0x9E3779B97F4A7C15, False)):
        x, n = begin[ok], size[ok]
        parts.append((K.Prefix(codes, 2).spans(x, x + n) ^ K.U(tag), x, n, np.full(len(x), read)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


@dataclass(frozen=True)
class Index:
    """Sorted window hashes of one block of the benchmark, with their item and place."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    size: np.ndarray
    read: np.ndarray
    item_ids: list
    tokens: list[list[str]]
    slots: list[list[bool]]
    numbers: list[list[bool]]
    short: list[int]
    #: Item that each entry is a reading of.
    base: list[int]


def _words_of(t: Templates, lo: int, hi: int) -> list[str]:
    return [" ".join(t.data[s:e].tobytes().decode("utf-8", "replace").lower().split()) for s, e in zip(t.start[lo:hi], t.end[lo:hi], strict=True)]


def build_index(item_ids: list, texts: list[str]) -> Index:
    """Windows of all items, word by word, and of those with runs of names or numbers also with runs as one token."""
    column = pa.array(texts, pa.string())
    plain = templates(column)
    again = np.flatnonzero(plain.runs)
    base = [*range(len(texts)), *again.tolist()]
    parts, tokens, slots, numbers, short, at = [], [], [], [], set(), 0
    for t in (plain, templates(column.take(pa.array(again)), True)):
        h, begin, size, read = windows(t, indexed=True)
        item = K.row_of(t.first, begin)
        parts.append((h, item + at, begin - t.first[item], size, read))
        for a, b in zip(t.first[:-1], t.first[1:], strict=True):
            words = _words_of(t, a, b)
            known = set(words)  # a run may begin with the sentence's first word before a name that the item has elsewhere
            tokens.append([w.partition(" ")[2] if w.partition(" ")[2] in known else w for w in words])
            slots.append(t.any_slot[a:b].tolist())
            numbers.append(t.number[a:b].tolist())
        short |= {int(s) for s in size if s < WINDOW}
        at += len(texts)
    h, item, place, size, read = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    return Index(h[order], item[order], place[order], size[order], read[order], [item_ids[i] for i in base], tokens, slots, numbers, sorted(short), base)


def _parts(places: list[int], pairs: dict[int, tuple[str, str]]) -> list[list[int]]:
    """``places`` cut before each one whose slot contradicts an earlier slot of its part."""
    out: list[list[int]] = [[]]
    one: dict[str, str] = {}
    for p in places:
        if p in pairs:
            a, b = pairs[p]
            if one.setdefault(a, b) != b:
                out.append([])
                one = {a: b}
        out[-1].append(p)
    return out


def _bare(a: str, b: str) -> tuple[str, str]:
    """Two names without the words that both open with: a sentence's first word may stand before a name."""
    x, y = a.split(), b.split()
    while len(x) > 1 and len(y) > 1 and x[0] == y[0]:
        x, y = x[1:], y[1:]
    return " ".join(x), " ".join(y)


def _longest_run(places: list[int]) -> int:
    run = best = 1
    for a, b in zip(places, places[1:], strict=False):
        run = run + 1 if b == a + 1 else 1
        best = max(best, run)
    return best


def leaks(index: Index, text: pa.Array, min_share: float, min_run: int) -> list[list[tuple[int, int, int, float]]]:
    """For each text: (item number, first and last byte of the passage, share of the item)."""
    plain = templates(text)
    out = _matched(index, plain, text, min_share, min_run)
    again = np.flatnonzero(plain.runs)
    if len(again):
        part = text.take(pa.array(again))
        for row, found in zip(again.tolist(), _matched(index, templates(part, True), part, min_share, min_run), strict=True):
            out[row] += found
    for row, found in enumerate(out):
        best: dict[int, tuple] = {}
        for x in found:  # one reading of each item
            if index.base[x[0]] not in best or x[3] > best[index.base[x[0]]][3]:
                best[index.base[x[0]]] = x
        out[row] = [(item, *best[item][1:]) for item in sorted(best)]
    return out


def _matched(index: Index, t: Templates, text: pa.Array, min_share: float, min_run: int) -> list[list[tuple[int, int, int, float]]]:
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(text))]
    h, begin, size, read = (np.concatenate(c) for c in zip(*(windows(t, n) for n in (WINDOW, *index.short)), strict=True))  # as short as the block's shortest items, too
    lo, hi = np.searchsorted(index.hashes, h, "left"), np.searchsorted(index.hashes, h, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return out
    lower: dict[int, str] = {}

    def word(i: int) -> str:
        if i not in lower:
            lower[i] = _words_of(t, i, i + 1)[0]
        return lower[i]

    diagonals: dict[tuple[int, int, int], set[int]] = {}
    strict: dict[tuple[int, int, int], set[int]] = {}  # without capitals read as names
    for x in hit.tolist():
        row = int(K.row_of(t.first, begin[x : x + 1])[0])
        for y in range(lo[x], hi[x]):
            if index.size[y] == size[x]:
                place = int(index.place[y])
                key = (row, int(index.item[y]), int(begin[x]) - place)
                diagonals.setdefault(key, set()).update(range(place, place + int(size[x])))
                if not read[x] and not index.read[y]:
                    strict.setdefault(key, set()).update(range(place, place + int(size[x])))
    covered: dict[tuple[int, int], set[int]] = {}
    spans: dict[tuple[int, int], list[int]] = {}
    for (row, item, shift), places in sorted(diagonals.items()):
        slots = index.slots[item]
        asked = [p for p in places if (slots[p] or t.any_slot[p + shift]) and not (index.numbers[item][p] and t.number[p + shift])]
        pairs = {p: _bare(index.tokens[item][p], word(int(p + shift))) for p in asked}
        parts = _parts(sorted(places), pairs)
        if len(parts) > 1 and (row, item, shift) in strict:
            again = _parts(sorted(strict[row, item, shift]), pairs)
            parts = again if len(again) == 1 else parts
        if len(parts) > 1:
            parts = [x for x in parts if _longest_run(x) >= min_run]
            if not parts:
                continue
        best = max(map(_longest_run, parts))
        places_in_order = [p for x in parts for p in x]
        key = (row, item)
        covered.setdefault(key, set()).update(places_in_order)
        span = spans.setdefault(key, [1 << 60, 0, 0])
        span[0] = min(span[0], int(t.start[places_in_order[0] + shift]))
        span[1] = max(span[1], int(t.end[places_in_order[-1] + shift]))
        span[2] = max(span[2], best)
    offsets = K.utf8(text)[1]
    for (row, item), places in sorted(covered.items()):
        share = len(places) / len(index.tokens[item])
        if share >= min_share or spans[row, item][2] >= min_run:
            out[row].append((item, spans[row, item][0] - int(offsets[row]), spans[row, item][1] - int(offsets[row]), share))
    return out


LEAK_TYPE = "array<struct<item_id:long,start:long,end:long,share:double>>"


def _leaks_column(index: Index, text: Column, spark, min_share: float, min_run: int) -> Column:
    shipped = spark.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    @F.arrow_udf(LEAK_TYPE)
    def run(text: pa.Array) -> pa.Array:
        index, out = shipped.value, []
        text = text.fill_null("")
        for at, to in K.slices(text):
            out += [[{"item_id": index.item_ids[i], "start": a, "end": b, "share": s} for i, a, b, s in found] for found in leaks(index, text.slice(at, to - at), min_share, min_run)]
        return pa.array(out, kind)

    return run(text)


def with_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "sw_leaks", min_share: float = 0.5, min_run: int = 20) -> DataFrame:
    """``docs`` with an array of leaks: item_id, byte span in the text, and share of the item's tokens.

    benchmark: item_id, text.  Items with null text or fewer than 5 template tokens can't be told from
    chance and match nothing; a null item_id is returned as null.  Null and empty texts have no leaks.
    Rows are judged each, without a shuffle, on whole texts.  The benchmark is read in blocks of about
    BLOCK_CHARS characters; each block is one more pass of the Arrow function over a row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        part.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        if part:
            found.append(_leaks_column(build_index([r["item_id"] for r in part], [r["text"] for r in part]), F.col("text"), spark, min_share, min_run))
    return docs.withColumn(column, F.concat(*found) if found else F.array().cast(LEAK_TYPE))


def readable(template: str) -> str:
    """Template of a short text, for reports: placeholders in angle brackets."""
    t = templates(pa.array([template], pa.string()))
    names = {int(_NUMBER): "<number>", int(_NAME): "<name>", int(_UNIT): "<unit>"}
    return " ".join(names.get(int(c), w) if s else w for c, s, w in zip(t.code, t.slot, _words_of(t, 0, len(t.code)), strict=True))
