"""Toxicity scores from a learned lexicon, Levenshtein automata and context windows.

The lexicon (words and stems that labelled toxic documents hold far more often than clean ones) is
kept as a trie.  Each word's Levenshtein automaton of one edit is intersected with that trie and the
intersection is determinised once into a transition table; all words of a slice of documents then
walk the table in lock-step and drop out as soon as they can't match any more.

A hit counts by its term, by whether it is exact or misspelled, and by whether its context window
looks like a quotation (inside quotation marks, or after a reporting cue) or not.  Each combination
has a weight learned from labelled documents, so a term that clean documents quote loses its weight
there while the same term used as abuse keeps it.  A logistic layer over the summed weights gives
the score.

Training reads a bounded sample (``rows_per_class`` labelled documents of each class, by a hash of
the id); scoring is a row-wise Arrow function without a shuffle and reads whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm import kernels as K
from sievewright.llm.durable import bounded_batches, written

#: Fixed cues of reported speech, in the languages at hand.
CUES = {"said", "says", "called", "quote", "quoted", "quoting", "wrote", "term", "word", "sagte", "nannte", "zitat", "wort", "dit", "mot", "dijo", "palabra"}
#: Letters of the stems that are counted beside whole words.
STEM_LETTERS = (4, 5, 6, 7, 8)
KINDS = ("exact", "misspelled", "exact quoted", "misspelled quoted")
#: Words before a hit in which a reporting cue counts.
CUE_WORDS = 5
#: What quotation takes out of a text while terms are chosen: marked passages (to the line's end where they aren't closed), and words after a cue.
_QUOTATION = re.compile(r'"[^"\n]*"?|“[^”\n]*”?|«[^»\n]*»?|„[^“”\n]*[“”]?|\b(?:' + "|".join(sorted(CUES)) + rf")\b(?:\W+\w+){{0,{CUE_WORDS}}}")
_alnum: list[np.ndarray] = []


@dataclass(frozen=True)
class Automaton:
    """Determinised intersection: classes of characters, transitions, and what each state accepts."""

    char_class: np.ndarray  # uint8 by code point
    step: np.ndarray  # int32 (state, class); state 0 is dead, state 1 the start
    accepts: np.ndarray  # term of the state or -1
    edits: np.ndarray  # edits of that term


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[str, ...]
    automaton: Automaton | None
    weights: np.ndarray  # (terms, kinds)
    bias: float
    scale: tuple[float, float]


def build_automaton(terms: list[str], least_fuzzy: int = 5) -> Automaton:
    """``terms`` are words, or stems written with a trailing ``*``.

    Words of ``least_fuzzy`` letters or more match within one insertion, deletion or substitution;
    shorter ones and stems match exactly (a stem also with any ending).
    """
    children: list[dict[str, int]] = [{}]
    ends: list[tuple[int, bool] | None] = [None]
    fuzzy = [False]
    for t, term in enumerate(terms):
        word, node = term.rstrip("*"), 0
        for ch in word:
            if ch not in children[node]:
                children[node][ch] = len(children)
                children.append({})
                ends.append(None)
                fuzzy.append(False)
            node = children[node][ch]
        ends[node] = (t, term.endswith("*"))
    # nodes on the way to a word that may be misspelled
    for term in terms:
        if not term.endswith("*") and len(term) >= least_fuzzy:
            node = fuzzy[0] = 0
            fuzzy[0] = True
            for ch in term:
                node = children[node][ch]
                fuzzy[node] = True
    alphabet = sorted({ch for x in children for ch in x})
    char_class = np.zeros(0x110000, np.uint8)
    for i, ch in enumerate(alphabet):
        char_class[ord(ch)] = i + 1

    def close(states: set[tuple[int, int]]) -> frozenset:
        """Add deletions: the automaton skips a letter of the term."""
        out = set(states)
        for node, e in states:
            if e == 0:
                out |= {(n, 1) for n in children[node].values() if fuzzy[n]}
        return frozenset(x for x in out if x[1] == 0 or (x[0], 0) not in out)

    def move(states: frozenset, ch: str | None) -> frozenset:
        out: set[tuple[int, int]] = set()
        for node, e in states:
            n = children[node].get(ch) if ch else None
            if n is not None and (e == 0 or fuzzy[n]):
                out.add((n, e))
            if e == 0:
                if fuzzy[node]:
                    out.add((node, 1))  # insertion
                out |= {(n, 1) for c, n in children[node].items() if c != ch and fuzzy[n]}  # substitution
        return close(out)

    start = close({(0, 0)})
    number, todo = {frozenset(): 0, start: 1}, [start]
    rows = [[0] * (len(alphabet) + 1), None]
    accepts, edits = [-1, -1], [0, 0]
    stem_state: dict[int, int] = {}
    while todo:
        states = todo.pop()
        row = []
        for ch in [None, *alphabet]:
            to = move(states, ch)
            stem = next((ends[n] for n, e in to if e == 0 and ends[n] and ends[n][1]), None)
            if stem:  # whatever follows, the stem is there
                if stem[0] not in stem_state:
                    stem_state[stem[0]] = k = len(rows)
                    rows.append([k] * (len(alphabet) + 1))
                    accepts.append(stem[0])
                    edits.append(0)
                row.append(stem_state[stem[0]])
                continue
            if to not in number:
                number[to] = len(rows)
                rows.append(None)
                found = min(((e, ends[n][0]) for n, e in to if ends[n] and not ends[n][1] and (e == 0 or fuzzy[n] and len(terms[ends[n][0]]) >= least_fuzzy)), default=(0, -1))
                accepts.append(found[1])
                edits.append(found[0])
                todo.append(to)
            row.append(number[to])
        rows[number[states]] = row
    return Automaton(char_class, np.array(rows, np.int32), np.array(accepts, np.int32), np.array(edits, np.int32))


def _tokens(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined lower-cased texts, their code points, and start, end and text of every token."""
    if not _alnum:
        _alnum.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    joined = "\n".join(x.lower().replace("\n", "\r") for x in texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _alnum[0][cp]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return joined, cp, start, end, np.searchsorted(np.flatnonzero(cp == 10), start)


def _quoted(joined: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Whether each hit's line opens a quotation before it, or one of the words before it is a reporting cue."""
    at = start[token]
    breaks = np.flatnonzero((cp == 10) | (cp == 13))
    line = np.r_[0, breaks + 1][np.searchsorted(breaks, at)]
    plain, opened, closed = (np.r_[0, np.cumsum(np.isin(cp, [ord(c) for c in marks]))] for marks in ('"', "“«„", "”»"))
    out = (plain[at] - plain[line]) % 2 == 1
    out |= opened[at] - opened[line] > closed[at] - closed[line]
    for i in np.flatnonzero(~out).tolist():
        near = slice(max(0, token[i] - CUE_WORDS), token[i])
        out[i] = any(a >= line[i] and joined[a:b] in CUES for a, b in zip(start[near].tolist(), end[near].tolist(), strict=True))
    return out


def hits(automaton: Automaton, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and kind of every hit."""
    joined, cp, start, end, of = _tokens(texts)
    alive = np.flatnonzero(end - start >= 2)
    state = np.ones(len(alive), np.int32)
    done_token, done_state = [], []
    at = start[alive]
    classes = automaton.char_class[cp]
    while len(alive):
        state = automaton.step[state, classes[at]]
        at = at + 1
        over = at == end[alive]
        found = over & (automaton.accepts[state] >= 0)
        done_token.append(alive[found])
        done_state.append(state[found])
        go = ~over & (state != 0)
        alive, state, at = alive[go], state[go], at[go]
    token = np.concatenate(done_token) if done_token else np.zeros(0, np.int64)
    states = np.concatenate(done_state) if done_state else np.zeros(0, np.int64)
    kind = automaton.edits[states] + 2 * _quoted(joined, cp, start, end, token)
    return of[token], automaton.accepts[states], kind


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("sw_toxic").to_pylist(), strict=True):
            found = set(re.findall(r"[^\W_]{3,}", _QUOTATION.sub(" ", (text or "").lower())))
            stems = {f"{w[:n]}*" for w in found for n in STEM_LETTERS if len(w) > n}
            for term in found | stems:
                counts.setdefault(term, [0, 0])[toxic] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([counts[k][1] for k in keys], pa.int64()), pa.array([counts[k][0] for k in keys], pa.int64())], names=["term", "n_toxic", "n_clean"]
        )


def _choose(table: list[tuple[str, int, int]], toxic: int, clean: int, most: int) -> list[str]:
    """Terms by strength; a stem stands for its words if it has clearly more toxic documents."""
    table.sort(key=lambda x: (-(x[1] - x[2] * toxic / max(clean, 1)), -len(x[0]), x[0]))
    by_word = {t: n for t, n, _ in table}
    chosen: list[str] = []
    taken: set[str] = set()
    for term, n, _ in table:
        body = term.rstrip("*")
        if any(f"{body[:k]}*" in taken for k in STEM_LETTERS):
            continue
        if term.endswith("*"):
            if any(by_word.get(w, 0) >= 0.9 * n for w in by_word if not w.endswith("*") and w.startswith(body)):
                continue  # one word is nearly all there is of it
            chosen = [x for x in chosen if not x.startswith(body)]
        chosen.append(term)
        taken.add(term)
        if len(chosen) >= most:
            break
    return chosen


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000, least_documents: int = 3, terms: int = 200, surprise: float = 12.0, candidates: int = 4000) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic 0 or 1) and the documents' texts.

    Rows with another or null label, without a document, or with null text are left out.  The sample
    of about ``rows_per_class`` labels of each class (an id's equal labels are one) is what is joined
    to the documents, so the broadcast side is bounded by that parameter whatever the number of labels.
    ``terms`` are chosen from the ``candidates`` words and stems that mark the most toxic documents.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("sw_toxic")).where("sw_toxic in (0, 1) and doc_id is not null").distinct()
    size = {r["sw_toxic"]: r["n"] for r in rows.groupBy("sw_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        constant = -6.0 if size.get(0) or not size else 6.0
        return ToxicityModel((), None, np.zeros((0, 4)), constant, (0.0, 0.0))
    rate = F.when(F.col("sw_toxic") == 1, min(1.0, rows_per_class / size[1])).otherwise(min(1.0, rows_per_class / size[0]))
    chosen_labels = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) < rate * (1 << 20))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    sample = written(texts.join(F.broadcast(chosen_labels), "doc_id").select("text", "sw_toxic"), "toxicity-sample")
    counts = sample.mapInArrow(_stem_counts, "term string, n_toxic long, n_clean long").groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    toxic, clean = (min(size[k], rows_per_class) for k in (1, 0))
    q = toxic / (toxic + clean)
    n, f = F.col("n_toxic") + F.col("n_clean"), F.col("n_toxic") / (F.col("n_toxic") + F.col("n_clean"))
    rest = F.when(F.col("n_clean") > 0, (1 - f) * F.log((1 - f) / (1 - q))).otherwise(0.0)
    # chance of a term that says nothing to be this toxic, against the number of terms that are tried
    strong = counts.where(F.col("n_toxic") >= least_documents).where((f > 0.5 + q / 2) & (n * (f * F.log(f / q) + rest) >= surprise))
    top = strong.orderBy(F.desc(F.col("n_toxic") - F.col("n_clean") * (toxic / clean)), "term").limit(candidates)
    chosen = _choose([tuple(r) for r in top.collect()], toxic, clean, terms)
    if not chosen:
        return ToxicityModel((), None, np.zeros((0, 4)), math.log(toxic / clean), (0.0, 0.0))
    automaton = build_automaton(chosen)
    shipped = spark.sparkContext.broadcast(automaton)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, label = batch.column("text").fill_null(""), np.array(batch.column("sw_toxic").to_pylist(), np.int64)
            for at, to in K.slices(text):
                of, term, kind = hits(shipped.value, text.slice(at, to - at).to_pylist())
                seen = np.unique(np.stack([of, term, kind]), axis=1)
                lists: list[list[int]] = [[] for _ in range(to - at)]
                for o, t, k in seen.T:
                    lists[o].append(int(t) * 4 + int(k))
                yield pa.RecordBatch.from_arrays([pa.array(label[at:to].astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))], names=["toxic", "hits"])

    got = [(r["toxic"], r["hits"]) for r in sample.mapInArrow(found, "toxic int, hits array<int>").collect()]
    got.sort(key=lambda x: (x[0], x[1]))
    n = np.zeros((2, len(chosen), 4))
    y = np.array([g[0] for g in got], float)
    for label, h in got:
        for x in h:
            n[label, x // 4, x % 4] += 1
    pos, neg = max(y.sum(), 1), max((1 - y).sum(), 1)
    odds = np.log((n[1] + 0.5) / (pos + 1)) - np.log((n[0] + 0.5) / (neg + 1))
    base = np.maximum(odds[:, :1], 0)
    seen = n.sum(axis=0)
    share = seen / (seen + 3)  # kinds hardly seen lean on the exact, unquoted weight
    prior = base * np.array([[1.0, 0.5, 0.25, 0.1]])
    weights = np.maximum(share * odds + (1 - share) * prior, 0)
    x = np.array([_features(weights, h) for _, h in got])
    w = _logistic(x, y)
    return ToxicityModel(tuple(chosen), automaton, weights, float(w[0]), (float(w[1]), float(w[2])))


def _features(weights: np.ndarray, h: list[int]) -> tuple[float, float]:
    """Largest weight, and the sum of the others damped: many weak hits don't outdo a strong one."""
    got = sorted((float(weights[x // 4, x % 4]) for x in h), reverse=True)
    return (got[0] if got else 0.0), math.log1p(sum(got[1:]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps of a ridge logistic regression; weights of the features stay at 0 or above."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(model: ToxicityModel, text: Column, spark) -> Column:
    """Score from 0 to 1 of every whole text; null and empty texts get the score without hits."""
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        model, out = shipped.value, []
        text = text.fill_null("")
        for at, to in K.slices(text):
            seen: list[set[int]] = [set() for _ in range(to - at)]
            if model.automaton is not None:
                for o, t, k in zip(*(v.tolist() for v in hits(model.automaton, text.slice(at, to - at).to_pylist())), strict=True):
                    seen[o].add(t * 4 + k)
            for h in seen:
                a, b = _features(model.weights, list(h))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + model.scale[0] * a + model.scale[1] * b)))))
        return pa.array(out, pa.float64())

    return run(text)


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row; repeated rows get the same score each."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(model, F.col("text"), docs.sparkSession).alias("score"))
