"""Problem 9: statistics of each text and a verdict on prose, lists, tables and junk.

A text is cut into stretches: its lines, long ones in windows. Each stretch is measured by labelling functions, none of which
can tell the kinds by itself: the layout of its line, a mark before it, cells, figures and signs, common words, how word-like
its letters are, short pieces between commas, repetition, odd signs. A function votes by the level of its statistic;
statistics that depend on each other (words a line, sentence ends and the text's line length; digits and signs) vote together
as one function. How often each level stands for each kind is learnt by expectation-maximization over the counts of vote
patterns of all texts (at most N_PATTERNS of them, however many texts there are), from first guesses that also hold the
kinds' names in place. A stretch has the posterior of its pattern, a text the kind with most of its characters. How word-like
letters are comes from letter pairs counted over all texts, a table of fixed size.

Defined results: a null or blank text has zero statistics and a null kind; equal ids with different texts are separate rows
in the statistics; very long texts and lines are taken whole.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.session import cut, table

KINDS = ("prose", "list", "table", "junk")

# ---- characters ---------------------------------------------------------------------------------------------------
SPACE, LETTER, ACCENTED, DIGIT, OTHER, N_CODES = 0, 1, 27, 28, 29, 30
_LOW = 0x3000


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points under _LOW: the letter-pair code, and 0 space, 1 letter or digit, 2 symbol."""
    code, kind = np.full(_LOW, OTHER, np.uint8), np.full(_LOW, 2, np.uint8)
    for i in range(_LOW):
        c = chr(i)
        if c.isspace():
            code[i], kind[i] = SPACE, 0
        elif c.isalnum():
            kind[i] = 1
            low = c.lower()
            code[i] = LETTER + ord(low) - 97 if len(low) == 1 and "a" <= low <= "z" else DIGIT if c.isdigit() else ACCENTED
    return code, kind


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.append(_char_tables())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code, kind = _TABLES[0]
    if points.size and int(points.max()) >= _LOW:
        points = np.minimum(points, _LOW - 1)
    return code[points], kind[points]


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """Counts of neighbouring character codes over all texts: N_CODES x N_CODES numbers."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(N_CODES * N_CODES, np.int64)
        for pdf in parts:
            for text in pdf["text"]:
                c, _ = _codes(text)
                if c.size > 1:
                    total += np.bincount(c[:-1].astype(np.int32) * N_CODES + c[1:], minlength=total.size)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"pair": at.astype(np.int32), "n": total[at]})

    rows = docs.select("text").mapInPandas(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 900 rows
    out = np.ones(N_CODES * N_CODES)
    for r in rows:
        out[r["pair"]] += r["n"]
    return out.reshape(N_CODES, N_CODES)


def pair_scores(counts: np.ndarray) -> np.ndarray:
    """log P(next | this) for pairs that hold a letter; 0 marks the others, which do not count."""
    scores = np.log(counts / counts.sum(axis=1, keepdims=True))
    letter = np.zeros(N_CODES, bool)
    letter[LETTER : ACCENTED + 1] = True
    scores[~(letter[:, None] | letter[None, :])] = 0
    return scores.astype(np.float32).ravel()


# ---- stretches and their votes ------------------------------------------------------------------------------------
STATS = ("words", "mean_word_length", "symbol_share", "punct_line_share", "common_share")
WINDOW, CONTEXT = 200, 120
_EDGES = ".,;:()[]{}\"'“”!?*-•–"
_MARK = re.compile(r"(?:[-*•–◦·▪+]|\(?\d{1,4}[.)]|\[[ xX]?\]|\(?[a-z]\))\s+(?=\S)")
CELL_SIGN, ODD_SIGN, END_SIGN, COMMA = 1, 2, 4, 8
#: Labelling functions with the number of levels they vote with; their levels together are the pattern of a stretch.
FUNCTIONS = {"layout": 18, "mark": 2, "cells": 3, "figures": 12, "common": 4, "odd": 4, "pieces": 3, "repeats": 4, "signs": 3}
SIZES = np.array(list(FUNCTIONS.values()))
RADIX = np.concatenate([[1], np.cumprod(SIZES)[:-1]])
N_PATTERNS = int(SIZES.prod())


def _sign_table() -> np.ndarray:
    out = np.zeros(_LOW, np.uint8)
    for signs, flag in (("|!\t", CELL_SIGN), ("{}[]\\^~$#<>*_=", ODD_SIGN), (".!?:;…\"”)", END_SIGN), (",;", COMMA)):
        for c in signs:
            out[ord(c)] |= flag
    return out


_SIGNS = _sign_table()


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.size + 1, np.float64)
    np.cumsum(x, out=out[1:])
    return out


class _Count:
    """How many places with a mark lie between others."""

    def __init__(self, mark: np.ndarray) -> None:
        self.places = mark.nonzero()[0]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.places.searchsorted(b) - self.places.searchsorted(a)


def _level(x: np.ndarray, *bounds: float) -> np.ndarray:
    """How many of the bounds each value exceeds or equals."""
    out = (x >= bounds[0]) * 1
    for b in bounds[1:]:
        out += x >= b
    return out


def measure(text: str, common: frozenset[str], scores: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
    """(STATS, patterns, characters): the vote pattern and the size of each stretch of a text."""
    tokens = text.lower().split()
    if not tokens:
        return (0,) + (0.0,) * (len(STATS) - 1), np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    newline = points == 10
    points = np.minimum(points, _LOW - 1)
    code, kind = _codes(text)
    sign = _SIGNS[points]
    n = points.size
    space = kind == 0
    solid = np.flatnonzero(~space)
    begins_word = np.ones(n, bool)
    begins_word[1:] = space[:-1]
    starts = solid[begins_word[solid]]
    word_ends = solid[np.append(begins_word[solid][1:], True)] + 1
    is_common = [t in common for t in tokens]
    # only words with signs at their edges are stripped
    for k in ((kind[starts] != 1) | (kind[word_ends - 1] != 1)).nonzero()[0].tolist():
        is_common[k] = tokens[k].strip(_EDGES) in common
    known = _Count(np.array(is_common))

    # lines from their first to behind their last character
    ends = np.append(np.flatnonzero(newline), n)
    first, last = np.searchsorted(solid, np.append(0, ends[:-1])), np.searchsorted(solid, ends) - 1
    good = last >= first
    begin, end = solid[first[good]], solid[last[good]] + 1
    words = starts.searchsorted(end) - starts.searchsorted(begin)
    closed = (sign[end - 1] & END_SIGN) > 0
    marked = np.fromiter([_MARK.match(text, a, b) is not None for a, b in zip(begin.tolist(), end.tolist())], bool, begin.size)
    between = lambda mark: _Count(mark)(begin, end)
    blank_next = np.append(space[1:], True)
    comma = (sign & COMMA) > 0
    bare, soft = between(comma & ~blank_next), between(comma & blank_next)
    gap = np.zeros(n, bool)
    gap[:-1] = space[:-1] & space[1:]
    separators, tabs, gaps = between(sign & CELL_SIGN), between(points == 9), between(gap)
    cells = np.where((separators >= 2) | (tabs >= 1) | ((bare >= 2) & (soft == 0)), 2, (gaps >= 1) * 1)
    each = words / (soft + 1)
    pieces = np.where((soft >= 4) & (each <= 3.2), 2, ((soft >= 1) & (each <= 4)) * 1)
    typical = float(np.median(words))
    layout = _level(words, 6, 12) * 6 + closed * 3 + int(_level(np.array([typical]), 6, 15)[0])
    packed = len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) < 0.13 * n
    repeats = 2 * (len(set(tokens)) <= max(3, len(tokens) // 20)) + packed

    # stretches of about WINDOW characters, each with CONTEXT for what needs more than a few words
    size = end - begin
    parts = -(-size // WINDOW)
    line = np.repeat(np.arange(size.size), parts)
    step = -(-size // parts)[line]
    a = begin[line] + (np.arange(line.size) - np.repeat(np.cumsum(parts) - parts, parts)) * step
    b = np.minimum(a + step, end[line])
    far = np.minimum(n, np.maximum(b, a + CONTEXT))
    near = np.minimum(a, np.maximum(0, far - CONTEXT))
    pairs = scores[code[:-1].astype(np.int32) * N_CODES + code[1:]] if n > 1 else np.zeros(1, np.float32)
    total = _sums(pairs)
    top, bottom = np.minimum(far, pairs.size), np.minimum(near, pairs.size)
    seen = _Count(pairs)(bottom, top)
    score = (total[top] - total[bottom]) / np.maximum(seen, 1)
    odd = np.where(seen < 0.25 * (far - near), 3, 2 - _level(score, -3.3, -2.95))
    full = np.maximum(solid.searchsorted(b) - solid.searchsorted(a), 1)
    inside = lambda mark: _Count(mark)(a, b) / full
    w0 = starts.searchsorted(near)
    w1 = np.maximum(starts.searchsorted(far), w0 + 1)
    share = known(w0, w1) / (w1 - w0)
    symbol = kind == 2
    figures = _level(inside(code == DIGIT), 0.1, 0.3) * 4 + _level(inside(symbol), 0.1, 0.25, 0.45)
    votes = (layout[line], marked[line], cells[line], figures, _level(share, 0.06, 0.15, 0.25), odd, pieces[line], repeats, _level(inside(sign & ODD_SIGN), 0.02, 0.08))
    patterns = sum(v * int(r) for v, r in zip(votes, RADIX))

    letters = _Count((code >= LETTER) & (code <= ACCENTED))
    lettered = int((letters(starts, word_ends) > 0).sum())
    stats = (len(tokens), solid.size / len(tokens), float(symbol.sum()) / n, float(closed.sum()) / closed.size, known.places.size / max(1, lettered))
    return stats, np.broadcast_to(patterns, a.shape), b - a


def with_measures(docs: DataFrame, id_col: str, text_col: str, common: frozenset[str]) -> DataFrame:
    """(doc_id, *STATS, patterns, sizes) of every row: each pattern once with its characters; letter pairs are counted over all
    texts first."""
    one = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scores = pair_scores(letter_pairs(one))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for text in pdf["text"]:
                stats, patterns, sizes = measure(text, common, scores)
                held: dict[int, int] = {}
                for p, k in zip(patterns.tolist(), sizes.tolist()):
                    held[p] = held.get(p, 0) + k
                rows.append((*stats, list(held), list(held.values())))
            out = pd.DataFrame(rows, columns=[*STATS, "patterns", "sizes"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield out

    return one.mapInPandas(run, "doc_id bigint, words bigint, " + ", ".join(f"{s} double" for s in STATS[1:]) + ", patterns array<int>, sizes array<int>")


# ---- learning -----------------------------------------------------------------------------------------------------
def _together(*tables: np.ndarray) -> np.ndarray:
    """The levels of several statistics as those of one function."""
    out = tables[0]
    for t in tables[1:]:
        out = (out[:, None, :] * t[None, :, :]).reshape(-1, len(KINDS))
    return out


def _guess(*levels: tuple[float, float, float, float]) -> np.ndarray:
    return np.array(levels)


# First guesses: how often each level of a statistic (a row) stands for prose, list, table and junk.
START = [
    _together(
        _guess((0.05, 0.6, 0.6, 0.3), (0.2, 0.3, 0.3, 0.3), (0.75, 0.1, 0.1, 0.4)),  # words in the line: under 6, under 12, more
        _guess((0.3, 0.8, 0.9, 0.8), (0.7, 0.2, 0.1, 0.2)),  # whether the line ends like a sentence
        _guess((0.05, 0.7, 0.7, 0.2), (0.3, 0.2, 0.2, 0.2), (0.65, 0.1, 0.1, 0.6)),  # median words a line: under 6, under 15, more
    ),
    _guess((0.98, 0.5, 0.97, 0.97), (0.02, 0.5, 0.03, 0.03)),  # a bullet or number before it
    _guess((0.96, 0.95, 0.1, 0.7), (0.02, 0.03, 0.3, 0.1), (0.02, 0.02, 0.6, 0.2)),  # cells: none, by gaps, by signs
    _together(
        _guess((0.85, 0.85, 0.15, 0.6), (0.12, 0.12, 0.25, 0.25), (0.03, 0.03, 0.6, 0.15)),  # digits
        _guess((0.9, 0.6, 0.2, 0.4), (0.08, 0.35, 0.35, 0.15), (0.01, 0.04, 0.4, 0.15), (0.01, 0.01, 0.05, 0.3)),  # signs
    ),
    _guess((0.03, 0.5, 0.9, 0.7), (0.12, 0.28, 0.07, 0.15), (0.3, 0.12, 0.02, 0.1), (0.55, 0.1, 0.01, 0.05)),  # common words
    _guess((0.97, 0.9, 0.3, 0.1), (0.015, 0.06, 0.1, 0.15), (0.01, 0.03, 0.1, 0.6), (0.005, 0.01, 0.5, 0.15)),  # unlikely letter pairs; last: hardly any letters
    _guess((0.85, 0.5, 0.93, 0.9), (0.13, 0.2, 0.05, 0.08), (0.02, 0.3, 0.02, 0.02)),  # short pieces between commas
    _guess((0.97, 0.9, 0.94, 0.6), (0.01, 0.04, 0.02, 0.1), (0.01, 0.03, 0.02, 0.1), (0.01, 0.03, 0.02, 0.2)),  # packs very well, few different words, both
    _guess((0.98, 0.75, 0.9, 0.5), (0.015, 0.1, 0.07, 0.1), (0.005, 0.15, 0.03, 0.4)),  # signs that prose and tables lack
]
PRIOR = (0.8, 0.07, 0.07, 0.06)
#: Weight of the first guesses against all that is seen: they keep the kinds' names in place.
TRUST = 0.3


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """The level of each function (a column) in each pattern."""
    return (patterns[:, None] // RADIX) % SIZES


def learn(patterns: np.ndarray, weights: np.ndarray, start: list[np.ndarray] = START, prior=PRIOR, rounds: int = 25, trust: float = TRUST) -> tuple[np.ndarray, list[np.ndarray]]:
    """Kind shares and the rates of all levels (one table a function) by expectation-maximization on how the functions agree."""
    votes, whole = votes_of(patterns), weights.sum()
    share, rates = np.array(prior, float), [r / r.sum(0) for r in start]
    first = rates
    for _ in range(rounds):
        x = posteriors(votes, share, rates) * weights[:, None]
        share = (x.sum(0) + trust * whole * np.array(prior)) / (whole * (1 + trust))
        hold = trust * whole / len(KINDS)
        rates = [(np.stack([np.bincount(votes[:, f], x[:, k], int(SIZES[f])) for k in range(len(KINDS))], 1) + hold * first[f]) / (x.sum(0) + hold) for f in range(len(SIZES))]
    return share, rates


def posteriors(votes: np.ndarray, share: np.ndarray, rates: list[np.ndarray]) -> np.ndarray:
    logs = np.log(share) + sum(np.log(np.maximum(r, 1e-6))[votes[:, f]] for f, r in enumerate(rates))
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def text_kinds(docs: DataFrame, id_col: str, text_col: str, common_words: DataFrame, most_common_words: int = 100_000) -> DataFrame:
    """(doc_id, *STATS, kind, posterior) of every row; posterior is the share of the kind in the text's characters."""
    words = [r[0] for r in common_words.selectExpr("lower(word)").where("word IS NOT NULL").distinct().limit(most_common_words + 1).collect()]
    if len(words) > most_common_words:
        raise ValueError(f"common_word holds more than {most_common_words} words; raise most_common_words if every task can hold them")
    rows = cut(with_measures(docs, id_col, text_col, frozenset(map(sys.intern, words))))
    pairs = rows.select(F.explode(F.arrays_zip("patterns", "sizes")).alias("x"))
    seen = pairs.groupBy("x.patterns").agg(F.sum("x.sizes").alias("n")).sort("patterns").collect()  # at most N_PATTERNS rows
    known = np.array([r["patterns"] for r in seen], np.int64)
    post = posteriors(votes_of(known), *learn(known, np.array([r["n"] for r in seen], float))) if seen else np.zeros((0, len(KINDS)))

    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            kinds, sure = [], []
            for patterns, sizes in zip(pdf["patterns"], pdf["sizes"]):
                if len(patterns) == 0:
                    kinds.append(None)
                    sure.append(np.nan)
                    continue
                mass = np.asarray(sizes, float) @ post[np.searchsorted(known, patterns)]
                kinds.append(KINDS[int(mass.argmax())])
                sure.append(float(mass.max() / mass.sum()))
            yield pdf.drop(columns=["patterns", "sizes"]).assign(kind=kinds, posterior=sure)

    out = rows.mapInPandas(decide, "doc_id bigint, words bigint, " + ", ".join(f"{s} double" for s in STATS[1:]) + ", kind string, posterior double")
    return out.withColumn("posterior", F.when(F.col("kind").isNotNull(), F.col("posterior")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text_kinds(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "common_word"))
    return out.where("kind <> 'prose'").select("doc_id", F.col("kind").alias("text_kind")).distinct()


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text_kinds(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "common_word"))
    return out.select("doc_id", *STATS, "kind", F.round("posterior", 6).alias("posterior"))
