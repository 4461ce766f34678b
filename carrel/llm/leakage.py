"""Problem 8: passages of held-out evaluation texts inside corpus documents.

All item texts are cut into blocks of six words; the squeezed blocks (folded letters and digits only, so that case, spacing,
punctuation, quote marks, line breaks and look-alikes do not matter) go into one Aho-Corasick automaton, and every document
is scanned once. Twenty-five words in a row hold at least three whole blocks; a whole text with one word in ten changed keeps as
many as the changes leave, one at least (short items have shorter blocks). A document and an item that share three blocks, or
as many as such a copy keeps if fewer, are looked at again: the runs are extended letter by letter, and a whole text is aligned
word by word with the part of the document around its blocks. Offsets are mapped to the original.

Defined results: null or empty texts hold nothing; repeated rows count once; items with equal texts are each reported; an
item shorter than a run is found only as a whole; one of fewer than ten words only unchanged.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.llm.textnorm import squeeze, squeeze_with_offsets
from carrel.session import table

BLOCK_WORDS, RUN_WORDS, LEAST_BLOCKS = 6, 25, 3


class Item:
    """One held-out text, squeezed, with the bounds of its words in the squeezed text. item_id: whatever names it."""

    def __init__(self, item_id, text: str) -> None:
        self.item_id = item_id
        parts = [p for p in (squeeze(w) for w in text.split()) if p]
        self.text = "".join(parts)
        self.starts, self.ends = [], []
        at = 0
        for p in parts:
            self.starts.append(at)
            at += len(p)
            self.ends.append(at)
        self.words = len(parts)

    def blocks(self, size: int = BLOCK_WORDS) -> list[tuple[int, int]]:
        """(start, end) in the squeezed text of consecutive blocks; a rest of half a block or more counts as one."""
        out = []
        for k in range(0, self.words, size):
            last = min(k + size, self.words) - 1
            if last - k + 1 >= size / 2:
                out.append((self.starts[k], self.ends[last]))
        return out

    def search_blocks(self, changed: float) -> tuple[list[tuple[int, int]], int]:
        """The blocks to look for, and how many of them a copy with the allowed changes keeps (at most LEAST_BLOCKS, at least
        one): as long as leave one whole, since each changed word spoils one block at most."""
        spoilt = int(changed * self.words)
        for size in range(BLOCK_WORDS, 0, -1):
            out = self.blocks(size)
            if len(out) > spoilt or size == 1:
                return out, max(1, min(LEAST_BLOCKS, len(out) - spoilt))

    def words_inside(self, a: int, b: int) -> int:
        """Number of whole words within [a, b)."""
        first = bisect_left(self.starts, a)
        last = bisect_left(self.ends, b + 1)
        return max(0, last - first)


class Scanner:
    def __init__(self, items: list[tuple[int, str]], changed: float = 0.1) -> None:
        self.items = [x for x in (Item(i, t) for i, t in items) if x.words]
        self.changed = changed
        self.automaton = ahocorasick.Automaton()
        patterns: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        self.need, self.n_blocks = [], []
        for k, item in enumerate(self.items):
            blocks, need = item.search_blocks(changed)
            self.need.append(need)
            self.n_blocks.append(len(blocks))
            for b, (s, e) in enumerate(blocks):
                patterns[item.text[s:e]].append((k, b, s))
        for p, where in patterns.items():
            self.automaton.add_word(p, (len(p), where))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, text: str) -> list[tuple[int, str, int, int, int]]:
        """(item_id, kind, words, start, end) for each item a text holds; offsets in the squeezed text."""
        if self.empty:
            return []
        doc = squeeze(text)
        hits: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for end, (n, where) in self.automaton.iter(doc):
            for k, b, s in where:
                hits[k].append((end + 1 - n, s, n, b))
        out = []
        for k, found in hits.items():
            if len({b for *_, b in found}) >= self.need[k] and (best := self._measure(text, doc, self.items[k], found, self.n_blocks[k])):
                out.append((self.items[k].item_id, *best))
        return out

    def _measure(self, text: str, doc: str, item: Item, found: list, n_blocks: int) -> tuple[str, int, int, int] | None:
        best = (0, 0, 0)
        done: list[tuple[int, int, int]] = []
        for d, s, n, _ in sorted(found):
            if any(diag == d - s and a <= d < b for diag, a, b in done):
                continue
            a, i = d, s
            while a > 0 and i > 0 and doc[a - 1] == item.text[i - 1]:
                a, i = a - 1, i - 1
            b, j = d + n, s + n
            while b < len(doc) and j < len(item.text) and doc[b] == item.text[j]:
                b, j = b + 1, j + 1
            done.append((d - s, a, b))
            if (n_words := item.words_inside(i, j)) > best[0]:
                # offsets of the whole words only
                first, last = bisect_left(item.starts, i), bisect_left(item.ends, j + 1) - 1
                best = (n_words, a + item.starts[first] - i, b - (j - item.ends[last]))
        if best[0] >= min(RUN_WORDS, item.words):
            return ("run" if best[0] < item.words else "whole", *best)
        return self._whole(text, doc, item, found, n_blocks)

    def _whole(self, text: str, doc: str, item: Item, found: list, n_blocks: int) -> tuple[str, int, int, int] | None:
        """The whole text with up to `changed` of its words misspelt, replaced or added."""
        n = len(item.text)
        slack = n // 6 + 12
        least = n_blocks - int(self.changed * item.words)
        tried: list[int] = []
        word_starts = None
        for d, s, _, _ in sorted(found):
            start = d - s
            if any(abs(start - t) <= slack // 2 for t in tried):
                continue
            tried.append(start)
            near = {b for dd, ss, _, b in found if abs(dd - ss - start) <= slack}
            # each changed word spoils one block at most
            if len(near) < max(1, least):
                continue
            low = max(0, start - slack)
            if word_starts is None:
                word_starts = np.unique(np.cumsum([0, *(len(squeeze(w)) for w in text.split())])[:-1])  # a word of signs alone is none
            changes, a, b = changed_words(item, doc[low : start + n + slack], word_starts[np.searchsorted(word_starts, low) :] - low)
            if changes <= self.changed * item.words:
                return ("whole", item.words - changes, low + a, low + b)
        return None


def changed_words(item: Item, part: str, word_starts: np.ndarray) -> tuple[int, int, int]:
    """(changes, start, end): the fewest words misspelt, replaced, left out or added that make the item out of a stretch of part.

    Dynamic programming over the item's words, where one change uses up at most one word of the document (word_starts: where
    they begin in part). A key holds the changes of the words so far and, behind them, how far back that reading begins.
    """
    size = len(part)
    step = size + 1
    begun = np.searchsorted(word_starts, np.arange(size + 1), side="left")  # words that begin before each place
    # the farthest place from which not more than one word begins up to here
    back = np.searchsorted(begun, begun - 1, side="left")
    key = size - np.arange(size + 1, dtype=np.int64)
    places = {w: np.array([m.start() for m in re.finditer(f"(?={re.escape(w)})", part)], np.int64) for w in {item.text[s:e] for s, e in zip(item.starts, item.ends)}}
    for s, e in zip(item.starts, item.ends):
        at = places[item.text[s:e]]
        new = _range_least(key, back) + step  # misspelt, replaced or left out
        if at.size:
            new[at + (e - s)] = np.minimum(new[at + (e - s)], key[at])
        key = np.minimum(new, _range_least(new, back) + step)  # a word added behind it
    q = int(key.argmin())
    return int(key[q] // step), int(size - key[q] % step), q


def _range_least(key: np.ndarray, back: np.ndarray) -> np.ndarray:
    """For each place q the least of key[back[q]] to key[q]."""
    here = np.arange(key.size)
    level = np.frexp(here - back + 1)[1] - 1
    out = np.empty_like(key)
    least = key
    for k in range(int(level.max()) + 1):
        at = level == k
        out[at] = np.minimum(least[back[at]], least[here[at] - (1 << k) + 1])
        if (2 << k) <= key.size:
            nxt = least.copy()
            nxt[: key.size - (1 << k)] = np.minimum(least[: key.size - (1 << k)], least[1 << k :])
            least = nxt
    return out


def find_leaks(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str | list[str], changed: float = 0.1, block_items: int = 20_000
) -> DataFrame:
    """(doc_id, item_id, field, kind, words, char_start, char_end) of the longest passage of an item in a document.

    item_text: the column or columns (questions, answers) whose texts are looked for; field names the one that was met. kind is
    'run' or 'whole', offsets are those of the document's text. The items go to the tasks in blocks of at most about block_items
    texts (one block here), the documents are scanned once a block.
    """
    fields = [item_text] if isinstance(item_text, str) else list(item_text)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("t")) for f in fields]))
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), each.alias("x")).select("i", "x.f", "x.t").where("i IS NOT NULL AND t IS NOT NULL").distinct()
    blocks = max(1, -(-rows.count() // block_items))
    one = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    out = None
    for b in range(blocks):
        held = [(r["i"], r["f"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).sort("i", "f", "t").collect()]  # bounded by block_items
        part = _scan_documents(one, held, changed)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "kind", "field", "char_start", "char_end")).alias("m"))
    return best.select("doc_id", "item_id", "m.field", "m.kind", "m.words", "m.char_start", "m.char_end")


def _scan_documents(docs: DataFrame, held: list[tuple[int, str, str]], changed: float) -> DataFrame:
    names = ["doc_id", "item_id", "field", "kind", "words", "char_start", "char_end"]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner([((i, field), t) for i, field, t in held], changed)
        for pdf in parts:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                found = scanner.scan(text)
                if found:
                    _, at = squeeze_with_offsets(text)
                    out += [(doc_id, *i, kind, words, at[a], at[b - 1] + 1) for i, kind, words, a, b in found]
            yield pd.DataFrame(out, columns=names)

    return docs.mapInPandas(scan, "doc_id bigint, item_id bigint, field string, kind string, words int, char_start bigint, char_end bigint")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "source_text")
    return leaks.select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items by suite: the documents that hold them and the longest passage."""
    items = table(spark, sf_dir, "eval_item")
    leaks = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "source_text")
    n = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("most_words"))
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "suite").distinct().join(n, "item_id")
