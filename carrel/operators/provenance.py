"""Where a value stands: excerpts to character spans, spans to pages and boxes; page assembly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrel.functions.text import squash


def assemble_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str, confidence_col: str | None = None, warn_below: float = 0.8) -> DataFrame:
    """(doc, text, page_count, confidence, quality_warning): page texts in order, an empty line between them."""
    agg = [F.array_sort(F.collect_list(F.struct(page_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")))).alias("p"), F.count("*").alias("page_count")]
    if confidence_col:
        agg += [F.round(F.avg(confidence_col), 3).alias("confidence"), F.coalesce(F.min(confidence_col) < warn_below, F.lit(False)).alias("quality_warning")]
    out = pages.groupBy(doc_col).agg(*agg)
    return out.withColumn("text", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).drop("p")


def page_offsets(pages: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """(doc, page, start, end): place of each page in the assembled text."""
    before = Window.partitionBy(doc_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)
    n = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    start = F.coalesce(F.sum(n + 2).over(before), F.lit(0))
    return pages.select(doc_col, page_col, start.alias("start"), (start + n).alias("end"))


def word_blocks(chars: DataFrame, doc_col: str, pos_col: str, char_col: str) -> DataFrame:
    """(doc, block, start, end, text, x0, y0, x1, y1): character boxes joined to one block for each run without white space."""
    order = Window.partitionBy(doc_col).orderBy(pos_col)
    blank = F.trim(F.col(char_col)) == ""
    rows = chars.withColumn("_b", F.sum(F.when(blank, 1).otherwise(0)).over(order)).where(~blank)
    out = rows.groupBy(doc_col, "_b").agg(
        F.min(pos_col).alias("start"), (F.max(pos_col) + 1).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos_col, char_col))), lambda s: s[char_col]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return out.withColumn("block", F.row_number().over(Window.partitionBy(doc_col).orderBy("start"))).drop("_b")


def span_pages(spans: DataFrame, blocks: DataFrame, doc_col: str, span_id: str, bin_chars: int = 2000) -> DataFrame:
    """(doc, span, page, x0, y0, x1, y1): for each span and page the box around the blocks it overlaps (half-open).

    A range join: both sides are cut into bins of bin_chars characters, so that within a document only neighbours meet; a pair
    is kept in the first bin that both share. bin_chars should be about the length of a long block.
    """
    cut = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_chars), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / bin_chars))))
    s = cut(spans.select(doc_col, span_id, "start", "end"))
    b = cut(blocks.select(doc_col, "page", F.col("start").alias("start"), F.col("end").alias("end"), "x0", "y0", "x1", "y1"))
    b = b.withColumnsRenamed({"start": "b_start", "end": "b_end"})
    hit = s.join(b, [doc_col, "_bin"]).where(
        (F.col("b_start") < F.col("end")) & (F.col("b_end") > F.col("start")) & (F.col("_bin") == F.greatest(F.floor(F.col("start") / bin_chars), F.floor(F.col("b_start") / bin_chars)))
    )
    return hit.groupBy(doc_col, span_id, "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


# Notations in which a date is looked for, and those in which it may be given.
DATE_OUT = ("%B %d, %Y", "%B %d,%Y", "%b %d, %Y", "%d %B %Y", "%d.%m.%Y", "%d-%m-%Y", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%d %b %Y")
DATE_IN = ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d-%m-%Y", "%m/%d/%Y")
EXCERPT = T.StructType([T.StructField("excerpt", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def date_forms(value: str) -> list[str]:
    """A date in all notations of DATE_OUT; empty for anything else."""
    for fmt in DATE_IN:
        try:
            day = datetime.strptime(value, fmt)
        except ValueError:
            continue
        return [day.strftime(f) for f in DATE_OUT]
    return []


def squash_with_offsets(text: str) -> tuple[str, list[int]]:
    """The text with single spaces only, and the original offset of each of its characters."""
    words = list(re.finditer(r"\S+", text))
    at: list[int] = []
    for m in words:
        at += range(m.start(), m.end() + 1)
    return " ".join(m[0] for m in words), at[:-1]


def locate_value(text: str, value: str) -> tuple[int, int] | None:
    """(start, end) of a value: as it is, then case aside, then as a date in other notations, then, from four characters on, by
    likeness. White space counts as one space however much there is; offsets are those of the text as given."""
    needle = value.strip()
    if not needle or not text:
        return None
    flat, at = squash_with_offsets(text)

    def literal(form: str) -> tuple[int, int] | None:
        squashed = " ".join(form.split())
        if (i := text.find(form)) >= 0:
            return i, i + len(form)
        if (i := flat.find(squashed)) >= 0:
            return at[i], at[i + len(squashed) - 1] + 1
        if m := re.search(re.escape(form), text, re.I):
            return m.span()
        if m := re.search(re.escape(squashed), flat, re.I):
            return at[m.start()], at[m.end() - 1] + 1
        return None

    if span := literal(needle):
        return span
    for form in date_forms(needle):
        if span := literal(form):
            return span
    squashed = " ".join(needle.split())
    if len(squashed) >= 4 and (span := fuzzy_find(flat, squashed)):
        return at[span[0]], at[span[1] - 1] + 1
    return None


def _excerpt(text: str | None, value: str | None) -> tuple[str | None, int | None, int | None]:
    span = locate_value(text, value) if text and value else None
    if span is None:
        return None, None, None
    start, end = span
    line_start = text.rfind("\n", 0, start) + 1
    line_end = text.find("\n", end)
    line = text[line_start : len(text) if line_end < 0 else line_end].strip()
    if len(line) > 120:
        line = line[max(0, start - line_start - 30) : end - line_start + 30].strip()
    return line, start, end


def tight_excerpt(source: Column, value: Column) -> Column:
    """struct<excerpt, start, end>: the line around a value, cut to its neighbourhood over 120 characters; nulls where it is
    not found (locate_value)."""

    @F.pandas_udf(EXCERPT)
    def excerpts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, values in parts:
            out = pd.DataFrame([_excerpt(t, v) for t, v in zip(texts, values)], columns=EXCERPT.names)
            yield out.astype({"excerpt": object, "start": "Int32", "end": "Int32"})

    return excerpts(source, value)


RESOLVED = T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("resolution", T.StringType())]))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _end_distances(text: np.ndarray, excerpt: np.ndarray) -> np.ndarray:
    """For each end in text, the fewest insertions and deletions between the excerpt and any piece that ends there."""
    steps = np.arange(len(text) + 1, dtype=np.int32)
    row = np.zeros(len(text) + 1, np.int32)
    for c in excerpt:
        new = row + 1
        np.minimum(new[1:], np.where(text == c, row[:-1], row[1:] + 1), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return row


def fuzzy_find(text: str, excerpt: str, claimed: list[tuple[int, int]] = ()) -> tuple[int, int] | None:
    """Window of text that is most like an excerpt: 90 % for short excerpts, 80 % from 40 characters on.

    All windows from a fifth shorter to a fifth longer count; of equal ones the shortest, then the first. SequenceMatcher never
    matches more than the longest common subsequence, so a window can be left out where that is too short for the likeness
    asked or already reached: first by the best piece that ends or begins there, then by the window itself.
    """
    n = len(excerpt)
    if not n or not text:
        return None
    least = 0.90 if n < 40 else 0.80
    short, long = max(1, int(n * 0.8)), min(int(n * 1.2), len(text))
    if long < short:
        return None
    t, x = _codes(text), _codes(excerpt)
    at_end, at_start = _end_distances(t, x), _end_distances(t[::-1], x[::-1])[::-1]
    bound = lambda same, w: 2.0 * same / (n + w)
    free = np.ones(len(text) + 1, np.int64)
    for cs, ce in claimed:
        free[cs:ce] = 0
    taken = np.concatenate([[0], np.cumsum(1 - free[:-1])])
    windows = []
    for w in range(short, long + 1):
        fewest = np.maximum(at_start[: len(text) + 1 - w], at_end[w:])
        # at least |n - w| changes, and as many as make n + w - changes even
        same = (n + w - np.maximum(fewest, abs(n - w))) // 2
        ok = (2.0 * same / (n + w) >= least) & (taken[w:] == taken[: len(text) + 1 - w])
        windows += [(-bound(int(same[s]), w), w, int(s)) for s in np.flatnonzero(ok)]
    windows.sort()
    masks: dict[str, int] = {}
    for i, c in enumerate(excerpt):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << n) - 1
    common: dict[int, list[int]] = {}

    def subsequence(s: int, w: int) -> int:
        if s not in common:
            v, lengths = full, [0]
            for c in text[s : s + long]:
                u = v & masks.get(c, 0)
                v = ((v + u) | (v - u)) & full
                lengths.append(n - v.bit_count())
            common[s] = lengths
        return common[s][w]

    best: tuple[float, int, int] | None = None  # (-likeness, length, start)
    matcher = SequenceMatcher(None, excerpt, "", autojunk=False)
    for limit, w, s in windows:
        if best and limit > best[0]:
            break
        closest = (-bound(subsequence(s, w), w), w, s)
        if -closest[0] < least or best and closest >= best:
            continue
        matcher.set_seq2(text[s : s + w])
        r = matcher.ratio()
        if r >= least and (best is None or (-r, w, s) < best):
            best = (-r, w, s)
    return (best[2], best[2] + best[1]) if best else None


def resolve_evidence(text: Column, evidence: Column) -> Column:
    """Spans of excerpts (array<struct<field, excerpt>>), in field order: exact and not yet taken, else fuzzy, else unresolved."""

    @F.pandas_udf(RESOLVED)
    def resolve(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in parts:
            yield pd.Series([_resolve(t, e) for t, e in zip(texts, lists)])

    return resolve(text, evidence)


def _resolve(text, evidence) -> list[dict]:
    taken: list[tuple[int, int]] = []
    out = []
    for e in evidence if evidence is not None else ():
        span, how = None, "unresolved"
        excerpt = e["excerpt"]
        if text and excerpt:
            at = text.find(excerpt)
            while at >= 0 and any(at < ce and cs < at + len(excerpt) for cs, ce in taken):
                at = text.find(excerpt, at + 1)
            if at >= 0:
                span, how = (at, at + len(excerpt)), "exact"
            elif span := fuzzy_find(text, excerpt, taken):
                how = "fuzzy"
        if span:
            taken.append(span)
        out.append({"field": e["field"], "start": span[0] if span else None, "end": span[1] if span else None, "resolution": how})
    return out


def source_snippet(text: Column, needle: Column, context: int = 80) -> Column:
    """Squashed text around a needle whose white space and slashes may be spaced otherwise; null where it is missing."""
    flat = F.regexp_replace(squash(text), r"\s*/\s*", "/")
    wanted = F.regexp_replace(squash(needle), r"\s*/\s*", "/")
    at = F.instr(F.lower(flat), F.lower(wanted)) - 1
    low = F.greatest(at - context, F.lit(0))
    return F.when((at >= 0) & (wanted != ""), F.substring(flat, low + 1, at + F.char_length(wanted) + context - low))


def with_page_spans(mappings: DataFrame, offsets: DataFrame, doc_col: str) -> DataFrame:
    """Mappings (doc, start, end, ...) with pages: array<struct<page, start, end>>, the parts of each span by page, in characters of
    the page. offsets: (doc, page, start, end), as page_offsets gives them with its page column named page."""
    pages = offsets.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct("page", F.col("start").alias("s"), F.col("end").alias("e")))).alias("_pages"))
    joined = mappings.join(pages, doc_col, "left")
    inside = F.filter("_pages", lambda p: (p["s"] < F.col("end")) & (p["e"] > F.col("start")))
    parts = F.transform(inside, lambda p: F.struct(p["page"].alias("page"), (F.greatest(p["s"], F.col("start")) - p["s"]).alias("start"), (F.least(p["e"], F.col("end")) - p["s"]).alias("end")))
    return joined.withColumn("pages", F.coalesce(parts, F.expr("cast(array() as array<struct<page:int,start:bigint,end:bigint>>)"))).drop("_pages")


def source_block(fields: DataFrame, id_col: str, source: str, offsets: DataFrame | None = None) -> DataFrame:
    """(id, source_block): for each document the place of every field, array<struct<field, value, excerpt, start, end, page, grounded>>
    in the order of the fields. fields: (id, path, value, source text); offsets: (id, page, start, end) of the pages, if any."""
    found = fields.select(id_col, F.col("path").alias("field"), "value", tight_excerpt(F.col(source), F.col("value")).alias("x"))
    rows = found.select(id_col, "field", "value", F.col("x.excerpt").alias("excerpt"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    if offsets is not None:
        pages = offsets.select(id_col, "page", F.col("start").alias("_s"), F.col("end").alias("_e"))
        rows = rows.join(pages, (rows[id_col] == pages[id_col]) & (pages["_s"] <= rows["start"]) & (rows["start"] < pages["_e"]), "left").drop(pages[id_col]).drop("_s", "_e")
    else:
        rows = rows.withColumn("page", F.lit(None).cast("int"))
    entry = F.struct("field", "value", "excerpt", "start", "end", "page", F.col("start").isNotNull().alias("grounded"))
    return rows.groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("source_block"))


def layout_lines(words: DataFrame, doc_col: str, page_col: str, text_col: str, tolerance: float = 0.5) -> DataFrame:
    """(doc, page, line_no, text, y0, y1): boxes of words (x0, y0, x1, y1) grouped to lines and read from left to right.

    From the top down, a box begins a new line where its middle lies more than `tolerance` heights below that of the line before.
    Pages are folded within their row; a page's words are what one scanned page holds.
    """
    box = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("m"), "x0", (F.col("y1") - F.col("y0")).alias("h"), F.col(text_col).alias("t"), "y0", "y1")
    pages = words.where(F.col(text_col).isNotNull()).groupBy(doc_col, page_col).agg(F.array_sort(F.collect_list(box)).alias("w"))
    kind = "array<struct<m: double, h: double, words: array<struct<x0: double, t: string>>, y0: double, y1: double>>"
    one = lambda x: F.struct(x["m"].alias("m"), x["h"].alias("h"), F.array(F.struct(x["x0"].cast("double").alias("x0"), x["t"].alias("t"))).alias("words"), x["y0"].alias("y0"), x["y1"].alias("y1"))
    last = lambda acc: F.element_at(acc, -1)
    lines = F.aggregate(
        "w",
        F.expr(f"cast(array() as {kind})"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["m"] - last(acc)["m"] > tolerance * F.greatest(x["h"], last(acc)["h"])), F.concat(acc, F.array(one(x)))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                last(acc)["m"].alias("m"), F.greatest(last(acc)["h"], x["h"]).alias("h"), F.concat(last(acc)["words"], one(x)["words"]).alias("words"), F.least(last(acc)["y0"], x["y0"]).alias("y0"), F.greatest(last(acc)["y1"], x["y1"]).alias("y1")))),
        ),
    )
    rows = pages.select(doc_col, page_col, F.posexplode(lines).alias("line_no", "l"))
    return rows.select(doc_col, page_col, "line_no", F.array_join(F.transform(F.array_sort("l.words"), lambda x: x["t"]), " ").alias("text"), "l.y0", "l.y1")
