"""Report structure: sections, labelled blocks, complexity, routed context, label matching."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrel.functions.text import MATCH_STOPWORDS, NULLISH, tokens

# Headings of report sections and the shape of a labelled line.
HEADINGS = r"clinical information|clinical history|history|indication|comparison|technique|procedure information|findings?|impression|diagnosis|assessment|plan|recommendation"
HEADER = rf"(?i)^\s*(?:{HEADINGS})s?\s*:?\s*$"
LABEL = r"^\s*([A-Za-z][A-Za-z0-9()/%&,\-'\s]{1,96}?)\s*:\s*(.*)$"


def sections(docs: DataFrame, id_col: str, text_col: str, most: int = 10) -> DataFrame:
    """(id, section_no, name, title, text): text under headings that stand alone on a line.

    A text without headings is one section 'document'; beyond `most` sections the rest is one 'remaining_sections'. Lines are
    folded within their row, so nothing is shuffled.
    """
    lines = F.split(F.col(text_col), r"\r\n|\n|\r")
    groups = F.aggregate(
        lines,
        F.expr("array(named_struct('title', 'Document', 'lines', cast(array() as array<string>)))"),
        lambda acc, line: F.when(
            line.rlike(HEADER),
            F.concat(acc, F.array(F.struct(F.initcap(F.trim(F.regexp_replace(F.trim(line), r":\s*$", ""))).alias("title"), F.expr("cast(array() as array<string>)").alias("lines")))),
        ).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["title"].alias("title"), F.concat(F.element_at(acc, -1)["lines"], F.array(line)).alias("lines"))))
        ),
    )
    made = F.transform(groups, lambda g: F.struct(g["title"].alias("title"), F.regexp_replace(F.array_join(g["lines"], "\n"), r"(?U)^\s+|\s+$", "").alias("text")))
    full = F.filter(made, lambda s: s["text"] != "")
    kept = F.when(F.size("s") <= most, F.col("s")).otherwise(
        F.concat(F.slice("s", 1, most - 1), F.array(F.struct(
            F.lit("Remaining Sections").alias("title"),
            F.array_join(F.transform(F.slice("s", F.lit(most), F.size("s")), lambda x: F.concat(x["title"], F.lit("\n"), x["text"])), "\n\n").alias("text"))))
    )
    name = lambda t: F.regexp_replace(F.lower(F.regexp_replace(t, r"[^a-zA-Z0-9]+", "_")), "^_|_$", "")
    rows = docs.select(F.col(id_col), full.alias("s")).select(id_col, F.posexplode(kept).alias("section_no", "x"))
    return rows.select(id_col, "section_no", name(F.col("x.title")).alias("name"), F.col("x.title").alias("title"), F.col("x.text").alias("text"))


def labelled_blocks(docs: DataFrame, id_col: str, text_col: str, most: int = 256) -> DataFrame:
    """(id, block_no, label, value) of 'Label: value' lines with the lines that go on from them; empty and null-like values are out."""
    lines = F.transform(F.split(F.col(text_col), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    blocks = F.aggregate(
        lines,
        F.expr("cast(array() as array<struct<label: string, value: string>>)"),
        lambda acc, x: F.when(
            x.rlike(LABEL), F.concat(acc, F.array(F.struct(F.trim(F.regexp_extract(x, LABEL, 1)).alias("label"), F.trim(F.regexp_extract(x, LABEL, 2)).alias("value"))))
        ).when(
            (F.size(acc) > 0) & (x != ""),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["label"].alias("label"), F.trim(F.concat_ws(" ", F.element_at(acc, -1)["value"], x)).alias("value")))),
        ).otherwise(acc),
    )
    good = F.slice(F.filter(blocks, lambda b: ~F.lower(b["value"]).isin(*NULLISH)), 1, most)
    rows = docs.select(F.col(id_col), F.posexplode(good).alias("block_no", "b"))
    return rows.select(id_col, "block_no", F.col("b.label").alias("label"), F.col("b.value").alias("value"))


def complexity(text: Column) -> Column:
    """easy, moderate or hard, by words, digits, measures and tables."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    digits = F.regexp_count(text, F.lit(r"\d"))
    measured = text.rlike(r"(?i)\b\d+(\.\d+)?\s*(mm|cm|kg|mg|ml|%|x10\^?\d+)\b")
    tabular = text.rlike(r"\b[A-Za-z_]+\s*\|\s*[A-Za-z_]+")
    return F.when((words <= 70) & (digits <= 20) & ~measured & ~tabular, "easy").when((words >= 260) | (digits >= 80) | measured | tabular, "hard").otherwise("moderate")


def strategy(hint: Column) -> Column:
    return F.when(hint == "easy", "deterministic").when(hint == "moderate", "constrained_extract").otherwise("heavy_extract")


def routed_context(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, context, original_chars, planned_chars, compression_ratio): sections shortened by their strategy, titles kept."""
    parts = sections(docs, id_col, text_col).withColumn("strategy", strategy(complexity(F.col("text"))))
    body = F.when(F.col("strategy") == "deterministic", F.substring("text", 1, 500)).when(F.col("strategy") == "constrained_extract", F.substring("text", 1, 2000)).otherwise(F.col("text"))
    body = F.regexp_replace(body, rf"(?i)^\s*(?:{HEADINGS})s?\s*:\s+", "")
    made = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("section_no", F.concat("title", F.lit(":\n"), F.trim(body)).alias("t")))).alias("p"))
    joined = made.select(id_col, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("context")).join(docs.select(id_col, F.char_length(text_col).alias("original_chars")), id_col)
    return joined.withColumn("planned_chars", F.char_length("context")).withColumn("compression_ratio", F.round(F.col("planned_chars") / F.col("original_chars"), 6))


def focused_context(docs: DataFrame, id_col: str, text_col: str, fields: list[str], budget: int = 4000, most: int = 6, least: float = 0.18) -> DataFrame:
    """(id, context): the sections that share most words with the wanted fields, within a budget, in their order."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(w for f in fields for w in f.lower().replace("_", " ").split() if w not in MATCH_STOPWORDS)])
    scored = sections(docs, id_col, text_col).withColumn("held", F.array_distinct(F.concat(tokens(F.col("title")), tokens(F.col("text")))))
    scored = scored.withColumn("score", F.size(F.array_intersect(wanted, F.col("held"))) / F.size(wanted)).where(F.col("score") >= least)
    ranked = scored.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "section_no", "title", "text"))).alias("r"))
    chosen = F.aggregate(
        F.slice("r", 1, most),
        F.expr("named_struct('used', 0, 'take', cast(array() as array<struct<section_no: int, text: string>>))"),
        lambda acc, x: F.when(acc["used"] + F.char_length(x["text"]) > budget, acc).otherwise(
            F.struct((acc["used"] + F.char_length(x["text"])).alias("used"), F.concat(acc["take"], F.array(F.struct(x["section_no"].alias("section_no"), F.concat(x["title"], F.lit(":\n"), x["text"]).alias("text")))).alias("take"))
        ),
        lambda acc: acc["take"],
    )
    return ranked.select(id_col, F.array_join(F.transform(F.array_sort(chosen), lambda x: x["text"]), "\n\n").alias("context"))


def label_score_text(field: str, label: str) -> float:
    """How well a label names a field: shared words against both sides, or the likeness of their sorted words."""
    import re

    a = {t for t in re.findall("[a-z0-9]+", (field or "").lower()) if t not in MATCH_STOPWORDS}
    b = {t for t in re.findall("[a-z0-9]+", (label or "").lower()) if t not in MATCH_STOPWORDS}
    shared = len(a & b)
    if not shared:
        return 0.0
    x, y = "_".join(sorted(a)), "_".join(sorted(b))
    if x == y:
        return 1.0
    score = max(0.7 * shared / len(a) + 0.3 * shared / len(a | b), 0.8 * SequenceMatcher(None, x, y).ratio())
    return min(1.0, max(score, 0.92) if x in y or y in x else score)


def label_score(field: Column, label: Column) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([label_score_text(x, y) for x, y in zip(a, b)], dtype="float64")

    return score(field, label)


def backfill(docs: DataFrame, id_col: str, text_col: str, fields: list[str], least: float = 0.72, least_section: float = 0.84) -> DataFrame:
    """(id, field, label, value, score): for each field the labelled block that names it best, the first of equals; where none
    reaches `least`, the section whose title reaches least_section.

    This is the default provider of extractions where no language model is plugged in. A document's blocks meet the fixed list
    of fields; documents never meet each other.
    """
    blocks = labelled_blocks(docs, id_col, text_col).withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))
    # blocks that share no word score 0: they never reach Python
    near = blocks.where(F.size(F.array_intersect(tokens(F.col("field")), tokens(F.col("label")))) > 0)
    scored = near.withColumn("score", label_score(F.col("field"), F.col("label"))).where(F.col("score") >= least)
    parts = sections(docs, id_col, text_col).where("name <> 'document'").select(id_col, F.col("title").alias("label"), F.col("text").alias("value"), (F.col("section_no") + 1_000_000).alias("block_no"), F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    parts = parts.where(F.size(F.array_intersect(tokens(F.col("field")), tokens(F.col("label")))) > 0).withColumn("score", label_score(F.col("field"), F.col("label"))).where(F.col("score") >= least_section)
    scored = scored.select(id_col, "field", "label", "value", "block_no", "score", F.lit(1).alias("tier")).unionByName(parts.select(id_col, "field", "label", "value", "block_no", "score", F.lit(0).alias("tier")))
    best = scored.groupBy(id_col, "field").agg(F.max(F.struct("tier", "score", (-F.col("block_no")).alias("neg"), "label", "value")).alias("m"))
    return best.select(id_col, "field", "m.label", "m.value", F.round("m.score", 6).alias("score"))
