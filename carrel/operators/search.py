"""Text retrieval: documents and chunks ranked by term counts, phrases, numbers, citations and their confidence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrel.functions.text import around, chunks, question_terms, spans, squash, term_hits, terms


def term_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n, docs): how often each stemmed term occurs and in how many rows."""
    # all terms of a row and its different ones side by side: one shuffle of partial sums
    rows = docs.select(terms(F.col(text_col)).alias("t"))
    lists = F.array(F.struct(F.lit(False).alias("once"), F.col("t").alias("t")), F.struct(F.lit(True).alias("once"), F.array_distinct("t").alias("t")))
    each = rows.select(F.explode(lists).alias("x")).select("x.once", F.explode("x.t").alias("term"))
    return each.groupBy("term").agg(F.count_if(~F.col("once")).alias("n"), F.count_if("once").alias("docs"))


def document_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1800, overlap: int = 220) -> DataFrame:
    """(id, chunk_id, start, end, char_count, text)."""
    rows = docs.select(F.col(id_col), F.inline(chunks(F.col(text_col), size, overlap)))
    return rows.select(id_col, "chunk_id", "start", "end", F.char_length("text").alias("char_count"), "text")


def list_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1800, overlap: int = 220) -> DataFrame:
    """(source, chunk_id, start, end, char_count, preview): the chunks with their first 120 characters."""
    rows = document_chunks(docs, id_col, text_col, size, overlap)
    return rows.select(F.col(id_col).alias("source"), "chunk_id", "start", "end", "char_count", F.substring(squash(F.col("text")), 1, 120).alias("preview"))


def get_chunk(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(source, chunk_id, start, end, char_count, text, error) for each row (source, chunk_id) of wanted; error is
    'chunk_not_found' and the rest null where there is none."""
    chunks_ = document_chunks(docs, id_col, text_col).withColumnRenamed(id_col, "source")
    out = wanted.select("source", "chunk_id").join(chunks_, ["source", "chunk_id"], "left")
    return out.select("source", "chunk_id", "start", "end", "char_count", "text", F.when(F.col("text").isNull(), "chunk_not_found").alias("error"))


def _anchor(term_array: Column, wanted: list[str]) -> Column:
    """The wanted term that occurs most often, the first of equals."""
    counted = F.array(*[F.struct(term_hits(term_array, [t]).alias("n"), F.lit(-i).alias("neg"), F.lit(t).alias("term")) for i, t in enumerate(wanted)])
    return F.array_max(counted)["term"]


def search_documents(docs: DataFrame, id_col: str, text_col: str, query: str, top_k: int = 5) -> DataFrame:
    """(source, score, snippet, evidence_type) of the best documents, ties by id; the snippet is the first line with most hits."""
    wanted = question_terms(query)
    scored = docs.select(F.col(id_col).alias("source"), F.col(text_col).alias("text"), term_hits(terms(F.col(text_col)), wanted).alias("score")).where("score > 0")
    best = scored.orderBy(F.desc("score"), "source").limit(max(1, top_k))
    lines = F.transform(F.split("text", r"\R"), lambda x: squash(x))
    ranked = F.transform(lines, lambda x, i: F.struct(term_hits(terms(x), wanted).alias("n"), (-i).alias("neg"), x.alias("line")))
    return best.select("source", "score", F.array_max(ranked)["line"].alias("snippet"), F.lit("text").alias("evidence_type"))


def search_chunks(docs: DataFrame, id_col: str, text_col: str, query: str, top_k: int = 8, size: int = 1800, overlap: int = 220) -> DataFrame:
    """(source, chunk_id, start, end, score, snippet, evidence_type) of the best chunks; the snippet surrounds the anchor term."""
    wanted = question_terms(query)
    parts = document_chunks(docs, id_col, text_col, size, overlap).withColumn("score", term_hits(terms(F.col("text")), wanted)).where("score > 0")
    best = parts.orderBy(F.desc("score"), id_col, "chunk_id").limit(max(1, top_k)).withColumn("anchor", _anchor(terms(F.col("text")), wanted))
    at = F.regexp_instr("text", F.concat(F.lit(r"(?i)\b"), F.col("anchor"), F.lit(r"s?\b"))) - 1
    snippet = F.when(at >= 0, around(F.col("text"), at, at + F.char_length("anchor"), 140, 280)).otherwise(squash(F.substring("text", 1, 360)))
    return best.select(F.col(id_col).alias("source"), "chunk_id", "start", "end", "score", snippet.alias("snippet"), F.lit("text_chunk").alias("evidence_type"))


def audit_chunks(docs: DataFrame, id_col: str, text_col: str, phrase: str, top_k: int = 12, context: int = 300) -> DataFrame:
    """Chunks by 8 x phrase + 2 x words covered + hits: (source, chunk_id, score, snippet), the snippet being half of `context` on
    each side of the phrase, or of the first word that stands in the chunk."""
    low_phrase = phrase.lower()
    wanted = list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", low_phrase) if len(w) >= 2))
    part = document_chunks(docs, id_col, text_col).withColumn("low", F.lower("text"))
    word = lambda t: rf"\b{re.escape(t)}\b"
    hits = reduce(lambda a, b: a + b, [F.regexp_count("low", F.lit(word(t))) for t in wanted], F.lit(0))
    covered = reduce(lambda a, b: a + b, [F.when(F.col("low").rlike(word(t)), 1).otherwise(0) for t in wanted], F.lit(0))
    phrase_at = F.instr("low", F.lit(low_phrase)) - 1
    score = 8 * F.when(phrase_at >= 0, 1).otherwise(0) + 2 * covered + hits
    first = F.coalesce(*[F.when(F.col("low").rlike(word(t)), F.struct((F.regexp_instr("low", F.lit(word(t))) - 1).alias("at"), F.lit(len(t)).alias("n"))) for t in wanted], F.struct(F.lit(0).alias("at"), F.lit(1).alias("n")))
    anchor = F.when(phrase_at >= 0, F.struct(phrase_at.alias("at"), F.lit(len(phrase)).alias("n"))).otherwise(first)
    best = part.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), id_col, "chunk_id").limit(top_k).withColumn("a", anchor)
    start = F.greatest(F.col("a.at") - context // 2, F.lit(0))
    return best.select(F.col(id_col).alias("source"), "chunk_id", "score", F.substring("text", start + 1, F.col("a.at") + F.col("a.n") + context // 2 - start).alias("snippet"))


def overlaps_itself(phrase: str) -> bool:
    """Whether two occurrences of a phrase can overlap: an end of it is also its beginning."""
    return any(phrase.startswith(phrase[k:]) for k in range(1, len(phrase)))


def phrase_positions(docs: DataFrame, id_col: str, text_col: str, phrase: str, most: int = 10, context: int = 150) -> DataFrame:
    """(source, start, snippet) of the first `most` occurrences of a phrase in each text, case aside; overlapping ones count."""
    low = phrase.lower()
    if overlaps_itself(low):
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(text_col) - len(low) + 1, F.lit(1))), lambda k: F.substring(F.lower(text_col), k, F.lit(len(low))) == low)
        found = F.transform(at, lambda k: (k - 1).cast("int"))
    else:
        found = F.transform(spans(F.lower(text_col), re.escape(low)), lambda s: s["start"])
    held = docs.where(F.contains(F.lower(text_col), F.lit(low))).select(F.col(id_col).alias("source"), F.col(text_col).alias("text"), F.explode(F.slice(found, 1, most)).alias("start"))
    return held.select("source", "start", around(F.col("text"), F.col("start"), F.col("start") + len(low), context, context).alias("snippet"))


# Numbers and the units looked for behind them, in the order in which they are tried.
NUMBER_UNIT = r"(\d+(?:\.\d+)?)\s*(mm|cm|m|kg|g|mg|ml|mL|%|years?|months?|days?|hours?|minutes?)?"


def number_inventory(docs: DataFrame, id_col: str, text_col: str, context: int = 80) -> DataFrame:
    """(source, ordinal, value, unit, context): each number of a text with its unit (empty without one) where it first stands.

    A unit is read as the first of the list that fits, so 'mg' and 'months' come out as 'm', as the reference has it.
    """
    rows = docs.select(F.col(id_col).alias("source"), F.col(text_col).alias("text"), F.posexplode(spans(F.col(text_col), NUMBER_UNIT)).alias("pos", "s"))
    rows = rows.select(
        "source", "pos", F.regexp_extract("s.value", NUMBER_UNIT, 1).alias("value"), F.regexp_extract("s.value", NUMBER_UNIT, 2).alias("unit"),
        F.substring("text", F.greatest(F.col("s.start") - context, F.lit(0)) + 1, F.col("s.end") + context - F.greatest(F.col("s.start") - context, F.lit(0))).alias("context"),
    )
    first = rows.groupBy("source", "value", "unit").agg(F.min(F.struct("pos", "context")).alias("f"))
    return first.select("source", F.col("f.pos").alias("ordinal"), "value", "unit", "f.context")


def merge_hits(parts: list[DataFrame], cap: int = 50, prefix: int = 180) -> DataFrame:
    """Hits of several searches in the order of the parts, a (source, start of snippet) only once, the first kept.

    Each part has source, snippet, score, evidence_type.
    """
    columns = ["source", "snippet", "score", "evidence_type"]
    tagged = [p.select(F.col("source").cast("string").alias("source"), *columns[1:], F.lit(i).alias("part")) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    order = Window.partitionBy("source", F.substring("snippet", 1, prefix)).orderBy("part", F.desc("score"), "snippet")
    kept = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    return kept.orderBy("part", F.desc("score"), "source", "snippet").limit(cap).drop("n")


# Worth of each kind of evidence, words that do not count in citations, and titles that say nothing.
EVIDENCE_WORTH = {"table_stat": 30, "table_sql": 28, "table_value": 26, "table_schema": 22, "table_column": 18, "text_chunk": 16, "table_row": 14}
CITATION_STOPWORDS = (
    "the a an and or of in on to for with is are was were be been being what which who whom when where why how does do did please show tell about can you your my me from that this those these there their them "
    "report reports patient study scan ct mri kind used use throughout across overall imaging image images imaged"
).split()
EMPTY_TITLES = ("radiology report", "follow-up radiology report", "ct chest/abdomen/pelvis with contrast")
TABLE_EVIDENCE = ("table_stat", "table_sql", "table_value", "table_schema", "table_column", "table_row")


def citation_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) >= 3 and w not in CITATION_STOPWORDS))


def ranked_citations(hits: DataFrame, question: str, top_k: int = 8, focus_source: str = "", focus_column: str = "", delta: bool = False) -> DataFrame:
    """Hits with their rank: 20 for each word of the question + score (12 at most) + worth of the evidence + 12 for millimetres + 5
    for a day, less 8 for a short snippet without either and 20 for an empty title; negative ranks are out.

    focus_source: +10 for evidence of that table, -18 for that of others; focus_column: +22 and -35 where hits have a column;
    delta: -25 for a snippet without millimetres, negative ranks out again.
    """
    wanted = F.array(*[F.lit(w) for w in citation_words(question)]).cast("array<string>")
    worth = F.coalesce(F.create_map(*[F.lit(x) for kv in EVIDENCE_WORTH.items() for x in kv])[F.col("evidence_type")], F.lit(0))
    text = squash(F.col("snippet"))
    has_mm, has_day = F.lower(text).rlike(r"\b\d+(?:\.\d+)?\s*mm\b"), text.rlike(r"\b\d{4}-\d{2}-\d{2}\b")
    held = F.size(F.array_intersect(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), wanted))
    rank = 20 * held + F.least("score", F.lit(12)) + worth + F.when(has_mm, 12).otherwise(0) + F.when(has_day, 5).otherwise(0)
    rank = rank - F.when((F.char_length(text) < 26) & ~has_mm & ~has_day, 8).otherwise(0) - F.when(F.lower(text).isin(*EMPTY_TITLES), 20).otherwise(0)
    rows = hits.where(text != "").withColumn("rank", rank.cast("int")).where("rank >= 0")
    if focus_source:
        rows = rows.withColumn("rank", F.col("rank") + F.when(~F.col("evidence_type").isin(*TABLE_EVIDENCE), 0).when(F.col("source") == focus_source, 10).otherwise(-18))
    if focus_column and "column" in hits.columns:
        named = F.col("evidence_type").isin("table_stat", "table_value", "table_column") & (F.coalesce("column", F.lit("")) != "")
        rows = rows.withColumn("rank", F.col("rank") + F.when(named & (F.col("column") == focus_column), 22).when(named, -35).otherwise(0))
    if delta:
        rows = rows.withColumn("rank", F.col("rank") - F.when(has_mm, 0).otherwise(25)).where("rank >= 0")
    return rows.orderBy(F.desc("rank"), F.desc("score"), "source", "snippet").limit(top_k)


def diverse_citations(ranked: DataFrame, top_k: int = 5, forced: tuple[str, ...] = ()) -> DataFrame:
    """First the best hit of each kind of evidence that is forced, then that of every source, then the rest by rank."""
    by = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy(F.desc("rank"), "source", "snippet"))
    must = F.when(F.col("evidence_type").isin(*forced) & (by("evidence_type") == 1), -1) if forced else F.lit(None)
    turned = ranked.withColumn("turn", F.coalesce(must, F.when(by("source") == 1, 0).otherwise(1)))
    return turned.orderBy("turn", F.desc("rank"), "source", "snippet").limit(top_k).drop("turn")


def citation_confidence(citations: DataFrame, question: str, answer: str) -> DataFrame:
    """One row (confidence): .25 rank/30 + .25 question covered + .35 answer supported + .15 sources, within 0 and 1."""
    q, a = question_terms(question, expand=False), question_terms(answer, expand=False)
    share = lambda wanted: (F.size(F.array_intersect(F.col("held"), F.array(*[F.lit(t) for t in wanted]).cast("array<string>"))) / max(1, len(wanted))) if wanted else F.lit(0.0)
    all_terms = citations.agg(F.array_distinct(F.flatten(F.collect_list(terms(F.col("snippet"))))).alias("held"), F.max("rank").alias("rank"), F.countDistinct("source").alias("sources"), F.count("*").alias("n"))
    value = 0.25 * F.least(F.coalesce("rank", F.lit(0)) / 30, F.lit(1.0)) + 0.25 * share(q) + 0.35 * share(a) + 0.15 * F.least(F.col("sources") / 2, F.lit(1.0))
    return all_terms.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6).alias("confidence"))


def literal_support(snippets: DataFrame, values: list[str]) -> DataFrame:
    """One row (support): share of the literal values that stand in any snippet."""
    if not values:
        return snippets.limit(0).agg(F.lit(0.0).alias("support"))
    flags = [F.max(F.when(F.contains(F.lower("snippet"), F.lit(v.lower())), 1).otherwise(0)) for v in values]
    return snippets.agg((reduce(lambda a, b: a + b, flags) / len(values)).alias("support"))


# Measures of findings with dates.
MEASURE = r"(\d+(?:\.\d+)?)\s*(mm|cm)\b"


def dated_measures(docs: DataFrame, id_col: str, text_col: str, date_col: str) -> DataFrame:
    """(source, day, mm): lengths in millimetres of dated texts, equal ones once."""
    hit = docs.select(F.col(id_col).alias("source"), F.to_date(date_col).alias("day"), F.explode(F.regexp_extract_all(text_col, F.lit(MEASURE), F.lit(0))).alias("h"))
    mm = F.round(F.regexp_extract("h", MEASURE, 1).cast("double") * F.when(F.regexp_extract("h", MEASURE, 2) == "cm", 10).otherwise(1), 4)
    return hit.select("source", "day", mm.alias("mm")).distinct()


def measure_delta(measures: DataFrame) -> DataFrame:
    """(first_day, last_day, first_mm, last_mm, delta) between the earliest and the latest measure; the largest counts of one day."""
    return measures.agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min_by("mm", F.struct("day", -F.col("mm"))).alias("first_mm"), F.max_by("mm", F.struct("day", "mm")).alias("last_mm"),
    ).withColumn("delta", F.round(F.col("last_mm") - F.col("first_mm"), 4))


