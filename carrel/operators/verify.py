"""Verification of extractions and claims against their source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrel.functions.text import around, spans, squash, tokens, truncate, word_overlap


def field_verdicts(fields: DataFrame, id_col: str, source: str) -> DataFrame:
    """(id, path, value, status, severity, issue, excerpt) from rows (id, path, value, kind, source text).

    Numbers count where they stand as they are in the source ('12' also in '128'); texts of four letters or more where they
    stand case aside, or where 60 % of their words do; under 30 % is an issue. References, booleans and short texts are skipped.
    """
    rows = fields.where(~F.col("path").rlike(r"_refs?\b") & F.col("kind").isin("number", "string"))
    flat = squash(F.col(source))
    needle = squash(F.col("value"))
    rows = rows.where((F.col("kind") == "number") | (F.char_length(needle) >= 4))
    at = F.instr(F.lower(flat), F.lower(needle)) - 1
    overlap = word_overlap(needle, flat)
    number_found = F.contains(F.col(source), F.col("value"))
    status = (
        F.when(F.col("kind") == "number", F.when(number_found, "verified").otherwise("unsupported"))
        .when((at >= 0) | (overlap >= 0.6), "verified").when(overlap < 0.3, "unsupported").otherwise("not_checked")
    )
    out = rows.withColumn("status", status)
    issue = F.when(F.col("status") == "unsupported", F.when(F.col("kind") == "number", "value_not_found").otherwise("low_grounding"))
    return out.select(
        id_col, "path", truncate(F.col("value"), 120).alias("value"), "status", F.when(F.col("status") == "unsupported", "warning").otherwise("info").alias("severity"), issue.alias("issue"),
        F.when((F.col("kind") == "string") & (at >= 0), around(flat, at, at + F.char_length(needle), 40, 40)).alias("excerpt"),
    )


def extraction_reports(verdicts: DataFrame, id_col: str, bad_references: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(id, verdict, confidence, checked, grounded, issues); bad_references: (id, n) of invalid references, each an issue.

    Nothing to check is insufficient evidence with confidence 0; ids (a table with the id column) brings the documents whose
    extractions hold no field that can be checked. A critical issue contradicts.
    """
    agg = verdicts.groupBy(id_col).agg(
        F.count("*").alias("checked"), F.count(F.when(F.col("status") == "verified", 1)).alias("grounded"), F.count("issue").alias("issues"), F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("critical"),
    )
    if ids is not None:
        agg = ids.select(id_col).distinct().join(agg, id_col, "left").na.fill({"checked": 0, "grounded": 0, "issues": 0, "critical": False})
    if bad_references is not None:
        agg = agg.join(bad_references, id_col, "left").withColumn("issues", F.col("issues") + F.coalesce("n", F.lit(0))).drop("n")
    ratio = F.col("grounded") / F.greatest("checked", F.lit(1))
    cases = [
        (F.col("checked") == 0, F.lit("insufficient_evidence"), F.lit(0.0)), (F.col("issues") == 0, F.lit("verified"), F.least(F.lit(0.95), ratio)), (F.col("critical"), F.lit("contradicted"), F.lit(0.2)),
        (ratio >= 0.7, F.lit("verified"), F.greatest(F.lit(0.1), ratio)), (F.lit(True), F.lit("partially_supported"), F.greatest(F.lit(0.1), ratio)),
    ]
    pick = lambda k: F.coalesce(*[F.when(c[0], c[k]) for c in cases])
    return agg.select(id_col, pick(1).alias("verdict"), F.round(pick(2), 3).alias("confidence"), "checked", "grounded", "issues")


def invalid_references(impressions: Column, findings: Column) -> Column:
    """Number of finding_refs that point behind the findings."""
    return F.aggregate(impressions, F.lit(0), lambda n, i: n + F.size(F.filter(F.coalesce(i["finding_refs"], F.array().cast("array<int>")), lambda r: r >= F.size(findings))))


def claim_check(claim: Column, source: Column) -> Column:
    """struct<verdict, confidence, missing>: verified if all numbers stand in the source and over half of the words do."""
    numbers = F.regexp_extract_all(claim, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    missing = F.filter(numbers, lambda n: ~F.contains(source, n))
    ratio = word_overlap(claim, source)
    good = (F.size(missing) == 0) & (ratio > 0.5)
    return F.struct(
        F.when(good, "verified").when(ratio > 0.3, "partially_supported").otherwise("insufficient_evidence").alias("verdict"),
        F.round(F.when(good, F.least(F.lit(0.95), ratio)).otherwise(ratio), 6).alias("confidence"), missing.alias("missing"),
    )


# Other names of statuses.
STATUS_NAMES = {
    "supported": "verified", "confirmed": "verified", "match": "verified", "correct": "verified", "verified": "verified", "mismatch": "mismatch", "contradicted": "mismatch", "incorrect": "mismatch", "conflict": "mismatch",
    "unsupported": "unsupported", "not_found": "unsupported", "missing": "unsupported",
}


def status_name(status: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(status)), r"[\s-]+", "_")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_NAMES.items() for x in kv])[key], F.lit("unsupported"))


def merged_report(statuses: DataFrame, id_col: str) -> DataFrame:
    """(id, verdict, confidence) of several checks: a mismatch contradicts, an unsupported field lowers, else it is verified."""
    agg = statuses.groupBy(id_col).agg(F.bool_or(F.col("status") == "mismatch").alias("bad"), F.bool_or(F.col("status") == "unsupported").alias("weak"), F.avg(F.when(F.col("status") == "verified", 1.0).otherwise(0.0)).alias("r"))
    return agg.select(
        id_col, F.when(F.col("bad"), "contradicted").when(F.col("weak"), "partially_supported").otherwise("verified").alias("verdict"),
        F.round(F.when(F.col("bad"), F.least(F.col("r"), F.lit(0.2))).when(F.col("weak"), F.least(F.col("r"), F.lit(0.6))).otherwise(F.greatest(F.col("r"), F.lit(0.85))), 6).alias("confidence"),
    )


# Field names whose errors matter most.
HIGH_RISK = ("measurement", "value", "size", "diagnosis", "severity", "laterality", "dose")


def high_risk_fields(fields: DataFrame, id_col: str, most: int = 8) -> DataFrame:
    """Fields of risky names; where an id has none, its first numbers and long texts."""
    words = F.split(F.lower(F.regexp_replace("path", r"[^A-Za-z0-9]+", "_")), "_")
    named = F.arrays_overlap(words, F.array(*[F.lit(w) for w in HIGH_RISK]))
    rows = fields.withColumn("named", named).withColumn("any_named", F.max("named").over(Window.partitionBy(id_col)))
    kept = rows.where(F.col("named") | (~F.col("any_named") & ((F.col("kind") == "number") | (F.char_length("value") >= 20))))
    turn = F.row_number().over(Window.partitionBy(id_col).orderBy("path", "value"))
    return kept.withColumn("turn", turn).where(F.col("named") | (F.col("turn") <= most)).select(id_col, "path", "value", "kind")


def value_comparison(claimed: Column, found: Column) -> Column:
    """match, conflict or unclear of two value texts: a blood pressure each, else their numbers in order."""
    bp = r"(\d{2,3})\s*/\s*(\d{2,3})"
    pair = lambda t: F.when(t.rlike(bp), F.concat_ws("/", F.regexp_extract(t, bp, 1), F.regexp_extract(t, bp, 2)))
    nums = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: n.cast("double"))
    a, b = pair(claimed), pair(found)
    x, y = nums(claimed), nums(found)
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "match").otherwise("conflict"))
        .when((F.size(x) > 0) & (F.size(y) > 0), F.when(x == y, "match").otherwise("conflict"))
        .otherwise("unclear")
    )


def blood_pressure_near(text: Column, claim: Column) -> Column:
    """The blood pressure of a text that a claim most likely means: by the words within 72 characters of it and by the claim's own
    figures; the first of equals, null where there is none."""
    pattern = r"\b\d{2,3}\s*/\s*\d{2,3}\b"
    plain = lambda v: F.regexp_replace(v, r"\s+", "")
    own = F.nullif(plain(F.regexp_extract(claim, pattern, 0)), F.lit(""))
    half = lambda v, k: F.split_part(v, F.lit("/"), F.lit(k))

    def scored(s: Column, i: Column) -> Column:
        low = F.greatest(s["start"] - 72, F.lit(0))
        near = F.lower(F.substring(text, low + 1, s["end"] + 72 - low))
        holds = lambda *marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(near, m))
        value = plain(s["value"])
        points = F.when(F.contains(near, F.lit("blood pressure")) | near.rlike(r"\bbp\b"), 5).otherwise(0) + F.when(holds("vital", "reading", "measured", "measurement", "status"), 2).otherwise(0) - F.when(holds("normal range", "reference", "target", "goal"), 2).otherwise(0)
        same = F.when(half(value, 2) == half(own, 2), 2).otherwise(0) + F.when(half(value, 1) == half(own, 1), 1).otherwise(0) + F.when(value == own, 3).otherwise(0)
        return F.struct((points + F.when(own.isNotNull(), same).otherwise(0)).alias("points"), (-i).alias("neg"), value.alias("value"))

    return F.array_max(F.transform(spans(text, pattern), scored))["value"]


# How deep a check goes.
VERIFY_LEVELS = ("quick", "standard", "thorough")


def verify_claims(rows: DataFrame, id_col: str, claim: str, source: str, level: str = "quick") -> DataFrame:
    """(id, verdict, confidence, level) of claims against their sources. The deeper levels need a language model: without one they
    give what 'quick' gives and say so; an unknown level is a ValueError."""
    if level not in VERIFY_LEVELS:
        raise ValueError(f"unknown level {level!r}; one of {', '.join(VERIFY_LEVELS)}")
    return rows.select(id_col, claim_check(F.col(claim), F.col(source)).alias("c")).select(id_col, "c.verdict", "c.confidence", F.lit("quick" if level == "quick" else f"{level}: quick only").alias("level"))


def final_decision(verdict: Column, confidence: Column, comparison: Column, critical_issue: Column, grounded: Column) -> Column:
    """struct<verdict, confidence, support_score, claim_is_true> after the comparison of values."""
    v = (
        F.when(comparison == "conflict", "contradicted")
        .when((comparison == "match") & ~critical_issue, "verified")
        .when(verdict.isin("verified", "contradicted") & ~grounded, "insufficient_evidence")
        .otherwise(verdict)
    )
    c = F.when(comparison == "conflict", F.least(confidence, F.lit(0.2))).when((comparison == "match") & ~critical_issue, F.greatest(confidence, F.lit(0.85))).otherwise(confidence)
    support = F.when(v == "verified", 1.0).when(v == "partially_supported", 0.5).when(v == "insufficient_evidence", 0.25).otherwise(0.0)
    true = F.when(v == "verified", True).when(v == "contradicted", False)
    return F.struct(v.alias("verdict"), c.alias("confidence"), support.alias("support_score"), true.alias("claim_is_true"))


# Worth of the parts of a report as citations.
CITATION_WORTH = {"issue": 96, "mismatch": 92, "verified": 92, "evidence": 86, "field": 74, "source": 60}


def verification_citations(parts: DataFrame, top_k: int = 8, prefix: int = 180) -> DataFrame:
    """The best distinct citations of rows (source, snippet, part, score): worth of the part plus score, equal starts once."""
    worth = F.coalesce(F.create_map(*[F.lit(x) for kv in CITATION_WORTH.items() for x in kv])[F.col("part")], F.lit(50))
    rows = parts.withColumn("rank", worth + F.coalesce("score", F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("source", F.substring("snippet", 1, prefix)).orderBy(F.desc("rank"), "snippet"))
    return rows.withColumn("turn", turn).where("turn = 1").drop("turn").orderBy(F.desc("rank"), "source", "snippet").limit(top_k)


def combined_sources(docs: DataFrame, group_col: str, order_col: str, text_col: str) -> DataFrame:
    """(group, text): several sources of one case as one text, in order."""
    rows = docs.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct(order_col, F.col(text_col).alias("t")))).alias("p"))
    return rows.select(group_col, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def lenient_json(text: Column) -> Column:
    """The variant in a text that may fence or surround it; null where there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    block = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(block, "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    tries = [F.try_parse_json(t) for t in (text, fenced, block, F.regexp_replace(quoted, r"\bNone\b", "null"))]
    return reduce(lambda a, b: F.coalesce(a, b), [F.when(F.trim(t) != "", p) for t, p in zip((text, fenced, block, block), tries)])
