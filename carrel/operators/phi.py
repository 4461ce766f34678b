"""De-identification by patterns: spans with offsets, greedy merge, redaction, leak check, summaries, alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrel.functions.text import spans

REDACTED = "[REDACTED]"
# Kind and pattern of each identifier, in the order in which they are applied (Java syntax; (?U) makes \w, \d and \b
# follow Unicode).
PATTERNS: list[tuple[str, str]] = [
    ("SSN", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("PHONE", r"(?U)\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"),
    ("MRN", r"(?iU)\bMRN\s*:?\s*\d{6,}\b"),
    ("EMAIL", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("DATE", r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b"),
    ("DATE", r"(?U)\b\d{1,2}\.\d{1,2}\.\d{2,4}\b"),
    ("DATE", r"(?U)\b\d{4}-\d{1,2}-\d{1,2}\b"),
    ("DATE", r"(?iuU)\b\d{1,2}\.(?:Jan|Feb|Mär|Mar|Apr|Mai|May|Jun|Jul|Aug|Sep|Okt|Oct|Nov|Dez|Dec)\.\d{2,4}\b"),
]
#: Registry of rule sets: name to (kind, pattern) pairs; further sets may be registered.
RULE_SETS: dict[str, list[tuple[str, str]]] = {"default": PATTERNS, "hipaa": PATTERNS}
SPAN = "array<struct<start:int,end:int,value:string,kind:string>>"


# Kinds of identifiers that a rule set of this standard covers.
HIPAA_CATEGORIES = "NAME DATE AGE ADDRESS ZIP PHONE FAX EMAIL URL SSN MRN ID ACCOUNT LICENSE INSURANCE CERTIFICATE DEVICE_ID IP_ADDRESS BIOMETRIC PHOTO OTHER".split()
CATEGORIES: dict[str, list[str]] = {"default": sorted({k for k, _ in PATTERNS}), "hipaa": HIPAA_CATEGORIES}
#: What a de-identification may do: patterns alone, or patterns and values found by a provider, both replaced by the placeholder.
REDACTION_MODES = ("remove", "regex")


def register_rules(name: str, rules: list[tuple[str, str]], categories: list[str] | None = None) -> None:
    RULE_SETS[name] = rules
    CATEGORIES[name] = categories or sorted({k for k, _ in rules})


def get_rules(name: str) -> list[tuple[str, str]]:
    """The patterns of a rule set; an unknown name is a KeyError that lists the known ones."""
    if name not in RULE_SETS:
        raise KeyError(f"unknown rule set {name!r}; there are {', '.join(list_rules())}")
    return RULE_SETS[name]


def list_rules() -> list[str]:
    return sorted(RULE_SETS)


def deidentify(text: Column, values: Column | None = None, mode: str = "remove", rules: str = "default") -> Column:
    """The text without identifiers. remove: given values and what the patterns find, each once, longer ones first, every
    occurrence case aside; regex: what the patterns find. Other modes are a ValueError."""
    if mode not in REDACTION_MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(REDACTION_MODES)}")
    found = get_rules(rules)
    if mode == "regex":
        return scrub(text, found)
    all_values = F.concat(F.coalesce(values, F.expr("cast(array() as array<string>)")) if values is not None else F.expr("cast(array() as array<string>)"), F.transform(all_spans(text, found), lambda s: s["value"]))
    return redact_values(text, all_values)


def all_spans(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Every match of every pattern with its kind, overlapping ones included."""
    found = [F.transform(spans(text, p), _typed(k)) for k, p in (rules or PATTERNS)]
    return F.concat(*found)


def _typed(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("kind"))


def merge_spans(span_array: Column) -> Column:
    """Earliest first, of equal starts the longest; what starts inside a kept span is dropped."""
    ordered = F.array_sort(F.transform(span_array, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["value"].alias("value"), s["kind"].alias("kind"))))
    return F.aggregate(
        ordered,
        F.expr(f"cast(array() as {SPAN})"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]), acc).otherwise(
            F.concat(acc, F.array(F.struct(s["start"].alias("start"), (-s["neg"]).alias("end"), s["value"].alias("value"), s["kind"].alias("kind"))))
        ),
    )


def phi_spans(docs: DataFrame, id_col: str, text_col: str, rules: str = "default") -> DataFrame:
    """(id, start, end, original, replacement, phi_type, method): merged spans of each text. Null and empty texts have none."""
    rows = docs.select(F.col(id_col), F.explode(merge_spans(all_spans(F.col(text_col), get_rules(rules)))).alias("s"))
    return rows.select(id_col, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("original"), F.lit(REDACTED).alias("replacement"), F.col("s.kind").alias("phi_type"), F.lit("regex").alias("method"))


def scrub(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Patterns replaced one after the other, in their order."""
    return reduce(lambda t, kp: F.regexp_replace(t, kp[1], F.lit("[REDACTED]")), rules or PATTERNS, text)


def redact_spans(text: Column, span_array: Column, replacement: str = REDACTED) -> Column:
    """The text with merged spans replaced, built from the pieces between them."""
    built = F.aggregate(
        span_array,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(replacement)).alias("out"), s["end"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    return F.when(text.isNotNull(), built)


def leak_score(text: Column) -> Column:
    """1.0 if no pattern matches, else 0.0."""
    return F.when(reduce(lambda a, b: a | b, [text.rlike(p) for _, p in PATTERNS]), 0.0).otherwise(1.0)


def span_kind(value: Column) -> Column:
    """Kind of the first pattern that a value matches, else OTHER."""
    out = F.lit("OTHER")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(value.rlike(pattern), kind).otherwise(out)
    return out


def without_overlap(found: Column, taken: Column) -> Column:
    """The spans that overlap none of the taken ones."""
    return F.filter(found, lambda d: ~F.exists(taken, lambda r: (d["start"] < r["end"]) & (r["start"] < d["end"])))


def merge_mappings(found: Column, regex: Column) -> Column:
    """Pattern spans and the found ones beside them, by start."""
    return F.array_sort(F.concat(regex, without_overlap(found, regex)))


def redact_values(text: Column, values: Column) -> Column:
    """Every occurrence of the values, case aside, replaced; longer values first."""
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct((-F.char_length(v)).alias("neg"), v.alias("v")))), lambda s: s["v"])
    return F.aggregate(F.filter(ordered, lambda v: F.char_length(v) > 0), text, lambda t, v: F.regexp_replace(t, F.concat(F.lit(r"(?iu)\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(REDACTED)))


def phi_summary(mappings: DataFrame, id_col: str) -> DataFrame:
    """(id, summary): '3 PHI items redacted: 2 dates, 1 phone'."""
    per = mappings.groupBy(id_col, "phi_type").agg(F.count("*").alias("n"))
    label = F.concat(F.col("n").cast("string"), F.lit(" "), F.lower("phi_type"), F.when(F.col("n") > 1, "s").otherwise(""))
    all_ = per.groupBy(id_col).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("phi_type", label.alias("label")))).alias("parts"))
    return all_.select(id_col, F.concat(F.col("total").cast("string"), F.lit(" PHI item"), F.when(F.col("total") != 1, "s").otherwise(""), F.lit(" redacted: "), F.array_join(F.transform("parts", lambda p: p["label"]), ", ")).alias("summary"))


def with_context(mappings: DataFrame, docs: DataFrame, id_col: str, text_col: str, chars: int = 30) -> DataFrame:
    """Mappings with the text around each span as `excerpt`."""
    low = F.greatest(F.col("start") - chars, F.lit(0))
    joined = mappings.join(docs.select(id_col, F.col(text_col).alias("_text")), id_col)
    return joined.withColumn("excerpt", F.substring("_text", low + 1, F.col("end") + chars - low)).drop("_text")


ENTITY_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("kind", T.StringType())]))


def claim_entities(text: Column, entities: Column) -> Column:
    """Spans of entity values (array<struct<value, kind>>): each takes its first occurrence that no earlier one took."""

    @F.pandas_udf(ENTITY_SPANS)
    def claim(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in parts:
            yield pd.Series([_claim(t, e) for t, e in zip(texts, lists)])

    return claim(text, entities)


def _claim(text, entities) -> list[dict]:
    out: list[dict] = []
    for e in entities if entities is not None and text else ():
        value = e["value"]
        at = text.find(value) if value else -1
        while at >= 0:
            if all(at + len(value) <= o["start"] or at >= o["end"] for o in out):
                out.append({"start": at, "end": at + len(value), "value": value, "kind": e["kind"]})
                break
            at = text.find(value, at + 1)
    return sorted(out, key=lambda o: o["start"])


def align_redaction(original: Column, redacted: Column) -> Column:
    """Spans of the original that a redacted copy no longer holds; the copy marks each with the placeholder."""

    @F.pandas_udf(ENTITY_SPANS)
    def align(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([_align(x, y) for x, y in zip(a, b)])

    return align(original, redacted)


def _align(original, redacted, within: int = 200, least: int = 3) -> list[dict]:
    """Text between placeholders is found again in order, at most `within` characters ahead where possible. Less than `least`
    characters between two placeholders could stand anywhere: they belong to one span with what is gone around them."""
    if not original or not redacted:
        return []
    pieces = redacted.split(REDACTED)
    if not original.startswith(pieces[0]):
        return []
    out, at = [], len(pieces[0])
    for k, piece in enumerate(pieces[1:], 1):
        last = k == len(pieces) - 1
        if len(piece) < least and not last:
            continue
        if last and original.endswith(piece):
            nxt = len(original) - len(piece)
        else:
            nxt = original.find(piece, at, at + within + len(piece))
            nxt = original.find(piece, at) if nxt < 0 else nxt
        if nxt < at:
            break
        if nxt > at:
            out.append({"start": at, "end": nxt, "value": original[at:nxt], "kind": "OTHER"})
        at = nxt + len(piece)
    return out
