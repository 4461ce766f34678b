"""Text expressions: normalisation, terms, chunks, overlaps, spans. All are built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning, and search synonyms.
SEARCH_STOPWORDS = (
    "the a an and or of in on to for with is are was were be been being what which who whom when where why how does do did "
    "please show tell about can you your my me from that this those these there their them no patient study scan ct mri table tables "
    "dataset data cohort findings impression compared comparison today"
).split()
SYNONYMS = {
    "cancer": ["carcinoma", "malignancy", "malignant", "neoplasm", "tumor", "oncology", "adenocarcinoma", "metastasis", "metastatic"],
    "pathology": ["diagnosis", "disease", "carcinoma", "malignancy", "tumor"],
    "lesion": ["nodule", "mass", "node", "lymph"],
    "gender": ["sex", "male", "female", "m", "f"],
    "sex": ["gender", "male", "female", "m", "f"],
    "sexe": ["sex", "gender"],
    "male": ["m", "man", "masculine"],
    "female": ["f", "woman", "feminine"],
    "ethnicity": ["race", "ethnic", "origin"],
    "race": ["ethnicity", "ethnic"],
}
MATCH_STOPWORDS = "a an and are as at by for from in is of on or the to with without".split()


def squash(text: Column) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last three dots where something was cut."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def stem(token: Column) -> Column:
    """Plural endings off: 'ies' becomes 'y' in words over four letters, 's' goes in words over three."""
    return (
        F.when(token.endswith("ies") & (F.length(token) > 4), F.concat(F.substring(token, F.lit(1), F.length(token) - 3), F.lit("y")))
        .when(token.endswith("s") & (F.length(token) > 3), F.substring(token, F.lit(1), F.length(token) - 1))
        .otherwise(token)
    )


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def terms(text: Column) -> Column:
    """Stemmed tokens."""
    return F.transform(tokens(text), stem)


def stem_word(token: str) -> str:
    if token.endswith("ies") and len(token) > 4:
        return token[:-3] + "y"
    return token[:-1] if token.endswith("s") and len(token) > 3 else token


def question_terms(question: str, expand: bool = True) -> list[str]:
    """Search terms of a question: stemmed, stop words out (after stemming, so 'findings' stays), synonyms added in order."""
    import re

    raw = [stem_word(t) for t in re.findall("[a-z0-9]+", question.lower())]
    kept = [t for t in raw if len(t) >= 2 and t not in SEARCH_STOPWORDS] or raw
    out: dict[str, None] = {}
    for t in kept:
        out.setdefault(t)
        if expand:
            for s in SYNONYMS.get(t, ()):
                out.setdefault(stem_word(s))
    return list(out)


def term_hits(term_array: Column, wanted: list[str]) -> Column:
    """How many elements are among the wanted terms, each as often as it occurs."""
    return F.size(F.filter(term_array, lambda t: t.isin(*wanted))) if wanted else F.lit(0)


def chunks(text: Column, size: int = 1800, overlap: int = 220, most: int | None = None) -> Column:
    """array<struct<chunk_id, start, end, text>> of fixed windows; the last is the one that reaches the end."""
    size = max(200, size)
    overlap = min(max(0, overlap), size - 1)
    step = size - overlap
    n = F.ceil(F.greatest(F.char_length(text) - size, F.lit(0)) / step).cast("int")
    last = n if most is None else F.least(n, F.lit(most - 1))
    made = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("chunk_id"), (i * step).alias("start"), F.least(i * step + size, F.char_length(text)).alias("end"),
            F.substring(text, i * step + 1, F.lit(size)).alias("text"),
        ),
    )
    return F.when(F.char_length(text) > 0, made)


def word_overlap(claim: Column, source: Column) -> Column:
    """Share of the claim's distinct words that the source holds; 0 for a claim without words."""
    words = F.array_distinct(tokens(claim))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, tokens(source))) / F.size(words)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the non-empty matches of a Java pattern, offsets in characters.

    Texts between the matches give the offsets; the ends are running sums over the matches of one text, kept as numbers alone.
    """

    def build(pair: Column) -> Column:
        m, gaps = pair["m"], pair["g"]
        ends = F.aggregate(
            F.sequence(F.lit(0), F.size(m) - 1), F.array(F.lit(0)), lambda acc, i: F.array_append(acc, F.element_at(acc, -1) + F.char_length(gaps[i]) + F.char_length(m[i]))
        )
        return F.when(F.size(m) > 0, F.transform(F.array(ends), lambda e: F.transform(
            m, lambda v, i: F.struct((F.get(e, i + 1) - F.char_length(v)).cast("int").alias("start"), F.get(e, i + 1).cast("int").alias("end"), v.alias("value"))))[0]
        ).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.transform(F.array(pair), build)[0]


def around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """Text around a span, white space squashed; start and end 0-based."""
    low = F.greatest(start - before, F.lit(0))
    return squash(F.substring(text, low + 1, end + after - low))


# How a missing value is written.
NULLISH = ("", "none", "null", "nil", "n/a", "na", "not available")


def is_missing(value: Column) -> Column:
    """Null, blank or a word for 'nothing'."""
    return value.isNull() | F.lower(F.trim(value)).isin(*NULLISH)


# Words that mean yes.
TRUE_WORDS = ("true", "yes", "ja", "1", "positive")


def is_truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*TRUE_WORDS) | (value.try_cast("double") > 0), F.lit(False))


def compact_number(value: Column) -> Column:
    """At most six decimals, zeros at the end cut."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), r"0+$", ""), r"\.$", "")


# Date notations in the order in which they are tried.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy", "M/d/yy", "d/M/yy", "MMM d yyyy", "MMMM d yyyy")


def iso_date(text: Column) -> Column:
    """The first ISO date inside a text, or the whole text read in the first notation that fits; null else."""
    inside = F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    clean = squash(F.regexp_replace(text, ",", " "))
    # a four-digit year must not be read by a two-digit notation, and the other way round
    shaped = [
        F.when(clean.rlike(shape), F.expr("null")) if fmt is None else F.when(clean.rlike(shape), F.call_function("try_to_timestamp", clean, F.lit(fmt)))
        for fmt, shape in zip(
            DATE_FORMATS,
            (r"^\d{4}-\d+-\d+$", r"^\d{4}/\d+/\d+$", r"^\d+/\d+/\d{4}$", r"^\d+-\d+-\d{4}$", r"^\d+/\d+/\d{4}$", r"^\d+-\d+-\d{4}$", r"^\d+/\d+/\d{2}$", r"^\d+/\d+/\d{2}$", r"^[A-Za-z]{3} \d+ \d{4}$", r"^[A-Za-z]{4,} \d+ \d{4}$"),
        )
    ]
    return F.when(inside != "", inside).otherwise(F.date_format(F.coalesce(*shaped), "yyyy-MM-dd"))


# Phrases that say a source holds nothing of the kind, and those of a failing service.
ABSENCE_CUES = ("does not contain", "not contain", "not found", "no evidence", "not present", "unable to find", "cannot find", "missing", "no information found")
FAILURE_CUES = ("unavailable", "connection error", "adapter jsonadapter failed", "failed to parse", "lm response cannot be serialized", "internalservererror")


def _holds_any(text: Column, cues) -> Column:
    low = F.lower(squash(F.coalesce(text, F.lit(""))))
    return F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(low, c))


def states_absence(text: Column) -> Column:
    """Whether a text says that what was asked for is not there."""
    return _holds_any(text, ABSENCE_CUES) | F.coalesce(F.lower(text).rlike(r"\bno\b[^.]{0,100}\bfound\b"), F.lit(False))


def states_failure(text: Column) -> Column:
    """Whether a text is the message of a failing service and no evidence."""
    return _holds_any(text, FAILURE_CUES)
