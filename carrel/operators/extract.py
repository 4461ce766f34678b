"""After extraction: coercion to types, semantic checks, grounding, contract, candidate scores, derived fields."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrel.functions.text import compact_number, is_missing, iso_date, squash, tokens

# Field words that tell what a value should be.
DATE_WORDS = ("date", "dob", "birth", "birthday", "admission", "discharge", "study_date", "exam_date")
RANGE_WORDS = ("range", "interval", "window", "duration")
UNIT_WORDS = ("height", "weight", "bmi", "blood_glucose", "uptake_time", "size", "diameter", "volume", "dose", "activity", "suv", "hu", "pressure", "bp")
NUMBER_WORDS = ("age", "score", "count", "number", "size", "diameter", "volume", "weight", "height", "bmi", "suv", "hu")
CRITICAL_WORDS = ("impression", "finding", "findings", "diagnosis", "assessment", "procedure", "exam_date", "date_of_birth", "dob", "patient_name")
# Units that are accepted, and other names of them.
UNITS = "mm cm m kg g mg ug lb lbs mmhg s sec seconds min mins minute minutes h hr hrs hour hours ml l % mg/dl g/dl".split()
UNIT_NAMES = {"millimeter": "mm", "millimeters": "mm", "centimeter": "cm", "centimeters": "cm", "milliliter": "ml", "milliliters": "ml", "liter": "l", "liters": "l", "kgs": "kg", "grams": "g", "milligrams": "mg", "micrograms": "ug", "mm hg": "mmhg"}
# How ranges and numbers with units are written.
RANGE = r"(?i)^\s*([-+]?\d+(?:\.\d+)?)\s*(?:-|to|–|—)\s*([-+]?\d+(?:\.\d+)?)\s*([A-Za-z%/]+)?\s*$"
NUMBER_UNIT = r"^\s*([-+]?\d+(?:\.\d+)?)\s*([A-Za-z%/]+)?\s*$"


def field_words(name: Column) -> Column:
    whole = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")
    return F.array_union(F.filter(F.split(whole, "_"), lambda t: t != ""), F.array(whole))


def named_as(name: Column, words) -> Column:
    return F.arrays_overlap(field_words(name), F.array(*[F.lit(w) for w in words]))


def unit_token(unit: Column) -> Column:
    low = F.lower(F.trim(unit))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in UNIT_NAMES.items() for x in kv])[low], low)


def semantic_check(name: Column, value: Column) -> Column:
    """struct<valid, kind, critical, reason, normalized_value> of a value under its field's name; the first rule that applies decides."""
    raw = F.trim(value)
    critical = named_as(name, CRITICAL_WORDS)
    result = lambda valid, kind, reason, norm: F.struct(
        F.lit(valid).alias("valid"), F.lit(kind).alias("kind"), critical.alias("critical"), F.lit(reason).cast("string").alias("reason"), (norm if isinstance(norm, Column) else F.lit(norm)).cast("string").alias("normalized_value")
    )
    is_range = raw.rlike(RANGE)
    low, high = F.regexp_extract(raw, RANGE, 1).try_cast("double"), F.regexp_extract(raw, RANGE, 2).try_cast("double")
    r_unit, n_unit = unit_token(F.regexp_extract(raw, RANGE, 3)), unit_token(F.regexp_extract(raw, NUMBER_UNIT, 2))
    with_unit = lambda number, unit: F.concat(number, F.when(unit != "", F.concat(F.lit(" "), unit)).otherwise(""))
    number = F.regexp_extract(raw, NUMBER_UNIT, 1).try_cast("double")
    date = iso_date(raw)
    return (
        F.when(value.isNull() | (raw == ""), result(False, "null", "missing_value", None))
        .when(is_missing(value), result(False, "null", "missing_value", None))
        .when(named_as(name, ("bp", "pressure")) & raw.rlike(r"^\s*\d{2,3}\s*/\s*\d{2,3}\s*$"), result(True, "blood_pressure", None, F.regexp_replace(raw, r"\s*/\s*", "/")))
        .when(named_as(name, ("date", *DATE_WORDS)) & date.isNull(), result(False, "date", "invalid_date_format", raw))
        .when(named_as(name, ("date", *DATE_WORDS)), result(True, "date", None, date))
        .when(named_as(name, RANGE_WORDS) & ~is_range, result(False, "range", "invalid_range_format", raw))
        .when(is_range & (low > high), result(False, "range", "invalid_range_order", raw))
        .when(is_range, result(True, "range", None, with_unit(F.concat(compact_number(low), F.lit("-"), compact_number(high)), r_unit)))
        .when(named_as(name, UNIT_WORDS) & ~raw.rlike(NUMBER_UNIT), result(False, "unit", "invalid_numeric_unit", raw))
        .when(named_as(name, UNIT_WORDS) & (n_unit != "") & ~n_unit.isin(*UNITS), result(False, "unit", "unknown_unit", raw))
        .when(named_as(name, UNIT_WORDS), result(True, "unit", None, with_unit(compact_number(number), n_unit)))
        .when(named_as(name, NUMBER_WORDS) & ~raw.rlike(r"\d"), result(False, "numeric", "missing_numeric_content", raw))
        .otherwise(result(True, "text", None, raw))
    )


def ground(source: Column, value: Column, is_flat: bool = False) -> Column:
    """struct<grounded, snippet>: where a value stands in the source. is_flat: the source is squashed already.

    Squashed and case aside it is looked for as it is, 80 characters around it being the snippet; else, for four or more words
    of three letters, the one to three sentences that hold most of them: 85 % is grounded, under 45 % nothing.
    """
    hay, needle = source if is_flat else squash(source), squash(value)
    at = F.instr(F.lower(hay), F.lower(needle)) - 1
    direct = F.substring(hay, F.greatest(at - 80, F.lit(0)) + 1, F.least(at, F.lit(80)) + F.char_length(needle) + 80)
    long_words = lambda t: F.filter(F.array_distinct(tokens(t)), lambda w: F.length(w) >= 3)
    wanted = long_words(needle)
    parts = F.filter(F.transform(F.split(hay, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")

    def best(pair: Column) -> Column:
        p, w = pair["p"], pair["w"]
        windows = F.flatten(F.transform(p, lambda _, i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.struct(
            (F.size(F.array_intersect(w, long_words(F.array_join(F.slice(p, i + 1, k), " ")))) / F.size(w)).alias("ratio"), (-(i * 3 + k)).alias("neg"), F.array_join(F.slice(p, i + 1, k), " ").alias("text")))))
        return F.array_max(windows)

    fuzzy = F.transform(F.array(F.struct(parts.alias("p"), wanted.alias("w"))), best)[0]
    snippet = F.when(F.char_length(fuzzy["text"]) > 420, F.concat(F.rtrim(F.substring(fuzzy["text"], 1, 417)), F.lit("..."))).otherwise(fuzzy["text"])
    none = F.struct(F.lit(False).alias("grounded"), F.lit(None).cast("string").alias("snippet"))
    return (
        F.when(source.isNull() | value.isNull() | (needle == "") | (hay == ""), F.struct(F.lit(None).cast("boolean").alias("grounded"), F.lit(None).cast("string").alias("snippet")))
        .when(at >= 0, F.struct(F.lit(True).alias("grounded"), direct.alias("snippet")))
        .when(F.size(wanted) < 4, none)
        .when(fuzzy["ratio"] >= 0.45, F.struct((fuzzy["ratio"] >= 0.85).alias("grounded"), snippet.alias("snippet")))
        .otherwise(none)
    )


def contract(fields: DataFrame, id_col: str, source: Column, is_flat: bool = False) -> DataFrame:
    """(id, field, value, valid, kind, grounded, evidence, confidence, status) from rows (id, field, value)."""
    rows = fields.withColumn("_c", semantic_check(F.col("field"), F.col("value"))).withColumn("_g", ground(source, F.col("value"), is_flat))
    missing = F.col("_c.kind") == "null"
    status = F.when(missing, "insufficient_evidence").when(F.col("_c.valid") & F.coalesce(F.col("_g.grounded"), F.lit(False)), "supported").otherwise("needs_review")
    confidence = F.when(missing, 0.0).when(~F.col("_c.valid"), 0.25).when(F.coalesce(F.col("_g.grounded"), F.lit(False)), 0.9).otherwise(0.5)
    return rows.select(id_col, "field", "value", F.col("_c.valid").alias("valid"), F.col("_c.kind").alias("kind"), F.col("_c.normalized_value").alias("normalized_value"), F.col("_c.reason").alias("reason"), F.col("_g.grounded").alias("grounded"), F.col("_g.snippet").alias("evidence"), confidence.alias("confidence"), status.alias("status"))


def contract_counts(contracts: DataFrame, id_col: str) -> DataFrame:
    """(id, supported, needs_review, insufficient_evidence, fields, present, missing): numbers of fields, and the names of those
    with and without a value."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    there = lambda missing: F.array_sort(F.collect_set(F.when((F.col("kind") == "null") == missing, F.col("field"))))
    counts = contracts.groupBy(id_col).agg(n("supported"), n("needs_review"), n("insufficient_evidence"), F.count("*").alias("fields"), there(False).alias("present"), there(True).alias("missing"))
    return counts.withColumns({c: F.array_join(c, ", ") for c in ("present", "missing")})


# ---- nested payloads ------------------------------------------------------------------------------------------------
FLAT = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), T.StructField("kind", T.StringType())]))
#: Dialects of flattening: list mark, whether nulls and booleans count, most entries.
DIALECTS = {
    "verify": ("[{}]", False, False, 500), "metrics": (".{}", True, True, None), "mapping": ("[{}]", True, True, None), "candidate": ("[{}]", True, True, 256), "listing": ("[{}]", False, True, None),
}


def flatten_value(payload, dialect: str = "mapping") -> list[dict]:
    mark, nulls, booleans, most = DIALECTS[dialect]
    out: list[dict] = []

    def walk(x, path: str) -> None:
        if most is not None and len(out) >= most:
            return
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}" if path else str(k))
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, path + mark.format(i))
        elif x is None:
            if nulls:
                out.append({"path": path, "value": "" if dialect == "metrics" else None, "kind": "null"})
        elif isinstance(x, bool):
            if booleans:
                out.append({"path": path, "value": str(x) if dialect == "metrics" else json.dumps(x), "kind": "boolean"})
        else:
            number = isinstance(x, (int, float))
            text = (str(int(x)) if isinstance(x, float) and x == int(x) else str(x)) if number else x
            out.append({"path": path, "value": text, "kind": "number" if number else "string"})

    walk(payload, "")
    return out


def flattened(json_text: Column, dialect: str = "mapping") -> Column:
    """array<struct<path, value, kind>> of the scalars of a JSON text; null for one that does not parse."""

    @F.pandas_udf(FLAT)
    def flat(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([_flat(t, dialect) for t in s], dtype="object")

    return flat(json_text)


def _flat(text, dialect):
    try:
        return None if text is None else flatten_value(json.loads(text), dialect)
    except ValueError:
        return None


def json_get(json_text: Column, path: str) -> Column:
    """Value at a path such as 'a[0].b' as text; null where there is none."""
    steps = "$" + re.sub(r"\.(\d+)(?=\.|$)", r"[\1]", "." + path if not path.startswith("[") else path)
    return F.try_variant_get(F.try_parse_json(json_text), steps, "string")


def json_set(payload: dict, path: str, value) -> dict:
    """The payload with a value put at a path; a path that does not exist changes nothing."""
    steps = [int(s) if s.isdigit() else s for s in re.findall(r"[^.\[\]]+", path)]
    at = payload
    for s in steps[:-1]:
        if isinstance(at, list) and isinstance(s, int) and s < len(at) or isinstance(at, dict) and s in at:
            at = at[s]
        else:
            return payload
    last = steps[-1]
    if isinstance(at, dict) or isinstance(at, list) and isinstance(last, int) and last < len(at):
        at[last] = value
    return payload


# ---- coercion -------------------------------------------------------------------------------------------------------
# Words for yes and no, and cues of doubt and denial.
YES, NO = ("true", "yes", "y", "1", "positive"), ("false", "no", "n", "0", "negative")
DOUBT = "uncertain|indeterminate|equivocal|possible|cannot exclude"
DENIAL = "no |without|negative for|absent|not seen|none"


def coerce(value: Column, kind: str, required: bool = False, options: list[str] | None = None) -> Column:
    """A text value as string, int, float, bool or enum. Null-like becomes null, or the zero value where required."""
    gone = is_missing(value)
    low = F.lower(F.trim(value))
    if kind == "bool":
        out = F.when(low.isin(*YES), True).when(low.isin(*NO) | gone, False).otherwise(True)
        return out if required else F.when(value.isNotNull(), out)
    if kind == "int":
        number = F.trim(value).try_cast("double")
        return F.when(gone, F.lit(0 if required else None).cast("bigint")).otherwise(F.when(number == F.floor(number), number.cast("bigint")))
    if kind == "float":
        return F.when(gone, F.lit(0.0 if required else None).cast("double")).otherwise(F.trim(value).try_cast("double"))
    if kind == "enum":
        return F.when(~gone, enum_match(value, options or []))
    plain = spinal_level(value)
    return F.when(gone, F.lit("" if required else None).cast("string")).otherwise(plain)


def enum_match(value: Column, options: list[str]) -> Column:
    """The option meant: equal, else the first contained either way, else the one that shares most words; else the value."""
    low = F.lower(F.trim(value))
    opts = F.array(*[F.lit(o) for o in options]).cast("array<string>")
    equal = F.filter(opts, lambda o: F.lower(o) == low)
    inside = F.filter(opts, lambda o: F.contains(low, F.lower(o)) | F.contains(F.lower(o), low))
    shared = F.array_max(F.transform(opts, lambda o, i: F.struct(F.size(F.array_intersect(tokens(o), tokens(value))).alias("n"), (-i).alias("neg"), o.alias("o"))))
    return F.when(F.size(equal) > 0, F.get(equal, F.lit(0))).when(F.size(inside) > 0, F.get(inside, F.lit(0))).when(shared["n"] > 0, shared["o"]).otherwise(value)


def trinary(value: Column, allow_unknown: bool = True) -> Column:
    """1, 0 or -1 for stated, denied and doubtful."""
    low, number = F.lower(F.trim(value)), F.trim(value).try_cast("double")
    unknown = F.lit(-1.0 if allow_unknown else 0.0)
    return (
        F.when(value.isNull() | (low == ""), unknown)
        .when(number.isNotNull(), F.when(number > 0, 1.0).when(number < 0, unknown).otherwise(0.0))
        .when(low.rlike(DOUBT), -1.0 if allow_unknown else 1.0)
        .when(low.rlike(DENIAL), 0.0)
        .otherwise(1.0)
    )


def spinal_level(value: Column) -> Column:
    """'C2-3' as 'C2-C3'."""
    return F.regexp_replace(value, r"\b([CTLSctls])(\d{1,2})\s*[-/]\s*(\d{1,2})\b", "$1$2-$1$3")


# ---- candidates, derived values, consistency ------------------------------------------------------------------------
def candidate_score(
    fields: Column, source: Column, critical: list[str], fits: Column | None = None, least_completeness: float = 1.0, least_grounding: float = 0.8
) -> Column:
    """struct<score, evidence, completeness, grounding, contradiction, null_overuse> of flattened fields (array<struct<path, value, kind>>).

    fits: whether the candidate could be brought into the shape of its schema; one that could not scores 0. A candidate below
    least_completeness or least_grounding of its critical fields is not accepted and keeps 55 % of its score.
    """
    low = F.lower(source)
    observed = F.filter(fields, lambda f: ~is_missing(f["value"]) & (f["kind"] != "boolean") & (F.char_length(F.trim(f["value"])) >= 2))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    held = share(F.size(F.filter(observed, lambda f: F.contains(low, F.lower(F.trim(f["value"]))))), F.size(observed))
    denied = share(F.size(F.filter(observed, lambda f: F.contains(low, F.concat(F.lit("no "), F.lower(F.trim(f["value"])))) | F.contains(low, F.concat(F.lit("without "), F.lower(F.trim(f["value"])))))), F.size(observed))
    wanted = F.array(*[F.lit(c) for c in critical]).cast("array<string>")
    hit = F.filter(observed, lambda f: F.array_contains(wanted, f["path"]))
    complete = share(F.size(hit), F.size(wanted))
    grounded = share(F.size(F.filter(hit, lambda f: F.contains(F.lower(squash(source)), F.lower(squash(f["value"]))))), F.size(wanted))
    empty = share(F.size(F.filter(fields, lambda f: is_missing(f["value"]))), F.size(fields))
    overuse = F.greatest(F.lit(0.0), empty - 0.5)
    raw = 0.30 + 0.20 * held + 0.20 * complete + 0.20 * grounded + 0.10 * (1 - F.least(denied, F.lit(1.0))) - 0.20 * overuse
    accepted = (complete >= least_completeness) & (grounded >= least_grounding)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(accepted, raw).otherwise(raw * 0.55)))
    if fits is not None:
        score = F.when(F.coalesce(fits, F.lit(False)), score).otherwise(0.0)
    return F.struct(F.round(score, 6).alias("score"), held.alias("evidence"), complete.alias("completeness"), grounded.alias("grounding"), denied.alias("contradiction"), overuse.alias("null_overuse"))


def best_candidate(candidates: DataFrame, id_col: str, score: str, ordinal: str) -> DataFrame:
    """The candidate with the highest score of each id, the first of equals."""
    others = [c for c in candidates.columns if c != id_col]
    best = candidates.groupBy(id_col).agg(F.max_by(F.struct(*others), F.struct(score, -F.col(ordinal))).alias("m"))
    return best.select(id_col, *[F.col(f"m.`{c}`").alias(c) for c in others])


def coerced_payload(json_text: Column, spec: dict) -> Column:
    """A JSON payload in the shape of a normalised spec (struct); null for one that is no object.

    Scalars are coerced by their type, an absent or null-like one becomes null, or the zero value where it is required; a single
    value stands for a list of it; objects and lists of objects are coerced within.
    """
    v = F.try_parse_json(json_text)
    whole = F.try_variant_get(v, "$", "map<string,variant>")
    return F.when(whole.isNotNull(), _shaped(v, spec["fields"]))


def _shaped(v: Column, fields: list[dict]) -> Column:
    made = []
    for f in fields:
        at = f"$.{f['name']}"
        need, kind = bool(f.get("required", True)), f["type"]
        if kind == "object" and f.get("fields"):
            out = _shaped(F.try_variant_get(v, at, "variant"), f["fields"])
        elif kind.startswith("list"):
            items = F.coalesce(F.try_variant_get(v, at, "array<variant>"), F.when(F.try_variant_get(v, at, "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, at, "variant")), F.array(F.try_variant_get(v, at, "variant"))))
            if f.get("fields"):
                out = F.transform(items, _shaper(f["fields"]))
            else:
                inner = re.fullmatch(r"list\[(\w+)\]", kind)
                out = F.filter(F.transform(items, _coercer(inner[1] if inner else "str")), lambda x: x.isNotNull())
            if need:
                out = F.coalesce(out, F.array())
        else:
            out = coerce(F.try_variant_get(v, at, "string"), kind, need, f.get("values"))
        made.append(out.alias(f["name"]))
    return F.struct(*made)


def _shaper(fields: list[dict]):
    return lambda x: _shaped(x, fields)


def _coercer(kind: str):
    return lambda x: coerce(F.try_variant_get(x, "$", "string"), kind)


def validated_payload(payload: Column, spec: dict) -> Column:
    """A coerced payload whose optional texts and numbers that break the rule of their name are null."""
    made = []
    for f in spec["fields"]:
        value = payload[f["name"]]
        if f["type"] in ("str", "int", "float") and not f.get("required", True):
            value = F.when(semantic_check(F.lit(f["name"]), value.cast("string"))["valid"], value)
        made.append(value.alias(f["name"]))
    return F.struct(*made)


def derived_rule(description: str) -> tuple[str, ...] | None:
    """('count_where', list, flag), ('count', list) or ('max_percentage',) as a field's description tells it; None if it does not."""
    low = description.lower()
    if m := re.search(r"(?:count\s+entries|number\s+of\s+\w+)(?:\s+in\s+(\w+))?.*?where\s+(\w+)\s+is\s+true", low):
        return ("count_where", m[1] or "", m[2])
    if m := re.search(r"count\s+(?:all\s+)?entries\s+in\s+(?:.*/\s*)?(\w+)", low):
        return ("count", m[1])
    if re.search(r"max(?:imum|imaler?)?\b.*percentage|max\(", low):
        return ("max_percentage",)
    return None


def lengths_by_key(items: Column, key: str, length: str) -> Column:
    """map<key, length> of the entries that have both, the first of equal keys."""
    good = F.filter(items, lambda x: x[key].isNotNull() & x[length].isNotNull())
    first = F.filter(good, lambda x, i: F.array_position(F.transform(good, lambda y: y[key]), x[key]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x[key], x[length])))


def max_percentage_across(items: Column, extent: str, key: str, lengths: Column) -> Column:
    """max_percentage where the lengths stand in another list, found by a key."""
    return F.array_max(F.transform(items, lambda x: F.bround(x[extent] / (F.try_element_at(lengths, x[key]) * 10) * 100, 0)))


def count_where(items: Column, flag: str) -> Column:
    """Number of entries whose flag is true."""
    return F.size(F.filter(items, lambda x: F.coalesce(F.lower(x[flag].cast("string")).isin(*("true", "yes", "ja", "1", "positive")) | (x[flag].cast("string").try_cast("double") > 0), F.lit(False))))


def max_percentage(items: Column, extent: str, length: str) -> Column:
    """Largest extent / (length x 10) x 100 of the entries, rounded."""
    return F.array_max(F.transform(items, lambda x: F.bround(x[extent] / (x[length] * 10) * 100, 0)))


def consistency_issues(required: dict[str, Column], counts: dict[str, tuple[Column, Column]], enums: dict[str, tuple[Column, list[str]]]) -> Column:
    """array<struct<field, issue, severity>> of missing required values, counts that miss their lists, unknown options."""
    made = []
    issue = lambda f, i, s: F.struct(F.lit(f).alias("field"), F.lit(i).alias("issue"), F.lit(s).alias("severity"))
    made += [F.when(is_missing(c), issue(f, "required_field_missing", "error")) for f, c in required.items()]
    made += [F.when(n.cast("int") != F.size(items), issue(f, "count_mismatch", "warning")) for f, (n, items) in counts.items()]
    made += [F.when(c.isNotNull() & ~c.isin(*opts), issue(f, "invalid_enum_value", "warning")) for f, (c, opts) in enums.items()]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


