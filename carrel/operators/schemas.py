"""Schemas of extractions: templates to Spark types, inference from tables, checks, versions and differences."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of types.
TYPE_NAMES = {
    "str": "str", "string": "str", "text": "str", "int": "int", "integer": "int", "float": "float", "number": "float", "double": "float", "bool": "bool", "boolean": "bool", "enum": "enum", "list": "list", "array": "list", "object": "object", "dict": "object",
}
# Words of boolean columns.
TRUE_CELLS, FALSE_CELLS = ("true", "yes", "y", "t"), ("false", "no", "n", "f")


def snake_name(name: str) -> str:
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower() or "field"
    return f"field_{s}" if s[0].isdigit() else s


def pascal_name(name: str) -> str:
    """'chest ct-report' as 'ChestCtReport'; a leading digit gets 'Schema' before it."""
    out = "".join(w[:1].upper() + w[1:] for w in re.findall("[A-Za-z0-9]+", name)) or "Schema"
    return f"Schema{out}" if out[0].isdigit() else out


def unique_fields(names: list[str]) -> list[str]:
    """Repeated names get _2, _3."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def normalize_spec(spec: dict) -> dict:
    """Field names in snake case without repeats, type names settled, options without repeats (case aside), absent ones added to optional enums."""
    fields = [dict(f) for f in spec.get("fields", [])]
    for f, name in zip(fields, unique_fields([snake_name(f.get("name", "")) for f in fields])):
        f["name"] = name
        kind = str(f.get("type", "str")).strip().lower()
        m = re.fullmatch(r"list\[(\w+)\]", kind)
        f["type"] = f"list[{TYPE_NAMES.get(m[1], 'str')}]" if m else TYPE_NAMES.get(kind, "str")
        f["required"] = bool(f.get("required", True))
        if f["type"] == "enum":
            options = list({str(o).lower(): str(o) for o in reversed(f.get("values") or [])}.values())[::-1]
            if not f["required"] and not any(o.lower() == "none" for o in options):
                options.append("None")
            f["values"] = options
        if f.get("fields"):
            f["fields"] = normalize_spec({"fields": f["fields"]})["fields"]
    return {**spec, "name": spec.get("name") or "Schema", "fields": fields}


def spec_issues(spec: dict) -> list[str]:
    """What a spec lacks: no fields, repeated names, enums without options, unknown types."""
    fields = spec.get("fields") or []
    issues = [] if fields else ["schema has no fields"]
    names = [f.get("name") for f in fields]
    issues += [f"repeated field {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    for f in fields:
        kind = str(f.get("type", ""))
        if kind == "enum" and not f.get("values"):
            issues.append(f"enum {f.get('name')} has no values")
        if re.sub(r"^list\[(\w+)\]$", r"\1", kind).lower() not in TYPE_NAMES:
            issues.append(f"unknown type {kind!r} of {f.get('name')}")
        if kind == "object" and not f.get("fields"):
            issues.append(f"object {f.get('name')} has no fields")
    return issues


_SIMPLE = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "enum": T.StringType()}


def to_struct(spec: dict) -> T.StructType:
    """Spark type of a normalised spec; description, options and need stand in the metadata."""

    def kind(f: dict) -> T.DataType:
        t = f["type"]
        if t == "object":
            return to_struct({"fields": f["fields"]}) if f.get("fields") else T.VariantType()
        if t.startswith("list"):
            inner = re.fullmatch(r"list\[(\w+)\]", t)
            if f.get("fields") or f.get("item", {}).get("fields"):
                return T.ArrayType(to_struct(normalize_spec({"fields": f.get("fields") or f["item"]["fields"]})))
            return T.ArrayType(_SIMPLE.get(inner[1] if inner else "str", T.StringType()))
        return _SIMPLE[t]

    made = []
    for f in spec["fields"]:
        meta = {"description": f.get("description", ""), "required": f.get("required", True), "values": f.get("values") or []}
        made.append(T.StructField(f["name"], kind(f), not f.get("required", True), meta))
    return T.StructType(made)


def to_evidence_struct(spec: dict) -> T.StructType:
    """As to_struct, each field that is no object as {value, excerpt}."""
    wrap = T.StructType([T.StructField("value", T.VariantType()), T.StructField("excerpt", T.StringType())])
    return T.StructType([T.StructField(f["name"], to_struct({"fields": f["fields"]}) if f["type"] == "object" and f.get("fields") else wrap) for f in spec["fields"]])


def from_struct(schema: T.StructType, name: str = "Schema") -> dict:
    """Spec of a Spark type."""

    def one(f: T.StructField) -> dict:
        t = f.dataType
        base = {"name": f.name, "required": not f.nullable, "description": f.metadata.get("description", "")}
        if isinstance(t, T.StructType):
            return base | {"type": "object", "fields": from_struct(t)["fields"]}
        if isinstance(t, T.ArrayType):
            return base | ({"type": "list", "fields": from_struct(t.elementType)["fields"]} if isinstance(t.elementType, T.StructType) else {"type": "list[str]"})
        if f.metadata.get("values"):
            return base | {"type": "enum", "values": list(f.metadata["values"])}
        kind = "bool" if isinstance(t, T.BooleanType) else "int" if isinstance(t, T.IntegralType) else "float" if isinstance(t, (T.FractionalType,)) else "str"
        return base | {"type": kind}

    return {"name": name, "fields": [one(f) for f in schema]}


def depth(schema: T.DataType) -> int:
    if isinstance(schema, T.StructType):
        return 1 + max((depth(f.dataType) for f in schema), default=0)
    return depth(schema.elementType) if isinstance(schema, T.ArrayType) else 0


def field_count(schema: T.DataType) -> int:
    if isinstance(schema, T.StructType):
        return sum(1 + field_count(f.dataType) for f in schema)
    return field_count(schema.elementType) if isinstance(schema, T.ArrayType) else 0


def infer_columns(df: DataFrame) -> DataFrame:
    """(column, type, required, uniques, filled) of a table read as text, in one pass.

    bool, then int, then float (a decimal comma counts), then enum: at most 20 values of 80 characters or less, not all
    different in more than five rows, and at most 8 of them or half of the rows; else str. Blanks count as missing.
    """
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        v = F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
        low = F.lower(v)
        aggs += [
            F.count(v).alias(f"f{i}"), F.countDistinct(v).alias(f"u{i}"), F.count(F.when(low.isin(*TRUE_CELLS, *FALSE_CELLS), 1)).alias(f"b{i}"), F.count(F.when(v.rlike(r"^[-+]?\d+$"), 1)).alias(f"i{i}"),
            F.count(F.when(v.rlike(r"^[-+]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][-+]?\d+)?$"), 1)).alias(f"d{i}"), F.max(F.char_length(v)).alias(f"l{i}"),
        ]
    row = df.agg(*aggs)
    parts = []
    for i, c in enumerate(df.columns):
        f, u, b, w, d, most = (F.col(f"{x}{i}") for x in "fubidl")
        kind = (
            F.when(f == 0, "str").when(b == f, "bool").when(w == f, "int").when(d == f, "float")
            .when((u <= 20) & (most <= 80) & ~((f > 5) & (u == f)) & ((u <= 8) | (u / f <= 0.5)), "enum").otherwise("str")
        )
        parts.append(F.struct(F.lit(c).alias("column"), kind.alias("type"), (f == F.col("n")).alias("required"), u.alias("uniques"), f.alias("filled")))
    return row.select(F.inline(F.array(*parts)))


def catalog_fields(df: DataFrame, name: str, value: str, order: str, split_by: str | None = None, label: str | None = None) -> DataFrame:
    """(split, name, values, labels): the values of each field of a field catalog, once each, in the order of the rows."""
    keys = [F.col(split_by).alias("split")] if split_by else [F.lit("").alias("split")]
    rows = df.where(F.col(value).isNotNull() & (F.trim(value) != ""))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(value).alias("v"), (F.col(label) if label else F.lit(None).cast("string")).alias("l"))))
    out = rows.groupBy(*keys, F.col(name).alias("name")).agg(ordered.alias("s"))
    return out.select("split", "name", F.array_distinct(F.transform("s", lambda x: x["v"])).alias("values"), F.filter(F.transform("s", lambda x: x["l"]), lambda x: x.isNotNull()).alias("labels"))


def value_labels(text: str) -> dict[str, str]:
    """'A=x; B=y' as a mapping; bars split before semicolons, those before commas; a value without label stands for itself."""
    sep = next((s for s in "|;," if s in text), ",")
    out = {}
    for part in (p.strip() for p in text.split(sep)):
        if part:
            k, _, v = part.partition("=")
            out[k.strip()] = v.strip() or k.strip()
    return out


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, change) between two field tables (field, type): added, removed or modified."""
    a, b = old.select("field", F.col("type").alias("a")), new.select("field", F.col("type").alias("b"))
    joined = a.join(b, "field", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return joined.select("field", change.alias("change")).where("change IS NOT NULL")


def fields_of(df: DataFrame) -> DataFrame:
    """(field, type) of a table's columns."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "field string, type string")


# ---- stored specs ---------------------------------------------------------------------------------------------------
def save_spec(spec: dict, folder: str) -> str:
    """Write a spec; the one there before moves to .history as the next version."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{spec['name']}.json")
    if os.path.exists(path):
        past = os.path.join(folder, ".history")
        os.makedirs(past, exist_ok=True)
        os.replace(path, os.path.join(past, f"{spec['name']}_v{len(versions(spec['name'], folder)) + 1}.json"))
    with open(path, "w") as f:
        json.dump(spec, f, indent=2)
    return path


def load_spec(name: str, folder: str, version: int | None = None) -> dict:
    path = os.path.join(folder, f"{name}.json") if version is None else os.path.join(folder, ".history", f"{name}_v{version}.json")
    with open(path) as f:
        return json.load(f)


def list_specs(folder: str) -> list[str]:
    return sorted(f[:-5] for f in os.listdir(folder) if f.endswith(".json")) if os.path.isdir(folder) else []


def versions(name: str, folder: str) -> list[int]:
    past = os.path.join(folder, ".history")
    return sorted(int(m[1]) for f in os.listdir(past) if (m := re.fullmatch(re.escape(name) + r"_v(\d+)\.json", f))) if os.path.isdir(past) else []


def revert_spec(name: str, folder: str, version: int) -> dict:
    spec = load_spec(name, folder, version)
    save_spec(spec, folder)
    return spec


def add_field(spec: dict, field: dict) -> dict:
    if any(f["name"] == field["name"] for f in spec["fields"]):
        raise ValueError(f"field {field['name']} is there already")
    return {**spec, "fields": [*spec["fields"], field]}


def remove_field(spec: dict, name: str) -> dict:
    if not any(f["name"] == name for f in spec["fields"]):
        raise ValueError(f"no field {name}")
    return {**spec, "fields": [f for f in spec["fields"] if f["name"] != name]}


def rename_field(spec: dict, old: str, new: str) -> dict:
    if not any(f["name"] == old for f in spec["fields"]):
        raise ValueError(f"no field {old}")
    return {**spec, "fields": [{**f, "name": new} if f["name"] == old else f for f in spec["fields"]]}


# Categories of published scoring systems and what they mean.
SCORES = {
    "Lung-RADS": {
        "1": "Negative: no lung nodules or definitely benign nodules",
        "2": "Benign appearance: nodules with a very low likelihood of malignancy",
        "3": "Probably benign: short-term follow-up suggested",
        "4A": "Suspicious: additional diagnostic testing recommended",
        "4B": "Very suspicious: additional diagnostic testing and/or tissue sampling recommended",
        "4X": "Category 3 or 4 with additional suspicious features",
    },
    "BI-RADS": {
        "0": "Incomplete: additional imaging needed",
        "1": "Negative: no significant findings",
        "2": "Benign: non-cancerous findings",
        "3": "Probably benign: short-interval follow-up recommended",
        "4": "Suspicious: biopsy should be considered",
        "5": "Highly suggestive of malignancy: biopsy strongly recommended",
        "6": "Known biopsy-proven malignancy",
    },
    "TI-RADS": {
        "TR1": "Benign: no FNA recommended",
        "TR2": "Not suspicious: no FNA recommended",
        "TR3": "Mildly suspicious: FNA if >= 2.5 cm; follow-up if >= 1.5 cm",
        "TR4": "Moderately suspicious: FNA if >= 1.5 cm; follow-up if >= 1.0 cm",
        "TR5": "Highly suspicious: FNA if >= 1.0 cm; follow-up if >= 0.5 cm",
    },
    "Deauville": {
        "1": "No uptake above background",
        "2": "Uptake <= mediastinum",
        "3": "Uptake > mediastinum but <= liver",
        "4": "Uptake moderately increased compared to liver",
        "5": "Uptake markedly increased compared to liver and/or new sites of disease",
    },
}


def score_description(system, category):
    """Column: description of a category; empty for an unknown system or category."""
    pairs = [F.lit(x) for s, cs in SCORES.items() for c, d in cs.items() for x in (f"{s}|{c}", d)]
    return F.coalesce(F.create_map(*pairs)[F.concat(system, F.lit("|"), category)], F.lit(""))
