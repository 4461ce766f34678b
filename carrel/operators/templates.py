"""Report templates: YAML in and out, where a name leads, schemas read off tables, effort and quality of a schema.

Specs are the dictionaries of carrel.operators.schemas; YAML is read where PyYAML is there.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrel.operators import schemas as sc

# Words by which an option says that nothing is there.
ABSENCE_OPTIONS = {"none", "not present", "absent", "not applicable", "n/a", "na", "missing", "unknown"}


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML templates need PyYAML, which is not installed") from e
    return yaml


def with_absence(options: list[str]) -> list[str]:
    """The options of an optional enum with one that says 'nothing', spelt as they are, where none does."""
    if not options or any(" ".join(str(o).lower().split()) in ABSENCE_OPTIONS for o in options):
        return list(options)
    lettered = [str(o) for o in options if re.search("[A-Za-z]", str(o))]
    return [*options, "None" if lettered and all(o[0].isupper() for o in lettered) else "none"]


def _field_of(section: dict) -> dict:
    """A section or field of a template as a field of a spec."""
    kind = str(section.get("type", "str")).lower()
    out = {"name": section.get("name", "item"), "type": kind, "required": bool(section.get("required", True)), "description": section.get("description", "") or ""}
    if kind == "enum":
        values = [str(v) for v in section.get("values") or []]
        out["values"] = values if out["required"] else with_absence(values)
    elif kind == "object":
        out["fields"] = [_field_of(f) for f in section.get("fields") or []]
    elif kind == "list":
        item = section.get("item") or {"type": "str"}
        if str(item.get("type", "str")).lower() == "object":
            out["fields"] = [_field_of(f) for f in item.get("fields") or []]
        else:
            out["type"] = f"list[{sc.TYPE_NAMES.get(str(item.get('type', 'str')).lower(), 'str')}]"
    return out


def _section_of(field: dict) -> dict:
    out = {"name": field["name"], "type": field["type"], "required": bool(field.get("required", True))}
    if field.get("description"):
        out["description"] = field["description"]
    if field.get("values"):
        out["values"] = list(field["values"])
    if field["type"] == "object":
        out["fields"] = [_section_of(f) for f in field.get("fields") or []]
    elif field["type"].startswith("list"):
        inner = re.fullmatch(r"list\[(\w+)\]", field["type"])
        out["type"] = "list"
        out["item"] = {"type": "object", "fields": [_section_of(f) for f in field["fields"]]} if field.get("fields") else {"type": inner[1] if inner else "str"}
    return out


def parse_template(text: str) -> dict:
    """The spec of a YAML template; optional enums can say 'nothing'. A text that is no template is a ValueError."""
    data = _yaml().safe_load(text)
    if not isinstance(data, dict) or not isinstance(data.get("sections"), list) or not data.get("name"):
        raise ValueError("a template needs a name and a list of sections")
    return {"name": data["name"], "description": data.get("description", "") or "", "radreport_id": data.get("radreport_id"), "mode": data.get("mode"), "fields": [_field_of(s) for s in data["sections"]]}


def template_yaml(spec: dict) -> str:
    """The YAML template of a spec."""
    head = {k: spec[k] for k in ("name", "description", "radreport_id", "mode") if spec.get(k)}
    return _yaml().safe_dump(head | {"sections": [_section_of(f) for f in spec["fields"]]}, sort_keys=False, allow_unicode=True)


# ---- registry -------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class TemplateInfo:
    name: str
    description: str
    mode: str


# Names of the built-in templates and the organs each has a section for.
BUILT_IN = {
    "abdomen_ct": ("Abdomen CT", "liver gallbladder pancreas spleen kidneys bowel vessels lymph_nodes"),
    "brain_mri": ("Brain MRI", "parenchyma ventricles extra_axial_spaces vessels skull"),
    "cardiac_mri": ("Cardiac MRI", "left_ventricle right_ventricle atria valves pericardium"),
    "chest_ct": ("Chest CT", "lungs airways mediastinum lymph_nodes pleura heart_and_vessels bones"),
    "chest_xr": ("Chest radiograph", "lungs pleura heart mediastinum bones"),
    "generic": ("Report", "findings_text"),
    "lung_ct": ("Lung screening CT", "nodules lungs mediastinum"),
    "mammography": ("Mammography", "density masses calcifications lymph_nodes"),
    "msk_mri": ("Musculoskeletal MRI", "bones joints ligaments muscles soft_tissue"),
    "pet_ct": ("PET/CT", "head_and_neck chest abdomen skeleton"),
    "thyroid_us": ("Thyroid ultrasound", "right_lobe left_lobe isthmus lymph_nodes"),
}


def built_in(name: str) -> dict | None:
    """A built-in template: indication, comparison and technique, a section for each organ, impression."""
    if name not in BUILT_IN:
        return None
    title, organs = BUILT_IN[name]
    text = lambda n, required, d: {"name": n, "type": "str", "required": required, "description": d}
    fields = [text("indication", True, "Why the examination was made"), text("comparison", False, "Earlier examinations"), text("technique", False, "How it was made")]
    fields += [text(o, False, f"Findings: {o.replace('_', ' ')}") for o in organs.split()]
    return {"name": "".join(w.title() for w in name.split("_")) + "Report", "description": f"Structured report: {title}", "radreport_id": None, "mode": "radiology", "fields": [*fields, text("impression", True, "Conclusion")]}


def list_templates() -> list[TemplateInfo]:
    return [TemplateInfo(n, (s := built_in(n))["description"], s["mode"]) for n in sorted(BUILT_IN)]


def get_template(name: str) -> TemplateInfo | None:
    return next((t for t in list_templates() if t.name == name), None)


def resolve_template(template: str | None, folder: str | None = None, saved: str | None = None) -> tuple[dict | None, str | None]:
    """(spec, name): a YAML file, then a template of the user's folder, a built-in one, a saved spec; an unknown name is a
    ValueError that says where was looked."""
    if template is None:
        return None, None
    stem, suffix = os.path.splitext(os.path.basename(template))
    if suffix.lower() in (".yaml", ".yml") and os.path.exists(template):
        with open(template, encoding="utf-8") as f:
            return parse_template(f.read()), stem
    for end in (".yaml", ".yml"):
        if folder and os.path.exists(path := os.path.join(folder, template + end)):
            with open(path, encoding="utf-8") as f:
                return parse_template(f.read()), template
    if (spec := built_in(template)) is not None:
        return spec, template
    if saved and template in sc.list_specs(saved):
        return sc.load_spec(template, saved), template
    raise ValueError(f"template {template!r} not found as a file, in {folder or 'no folder'}, among {', '.join(sorted(BUILT_IN))} or in {saved or 'no store'}")


def template_mode(spec: dict | None, default: str = "radiology") -> str:
    return (spec or {}).get("mode") or default


MODES: dict[str, str] = {"radiology": "Reports of imaging: findings and impression", "pathology": "Reports of specimens: findings and diagnosis"}


def register_mode(name: str, description: str) -> None:
    MODES[name] = description


def get_mode(name: str) -> str:
    """The description of a mode; an unknown name is a ValueError that lists the known ones."""
    if name not in MODES:
        raise ValueError(f"unknown mode {name!r}; there are {', '.join(sorted(MODES)) or 'none'}")
    return MODES[name]


def list_modes() -> list[tuple[str, str]]:
    return sorted(MODES.items())


# ---- schemas from tables --------------------------------------------------------------------------------------------
# Headers by which the columns of a field catalog are known.
HEADERS = {
    "name": {"field_name", "name"},
    "type": {"type", "field_type"},
    "description": {"description", "field_description", "note", "field_note"},
    "required": {"required", "field_is_mandatory", "mandatory"},
    "values": {"values", "enum_values", "field_values", "allowed_values", "field_value", "value_code", "code"},
    "label": {"field_value_shortdesc", "field_value_description", "value_description", "value_label", "label"},
    "catalog_id": {"catalog_id", "catalog_name"},
    "catalog_version": {"catalog_version", "catalog_version_description"},
}
YES_CELLS, NO_CELLS = ("true", "yes", "y", "1", "required", "mandatory"), ("false", "no", "n", "0", "optional")


def header_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def catalog_headers(columns: list[str], given: dict[str, str] | None = None) -> dict[str, str]:
    """Which column plays which part; a column that was given must be there."""
    out = dict(given or {})
    if missing := [c for c in out.values() if c not in columns]:
        raise ValueError(f"no column {missing[0]!r}; there are {', '.join(columns)}")
    for part, names in HEADERS.items():
        if part not in out and (hit := next((c for c in columns if header_key(c) in names), None)):
            out[part] = hit
    return out


def table_shape(columns: list[str], headers: dict[str, str]) -> str:
    """'catalog' if the rows are fields (a name with a type, values or description), else 'data'."""
    return "catalog" if "name" in headers and {"type", "values", "description"} & set(headers) else "data"


def table_specs(df: DataFrame, order: str, headers: dict[str, str] | None = None, split_by: str | None = None) -> DataFrame:
    """(split, place, name, type, description, required, values, labels): the fields that a table describes, a row for each.

    A catalog's rows are grouped by field: the first type and description that are filled, values once each in the order of the
    rows (several in one cell are split), required if any row says so. A plain table's columns become fields by what they hold.
    """
    h = catalog_headers(df.columns, headers)
    if table_shape(df.columns, h) == "data":
        rows = sc.infer_columns(df)
        place = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column")) - 1
        none = F.expr("cast(array() as array<string>)")
        return rows.select(F.lit("").alias("split"), place.cast("int").alias("place"), F.col("column").alias("name"), "type", F.lit("").alias("description"), "required", none.alias("values"), none.alias("labels"))
    filled = lambda part: F.nullif(F.trim(F.col(f"`{h[part]}`").cast("string")), F.lit("")) if part in h else F.lit(None).cast("string")
    cells = df.select(F.col(f"`{split_by}`").cast("string").alias("split") if split_by else F.lit("").alias("split"), F.col(f"`{order}`").alias("o"), *[filled(p).alias(p) for p in ("name", "type", "description", "required", "values", "label")]).where("name IS NOT NULL AND split IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("o", "values", "label")))
    got = cells.groupBy("split", "name").agg(F.min("o").alias("o"), F.min_by("type", F.when(F.col("type").isNotNull(), F.col("o"))).alias("type"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("o"))).alias("description"),
                                             F.max(F.lower("required").isin(*YES_CELLS)).alias("required"), ordered.alias("s"))
    # the separator of a cell with several values: bar, then semicolon, then comma
    parts = lambda v: F.when(F.contains(v, F.lit("|")), F.split(v, r"\|")).when(F.contains(v, F.lit(";")), F.split(v, ";")).when(F.contains(v, F.lit(",")), F.split(v, ",")).otherwise(F.array(v))
    held = F.flatten(F.transform(F.filter("s", lambda x: x["values"].isNotNull()), lambda x: F.transform(parts(x["values"]), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("v"), F.coalesce(x["label"], F.when(F.contains(p, F.lit("=")), F.trim(F.regexp_replace(p, "^[^=]*=", "")))).alias("l")))))
    got = got.withColumn("held", F.filter(held, lambda x: x["v"] != ""))
    values, labels = F.array_distinct(F.transform("held", lambda x: x["v"])), F.array_distinct(F.transform(F.filter("held", lambda x: x["l"].isNotNull()), lambda x: F.concat(x["v"], F.lit("="), x["l"])))
    known = F.create_map(*[F.lit(x) for kv in sc.TYPE_NAMES.items() for x in kv])[F.lower("type")]
    kind = F.when(known.isNotNull() & (known != "str"), known).when(F.size(values) > 0, "enum").otherwise(F.coalesce(known, F.lit("str")))
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("split").orderBy("o", "name")) - 1).cast("int")
    return got.select("split", place.alias("place"), "name", kind.alias("type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("required", F.lit(False)).alias("required"), values.alias("values"), labels.alias("labels"))


# ---- effort and quality ---------------------------------------------------------------------------------------------
CALCULATED = r"(?i)\b(?:count|calculate|calculated\s+as|max\(|sum\(|number\s+of|percentage)"
LEVELS = ("fast", "standard", "deep")


def _walk(fields: list[dict], lists: int = 0):
    """(field, lists of objects around it)."""
    for f in fields:
        yield f, lists
        if f.get("fields"):
            yield from _walk(f["fields"], lists + f["type"].startswith("list"))


def think_level(spec: dict) -> str:
    """fast up to 8 fields without lists of objects; standard up to 20, two levels deep, without calculated ones; else deep."""
    every = list(_walk(spec["fields"]))
    nested = [f for f, _ in every if f["type"].startswith("list") and f.get("fields")]
    depth = max((k for _, k in every), default=0)
    if len(every) <= 8 and not nested:
        return "fast"
    return "standard" if len(every) <= 20 and depth <= 2 and not any(re.search(CALCULATED, f.get("description", "")) for f, _ in every) else "deep"


def effective_level(asked: str, spec: dict | None) -> str:
    """What was asked for, but never below what the schema needs; auto takes just that."""
    if asked == "deep":
        return "deep"
    if spec is None:
        return "standard" if asked == "auto" else asked
    need = think_level(spec)
    return need if asked == "auto" else max(asked, need, key=LEVELS.index)


def schema_chunks(spec: dict) -> list[tuple[str, list[str]]]:
    """(name, fields): all plain fields together, then each list of objects by itself."""
    nested = [f["name"] for f in spec["fields"] if f["type"].startswith("list") and f.get("fields")]
    plain = [f["name"] for f in spec["fields"] if f["name"] not in nested]
    return ([("scalars", plain)] if plain else []) + [(n, [n]) for n in nested]


def schema_quality(spec: dict) -> float:
    """How well a schema is built: .45 if it compiles, and shares of fields, types, needs and options; issues take 35 % off."""
    fields = spec.get("fields") or []
    n = max(len(fields), 1)
    try:
        sc.to_struct(sc.normalize_spec(spec))
        score = 0.45
    except Exception:
        score = 0.0
    score += min(0.2, len(fields) / 12 * 0.2) + 0.15 * sum(f.get("type") not in ("str", "string") for f in fields) / n + 0.1 * sum(bool(f.get("required", True)) for f in fields) / n
    score += 0.1 * sum(f.get("type") == "enum" and bool(f.get("values")) for f in fields) / n
    return max(0.0, min(1.0, score * (0.65 if sc.spec_issues(spec) else 1.0)))


# Marks of spinal levels and numbered lines, and words that hint at options.
LEVEL_MARK = r"\b[cCtTlLsS]\d{1,2}\s*[-/]\s*[cCtTlLsS]?\d{1,2}\b"
NUMBERED_LINE = r"(?m)^[^\S\n]*\d+[).:-]\s+"
OPTION_HINTS = ("none", "mild", "moderate", "severe", "present", "absent", "left", "right", "bilateral", "unilateral")


def granularity(text: Column, spec: dict) -> Column:
    """struct<score, issues>: whether the structure of a schema fits what the texts hold."""
    every = [f for f, _ in _walk(spec["fields"])]
    n = max(len(every), 1)
    options = sum(f["type"] == "enum" for f in every)
    lists = sum(f["type"].startswith("list") and bool(f.get("fields")) for f in every)
    objects = sum(f["type"] == "object" for f in every) + lists
    base = 0.35 + min(0.25, 0.25 * sum(f["type"] != "str" for f in every) / n) + min(0.20, 0.20 * (objects + lists) / n) + min(0.15, 0.15 * options / n)
    levels = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(LEVEL_MARK), F.lit(0))))
    hints = sum((F.regexp_count(F.lower(text), F.lit(re.escape(w))) for w in OPTION_HINTS), F.lit(0))
    numbered = F.regexp_count(text, F.lit(NUMBERED_LINE))
    rules = [
        ("document_has_repeating_level_markers_but_schema_lacks_list_object_structure", 0.25, (levels >= 3) & F.lit(lists == 0)),
        ("document_has_level_markers_but_schema_has_no_level_field", 0.15, (levels >= 3) & F.lit(not any("level" in f["name"].lower() for f in every))),
        ("document_has_strong_categorical_cues_but_schema_has_no_enum_fields", 0.10, (hints >= 6) & F.lit(options == 0)),
        ("document_has_numbered_structures_but_schema_is_flat", 0.10, (numbered >= 3) & F.lit(objects == 0)),
    ]
    issues = F.filter(F.array(*[F.when(c, F.lit(i)) for i, _, c in rules]), lambda x: x.isNotNull())
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(base) - sum((F.when(c, w).otherwise(0.0) for _, w, c in rules), F.lit(0.0))))
    empty = text.isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) == "")
    return F.struct(F.when(empty, 1.0).otherwise(score).alias("score"), F.when(empty, F.expr("cast(array() as array<string>)")).otherwise(issues).alias("issues"))


def run_report(docs: DataFrame, id_col: str, text_col: str, spec: dict) -> DataFrame:
    """(id, fields, overall, required_coverage, optional_coverage, missing_required): what the default provider reads for a
    template, map<field, value>, and how complete it is."""
    from carrel.functions.quality import report_completeness
    from carrel.operators.sections import backfill

    names = [f["name"] for f in spec["fields"]]
    found = backfill(docs, id_col, text_col, names).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    rows = docs.select(id_col).distinct().join(found, id_col, "left").withColumn("fields", F.coalesce("fields", F.expr("cast(map() as map<string,string>)")))
    has = {n: F.coalesce(F.trim(F.try_element_at(F.col("fields"), F.lit(n))) != "", F.lit(False)) for n in names}
    need = {f["name"] for f in spec["fields"] if f.get("required", True)}
    c = report_completeness({n: h for n, h in has.items() if n in need}, {n: h for n, h in has.items() if n not in need})
    return rows.select(id_col, "fields", c.alias("c")).select(id_col, "fields", F.round("c.overall", 6).alias("overall"), F.round("c.required_coverage", 6).alias("required_coverage"), F.round("c.optional_coverage", 6).alias("optional_coverage"), "c.missing_required")
