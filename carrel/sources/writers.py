"""Sinks: flat reports, findings as rows, Markdown, clinical bundles. Every writer is a plan over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRATEGIES = ("one_row", "findings_rows")
#: Columns that stay inside.
INTERNAL = ("_source", "_extraction_contract", "_planner", "redaction_map")


def one_row(reports: DataFrame, nested: str = "findings") -> DataFrame:
    """A row for each report, nested columns as JSON text."""
    return reports.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in reports.schema])


def findings_rows(reports: DataFrame, nested: str = "findings") -> DataFrame:
    """A row for each finding; its fields win over equal names of the report; reports without findings disappear."""
    inner = [f.name for f in reports.schema[nested].dataType.elementType.fields]
    kept = [c for c in reports.columns if c != nested and c not in inner]
    return reports.select(*kept, F.explode(nested).alias("_f")).select(*kept, *[F.col(f"_f.{c}").alias(c) for c in inner])


def shaped(reports: DataFrame, strategy: str, nested: str = "findings") -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
    return one_row(reports, nested) if strategy == "one_row" else findings_rows(reports, nested)


def write_csv(reports: DataFrame, path: str, strategy: str = "one_row") -> None:
    shaped(reports, strategy).write.mode("overwrite").csv(path, header=True, escape='"')


def write_parquet(reports: DataFrame, path: str, strategy: str = "one_row") -> None:
    shaped(reports, strategy).write.mode("overwrite").parquet(path)


def write_jsonl(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def save_artifact(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One file for a small result; an empty one is refused."""
    if df.isEmpty():
        raise ValueError("nothing to save")
    out = df.coalesce(1).write.mode("overwrite")
    out.csv(path, header=True) if kind == "csv" else out.json(path)


def markdown(title: Column, meta: dict[str, Column], findings: Column, impression: Column) -> Column:
    """A report as Markdown: title, facts, numbered findings, impression."""
    facts = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"**{k}:** "), c)) for k, c in meta.items()]
    lines = F.transform(findings, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), F.concat_ws(" - ", f["anatomy"], f["observation"], f["severity"])))
    part = F.when(F.size(findings) > 0, F.concat(F.lit("## Findings\n\n"), F.array_join(lines, "\n")))
    end = F.when(impression.isNotNull() & (impression != ""), F.concat(F.lit("## Impression\n\n"), impression))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *facts, part, end)


def clinical_bundle(report_id: Column, exam: Column, findings: Column, impression: Column) -> Column:
    """A bundle in the R4 shape as JSON text: one DiagnosticReport that points at one Observation for each finding.

    Ids are derived from the report's id, so that a second run writes the same.
    """
    uid = lambda *p: F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", *[x.cast("string") for x in p])), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    coded = lambda f: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", f["anatomy"], f["observation"])), F.lit("")), F.lit("Unspecified finding"))
    kept = F.coalesce(findings, F.expr("cast(array() as array<struct<anatomy:string,observation:string,severity:string>>)"))
    observations = F.transform(kept, lambda f, i: F.to_json(F.struct(
        uid(report_id, i).alias("fullUrl"),
        F.struct(F.lit("Observation").alias("resourceType"), F.lit("final").alias("status"), F.struct(coded(f).alias("text")).alias("code"), f["severity"].alias("valueString")).alias("resource"))))
    report = F.to_json(F.struct(
        uid(report_id).alias("fullUrl"),
        F.struct(F.lit("DiagnosticReport").alias("resourceType"), F.lit("final").alias("status"), F.struct(F.coalesce(exam, F.lit("Report")).alias("text")).alias("code"),
                 F.transform(kept, lambda f, i: F.struct(uid(report_id, i).alias("reference"))).alias("result"), impression.alias("conclusion")).alias("resource")))
    return F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.array_join(F.concat(F.array(report), observations), ","), F.lit("]}"))


def public_tier(df: DataFrame) -> DataFrame:
    """Without the internal columns."""
    return df.drop(*INTERNAL)


def write_documents(df: DataFrame, name: str, path: str) -> None:
    """One JSON text a document, in a folder of the document's name; a document's row is a line of its own."""
    df.write.mode("overwrite").partitionBy(name).json(path)


def write_redacted(docs: DataFrame, name: str, redacted: str, mappings: DataFrame, path: str) -> None:
    """The redacted texts (name, text) and, beside them, the map of what was replaced (public columns only)."""
    docs.select(F.col(name), F.col(redacted).alias("text")).write.mode("overwrite").json(f"{path}/texts")
    mappings.drop("original", "value").write.mode("overwrite").json(f"{path}/map")
