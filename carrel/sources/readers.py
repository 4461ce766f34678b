"""Sources: files by their suffix, names, page assembly from documents, HTML parts."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.session import cut

# What a CSV cell may hold for 'no value'.
NA_CELLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """A file, folder or glob by its suffix: csv, tsv, parquet, json, jsonl, excel where openpyxl is there; anything else is text."""
    suffix = os.path.splitext(path.rstrip("*/"))[1].lower()
    if suffix in (".csv", ".tsv"):
        return read_csv(spark, path, "\t" if suffix == ".tsv" else ",")
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if suffix == ".json":
        return spark.read.option("multiLine", True).json(path)
    if suffix in (".jsonl", ".ndjson"):
        return read_jsonl(spark, path)
    if suffix in (".xlsx", ".xls"):
        return read_excel(spark, path)
    return read_text(spark, path)


def read_csv(spark: SparkSession, path: str, sep: str = ",", infer: bool = True) -> DataFrame:
    """CSV with a header. Types are inferred over the whole file; cells that mean 'no value' are null."""
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"')
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(*NA_CELLS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if not infer or not raw.columns:
        return clean
    kinds = clean.agg(*[F.struct(
        F.count(f"`{c}`").alias("n"), F.count(F.col(f"`{c}`").try_cast("bigint")).alias("whole"), F.count(F.col(f"`{c}`").try_cast("double")).alias("number"),
        F.count(F.when(F.lower(f"`{c}`").isin("true", "false"), 1)).alias("flag")).alias(f"k{i}") for i, c in enumerate(clean.columns)]).first()
    kind = lambda k: "string" if k["n"] == 0 else "boolean" if k["flag"] == k["n"] else "bigint" if k["whole"] == k["n"] else "double" if k["number"] == k["n"] else "string"
    return clean.select(*[F.col(f"`{c}`").try_cast(kind(kinds[i])).alias(c) for i, c in enumerate(clean.columns)])


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that does not parse is an error when the rows are read."""
    return spark.read.option("mode", "FAILFAST").json(path)


def numbered_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line, ok): every filled line with its number from 1 in its file, which is read as one text."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("k", "line"))
    return whole.where(F.trim("line") != "").select("file", (F.col("k") + 1).alias("line_no"), "line", F.try_parse_json("line").isNotNull().alias("ok"))


def check_examples(spark: SparkSession, path: str, inputs: list[str], labels: list[str]) -> DataFrame:
    """(file, line_no, inputs, labels) of training examples, as maps of the fields named; a file without lines, a line that is no
    object or one that lacks an input is a ValueError that names the line."""
    rows = numbered_json_lines(spark, path)
    v = F.try_parse_json("line")
    lacking = [F.when(F.try_variant_get(v, f"$.{k}", "variant").isNull(), F.lit(k)) for k in inputs]
    wrong = rows.select("file", "line_no", F.when(~F.col("ok"), "no JSON").otherwise(F.concat(F.lit("lacks "), F.coalesce(*lacking))).alias("why")).where("why IS NOT NULL").orderBy("file", "line_no").first()
    if wrong:
        raise ValueError(f"{wrong['file']}, line {wrong['line_no']}: {wrong['why']}")
    if rows.isEmpty():
        raise ValueError(f"no examples in {path}")
    pick = lambda names: F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[F.try_variant_get(v, f"$.{k}", "string") for k in names]))
    return rows.select("file", "line_no", pick(inputs).alias("inputs"), pick(labels).alias("labels"))


def sniff_delimiter(sample: str) -> str:
    """The separator that splits the lines of a sample into most cells, equally many in each; a comma where none does."""
    lines = [x for x in sample.splitlines() if x.strip()]
    best = (0, ",")
    for sep in (",", ";", "\t", "|"):
        n = {len(re.sub(r'"[^"]*"', "", x).split(sep)) - 1 for x in lines}
        if len(n) == 1 and (k := n.pop()) > best[0]:
            best = (k, sep)
    return best[1]


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of any separator as strings: found from the file's first ten lines; a byte order mark goes, names are trimmed, columns without a name are dropped."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(10).collect())
    raw = spark.read.csv(path, header=True, sep=sniff_delimiter(head.lstrip("\ufeff")), inferSchema=False, multiLine=True, escape='"')
    named = [(c, " ".join(c.lstrip("\ufeff").split())) for c in raw.columns]
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in named if n and not re.fullmatch(r"_c\d+", n)])


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the lines that are no JSON; blank lines are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.where((F.trim("line") != "") & F.try_parse_json("line").isNull())


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ValueError("reading Excel files needs openpyxl, which is not installed") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(source, path, text): each file as one text."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("*",)) -> DataFrame:
    """(path, length, content) of files for a provider that turns them into text."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return out if suffixes == ("*",) else out.where(F.lower(F.substring_index("path", ".", -1)).isin(*[s.lstrip(".").lower() for s in suffixes]))


def expand_sources(spark: SparkSession, pattern: str) -> list[str]:
    """Files behind a path, folder or glob of any file system that the session reaches, sorted; none is an error."""
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(path) or []:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() and not any(c in pattern for c in "*?[") else [status]
        found += [f.getPath().toUri().getPath() if f.getPath().toUri().getScheme() in (None, "file") else f.getPath().toString() for f in inner if f.isFile()]
    if not found:
        raise FileNotFoundError(f"no source at {pattern}")
    return sorted(found)


def unique_name(name: str, taken: set[str]) -> str:
    """The name, or 'name (2)', 'name (3)' where it is taken."""
    if name not in taken:
        return name
    n = 2
    while f"{name} ({n})" in taken:
        n += 1
    return f"{name} ({n})"


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names numbered in order: 'x', 'x (2)'.

    Rows are range-partitioned by the order, numbered within each partition and shifted by the counts of the partitions before,
    so that a name of very many rows is spread over all partitions. Names with equal orders are numbered in any order.
    """
    from pyspark.sql import Window

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(name, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(name).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(F.col(name).alias("_name"), F.col("_part").alias("_of"), before.alias("_before"))
    within = ranged.withColumn("_n", F.row_number().over(Window.partitionBy(name, "_part").orderBy(order)))
    joined = within.join(shifts, within[name].eqNullSafe(F.col("_name")) & (F.col("_part") == F.col("_of")))
    n = F.col("_n") + F.col("_before")
    named = joined.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))
    return named.drop("_part", "_n", "_name", "_of", "_before")


# ---- HTML -----------------------------------------------------------------------------------------------------------
def _plain(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def html_table(html: Column) -> Column:
    """The rows of an HTML table as lines of cells between bars, a rule after the first."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), _plain), " | "), F.lit(" |")))
    cells = F.size(F.regexp_extract_all(F.get(rows, F.lit(0)), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), cells))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n"))


def html_sections(html: Column) -> Column:
    """array<struct<id, name, text>> of <section id data-section-name> parts with their text areas."""
    shape = r'(?is)<section[^>]*\bid="([^"]*)"[^>]*\bdata-section-name="([^"]*)"[^>]*>(.*?)</section>'
    parts = [F.regexp_extract_all(html, F.lit(shape), F.lit(g)) for g in (1, 2, 3)]
    area = lambda body: F.coalesce(F.nullif(F.regexp_extract(body, r"(?is)<textarea[^>]*>(.*?)</textarea>", 1), F.lit("")), body)
    return F.transform(F.arrays_zip(parts[0].alias("i"), parts[1].alias("n"), parts[2].alias("b")), lambda z: F.struct(z["i"].alias("id"), z["n"].alias("name"), _plain(area(z["b"])).alias("text")))


def loinc_entries(html: Column) -> Column:
    """map<section id, struct<code, meaning>> of the codes that a page's XML part gives its sections; empty without one."""
    xml = F.regexp_extract(html, r'(?is)<script\s+type="text/xml">(.*?)</script>', 1)
    shape = r'(?is)<entry\s+origtxt="([^"]+)"[^>]*>.*?<code\s+meaning="([^"]*)"[^>]*value="([^"]*)"[^>]*scheme="LOINC"'
    ids, meanings, codes = (F.regexp_extract_all(xml, F.lit(shape), F.lit(g)) for g in (1, 2, 3))
    zipped = F.arrays_zip(ids.alias("i"), codes.alias("c"), meanings.alias("m"))
    kept = F.filter(zipped, lambda z, k: F.array_position(ids, z["i"]) == k + 1)
    return F.map_from_entries(F.transform(kept, lambda z: F.struct(z["i"], F.struct(z["c"].alias("code"), z["m"].alias("meaning")))))
