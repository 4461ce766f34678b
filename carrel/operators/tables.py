"""Tabular analytics: profile, roles, statistics, distinct values, samples, row search.

Statistics are plain aggregates, so Catalyst prunes columns and pushes filters; grouped ones aggregate partially before the
shuffle. Rows keep their null group. Column names resolve exactly, else by their lower-case letters and digits.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrel.functions.text import question_terms, stem_word
from carrel.session import cut

# Names under which an operation may be asked for.
OPERATION_NAMES = {
    "average": "mean", "avg": "mean", "mean": "mean", "median": "median", "min": "min", "minimum": "min", "max": "max", "maximum": "max", "sum": "sum", "total": "sum",
    "std": "std", "stdev": "std", "count": "count", "nunique": "nunique", "unique": "nunique", "distinct": "nunique", "missing_count": "missing_count", "missing": "missing_count", "null": "missing_count", "na": "missing_count",
}
# Column words that hint at an identifier.
ENTITY_WORDS = {"subject", "patient", "participant", "case", "id", "identifier", "individual", "person"}
NUMERIC = ("mean", "median", "min", "max", "sum", "std")


def column_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def resolve_column(df: DataFrame, name: str) -> str:
    """The column meant by a name; of columns with equal keys the later one."""
    if name in df.columns:
        return name
    by_key = {column_key(c): c for c in df.columns}
    if column_key(name) not in by_key:
        raise ValueError(f"unknown column {name!r}; columns are {df.columns}")
    return by_key[column_key(name)]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def operation_name(operation: str) -> str:
    key = operation.strip().lower()
    if key not in OPERATION_NAMES:
        raise ValueError(f"unknown operation {operation!r}")
    return OPERATION_NAMES[key]


def _as_double(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    value = quoted(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return value.cast("double") if isinstance(kind, T.NumericType) else value.try_cast("double")


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN as null."""
    return _as_double(df, name) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else quoted(name)


def statistic(df: DataFrame, column: str, operation: str) -> Column:
    name, op = resolve_column(df, column), operation_name(operation)
    number, value = _as_double(df, name), present(df, name)
    return {
        "mean": lambda: F.avg(number), "median": lambda: F.median(number), "min": lambda: F.min(number), "max": lambda: F.max(number), "sum": lambda: F.sum(number),
        "std": lambda: F.stddev_samp(number), "count": lambda: F.count(value), "nunique": lambda: F.countDistinct(value), "missing_count": lambda: F.count(F.when(value.isNull(), 1)),
    }[op]()


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours, exact at any size; nulls where the column holds no number.

    Equal values are counted first, the counts are range-partitioned by value, and only the partitions' sums come to the driver
    (one row each). They tell in which partition each wanted rank lies; that partition alone is then looked into.
    """
    values = df.select(_as_double(df, resolve_column(df, column)).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(values.repartitionByRange(parts, "v").withColumn("p", F.spark_partition_id()))
    sums = {r["p"]: r["n"] for r in ranged.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    total = sum(sums.values())
    if not total:
        return [None] * len(shares)
    at = [(total - 1) * q for q in shares]
    ranks = sorted({int(x) for x in at} | {min(total - 1, int(x) + 1) for x in at})
    found: dict[int, float] = {}
    before = 0
    for p in sorted(sums):
        inside = [r for r in ranks if before <= r < before + sums[p]]
        if inside:
            upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + before
            rows = ranged.where(F.col("p") == p).select("v", upto.alias("upto"), (upto - F.col("n")).alias("from"))
            rows = rows.where(F.exists(F.array(*[F.lit(r).cast("bigint") for r in inside]), lambda r: (r >= F.col("from")) & (r < F.col("upto"))))
            for row in rows.collect():  # at most one row a rank
                found.update({r: row["v"] for r in inside if row["from"] <= r < row["upto"]})
        before += sums[p]
    out = []
    for x in at:
        low, high = found[int(x)], found[min(total - 1, int(x) + 1)]
        out.append(low + (high - low) * (x - int(x)))
    return out


def filtered(df: DataFrame, where: str | None) -> DataFrame:
    """Rows under a SQL predicate; one that does not parse or resolve is a ValueError."""
    if not where or not where.strip():
        return df
    try:
        out = df.where(F.expr(where))
        out.schema  # noqa: B018 - resolves the names now
        return out
    except Exception as e:
        raise ValueError(f"invalid where clause {where!r}: {str(e).splitlines()[0]}") from e


def table_stat(df: DataFrame, column: str, operation: str, group_by: str | None = None, where: str | None = None, top_n: int = 10) -> DataFrame:
    """(value, row_count, non_null), or (grp, value) of the top_n (1 to 50) groups: largest value first, nulls last, then by group."""
    rows = filtered(df, where)
    if operation_name(operation) == "median" and not group_by:
        # a median aggregate would hold all different values in one task
        stat = F.lit(exact_quantiles(rows, column, [0.5])[0]).cast("double")
    else:
        stat = statistic(rows, column, operation)
    if group_by:
        g = quoted(resolve_column(rows, group_by))
        return rows.groupBy(g.alias("grp")).agg(stat.alias("value")).orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("grp")).limit(max(1, min(50, top_n)))
    return rows.agg(stat.alias("value"), F.count("*").alias("row_count"), F.count(present(rows, resolve_column(rows, column))).alias("non_null"))


def distinct_values(df: DataFrame, column: str, where: str | None = None, limit: int = 50) -> DataFrame:
    """(value, n) of the most frequent values, nulls out, at most 100."""
    rows = filtered(df, f"({where})" if where else None)
    value = present(rows, resolve_column(rows, column))
    return rows.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(max(1, min(100, limit)))


def table_schema(df: DataFrame) -> DataFrame:
    """(column, type, non_null, missing, missing_pct, uniques) of every column, in one pass over the table.

    The cells are counted as (column, hash of the value) before they are shuffled, and equal ones once after it, so that neither
    a hot value nor the number of columns multiplies what a task holds. The hash has 96 bits.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, type string, non_null bigint, missing bigint, missing_pct double, uniques bigint")
    cells = df.select(F.posexplode(F.array(*[F.when(_hashable(df, c).isNotNull(), F.struct(*_digest(_hashable(df, c)))) for c in df.columns])).alias("pos", "h"))
    counted = cells.groupBy("pos", "h").agg(F.count("*").alias("n"))
    sums = counted.groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("h").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count("h").alias("uniques"))
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type")) for c in df.columns])
    every = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("pos")).withColumn("c", F.get(names, F.col("pos")))
    row = every.join(sums, "pos", "left").na.fill(0)
    gone = F.col("n") - F.col("non_null")
    return row.orderBy("pos").select("c.column", "c.type", "non_null", gone.alias("missing"), F.when(F.col("n") > 0, F.round(100 * gone / F.col("n"), 2)).otherwise(0.0).alias("missing_pct"), "uniques")


def _digest(value: Column) -> list[Column]:
    """Two independent hashes, of 64 and 32 bits."""
    return [F.xxhash64(value).alias("a"), F.hash(value).alias("b")]


def _hashable(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.to_json(quoted(name)) if isinstance(kind, (T.MapType, T.StructType, T.ArrayType, T.VariantType)) else present(df, name)


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mean, std, min, p25, median, p75, max) of the numeric columns: one pass for the moments, exact quantiles of each."""
    names = [resolve_column(df, c) for c in columns] if columns else [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    parts = []
    for c in names:
        v = _as_double(df, c)
        quarters = [F.lit(q).cast("double").alias(k) for q, k in zip(exact_quantiles(df, c, [0.25, 0.5, 0.75]), ("p25", "median", "p75"))]
        parts.append(F.struct(F.lit(c).alias("column"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), *quarters, F.max(v).alias("max")))
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return distinct_values(df, column, limit=k)


def id_candidates(df: DataFrame) -> DataFrame:
    """Columns that may identify rows: (column, score, non_null, uniques, unique_ratio, role), best first.

    Long texts and booleans are none; at least half of the rows (and three) must be filled, 95 % of them distinct.
    """
    n_rows = F.col("n_rows")
    roles = column_roles(df)
    stats = table_schema(df).withColumn("n_rows", F.col("non_null") + F.col("missing"))
    ratio = F.col("uniques") / F.col("non_null")
    role = F.create_map(*[F.lit(x) for c, r in roles.items() for x in (c, r)])[F.col("column")]
    hints = [c for c in df.columns if set(question_terms(c.replace("_", " "), expand=False)) & ENTITY_WORDS or set(map(stem_word, re.findall("[a-z0-9]+", c.lower()))) & ENTITY_WORDS]
    rows = stats.withColumns({"unique_ratio": F.round(ratio, 6), "role": role}).where(
        (F.col("non_null") >= F.greatest(F.lit(3), F.floor(n_rows * 0.5))) & (ratio >= 0.95) & F.col("role").isin("categorical", "numeric", "datetime")
    )
    score = F.bround(100 * ratio).cast("int") + F.when(F.col("column").isin(*hints), 20).otherwise(0) if hints else F.bround(100 * ratio).cast("int")
    return rows.select("column", score.alias("score"), "non_null", "uniques", "unique_ratio", "role").orderBy(F.desc("score"), F.desc("unique_ratio"), "column").limit(20)


def column_roles(df: DataFrame, sample: int = 80) -> dict[str, str]:
    """numeric, boolean, datetime, text or categorical for each column.

    Types decide; strings are looked at by their first `sample` values (a defined part of this heuristic) and their counts.
    """
    roles: dict[str, str] = {}
    strings = []
    for f in df.schema:
        if isinstance(f.dataType, T.BooleanType):
            roles[f.name] = "boolean"
        elif isinstance(f.dataType, T.NumericType):
            roles[f.name] = "numeric"
        elif isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            roles[f.name] = "datetime"
        elif isinstance(f.dataType, T.StringType):
            strings.append(f.name)
        else:
            roles[f.name] = "categorical"
    for c in strings:
        v = quoted(c)
        head = df.where(v.isNotNull()).select(v.alias("v")).limit(sample)
        as_date = F.coalesce(*[F.call_function("try_to_timestamp", F.col("v"), F.lit(p)) for p in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy")])
        r = head.agg(
            F.avg(F.char_length("v")).alias("len"), F.avg(F.when(F.col("v").rlike(r"\d") & F.col("v").rlike("[-/:]"), 1.0).otherwise(0.0)).alias("shaped"),
            F.avg(F.when(as_date.isNotNull(), 1.0).otherwise(0.0)).alias("dates"),
        ).first()
        hint = any(h in c.lower() for h in ("date", "time", "timestamp", "dob"))
        if r["dates"] is not None and (hint or r["shaped"] >= 0.45) and r["dates"] >= 0.7:
            roles[c] = "datetime"
            continue
        if r["len"] is not None and r["len"] >= 48:
            n = df.agg(F.count(v).alias("n"), F.countDistinct(v).alias("u")).first()
            roles[c] = "text" if n["u"] >= min(max(15, n["n"] // 3), n["n"]) else "categorical"
        else:
            roles[c] = "categorical"
    return {c: roles[c] for c in df.columns}


def sample_rows(df: DataFrame, mode: str = "head", n: int = 5, columns: list[str] | None = None, order: str | None = None, seed: int = 0) -> DataFrame:
    """head, tail or random rows, 1 to 100. Tables have no order of their own: head and tail go by `order` (default: first column)."""
    n = max(1, min(100, n))
    key = quoted(resolve_column(df, order) if order else df.columns[0])
    if mode == "head":
        out = df.orderBy(key.asc_nulls_first()).limit(n)
    elif mode == "tail":
        out = df.orderBy(key.desc_nulls_last()).limit(n)
    elif mode == "random":
        out = df.orderBy(F.rand(seed)).limit(n)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out.select(*[quoted(resolve_column(df, c)) for c in columns]) if columns else out


def shown(df: DataFrame, name: str) -> Column:
    """A value as search text: doubles in shortest form, nulls as 'null'."""
    kind = df.schema[name].dataType
    v = present(df, name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    elif isinstance(kind, (T.MapType, T.StructType, T.ArrayType, T.VariantType)):
        v = F.to_json(v)
    else:
        v = v.cast("string")
    return F.coalesce(v, F.lit("null"))


def search_rows(df: DataFrame, query: str, source: str, key: str, top_k: int = 5) -> DataFrame:
    """Rows that hold the terms of a question: (source, row_key, score, snippet, evidence_type), best first, ties by key.

    Columns whose names hold a term are looked at, else the first twelve; each term found in a column's name or value counts.
    All rows are searched.
    """
    wanted = question_terms(query)
    keys = {c: column_key(c) for c in df.columns}
    looked = [c for c in df.columns if any(t in keys[c] for t in wanted)] or df.columns[:12]
    pairs = []
    for c in looked:
        value = shown(df, c)
        named = sum(t in keys[c] for t in wanted)
        found = reduce(lambda a, b: a + b, [F.when(F.contains(F.lower(value), F.lit(t)), 1).otherwise(0) for t in wanted if t not in keys[c]], F.lit(named))
        pairs.append(F.struct(F.lit(c).alias("name"), value.alias("value"), found.alias("hits")))
    row = df.select(quoted(resolve_column(df, key)).alias("row_key"), F.filter(F.array(*pairs), lambda p: p["hits"] > 0).alias("m"))
    score = F.aggregate("m", F.lit(0), lambda a, p: a + p["hits"])
    preview = F.array_join(F.transform(F.slice("m", 1, 4), lambda p: F.concat(p["name"], F.lit("="), p["value"])), ", ")
    return (
        row.select(F.lit(source).alias("source"), "row_key", score.alias("score"), F.concat(F.lit("row "), F.col("row_key").cast("string"), F.lit(": "), preview).alias("snippet"), F.lit("table_row").alias("evidence_type"))
        .where("score > 0")
        .orderBy(F.desc("score"), "row_key")
        .limit(max(1, top_k))
    )
