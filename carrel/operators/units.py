"""Problem 5: lengths of mixed notation in whole micrometres."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.functions.units import field_length, observed_length_um
from carrel.session import table

# Names of the left-ventricular end-diastolic diameter.
EDD_LABEL = re.compile(r"LVEDD(?:\s*\(2D\))?|LVIDd|LV\s+end-?\s?diastolic\s+(?:diameter|dimension)|LV\s+diastolic\s+(?:dimension|diameter)", re.I)


#: Parsed fields that a task remembers.
MOST_SEEN = 500_000


def length_um(field: Column, neighbour: Column, label: re.Pattern | None = None) -> Column:
    """Column of the length in micrometres (bigint); null where there is none.

    Equal fields of a task are parsed once, as far as MOST_SEEN of them are remembered; neighbouring texts only for bare numbers.
    """

    @F.pandas_udf("bigint")
    def parse(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen: dict = {}

        def of_field(v):
            if v not in seen:
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen[v] = field_length(v)
            return seen[v]

        for values, texts in parts:
            yield pd.Series([observed_length_um(v, t, label, of_field) for v, t in zip(values, texts)], dtype="Int64")

    return parse(field, neighbour)


def convert_lengths(df: DataFrame, id_col: str, field: Column, neighbour: Column, source_table: str, label: re.Pattern | None = None) -> DataFrame:
    """(source_table, output_id, value_um), one row per id with a length.

    A null id gives no row; repeated rows count once; if the rows of one id disagree, each distinct length is kept.
    Only fields that hold a digit reach Python.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("output_id"), field.alias("f"), neighbour.alias("n")).where(
        F.col("output_id").isNotNull() & F.col("f").rlike("[0-9]")
    )
    out = rows.select(F.lit(source_table).alias("source_table"), "output_id", length_um(F.col("f"), F.col("n"), label).alias("value_um"))
    return out.where(F.col("value_um").isNotNull()).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "radiology_mode_output")
    s = table(spark, sf_dir, "schema_extraction_output")
    a = convert_lengths(m, "finding_id", F.col("measurement"), F.col("observation"), "radiology_mode_output")
    b = convert_lengths(s, "output_id", F.col("extracted.lv_end_diastolic_diameter"), F.col("source_text"), "schema_extraction_output", EDD_LABEL)
    return a.unionByName(b)
