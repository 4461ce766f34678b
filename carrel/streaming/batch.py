"""Batches of documents: resume by what is done, errors kept apart, incremental folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.session import ship

RESULT = "name string, ok boolean, value string, error string"


def pending(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Documents that are not done yet."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def completed(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return docs.join(done.select(key).distinct(), key, "left_semi")


def process(docs: DataFrame, name_col: str, text_col: str, run: Callable[[str], str]) -> DataFrame:
    """(name, ok, value, error) of `run` on each text; a failing or empty text is an error of its row only."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for name, text in zip(pdf["name"], pdf["text"]):
                try:
                    if not text or not text.strip():
                        raise ValueError("empty document")
                    rows.append((name, True, run(text), None))
                except Exception as e:
                    rows.append((name, False, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["name", "ok", "value", "error"])

    return docs.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text")).mapInPandas(each, RESULT)


def run_batch(docs: DataFrame, name_col: str, text_col: str, run: Callable[[str], str], out: str) -> dict:
    """Process what is not yet in the folder `out`, append it there, and count: {total, succeeded, failed, skipped}."""
    spark = docs.sparkSession
    ship(spark)
    named = docs.withColumn("name", F.col(name_col).cast("string"))
    try:
        done = spark.read.schema(RESULT).parquet(out).where("ok")
        done.limit(1).collect()
    except Exception:
        done = spark.createDataFrame([], RESULT)
    done = done.select("name")
    todo = pending(named, done, "name")
    total = named.select("name").distinct().count()
    skipped = completed(named, done, "name").select("name").distinct().count()
    process(todo, "name", text_col, run).write.mode("append").parquet(out)
    good = spark.read.parquet(out).groupBy("name").agg(F.max("ok").alias("ok"))
    counts = good.agg(F.count(F.when(F.col("ok"), 1)).alias("good"), F.count(F.when(~F.col("ok"), 1)).alias("bad")).first()
    return {"total": total, "succeeded": counts["good"] - skipped, "failed": counts["bad"], "skipped": skipped}


def stream_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """New text files of a folder, once each: a stream that takes what is there and ends; its checkpoint remembers the rest."""
    ship(spark)
    files = spark.readStream.schema("value string").option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    transform(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def step_totals(steps: DataFrame) -> DataFrame:
    """(steps, duration, tokens) summed over rows (duration, input_tokens, output_tokens)."""
    return steps.agg(F.count("*").alias("steps"), F.sum("duration").alias("duration"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


def envelope(df: DataFrame, pipeline: str, version: str = "1") -> DataFrame:
    """The rows with a struct of how they were made."""
    return df.withColumn("_run", F.struct(F.lit(pipeline).alias("pipeline"), F.lit(version).alias("version"), F.current_timestamp().alias("created_at")))


