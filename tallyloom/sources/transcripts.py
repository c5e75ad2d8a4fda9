"""Usage transcripts: JSON lines with the tokens of each request, and their weekly report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import model_family
from ..operators.relational import keep_max, weekly

RECORD = "requestId string, timestamp string, message struct<model:string, usage:struct<input_tokens:long, output_tokens:long, cache_read_input_tokens:long, cache_creation_input_tokens:long>>"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(value, path, ord) of all lines of the JSON line files below a folder."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(folder)
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("ord"))


def usage_records(lines: DataFrame) -> DataFrame:
    """One row per request: of its records the one with most tokens, the first among equals. Malformed lines and those without usage are left out."""
    cheap = lines.where(F.contains("value", F.lit('"usage"')))
    r = cheap.select(F.from_json("value", RECORD).alias("r"), "ord").where("r.requestId <> '' AND r.message.model <> '' AND r.message.usage IS NOT NULL")
    count = lambda c: F.coalesce(F.col(f"r.message.usage.{c}"), F.lit(0))
    flat = r.select(
        F.col("r.requestId").alias("request"),
        F.expr("try_to_timestamp(r.timestamp)").alias("at"),
        model_family(F.col("r.message.model")).alias("model"),
        count("input_tokens").alias("input"),
        count("output_tokens").alias("output"),
        count("cache_read_input_tokens").alias("cache_read"),
        count("cache_creation_input_tokens").alias("cache_write"),
        "ord",
    ).where("at IS NOT NULL")
    summed = flat.withColumn("total", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write"))
    return keep_max(summed, ["request"], "total", "ord").drop("total", "ord")


def weekly_usage(records: DataFrame) -> DataFrame:
    """Calls and sums of tokens by ISO week, with the means per call."""
    sums = {c: F.col(c) for c in ("input", "output", "cache_read", "cache_write")}
    got = weekly(records, "at", **sums)
    return got.select("*", *[(F.col(c) / F.col("calls")).alias(f"{c}_per_call") for c in ("output", "cache_read", "cache_write")])


def usage_by_model(records: DataFrame) -> DataFrame:
    return records.groupBy("model").agg(F.count("*").alias("calls"), F.sum("cache_read").alias("cache_read"))
