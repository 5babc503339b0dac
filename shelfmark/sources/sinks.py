"""Writers: review manifest, run export, copy plan, journal. Plans are written; files are never deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_CHARS = 4000


def review_manifest(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines with sorted keys; ``raw_output`` is cut to 4,000 characters, as its format says."""
    shown = rows.withColumn("raw_output", F.substring("raw_output", 1, RAW_CHARS)) if "raw_output" in rows.columns else rows
    shown.select(*sorted(shown.columns)).write.mode("append").json(path)


def export_run(groups: DataFrame, records: DataFrame, path: str, **facts: str) -> None:
    """groups/, records/ and a one-row meta/ with the counts of both."""
    groups.write.mode("overwrite").json(f"{path}/groups")
    records.write.mode("overwrite").json(f"{path}/records")
    spark = groups.sparkSession
    counts = spark.read.schema(groups.schema).json(f"{path}/groups").agg(F.count("*").alias("groups_count")).crossJoin(spark.read.schema(records.schema).json(f"{path}/records").agg(F.count("*").alias("records_count")))
    counts.select(*(F.lit(v).alias(k) for k, v in sorted(facts.items())), "groups_count", "records_count").write.mode("overwrite").json(f"{path}/meta")


def copy_plan(plan: DataFrame, path: str) -> None:
    """The table of (source, dest) by storage category."""
    plan.write.mode("overwrite").partitionBy("storage_category").parquet(path)


def journal(plan: DataFrame, path: str, mode: str, at: float) -> None:
    """Append one row a batch: when, how, how many and which paths; written before anything acts on the plan."""
    row = plan.agg(F.lit(at).alias("ts"), F.lit(mode).alias("mode"), F.count("*").alias("count"), F.array_sort(F.collect_list("path")).alias("paths"))
    row.write.mode("append").json(path)


def jpeg_data_uri(content):
    """Data URI column of JPEG bytes."""
    return F.concat(F.lit("data:image/jpeg;base64,"), F.translate(F.base64(content), "\r\n", ""))
