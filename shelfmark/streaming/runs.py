"""Run metrics and state as streams: the batch operators' analogues for events that keep coming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.scratch import shared_dir

WATERMARK = "1 hour"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A stream of a table's files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{directory}/{name}*.parquet")


def error_windows(events: DataFrame, ts: str = "ts", least: int = 1) -> DataFrame:
    """(window_start, errors): errors of every 12 seconds, each second anew, for windows with at least ``least``."""
    errors = events.where("event_type = 'error'").select(F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", WATERMARK)
    return errors.groupBy(F.window("ts", "12 seconds", "1 second")).agg(F.count("*").alias("errors")).where(F.col("errors") >= least).select(F.unix_timestamp("window.start").alias("window_start"), "errors")


def first_by_content(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row for each content digest ever seen."""
    return documents.select(F.sha2(text, 256).alias("sha256")).dropDuplicates(["sha256"])


def latest_state(events: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """(key, seq, state) of the latest event of each key; an update for each change."""
    return events.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(state, seq).alias(state))


def drained(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run a stream over all that is there now and return its final rows: the last that was emitted for each key.

    Batches are written with their number, so a batch that is repeated after a failure
    counts once.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/shelfmark-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{at}/out")
    rest = [c for c in stream.columns if c not in keys]
    if not rest:
        return out.select(*keys).distinct()
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


