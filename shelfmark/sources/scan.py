"""Scanning media files, exemplars and label sets; column-pruned, so contents are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by class.
STILL = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".heic", ".heif", ".avif")
VIDEO = (".mp4", ".mov", ".mkv", ".webm", ".avi", ".m4v", ".wmv", ".flv", ".mpeg", ".mpg", ".3gp", ".mts", ".m2ts")
GIF = (".gif",)
MODES = {"photos_only": STILL, "video_only": VIDEO + GIF, "photos_and_video": STILL + VIDEO + GIF}

SCHEMA = "path string, mtime timestamp, size long"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def media_files(spark: SparkSession, root: str, mode: str = "photos_and_video", exclude: str | None = None) -> DataFrame:
    """(path, mtime, size) of the media files under a folder, in order of the lower-cased path.

    ``exclude`` is an output folder inside the root whose files are left out. A root that
    is not a folder gives an empty result.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).where(extension(F.col("path")).isin(*MODES[mode]))
    if exclude and exclude.rstrip("/") != root.rstrip("/"):
        plain = F.regexp_replace("path", "^file:/+", "/")
        found = found.where(~F.startswith(plain, F.lit(exclude.removeprefix("file://").rstrip("/") + "/")))
    return found.orderBy(F.lower("path"))


def exemplars(files: DataFrame, most: int = 48) -> DataFrame:
    """(tag, path): the first stills of each folder, by name; the folder's name is the tag."""
    from shelfmark.operators.metrics import capped_exemplars

    named = files.where(extension(F.col("path")).isin(*STILL)).select(F.element_at(F.split("path", "/"), -2).alias("tag"), "path")
    return capped_exemplars(named, "tag", "path", most)


def labelled(files: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, path) of stills and gifs in the folders of allowed tags."""
    named = files.where(extension(F.col("path")).isin(*STILL, *GIF)).select(F.element_at(F.split("path", "/"), -2).alias("tag"), "path")
    return named.join(F.broadcast(tags.select("tag")), "tag", "left_semi")


TAG_STORE = "active_set string, sets array<struct<name:string,tags:array<struct<key:string,description:string>>>>"


def tag_store(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, active, key, description) of a tag store file; a broken file has no rows."""
    raw = spark.read.schema(TAG_STORE).option("multiLine", True).json(path)
    sets = raw.select("active_set", F.explode("sets").alias("s"))
    return sets.select(F.col("s.name").alias("set_name"), (F.col("s.name") == F.col("active_set")).alias("active"), F.explode("s.tags").alias("t")).select("set_name", "active", F.col("t.key").alias("key"), F.coalesce("t.description", F.lit("")).alias("description")).where("key <> ''")
