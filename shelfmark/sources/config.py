"""Stored settings: environment files, JSON maps, tag stores of every layout, model inventories, exported runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.settings import unquoted
from shelfmark.functions.text import clean_alias, stripped


def environment(lines: DataFrame, real: tuple[str, ...] = ()) -> DataFrame:
    """(key, value) of environment files' lines (file, number, line): .env.local before .env, the first line of a key counts, none that the ``real`` environment has.

    Blank lines, comments and lines without ``=`` or a key are left out.
    """
    text = stripped(F.regexp_replace("line", "^﻿", ""))
    kept = lines.where((text != "") & ~F.startswith(text, F.lit("#")) & F.contains(text, F.lit("=")))
    split = kept.select("file", "number", stripped(F.substring_index(text, "=", 1)).alias("key"), unquoted(F.regexp_replace(text, r"(?s)^[^=]*=", "")).alias("value"))
    named = split.where((F.col("key") != "") & ~F.col("key").isin(*real)) if real else split.where("key <> ''")
    order = Window.partitionBy("key").orderBy((F.col("file") != ".env.local"), "number")
    return named.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("key", "value")


def json_map(json: Column) -> Column:
    """A JSON object as a map of texts; empty for anything else."""
    return F.coalesce(F.when(F.startswith(stripped(json), F.lit("{")), F.from_json(json, "map<string,string>")), F.create_map().cast("map<string,string>"))


def alias_map(json: Column) -> Column:
    """Aliases of a JSON object, cleaned; entries that are empty or stand for themselves go."""
    entries = F.transform(F.map_entries(json_map(json)), lambda e: F.struct(clean_alias(e["key"]).alias("key"), clean_alias(e["value"]).alias("value")))
    good = F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != "") & (e["key"] != e["value"]))
    last = F.filter(good, lambda e, i: ~F.exists(F.slice(good, i + 2, F.greatest(F.size(good), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def saved_map(values: Column) -> Column:
    """What is stored of a map of secrets: without blank values; null (no file) if nothing is left."""
    left = F.map_filter(values, lambda _, v: stripped(F.coalesce(v, F.lit(""))) != "")
    return F.when(F.size(left) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(left)))))


_TAGS = "array<string>"


def _tag(item: Column) -> Column:
    """(key, description) of a tag that is an object or a text, as JSON."""
    given = F.startswith(item, F.lit("{"))
    key = F.when(given, F.get_json_object(item, "$.key")).otherwise(item)
    return F.struct(stripped(F.coalesce(key, F.lit(""))).alias("key"), stripped(F.coalesce(F.when(given, F.get_json_object(item, "$.description")), F.lit(""))).alias("description"))


def _tag_list(json: Column) -> Column:
    tags = F.transform(F.coalesce(F.from_json(json, _TAGS), F.array().cast(_TAGS)), _tag)
    return F.filter(tags, lambda t: t["key"] != "")


def tag_sets(stores: DataFrame, json: str) -> DataFrame:
    """Adds set_name, active, ord, key, description: one row a tag of the stores' JSON texts.

    Sets have a name and tags, which are objects or texts. A store without sets may be of
    the old layout: ``tags`` are one set, ``My tags``, and so is every one of its
    ``custom_lists`` with its categories. A store that can't be read has no rows.
    """
    field = lambda name: F.get_json_object(json, f"$.{name}")
    items = lambda text: F.coalesce(F.from_json(text, _TAGS), F.array().cast(_TAGS))
    one = lambda name, tags: F.struct(name.alias("set_name"), tags.alias("tags"))
    named = F.filter(items(field("sets")), lambda s: F.coalesce(F.get_json_object(s, "$.name") != "", F.lit(False)))
    new = F.transform(named, lambda s: one(F.get_json_object(s, "$.name"), _tag_list(F.get_json_object(s, "$.tags"))))
    own = F.filter(_tag_list(field("tags")), lambda t: t["key"] != "")
    lists = F.filter(items(field("custom_lists")), lambda s: F.coalesce(F.get_json_object(s, "$.name") != "", F.lit(False)))
    old = F.concat(F.array(one(F.lit("My tags"), own)), F.transform(lists, lambda s: one(F.get_json_object(s, "$.name"), _tag_list(F.get_json_object(s, "$.categories")))))
    sets = F.when(F.size(new) > 0, new).otherwise(F.when(field("tags").isNotNull(), old))
    rows = stores.select("*", stripped(F.coalesce(field("active_set"), F.lit(""))).alias("_active"), F.explode(sets).alias("_s"))
    rows = rows.select(*stores.columns, F.col("_s.set_name").alias("set_name"), (F.col("_s.set_name") == F.col("_active")).alias("active"), F.posexplode("_s.tags").alias("ord", "_t"))
    return rows.select(*stores.columns, "set_name", "active", "ord", F.col("_t.key").alias("key"), F.col("_t.description").alias("description"))


def model_ids(replies: DataFrame, json: str, by: str) -> DataFrame:
    """(by, ord, id): distinct model ids of a server's inventory reply, in order of the lower-cased id."""
    ids = F.array_distinct(F.filter(F.transform(F.from_json(F.get_json_object(json, "$.data"), _TAGS), lambda m: F.get_json_object(m, "$.id")), lambda i: F.coalesce(i != "", F.lit(False))))
    ordered = F.array_sort(F.transform(ids, lambda i: F.struct(F.lower(i).alias("low"), i.alias("id"))))
    return replies.select(by, F.posexplode(ordered).alias("ord", "m")).select(by, "ord", F.col("m.id").alias("id"))


def exported_run(spark: SparkSession, path: str, groups_schema: str, records_schema: str) -> tuple[DataFrame, DataFrame]:
    """(groups, records) of a run written by ``sinks.export_run``, for browsing."""
    return spark.read.schema(groups_schema).json(f"{path}/groups"), spark.read.schema(records_schema).json(f"{path}/records")
