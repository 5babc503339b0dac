"""What a model server says, read in columns: errors, model ids, capabilities, replies, loaded instances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import let, strip_reasoning, stripped

# Error classes, status codes and words that are worth another try.
RETRY_KINDS = ("Timeout", "ConnectionError", "ValueError", "ChunkedEncodingError", "RequestException")
RETRY_STATUS = (429, 500, 502, 503)
RETRY_WORDS = ("channel error", "channel closed", "model reloaded", "model crashed")
RELOAD_WORDS = ("model reloaded", "model crashed", "exit code")
PLACEHOLDER_WORDS = ("нажмите", "пустой список", "placeholder")
VISION_WORDS = ("vision", "image", "multimodal")
THOUGHT_KEYS = ("reasoning_content", "reasoning", "thought")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w)) for w in words))


def retryable(kind: Column, status: Column, message: Column) -> Column:
    """Whether a failed request is worth another try. Kinds are exception names; HTTPError goes by status, 400 by its words."""
    http = F.coalesce(status.isin(*RETRY_STATUS) | ((status == 400) & _any(message, RELOAD_WORDS)), F.lit(False))
    return _any(message, RETRY_WORDS) | F.coalesce(kind.isin(*RETRY_KINDS), F.lit(False)) | (F.coalesce(kind == "HTTPError", F.lit(False)) & http)


def reloading(message: Column) -> Column:
    return _any(message, RELOAD_WORDS)


def valid_model_id(model: Column) -> Column:
    """False for blanks and placeholders of a selection box."""
    m = stripped(F.coalesce(model, F.lit("")))
    return (m != "") & ~m.rlike("^[—–]") & ~_any(m, PLACEHOLDER_WORDS)


def canonical_model(wanted: DataFrame, models: DataFrame, key: str, model: str) -> DataFrame:
    """(key, model): the id as listed; else one that differs by case alone (the greatest listed); else as given."""
    low = models.groupBy(F.lower("id").alias("_low")).agg(F.collect_set("id").alias("_ids"))
    found = wanted.join(low, F.lower(F.trim(F.col(model))) == F.col("_low"), "left")
    m = F.trim(F.col(model))
    return found.select(key, F.when(F.array_contains("_ids", m), m).otherwise(F.coalesce(F.array_max("_ids"), m)).alias(model))


def has_vision(record: Column) -> Column:
    """True, false, or null where the record of a model (JSON) doesn't tell."""
    out = F.when(F.lower(F.get_json_object(record, "$.architecture")).rlike("vision|vl|mm"), True)
    flag = F.get_json_object(record, "$.vision")
    out = F.when(flag.isin("true", "false"), flag == "true").otherwise(out)
    for key in ("capabilities", "modalities"):
        listed = F.from_json(F.get_json_object(record, f"$.{key}"), "array<string>")
        told = F.when(F.exists(listed, lambda x: _any(x, VISION_WORDS)), True).when((F.size(listed) > 0) & F.forall(listed, lambda x: F.lower(x).isin("text", "language")), False)
        out = F.coalesce(told, out)
    return out


def assistant_text(message: Column) -> Column:
    """The content of a message (JSON): its text or text parts, else what it thought; without reasoning wrappers."""
    content = F.get_json_object(message, "$.content")
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    text = F.when(F.startswith(content, F.lit("[")), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(F.coalesce(content, F.lit("")))
    options = F.array(text, *(F.coalesce(F.get_json_object(message, f"$.{k}"), F.lit("")) for k in THOUGHT_KEYS))
    cleaned = F.filter(F.transform(options, lambda x: strip_reasoning(stripped(x))), lambda x: x != "")
    return let(cleaned, lambda xs: F.coalesce(F.get(xs, F.lit(0)), F.lit("")))


INSTANCES = "struct<key:string,id:string,display_name:string,state:string,loaded_context_length:bigint,loaded_instances:array<struct<id:string,config:struct<context_length:bigint,parallel:bigint>,remaining_ttl_seconds:bigint>>>"


def loaded_instances(models: DataFrame, record: str) -> DataFrame:
    """One row a loaded instance; a model that says it is loaded without listing any counts as one."""
    m = models.select("*", F.from_json(record, INSTANCES).alias("m"))
    key = F.coalesce(F.nullif(F.col("m.key"), F.lit("")), F.col("m.id"), F.lit(""))
    listed = F.coalesce("m.loaded_instances", F.array().cast("array<struct<id:string,config:struct<context_length:bigint,parallel:bigint>,remaining_ttl_seconds:bigint>>"))
    own = F.array(F.struct(key.alias("id"), F.struct(F.col("m.loaded_context_length").alias("context_length"), F.lit(None).cast("long").alias("parallel")).alias("config"), F.lit(None).cast("long").alias("remaining_ttl_seconds")))
    rows = m.withColumn("i", F.explode(F.when((F.size(listed) == 0) & (F.lower("m.state") == "loaded"), own).otherwise(listed)))
    return rows.select(*models.columns, key.alias("model_key"), F.coalesce(F.nullif(F.col("i.id"), F.lit("")), key).alias("instance_id"), F.coalesce(F.nullif(F.col("m.display_name"), F.lit("")), key).alias("display_name"), F.col("i.config.context_length").alias("context_length"), F.col("i.config.parallel").alias("parallel"), F.col("i.remaining_ttl_seconds").alias("remaining_ttl_seconds"))


def categories(tags: DataFrame, mode: str, profile: str = "base") -> DataFrame:
    """(tag, ord) for a mode. tags: set_name, active, profile, key, ord.

    Custom and hybrid modes take the active set, the others the sets of the profile and
    of ``base``; uncategorized comes last. A custom mode without tags has none.
    """
    custom = mode in ("custom", "hybrid")
    chosen = tags.where("active" if custom else F.col("profile").isin("base", profile))
    distinct = chosen.where("key <> 'uncategorized'").groupBy("key").agg(F.min("ord").alias("ord")).select(F.col("key").alias("tag"), "ord")
    last = chosen.limit(1).select(F.lit("uncategorized").alias("tag"), F.lit(2**31 - 1).cast("long").alias("ord"))
    return distinct.select("tag", F.col("ord").cast("long").alias("ord")).unionByName(last)
