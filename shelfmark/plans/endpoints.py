"""Model-server queries: events and parts stand for errors, messages and model lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import endpoints as E
from shelfmark.sources.tables import table

_KIND = "CASE event_id % 6 WHEN 0 THEN 'Timeout' WHEN 1 THEN 'HTTPError' WHEN 2 THEN 'HTTPError' WHEN 3 THEN 'KeyError' WHEN 4 THEN 'HTTPError' ELSE 'KeyError' END"
_STATUS = "CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 400 WHEN 2 THEN 404 WHEN 3 THEN 500 END"
_WORDS = "CASE event_id % 7 WHEN 0 THEN 'Channel Error' WHEN 1 THEN 'died with Exit Code 3' WHEN 2 THEN 'model reloaded' ELSE event_type END"
_MESSAGES = (
    "concat('{\"content\":\" ', t, ' \"}')",
    "concat('{\"content\":[{\"type\":\"text\",\"text\":\"a', t, '\"},{\"type\":\"image\"},{\"type\":\"text\",\"text\":\"b\"}]}')",
    "concat('{\"content\":\"<think>x\",\"reasoning\":\"', t, '\"}')",
    "'{\"content\":null,\"thought\":\" why \"}'",
    "'{}'",
)
_CASE = "CASE " + " ".join(f"WHEN event_id % 5 = {k} THEN {m}" for k, m in enumerate(_MESSAGES)) + " END"


def ep_retryable(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_KIND} AS kind", f"{_STATUS} AS status", f"{_WORDS} AS said")
    return e.select("event_id", E.retryable(F.col("kind"), F.col("status"), F.col("said")).alias("retry"), E.reloading(F.col("said")).alias("reload"))


def ep_model_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    models = p.where("p_partkey % 2 = 0").select(F.col("p_type").alias("id")).distinct()
    wanted = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).when(F.col("p_partkey") % 7 == 0, "— pick one").otherwise(F.concat(F.lit(" "), F.col("p_type"))).alias("model"))
    return E.canonical_model(wanted, models, "p_partkey", "model").select("p_partkey", "model", E.valid_model_id(F.col("model")).alias("valid"))


def ep_vision(spark, sf_dir):
    shapes = ("'{\"modalities\":[\"Text\",\"Image\"]}'", "'{\"capabilities\":[\"text\"]}'", "'{\"vision\":false,\"architecture\":\"qwen-vl\"}'", "'{\"architecture\":\"qwen2VL\"}'", "'{\"modalities\":[\"audio\"]}'", "'{}'")
    e = table(spark, sf_dir, "events").selectExpr("event_id", "CASE " + " ".join(f"WHEN event_id % 6 = {k} THEN {s}" for k, s in enumerate(shapes)) + " END AS record")
    return e.select("event_id", E.has_vision(F.col("record")).alias("vision"))


def ep_assistant_text(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS t").selectExpr("event_id", f"{_CASE} AS message")
    return e.select("event_id", E.assistant_text(F.col("message")).alias("said"))


def ep_instances(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"key":"k'), F.col("p_partkey"), F.lit('","state":"Loaded","loaded_context_length":4096}'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"id":"i'), F.col("p_partkey"), F.lit('","display_name":"N","loaded_instances":[{"id":"x","config":{"context_length":8,"parallel":2}},{"remaining_ttl_seconds":5}]}'))).otherwise('{"key":"z","state":"idle"}').alias("record"))
    return E.loaded_instances(p, "record").drop("record")


def ep_categories(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("set_name"), (F.col("p_brand") == "Brand#1").alias("active"), F.when(F.col("p_size") % 2 == 0, "base").otherwise("extended").alias("profile"), F.col("p_type").alias("key"), F.col("p_partkey").alias("ord"))
    return E.categories(p, "custom").withColumn("mode", F.lit("custom")).unionByName(E.categories(p, "preset").withColumn("mode", F.lit("preset")))


QUERIES = {f.__name__: f for f in (ep_retryable, ep_model_ids, ep_vision, ep_assistant_text, ep_instances, ep_categories)}

SQL = {
    "ep_retryable": f"""WITH e AS (SELECT event_id, {_KIND} AS kind, {_STATUS} AS status, lower({_WORDS}) AS said FROM events)
      SELECT event_id, said IN ('channel error', 'model reloaded') OR kind = 'Timeout' OR (kind = 'HTTPError' AND coalesce(status IN (429, 500) OR (status = 400 AND (contains(said, 'exit code') OR contains(said, 'model reloaded'))), false)) AS retry, contains(said, 'model reloaded') OR contains(said, 'exit code') AS reload FROM e""",
    "ep_model_ids": """WITH m AS (SELECT DISTINCT p_type AS id FROM part WHERE p_partkey % 2 = 0), w AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) WHEN p_partkey % 7 = 0 THEN '— pick one' ELSE p_type END AS model FROM part),
      f AS (SELECT p_partkey, coalesce(max(id) FILTER (WHERE id = model), max(id), any_value(model)) AS model FROM w LEFT JOIN m ON lower(id) = lower(model) GROUP BY p_partkey) SELECT p_partkey, model, NOT starts_with(model, '—') AS valid FROM f""",
    "ep_vision": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END AS vision FROM events",
    "ep_assistant_text": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'a' || event_type || 'b' WHEN 2 THEN event_type WHEN 3 THEN 'why' ELSE '' END AS said FROM events",
    "ep_instances": """SELECT p_partkey, 'k' || p_partkey AS model_key, 'k' || p_partkey AS instance_id, 'k' || p_partkey AS display_name, 4096::BIGINT AS context_length, NULL::BIGINT AS parallel, NULL::BIGINT AS remaining_ttl_seconds FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT p_partkey, 'i' || p_partkey, 'x', 'N', 8, 2, NULL FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'i' || p_partkey, 'i' || p_partkey, 'N', NULL, NULL, 5 FROM part WHERE p_partkey % 3 = 1""",
    "ep_categories": """SELECT p_type AS tag, min(p_partkey) AS ord, 'custom' AS mode FROM part WHERE p_brand = 'Brand#1' GROUP BY 1 UNION ALL SELECT p_type, min(p_partkey), 'preset' FROM part WHERE p_size % 2 = 0 GROUP BY 1
      UNION ALL SELECT 'uncategorized', 2147483647, 'preset' UNION ALL SELECT 'uncategorized', 2147483647, 'custom' WHERE EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#1')""",
}
