"""Queries of stored settings, paths, messages, providers' answers and review state.

Where the input is text in several layouts, rows deal the layouts by number and the SQL
says what each of them means, worked out by hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmark.functions import settings as S
from shelfmark.functions import text
from shelfmark.functions.text import yes_or_no
from shelfmark.operators import groups as G
from shelfmark.operators import metrics as M
from shelfmark.operators import review as V
from shelfmark.plans.duplicates import _FILES, _KEEP, _STAR, _assembled, _components, files
from shelfmark.plans.labels import VOCABULARY
from shelfmark.plans.presets import QUALITY, classify_settings, start_blockers
from shelfmark.plans.runs import _review
from shelfmark.scratch import shared_dir
from shelfmark.sources import config, providers, sinks
from shelfmark.sources.scan import VIDEO, extension
from shelfmark.sources.tables import table


def _dealt(spark, sf_dir, values, name="raw"):
    """part rows, each with one of ``values`` by its number."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(values)).cast("int").alias("_k"))
    return p.select("p_partkey", F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.col("_k")).alias(name))


def _expected(values, kinds: str, columns: str) -> str:
    """SQL of part rows with the row of ``values`` that their number deals."""
    names = columns.split(", ")
    fields = ", ".join(f"CASE p_partkey % {len(values)} " + " ".join(f"WHEN {k} THEN {v[i]}" for k, v in enumerate(values)) + f" END::{kind} AS {name}" for i, (kind, name) in enumerate(zip(kinds.split(", "), names)))
    return f"SELECT p_partkey, {fields} FROM part"


# raw label, and what it stands for: aliases of the whole label, then of segments, and the root that has a tag of its own
ALIAS_VOCABULARY = text.Vocabulary(
    tags=VOCABULARY.tags, legacy=VOCABULARY.legacy, segment_aliases=VOCABULARY.segment_aliases, weak=VOCABULARY.weak, roots=("nature", "vehicle"), presets=VOCABULARY.presets,
    aliases={"my_dog": "animal/dog", "beach/sunset": "nature/sea", "pup": "dog/young", "shop": "buy", "odd": "###"}, special_roots=(("vehicle", ("vehicle", "racing", "motorsport"), "race_cars"),),
)
ALIASED = (
    ("My Dog", "animal/dog"), ("beach/sunset", "nature/sea"), ("beach/sand", "beach/sand"), ("pup/park", "dog/park"), ("shop", "buy"), ("odd/thing", "odd/thing"), ("vehicles/racing", "race_cars"),
    ("vehicles/motorsport/auto", "vehicle/car"), ("vehicle", "race_cars"), ("racing/vehicle/red", "vehicle/red"), ("click", "click"), ("photo/misc", "uncategorized"), ("nature", "landscape"),
)


def txt_auto_alias(spark, sf_dir):
    return _dealt(spark, sf_dir, [a for a, _ in ALIASED]).select("p_partkey", text.auto_label(F.col("raw"), ALIAS_VOCABULARY).alias("tag"))


ALIAS_MAPS = ('{"My Dog":"Animal/Dog","x":"x"," b ":"C d","!!":"z"}', "{}", "broken", '{"k":"!!"}')


def txt_alias_lines(spark, sf_dir):
    d = _dealt(spark, sf_dir, ALIAS_MAPS)
    return d.select("p_partkey", S.alias_lines(config.json_map(F.col("raw"))).alias("lines"), F.size(config.alias_map(F.col("raw"))).cast("long").alias("kept"))


SECONDS = (0, 0.4, 59.5, 60, 61, 150.5, 3599, 3600, 7325, -3)


def txt_eta(spark, sf_dir):
    d = _dealt(spark, sf_dir, SECONDS).withColumn("s", F.col("raw").cast("double"))
    return d.select("p_partkey", S.eta_words(F.col("s")).alias("words"), S.eta_about(F.col("s")).alias("about"))


PATHS = (
    ("/a/./b//c/", "/a/b/c"), ("/a/b/../c", "/a/c"), ("/../a", "/a"), ("a\\b\\..\\c", "a/c"), ("../x", "../x"), ("a/../../x", "../x"), ("/", "/"), ("A/B", "A/B"),
)


def txt_paths(spark, sf_dir):
    d = _dealt(spark, sf_dir, [p for p, _ in PATHS])
    return d.select("p_partkey", S.normalised_path(F.col("raw")).alias("path"), S.same_path(F.col("raw"), F.lit("a/b"), fold_case=True).alias("same"))


QUOTED = ((" 'x y' ", "x y"), ('"a"', "a"), ("'a\"", "'a\""), ("'", "'"), ("''", ""), ("plain", "plain"))


def cfg_unquote(spark, sf_dir):
    return _dealt(spark, sf_dir, [q for q, _ in QUOTED]).select("p_partkey", S.unquoted(F.col("raw")).alias("value"))


ENV_LINES = (
    (".env", 1, "A=1"), (".env", 2, "B = 'two words'"), (".env.local", 1, "# A=comment"), (".env.local", 2, "A=local=yes"), (".env.local", 3, "A=later"), (".env", 3, "REAL=no"), (".env", 4, "=x"), (".env", 5, "nothing"), (".env", 6, 'C="'),
)


def cfg_environment(spark, sf_dir):
    return config.environment(spark.createDataFrame(ENV_LINES, "file string, number int, line string"), real=("REAL",))


SECRETS = ('{"token":"t","blank":"  ","none":null}', '{"blank":""}', '{"b":"2","a":"1"}', "[]")


def cfg_secrets(spark, sf_dir):
    return _dealt(spark, sf_dir, SECRETS).select("p_partkey", config.saved_map(config.json_map(F.col("raw"))).alias("stored"))


STORES = (
    '{"sets":[{"name":"s","tags":[{"key":" a ","description":" x "},"b","",{"key":""}]},{"name":"","tags":["c"]}],"active_set":"s"}',
    '{"tags":[{"key":"a","description":"d"},{"nokey":1}],"custom_lists":[{"name":"l","categories":["p","q"]}],"active_set":"l"}',
    "broken",
    '{"sets":[],"active_set":""}',
)


def cfg_tag_store(spark, sf_dir):
    return config.tag_sets(_dealt(spark, sf_dir, STORES), "raw").drop("raw")


INVENTORIES = ('{"data":[{"id":"b"},{"id":"A"},{"id":"b"},{"name":"x"},{"id":""}]}', '{"data":[]}', "down")


def cfg_model_ids(spark, sf_dir):
    return config.model_ids(_dealt(spark, sf_dir, INVENTORIES), "raw", "p_partkey")


NUMBERS = ("7", "7.9", "-3", "1e9", "x", None, "0.5")


def cfg_clamps(spark, sf_dir):
    d = _dealt(spark, sf_dir, NUMBERS)
    return d.select("p_partkey", S.clamped_number(F.col("raw"), 1, 512, 28, whole=True).alias("whole"), S.clamped_number(F.col("raw"), 0.05, 0.95, 0.2).alias("share"))


MODELS = (
    # manual, listed, profile, saved -> model
    ("m", "c", "p", "s", "m"), ("local-model", "c", "p", "s", "c"), ("", "c", "", "", "c"), (" m ", "—", "p", "s", "m"), ("", "", "p", "s", "p"), ("", "", "local-model", "s", "s"), ("", "", "local-model", "", "local-model"), ("", "—", "", "", "local-model"),
)


def cfg_model_choice(spark, sf_dir):
    d = _dealt(spark, sf_dir, ["\x1f".join(m[:4]) for m in MODELS])
    part = lambda k: F.get(F.split("raw", "\x1f", -1), F.lit(k))
    return d.select("p_partkey", S.chosen_model(part(0), part(1), part(2), part(3)).alias("model"))


def cfg_quality(spark, sf_dir):
    """Presets with and without a graphics card, and with given settings before them."""
    rows = []
    for quality in (*QUALITY, "other"):
        for card in (False, True):
            for given in ({}, {"batch_size": 4000, "min_margin": 0.001}):
                s = classify_settings({"quality": quality, **given}, card)
                rows.append((quality, card, bool(given), s["model_name"], s["batch_size"], s["image_max_side"], s["min_margin"], s["prefetch_workers"], s["top_k_softmax"]))
    return spark.createDataFrame(rows, "quality string, card boolean, given boolean, model_name string, batch_size int, image_max_side int, min_margin double, workers int, top_k int")


def cfg_embedding_key(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = classify_settings({"quality": "max"})
    knobs = {**s, "multi_crop": F.col("p_partkey") % 2 == 0, "image_max_side": F.col("p_size").cast("int")}
    struct = F.struct(*((v if not isinstance(v, (str, bool, int, float)) else F.lit(v)).alias(k) for k, v in knobs.items()))
    key = S.embedding_key(struct)
    return p.select("p_partkey", key.alias("key"), (F.length(S.fingerprint(struct)) == 24).alias("sized"))


def cfg_blockers(spark, sf_dir):
    rows = [(n, ready, "|".join(start_blockers(n, ready))) for n in (0, 3) for ready in (False, True)]
    return spark.createDataFrame(rows, "tags int, ready boolean, blockers string")


def cfg_session_category(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.session_category(F.when(F.col("p_partkey") % 2 == 0, "preset").otherwise("auto"), F.col("p_brand")).alias("category"))


def cfg_prompt(spark, sf_dir):
    told = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("\n", S.context_line(F.lit("my_dog"), F.col("p_name")))).otherwise("  ")
    extra = F.when(F.col("p_partkey") % 3 == 0, " be brief ").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", S.system_prompt(F.lit("H"), F.lit("R"), F.array(F.concat(F.lit("a: "), F.col("p_type"))), told, extra).alias("prompt"))


def img_resized(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 5000).cast("long").alias("w"), (F.col("p_partkey") * 91 % 3000 + 1).cast("long").alias("h"))
    r = S.resized(F.col("w"), F.col("h"), 768)
    return p.select("p_partkey", r["width"].alias("width"), r["height"].alias("height"))


FRAMES = ('["0f","ff"]', '["0f"]', '["0f","zz"]', "broken", None, '["1","2","3"]')


def img_frame_hashes(spark, sf_dir):
    return _dealt(spark, sf_dir, FRAMES).select("p_partkey", F.array_join(F.transform(S.frame_hashes(F.col("raw")), lambda x: x.cast("string")), ",").alias("hashes"))


NAMES = ("a.MP4", "b.gif", "c.jpg", "d.mov", "e")


def img_needs_frames(spark, sf_dir):
    """Films need several frames, and so do moving pictures."""
    d = _dealt(spark, sf_dir, NAMES)
    return d.select("p_partkey", (extension(F.concat(F.lit("/"), "raw")).isin(*VIDEO) | ((extension(F.concat(F.lit("/"), "raw")) == ".gif") & (F.col("p_partkey") % 2 == 0))).alias("needs"))


def api_retry_delay(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", F.round(S.retry_delay(k % 6 + 1, k % 5 == 0, k % 7 == 0, (k % 11) / 10.0), 6).alias("seconds"))


def api_round_robin(spark, sf_dir):
    endpoints = spark.createDataFrame([("e0", 0, 0.0), ("e1", 1, 99.0), ("e2", 2, None), ("e3", 3, 10.0)], "endpoint string, pos int, cooling_until double")
    return M.round_robin(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], endpoints, 10.0)


def api_all_cooling(spark, sf_dir):
    endpoints = spark.createDataFrame([("e0", 0, 50.0), ("e1", 1, 40.0)], "endpoint string, pos int, cooling_until double")
    return M.round_robin(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], endpoints, 10.0).groupBy("endpoint").agg(F.count("*").alias("n"))


def mdl_retries(spark, sf_dir):
    """Three attempts for each item: the first with a category counts."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("item"), (F.col("event_id") % 3).alias("attempt"), F.when(F.col("event_type").isin("click", "view"), "uncategorized").otherwise(F.col("event_type")).alias("category"))
    return providers.first_success(e, "item", "attempt", "category")


def mdl_frame_cascade(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("item"), (F.col("event_id") % 3 + 1).alias("frames"), F.when(F.col("event_type").isin("click", "view"), "uncategorized").otherwise(F.col("event_type")).alias("category"), F.lit(0.5).alias("confidence"))
    votes = e.where("item % 2 = 0").select("item", F.lit("voted").alias("category")).distinct()
    return providers.cascade(e, "item", "frames", "category", "confidence", votes)


def mdl_pair_verification(spark, sf_dir):
    """Recorded replies of a vision model decide pairs; pairs without one stay undecided."""
    f = files(spark, sf_dir).select("id", "path")
    pairs = f.where("id % 2 = 0").select("id", F.col("path").alias("path_a")).join(f.select((F.col("id") - 1).alias("id"), F.col("path").alias("path_b")), "id")
    answers = pairs.where("id % 3 <> 0").select("path_a", "path_b", F.when(F.col("id") % 4 == 0, "Yes, the same.").otherwise("<think>yes</think> no").alias("reply"))
    told = providers.recorded(pairs, answers, ["path_a", "path_b"])
    return told.select("id", F.when(F.col("reply").isNotNull(), yes_or_no(F.col("reply"))).alias("same"))


def mt_scan_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 70).alias("done"), F.lit(60).alias("total"), (F.col("event_id") % 9).cast("double").alias("elapsed"))
    return M.scan_progress(e, "user_id", "event_id").select("user_id", "done", "total", F.round("rate", 6).alias("rate"), F.round("eta_s", 6).alias("eta_s"))


def mt_current_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3).alias("run_id"))
    current = e.groupBy("user_id").agg(F.max_by("run_id", "event_id").alias("run_id"))
    return M.current_messages(e, "run_id", current, "user_id").select("event_id")


STATES = {"click": "running", "view": "pausing", "purchase": "paused", "signup": "stopping", "error": "error"}


def mt_illegal_steps(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce(F.try_element_at(names, F.col("event_type").cast("string")), F.lit("finished")).alias("state"))
    return M.illegal_steps(e, "user_id", "event_id", "state").select("event_id", "before", "state")


def _members(spark, sf_dir):
    """One row a path of a group, with its flags and the suggested path of two groups in three."""
    r = _review(spark, sf_dir)
    flags = r.groupBy("group_id", "path").agg(F.max("keep").alias("keep"), F.max("approved").alias("approved"), F.max("skipped").alias("skipped"), F.max("delete_entire").alias("delete_entire"))
    best = flags.groupBy("group_id").agg(F.when(F.col("group_id") % 3 != 0, F.max("path")).alias("suggested_keep"))
    return flags.join(best, "group_id")


def rv_apply_suggestions(spark, sf_dir):
    return V.apply_suggestions(_members(spark, sf_dir)).select("group_id", "path", "keep")


def rv_approve_unskip(spark, sf_dir):
    g = _members(spark, sf_dir).select("group_id", "approved", "skipped").distinct()
    return V.unskip_all(V.approve_all(g))


def rv_persisted(spark, sf_dir):
    saved = V.persisted(_members(spark, sf_dir))
    return saved.select("group_id", F.from_json("state", V.SAVED).alias("s")).select("group_id", "s.skip", F.array_join("s.keep_paths", "|").alias("keep_paths"), "s.approved", "s.delete_entire")


def rv_restored(spark, sf_dir):
    """Groups whose kept paths are saved, saved in the old form, saved without a member, unreadable, or not saved."""
    m = _members(spark, sf_dir)
    last, k = F.max("path"), F.col("group_id") % 5
    states = m.groupBy("group_id").agg(last.alias("p")).select(
        "group_id",
        F.when(k == 0, F.concat(F.lit('{"skip":true,"approved":true,"keep_paths":["'), "p", F.lit('"]}')))
        .when(k == 1, F.concat(F.lit('{"reviewed":true,"keep_path":"'), "p", F.lit('"}')))
        .when(k == 2, F.lit('{"keep_paths":["gone"],"delete_entire":true}'))
        .when(k == 3, F.lit("broken"))
        .alias("state"),
    )
    return V.restored(m, states.where("state is not null")).select("group_id", "path", "keep", "approved", "skipped", "delete_entire")


def src_export_reload(spark, sf_dir):
    """Groups of a run, exported and read back."""
    f = files(spark, sf_dir).drop("text")
    found = G.assemble(G.members(f, G.exact_edges(f))).select("group_id", "paths", "suggested_keep", "is_exact")
    records = f.select("path", "size", "sha256")
    at = f"{shared_dir(spark).rstrip('/')}/shelfmark-{spark.sparkContext.applicationId}/export-{uuid.uuid4().hex}"
    sinks.export_run(found, records, at, root_path="r", media_mode="photos_only", strictness="balanced")
    groups, rows = config.exported_run(spark, at, "group_id string, paths array<string>, suggested_keep string, is_exact boolean", "path string, size long, sha256 string")
    counts = rows.agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))
    return groups.select("group_id", F.array_join("paths", "|").alias("paths"), "suggested_keep", "is_exact").crossJoin(counts)


QUERIES = {
    f.__name__: f
    for f in (
        txt_auto_alias, txt_alias_lines, txt_eta, txt_paths, cfg_unquote, cfg_environment, cfg_secrets, cfg_tag_store, cfg_model_ids, cfg_clamps, cfg_model_choice, cfg_quality, cfg_embedding_key, cfg_blockers,
        cfg_session_category, cfg_prompt, img_resized, img_frame_hashes, img_needs_frames, api_retry_delay, api_round_robin, api_all_cooling, mdl_retries, mdl_frame_cascade, mdl_pair_verification,
        mt_scan_progress, mt_current_messages, mt_illegal_steps, rv_apply_suggestions, rv_approve_unskip, rv_persisted, rv_restored, src_export_reload,
    )
}


def _q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _rows(rows, columns: str) -> str:
    """SQL of constant rows."""
    shown = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {shown}) AS t({columns})"


_MEM = """r AS (SELECT DISTINCT l_orderkey AS group_id, (CASE WHEN l_linenumber % 2 = 0 THEN 'B' ELSE 'a' END) || '/' || l_partkey AS path, l_linenumber FROM lineitem),
  m AS (SELECT group_id, path, max(l_linenumber = 1) AS keep, group_id % 2 = 0 AS approved, group_id % 6 = 0 AS skipped, group_id % 10 = 0 AS delete_entire FROM r GROUP BY group_id, path),
  b AS (SELECT group_id, max(path) AS p FROM m GROUP BY 1)"""
_HEAD = "Category alias rules (apply before creating new folders):"
_CAT = "CASE WHEN event_type IN ('click', 'view') THEN 'uncategorized' ELSE event_type END"
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in M.STEPS)
_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " ELSE 'finished' END"

SQL = {
    "txt_auto_alias": _expected([(_q(t),) for _, t in ALIASED], "VARCHAR", "tag"),
    "txt_alias_lines": _expected([(f"'{_HEAD}' || chr(10) || '- b => c_d' || chr(10) || '- my_dog => animal/dog'", 2), ("''", 0), ("''", 0), ("''", 0)], "VARCHAR, BIGINT", "lines, kept"),
    "txt_eta": _expected(
        [("'0 s'", "'—'"), ("'0 s'", "'~0 s'"), ("'60 s'", "'~1 min 0 s'"), ("'1 min'", "'~1 min 0 s'"), ("'1 min'", "'~1 min 1 s'"), ("'2 min'", "'~2 min 30 s'"), ("'59 min'", "'~59 min 59 s'"), ("'1 h 00 min'", "'~1 h 0 min'"), ("'2 h 02 min'", "'~2 h 2 min'"), ("'0 s'", "'—'")],
        "VARCHAR, VARCHAR", "words, about",
    ),
    "txt_paths": _expected([(_q(p), "true" if p == "A/B" else "false") for _, p in PATHS], "VARCHAR, BOOLEAN", "path, same"),
    "cfg_unquote": _expected([(_q(v),) for _, v in QUOTED], "VARCHAR", "value"),
    "cfg_environment": _rows([("A", "local=yes"), ("B", "two words"), ("C", '"')], "key, value"),
    "cfg_secrets": _expected([("""'{"token":"t"}'""",), ("NULL",), ("""'{"a":"1","b":"2"}'""",), ("NULL",)], "VARCHAR", "stored"),
    "cfg_tag_store": """SELECT p_partkey, set_name, active, ord::INT AS ord, key, description FROM part JOIN (VALUES (0, 's', true, 0, 'a', 'x'), (0, 's', true, 1, 'b', ''), (1, 'My tags', false, 0, 'a', 'd'), (1, 'l', true, 0, 'p', ''), (1, 'l', true, 1, 'q', '')) AS t(k, set_name, active, ord, key, description) ON k = p_partkey % 4""",
    "cfg_model_ids": "SELECT p_partkey, ord::INT AS ord, id FROM part JOIN (VALUES (0, 'A'), (1, 'b')) AS t(ord, id) ON p_partkey % 3 = 0",
    "cfg_clamps": _expected([(7, 0.95), (7, 0.95), (1, 0.05), (512, 0.95), (28, 0.2), (28, 0.2), (1, 0.5)], "BIGINT, DOUBLE", "whole, share"),
    "cfg_model_choice": _expected([(_q(m[4]),) for m in MODELS], "VARCHAR", "model"),
    "cfg_quality": """WITH q(quality, m0, m1, b0, b1, i0, i1, margin, w, k) AS (VALUES ('fast', 'ViT-B-32', 'ViT-B-32', 48, 96, 384, 384, 0.07, 6, 8), ('balanced', 'ViT-B-32', 'ViT-B-16', 32, 64, 448, 448, 0.08, 8, 10),
        ('max', 'ViT-B-16', 'ViT-L-14', 24, 36, 448, 512, 0.10, 8, 12), ('ultra', 'ViT-B-16', 'ViT-L-14', 20, 28, 480, 576, 0.11, 8, 15), ('other', 'ViT-B-16', 'ViT-L-14', 20, 28, 480, 576, 0.11, 8, 15))
      SELECT quality, card, given, CASE WHEN card THEN m1 ELSE m0 END AS model_name, CASE WHEN given THEN 512 WHEN card THEN b1 ELSE b0 END::INT AS batch_size, CASE WHEN card THEN i1 ELSE i0 END::INT AS image_max_side,
        CASE WHEN given THEN 0.01 ELSE margin END::DOUBLE AS min_margin, w::INT AS workers, k::INT AS top_k FROM q, (VALUES (true), (false)) AS c(card), (VALUES (true), (false)) AS g(given)""",
    "cfg_embedding_key": "SELECT p_partkey, 'ViT-B-16|openai|auto|fp16=1|side=' || p_size || '|crops=' || CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 1 END || '|tf=0.68|tpmax=0|cpool=1|topk=12|ex=0.32:0.12:1.20' AS key, true AS sized FROM part",
    "cfg_blockers": _rows([(0, False, "no_tags|no_encoder"), (0, True, "no_tags"), (3, False, "no_encoder"), (3, True, "")], "tags, ready, blockers"),
    "cfg_session_category": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'preset_' || p_brand ELSE 'auto' END AS category FROM part",
    "cfg_prompt": """SELECT p_partkey, 'H' || chr(10) || 'R' || chr(10) || chr(10) || 'Definitions (tag: meaning):' || chr(10) || 'a: ' || p_type || chr(10) || chr(10) ||
        CASE WHEN p_partkey % 2 = 0 THEN 'User context for recognition (match these descriptions to identify personal subjects):' || chr(10) || 'my_dog: ' || p_name ELSE 'User context: not provided. Use only visual content for classification.' END ||
        CASE WHEN p_partkey % 3 = 0 THEN chr(10) || chr(10) || 'Extra prompt settings:' || chr(10) || 'be brief' ELSE '' END AS prompt FROM part""",
    "img_resized": """WITH p AS (SELECT p_partkey, p_partkey * 37 % 5000 AS w, p_partkey * 91 % 3000 + 1 AS h FROM part), s AS (SELECT *, greatest(w, h) AS m FROM p)
      SELECT p_partkey, CASE WHEN m > 768 THEN greatest(1, round_even(w * (768.0::DOUBLE / m), 0)) ELSE w END::BIGINT AS width, CASE WHEN m > 768 THEN greatest(1, round_even(h * (768.0::DOUBLE / m), 0)) ELSE h END::BIGINT AS height FROM s""",
    "img_frame_hashes": _expected([("'15,255'",), ("NULL",), ("NULL",), ("NULL",), ("NULL",), ("'1,2,3'",)], "VARCHAR", "hashes"),
    "img_needs_frames": "SELECT p_partkey, p_partkey % 5 IN (0, 3) OR (p_partkey % 5 = 1 AND p_partkey % 2 = 0) AS needs FROM part",
    "api_retry_delay": """SELECT p_partkey, round(CASE WHEN p_partkey % 5 = 0 THEN least(12.0, 3.0 + 2.0 * (p_partkey % 6 + 1)) WHEN p_partkey % 7 = 0 THEN 0.5
        ELSE least(8.0, [1.5, 3.0, 5.0, 8.0, 8.0, 8.0][p_partkey % 6 + 1]::DOUBLE * (0.75 + 0.5 * (p_partkey % 11) / 10.0::DOUBLE)) END, 6)::DOUBLE AS seconds FROM part""",
    "api_round_robin": "SELECT p_partkey, CASE (row_number() OVER (ORDER BY p_partkey) - 1) % 3 WHEN 0 THEN 'e0' WHEN 1 THEN 'e2' ELSE 'e3' END AS endpoint FROM part",
    "api_all_cooling": "SELECT 'e1' AS endpoint, count(*) AS n FROM part",
    "mdl_retries": f"WITH a AS (SELECT event_id // 3 AS item, event_id % 3 AS attempt, {_CAT} AS category FROM events) SELECT item, attempt, category FROM a QUALIFY row_number() OVER (PARTITION BY item ORDER BY category = 'uncategorized', CASE WHEN category = 'uncategorized' THEN -attempt ELSE attempt END) = 1",
    "mdl_frame_cascade": f"""WITH a AS (SELECT event_id // 3 AS item, event_id % 3 + 1 AS frames, {_CAT} AS category FROM events), g AS (SELECT item, max(frames) FILTER (WHERE category <> 'uncategorized') AS f, arg_max(category, frames) FILTER (WHERE category <> 'uncategorized') AS c FROM a GROUP BY 1)
      SELECT item, CASE WHEN f IS NOT NULL THEN c WHEN item % 2 = 0 THEN 'voted' ELSE 'uncategorized' END AS category, CASE WHEN f IS NOT NULL THEN 'frames' || f WHEN item % 2 = 0 THEN 'vote' ELSE 'none' END AS via FROM g""",
    "mdl_pair_verification": "SELECT a.doc_id AS id, CASE WHEN a.doc_id % 3 <> 0 THEN a.doc_id % 4 = 0 END AS same FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0",
    "mt_scan_progress": """WITH l AS (SELECT user_id, max(event_id) AS e FROM events GROUP BY 1), s AS (SELECT user_id, e % 70 AS done, 60 AS total, CASE WHEN e % 9 = 0 THEN 0.0 ELSE (e % 70) / (e % 9)::DOUBLE END AS rate FROM l)
      SELECT user_id, done, total, round(rate, 6)::DOUBLE AS rate, round(CASE WHEN rate = 0 THEN 0.0 ELSE greatest(0, total - done) / rate END, 6)::DOUBLE AS eta_s FROM s""",
    "mt_current_messages": "WITH l AS (SELECT user_id, max(event_id) % 3 AS r FROM events GROUP BY 1) SELECT event_id FROM events JOIN l USING (user_id) WHERE event_id % 3 = r",
    "mt_illegal_steps": f"""WITH s AS (SELECT event_id, user_id, {_STATE} AS state FROM events), b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY event_id), 'idle') AS before FROM s)
      SELECT event_id, before, state FROM b WHERE before <> state AND (before, state) NOT IN ({_LEGAL})""",
    "rv_apply_suggestions": f"WITH {_MEM} SELECT group_id, path, CASE WHEN approved AND NOT skipped THEN group_id % 3 <> 0 AND path = p ELSE keep END AS keep FROM m JOIN b USING (group_id)",
    "rv_approve_unskip": f"WITH {_MEM} SELECT DISTINCT group_id, true AS approved, false AS skipped FROM m",
    "rv_persisted": f"WITH {_MEM} SELECT group_id, bool_or(skipped) AS skip, coalesce(string_agg(path, '|' ORDER BY path) FILTER (WHERE keep), '') AS keep_paths, bool_or(approved) AS approved, bool_or(delete_entire) AS delete_entire FROM m GROUP BY 1",
    "rv_restored": f"""WITH {_MEM} SELECT group_id, path, CASE group_id % 5 WHEN 0 THEN path = p WHEN 1 THEN path = p WHEN 2 THEN row_number() OVER (PARTITION BY group_id ORDER BY lower(path), path) = 1 ELSE keep END AS keep,
        CASE WHEN group_id % 5 IN (0, 1) THEN true WHEN group_id % 5 = 2 THEN false ELSE approved END AS approved, CASE group_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE skipped END AS skipped,
        CASE group_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true ELSE delete_entire END AS delete_entire FROM m JOIN b USING (group_id)""",
    "src_export_reload": f"""WITH RECURSIVE {_FILES}, {_components(_STAR.format('sha256'))}, {_assembled('files', _KEEP['pixels'], "sha256(array_to_string(paths, '|')) AS group_id, array_to_string(paths, '|') AS paths, suggested_keep, is_exact, (SELECT count(*) FROM files) AS records, (SELECT sum(size)::BIGINT FROM files) AS bytes")}""",
}
