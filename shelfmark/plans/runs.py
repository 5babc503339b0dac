"""State, review, metrics and naming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import metrics as M
from shelfmark.operators import naming as N
from shelfmark.operators import review as V
from shelfmark.operators import state as S
from shelfmark.sources.tables import table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _files(spark, sf_dir):
    """Known digests: customers stand for contents, every third pending, versions 1 and 2."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.sha2(F.col("c_name"), 256).alias("sha256"), F.when(F.col("c_custkey") % 3 == 0, "pending").otherwise("processed").alias("status"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("category"), (F.col("c_custkey") % 2 + 1).cast("int").alias("pipeline_version"))


def st_upsert_state(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.sha2("c_name", 256).alias("sha256"))
    s = table(spark, sf_dir, "supplier").select(F.sha2("s_name", 256).alias("sha256"))
    return S.upsert_files(_files(spark, sf_dir), c.unionByName(s).unionByName(c), 2)


def st_merge_sessions(spark, sf_dir):
    old = _orders(spark, sf_dir).where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("status"), F.col("o_totalprice").alias("started"))
    new = _orders(spark, sf_dir).where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("status"), F.lit(-1.0).alias("started"), F.lit(7).alias("extra"))
    return S.merge(old, new, ["k"], keep_old=("started",))


def _items(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select(F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") * 10).alias("mtime"), F.floor("o_totalprice").cast("long").alias("size"), "o_orderkey", "o_orderstatus")


def st_resume_anti(spark, sf_dir):
    items = _items(spark, sf_dir)
    done = items.select("path", F.when(F.col("o_orderkey") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size", F.when(F.col("o_orderstatus") == "F", "done").otherwise("error").alias("status"), F.when(F.col("o_orderkey") % 11 == 0, "t").otherwise("s").alias("session_key"))
    return S.still_to_do(items, done, "s").select("o_orderkey")


def st_processed_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha256"))
    return S.unprocessed(c, _files(spark, sf_dir), 2).select("c_custkey")


def st_cache_hit_split(spark, sf_dir):
    items = _items(spark, sf_dir).select("o_orderkey", F.col("path").alias("path_norm"), "mtime", "size")
    moving = items.withColumn("multiframe", F.col("o_orderkey") % 8 == 0)
    return S.with_cache(moving, _cache(items), 2, exact=True, visual=True).select("o_orderkey", "hit")


def _cache(items):
    """Signatures of some items: some of another time, of other versions, without hashes or without frame hashes."""
    k = F.col("o_orderkey")
    return items.where(k % 4 != 1).select(
        "path_norm",
        F.when(k % 5 == 0, F.lit(0)).otherwise(F.col("mtime")).alias("mtime"),
        "size",
        (k % 3).alias("sig_version"),
        F.lit("x").alias("sha256"),
        F.when(k % 2 == 0, F.lit(1)).alias("phash"),
        F.when(k % 16 == 0, F.array(F.lit(1), F.lit(2))).alias("phash_frames"),
    )


def st_cache_only(spark, sf_dir):
    items = _items(spark, sf_dir).select("o_orderkey", F.col("path").alias("path_norm"), "mtime", "size")
    return S.from_cache(items, _cache(items), visual=True).select("o_orderkey", "sha256", "phash")


def st_resume_duplicates(spark, sf_dir):
    """What a resumed scan takes from the cache, and what it computes again."""
    items = _items(spark, sf_dir).select("o_orderkey", F.col("path").alias("path_norm"), "mtime", "size")
    k = F.col("o_orderkey")
    done = items.select("path_norm", F.when(k % 3 == 0, "done").otherwise("error").alias("status"), F.when(k % 11 == 0, "t").otherwise("s").alias("session_key"))
    kept, left = S.resumed(items, done, "s", _cache(items), visual=False)
    return kept.select("o_orderkey", F.lit("cached").alias("state")).unionByName(left.select("o_orderkey", F.lit("compute").alias("state")))


def st_cached_vectors(spark, sf_dir):
    """The cache holds two models and sides, and vectors whose length isn't the one they say."""
    e = table(spark, sf_dir, "embeddings").withColumn("sha256", F.sha2(F.col("vec_id").cast("string"), 256))
    cache = e.select("sha256", F.when(F.col("vec_id") % 3 == 0, "other").otherwise("m").alias("model_key"), F.when(F.col("vec_id") % 5 == 0, 384).otherwise(576).alias("image_max_side"), F.when(F.col("vec_id") % 7 == 0, 1).otherwise(F.size("embedding")).alias("dim"), F.col("embedding").alias("vec"))
    asked = e.where("vec_id % 2 = 0").select("sha256")
    return S.cached_vectors(asked.unionByName(asked), cache, "m", 576).select("sha256", F.size("vec").alias("dim"))


def st_hash_cache(spark, sf_dir):
    items = _items(spark, sf_dir).select("o_orderkey", F.col("path").alias("path_norm"), "mtime", "size")
    known = items.where("o_orderkey % 3 <> 0").select("path_norm", F.when(F.col("o_orderkey") % 5 == 0, F.lit(0)).otherwise(F.col("mtime")).alias("mtime"), "size", F.lit("cached").alias("sha256"))
    files, new = S.with_digests(items, known, F.sha2("path_norm", 256))
    return files.select("o_orderkey", "sha256").join(new.select("path_norm", F.lit(True).alias("added")).join(items, "path_norm").select("o_orderkey", "added"), "o_orderkey", "left").select("o_orderkey", "sha256", F.coalesce("added", F.lit(False)).alias("added"))


def st_mark_processed(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    done = c.where("c_custkey % 4 = 0").select(F.sha2("c_name", 256).alias("sha256"), F.lit("new").alias("category")).unionByName(s.select(F.sha2("s_name", 256).alias("sha256"), F.lit("new").alias("category")))
    return S.mark_processed(_files(spark, sf_dir), done, 3)


def st_cache_counts(spark, sf_dir):
    return S.cache_counts(sort_records=table(spark, sf_dir, "customer"), duplicate_signatures=table(spark, sf_dir, "documents"))


def st_asks_to_resume(spark, sf_dir):
    return S.asks_to_resume(_sessions(spark, sf_dir)).select("session_key", "status")


def st_pair_decisions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("a/"), F.col("p_partkey").cast("string")).alias("x"), F.concat(F.lit("b/"), F.col("p_partkey").cast("string")).alias("y"), "p_partkey")
    stored = p.where("p_partkey % 3 <> 0").select(F.when(F.col("p_partkey") % 5 == 0, "other").otherwise("s").alias("session_key"), F.col("x").alias("path_a"), F.col("y").alias("path_b"), (F.col("p_partkey") % 2 == 0).alias("decision"))
    return S.pair_decisions(stored, "s", p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("y")).otherwise(F.col("x")).alias("path_a"), F.when(F.col("p_partkey") % 2 == 0, F.col("x")).otherwise(F.col("y")).alias("path_b")))


def st_clear_session(spark, sf_dir):
    items = _orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderstatus")).alias("session_key"))
    return S.without(items, F.col("session_key") == "F")


def _sessions(spark, sf_dir):
    o = _orders(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("paused")
    return o.select(F.col("o_orderkey").cast("string").alias("session_key"), status.alias("status"), (F.col("o_orderkey") % 10).alias("done"), (F.col("o_orderkey") % 13).alias("total"), F.col("o_totalprice").alias("updated_at"))


def st_latest_incomplete(spark, sf_dir):
    return S.latest_incomplete(_sessions(spark, sf_dir)).select("session_key", "status")


def st_sessions_interrupt(spark, sf_dir):
    return S.interrupt_running(_sessions(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def st_session_keys(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", S.session_key(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")).alias("session_key"))


def st_newest_embedding(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("written"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return S.newest(e, ["k"], "seq").select("k", "written", "seq")


def _members(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("group_id"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, "B").otherwise("a"), F.lit("/"), F.col("l_partkey").cast("string")).alias("path"), "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("ls")).distinct()


def rv_keep_flags(spark, sf_dir):
    m = _members(spark, sf_dir).select("group_id", "path").distinct().withColumn("suggested_keep", F.when(F.col("group_id") % 3 == 0, F.lit("none")).otherwise(F.col("path")))
    best = m.groupBy("group_id").agg(F.max("suggested_keep").alias("suggested_keep"))
    return V.keep_flags(m.select("group_id", "path").join(best, "group_id")).select("group_id", "path", "keep")


def _groups(spark, sf_dir):
    g = _members(spark, sf_dir).groupBy(F.col("group_id").alias("ordinal")).agg(F.count_distinct("path").alias("n"), F.min("path").alias("first_path"), (F.min("flag") == F.max("flag")).alias("is_exact"))
    return g.withColumn("skipped", F.col("ordinal") % 6 == 0)


def rv_filter_sort(spark, sf_dir):
    return V.filtered(V.skip_small(_groups(spark, sf_dir), 3), least=2, kind="similar", skipped="active", order="name").select("ordinal", "n", "first_path")


def _review(spark, sf_dir):
    m = _members(spark, sf_dir)
    return m.select("group_id", "path", (F.col("l_linenumber") == 1).alias("keep"), (F.col("group_id") % 2 == 0).alias("approved"), (F.col("group_id") % 6 == 0).alias("skipped"), (F.col("group_id") % 10 == 0).alias("delete_entire"))


def rv_delete_plan(spark, sf_dir):
    return V.deletion_plan(_review(spark, sf_dir))


def rv_scope(spark, sf_dir):
    r = _review(spark, sf_dir)
    return V.scope(r, V.deletion_plan(r), V.filtered(_groups(spark, sf_dir), least=3))


def rv_page(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return V.page(e.select("event_type", "event_id"), "event_type", ["event_id"], 1).select("event_type", "event_id")


def mt_rolling_eta(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.abs("value"), 2).alias("seconds"))
    return M.rolling_eta(e, "user_id", "event_id", "seconds", F.lit(80), 3).select("event_id", F.round("mean_s", 6).alias("mean_s"), F.round("eta_s", 4).alias("eta_s"))


def _epochs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"), "value")


def mt_error_storm(spark, sf_dir):
    """Runs of many users at once, in hundredths of the tables' seconds, so that windows of 12 seconds hold up to several errors."""
    e = _epochs(spark, sf_dir).where("event_type = 'error'").select("event_id", (F.col("user_id") % 3).alias("run"), F.floor(F.col("epoch") / 100).alias("epoch"))
    return M.error_storms(e, "run", "epoch", 1, F.col("event_id") % 50 == 0).select("event_id", "recent", "cooldown_s")


def mt_run_summary(spark, sf_dir):
    e = _epochs(spark, sf_dir).select("user_id", F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("other").alias("kind"), "epoch", F.when(F.col("event_type") == "view", F.round("value", 2)).alias("api_s"))
    return M.run_summary(e, "user_id").select("user_id", "done", "errors", "seconds", F.round("mean_api_s", 6).alias("mean_api_s"), F.round("files_per_sec", 9).alias("files_per_sec"))


def mt_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 70).alias("done"), (F.col("user_id") % 90 + 1).alias("total"))
    return M.progress(e, "user_id", "event_id")


def mt_refs_fingerprint(spark, sf_dir):
    return M.exemplar_fingerprint(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


def mt_exemplar_cap(spark, sf_dir):
    return M.capped_exemplars(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 48).select("p_brand", "p_partkey")


def mt_unload_set(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("instance"), F.col("p_partkey").alias("pos"), (F.substring("p_brand", -1, 1).cast("int") % 2 == 0).alias("active"))
    return M.unload_set(p, "k", "instance", "pos", "active").select("k", "pos")


def _copy_plan(spark, sf_dir):
    """Names of few kinds in few folders, of which some look like numbered forms of others."""
    p = table(spark, sf_dir, "part")
    stem = F.concat(F.when(F.col("p_partkey") % 2 == 0, "IMG").otherwise("img"), F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("_"), (F.col("p_size") % 4).cast("string"))).otherwise(""))
    name = F.concat(stem, F.when(F.col("p_size") % 3 == 0, "").otherwise(".jpg"))
    digest = F.when(F.col("p_partkey") % 9 != 0, F.sha2(F.concat("p_type", F.col("p_size").cast("string")), 256))
    return p.select(F.concat(F.lit("src/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("source"), F.col("p_brand").alias("dest_dir"), name.alias("name"), digest.alias("sha256"))


def _there(spark, sf_dir):
    """Files of every fifth folder: numbered ones, of which some have a planned content."""
    p = table(spark, sf_dir, "part").where("p_partkey % 5 = 0 AND p_partkey % 9 <> 0 AND p_size % 3 <> 0")
    return p.select(F.col("p_brand").alias("dest_dir"), F.concat(F.lit("IMG_"), (F.col("p_partkey") % 7).cast("string"), F.lit(".jpg")).alias("name"), F.sha2(F.concat("p_type", F.col("p_size").cast("string")), 256).alias("sha256")).groupBy("dest_dir", "name").agg(F.min("sha256").alias("sha256"))


def snk_unique_names(spark, sf_dir):
    """How many contents have a destination, how many destinations there are, how many are taken: every content its own, none of another file."""
    there = _there(spark, sf_dir)
    out = N.destinations(_copy_plan(spark, sf_dir), there).withColumn("low", F.lower("dest")).withColumn("c", F.coalesce("sha256", F.concat(F.lit("path:"), F.col("source"))))
    held = there.select(F.lower(F.concat_ws("/", "dest_dir", "name")).alias("low"), F.col("sha256").alias("held"))
    by_dest = out.groupBy("dest_dir", "low").agg(F.count_distinct("c").alias("contents"), F.min("c").alias("c")).join(held, "low", "left")
    lost = (F.col("contents") > 1) | F.coalesce(F.col("held") != F.col("c"), F.lit(False))
    sums = by_dest.groupBy("dest_dir").agg(F.sum(lost.cast("long")).alias("overwritten"))
    return out.groupBy("dest_dir").agg(F.count("*").alias("files"), F.count_distinct("c", F.lower("name")).alias("named_contents")).join(sums, "dest_dir")


def snk_names_of_empty_folders(spark, sf_dir):
    """Names without numbers of their own: contents are numbered in order of their least source."""
    plain = _copy_plan(spark, sf_dir).withColumn("name", F.regexp_replace("name", r"_\d", "x"))
    return N.destinations(plain).select("source", "dest")


def snk_space_guard(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", F.floor("o_totalprice").cast("long").alias("size"))
    return N.space_guard(o, "o_orderkey", "size", 300_000_000, 64 << 20).select("o_orderkey", "running", "fits")


QUERIES = {f.__name__: f for f in (st_upsert_state, st_merge_sessions, st_resume_anti, st_processed_anti, st_cache_hit_split, st_cache_only, st_resume_duplicates, st_cached_vectors, st_hash_cache, st_mark_processed, st_cache_counts, st_asks_to_resume, st_pair_decisions, st_clear_session, st_latest_incomplete, st_sessions_interrupt, st_session_keys, st_newest_embedding, rv_keep_flags, rv_filter_sort, rv_delete_plan, rv_scope, rv_page, mt_rolling_eta, mt_error_storm, mt_run_summary, mt_progress, mt_refs_fingerprint, mt_exemplar_cap, mt_unload_set, snk_unique_names, snk_names_of_empty_folders, snk_space_guard)}

_MEM = "m AS (SELECT DISTINCT l_orderkey AS group_id, (CASE WHEN l_linenumber % 2 = 0 THEN 'B' ELSE 'a' END) || '/' || l_partkey AS path, l_linenumber, l_returnflag AS flag FROM lineitem)"
_GRP = f"{_MEM}, g AS (SELECT group_id AS ordinal, count(DISTINCT path) AS n, min(path) AS first_path, min(flag) = max(flag) AS is_exact, group_id % 6 = 0 AS skipped FROM m GROUP BY group_id)"
_REV = f"{_GRP}, r AS (SELECT group_id, path, l_linenumber = 1 AS keep, group_id % 10 = 0 AS entire FROM m WHERE group_id % 2 = 0 AND group_id % 6 <> 0), plan AS (SELECT path, min(group_id) AS group_id FROM r WHERE entire OR NOT keep GROUP BY path HAVING path NOT IN (SELECT path FROM r WHERE keep AND NOT entire))"
_SES = "s AS (SELECT o_orderkey::VARCHAR AS session_key, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'paused' END AS status, o_orderkey % 10 AS done, o_orderkey % 13 AS total, o_totalprice AS updated_at FROM orders)"

SQL = {
    "st_upsert_state": """WITH f AS (SELECT sha256(c_name) AS sha256, CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'processed' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS category, c_custkey % 2 + 1 AS v, c_custkey % 5 = 0 AS seen FROM customer)
      SELECT sha256, CASE WHEN seen AND NOT (status = 'processed' AND v = 2) THEN 'pending' ELSE status END AS status, CASE WHEN seen AND v <> 2 THEN NULL ELSE category END AS category, (CASE WHEN seen THEN 2 ELSE v END)::INT AS pipeline_version, CASE WHEN seen THEN CASE WHEN status = 'processed' AND v = 2 THEN 'skip' ELSE 'process' END END AS action FROM f
      UNION ALL SELECT sha256(s_name), 'pending', NULL, 2, 'process' FROM supplier""",
    "st_merge_sessions": """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS started FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0)
      SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN 'new' ELSE 'old' END AS status, CASE WHEN o.k IS NOT NULL THEN started ELSE -1.0 END AS started, CASE WHEN n.k IS NOT NULL THEN 7 END AS extra FROM o FULL JOIN n ON o.k = n.k""",
    "st_resume_anti": "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 7 <> 0 AND o_orderstatus = 'F' AND o_orderkey % 11 <> 0)",
    "st_processed_anti": "SELECT c_custkey FROM customer WHERE NOT (c_custkey % 3 <> 0 AND c_custkey % 2 = 1)",
    "st_cache_hit_split": "SELECT o_orderkey, o_orderkey % 4 <> 1 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 AND (o_orderkey % 8 <> 0 OR o_orderkey % 16 = 0) AS hit FROM orders",
    "st_cache_only": "SELECT o_orderkey, 'x' AS sha256, 1 AS phash FROM orders WHERE o_orderkey % 4 <> 1 AND (o_orderkey % 5 <> 0 OR o_orderkey = 0) AND o_orderkey % 2 = 0",
    "st_resume_duplicates": """WITH o AS (SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0 AS done, o_orderkey % 4 <> 1 AND o_orderkey % 5 <> 0 AS cached FROM orders)
      SELECT o_orderkey, CASE WHEN done THEN 'cached' ELSE 'compute' END AS state FROM o WHERE cached OR NOT done""",
    "st_cached_vectors": "SELECT sha256(vec_id::VARCHAR) AS sha256, len(embedding)::INT AS dim FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 <> 0 AND vec_id % 5 <> 0 AND vec_id % 7 <> 0",
    "st_hash_cache": "SELECT o_orderkey, CASE WHEN hit THEN 'cached' ELSE sha256('p/' || o_orderkey) END AS sha256, NOT hit AS added FROM (SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS hit FROM orders)",
    "st_mark_processed": """WITH f AS (SELECT sha256(c_name) AS sha256, c_custkey % 4 = 0 AS done, CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'processed' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS category, c_custkey % 2 + 1 AS v FROM customer)
      SELECT sha256, CASE WHEN done THEN 'processed' ELSE status END AS status, CASE WHEN done THEN 'new' ELSE category END AS category, (CASE WHEN done THEN 3 ELSE v END)::INT AS pipeline_version FROM f
      UNION ALL SELECT sha256(s_name), 'processed', 'new', 3 FROM supplier""",
    "st_cache_counts": "SELECT (SELECT count(*) FROM customer) AS sort_records, (SELECT count(*) FROM documents) AS duplicate_signatures",
    "st_asks_to_resume": f"WITH {_SES} SELECT session_key, status FROM s WHERE total > 0 AND NOT (done >= total AND status = 'completed')",
    "st_pair_decisions": "SELECT 'a/' || p_partkey AS path_a, 'b/' || p_partkey AS path_b, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN p_partkey % 2 = 0 END AS decision FROM part",
    "st_clear_session": "WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS session_key FROM orders) SELECT * FROM s WHERE session_key IS DISTINCT FROM 'F'",
    "st_latest_incomplete": f"WITH {_SES} SELECT session_key, status FROM s WHERE status IN ('running', 'paused') AND (total <= 0 OR done < total) ORDER BY updated_at DESC, session_key LIMIT 1",
    "st_sessions_interrupt": f"WITH {_SES} SELECT CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status, count(*) AS n FROM s GROUP BY 1",
    "st_session_keys": "SELECT o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority || '|' || o_custkey) AS session_key FROM orders",
    "st_newest_embedding": "SELECT l_partkey AS k, arg_max(l_orderkey || '/' || l_linenumber, l_orderkey * 10 + l_linenumber) AS written, max(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1",
    "rv_keep_flags": f"""WITH {_MEM}, d AS (SELECT DISTINCT group_id, path FROM m) SELECT group_id, path, CASE WHEN group_id % 3 = 0 THEN row_number() OVER (PARTITION BY group_id ORDER BY lower(path), path) = 1 ELSE path = max(path) OVER (PARTITION BY group_id) END AS keep FROM d""",
    "rv_filter_sort": f"WITH {_GRP} SELECT ordinal, n, first_path FROM g WHERE n >= 3 AND NOT is_exact AND NOT skipped",
    "rv_delete_plan": f"WITH {_REV} SELECT path, group_id FROM plan",
    "rv_scope": f"WITH {_REV} SELECT (SELECT count(*) FROM plan) AS files, (SELECT count(DISTINCT group_id) FROM plan) AS groups_deleting, (SELECT count(DISTINCT group_id) FROM m) AS groups, (SELECT count(*) FROM g WHERE n >= 3) AS shown",
    "rv_page": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) BETWEEN 201 AND 400",
    "mt_rolling_eta": """WITH e AS (SELECT user_id, event_id, round(abs(value), 2) AS s FROM events), r AS (SELECT event_id, avg(s) OVER w AS mean_s, greatest(0, 80 - row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS remaining FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
      SELECT event_id, round(mean_s, 6) AS mean_s, round(remaining * mean_s / 3, 4) AS eta_s FROM r""",
    "mt_error_storm": """WITH e AS (SELECT event_id, user_id % 3 AS run, floor(floor(epoch(ts)) / 100)::BIGINT AS h FROM events WHERE event_type = 'error'), r AS (SELECT event_id, count(*) OVER (PARTITION BY run ORDER BY h RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS recent FROM e)
      SELECT event_id, recent, (CASE WHEN event_id % 50 = 0 THEN 6 WHEN recent >= 4 THEN 2 ELSE 0 END)::INT AS cooldown_s FROM r""",
    "mt_run_summary": """WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS errors, (max(floor(epoch(ts))) - min(floor(epoch(ts))))::DOUBLE AS seconds, coalesce(avg(round(value, 2)) FILTER (WHERE event_type = 'view'), 0.0) AS a FROM events GROUP BY user_id)
      SELECT user_id, done, errors, seconds, round(a, 6) AS mean_api_s, round(CASE WHEN seconds = 0 THEN 0.0 ELSE done / seconds END, 9) AS files_per_sec FROM s""",
    "mt_progress": "WITH l AS (SELECT user_id, max(event_id) AS e FROM events GROUP BY 1) SELECT sum(e % 70)::BIGINT AS done, sum(user_id % 90 + 1)::BIGINT AS total FROM l",
    "mt_refs_fingerprint": "WITH t AS (SELECT p_brand || ':' || count(*) || ':' || max(p_partkey) AS p FROM part GROUP BY p_brand) SELECT substr(sha256(string_agg(p, '|' ORDER BY p)), 1, 16) AS fingerprint FROM t",
    "mt_exemplar_cap": "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 48",
    "mt_unload_set": """WITH i AS (SELECT p_brand AS k, p_partkey AS pos, (CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END) = p_brand AS own, right(p_brand, 1)::INT % 2 = 0 AS active FROM part)
      SELECT k, pos FROM i QUALIFY NOT (active AND row_number() OVER (PARTITION BY k ORDER BY own DESC, pos) = 1)""",
    "snk_unique_names": """WITH p AS (SELECT p_brand AS dest_dir, lower('img' || CASE WHEN p_size % 4 > 0 THEN '_' || (p_size % 4) ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.jpg' END) AS low, CASE WHEN p_partkey % 9 <> 0 THEN sha256(p_type || p_size) ELSE 'path:' || p_partkey END AS c FROM part)
      SELECT dest_dir, count(*) AS files, count(DISTINCT (c, low)) AS named_contents, 0::BIGINT AS overwritten FROM p GROUP BY dest_dir""",
    "snk_names_of_empty_folders": """WITH p AS (SELECT 'src/' || lpad(p_partkey::VARCHAR, 9, '0') AS source, p_brand AS d, (CASE WHEN p_partkey % 2 = 0 THEN 'IMG' ELSE 'img' END) || CASE WHEN p_size % 4 > 0 THEN 'x' ELSE '' END AS stem, CASE WHEN p_size % 3 = 0 THEN '' ELSE '.jpg' END AS ext, CASE WHEN p_partkey % 9 <> 0 THEN sha256(p_type || p_size) ELSE 'path:' || p_partkey END AS c FROM part),
      f AS (SELECT d, lower(stem || ext) AS low, c, min(source) AS first FROM p GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY d, low ORDER BY first, c) - 1 AS n FROM f)
      SELECT source, p.d || '/' || stem || CASE WHEN n = 0 THEN '' ELSE '_' || n END || ext AS dest FROM p JOIN n ON n.d = p.d AND n.low = lower(stem || ext) AND n.c = p.c""",
    "snk_space_guard": "WITH r AS (SELECT o_orderkey, sum(floor(o_totalprice)::BIGINT) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders) SELECT o_orderkey, running, running + 67108864 <= 300000000 AS fits FROM r",
}
