"""Classifier and rule queries: embeddings stand for images, their labels for tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.vectors import dot, failed, normalised
from shelfmark.operators import classify as C
from shelfmark.operators import metrics as M
from shelfmark.operators import rules as R
from shelfmark.plans.presets import ClassifyOptions
from shelfmark.sources.tables import table

O = ClassifyOptions(top_k=3, min_raw=0.12, threshold=0.55, min_margin=0.12, min_raw_margin=0.005, exemplar_min=0.2, exemplar_cap=0.08)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("tag"), F.col("label").cast("string")).alias("tag"))


#: What may be picked: every tag but one, so that the best of the others comes up where that one is nearest.
NOT_ALLOWED, TAG_RULES = "tag3", R.RuleTables(specificity=(("tag2", 3),))


def _prototypes(spark, sf_dir):
    """Two prompts a tag."""
    prompts = _vectors(spark, sf_dir).withColumn("prompt", F.concat_ws("/", "tag", (F.col("vec_id") % 2).cast("string")))
    return C.mean_vectors(prompts, "prompt", "embedding").select(F.substring_index("prompt", "/", 1).alias("tag"), F.col("mean").alias("proto"))


def _text_sims(spark, sf_dir):
    return C.similarities(_vectors(spark, sf_dir), _prototypes(spark, sf_dir), "vec_id", "embedding", "tag", "proto")


def _sims(spark, sf_dir):
    """The first exemplars of each tag, as many as a folder may have, raise the similarities."""
    v = _vectors(spark, sf_dir)
    exemplars = M.capped_exemplars(v, "tag", "vec_id").select("tag", normalised(F.col("embedding")).alias("proto"))
    return C.boosted(_text_sims(spark, sf_dir), C.similarities(v, exemplars, "vec_id", "embedding", "tag", "proto"), "vec_id", "tag", O)


def _probs(spark, sf_dir):
    return C.top_k_softmax(_sims(spark, sf_dir), "vec_id", "tag", O)


def _results(spark, sf_dir):
    """Every 97th vector stands for an image that could not be encoded."""
    v = _vectors(spark, sf_dir)
    allowed = tuple(sorted(r.tag for r in v.select("tag").distinct().collect() if r.tag != NOT_ALLOWED))
    return C.results(_probs(spark, sf_dir), "vec_id", "tag", O, allowed, TAG_RULES, apply_rules=False, failed=v.where("vec_id % 97 = 0"))


def _long(frame, key, vec):
    return frame.select(key, F.posexplode(vec).alias("pos", "x")).select(key, "pos", (F.round("x", 6) + 0.0).alias("x"))


def cls_prototypes(spark, sf_dir):
    return _long(C.fused_prototypes(_vectors(spark, sf_dir), "tag", "vec_id", "embedding", O.fusion_weight), "tag", "vec")


def cls_outliers(spark, sf_dir):
    return C.keep_inliers(_vectors(spark, sf_dir), "tag", "vec_id", "embedding").select("tag", "vec_id")


def cls_sims(spark, sf_dir):
    return _text_sims(spark, sf_dir).select("vec_id", "tag", F.round("sim", 6).alias("sim"))


def cls_exemplar_boost(spark, sf_dir):
    return _sims(spark, sf_dir).select("vec_id", "tag", F.round("delta", 6).alias("delta"), F.round("sim", 6).alias("sim"))


def cls_topk_softmax(spark, sf_dir):
    return _probs(spark, sf_dir).select("vec_id", "tag", "rank", F.round("prob", 6).alias("prob"))


def cls_margins(spark, sf_dir):
    return C.margins(_probs(spark, sf_dir), "vec_id", "tag").select("vec_id", "top_tag", *(F.round(c, 6).alias(c) for c in ("top", "raw_margin", "prob", "prob_margin")))


def cls_result(spark, sf_dir):
    shown = _results(spark, sf_dir).withColumn("confidence", F.round("confidence", 6)).withColumn("candidates", F.array_join("candidates", "|"))
    return shown.withColumn("reason", F.regexp_extract("reason", r"^\S+", 0))


def cls_frame_pool(spark, sf_dir):
    """Frames of an item are five neighbouring vectors; a tag's score is its best frame."""
    frames = _vectors(spark, sf_dir).withColumn("item", F.floor(F.col("vec_id") / 5))
    return C.similarities(frames, _prototypes(spark, sf_dir), "item", "embedding", "tag", "proto", pooled=True).select("item", "tag", F.round("sim", 6).alias("sim"))


def cls_crop_fuse(spark, sf_dir):
    crops = _vectors(spark, sf_dir).withColumn("item", F.floor(F.col("vec_id") / 4)).withColumn("score", F.col("embedding")[0].cast("double"))
    return _long(C.fused_crops(crops, "item", "vec_id", "embedding", "score"), "item", "vec")


def cls_failed(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return v.select("vec_id", failed(F.col("embedding")).alias("failed"))


def cls_vlm_merge(spark, sf_dir):
    r = _results(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))
    vlm_conf = (F.col("vec_id") * 37 % 100) / 100.0
    r = r.withColumn("needs", C.fallback_needed(F.col("category"), F.col("reason"), F.col("confidence"), O.threshold))
    r = r.withColumn("vlm_category", F.when(F.col("needs"), F.when(F.col("vec_id") % 5 == 0, "uncategorized").otherwise("tag0"))).withColumn("vlm_conf", vlm_conf)
    choice = C.merged_choice(F.col("category"), F.col("confidence"), F.col("needs_review"), F.col("reason"), F.col("vlm_category"), F.col("vlm_conf"), O.threshold)
    return r.select("vec_id", "needs", choice.alias("choice"), F.when(choice == "vlm", F.col("vlm_category")).otherwise(F.col("category")).alias("final"))


def cls_accuracy(spark, sf_dir):
    r = _results(spark, sf_dir).join(_vectors(spark, sf_dir).select("vec_id", "tag"), "vec_id").withColumn("hit", F.col("category") == F.col("tag")).withColumn("sure", ~F.col("needs_review"))
    return C.accuracy(r, "tag", "hit", "sure", "needs_review")


def cls_confusions(spark, sf_dir):
    r = _results(spark, sf_dir).join(_vectors(spark, sf_dir).select("vec_id", "tag"), "vec_id")
    return C.confusions(r, "tag", "category")


def cls_tag_scores(spark, sf_dir):
    return C.tag_scores(_text_sims(spark, sf_dir), "vec_id", "tag", 0.07).select("vec_id", "tag", F.round("score", 6).alias("score"))


def cls_heuristic(spark, sf_dir):
    """Filename rules of every confidence, some of them below the gates."""
    v = _vectors(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 4 == 3, None).otherwise(F.struct(F.col("tag"), F.when(F.col("vec_id") % 4 == 0, 0.92).when(F.col("vec_id") % 4 == 1, 0.9).otherwise(0.5).alias("confidence"), F.lit("filename_x").alias("reason"))).alias("found"))
    h = C.heuristic_result(F.col("found"), O)
    return v.select("vec_id", h.alias("h")).select("vec_id", "h.category", F.array_join("h.candidates", "|").alias("candidates"), "h.confidence", "h.reason", "h.needs_review")


def cls_whitelist_clamp(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    allowed = v.select("tag").distinct().where(F.col("tag") != NOT_ALLOWED)
    return C.clamped(v.select("vec_id", F.col("tag").alias("category"), (F.col("vec_id") % 3 == 0).alias("needs_review")), allowed)


def cls_loo(spark, sf_dir):
    """Nearest tag mean of each vector, its own tag's mean taken without it: sums once, then each row subtracts itself."""
    v = _vectors(spark, sf_dir)
    parts = v.select("tag", F.posexplode("embedding").alias("pos", "x")).groupBy("tag", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    sums = parts.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("total"))
    pairs = v.crossJoin(F.broadcast(sums.withColumnRenamed("tag", "other")))
    held = F.when(F.col("tag") == F.col("other"), F.zip_with("total", "embedding", lambda t, e: t - e.cast("double"))).otherwise(F.col("total"))
    sims = pairs.select("vec_id", "tag", "other", dot(F.col("embedding"), normalised(held)).alias("sim"))
    best = sims.groupBy("vec_id", "tag").agg(F.max_by("other", F.struct(F.round("sim", 9), -F.substring("other", 4, 5).cast("int"))).alias("picked"))
    return best.groupBy("tag").agg(F.count("*").alias("n"), F.sum((F.col("tag") == F.col("picked")).cast("long")).alias("hits"))


TABLES = R.RuleTables(
    specific=(("purchase", ("click", "view")), ("view", ("signup",))), class_a=("signup", "view"), class_b=("error", "view"), personal=("signup",), generic_people=("click",),
    real=("purchase", "signup"), generated=("error",), specificity=(("purchase", 3), ("click", 2)),
)
ALLOWED = ("click", "error", "purchase", "signup", "view")


def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 6).alias("item"), "event_type", (F.col("event_id") * 31 % 97 / 97.0).alias("score"))
    return e.groupBy("item", "event_type").agg(F.max("score").alias("score"))


def rule_pick_tag(spark, sf_dir):
    m = _scores(spark, sf_dir).groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "score"))).alias("scores"))
    on, off = R.pick_tag(F.col("scores"), ALLOWED, TABLES), R.pick_tag(F.col("scores"), ALLOWED[1:], TABLES, apply_rules=False)
    return m.select("item", on.alias("on"), off.alias("off")).select("item", F.col("on.tag").alias("tag"), F.round("on.confidence", 6).alias("confidence"), F.array_join("on.candidates", "|").alias("candidates"), F.col("off.tag").alias("plain_tag"), F.array_join("off.candidates", "|").alias("plain_candidates"))


def rule_priority_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 6).alias("item"), F.col("event_type").alias("tag"), "event_id")
    priority = spark.createDataFrame([("purchase", 0), ("signup", 1), ("error", 2)], "tag string, rank int")
    return R.merge_by_priority(e, "item", "tag", "event_id", priority)


def rule_frame_vote(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 7).alias("item"), F.when(F.col("event_type") == "error", "uncategorized").otherwise(F.col("event_type")).alias("tag"), (F.col("event_id") % 10 / 10.0).alias("confidence"))
    return R.frame_vote(e, "item", "tag", "confidence")


QUERIES = {f.__name__: f for f in (cls_prototypes, cls_outliers, cls_sims, cls_exemplar_boost, cls_topk_softmax, cls_margins, cls_result, cls_frame_pool, cls_crop_fuse, cls_failed, cls_vlm_merge, cls_accuracy, cls_confusions, cls_tag_scores, cls_heuristic, cls_whitelist_clamp, cls_loo, rule_pick_tag, rule_priority_merge, rule_frame_vote)}

# --- SQL

_V = "v AS (SELECT vec_id, 'tag' || label AS tag, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u, embedding::DOUBLE[] AS e FROM embeddings)"


def _unit(x: str) -> str:
    return f"list_transform([{x}], lambda r: list_transform(r, lambda y: y / sqrt(list_inner_product(r, r))))[1]"


def _mean(source: str, key: str, name: str, vec: str = "u") -> str:
    return f"""{name}_p AS (SELECT {key}, unnest({vec}) AS x, generate_subscripts({vec}, 1) AS pos FROM {source}), {name}_a AS (SELECT {key}, pos, avg(x) AS x FROM {name}_p GROUP BY 1, 2),
  {name} AS (SELECT {key}, {_unit('list(x ORDER BY pos)')} AS mean FROM {name}_a GROUP BY 1)"""


_PROTO = f"""{_V}, prompts AS (SELECT tag || '/' || (vec_id % 2) AS prompt, u FROM v), {_mean('prompts', 'prompt', 'proto')},
  tsim AS (SELECT vec_id, split_part(prompt, '/', 1) AS tag, max(list_inner_product(u, mean)) AS sim FROM v, proto GROUP BY 1, 2)"""
_BOOST = f"""{_PROTO}, few AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY tag ORDER BY vec_id) <= 48), ex AS (SELECT o.vec_id, x.tag, max(list_inner_product(o.u, x.u)) AS best FROM v o, few x GROUP BY 1, 2),
  sims AS (SELECT vec_id, tag, sim AS text_sim, coalesce(least({O.exemplar_cap}, greatest(0.0, best - {O.exemplar_min}) * {O.exemplar_boost - 1}), 0.0) AS delta,
    least(1.0, sim + coalesce(least({O.exemplar_cap}, greatest(0.0, best - {O.exemplar_min}) * {O.exemplar_boost - 1}), 0.0)) AS sim FROM tsim LEFT JOIN ex USING (vec_id, tag))"""
_PROBS = f"""{_BOOST}, rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, tag) AS rank, max(sim) OVER (PARTITION BY vec_id) AS mx FROM sims),
  ex2 AS (SELECT *, CASE WHEN rank <= {O.top_k} THEN exp((sim - mx) / {O.temperature}) ELSE 0.0 END AS e2 FROM rk), probs AS (SELECT *, e2 / greatest(sum(e2) OVER (PARTITION BY vec_id), 1e-9) AS prob FROM ex2)"""
_MARG = f"""{_PROBS}, m AS (SELECT vec_id, max(tag) FILTER (WHERE rank = 1) AS top_tag, max(sim) FILTER (WHERE rank = 1) AS top, max(sim) FILTER (WHERE rank = 1) - coalesce(max(sim) FILTER (WHERE rank = 2), 0.0) AS raw_margin,
    max(prob) FILTER (WHERE rank = 1) AS prob, max(prob) FILTER (WHERE rank = 1) - coalesce(max(prob) FILTER (WHERE rank = 2), 0.0) AS prob_margin, max(text_sim) FILTER (WHERE rank = 1) AS text_sim, max(delta) FILTER (WHERE rank = 1) AS delta FROM probs GROUP BY vec_id)"""
_RES = f"""{_MARG}, pk AS (SELECT vec_id, list(tag ORDER BY round(prob, 9) DESC, CASE tag WHEN 'tag2' THEN 3 ELSE 1 END DESC, tag)[1:5] AS cand FROM probs WHERE tag <> '{NOT_ALLOWED}' GROUP BY vec_id),
  j AS (SELECT m.vec_id, m.top, m.raw_margin, m.prob, m.prob_margin, cand, m.vec_id % 97 = 0 AS failed, round(m.top, 9) < {O.min_raw} AS low,
    round(p.delta, 9) >= 0.045 AND round(p.text_sim, 9) < 0.24 AND NOT (round(m.raw_margin, 9) >= 0.06 AND round(m.prob_margin, 9) >= {O.min_margin}) AS led
    FROM m JOIN pk USING (vec_id) JOIN probs p ON p.vec_id = m.vec_id AND p.tag = cand[1]),
  res AS (SELECT vec_id, CASE WHEN failed OR low THEN 'uncategorized' ELSE cand[1] END AS category, CASE WHEN failed OR low THEN '' ELSE array_to_string(cand, '|') END AS candidates,
    round(CASE WHEN failed THEN 0.0 WHEN low THEN greatest(0.0, top) ELSE prob END, 6) AS confidence,
    failed OR low OR round(prob, 9) < {O.threshold} OR round(prob_margin, 9) < {O.min_margin} OR round(raw_margin, 9) < {O.min_raw_margin} OR led AS needs_review,
    CASE WHEN failed THEN 'clip_embed_failed' WHEN low THEN 'clip_low_sim' ELSE 'clip' END AS reason FROM j)"""
_SCORES = "sc AS (SELECT floor(event_id / 6.0)::BIGINT AS item, event_type AS tag, max(event_id * 31 % 97 / 97.0::DOUBLE) AS s FROM events GROUP BY 1, 2)"
_STEP = "{n} AS (SELECT item, tag, CASE WHEN tag = '{g}' AND best >= 0.35 * gen AND best >= 0.25 * top THEN least(s, 0.45 * best) ELSE s END AS s FROM (SELECT *, max(s) FILTER (WHERE tag IN ({sp})) OVER w AS best, max(s) FILTER (WHERE tag = '{g}') OVER w AS gen, max(s) OVER w AS top FROM {p} WINDOW w AS (PARTITION BY item)))"

SQL = {
    "cls_prototypes": f"""WITH {_V}, {_mean('v', 'tag', 'mm')}, near AS (SELECT tag, u, mean, row_number() OVER (PARTITION BY tag ORDER BY round(list_inner_product(u, mean), 9) DESC, vec_id) AS r FROM v JOIN mm USING (tag)),
      f AS (SELECT tag, {_unit(f'[{1 - O.fusion_weight}::DOUBLE * mean[i] + {O.fusion_weight}::DOUBLE * u[i] for i in range(1, len(u) + 1)]')} AS vec FROM near WHERE r = 1)
      SELECT tag, unnest([round(x, 6) + 0.0 for x in vec]) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM f""",
    "cls_outliers": f"""WITH {_V}, {_mean('v', 'tag', 'mm')}, s AS (SELECT tag, vec_id, round(list_inner_product(u, mean), 9) AS s FROM v JOIN mm USING (tag)), d AS (SELECT *, median(s) OVER (PARTITION BY tag) AS mid, count(*) OVER (PARTITION BY tag) AS n FROM s),
      a AS (SELECT *, median(abs(s - mid)) OVER (PARTITION BY tag) AS mad FROM d), g AS (SELECT *, n <= 3 OR round(s - mid + 2.9652 * CASE WHEN mad = 0 THEN 0.001 ELSE mad END, 9) >= 0 AS good FROM a)
      SELECT tag, vec_id FROM g QUALIFY good OR NOT bool_or(good) OVER (PARTITION BY tag)""",
    "cls_sims": f"WITH {_PROTO} SELECT vec_id, tag, round(sim, 6) AS sim FROM tsim",
    "cls_exemplar_boost": f"WITH {_BOOST} SELECT vec_id, tag, round(delta, 6) AS delta, round(sim, 6) AS sim FROM sims",
    "cls_topk_softmax": f"WITH {_PROBS} SELECT vec_id, tag, rank, round(prob, 6) AS prob FROM probs",
    "cls_margins": f"WITH {_MARG} SELECT vec_id, top_tag, round(top, 6) AS top, round(raw_margin, 6) AS raw_margin, round(prob, 6) AS prob, round(prob_margin, 6) AS prob_margin FROM m",
    "cls_result": f"WITH {_RES} SELECT * FROM res",
    "cls_frame_pool": f"WITH {_PROTO} SELECT floor(vec_id / 5.0)::BIGINT AS item, split_part(prompt, '/', 1) AS tag, round(max(list_inner_product(u, mean)), 6) AS sim FROM v, proto GROUP BY 1, 2",
    "cls_crop_fuse": f"""WITH {_V}, b AS (SELECT floor(vec_id / 4.0)::BIGINT AS item, u FROM v QUALIFY row_number() OVER (PARTITION BY floor(vec_id / 4.0) ORDER BY round(e[1], 9) DESC, vec_id) <= 2), {_mean('b', 'item', 'mm')}
      SELECT item, unnest([round(x, 6) + 0.0 for x in mean]) AS x, generate_subscripts(mean, 1) - 1 AS pos FROM mm""",
    "cls_failed": "SELECT vec_id, vec_id % 9 = 0 AS failed FROM embeddings",
    "cls_vlm_merge": f"""WITH {_RES}, n AS (SELECT *, category = 'uncategorized' OR reason = 'clip_low_sim' OR confidence < {0.9 * O.threshold} AS needs, (vec_id * 37 % 100) / 100.0::DOUBLE AS vc FROM res),
      k AS (SELECT *, CASE WHEN needs THEN CASE WHEN vec_id % 5 = 0 THEN 'uncategorized' ELSE 'tag0' END END AS vlm FROM n),
      c AS (SELECT *, CASE WHEN category = 'uncategorized' THEN CASE WHEN vlm <> 'uncategorized' THEN 'vlm' ELSE 'clip' END WHEN coalesce(vlm, 'uncategorized') = 'uncategorized' THEN 'clip' WHEN confidence >= {O.threshold} AND NOT needs_review THEN 'clip'
        WHEN confidence >= {O.threshold} THEN CASE WHEN vc >= 0.82 AND vc > confidence + 0.14 THEN 'vlm' ELSE 'clip' END WHEN reason = 'clip_low_sim' THEN CASE WHEN vc >= 0.65 THEN 'vlm' ELSE 'clip' END WHEN vc >= 0.8 AND vc > confidence + 0.15 THEN 'vlm' ELSE 'clip' END AS choice FROM k)
      SELECT vec_id, needs, choice, CASE WHEN choice = 'vlm' THEN vlm ELSE category END AS final FROM c""",
    "cls_accuracy": f"WITH {_RES} SELECT tag, count(*) AS n, sum((category = tag)::BIGINT)::BIGINT AS hits, sum((category = tag AND NOT needs_review)::BIGINT)::BIGINT AS sure_hits, sum(needs_review::BIGINT)::BIGINT AS reviews FROM res JOIN v USING (vec_id) GROUP BY ROLLUP (tag)",
    "cls_confusions": f"WITH {_RES} SELECT tag, category, count(*) AS n FROM res JOIN v USING (vec_id) WHERE tag <> category GROUP BY 1, 2",
    "cls_tag_scores": f"WITH {_PROTO}, e AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY vec_id)) / 0.07) AS e FROM tsim) SELECT vec_id, tag, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS score FROM e",
    "cls_heuristic": f"""SELECT vec_id, CASE WHEN k < 3 THEN 'tag' || label END AS category, CASE WHEN k < 3 THEN 'tag' || label END AS candidates, CASE k WHEN 0 THEN 0.92 WHEN 1 THEN 0.9 WHEN 2 THEN 0.5 END::DOUBLE AS confidence,
      CASE WHEN k < 3 THEN 'heuristic:filename_x' END AS reason, CASE WHEN k = 0 THEN false WHEN k < 3 THEN true END AS needs_review FROM (SELECT *, vec_id % 4 AS k FROM embeddings)""",
    "cls_whitelist_clamp": f"SELECT vec_id, CASE WHEN label = 3 THEN 'uncategorized' ELSE 'tag' || label END AS category, vec_id % 3 = 0 OR label = 3 AS needs_review FROM embeddings",
    "cls_loo": f"""WITH {_V}, p AS (SELECT tag, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v), a AS (SELECT tag, pos, sum(x) AS x FROM p GROUP BY 1, 2), t AS (SELECT tag, list(x ORDER BY pos) AS total FROM a GROUP BY 1),
      h AS (SELECT v.vec_id, v.tag, t.tag AS other, v.e, CASE WHEN v.tag = t.tag THEN [total[i] - v.e[i] for i in range(1, len(total) + 1)] ELSE total END AS held FROM v, t),
      s AS (SELECT vec_id, tag, other, list_inner_product(e, {_unit('held')}) AS sim FROM h), b AS (SELECT tag, other FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, substr(other, 4)::INT) = 1)
      SELECT tag, count(*) AS n, sum((tag = other)::BIGINT)::BIGINT AS hits FROM b GROUP BY tag""",
    "rule_pick_tag": f"""WITH {_SCORES}, {_STEP.format(n='s1', g='purchase', sp="'click', 'view'", p='sc')}, {_STEP.format(n='s2', g='view', sp="'signup'", p='s1')},
      s3 AS (SELECT item, tag, CASE WHEN a >= 0.08 AND a >= 0.7 * b AND tag = 'error' THEN s * 0.5 ELSE s END AS s FROM (SELECT *, coalesce(max(s) FILTER (WHERE tag IN ('signup', 'view')) OVER w, 0) AS a, coalesce(max(s) FILTER (WHERE tag IN ('error', 'view')) OVER w, 0) AS b FROM s2 WINDOW w AS (PARTITION BY item))),
      s4 AS (SELECT item, tag, CASE WHEN p >= 0.2 AND tag = 'click' THEN s * 0.45 ELSE s END AS s FROM (SELECT *, coalesce(max(s) FILTER (WHERE tag = 'signup') OVER (PARTITION BY item), 0) AS p FROM s3)),
      s5 AS (SELECT item, tag, CASE WHEN rw AND tag = 'error' THEN s * 0.55 WHEN mw AND NOT rw AND tag = 'purchase' THEN s * 0.55 ELSE s END AS s FROM (SELECT *, r >= 0.12 AND r >= 1.05 * g AS rw, g >= 0.12 AND g >= 1.05 * r AS mw FROM
        (SELECT *, coalesce(max(s) FILTER (WHERE tag IN ('purchase', 'signup')) OVER w, 0) AS r, coalesce(max(s) FILTER (WHERE tag = 'error') OVER w, 0) AS g FROM s4 WINDOW w AS (PARTITION BY item)))),
      r1 AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(s, 9) DESC, CASE tag WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END DESC, tag) AS r FROM s5),
      r2 AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(s, 9) DESC, CASE tag WHEN 'purchase' THEN 3 ELSE 1 END DESC, tag) AS r FROM sc WHERE tag <> 'click'),
      o AS (SELECT item, string_agg(tag, '|' ORDER BY r) AS candidates, max(tag) FILTER (WHERE r = 1) AS tag, round(max(s) FILTER (WHERE r = 1), 6) AS confidence FROM r1 WHERE r <= 5 GROUP BY item),
      f AS (SELECT item, string_agg(tag, '|' ORDER BY r) AS plain_candidates, max(tag) FILTER (WHERE r = 1) AS plain_tag FROM r2 WHERE r <= 5 GROUP BY item)
      SELECT o.item, tag, confidence, candidates, coalesce(plain_tag, 'uncategorized') AS plain_tag, coalesce(plain_candidates, '') AS plain_candidates FROM o LEFT JOIN f USING (item)""",
    "rule_priority_merge": "SELECT floor(event_id / 6.0)::BIGINT AS item, arg_min(event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 3 END::BIGINT * 1000000000 + event_id) AS tag FROM events GROUP BY 1",
    "rule_frame_vote": """WITH f AS (SELECT floor(event_id / 7.0)::BIGINT AS item, event_type AS tag, count(*) AS votes, max(event_id % 10 / 10.0::DOUBLE) AS confidence FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
      SELECT item, tag, votes, confidence FROM f QUALIFY row_number() OVER (PARTITION BY item ORDER BY votes DESC, confidence DESC, length(tag), tag) = 1""",
}
