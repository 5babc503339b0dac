"""Embedding classifier: prototypes, pooled similarities, margins, gates and merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.functions.vectors import dot, normalised
from shelfmark.operators.ranking import SMALL_ROWS, medians, small
from shelfmark.operators.rules import UNCATEGORIZED, RuleTables, pick_tag
from shelfmark.plans.presets import ClassifyOptions
from shelfmark.scratch import cut


def mean_vectors(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, mean) with the unit mean of each key's unit vectors; sums are taken per element, map-side first."""
    parts = rows.select(key, F.posexplode(normalised(F.col(vec))).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))
    return whole.select(key, normalised(F.col("mean")).alias("mean"))


def fused_prototypes(rows: DataFrame, key: str, row_id: str, vec: str, weight: float) -> DataFrame:
    """(key, vec): the mean direction pulled towards the row nearest to it (ties by least id)."""
    means = mean_vectors(rows, key, vec)
    near = rows.join(small(means), key).withColumn("u", normalised(F.col(vec))).withColumn("s", F.round(dot(F.col("u"), F.col("mean")), 9))
    best = near.groupBy(key).agg(F.max_by("u", F.struct("s", -F.col(row_id))).alias("best"), F.first("mean").alias("mean"))
    return best.select(key, normalised(F.zip_with("mean", "best", lambda m, b: (1 - weight) * m + weight * b)).alias("vec"))


def keep_inliers(rows: DataFrame, key: str, row_id: str, vec: str, sigma: float = 2.0) -> DataFrame:
    """Rows whose similarity to their key's mean is not far below the median (median absolute deviations).

    Keys of three rows or fewer keep all, and so do keys that would lose all. Medians are
    exact, and no key is gathered in one place.
    """
    near = rows.join(small(mean_vectors(rows, key, vec)), key)
    sims = cut(near.select(key, row_id, F.round(dot(normalised(F.col(vec)), F.col("mean")), 9).alias("s")), "sims")
    off = cut(sims.join(small(medians(sims, key, "s", row_id)), key).withColumn("away", F.abs(F.col("s") - F.col("mid"))), "off")
    mad = small(medians(off, key, "away", row_id).select(key, F.col("mid").alias("mad")))
    judged = off.join(mad, key).withColumn("mad", F.when(F.col("mad") == 0, 1e-3).otherwise(F.col("mad")))
    judged = judged.withColumn("good", (F.col("n") <= 3) | (F.round(F.col("s") - F.col("mid") + F.lit(sigma * 1.4826) * F.col("mad"), 9) >= 0))
    some = judged.groupBy(key).agg(F.max("good").alias("some"))
    return judged.join(small(some), key).where("good or not some").select(key, row_id, "s")


def similarities(items: DataFrame, prototypes: DataFrame, item_id: str, vec: str, tag: str, proto: str, pooled: bool = False) -> DataFrame:
    """(item, tag, sim): the best cosine over a tag's prototypes; ``pooled`` also over the rows of an item.

    Prototypes are one row a prompt. As long as they are few (SMALL_ROWS) they go to the
    items as one matrix, and a batch of items is one matrix product, with no shuffle unless
    rows are pooled; beyond that items meet them in a join. Null vectors have no rows.
    """
    vectors = items.select(item_id, normalised(F.col(vec)).alias("_v"))
    protos = cut(prototypes.select(F.col(tag).alias("tag"), F.col(proto).alias("p")).where("p is not null"), "prototypes")
    if protos.count() > SMALL_ROWS:
        pairs = vectors.crossJoin(protos)
        return pairs.groupBy(item_id, F.col("tag").alias(tag)).agg(F.max(dot(F.col("_v"), F.col("p"))).alias("sim"))
    known = sorted(((r["tag"], r["p"]) for r in protos.collect()), key=lambda x: str(x[0]))
    tags = list(dict.fromkeys(t for t, _ in known))
    first = [next(i for i, (t, _) in enumerate(known) if t == tag) for tag in tags]
    matrix = np.array([p for _, p in known], np.float64).T
    tag_type, id_type = protos.schema["tag"].dataType, items.schema[item_id].dataType
    schema = T.StructType([T.StructField(item_id, id_type), T.StructField(tag, tag_type), T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(batch.column(1).is_valid())
            for at in range(0, held.num_rows, 1024):
                part = held.slice(at, 1024)
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                sims = np.maximum.reduceat(rows @ matrix, first, axis=1)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(tags))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(tags * part.num_rows, to_arrow_type(tag_type)), pa.array(sims.ravel())], names=[item_id, tag, "sim"])

    if not known:
        return items.sparkSession.createDataFrame([], schema)
    out = vectors.mapInArrow(run, schema)
    return out.groupBy(item_id, tag).agg(F.max("sim").alias("sim")) if pooled else out


def boosted(text_sims: DataFrame, exemplar_sims: DataFrame, item_id: str, tag: str, o: ClassifyOptions) -> DataFrame:
    """Adds to each text similarity what its best exemplar earns above the minimum, capped; never above 1."""
    best = exemplar_sims.groupBy(item_id, tag).agg(F.max("sim").alias("best"))
    delta = F.least(F.lit(o.exemplar_cap), F.greatest(F.lit(0.0), F.col("best") - o.exemplar_min) * (o.exemplar_boost - 1))
    out = text_sims.join(best, [item_id, tag], "left").withColumn("delta", F.coalesce(delta, F.lit(0.0)))
    return out.select(item_id, tag, F.col("sim").alias("text_sim"), "delta", F.least(F.lit(1.0), F.col("sim") + F.col("delta")).alias("sim"))


def ranked(sims: DataFrame, item_id: str, tag: str, score: str = "sim") -> DataFrame:
    """Adds ``rank`` by score (to nine places), ties by tag."""
    return sims.withColumn("rank", F.row_number().over(Window.partitionBy(item_id).orderBy(F.round(score, 9).desc(), tag)))


def top_k_softmax(sims: DataFrame, item_id: str, tag: str, o: ClassifyOptions) -> DataFrame:
    """Adds ``rank`` and ``prob``: softmax over the k best tags of an item, 0 for the others."""
    r = ranked(sims, item_id, tag)
    w = Window.partitionBy(item_id)
    inside = F.col("rank") <= o.top_k
    e = F.when(inside, F.exp((F.col("sim") - F.max("sim").over(w)) / o.temperature)).otherwise(0.0)
    return r.withColumn("_e", e).withColumn("prob", F.col("_e") / F.greatest(F.sum("_e").over(w), F.lit(1e-9))).drop("_e")


def margins(probs: DataFrame, item_id: str, tag: str) -> DataFrame:
    """One row an item: top_tag, top, raw_margin (second counts 0 where alone), prob, prob_margin (all of it where alone)."""
    at = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    return probs.where("rank <= 2").groupBy(item_id).agg(
        at(tag, 1).alias("top_tag"),
        at("sim", 1).alias("top"),
        (at("sim", 1) - F.coalesce(at("sim", 2), F.lit(0.0))).alias("raw_margin"),
        at("prob", 1).alias("prob"),
        (at("prob", 1) - F.coalesce(at("prob", 2), F.lit(0.0))).alias("prob_margin"),
    )


def needs_review(prob: Column, margin: Column, o: ClassifyOptions) -> Column:
    return (prob < o.threshold) | (margin < o.min_margin)


def results(probs: DataFrame, item_id: str, tag: str, o: ClassifyOptions, allowed: tuple[str, ...], rules: RuleTables = RuleTables(), apply_rules: bool = True, failed: DataFrame | None = None) -> DataFrame:
    """One row an item: category, candidates, confidence, needs_review, reason. ``probs`` has sim, text_sim, delta, rank, prob.

    The category is what the rules pick from the probabilities of the ``allowed`` tags;
    the confidence is the greatest probability, whoever has it. Items in ``failed`` have
    no embedding and so no category.
    """
    scores = F.map_from_entries(F.collect_list(F.struct(F.col(tag).cast("string"), "prob")))
    facts = F.map_from_entries(F.collect_list(F.struct(F.col(tag).cast("string"), F.struct("text_sim", "delta"))))
    held = probs.groupBy(item_id).agg(scores.alias("scores"), facts.alias("facts"))
    picked = held.withColumn("p", pick_tag(F.col("scores"), allowed, rules, apply_rules))
    x = margins(probs, item_id, tag).join(picked.select(item_id, "p", F.try_element_at("facts", F.col("p.tag")).alias("f")), item_id)
    x = x.join(failed.select(item_id, F.lit(True).alias("no_vector")).distinct(), item_id, "left") if failed is not None else x.withColumn("no_vector", F.lit(None).cast("boolean"))
    r = lambda c: F.round(c, 9)
    none = F.coalesce("no_vector", F.lit(False))
    low = r(F.col("top")) < o.min_raw
    lost = F.col("p.tag") == UNCATEGORIZED
    decisive = (r(F.col("raw_margin")) >= 0.06) & (r(F.col("prob_margin")) >= o.min_margin)
    exemplar_led = F.coalesce((r(F.col("f.delta")) >= 0.045) & (r(F.col("f.text_sim")) < 0.24), F.lit(False)) & ~decisive
    weak = (r(F.col("prob")) < 0.16) & (r(F.col("prob_margin")) < o.min_margin)
    review = needs_review(r(F.col("prob")), r(F.col("prob_margin")), o) | (r(F.col("raw_margin")) < o.min_raw_margin) | weak | lost | exemplar_led
    return x.select(
        item_id,
        F.when(none | low, F.lit(UNCATEGORIZED)).otherwise(F.col("p.tag")).alias("category"),
        F.when(none | low, F.array().cast("array<string>")).otherwise(F.col("p.candidates")).alias("candidates"),
        F.when(none, 0.0).when(low, F.greatest(F.lit(0.0), F.col("top"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prob")))).alias("confidence"),
        (none | low | review).alias("needs_review"),
        F.when(none, "clip_embed_failed").when(low, F.format_string("clip_low_sim raw=%.2f", "top")).otherwise(F.format_string("clip raw=%.2f margin=%.2f", "top", "raw_margin")).alias("reason"),
    )


def heuristic_result(found: Column, o: ClassifyOptions) -> Column:
    """Struct of category, candidates, confidence, reason, needs_review of a filename rule's (tag, confidence, reason); null without one.

    Only a rule that is as sure as .92 and passes the usual gate goes without review; its
    margin counts as 1 from .85 on, and as none below.
    """
    sure = found["confidence"]
    review = (sure < 0.92) | needs_review(sure, F.when(sure >= 0.85, 1.0).otherwise(0.0), o)
    out = F.struct(found["tag"].alias("category"), F.array(found["tag"]).alias("candidates"), sure.alias("confidence"), F.concat(F.lit("heuristic:"), found["reason"]).alias("reason"), review.alias("needs_review"))
    return F.when(found.isNotNull(), out)


def clamped(rows: DataFrame, allowed: DataFrame, category: str = "category", review: str = "needs_review") -> DataFrame:
    """A category that isn't among ``allowed`` (tag) becomes uncategorized and goes to review."""
    known = small(allowed.select(F.col("tag").alias("_tag")).distinct())
    met = rows.join(known, F.col(category) == F.col("_tag"), "left")
    outside = F.col("_tag").isNull()
    return met.withColumn(review, F.col(review) | outside).withColumn(category, F.when(outside, UNCATEGORIZED).otherwise(F.col(category))).drop("_tag")


def tag_scores(sims: DataFrame, item_id: str, tag: str, temperature: float) -> DataFrame:
    """(item, tag, score): softmax over all tags of an item."""
    w = Window.partitionBy(item_id)
    e = F.exp((F.col("sim") - F.max("sim").over(w)) / max(1e-4, temperature))
    return sims.select(item_id, tag, e.alias("_e")).withColumn("score", F.col("_e") / F.greatest(F.sum("_e").over(w), F.lit(1e-9))).drop("_e")


def confusions(judged: DataFrame, tag: str, category: str) -> DataFrame:
    """(tag, category, n) of wrong results, counted."""
    return judged.where(~F.col(category).eqNullSafe(F.col(tag))).groupBy(tag, category).agg(F.count("*").alias("n"))


def fused_crops(crops: DataFrame, item_id: str, crop_id: str, vec: str, score: str) -> DataFrame:
    """(item, vec): unit mean of an item's two best-scored crops (ties by crop)."""
    best = crops.withColumn("_r", F.row_number().over(Window.partitionBy(item_id).orderBy(F.round(score, 9).desc(), crop_id))).where("_r <= 2")
    return mean_vectors(best, item_id, vec).withColumnRenamed("mean", "vec")


def fallback_needed(category: Column, reason: Column, confidence: Column, threshold: float) -> Column:
    return (category == UNCATEGORIZED) | F.contains(reason, F.lit("clip_low_sim")) | (confidence < 0.9 * threshold)


def merged_choice(clip_category: Column, clip_conf: Column, clip_review: Column, clip_reason: Column, vlm_category: Column, vlm_conf: Column, threshold: float) -> Column:
    """'clip' or 'vlm': which of two results to take; a null vlm result leaves clip."""
    vlm_known = F.coalesce(vlm_category != UNCATEGORIZED, F.lit(False))
    vlm = lambda rule: F.when(rule, "vlm").otherwise("clip")
    return (
        F.when(clip_category == UNCATEGORIZED, vlm(vlm_known))
        .when(~vlm_known, "clip")
        .when((clip_conf >= threshold) & ~clip_review, "clip")
        .when(clip_conf >= threshold, vlm((vlm_conf >= 0.82) & (vlm_conf > clip_conf + 0.14)))
        .when(F.contains(clip_reason, F.lit("clip_low_sim")), vlm(vlm_conf >= 0.65))
        .otherwise(vlm((vlm_conf >= 0.80) & (vlm_conf > clip_conf + 0.15)))
    )


def accuracy(judged: DataFrame, tag: str, hit: str, sure: str, review: str) -> DataFrame:
    """Hits by tag and over all (a null tag): n, hits, sure_hits, reviews."""
    return judged.rollup(tag).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("hits"), F.sum((F.col(hit) & F.col(sure)).cast("long")).alias("sure_hits"), F.sum(F.col(review).cast("long")).alias("reviews"))
