"""Duplicate groups: exact edges, assembly, what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.components import connected_components
from shelfmark.operators.similarity import perceptual_edges
from shelfmark.plans.presets import DuplicateOptions
from shelfmark.scratch import cut

#: Keep policies: sort keys, all descending.
POLICIES = {"largest_pixels": ("px", "size", "mtime"), "newest_mtime": ("mtime", "px", "size"), "largest_file": ("size", "px", "mtime")}


def size_candidates(files: DataFrame) -> DataFrame:
    """Files whose size occurs at least twice: equal content needs equal size, so the others need no digest."""
    sizes = cut(files.groupBy("size").agg(F.count("*").alias("_n")).where("_n > 1").select("size"), "sizes")
    return files.join(sizes, "size", "left_semi")


def exact_edges(records: DataFrame) -> DataFrame:
    """(src, dst): a star from the first record of each content digest; linear, not all pairs.

    The heads are a table of their own, so that a digest with very many copies can be
    split in the join.
    """
    heads = cut(records.where("sha256 is not null").groupBy("sha256").agg(F.min("id").alias("src"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    return records.join(heads, "sha256").where("id <> src").select("src", F.col("id").alias("dst"))


def first_by_path(records: DataFrame) -> DataFrame:
    """One record for each normalised path: the one with the least id."""
    ranked = records.withColumn("_r", F.row_number().over(Window.partitionBy("path_norm").orderBy("id")))
    return ranked.where("_r = 1").drop("_r")


def keep_order(policy: str) -> list[Column]:
    px = F.coalesce(F.col("width"), F.lit(0)) * F.coalesce(F.col("height"), F.lit(0))
    value = {"px": px, "size": F.coalesce(F.col("size"), F.lit(0)), "mtime": F.coalesce(F.col("mtime"), F.lit(0))}
    return [value[k].desc() for k in POLICIES[policy]] + [F.lower("path").asc(), F.col("path").asc()]


def members(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Records that have an edge, with ``component``."""
    return records.join(connected_components(edges), "id")


def assemble(grouped: DataFrame, policy: str = "largest_pixels", include_exact: bool = True) -> DataFrame:
    """One row for each group of two or more paths, largest first.

    group_id is a hash of the member paths in order and so survives restarts. is_exact:
    one distinct digest among those known (missing digests don't count against it).
    """
    best = Window.partitionBy("component").orderBy(*keep_order(policy))
    ranked = grouped.withColumn("_keep", F.row_number().over(best) == 1)
    ordered = F.transform(F.array_sort(F.collect_set(F.struct(F.lower("path").alias("low"), F.col("path").alias("path")))), lambda x: x["path"])
    groups = ranked.groupBy("component").agg(ordered.alias("paths"), F.max(F.when(F.col("_keep"), F.col("path"))).alias("suggested_keep"), F.count_distinct("sha256").alias("_digests"))
    groups = groups.where(F.size("paths") >= 2).select(
        F.sha2(F.array_join("paths", "|"), 256).alias("group_id"), "component", "paths", F.size("paths").cast("long").alias("n"), "suggested_keep", (F.lit(include_exact) & (F.col("_digests") == 1)).alias("is_exact")
    )
    return groups.orderBy(F.col("n").desc(), F.lower(F.element_at("paths", 1)), "component")


def duplicate_groups(records: DataFrame, o: DuplicateOptions, verified: DataFrame | None = None, bits: int = 60) -> DataFrame:
    """Groups over the union of exact, perceptual and verified edges, under the options."""
    unique = cut(first_by_path(records), "records")  # signatures are computed once
    edges = []
    if o.exact:
        edges.append(exact_edges(unique))
    if o.perceptual:
        edges.append(perceptual_edges(unique, o, bits))
    if verified is not None:
        edges.append(verified_edges(unique, verified))
    if not edges:
        return assemble(unique.limit(0).withColumn("component", F.col("id")), o.keep, o.exact)
    union = edges[0]
    for more in edges[1:]:
        union = union.unionByName(more)
    return assemble(members(unique, union), o.keep, o.exact)


def verified_edges(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """(src, dst) of pairs of known paths decided to be duplicates; ``decisions`` has path_a, path_b, same."""
    ids = records.select("path", "id")
    yes = decisions.where("same")
    return yes.join(ids.select(F.col("path").alias("path_a"), F.col("id").alias("src")), "path_a").join(ids.select(F.col("path").alias("path_b"), F.col("id").alias("dst")), "path_b").select("src", "dst")


def merge_decisions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Decisions by unordered pair of paths; a fresh one replaces a stored one."""
    both = stored.withColumn("_age", F.lit(1)).unionByName(fresh.withColumn("_age", F.lit(0)))
    pair = both.select(F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b"), "same", "_age")
    return pair.groupBy("path_a", "path_b").agg(F.min_by("same", F.struct("_age", "same")).alias("same"))


def block_statistics(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(pairs, largest): comparisons needed within blocks of more than one record, and the largest block."""
    sizes = blocks.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) / 2)), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest"))
