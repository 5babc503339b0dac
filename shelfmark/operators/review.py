"""Review of duplicate groups: flags, filters, orders and the deletion plan. Nothing is ever deleted here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDERS = {"size_desc": ["-n"], "size_asc": ["n"], "name": ["name"], "type": ["exact", "-n"]}


def keep_flags(members: DataFrame) -> DataFrame:
    """(group_id, path, suggested_keep) with ``keep``: the suggested member, or the first by path where none is a member."""
    w = Window.partitionBy("group_id")
    chosen = F.col("path") == F.col("suggested_keep")
    first = F.row_number().over(w.orderBy(F.lower("path"), "path")) == 1
    return members.withColumn("keep", F.when(F.max(F.coalesce(chosen, F.lit(False))).over(w), F.coalesce(chosen, F.lit(False))).otherwise(first))


def filtered(groups: DataFrame, least: int = 2, kind: str = "all", skipped: str = "all", order: str = "size_desc") -> DataFrame:
    """Groups of at least ``least`` (2 or more) of a kind (all, exact, similar) and state (all, skipped, active), in order; ties by ordinal."""
    out = groups.where(F.col("n") >= max(2, least))
    if kind != "all":
        out = out.where(F.col("is_exact") == (kind == "exact"))
    if skipped != "all":
        out = out.where(F.col("skipped") == (skipped == "skipped"))
    keys = {"-n": F.desc("n"), "n": F.asc("n"), "name": F.lower("first_path").asc(), "exact": F.desc("is_exact")}
    return out.orderBy(*(keys[k] for k in ORDERS[order]), "ordinal")


def skip_small(groups: DataFrame, least: int) -> DataFrame:
    return groups.withColumn("skipped", F.col("skipped") | (F.col("n") < least))


def deletion_plan(members: DataFrame) -> DataFrame:
    """(path, group_id): members of approved groups that aren't skipped nor kept; a path once, under its least group.

    members: group_id, path, keep, approved, skipped, delete_entire. A path that some
    group keeps is never planned for deletion.
    """
    active = members.where("approved and not skipped")
    kept = active.where("keep and not delete_entire").select("path").distinct()
    doomed = active.where("delete_entire or not keep").groupBy("path").agg(F.min("group_id").alias("group_id"))
    return doomed.join(kept, "path", "left_anti")


def scope(members: DataFrame, plan: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: files to delete, groups they are in, all groups, groups shown."""
    files = plan.agg(F.count("*").alias("files"), F.count_distinct("group_id").alias("groups_deleting"))
    return files.crossJoin(members.agg(F.count_distinct("group_id").alias("groups"))).crossJoin(shown.agg(F.count("*").alias("shown")))


def page(rows: DataFrame, group: str, order: list, number: int, size: int = 200) -> DataFrame:
    """Rows of one page (from 0) of each group."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_r", r).where((F.col("_r") > number * size) & (F.col("_r") <= (number + 1) * size)).drop("_r")


def apply_suggestions(members: DataFrame) -> DataFrame:
    """In approved groups that aren't skipped, the suggested member is kept and no other (none without a suggestion)."""
    chosen = F.coalesce((F.col("suggested_keep") != "") & (F.col("path") == F.col("suggested_keep")), F.lit(False))
    return members.withColumn("keep", F.when(F.col("approved") & ~F.col("skipped"), chosen).otherwise(F.col("keep")))


def approve_all(groups: DataFrame) -> DataFrame:
    return groups.withColumn("approved", F.lit(True))


def unskip_all(groups: DataFrame) -> DataFrame:
    return groups.withColumn("skipped", F.lit(False))


#: What a session's payload keeps of a group's review; ``keep_path`` and ``reviewed`` are older names.
SAVED = "struct<skip:boolean,keep_paths:array<string>,keep_path:string,approved:boolean,reviewed:boolean,delete_entire:boolean>"


def persisted(members: DataFrame) -> DataFrame:
    """(group_id, state): the review of each group as JSON, its kept paths in order."""
    kept = F.array_sort(F.collect_list(F.when(F.col("keep"), F.col("path"))))
    facts = members.groupBy("group_id").agg(F.max("skipped").alias("skip"), kept.alias("keep_paths"), F.max("approved").alias("approved"), F.max("delete_entire").alias("delete_entire"))
    return facts.select("group_id", F.to_json(F.struct("skip", "keep_paths", "approved", "delete_entire")).alias("state"))


def restored(members: DataFrame, saved: DataFrame) -> DataFrame:
    """Members with the saved review of their group (group_id, state); groups without a readable one keep theirs.

    Kept are the saved paths; the first by path where none of them is a member any more.
    """
    states = saved.select("group_id", F.when(F.startswith(F.trim("state"), F.lit("{")), F.from_json("state", SAVED)).alias("_s")).where("_s is not null")
    met = members.join(states, "group_id", "left")
    listed = F.when(F.size("_s.keep_paths") > 0, F.array_contains("_s.keep_paths", F.col("path"))).otherwise(F.coalesce(F.col("_s.keep_path") == F.col("path"), F.lit(False)))
    w = Window.partitionBy("group_id")
    known = F.col("_s").isNotNull()
    flagged = met.withColumn("_keep", listed).withColumn("_some", F.max("_keep").over(w)).withColumn("_first", F.row_number().over(w.orderBy(F.lower("path"), "path")) == 1)
    flag = lambda name, old: F.coalesce(F.when(known, F.coalesce(F.col(f"_s.{name}"), F.lit(False))), F.col(old))
    out = flagged.withColumn("keep", F.when(~known, F.col("keep")).when(F.col("_some"), F.col("_keep")).otherwise(F.col("_first")))
    out = out.withColumn("approved", F.when(known, F.coalesce("_s.approved", "_s.reviewed", F.lit(False))).otherwise(F.col("approved")))
    out = out.withColumn("skipped", flag("skip", "skipped")).withColumn("delete_entire", flag("delete_entire", "delete_entire"))
    return out.drop("_s", "_keep", "_some", "_first")
