"""Metrics of a run: rolling means, error storms, summaries, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.ranking import running, small

ROLLING, STORM_S = 20, 12


def rolling_eta(tasks: DataFrame, run: str, seq: str, seconds: str, total: Column, workers: int) -> DataFrame:
    """Adds ``mean_s`` of a run's last 20 tasks and ``eta_s`` = remaining x mean / workers."""
    order = Window.partitionBy(run).orderBy(seq)
    mean = F.avg(seconds).over(order.rowsBetween(-(ROLLING - 1), 0))
    left = F.greatest(F.lit(0), total - F.row_number().over(order))
    return tasks.withColumn("mean_s", mean).withColumn("eta_s", left * F.col("mean_s") / max(1, workers))


def error_storms(errors: DataFrame, run: str, epoch: str, workers: int, reload: Column | None = None) -> DataFrame:
    """Adds ``recent`` (errors of the last 12 seconds) and ``cooldown_s``: 6 after a model reload, 2 in a storm, else 0."""
    w = Window.partitionBy(run).orderBy(epoch).rangeBetween(-STORM_S, 0)
    recent = F.count("*").over(w)
    reloading = F.coalesce(reload, F.lit(False)) if reload is not None else F.lit(False)
    return errors.withColumn("recent", recent).withColumn("cooldown_s", F.when(reloading, 6).when(F.col("recent") >= max(4, 2 * workers), 2).otherwise(0))


def run_summary(events: DataFrame, run: str) -> DataFrame:
    """One row a run: done, errors, seconds, files_per_sec, mean_api_s (0 where there were no calls). events: kind, epoch, api_s."""
    out = events.groupBy(run).agg(
        F.sum((F.col("kind") == "done").cast("long")).alias("done"),
        F.sum((F.col("kind") == "error").cast("long")).alias("errors"),
        (F.max("epoch") - F.min("epoch")).cast("double").alias("seconds"),
        F.coalesce(F.avg("api_s"), F.lit(0.0)).alias("mean_api_s"),
    )
    return out.withColumn("files_per_sec", F.coalesce(F.try_divide("done", "seconds"), F.lit(0.0)))


def progress(events: DataFrame, run: str, seq: str) -> DataFrame:
    """One row: done and total summed over the latest event of each run."""
    last = events.groupBy(run).agg(F.max_by("done", seq).alias("done"), F.max_by("total", seq).alias("total"))
    return last.agg(F.coalesce(F.sum("done"), F.lit(0)).alias("done"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def exemplar_fingerprint(exemplars: DataFrame, tag: str, mtime: str) -> DataFrame:
    """One row: 16 hex digits that change when a tag's exemplars do (their number and latest time)."""
    by_tag = exemplars.groupBy(tag).agg(F.count("*").alias("n"), F.max(mtime).alias("m"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.col(tag), F.col("n").cast("string"), F.col("m").cast("string"))))
    return by_tag.agg(F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 16).alias("fingerprint"))


def capped_exemplars(exemplars: DataFrame, tag: str, name: str, most: int = 48) -> DataFrame:
    """The first exemplars of each tag by name; the cap is the feature."""
    return exemplars.withColumn("_r", F.row_number().over(Window.partitionBy(tag).orderBy(name))).where(F.col("_r") <= most).drop("_r")


def round_robin(items: DataFrame, order: list[str], endpoints: DataFrame, now: float) -> DataFrame:
    """Adds ``endpoint``: items dealt in turn to the endpoints that aren't cooling; to the one that is ready first if all are.

    endpoints: endpoint, pos, cooling_until (a handful of rows).
    """
    free = endpoints.where(F.coalesce(F.col("cooling_until"), F.lit(0.0)) <= now)
    listed = free.agg(F.array_sort(F.collect_list(F.struct("pos", "endpoint"))).alias("_free"))
    first = endpoints.agg(F.min_by("endpoint", F.struct("cooling_until", "pos")).alias("_first"))
    dealt = running(items, [], order, 1, "_turn").crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(first))
    turn = F.pmod(F.col("_turn") - 1, F.greatest(F.size("_free"), F.lit(1))).cast("int")
    return dealt.withColumn("endpoint", F.coalesce(F.get("_free", turn)["endpoint"], F.col("_first"))).drop("_turn", "_free", "_first")


def scan_progress(events: DataFrame, run: str, seq: str) -> DataFrame:
    """One row a run: done, total, files a second and seconds left as of its latest event. events: done, total, elapsed."""
    last = events.groupBy(run).agg(*(F.max_by(c, seq).alias(c) for c in ("done", "total", "elapsed")))
    rate = F.coalesce(F.try_divide(F.col("done"), F.col("elapsed")), F.lit(0.0))
    left = F.greatest(F.lit(0), F.col("total") - F.col("done"))
    return last.select(run, "done", "total", rate.alias("rate"), F.coalesce(F.try_divide(left, rate), F.lit(0.0)).alias("eta_s"))


def current_messages(messages: DataFrame, run: str, current: DataFrame, key: str) -> DataFrame:
    """Messages of each key's current run; those of stale runs are dropped. current: key, run."""
    return messages.join(small(current), [key, run], "left_semi")


#: Steps a task may take.
STEPS = (
    ("idle", "running"), ("running", "pausing"), ("pausing", "paused"), ("paused", "running"), ("running", "stopping"), ("pausing", "stopping"), ("paused", "stopping"),
    ("stopping", "stopped"), ("running", "finished"), ("running", "error"), ("stopped", "running"), ("finished", "running"), ("error", "running"),
)


def illegal_steps(events: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """Events whose state can't follow the one before of the same key (idle before the first)."""
    before = F.coalesce(F.lag(state).over(Window.partitionBy(key).orderBy(seq)), F.lit("idle"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in STEPS))
    out = events.withColumn("before", before)
    return out.where((F.col("before") != F.col(state)) & ~F.array_contains(steps, F.struct(F.col("before").alias("a"), F.col(state).alias("b"))))


def unload_set(instances: DataFrame, key: str, instance: str, pos: str, active: str) -> DataFrame:
    """Instances to unload: of an active key all but the one named like the key, or else the first; of other keys all."""
    keep = F.row_number().over(Window.partitionBy(key).orderBy((F.col(instance) == F.col(key)).desc(), pos)) == 1
    return instances.withColumn("_k", keep & F.col(active)).where("not _k").drop("_k")
