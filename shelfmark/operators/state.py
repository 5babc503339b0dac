"""Resumable run state as table snapshots: merging, resume filters, versions.

A snapshot is never changed in place: ``merge`` makes the next one, which the caller
writes to a new directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESUMABLE = ("running", "paused", "interrupted", "stopped")


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same keys, but for the columns in ``keep_old``.

    Columns that only one side has are null on the other (schema growth). Keys compare
    null-safe; both sides must be unique by key.
    """
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    o = old.select(F.struct(*old.columns).alias("o"), *(F.col(k).alias(f"_o_{k}") for k in keys))
    n = new.select(F.struct(*new.columns).alias("n"), *(F.col(k).alias(f"_n_{k}") for k in keys))
    same = [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys]
    both = o.join(n, same, "full_outer")

    def value(c: str) -> Column:
        mine = F.col(f"o.{c}") if c in old.columns else F.lit(None)
        theirs = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c not in new.columns or (c in keep_old and c in old.columns):
            return F.when(F.col("o").isNotNull(), mine).otherwise(theirs).alias(c)
        return F.when(F.col("n").isNotNull(), theirs).otherwise(mine).alias(c)

    return both.select(*map(value, columns))


def upsert_files(files: DataFrame, seen: DataFrame, version: int) -> DataFrame:
    """files (sha256, status, category, pipeline_version) after ``seen`` (sha256): state and what to do with each.

    Unknown: pending. Processed by this version: skip. Processed by another: pending
    again, without its category. Pending: stays.
    """
    old = files.select("sha256", F.col("status").alias("_s"), F.col("category").alias("_c"), F.col("pipeline_version").alias("_v"))
    joined = seen.select("sha256").distinct().withColumn("_seen", F.lit(True)).join(old, "sha256", "full_outer")
    done = F.coalesce((F.col("_s") == "processed") & (F.col("_v") == version), F.lit(False))
    touched = F.coalesce(F.col("_seen"), F.lit(False))
    return joined.select(
        "sha256",
        F.when(touched & ~done, "pending").otherwise(F.col("_s")).alias("status"),
        F.when(touched & (F.col("_s") == "processed") & ~done, F.lit(None)).otherwise(F.col("_c")).alias("category"),
        F.when(touched & ~done, F.lit(version)).otherwise(F.col("_v")).alias("pipeline_version"),
        F.when(touched, F.when(done, "skip").otherwise("process")).alias("action"),
    )


def still_to_do(items: DataFrame, done: DataFrame, session: str) -> DataFrame:
    """Items not yet done in a session in the same state (path, mtime, size)."""
    finished = done.where((F.col("session_key") == session) & (F.col("status") == "done")).select("path", "mtime", "size")
    return items.join(finished, ["path", "mtime", "size"], "left_anti")


def unprocessed(items: DataFrame, files: DataFrame, version: int) -> DataFrame:
    return items.join(files.where((F.col("status") == "processed") & (F.col("pipeline_version") == version)).select("sha256"), "sha256", "left_anti")


def with_cache(items: DataFrame, cache: DataFrame, version: int, exact: bool, visual: bool) -> DataFrame:
    """Adds ``hit``: whether the cached signature of the path is of the same file state and version and has what is needed.

    A visual signature needs a hash, and frame hashes too where the item's ``multiframe``
    says so. cache: path_norm, mtime, size, sig_version, sha256, phash, phash_frames.
    """
    c = cache.select(F.col("path_norm").alias("_p"), F.col("mtime").alias("_m"), F.col("size").alias("_z"), F.col("sig_version").alias("_v"), "sha256", "phash", "phash_frames")
    ok = (F.col("_m") == F.col("mtime")) & (F.col("_z") == F.col("size")) & (F.col("_v") == version)
    ok = ok & (F.col("sha256").isNotNull() if exact else F.lit(True)) & (F.col("phash").isNotNull() & (~F.col("multiframe") | F.col("phash_frames").isNotNull()) if visual else F.lit(True))
    return items.join(c, F.col("path_norm") == F.col("_p"), "left").withColumn("hit", F.coalesce(ok, F.lit(False))).drop("_p", "_m", "_z", "_v", "sha256", "phash", "phash_frames")


def from_cache(items: DataFrame, cache: DataFrame, visual: bool) -> DataFrame:
    """Items (path_norm, mtime, size) with the cached signature of the same file state; stale and missing ones go, versions aren't asked."""
    signed = cache.where("phash is not null") if visual else cache
    return items.join(signed.drop("sig_version"), ["path_norm", "mtime", "size"])


def resumed(items: DataFrame, done: DataFrame, session: str, cache: DataFrame, visual: bool) -> tuple[DataFrame, DataFrame]:
    """(records of items done in the session, from the cache; items still to compute). Done goes by path alone.

    An item that is done but no longer in the cache is in neither.
    """
    paths = done.where((F.col("session_key") == session) & (F.col("status") == "done")).select("path_norm").distinct()
    return from_cache(items.join(paths, "path_norm", "left_semi"), cache, visual), items.join(paths, "path_norm", "left_anti")


def cached_vectors(digests: DataFrame, cache: DataFrame, model_key: str, side: int) -> DataFrame:
    """(sha256, vec) of the digests whose embedding is cached for the model and image side with the length it says."""
    ok = (F.col("model_key") == model_key) & (F.col("image_max_side") == side) & (F.size("vec") == F.col("dim"))
    return digests.select("sha256").distinct().join(cache.where(ok).select("sha256", "vec"), "sha256")


def with_digests(files: DataFrame, cache: DataFrame, compute: Column) -> tuple[DataFrame, DataFrame]:
    """(files with sha256, cached or computed; rows to add to the cache). files: path_norm, mtime, size; ``compute`` is read for misses alone."""
    known = files.join(cache.select("path_norm", "mtime", "size", F.col("sha256").alias("_known")), ["path_norm", "mtime", "size"], "left")
    found = known.withColumn("sha256", F.coalesce("_known", F.when(F.col("_known").isNull(), compute)))
    return found.drop("_known"), found.where("_known is null").select("path_norm", "mtime", "size", "sha256")


def mark_processed(files: DataFrame, results: DataFrame, version: int) -> DataFrame:
    """files after ``results`` (sha256, category): those are processed by this version; unknown digests are added."""
    new = results.select("sha256", F.lit("processed").alias("status"), "category", F.lit(version).alias("pipeline_version"))
    return merge(files.select("sha256", "status", "category", "pipeline_version"), new, ["sha256"])


def cache_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def asks_to_resume(sessions: DataFrame) -> DataFrame:
    """Duplicate sessions that can be continued: they have files, and aren't both done and completed."""
    return sessions.where((F.col("total") > 0) & ~((F.col("done") >= F.col("total")) & (F.col("status") == "completed")))


def pair_decisions(decisions: DataFrame, session: str, pairs: DataFrame) -> DataFrame:
    """(path_a, path_b, decision) of the wanted pairs, in either order of paths; null where none is stored."""
    asked = pairs.select(F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b"))
    return asked.join(decisions.where(F.col("session_key") == session).select("path_a", "path_b", "decision"), ["path_a", "path_b"], "left")


def latest_incomplete(sessions: DataFrame) -> DataFrame:
    """The session that was touched last among those that can be resumed."""
    return sessions.where(F.col("status").isin(*RESUMABLE) & ((F.col("total") <= 0) | (F.col("done") < F.col("total")))).orderBy(F.desc("updated_at"), "session_key").limit(1)


def interrupt_running(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def session_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def newest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row a key: the one with the greatest ``by``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_r")).select(*keys, "_r.*")


def without(rows: DataFrame, condition: Column) -> DataFrame:
    """Snapshot without the rows that satisfy ``condition`` (clearing a session); a null condition keeps the row."""
    return rows.where(~F.coalesce(condition, F.lit(False)))
