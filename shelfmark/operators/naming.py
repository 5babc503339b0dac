"""Copy plans: destination names without collisions, and the free-space guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ranking import running
from shelfmark.scratch import cut

MARGIN = 64 << 20


def _stem_and_ext(name: Column) -> tuple[Column, Column]:
    ext = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def destinations(plan: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``dest`` (dest_dir/name, or stem_n.ext) to rows of source, dest_dir, name, sha256.

    ``existing`` has the dest_dir, name and sha256 of files that are there already. Names
    compare case aside. Equal content shares one destination (each row spells it its way), and content that is there
    under the name or a numbered form of it is not copied again; a file without a digest
    is its own content. A free name goes to the content of its least source; every other
    content gets, in order of its least source, the next number that no file in the folder
    and no name of the plan has. So no two contents meet at one destination.
    """
    content = F.coalesce(F.col("sha256"), F.concat(F.lit("path:"), F.col("source")))
    keyed = plan.withColumn("_c", content).withColumn("_low", F.lower("name"))
    first = cut(keyed.groupBy("dest_dir", "_low", "_c").agg(F.min("source").alias("_first")), "contents")
    there = plan.sparkSession.createDataFrame([], "dest_dir string, name string, sha256 string") if existing is None else existing
    there = cut(there.select("dest_dir", "name", F.lower("name").alias("_low"), "sha256"), "existing")

    # what is there already, by the name and by the name that a numbered file was made from
    stem, ext = _stem_and_ext(F.col("_low"))
    number = F.regexp_extract(stem, r"_([1-9]\d{0,8})$", 1)
    numbered = F.when(number != "", F.concat(F.regexp_replace(stem, r"_[1-9]\d{0,8}$", ""), ext))
    both = there.select("dest_dir", "_low", "name", "sha256", F.lit(0).alias("_n")).unionByName(there.where(numbered.isNotNull()).select("dest_dir", numbered.alias("_low"), "name", "sha256", number.cast("long").alias("_n")))
    held = both.where("sha256 is not null").groupBy("dest_dir", "_low", F.col("sha256").alias("_c")).agg(F.min_by("name", "_n").alias("_held"))
    left = cut(first.join(held, ["dest_dir", "_low", "_c"], "left"), "left")

    # the name itself goes to one content, unless a file has it
    heads = left.where("_held is null").groupBy("dest_dir", "_low").agg(F.min(F.struct("_first", "_c")).alias("_head"))
    heads = heads.join(there.select("dest_dir", "_low").distinct(), ["dest_dir", "_low"], "left_anti")
    owned = cut(heads.select("dest_dir", "_low", F.col("_head._c").alias("_c"), F.lit(True).alias("_own")), "owned")
    marked = left.join(owned, ["dest_dir", "_low", "_c"], "left")

    # numbers that files or other names of the plan have
    names = there.select("dest_dir", "_low").unionByName(left.select("dest_dir", "_low")).distinct()
    taken = cut(names.where(numbered.isNotNull()).groupBy("dest_dir", numbered.alias("_low")).agg(F.array_sort(F.collect_set(number.cast("long"))).alias("_taken")), "taken")
    waiting = running(marked.where("_held is null and _own is null"), ["dest_dir", "_low"], ["_first", "_c"], 1, "_k").join(taken, ["dest_dir", "_low"], "left")
    below = F.size(F.filter(F.transform("_taken", lambda t, i: t - i), lambda x: x <= F.col("_k")))
    free = F.col("_k") + F.when(F.col("_taken").isNotNull(), below).otherwise(0)
    given = cut(waiting.select("dest_dir", "_low", "_c", free.alias("_n")), "numbers")

    out = keyed.join(marked.select("dest_dir", "_low", "_c", "_held"), ["dest_dir", "_low", "_c"]).join(given, ["dest_dir", "_low", "_c"], "left")
    stem, ext = _stem_and_ext(F.col("name"))
    name = F.when(F.col("_held").isNotNull(), F.col("_held")).when(F.col("_n").isNull(), F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))
    return out.withColumn("dest", F.concat_ws("/", "dest_dir", name)).drop("_c", "_low", "_n", "_held")


def space_guard(files: DataFrame, order: str, size: str, free: int, margin: int = MARGIN) -> DataFrame:
    """Adds ``running`` (bytes up to and with each file, in order) and ``fits``: whether they leave the margin free."""
    return running(files, [], [order], F.col(size), "running").withColumn("fits", F.col("running") + margin <= free)
