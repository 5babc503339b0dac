"""Line deduplication by site-relative frequency.

A line is boilerplate on a host if more than ``ratio`` of the host's pages have it, and
at least ``min_pages`` do. Each page counts a line once. The counts are map-side
combined (host, line hash) pairs, so a hot host or a line that is on every page is a few
partial counts. A host has at most 1 / ratio times as many boilerplate lines as its pages
have lines each, so they are one short array a host, which its pages meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.columns import free_name
from shelfmark.scratch import cut

#: Between the shares that real boilerplate has by host (8.6 to 13.2 % in the tables) and those of other lines (up to 4.8 %).
RATIO = 0.065
MIN_PAGES = 5
#: Bytes of boilerplate keys (8 a line, and 64 for its host) up to which they are sent to every executor.
BROADCAST_BYTES = 8 << 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _host(host: Column) -> Column:
    return F.coalesce(host.cast("string"), F.lit(""))


def _keys(host: Column, text: Column) -> Column:
    """Identity of each line on its host, blanks at its ends aside; null for a line of blanks."""
    bare = F.transform(_lines(text), lambda x: F.trim(F.translate(x, "\t\r", "  ")))
    return F.transform(bare, lambda x: F.when(x != "", F.xxhash64(host, x)))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """(host, known): the keys of the lines that more than ``ratio`` of the host's pages, and at least ``min_pages``, have."""
    pages = docs.select(_host(host).alias("host"), text.cast("string").alias("text"))
    totals = cut(pages.groupBy("host").agg(F.count("*").alias("pages")), "pages")
    keys = F.array_distinct(F.array_compact(_keys(F.col("host"), F.col("text"))))
    counts = pages.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("having")).where(F.col("having") >= min_pages)
    frequent = counts.join(totals, "host").where(F.col("having") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_set("key").alias("known"))


def drop_lines(
    docs: DataFrame,
    text_col: str = "text",
    host: Column | str = "source",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    keep_copied: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All columns of ``docs``, ``text_col`` without its boilerplate lines, and a struct ``line_dedup`` (n_lines, n_dropped, copied).

    The lines left keep their order and are joined by newlines; a page without boilerplate
    keeps its text as it is. ``copied`` marks a page all of whose lines are boilerplate:
    whole pages repeat on that host. It is empty then, unless ``keep_copied`` leaves such
    pages whole for near-duplicate removal to settle.

    A null host is a host of its own, the empty one; a null text stays null with no lines.
    Lines of blanks (spaces, tabs, carriage returns) are never counted nor dropped. Rows
    are pages: repeated rows each count. An empty table gives an empty result. Any column
    names are safe; if ``docs`` has a column ``line_dedup``, the struct is ``line_dedup_``.

    The boilerplate lines are counted first. Up to ``broadcast_bytes`` they are sent to
    every executor; beyond that pages are joined with them by host, where a hot host's
    pages can be split, as the lines are a table of their own with one row a host.
    """
    host = F.col(host) if isinstance(host, str) else host
    found = cut(boilerplate(docs, host, F.col(text_col), ratio, min_pages), "boilerplate")
    size = found.agg(F.coalesce(F.sum(8 * F.size("known") + 64), F.lit(0))).first()[0]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), _host(host).alias("host"), _keys(_host(host), F.col(f"`{text_col}`")).alias("keys"))
    marked = rows.join(F.broadcast(found) if size <= broadcast_bytes else found.hint("merge"), "host", "left")

    text = F.col("row")[text_col]
    drop = F.when(F.col("known").isNotNull(), F.array_intersect("keys", "known"))
    with_keys = marked.select("row", drop.alias("drop"), "keys", F.size(F.array_compact("keys")).alias("n_lines"))
    some = F.coalesce(F.size("drop") > 0, F.lit(False))
    gone = lambda k: F.coalesce(F.array_contains(F.col("drop"), k), F.lit(False))
    pairs = F.arrays_zip(_lines(text).alias("line"), F.col("keys").alias("key"))
    left = F.array_join(F.transform(F.filter(pairs, lambda x: ~gone(x["key"])), lambda x: x["line"]), "\n")
    n_gone = F.when(some, F.size(F.filter("keys", gone))).otherwise(0)
    judged = with_keys.select("row", "n_lines", some.alias("some"), n_gone.alias("n_gone"), F.when(some, left).alias("left"))

    copied = F.col("some") & (F.col("n_gone") == F.col("n_lines"))
    spared = copied if keep_copied else F.lit(False)
    new = F.when(F.col("some") & ~spared, F.col("left")).otherwise(F.col("row")[text_col])
    facts = F.struct(
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(spared, 0).otherwise(F.col("n_gone")).cast("long").alias("n_dropped"),
        copied.alias("copied"),
    )
    own = [new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return judged.select(*own, facts.alias(free_name("line_dedup", docs.columns)))
