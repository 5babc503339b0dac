"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets decide.

1. Each text becomes its set of five-word shingles. Equal sets form one class at once, so
   that copies never meet each other again; a class carries its number of documents.
2. Classes are shuffled on their band keys (8 bytes each, not texts). A bucket of two or
   more adds a star of edges to its least member: linear in its size.
3. Candidates are verified in units. Classes connected over buckets are one unit, in which
   all pairs are compared. Where unlike texts that share a band here and there chain up, so
   that a unit has more pairs than all its buckets together, its buckets are the units, and
   a pair counts in the first band it shares alone. Work never exceeds the candidates'.
4. A unit's n-gram sets are dealt in blocks of bounded number and bytes, and every pair of
   blocks is one task that counts intersections of all its pairs at once. It emits one row
   for each class: its links, and its local root.
5. Components over the verified links are the near-duplicate classes.

No pair is ever a row, and no link is dropped: the number of links of a document counts
every document whose similarity reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.shingles import NGRAM, BandHasher, WordHashes, choose_bands, ngram_set
from shelfmark.operators.components import connected_components
from shelfmark.scratch import cut

THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 160
#: A unit is dealt in blocks of BLOCK classes, up to SPREAD blocks; beyond that the blocks grow up to LARGEST classes or GRAMS shingles, then their number does.
BLOCK, SPREAD, LARGEST, GRAMS = 64, 24, 2048, 2_000_000
#: Rows up to which a table of 64-bit keys is sent to every executor instead of shuffling texts to it.
BROADCAST_ROWS = 250_000


def _set_key(grams: np.ndarray) -> int | None:
    """64-bit identity of an n-gram set; none for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64)) if len(grams) else None


def content_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h, k, grams, bands): hash of each text, identity, size and band keys of its n-gram set; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hasher = WordHashes(), BandHasher(bands, rows)
        for batch in batches:
            keys, sizes, found = [], [], []
            for text in batch.column(2):
                grams = ngram_set(text.as_py(), hashes, n)
                keys.append(_set_key(grams))
                sizes.append(len(grams))
                found.append(hasher.keys(grams).view(np.int64) if len(grams) else None)
            more = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names=["doc_id", "h", "k", "grams", "bands"])

    text = F.col(text_col).cast("string")
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), content_hash(text).alias("h"), text.alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, h long, k long, grams long, bands array<long>")


def _gram_sets(rows: DataFrame, n: int) -> DataFrame:
    """(k, grams): the n-gram set of ``text`` as bytes, for the rows whose set is the one named by k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [ngram_set(t.as_py(), hashes, n) for t in batch.column(1)]
            keep = pa.array([_set_key(s) == k for s, k in zip(sets, batch.column(0).to_pylist())], pa.bool_())
            sets = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["k", "grams"]).filter(keep)

    return rows.select("k", "text").mapInArrow(run, "k long, grams binary")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each left set with each right set, as (left, right) counts."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(gram)[gram] > 1
    owner, gram = owner[shared], gram[shared]
    _, gram = np.unique(gram, return_inverse=True)
    width = int(gram.max()) + 1 if len(gram) else 0
    counts = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    step = max(64, 4_000_000 // len(sets))  # columns at once, so that memory is bounded whatever the sets' sizes
    edges = np.searchsorted(gram, np.arange(0, width + step, step))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        m = np.zeros((len(sets), step), np.float32)
        m[owner[a:b], gram[a:b] - k * step] = 1
        counts += m[: len(left)] @ m[len(left) :].T
    return counts


def _verify(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links and local root of each class of a pair of blocks; in a unit of one band, of pairs that share no earlier band."""
    group = group.drop_duplicates(["k", "side"])
    sides = [group[group.side == s].sort_values("k") for s in (0, 1)]
    alone = bool((group.i == group.j).iloc[0])
    band = int(group.band.iloc[0])
    left, right = sides[0], sides[0] if alone else sides[1]
    out_k = left.k.to_numpy(np.int64) if alone else np.concatenate([left.k.to_numpy(np.int64), right.k.to_numpy(np.int64)])
    links, root = np.zeros(len(out_k), np.int64), np.arange(len(out_k))
    if len(left) and len(right):
        a, b = ([np.frombuffer(x, np.uint64) for x in side.grams] for side in (left, right))
        both = _intersections(a, b)
        union = np.array([len(x) for x in a], np.float32)[:, None] + np.array([len(x) for x in b], np.float32)[None] - both
        linked = both >= threshold * union - 1e-6 * union
        if alone:
            np.fill_diagonal(linked, False)
        if band > 0:
            earlier_a, earlier_b = (np.stack(side.bands.to_list())[:, :band] for side in (left, right))
            for x, y in zip(earlier_a.T, earlier_b.T):
                linked &= x[:, None] != y[None]
        shift = 0 if alone else len(left)
        links[: len(left)] += linked @ right.copies.to_numpy().astype(np.int64)
        if not alone:
            links[shift:] += linked.T @ left.copies.to_numpy().astype(np.int64)
        x, y = np.nonzero(linked)
        y = y + shift
        while True:  # least root among neighbours, then of the root, until nothing moves
            before = root.copy()
            np.minimum.at(root, x, root[y])
            np.minimum.at(root, y, root[x])
            root = root[root]
            if (root == before).all():
                break
    return pd.DataFrame({"k": out_k, "links": links, "root": out_k[root]})


def _units(classes: DataFrame) -> DataFrame:
    """(k, units): for each class with candidates, the (unit, band, blocks) it is compared in; at most one for each band."""
    keyed = classes.select("k", "grams", F.posexplode("bands").alias("band", "key"))
    buckets = cut(keyed.groupBy("key").agg(F.min("k").alias("head"), F.count("*").alias("size"), F.sum("grams").alias("grams")).where("size > 1"), "buckets")
    star = keyed.join(buckets.select("key", "head"), "key").where("k <> head").select(F.col("k").alias("src"), F.col("head").alias("dst"))
    clusters = cut(connected_components(star).withColumnRenamed("id", "k"), "clusters")

    in_buckets = buckets.join(clusters.withColumnRenamed("k", "head"), "head").groupBy("component").agg(F.sum(F.col("size").cast("double") ** 2).alias("apart"))
    whole = clusters.join(classes.select("k", "grams"), "k").groupBy("component").agg(F.count("*").alias("size"), F.sum("grams").alias("grams"))
    sizes = cut(whole.join(in_buckets, "component").withColumn("split", (F.col("size") > BLOCK) & (F.col("size").cast("double") ** 2 > F.col("apart"))), "sizes")

    most = F.greatest(F.ceil(F.col("size") / LARGEST), F.ceil(F.col("grams") / GRAMS))
    blocks = F.greatest(most, F.least(F.lit(SPREAD), F.ceil(F.col("size") / BLOCK))).cast("long").alias("blocks")
    together = clusters.join(sizes.where("not split").select("component", blocks), "component").select("k", F.struct(F.col("component").alias("unit"), F.lit(-1).alias("band"), "blocks").alias("u"))
    parts = cut(
        buckets.join(clusters.withColumnRenamed("k", "head"), "head").join(sizes.where("split").select("component"), "component", "left_semi").select("key", blocks),
        "parts",
    )
    apart = keyed.join(parts, "key").select("k", F.struct(F.col("key").alias("unit"), "band", "blocks").alias("u"))
    return together.unionByName(apart).groupBy("k").agg(F.collect_list("u").alias("units"))


def _with_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, text): one text for each row (h, k) of the table ``wanted``; ``texts`` has h and text.

    Up to BROADCAST_ROWS, ``wanted`` goes to the texts, and only those it names are
    shuffled; beyond that all distinct texts are. Copies are met map-side in either case.
    """
    first = F.first("text").alias("text")
    if wanted.count() <= BROADCAST_ROWS:
        return texts.join(F.broadcast(wanted), "h").groupBy("h", "k").agg(first)
    return texts.groupBy("h").agg(first).join(wanted.hint("merge"), "h")


def _classified(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, most_hashes: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, h, k of each document; classes: k, copies, component, n_links of each set with words)."""
    bands, rows = choose_bands(threshold, recall, most_hashes)
    signed = cut(signatures(docs, id_col, text_col, n, bands, rows), "signatures")
    first = [F.min("h").alias("h"), F.first("grams").alias("grams"), F.first("bands").alias("bands")]
    classes = cut(signed.where("k is not null").groupBy("k").agg(F.count("*").alias("copies"), *first), "classes")

    units = cut(_units(classes), "units")
    compared = cut(units.join(classes.select("k", "copies", "h", F.col("bands").alias("own_bands")), "k"), "compared")
    wanted = cut(compared.select("h", "k"), "wanted")
    texts = docs.select(content_hash(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    sets = _gram_sets(_with_text(texts, wanted), n)

    placed = sets.join(compared, "k").select("k", "copies", "grams", "own_bands", F.explode("units").alias("u"))
    own = F.pmod(F.xxhash64("k"), F.col("u.blocks"))
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("u.blocks") - 1)))
    dealt = dealt.select(
        F.col("u.unit").alias("unit"),
        F.col("u.band").alias("band"),
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "k",
        "copies",
        "grams",
        F.when(F.col("u.band") > 0, F.col("own_bands")).alias("bands"),
    )
    checked = cut(dealt.groupBy("unit", "band", "i", "j").applyInPandas(lambda g: _verify(g, threshold), "k long, links long, root long"), "checked")

    joined = connected_components(checked.where("k <> root").select(F.col("k").alias("src"), F.col("root").alias("dst")))
    links = checked.groupBy("k").agg(F.sum("links").alias("links"))
    known = (
        classes.select("k", "copies")
        .join(joined.withColumnRenamed("id", "k"), "k", "left")
        .join(links, "k", "left")
        .select("k", "copies", F.coalesce("component", "k").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    return signed.select("doc_id", "h", "k"), cut(known, "known")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of n-word shingles
    (lower-cased ``\\w+`` words) is at least ``threshold``. class_id is the least doc_id
    among all documents reached over links; n_links counts the documents linked directly,
    exact copies included. Bands and rows are chosen so that a pair at the threshold is
    found with probability ``recall``.

    A text of fewer than n words is one shingle of all its words. A null text or one
    without words has no links and is its own class. Each row is a document: rows that
    repeat a doc_id are linked as copies if their texts agree. A null doc_id is carried
    along; a class of such rows alone has a null class_id. Other columns are not read.
    """
    rows, classes = _classified(docs, id_col, text_col, n, threshold, recall, most_hashes)
    worded = rows.where("k is not null")
    first = cut(worded.groupBy("k").agg(F.min("doc_id").alias("first_id")), "first")
    heads = cut(classes.join(first, "k").groupBy("component").agg(F.min("first_id").alias("class_id")), "heads")
    named = cut(classes.join(heads, "component").select("k", "class_id", "n_links"), "named")
    linked = worded.join(named, "k").select("doc_id", "class_id", "n_links")
    return linked.unionByName(rows.where("k is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """The rows of ``docs`` without near duplicates: exactly one row of each class of two or more.

    It is the row with the least id (null ids come last), then the least hash of the text;
    of rows that agree in both, the one with the least hash of all columns. Rows are told
    apart by id and text, so null and repeated ids neither lose a row nor spare one. Rows
    without words are in no class and all stay. Columns keep their names, order and types.

    What decides on a text in a class of several rows is one narrow row. Up to
    BROADCAST_ROWS of them go to the documents, and no text is shuffled but those of rows
    that repeat both id and text; beyond that documents are joined with them on the hash
    of the text.
    """
    rows, classes = _classified(docs, id_col, text_col, n, threshold, recall, most_hashes)
    several = classes.where("n_links > 0").select("k", "component")
    texts = cut(rows.where("k is not null").groupBy("k", "h", "doc_id").agg(F.count("*").alias("times")).join(several, "k"), "texts")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    heads = cut(texts.groupBy("component").agg(F.min(order).alias("head"), F.min_by("times", order).alias("times")), "heads")
    judged = texts.select("h", "component").distinct().join(heads, "component")
    rules = cut(judged.select(F.col("h").alias("_h"), (F.col("h") == F.col("head.h")).alias("_first"), F.col("head.doc_id").alias("_id"), F.col("times").alias("_times")), "rules")

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    held = docs.select(row.alias("row"), content_hash(F.col(text_col)).alias("h"), F.col(id_col).cast("long").alias("id"))
    small = rules.count() <= BROADCAST_ROWS
    met = held.join(F.broadcast(rules) if small else rules.hint("merge"), F.col("h") == F.col("_h"), "left")
    own = F.col("_first") & F.col("id").eqNullSafe(F.col("_id"))
    alone = met.where(F.col("_h").isNull() | (own & (F.col("_times") == 1))).select("row.*")
    # grouped by a key of its own, so that the join's hot texts can still be split
    repeated = met.where(own & (F.col("_times") > 1)).select("row", F.xxhash64("h", "id").alias("key"))
    again = repeated.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return alone.unionByName(again)
