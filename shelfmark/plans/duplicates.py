"""Duplicate-finder queries: documents stand for files, their SimHash for a perceptual hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.hashing import dimension_block, from_hex, hamming, sign_bits, simhash, simhash_of
from shelfmark.operators import groups as G
from shelfmark.operators import similarity as S
from shelfmark.plans.presets import duplicate_options
from shelfmark.scratch import cut
from shelfmark.sources.tables import table

BITS = 60


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    size = F.length("text").cast("long")
    return d.select(
        F.col("doc_id").alias("id"),
        path.alias("path"),
        F.lower(path).alias("path_norm"),
        size.alias("size"),
        (F.lit(1_700_000_000) + F.col("doc_id") * 7919 % 1000).cast("long").alias("mtime"),
        F.when(F.col("doc_id") % 11 != 0, F.lit(320) + size % 5 * 20).cast("long").alias("width"),
        (F.lit(240) + size % 3 * 20).cast("long").alias("height"),
        F.sha2("text", 256).alias("sha256"),
        F.col("text"),
    )


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = files(spark, sf_dir).withColumn("phash", simhash_of(F.col("text"), BITS)).drop("text")
    return hashed.select(
        "*",
        F.when(F.col("id") % 4 != 0, F.shiftrightunsigned("phash", 20)).alias("dhash"),
        F.col("phash").bitwiseAND(F.lit(0xFFF)).alias("colorhash"),
        F.when(F.col("id") % 5 == 0, F.array(F.col("phash"), F.col("phash").bitwiseXOR(F.lit((1 << 40) - 1)))).alias("phash_frames"),
    )


def dup_size_candidates(spark, sf_dir):
    return G.size_candidates(files(spark, sf_dir)).select("id", "path", "size")


def _exact(spark, sf_dir, policy="largest_pixels"):
    f = G.size_candidates(files(spark, sf_dir)).drop("text")
    return G.assemble(G.members(f, G.exact_edges(f)), policy)


def dup_exact_groups(spark, sf_dir):
    return _exact(spark, sf_dir).select("group_id", "component", F.array_join("paths", "|").alias("paths"), "n", "suggested_keep", "is_exact")


def _keep(policy):
    def query(spark, sf_dir):
        return _exact(spark, sf_dir, policy).select("group_id", "suggested_keep")

    return query


def dup_bucket_stats(spark, sf_dir):
    f = files(spark, sf_dir)
    return G.block_statistics(f.select(dimension_block(F.col("width")).alias("bw"), dimension_block(F.col("height")).alias("bh")), ["bw", "bh"])


def dup_dedupe_paths(spark, sf_dir):
    f = files(spark, sf_dir).select("id", "path", "path_norm", "size")
    again = f.where(F.col("id") % 3 == 0).select((F.col("id") + 1_000_000_000).alias("id"), F.upper("path").alias("path"), "path_norm", "size")
    return G.first_by_path(f.unionByName(again)).select("id", "path", "path_norm")


def sig_signbits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", sign_bits(F.col("embedding"), BITS).alias("signature"))


def sig_simhash(spark, sf_dir):
    return simhash(table(spark, sf_dir, "documents"), "doc_id", "text", BITS)


def sig_hex(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    h = F.substring(F.sha2("text", 256), 1, 16)
    return d.select("doc_id", from_hex(h).alias("bits"), hamming(from_hex(h), F.when(F.col("doc_id") % 7 != 0, from_hex(F.substring(F.sha2("lang", 256), 1, 16)))).cast("int").alias("distance"))


def dup_hamming_pairs(spark, sf_dir):
    o = duplicate_options("balanced")
    items = S.with_blocks(signatures(spark, sf_dir), o)
    heads = items.groupBy("bw", "bh", "phash").agg(F.min("id").alias("head"), F.count("*").alias("members"))
    pairs = S.hamming_pairs(heads, "head", "phash", o.phash_radius, BITS, ("bw", "bh"))
    return pairs.select("bw", "bh", "key_a", "key_b", F.col("distance").cast("int").alias("distance"))


def dup_color_pairs(spark, sf_dir):
    items = S.with_blocks(signatures(spark, sf_dir), duplicate_options("balanced"))
    heads = items.groupBy("bw", "bh", "colorhash").agg(F.min("id").alias("head"))
    return S.hamming_pairs(heads, "head", "colorhash", 1, 12, ("bw", "bh"), bands=2).select("bw", "bh", "key_a", "key_b", F.col("distance").cast("int").alias("distance"))


def dup_multiframe_pairs(spark, sf_dir):
    o = duplicate_options("balanced")
    return S.multiframe_pairs(S.visual_classes(signatures(spark, sf_dir), o), o, BITS)


def dup_geometry_filter(spark, sf_dir):
    f = files(spark, sf_dir).drop("text").withColumn("half", F.floor(F.col("id") / 2)).withColumn("width", F.col("width") * F.when(F.col("id") % 6 == 0, 3).otherwise(1))
    a, b = f.where("id % 2 = 0").alias("a"), f.where("id % 2 = 1").alias("b")
    return a.join(b, F.col("a.half") == F.col("b.half")).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), S.plausible_geometry("a", "b").alias("plausible"))


def _group_rows(groups: DataFrame) -> DataFrame:
    return groups.select("component", F.array_join("paths", "|").alias("paths"), "n", "suggested_keep", "is_exact")


def dup_perceptual_groups(spark, sf_dir):
    return _group_rows(G.duplicate_groups(signatures(spark, sf_dir), duplicate_options("balanced"), bits=BITS))


def dup_verify_pairs(spark, sf_dir):
    return S.verification_pairs(signatures(spark, sf_dir), duplicate_options("deep"))


def dup_verified_groups(spark, sf_dir):
    s = cut(signatures(spark, sf_dir), "signatures")
    pairs = S.verification_pairs(s, duplicate_options("strict"))
    paths = s.select("id", "path")
    named = pairs.join(paths.select(F.col("id").alias("id_a"), F.col("path").alias("path_a")), "id_a").join(paths.select(F.col("id").alias("id_b"), F.col("path").alias("path_b")), "id_b")
    stored = named.select("path_a", "path_b", (F.col("distance") <= 12).alias("same"))
    fresh = named.where("distance % 2 = 1").select(F.col("path_b").alias("path_a"), F.col("path_a").alias("path_b"), F.lit(False).alias("same"))
    o = duplicate_options("fast", keep="newest_mtime")
    return _group_rows(G.duplicate_groups(s, o, G.merge_decisions(stored, fresh), BITS))


QUERIES = {f.__name__: f for f in (dup_size_candidates, dup_exact_groups, dup_bucket_stats, dup_dedupe_paths, sig_signbits, sig_simhash, sig_hex, dup_hamming_pairs, dup_color_pairs, dup_multiframe_pairs, dup_geometry_filter, dup_perceptual_groups, dup_verify_pairs, dup_verified_groups)}
QUERIES |= {f"dup_keep_policy_{n}": _keep(p) for n, p in (("pixels", "largest_pixels"), ("mtime", "newest_mtime"), ("file", "largest_file"))}

# --- SQL

_FILES = """files AS (SELECT doc_id AS id, concat_ws('/', source, (CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END) || '_' || doc_id || '.txt') AS path,
  lower(concat_ws('/', source, lang || '_' || doc_id || '.txt')) AS path_norm, length(text) AS size, 1700000000 + doc_id * 7919 % 1000 AS mtime,
  CASE WHEN doc_id % 11 <> 0 THEN 320 + length(text) % 5 * 20 END AS width, 240 + length(text) % 3 * 20 AS height, sha256(text) AS sha256, text FROM documents)"""
_VOTES = ", ".join(f"sum(CASE WHEN (h & {1 << i}) <> 0 THEN 1 ELSE -1 END) AS b{i}" for i in range(BITS))
_SIM = f"""tok AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n]+'), lambda t: t <> ''))) AS t FROM documents),
  hashed AS (SELECT doc_id, ('0x' || substr(sha256(t), 1, 15))::BIGINT AS h FROM tok), votes AS (SELECT doc_id, {_VOTES} FROM hashed GROUP BY doc_id),
  sim AS (SELECT d.doc_id, coalesce({' | '.join(f'(CASE WHEN b{i} > 0 THEN {1 << i} ELSE 0 END)::BIGINT' for i in range(BITS))}, 0) AS simhash FROM documents d LEFT JOIN votes v ON d.doc_id = v.doc_id)"""
_BLOCK = "floor(coalesce(nullif({0}, 0), -1) / 32.0)::BIGINT"
_SIGS = f"""{_FILES}, {_SIM}, sigs AS (SELECT f.*, simhash AS phash, CASE WHEN id % 4 <> 0 THEN simhash >> 20 END AS dhash, simhash & 4095 AS colorhash,
  CASE WHEN id % 5 = 0 THEN [simhash, xor(simhash, {(1 << 40) - 1})] END AS frames, {_BLOCK.format('width')} AS bw, {_BLOCK.format('height')} AS bh FROM files f JOIN sim s ON s.doc_id = f.id)"""
_KEEP = {"pixels": "px DESC, size DESC, mtime DESC", "mtime": "mtime DESC, px DESC, size DESC", "file": "size DESC, px DESC, mtime DESC"}


def _components(edges: str) -> str:
    return f"""both_ways AS (SELECT src, dst FROM ({edges}) UNION SELECT dst, src FROM ({edges})),
  reach AS (SELECT src AS id, src AS root FROM both_ways UNION SELECT e.dst, r.root FROM reach r JOIN both_ways e ON e.src = r.id),
  comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""


def _assembled(source: str, order: str, columns: str) -> str:
    return f"""grouped AS (SELECT f.*, component, coalesce(width, 0) * coalesce(height, 0) AS px FROM {source} f JOIN comp USING (id)),
  kept AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY {order}, lower(path), path) AS r FROM grouped),
  g AS (SELECT component, list(path ORDER BY lower(path), path) AS paths, max(path) FILTER (WHERE r = 1) AS suggested_keep, count(DISTINCT sha256) = 1 AS is_exact FROM kept GROUP BY component HAVING count(*) >= 2)
  SELECT {columns} FROM g"""


_STAR = "SELECT min(id) OVER (PARTITION BY {0}) AS src, id AS dst FROM files"
_FULL = "sha256(array_to_string(paths, '|')) AS group_id, component, array_to_string(paths, '|') AS paths, len(paths) AS n, suggested_keep, is_exact"
_SHORT = "component, array_to_string(paths, '|') AS paths, len(paths) AS n, suggested_keep, is_exact"
_GEO = """(coalesce(a.width > 0 AND a.height > 0 AND b.width > 0 AND b.height > 0, false) = false OR
  (greatest(a.width * a.height, b.width * b.height) / least(a.width * a.height, b.width * b.height)::DOUBLE <= 3.5 AND
   greatest(a.width / a.height::DOUBLE, b.width / b.height::DOUBLE) / least(a.width / a.height::DOUBLE, b.width / b.height::DOUBLE) <= 2.0))"""
_MEAN = """(list_sum([list_min([bit_count(xor(x, y)) for y in fb]) for x in fa]) / len(fa) + list_sum([list_min([bit_count(xor(x, y)) for x in fa]) for y in fb]) / len(fb)) / 2"""
_PERCEPTUAL = f"""matches AS (SELECT src, dst FROM (
  SELECT a.id AS src, b.id AS dst, {_GEO} AS geo, (a.frames IS NOT NULL OR b.frames IS NOT NULL) AS moving, coalesce(a.frames, [a.phash]) AS fa, coalesce(b.frames, [b.phash]) AS fb,
    bit_count(xor(a.phash, b.phash)) <= 10 AND (a.dhash IS NULL OR b.dhash IS NULL OR bit_count(xor(a.dhash, b.dhash)) <= 12) AS still
  FROM sigs a JOIN sigs b ON a.bw = b.bw AND a.bh = b.bh AND a.id < b.id) WHERE geo AND CASE WHEN moving THEN {_MEAN} <= 7 ELSE still END)"""
_CLASSES = "classes AS (SELECT min(id) AS rep, bw, bh, phash, frames FROM sigs GROUP BY width, height, phash, dhash, colorhash, frames, bw, bh)"

SQL = {
    "dup_size_candidates": f"WITH {_FILES} SELECT id, path, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)",
    "dup_exact_groups": f"WITH RECURSIVE {_FILES}, {_components(_STAR.format('sha256'))}, {_assembled('files', _KEEP['pixels'], _FULL)}",
    "dup_bucket_stats": f"WITH {_FILES}, s AS (SELECT count(*) AS n FROM files GROUP BY {_BLOCK.format('width')}, {_BLOCK.format('height')}) SELECT sum(n * (n - 1) / 2)::BIGINT AS pairs, max(n) AS largest FROM s",
    "dup_dedupe_paths": f"WITH {_FILES}, both_sets AS (SELECT id, path, path_norm FROM files UNION ALL SELECT id + 1000000000, upper(path), path_norm FROM files WHERE id % 3 = 0) SELECT min(id) AS id, min_by(path, id) AS path, path_norm FROM both_sets GROUP BY path_norm",
    "sig_signbits": f"SELECT vec_id, {' | '.join(f'(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END)::BIGINT' for i in range(BITS))} AS signature FROM embeddings",
    "sig_simhash": f"WITH {_SIM} SELECT doc_id, simhash FROM sim",
    "sig_hex": """WITH h AS (SELECT doc_id, ('0x' || substr(sha256(text), 1, 16))::UBIGINT AS a, CASE WHEN doc_id % 7 <> 0 THEN ('0x' || substr(sha256(lang), 1, 16))::UBIGINT END AS b FROM documents)
      SELECT doc_id, (CASE WHEN a >= 9223372036854775808 THEN a::HUGEINT - 18446744073709551616 ELSE a::HUGEINT END)::BIGINT AS bits, coalesce(bit_count(xor(a, b)), 9999)::INT AS distance FROM h""",
    "dup_hamming_pairs": f"WITH {_SIGS}, heads AS (SELECT bw, bh, phash, min(id) AS head FROM sigs GROUP BY 1, 2, 3) SELECT a.bw, a.bh, a.head AS key_a, b.head AS key_b, bit_count(xor(a.phash, b.phash))::INT AS distance FROM heads a JOIN heads b ON a.bw = b.bw AND a.bh = b.bh AND a.head < b.head WHERE bit_count(xor(a.phash, b.phash)) <= 10",
    "dup_color_pairs": f"WITH {_SIGS}, heads AS (SELECT bw, bh, colorhash, min(id) AS head FROM sigs GROUP BY 1, 2, 3) SELECT a.bw, a.bh, a.head AS key_a, b.head AS key_b, bit_count(xor(a.colorhash, b.colorhash))::INT AS distance FROM heads a JOIN heads b ON a.bw = b.bw AND a.bh = b.bh AND a.head < b.head WHERE bit_count(xor(a.colorhash, b.colorhash)) <= 1",
    "dup_multiframe_pairs": f"""WITH {_SIGS}, {_CLASSES}, f AS (SELECT rep, bw, bh, frames IS NOT NULL AS several, unnest(coalesce(frames, [phash])) AS h FROM classes)
      SELECT DISTINCT a.rep AS key_a, b.rep AS key_b FROM f a JOIN f b ON a.bw = b.bw AND a.bh = b.bh AND a.rep < b.rep WHERE (a.several OR b.several) AND bit_count(xor(a.h, b.h)) <= 10""",
    "dup_geometry_filter": f"WITH {_FILES}, w AS (SELECT id, width * CASE WHEN id % 6 = 0 THEN 3 ELSE 1 END AS width, height FROM files) SELECT a.id AS id_a, b.id AS id_b, {_GEO} AS plausible FROM w a JOIN w b ON a.id % 2 = 0 AND b.id = a.id + 1",
    "dup_perceptual_groups": f"WITH RECURSIVE {_SIGS}, {_PERCEPTUAL}, {_components('SELECT src, dst FROM matches UNION ALL ' + _STAR.format('sha256'))}, {_assembled('files', _KEEP['pixels'], _SHORT)}",
    "dup_verify_pairs": f"""WITH {_SIGS} SELECT a.bw, a.bh, a.id AS id_a, b.id AS id_b, bit_count(xor(a.phash, b.phash))::INT AS distance FROM sigs a JOIN sigs b ON a.bw = b.bw AND a.bh = b.bh AND a.id < b.id
      WHERE {_GEO} AND a.sha256 <> b.sha256 AND (bit_count(xor(a.phash, b.phash)) BETWEEN 6 AND 16 OR bit_count(xor(a.colorhash, b.colorhash)) <= 8) ORDER BY 1, 2, 3, 4 LIMIT 15000""",
    "dup_verified_groups": f"""WITH RECURSIVE {_SIGS}, pairs AS (SELECT a.id AS x, b.id AS y, bit_count(xor(a.phash, b.phash)) AS d FROM sigs a JOIN sigs b ON a.bw = b.bw AND a.bh = b.bh AND a.id < b.id
        WHERE {_GEO} AND a.sha256 <> b.sha256 AND bit_count(xor(a.phash, b.phash)) BETWEEN 6 AND 12 ORDER BY a.bw, a.bh, a.id, b.id LIMIT 15000),
      yes AS (SELECT x AS src, y AS dst FROM pairs WHERE d % 2 = 0), {_components('SELECT src, dst FROM yes UNION ALL ' + _STAR.format('sha256'))}, {_assembled('files', _KEEP['mtime'], _SHORT)}""",
}
SQL |= {f"dup_keep_policy_{k}": f"WITH RECURSIVE {_FILES}, {_components(_STAR.format('sha256'))}, {_assembled('files', order, _FULL).replace('SELECT ' + _FULL, 'SELECT sha256(array_to_string(paths, ' + chr(39) + '|' + chr(39) + ')) AS group_id, suggested_keep')}" for k, order in _KEEP.items()}
