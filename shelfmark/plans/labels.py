"""Label and reply queries: events and customers stand for model replies in all their shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import geometry, replies, text
from shelfmark.sources.tables import table

VOCABULARY = text.Vocabulary(
    tags=("click", "error", "purchase", "signup", "view", "landscape", "page_view"),
    legacy={"buy": "order", "order": "purchase", "scenery": "landscape"},
    segment_aliases={"auto": "car", "kitten": "cat", "woods": "forest"},
    weak=("a", "and", "image", "images", "misc", "photo", "photos", "other"),
    roots=("nature", "animal", "vehicle"),
    presets={"nature": "landscape"},
)
# (expression of tag t and number n in SQL that both engines read)
SHAPES = (
    "t", "concat('<think>maybe error</think> ', t)", "concat('Category: ', upper(t))", "concat('I think it shows things', chr(10), 'final tag: \"', t, '\"')",
    "concat(t, ', nature/forests-', n, ', ', t)", "'Nature / Wild Life / big--cats'", "'###'", "concat('This image shows a ', t, ' page')", "concat('<think>unclosed ', t)",
    "''", "'buy'", "'photos/cars, kittens; dogs|cats'", "concat('<|channel|>final ', t, '_now')", "concat('cats, dogs', chr(10), 'dogs, auto/woods')", "concat('`scenery`', chr(10), 'because')", "'cities/nature/glass, cities/nature/glass'",
)


def _case(shapes) -> str:
    return "CASE " + " ".join(f"WHEN event_id % {len(shapes)} = {k} THEN {s}" for k, s in enumerate(shapes)) + " END"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "CAST(event_type AS STRING) AS t", "CAST(event_id % 3 AS STRING) AS n").selectExpr("event_id", f"{_case(SHAPES)} AS raw")


def txt_strip_reasoning(spark, sf_dir):
    return labels(spark, sf_dir).select("event_id", text.strip_reasoning(F.col("raw")).alias("clean"))


def txt_label(spark, sf_dir):
    raw = F.col("raw")
    return labels(spark, sf_dir).select("event_id", text.normalise_exact(raw, VOCABULARY).alias("exact"), text.normalise(raw, VOCABULARY).alias("inside"))


def txt_hier_tag(spark, sf_dir):
    return labels(spark, sf_dir).select("event_id", text.hierarchical(F.col("raw"), VOCABULARY).alias("tag"))


def txt_free(spark, sf_dir):
    return labels(spark, sf_dir).select("event_id", text.normalise_free(F.col("raw"), VOCABULARY).alias("tag"))


def txt_auto_vote(spark, sf_dir):
    return labels(spark, sf_dir).select("event_id", text.normalise_auto(F.col("raw"), VOCABULARY).alias("tag"))


def txt_alias_resolve(spark, sf_dir):
    """User aliases before built-in ones, else the cleaned key; an empty key gives the category itself."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 17 == 0, "!!").otherwise(F.col("p_type")).alias("category"))
    keyed = parts.withColumn("key", text.clean_alias(F.col("category")))
    user = spark.createDataFrame([("small plated tin", "Metal / Plated"), ("Large Brushed", "metal/brushed"), ("", "x")], "src string, dst string")
    builtin = spark.createDataFrame([("economy_burnished_steel", "metal"), ("small_plated_tin", "unused")], "key string, builtin string")
    cleaned = user.select(text.clean_alias(F.col("src")).alias("key"), text.clean_alias(F.col("dst")).alias("user")).where("key <> '' and user <> '' and key <> user")
    found = keyed.join(F.broadcast(cleaned), "key", "left").join(F.broadcast(builtin), "key", "left")
    return found.select("p_partkey", F.when(F.col("key") == "", F.col("category")).otherwise(F.coalesce("user", "builtin", "key")).alias("storage"))


def txt_prompts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.lower("p_brand"), "#", "_").alias("tag"), F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.repeat("p_name", 20)).alias("d"))
    return p.select("p_partkey", F.array_join(text.prompts(F.col("tag"), F.col("d")), "\n").alias("prompts"))


_NAMES = "CASE event_id % 8 WHEN 6 THEN concat('Capture d', chr(39), 'écran 2024.png') WHEN 0 THEN concat('Screen_Shot-', event_id) WHEN 1 THEN concat('scanned ', t) WHEN 2 THEN 'QR-Code.png' WHEN 3 THEN concat('invoice_', n) WHEN 4 THEN 'Договор.jpg' WHEN 5 THEN 'скрин 1' ELSE t END"


def txt_filename_heuristics(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(event_type AS STRING) AS t", "CAST(event_id % 3 AS STRING) AS n").selectExpr("event_id", f"{_NAMES} AS name", "CAST(event_id % 20 AS INT) AS w")
    found = text.filename_heuristic(F.col("name"), F.col("w"), F.lit(100), ("screenshot", "receipt_barcode", "document"))
    return e.select("event_id", found.alias("f")).select("event_id", "f.tag", "f.confidence", "f.reason")


def txt_provider_bits(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    base = F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.when(F.col("page_id") % 3 == 0, "/api/v1/").when(F.col("page_id") % 3 == 1, "/v1").otherwise("//"))
    reply = F.when(F.col("page_id") % 4 == 0, " yes, same").when(F.col("page_id") % 4 == 1, "No").when(F.col("page_id") % 4 == 2, "<think>yes</think> NOT sure").otherwise("")
    return p.select("page_id", text.api_base(base).alias("base"), text.yes_or_no(reply).alias("same"))


JSON_SHAPES = (
    "concat('{\"category\":\"', t, '\",\"confidence\":0.', n, '5}')",
    "concat('Sure: {\"primary_category\":\"buy\",\"confidence\":87,\"reasoning\":\" it is ', t, ' \"} done')",
    "concat('{\"best_folder_name\":\"', t, '\",\"confidence\":\"high\",\"top_candidates\":[{\"folder_name\":\"', t, '\",\"confidence\":0.6},{\"category\":\"view\",\"confidence\":0.', n, '5},\"click\"]}')",
    "concat('```json', chr(10), '{\"tag\":\"nothing\",\"candidates\":[\"', t, '\",\"signup\"],\"confidence\":1.5}', chr(10), '```')",
    "concat('{\"label\":\"', t, '\",\"tags\":\"error; view\",\"needs_review\":true,\"confidence\":0.9}')",
    "t", "'{broken'", "''", "'[1,2]'", "concat('{\"category\":\"none\",\"confidence\":-3}')",
)


def json_replies(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "CAST(event_type AS STRING) AS t", "CAST(event_id % 3 AS STRING) AS n").selectExpr("event_id", f"{_case(JSON_SHAPES)} AS raw")


def json_extract(spark, sf_dir):
    obj = replies.fields(replies.json_object(F.col("raw")))
    return json_replies(spark, sf_dir).select("event_id", obj.isNotNull().alias("is_object"), replies.primary_label(obj).alias("label"))


def json_candidates(spark, sf_dir):
    obj = replies.fields(replies.json_object(F.col("raw")))
    return json_replies(spark, sf_dir).select("event_id", F.array_join(F.when(obj.isNotNull(), replies.candidate_names(obj)).otherwise(F.array().cast("array<string>")), "|").alias("names"), F.round(F.when(obj.isNotNull(), replies.margin(obj)).otherwise(1.0), 6).alias("margin"))


def json_result(spark, sf_dir):
    r = replies.result(F.col("raw"), lambda c: text.normalise(c, VOCABULARY))
    return json_replies(spark, sf_dir).select("event_id", r.alias("r")).select("event_id", "r.category", F.array_join("r.candidates", "|").alias("candidates"), F.round("r.confidence", 6).alias("confidence"), "r.reason", "r.needs_review")


def fn_crops(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 900 + 20).cast("int").alias("w"), (F.col("p_partkey") * 13 % 700 + 25).cast("int").alias("h"))
    b = F.col("b")
    return p.select("p_partkey", F.posexplode(geometry.crop_boxes(F.col("w"), F.col("h"), 12)).alias("view", "b")).select("p_partkey", "view", b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))


def fn_spread_idx(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).cast("int").alias("n"), (F.col("p_partkey") % 9).cast("int").alias("k"))
    return p.select("p_partkey", F.array_join(geometry.spread_indices(F.col("n"), F.col("k")).cast("array<string>"), ",").alias("indices"))


def fn_sample_times(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 40 / 4.0).cast("double").alias("d"), (F.col("p_partkey") % 7).cast("int").alias("k"))
    p = p.withColumn("times", geometry.sample_times(F.col("d"), F.col("k")))
    more = geometry.fallback_times(F.col("d"), F.col("times"))
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.round(x * 1000).cast("int").cast("string")), ",")
    return p.select("p_partkey", shown(F.col("times")).alias("times_ms"), shown(more).alias("fallback_ms"))


QUERIES = {f.__name__: f for f in (txt_strip_reasoning, txt_label, txt_hier_tag, txt_free, txt_auto_vote, txt_alias_resolve, txt_prompts, txt_filename_heuristics, txt_provider_bits, json_extract, json_candidates, json_result, fn_crops, fn_spread_idx, fn_sample_times)}

# --- SQL, built from small expressions; each takes the name of a value

_BLANK = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)"
_QUOTE = "'`\"' || chr(39)"
_V = VOCABULARY


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"


def _map(m: dict[str, str], key: str) -> str:
    return "CASE " + f"{key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


def _strip(x: str) -> str:
    final = r"(?is)<\|channel\|>\s*final\b(.*)$"
    out = _let(f"coalesce({x}, '')", "s0", f"CASE WHEN regexp_matches(s0, '{final}') THEN regexp_extract(s0, '{final}', 1) ELSE s0 END")
    for p in (r"(?is)<think>.*?</think>", r"(?is)<think>.*$", r"(?is)<\|channel>\s*thought\b.*?<channel\|>", r"(?is)<\|channel\|>\s*(?:analysis|thought)\b.*?<\|channel\|>\s*final\b", r"(?im)^[ \t]*</think>[ \t]*$"):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANK})"


def _label(x: str) -> str:
    return _let(f"trim(trim({x}, {_BLANK}), {_QUOTE})", "b0", f"CASE WHEN regexp_matches(b0, '{text.LABEL}') THEN trim(trim(regexp_extract(b0, '{text.LABEL}', 1), {_BLANK}), {_QUOTE}) ELSE b0 END")


def _twice(t: str) -> str:
    return _let(f"coalesce({_map(_V.legacy, t)}, {t})", "o0", f"coalesce({_map(_V.legacy, 'o0')}, o0)")


def _resolve(x: str) -> str:
    return _let(x, "t0", f"CASE WHEN list_contains({_list(_V.tags)}, t0) THEN t0 WHEN list_contains({_list(_V.tags)}, {_twice('t0')}) THEN {_twice('t0')} END")


def _lines(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\r\\n|\\r|\\n'), lambda l0: trim(l0, {_BLANK}) <> '')"


def _exact(raw: str) -> str:
    body = f"coalesce({_resolve('lower(' + _label('src') + ')')}, {_let(_lines('src'), 'ls', 'coalesce(' + _resolve('lower(' + _label('ls[1]') + ')') + ', ' + _resolve('lower(' + _label('ls[-1]') + ')') + ')')})"
    return _let(f"CASE WHEN {_strip(raw)} <> '' THEN {_strip(raw)} ELSE {raw} END", "src", body)


def _seg(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim({x}, {_BLANK}), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g'), '_')"


def _hier(raw: str) -> str:
    t = _let(_label(_strip(raw)), "h0", f"lower(trim(CASE WHEN h0 <> '' THEN h0 ELSE {_label(f'coalesce({raw}, ' + chr(39) * 2 + ')')} END, {_BLANK}))")
    cleaned = f"regexp_replace(replace({t}, '`', ' '), '[^a-z0-9_/\\-\\s]+', ' ', 'g')"
    out = f"array_to_string(list_transform(list_filter(list_transform(string_split({cleaned}, '/'), lambda g0: {_seg('g0')}), lambda g1: g1 <> '')[1:4], lambda g2: substr(g2, 1, 32)), '/')"
    return _let(out, "p0", f"CASE WHEN p0 = '' THEN 'uncategorized' WHEN list_contains({_list(_V.tags)}, p0) THEN {_twice('p0')} ELSE trim(substr(p0, 1, 128), '/') END")


def _looks(x: str) -> str:
    body = f"(k0 <> '' AND length(k0) <= 160 AND NOT regexp_matches(k0, '[{{}}\\[\\]:]') AND (regexp_matches(k0, '[/_\\-]') OR NOT contains(k0, ' ')) AND (regexp_matches(k0, '[/_\\-]') OR NOT regexp_matches(k0, '{text.PROSE}')) AND regexp_matches(k0, '[a-z0-9]'))"
    return _let(f"lower({_label(x)})", "k0", body)


def _auto_seg(x: str) -> str:
    y, one = "substr(q0, 1, length(q0) - 3) || 'y'", "substr(q0, 1, length(q0) - 1)"
    a = lambda e: f"coalesce({_map(_V.segment_aliases, e)}, {e})"
    return _let(_seg(f"lower({x})"), "q0", f"CASE WHEN {_map(_V.segment_aliases, 'q0')} IS NOT NULL THEN {_map(_V.segment_aliases, 'q0')} WHEN length(q0) > 4 AND q0 LIKE '%ies' THEN {a('(' + y + ')')} WHEN length(q0) > 3 AND q0 LIKE '%s' AND q0 NOT LIKE '%ss' THEN {a('(' + one + ')')} ELSE q0 END")


def _auto(raw: str) -> str:
    segs = f"list_filter(list_transform(string_split(safe, '/'), lambda u0: {_auto_seg('u0')}), lambda u1: u1 <> '' AND NOT list_contains({_list(_V.weak)}, u1))"
    unique = f"list_transform([{segs}], lambda z0: list_filter(z0, lambda e, i: list_position(z0, e) = i))[1]"
    root = _let("zs", "z1", f"coalesce(list_filter(z1, lambda w0: list_contains({_list(_V.roots)}, w0))[1], z1[1])")
    out = _let(root, "rt", _let("list_filter(zs, lambda w1: w1 <> rt)[1]", "dt", f"CASE WHEN dt IS NULL THEN coalesce({_map(_V.presets, 'rt')}, rt) ELSE rt || '/' || dt END"))
    final = _let(out, "fo", f"CASE WHEN list_contains({_list(_V.tags)}, fo) THEN fo ELSE trim(substr(fo, 1, 96), '/') END")
    return _let(_hier(raw), "safe", f"CASE WHEN safe = 'uncategorized' OR list_contains({_list(_V.tags)}, safe) THEN safe ELSE {_let(unique, 'zs', f'CASE WHEN len(zs) = 0 THEN {chr(39)}uncategorized{chr(39)} ELSE {final} END')} END")


_LABELS = f"tn AS (SELECT event_id, event_type AS t, (event_id % 3)::VARCHAR AS n FROM events), labels AS (SELECT event_id, {_case(SHAPES)} AS raw FROM tn)"
_INSIDE = f"list_filter({_list(sorted(_V.tags, key=lambda t: (-len(t), t)))}, lambda i0: contains(lower(CASE WHEN {_strip('raw')} <> '' THEN {_strip('raw')} ELSE raw END), i0))[1]"
_NORMAL = f"coalesce({_exact('raw')}, CASE WHEN raw <> '' THEN {_INSIDE} END, 'uncategorized')"
_REPLIES = f"tn AS (SELECT event_id, event_type AS t, (event_id % 3)::VARCHAR AS n FROM events), replies AS (SELECT event_id, {_case(JSON_SHAPES)} AS raw FROM tn)"


def _object(x: str) -> str:
    ok = lambda e: f"CASE WHEN json_valid({e}) AND json_type({e}) = 'OBJECT' THEN {e} END"
    return _let(f"nullif(regexp_extract({x}, '(?s)(\\{{.*\\}})', 1), '')", "j0", f"coalesce({ok('j0')}, {ok('trim(' + x + ')')})")


_OBJECTS = f"{_REPLIES}, objects AS (SELECT event_id, raw, {_object('raw')} AS obj FROM replies)"
_PRIMARY = "coalesce(" + ", ".join(f"nullif(json_extract_string(obj, '$.{k}'), '')" for k in replies.PRIMARY_KEYS) + ", '')"


def _conf(value: str, fallback: str) -> str:
    return _let(f"try_cast({value} AS DOUBLE)", "c0", f"CASE WHEN c0 IS NULL THEN {fallback} ELSE greatest(0.0, least(1.0, CASE WHEN c0 > 1 AND c0 <= 100 THEN c0 / 100 ELSE c0 END)) END")


_TOPS = "coalesce(json_extract(obj, '$.top_candidates[*]'), [])"
_ITEM = "CASE WHEN json_type(m0) = 'OBJECT' THEN coalesce(" + ", ".join(f"json_extract_string(m0, '$.{k}')" for k in replies.TOP_KEYS) + ") ELSE json_extract_string(m0, '$') END"
_GIVEN = "CASE WHEN json_type(obj, '$.candidates') = 'ARRAY' THEN list_transform(json_extract(obj, '$.candidates[*]'), lambda m1: json_extract_string(m1, '$')) WHEN json_type(obj, '$.tags') = 'VARCHAR' THEN string_split_regex(json_extract_string(obj, '$.tags'), '[\\n,;|]+') ELSE [] END"
_NAMED = f"list_filter(list_transform(list_concat(list_transform({_TOPS}, lambda m0: {_ITEM}), {_GIVEN}), lambda m2: trim(m2)), lambda m3: m3 <> '')"
_PROBS = f"list_reverse_sort(list_transform(list_filter({_TOPS}, lambda m4: json_type(m4) = 'OBJECT'), lambda m5: {_conf(chr(39).join(['json_extract_string(m5, ', '$.confidence', ')']), '0.5')}))"
_MARGIN = _let(_PROBS, "ps", "CASE WHEN len(ps) >= 2 THEN ps[1] - ps[2] ELSE 1.0 END")
_TEXT_NORMAL = lambda x: f"coalesce({_exact(x)}, CASE WHEN {x} <> '' THEN list_filter({_list(sorted(_V.tags, key=lambda t: (-len(t), t)))}, lambda i1: contains(lower({x}), i1))[1] END, 'uncategorized')"

_CLEAN_PART = "substr(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(a0)), '[^a-z0-9_/\\-\\s]+', ' ', 'g'), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g'), '_/'), 1, 96)"


def _clean(x: str) -> str:
    return f"trim(substr(array_to_string(list_filter(list_transform(string_split({x}, '/'), lambda a0: {_CLEAN_PART}), lambda a1: a1 <> ''), '/'), 1, 128), '/')"




def _heuristic(field: int) -> str:
    cases = " ".join("WHEN regexp_matches(name, '(?i)" + r[3].replace("'", "''") + "') THEN " + (f"{r[1]}::DOUBLE" if field == 1 else f"'{r[field]}'") for r in text.FILENAME_RULES)
    return f"CASE WHEN w >= 8 THEN CASE {cases} END END"


_PART = lambda size, share: f"greatest(24, floor({size} * {share}::DOUBLE)::INT)"
_BOXES = """WITH p AS (SELECT p_partkey, (p_partkey * 7 % 900 + 20)::INT AS w, (p_partkey * 13 % 700 + 25)::INT AS h FROM part),
  s AS (SELECT *, {cw} AS cw, {ch} AS ch, {cz} AS cz, {bh} AS bh, {bw} AS bw, {cw2} AS cw2, {ch2} AS ch2 FROM p),
  b AS (SELECT p_partkey, w, h, [[0,0,w,h],[0,0,cw,ch],[w-cw,0,w,ch],[0,h-ch,cw,h],[w-cw,h-ch,w,h],[floor((w-cz)/2)::INT,floor((h-cz)/2)::INT,floor((w-cz)/2)::INT+cz,floor((h-cz)/2)::INT+cz],
    [0,greatest(0,floor((h-bh)/2)::INT),w,greatest(0,floor((h-bh)/2)::INT)+bh],[greatest(0,floor((w-bw)/2)::INT),0,greatest(0,floor((w-bw)/2)::INT)+bw,h],[0,0,cw2,ch2],[w-cw2,h-ch2,w,h]] AS boxes FROM s),
  e AS (SELECT p_partkey, unnest(CASE WHEN w < 32 OR h < 32 THEN boxes[1:1] ELSE boxes END) AS x, generate_subscripts(CASE WHEN w < 32 OR h < 32 THEN boxes[1:1] ELSE boxes END, 1) - 1 AS view FROM b)
  SELECT p_partkey, view, x[1] AS x0, x[2] AS y0, x[3] AS x1, x[4] AS y1 FROM e""".format(
    cw=_PART("w", 0.88), ch=_PART("h", 0.88), cz=_PART("least(w, h)", 0.72), bh=_PART("h", 0.55), bw=_PART("w", 0.55), cw2=_PART("w", 0.76), ch2=_PART("h", 0.76)
)
_IN = "greatest(0.0, least({0} * d, greatest(0.0, d - 0.001)))"

SQL = {
    "txt_strip_reasoning": f"WITH {_LABELS} SELECT event_id, {_strip('raw')} AS clean FROM labels",
    "txt_label": f"WITH {_LABELS} SELECT event_id, coalesce({_exact('raw')}, 'uncategorized') AS exact, {_NORMAL} AS inside FROM labels",
    "txt_hier_tag": f"WITH {_LABELS} SELECT event_id, {_hier('raw')} AS tag FROM labels",
    "txt_free": f"WITH {_LABELS} SELECT event_id, coalesce({_exact('raw')}, {_let('list_reverse(' + _lines(_strip('raw')) + ')', 'rv', f'list_filter(list_transform(list_filter(rv, lambda y0: {_looks(chr(121) + chr(48))}), lambda y1: {_hier(chr(121) + chr(49))}), lambda y2: y2 <> {chr(39)}uncategorized{chr(39)})[1]')}, CASE WHEN len({_lines(_strip('raw'))}) > 0 THEN 'uncategorized' END, {_hier('raw')}) AS tag FROM labels",
    "txt_auto_vote": f"""WITH {_LABELS}, chunk AS (SELECT event_id, raw, unnest(string_split_regex(lower({_strip('raw')}), '[\\n,;|]+')) AS c, generate_subscripts(string_split_regex(lower({_strip('raw')}), '[\\n,;|]+'), 1) AS pos FROM labels),
      cand AS (SELECT event_id, pos, {_auto('c')} AS tag FROM chunk WHERE {_looks('c')}), votes AS (SELECT event_id, tag, count(*) AS n, min(pos) AS first FROM cand WHERE tag <> 'uncategorized' GROUP BY 1, 2),
      won AS (SELECT event_id, tag FROM votes QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first, length(tag), tag) = 1)
      SELECT event_id, CASE WHEN raw = '' THEN 'uncategorized' ELSE coalesce({_exact('raw')}, won.tag, {_auto('lower(' + _strip('raw') + ')')}) END AS tag FROM labels LEFT JOIN won USING (event_id)""",
    "txt_alias_resolve": f"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '!!' ELSE p_type END AS category FROM part), k AS (SELECT *, {_clean('category')} AS key FROM c)
      SELECT p_partkey, CASE WHEN key = '' THEN category ELSE coalesce(CASE key WHEN 'small_plated_tin' THEN 'metal/plated' WHEN 'large_brushed' THEN 'metal/brushed' END, CASE key WHEN 'economy_burnished_steel' THEN 'metal' WHEN 'small_plated_tin' THEN 'unused' END, key) END AS storage FROM k""",
    "txt_prompts": """WITH p AS (SELECT p_partkey, replace(lower(p_brand), '#', '_') AS tag, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE repeat(p_name, 20) END AS d0 FROM part),
      q AS (SELECT p_partkey, CASE WHEN trim(replace(tag, '_', ' ')) = '' THEN tag ELSE trim(replace(tag, '_', ' ')) END AS l, trim(regexp_replace(d0, '\\s+', ' ', 'g')) AS s FROM p),
      r AS (SELECT *, CASE WHEN length(s) > 220 THEN rtrim(substr(s, 1, 217)) || '...' ELSE s END AS d FROM q)
      SELECT p_partkey, array_to_string(CASE WHEN d <> '' THEN ['a photo of ' || l || '.', 'a photo of ' || l || ', ' || d, 'an image showing ' || d, 'a picture of ' || d, d] ELSE ['a photo of ' || l || '.', 'a clear, well-lit photo of ' || l || '.', 'a picture of ' || l || '.'] END, chr(10)) AS prompts FROM r""",
    "txt_filename_heuristics": f"WITH tn AS (SELECT event_id, event_type AS t, (event_id % 3)::VARCHAR AS n FROM events), f AS (SELECT event_id, {_NAMES} AS name, (event_id % 20)::INT AS w FROM tn) SELECT event_id, {_heuristic(0)} AS tag, {_heuristic(1)} AS confidence, {_heuristic(2)} AS reason FROM f",
    "txt_provider_bits": "SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS base, page_id % 4 = 0 AS same FROM pages",
    "json_extract": f"WITH {_OBJECTS} SELECT event_id, obj IS NOT NULL AS is_object, CASE WHEN obj IS NULL THEN '' ELSE {_PRIMARY} END AS label FROM objects",
    "json_candidates": f"WITH {_OBJECTS} SELECT event_id, CASE WHEN obj IS NULL THEN '' ELSE coalesce(array_to_string({_NAMED}, '|'), '') END AS names, round(CASE WHEN obj IS NULL THEN 1.0 ELSE {_MARGIN} END, 6) AS margin FROM objects",
    "json_result": f"""WITH {_OBJECTS}, a AS (SELECT event_id, raw, obj, {_PRIMARY} AS lab, CASE WHEN obj IS NULL THEN []::VARCHAR[] ELSE {_NAMED} END AS names, {_MARGIN} AS margin FROM objects),
      b AS (SELECT *, {_TEXT_NORMAL('raw')} AS plain, list_filter(list_transform(list_concat([lab], names), lambda n0: {_TEXT_NORMAL('n0')}), lambda n1: n1 <> 'uncategorized') AS normal FROM a),
      c AS (SELECT *, CASE WHEN obj IS NULL THEN list_filter([plain], lambda n2: n2 <> 'uncategorized') ELSE list_filter(normal, lambda e, i: list_position(normal, e) = i) END AS cands, {_TEXT_NORMAL('lab')} AS prim FROM b),
      d AS (SELECT *, CASE WHEN obj IS NULL THEN plain WHEN prim <> 'uncategorized' THEN prim ELSE coalesce(cands[1], 'uncategorized') END AS category FROM c),
      e AS (SELECT *, CASE WHEN obj IS NULL THEN CASE WHEN category <> 'uncategorized' THEN 0.55 ELSE 0 END ELSE {_conf("json_extract_string(obj, '$.confidence')", "CASE WHEN category <> 'uncategorized' THEN 0.55 ELSE 0 END")} END AS conf FROM d)
      SELECT event_id, category, array_to_string(cands, '|') AS candidates, round(conf::DOUBLE, 6) AS confidence, CASE WHEN obj IS NULL THEN 'legacy_tag_output' ELSE substr(trim(coalesce(json_extract_string(obj, '$.reasoning'), '')), 1, 240) END AS reason,
        category = 'uncategorized' OR conf < 0.55 OR (obj IS NOT NULL AND (coalesce(json_extract_string(obj, '$.needs_review') = 'true', false) OR round(margin, 9) < 0.12)) AS needs_review FROM e""",
    "fn_crops": _BOXES,
    "fn_spread_idx": """WITH p AS (SELECT p_partkey, (p_partkey % 50)::INT AS n, (p_partkey % 9)::INT AS k FROM part)
      SELECT p_partkey, array_to_string(CASE WHEN n <= 0 OR k <= 0 THEN []::INT[] WHEN k = 1 THEN [0] WHEN k >= n THEN range(n)::INT[] ELSE [round_even(i * (n - 1) / (k - 1)::DOUBLE, 0)::INT for i in range(k)] END, ',') AS indices FROM p""",
    "fn_sample_times": f"""WITH p AS (SELECT p_partkey, (p_partkey % 40 / 4.0)::DOUBLE AS d, (p_partkey % 7)::INT AS k FROM part),
      q AS (SELECT *, CASE WHEN k <= 0 THEN []::DOUBLE[] ELSE [CASE WHEN d <= 0.001 THEN 0.0 ELSE {_IN.format('f')} END for f in CASE WHEN k <= 3 THEN ([0.0, 0.5, 1.0]::DOUBLE[])[1:k] ELSE [i / (k - 1)::DOUBLE for i in range(k)] END] END AS times FROM p)
      SELECT p_partkey, array_to_string([round(x * 1000)::INT for x in times], ',') AS times_ms, array_to_string(CASE WHEN d <= 0.001 THEN []::INT[] ELSE [round(x * 1000)::INT for x in [{_IN.format('f')} for f in [0.9, 0.1, 0.75, 0.25, 0.66, 0.33]::DOUBLE[]] if NOT list_contains([round(t, 3) for t in times], round(x, 3))] END, ',') AS fallback_ms FROM q""",
}
