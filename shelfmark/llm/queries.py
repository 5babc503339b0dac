"""Queries of this subpackage over the supplied tables, and their SQL where there is one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import chat_format, decontaminate, jaccard_join, licenses, line_dedup, packing, pii, quality_model, quality_rules, url_filter
from shelfmark.sources.tables import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_dropped").alias("n_dropped"), F.col("line_dedup.copied").alias("copied"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"))


#: A conversation that says the template's own words.
SAID = r"\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string"))
    turns = chat_format.canonical_turns(chat_format.conversations_as_records(rows), "record", role_names={})
    formatted = chat_format.format_turns(turns).select("conv_id", "layout", "formatted", "loss_spans")
    back = formatted.withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_url_filters,
        op3_quality_rules,
        op4_pii,
        op5_quality_classifier,
        op6_chat_formatting,
        op7_benchmark_decontamination,
        op8_ngram_jaccard_join,
        op9_license_scans,
        op10_best_fit_packing,
    )
}

SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = f"""
WITH pages AS (
  SELECT row_number() OVER () AS page, doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT page, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM pages
), keyed AS (
  SELECT page, host, pos, line, trim(replace(replace(line, chr(9), ' '), chr(13), ' ')) AS key FROM line
), totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
frequent AS (
  SELECT host, key FROM (SELECT host, key, count(DISTINCT page) AS having_it FROM keyed WHERE key <> '' GROUP BY host, key) c JOIN totals t USING (host)
  WHERE having_it >= {line_dedup.MIN_PAGES} AND having_it > {line_dedup.RATIO} * t.pages
), judged AS (
  SELECT k.*, (f.key IS NOT NULL AND k.key <> '') AS boiler FROM keyed k LEFT JOIN frequent f ON f.host = k.host AND f.key = k.key
), per_page AS (
  SELECT page, count(*) FILTER (WHERE key <> '') AS n_lines, count(*) FILTER (WHERE boiler) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT boiler), '') AS left_text
  FROM judged GROUP BY page
)
SELECT p.doc_id, CASE WHEN n_dropped = 0 THEN p.text ELSE left_text END AS text, n_lines, n_dropped, n_dropped > 0 AND n_dropped = n_lines AS copied
FROM per_page JOIN pages p USING (page)
"""


def _as_regex(glob: str) -> str:
    """The same language as a glob, as a regular expression."""
    parts = {"**": "(?:.|\\n)*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(t, t if t.startswith("\\") else re.escape(t)) for t in re.findall(r"\\.|\*\*|.", glob)) + "$"


def _rule_case() -> str:
    fits = []
    for r in url_filter.RULES:
        host, slash, path = r.name.partition("/")
        path_fits = f" AND starts_with(path, '{slash}{path}')" if slash else ""
        fits.append(f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')){path_fits} THEN struct_pack(size := {len(r.name)}, rule := '{r.name}', verdict := '{r.verdict}') END")
    return f"list_sort(list_filter([{', '.join(fits)}], lambda x: x IS NOT NULL), 'DESC')[1]"


def _glob_case() -> str:
    ordered = sorted(url_filter.GLOBS, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    return "CASE " + " ".join(f"WHEN regexp_matches('.' || host || path, '{_as_regex(r.glob)}') THEN '{r.name}'" for r in ordered) + " END"


SQL["op2_url_filters"] = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*((?:/[^?#]*)?)', 1) AS path FROM pages
), judged AS (SELECT *, {_rule_case()} AS hit, {_glob_case()} AS shape FROM parts)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN shape IS NOT NULL THEN 'block' END, '{url_filter.DEFAULT}') AS verdict,
       CASE WHEN hit IS NULL THEN shape END AS glob FROM judged
"""

_ESCAPED = "regexp_replace({0}, '(\\\\|</?turn>|<body>)', '\\\\\\1', 'g')"

SQL["op6_chat_formatting"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'
), each AS (
  SELECT *, length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len(chat_format.OPEN) + len(chat_format.BODY) + len(chat_format.CLOSE) + 5} AS chars FROM rows
), conv AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
         sum(chars)::BIGINT AS formatted_chars,
         list(role ORDER BY turn, role, text) = ['user', 'assistant'] AND max(text) FILTER (WHERE role = 'user') <> '' AS exchange,
         coalesce((conv_id % {len(chat_format.SERVED)} + {len(chat_format.SERVED)}) % {len(chat_format.SERVED)}, 0) AS served
  FROM each GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
       CASE WHEN served >= 4 AND NOT coalesce(exchange, false) THEN '{chat_format.SERVED[0]}' ELSE {list(chat_format.SERVED)}[served + 1] END AS layout
FROM conv
"""
