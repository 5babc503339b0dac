"""JSON replies of a model parsed into a result, all in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import UNCATEGORIZED, let, stripped

# Keys in order of precedence.
PRIMARY_KEYS = ("best_folder_name", "primary_category", "folder_name", "category", "tag", "label")
TOP_KEYS = ("folder_name", "primary_category", "category", "tag")
LIST_KEYS = ("candidates", "candidate_tags", "tags", "labels")
REASON_KEYS = ("reasoning", "reason_short", "reason")
KEYS = tuple(dict.fromkeys((*PRIMARY_KEYS, *TOP_KEYS, *LIST_KEYS, *REASON_KEYS, "top_candidates", "confidence", "needs_review")))
REVIEW_CONFIDENCE, REVIEW_MARGIN = 0.55, 0.12

_TOP = "array<string>"


def _json(text: Column) -> Column:
    """The text if it is a JSON object."""
    variant = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(variant), F.lit("OBJECT")), text)


def json_object(raw: Column) -> Column:
    """First of: first brace to last brace, a fenced block, the whole text, that is a JSON object; else null."""
    text = stripped(F.coalesce(raw, F.lit("")))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(_json(F.nullif(braces, F.lit(""))), _json(F.nullif(fenced, F.lit(""))), _json(text))


def fields(obj: Column) -> Column:
    """All fields of a reply that are read, as texts, from one pass over its JSON; null for none."""
    return F.from_json(obj, "struct<" + ",".join(f"{k}:string" for k in KEYS) + ">")


def _get(obj: Column, key: str) -> Column:
    return F.nullif(obj[key], F.lit(""))


def primary_label(obj: Column) -> Column:
    return F.coalesce(*(_get(obj, k) for k in PRIMARY_KEYS), F.lit(""))


def confidence(value: Column, fallback: Column) -> Column:
    """A number in 0..1; above 1 up to 100 it is a per cent; not a number is the fallback."""

    def clamped(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((x > 1) & (x <= 100), x / 100).otherwise(x)))

    return let(value.try_cast("double"), lambda x: F.when(x.isNull(), fallback).otherwise(clamped(x)))


def _items(text: Column) -> Column:
    """Elements of a JSON array as JSON texts; empty if it is none."""
    return F.coalesce(F.from_json(text, _TOP), F.array().cast(_TOP))


def candidate_names(obj: Column) -> Column:
    """Names in ``top_candidates`` (objects or strings), then those of the first other list given (array or separated text)."""

    def name(item: Column, keys: tuple[str, ...]) -> Column:
        return F.when(F.startswith(item, F.lit("{")), let(fields(item), lambda x: F.coalesce(*(_get(x, k) for k in keys)))).otherwise(item)

    top = F.transform(_items(obj["top_candidates"]), lambda x: name(x, TOP_KEYS))
    given = F.coalesce(*(F.nullif(_get(obj, k), F.lit("[]")) for k in LIST_KEYS), F.lit(""))
    listed = F.when(F.startswith(given, F.lit("[")), F.transform(_items(given), lambda x: name(x, ("folder_name", "category", "tag")))).otherwise(F.split(given, r"[\n,;|]+"))
    return F.filter(F.transform(F.concat(top, listed), lambda x: stripped(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def margin(obj: Column) -> Column:
    """Gap of the two best named candidates' confidences (.5 if not given); 1 with fewer than two."""
    said = F.transform(F.filter(_items(obj["top_candidates"]), lambda x: F.startswith(x, F.lit("{"))), fields)
    named = F.filter(said, lambda x: F.coalesce(_get(x, "folder_name"), _get(x, "primary_category"), _get(x, "category")).isNotNull())
    p = F.sort_array(F.transform(named, lambda x: confidence(x["confidence"], F.lit(0.5))), asc=False)
    return F.when(F.size(p) >= 2, F.get(p, F.lit(0)) - F.get(p, F.lit(1))).otherwise(F.lit(1.0))


def result(raw: Column, normalise: Callable[[Column], Column], review_confidence: float = REVIEW_CONFIDENCE, review_margin: float = REVIEW_MARGIN) -> Column:
    """Struct of category, candidates, confidence, reason, needs_review; plain text is an older format of fixed confidence."""

    def judged(x: Column) -> Column:
        obj, names, category = x["obj"], x["names"], x["category"]
        fallback = F.when(category != UNCATEGORIZED, F.lit(0.55)).otherwise(F.lit(0.0))
        sure = let(F.when(obj.isNull(), fallback).otherwise(confidence(obj["confidence"], fallback)), lambda c: c)
        told = F.coalesce(obj["needs_review"] == "true", F.lit(False))
        reason = F.when(obj.isNull(), F.lit("legacy_tag_output")).otherwise(F.substring(stripped(F.coalesce(*(_get(obj, k) for k in REASON_KEYS), F.lit(""))), 1, 240))
        doubt = let(sure, lambda c: (category == UNCATEGORIZED) | (c < review_confidence) | (obj.isNotNull() & (told | (F.round(margin(obj), 9) < review_margin))))
        return F.struct(category.alias("category"), names.alias("candidates"), sure.alias("confidence"), reason.alias("reason"), doubt.alias("needs_review"))

    def categorised(x: Column) -> Column:
        names = F.filter(x["normal"], lambda n: n != UNCATEGORIZED)
        first = F.get(x["normal"], F.lit(0))
        category = F.when(first != UNCATEGORIZED, first).otherwise(F.coalesce(F.get(names, F.lit(0)), F.lit(UNCATEGORIZED)))
        return F.struct(x["obj"].alias("obj"), F.array_distinct(names).alias("names"), category.alias("category"))

    def named(obj: Column) -> Column:
        said = F.when(obj.isNull(), F.array(F.coalesce(raw, F.lit("")))).otherwise(F.concat(F.array(primary_label(obj)), candidate_names(obj)))
        return F.struct(obj.alias("obj"), F.transform(said, normalise).alias("normal"))

    return let(let(let(fields(json_object(raw)), named), categorised), judged)
