"""Normalising what a model said into a stable hierarchical label.

Every function maps columns to columns. Vocabularies are arguments, read from tables by
the caller; no label is built in but ``uncategorized``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCATEGORIZED = "uncategorized"
BLANKS = " \t\r\n\f\u000b"
_QUOTES = "`\"'"
# Label prefixes, prose words and filename words of the formats that are understood.
LABEL = r"(?is)^\s*(?:best_folder_name|primary_category|folder_name|category|tag|label|final(?:\s+tag)?|answer)\s*[:=-]\s*(.+?)\s*$"
PROSE = r"\b(?:because|contains|image|looks|photo|picture|shows|there|this|visible|would)\b"
FILENAME_RULES = (
    ("screenshot", 0.92, "filename_screenshot", r"(screenshot|screen[_-]?shot|screencap|capture d'?écran|снимок экрана|скрин)"),
    ("receipt_barcode", 0.90, "filename_receipt", r"(receipt|barcode|qr[_-]?code|чек|квитанц|invoice)"),
    ("document", 0.88, "filename_document", r"(scan|scanned|document|invoice|receipt|чек|квитанц|договор|contract)"),
)


@dataclass(frozen=True)
class Vocabulary:
    """The tables behind the normalisers: allowed tags, old names, and hints for free labels."""

    tags: tuple[str, ...]
    legacy: dict[str, str] = field(default_factory=dict)
    segment_aliases: dict[str, str] = field(default_factory=dict)
    weak: tuple[str, ...] = ()
    roots: tuple[str, ...] = ()
    presets: dict[str, str] = field(default_factory=dict)
    #: The user's own labels or segments, cleaned, and what they stand for.
    aliases: dict[str, str] = field(default_factory=dict)
    #: Root, words that say nothing below it, and the tag of the root without any other detail.
    special_roots: tuple[tuple[str, tuple[str, ...], str], ...] = ()


def _array(xs) -> Column:
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), key) if mapping else F.lit(None).cast("string")


def _first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return _first(F.transform(F.array(value), body))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def strip_reasoning(text: Column) -> Column:
    """Drop thinking blocks, closed or not, and channel markers; keep what follows a final marker; squeeze blank runs. Null is empty."""
    final = r"(?is)<\|channel\|>\s*final\b(.*)$"
    patterns = (r"(?is)<think>.*?</think>", r"(?is)<think>.*$", r"(?is)<\|channel\>\s*thought\b.*?<channel\|>", r"(?is)<\|channel\|>\s*(?:analysis|thought)\b.*?<\|channel\|>\s*final\b", r"(?im)^[ \t]*</think>[ \t]*$")

    def marked(t: Column) -> Column:
        t = let(t, lambda x: F.when(x.rlike(final), F.regexp_extract(x, final, 1)).otherwise(x))
        for pattern in patterns:
            t = F.regexp_replace(t, pattern, " ")
        return t

    def squeezed(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)

    # texts without a marker, which are most, meet no pattern
    clean = let(F.coalesce(text, F.lit("")), lambda t: F.when(F.contains(t, F.lit("<")), marked(t)).otherwise(t))
    return stripped(let(clean, squeezed))


def strip_label(text: Column) -> Column:
    """Without quotes, and without a prefix such as ``category:``."""
    bare = F.btrim(stripped(text), F.lit(_QUOTES))
    return let(bare, lambda b: F.when(b.rlike(LABEL), F.btrim(stripped(F.regexp_extract(b, LABEL, 1)), F.lit(_QUOTES))).otherwise(b))


def resolve(tag: Column, v: Vocabulary) -> Column:
    """The tag if allowed, else what its old name leads to in at most two steps, else null."""

    def one(t: Column) -> Column:
        once = F.coalesce(_lookup(v.legacy, t), t)
        twice = F.coalesce(_lookup(v.legacy, once), once)
        return F.when(F.array_contains(_array(v.tags), t), t).when(F.array_contains(_array(v.tags), twice), twice)

    return let(tag, one)


def _source(raw: Column) -> Column:
    return let(strip_reasoning(raw), lambda clean: F.when(clean != "", clean).otherwise(raw))


def lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: stripped(x) != "")


def _exact(source: Column, v: Vocabulary) -> Column:
    def one(source: Column) -> Column:
        labels = F.transform(lines(source), lambda x: F.lower(strip_label(x)))
        edges = let(labels, lambda xs: F.coalesce(resolve(_first(xs), v), resolve(F.try_element_at(xs, F.lit(-1)), v)))
        return F.coalesce(resolve(F.lower(strip_label(source)), v), edges)

    return one(source)


def exact_or_null(raw: Column, v: Vocabulary) -> Column:
    """An allowed tag that is the whole text, its first line or its last one; else null."""
    return let(_source(raw), lambda source: _exact(source, v))


def normalise_exact(raw: Column, v: Vocabulary) -> Column:
    return F.coalesce(exact_or_null(raw, v), F.lit(UNCATEGORIZED))


def normalise(raw: Column, v: Vocabulary) -> Column:
    """As normalise_exact, else the longest allowed tag inside the text (ties by name)."""
    by_length = _array(sorted(v.tags, key=lambda t: (-len(t), t)))
    inside = lambda source: let(F.lower(source), lambda whole: _first(F.filter(by_length, lambda t: F.contains(whole, t))))
    found = let(_source(raw), lambda source: F.coalesce(_exact(source, v), inside(source)))
    return F.coalesce(F.when(raw != "", found), F.lit(UNCATEGORIZED))


def _segment(seg: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(stripped(seg), r"[\s\-]+", "_"), "_+", "_"), F.lit("_"))


def hierarchical(raw: Column, v: Vocabulary) -> Column:
    """A safe path of at most 4 segments of at most 32 characters, 128 in all; ``uncategorized`` if nothing is left."""
    t = let(strip_label(strip_reasoning(raw)), lambda x: F.lower(stripped(F.when(x != "", x).otherwise(strip_label(raw)))))
    t = F.regexp_replace(F.translate(t, "`", " "), r"[^a-z0-9_/\-\s]+", " ")
    parts = F.filter(F.transform(F.split(t, "/"), _segment), lambda s: s != "")
    path = F.array_join(F.transform(F.slice(parts, 1, 4), lambda s: F.substring(s, 1, 32)), "/")

    def named(out: Column) -> Column:
        return F.when(F.coalesce(out, F.lit("")) == "", F.lit(UNCATEGORIZED)).when(F.array_contains(_array(v.tags), out), F.coalesce(resolve(out, v), out)).otherwise(F.btrim(F.substring(out, 1, 128), F.lit("/")))

    return let(path, named)


def looks_like_tag(text: Column) -> Column:
    """Short, without brackets, and not bare prose."""
    return let(F.lower(strip_label(text)), _shaped)


def _shaped(t: Column) -> Column:
    separated = t.rlike(r"[/_\-]")
    return (t != "") & (F.length(t) <= 160) & ~t.rlike(r"[{}\[\]:]") & (separated | ~F.contains(t, F.lit(" "))) & (separated | ~t.rlike(PROSE)) & t.rlike("[a-z0-9]")


def auto_segment(seg: Column, v: Vocabulary, own: bool = True) -> Column:
    """One segment by the user's alias (its first segment), by its alias, or in the singular."""

    def one(s: Column) -> Column:
        y = F.concat(F.substring(s, F.lit(1), F.length(s) - 3), F.lit("y"))
        singular = F.substring(s, F.lit(1), F.length(s) - 1)
        plain = (
            F.when(_lookup(v.segment_aliases, s).isNotNull(), _lookup(v.segment_aliases, s))
            .when((F.length(s) > 4) & s.endswith("ies"), F.coalesce(_lookup(v.segment_aliases, y), y))
            .when((F.length(s) > 3) & s.endswith("s") & ~s.endswith("ss"), F.coalesce(_lookup(v.segment_aliases, singular), singular))
            .otherwise(s)
        )
        if not (own and v.aliases):
            return plain
        named = let(_lookup(v.aliases, s), lambda x: F.when(x.isNotNull(), F.nullif(hierarchical(x, v), F.lit(UNCATEGORIZED))))
        return F.coalesce(F.substring_index(named, "/", 1), plain)

    return let(_segment(F.lower(seg)), one)


def auto_label(raw: Column, v: Vocabulary) -> Column:
    """At most two levels: a known root first, weak words dropped, synonyms merged; the user's alias of the whole label comes before its segments."""

    def joined(root: Column, details: Column) -> Column:
        out = let(_first(details), lambda d: F.when(d.isNull(), F.coalesce(_lookup(v.presets, root), root)).otherwise(F.concat_ws("/", root, d)))
        for name, idle, tag in v.special_roots:
            some = let(_first(F.filter(details, lambda d: ~F.array_contains(_array(idle), d))), lambda d: F.when(d.isNull(), F.lit(tag)).otherwise(F.concat_ws("/", root, d)))
            out = F.when(root == name, some).otherwise(out)
        return out

    def compact(segments: Column) -> Column:
        root = F.coalesce(_first(F.filter(segments, lambda s: F.array_contains(_array(v.roots), s))), _first(segments))
        label = let(root, lambda r: joined(r, F.filter(segments, lambda s: s != r)))
        named = let(label, lambda out: F.when(F.array_contains(_array(v.tags), out), F.coalesce(resolve(out, v), out)).otherwise(F.btrim(F.substring(out, 1, 96), F.lit("/"))))
        return F.when(F.size(segments) == 0, F.lit(UNCATEGORIZED)).otherwise(named)

    def one(safe: Column, own: bool) -> Column:
        segments = F.flatten(F.transform(F.split(safe, "/"), lambda s: F.split(auto_segment(s, v, own), "/")))
        kept = F.array_distinct(F.filter(segments, lambda s: (s != "") & ~F.array_contains(_array(v.weak), s)))
        return F.when((safe == UNCATEGORIZED) | F.array_contains(_array(v.tags), safe), F.coalesce(resolve(safe, v), safe)).otherwise(let(kept, compact))

    def aliased(safe: Column) -> Column:
        whole = let(_lookup(v.aliases, safe), lambda x: F.when(x.isNotNull(), F.nullif(hierarchical(x, v), F.lit(UNCATEGORIZED))))
        meant = F.when(~F.array_contains(_array(v.tags), safe), whole)
        return let(meant, lambda m: F.when(m.isNotNull(), one(m, False)).otherwise(one(safe, True)))

    return let(hierarchical(raw, v), aliased if v.aliases else lambda safe: one(safe, True))


def normalise_free(raw: Column, v: Vocabulary) -> Column:
    """An allowed tag, else the last line shaped like one; prose alone is uncategorized."""

    def last(rows: Column) -> Column:
        shaped = F.transform(F.filter(F.reverse(rows), looks_like_tag), lambda x: hierarchical(strip_label(x), v))
        return F.coalesce(_first(F.filter(shaped, lambda x: x != UNCATEGORIZED)), F.when(F.size(rows) > 0, F.lit(UNCATEGORIZED)))

    return F.coalesce(exact_or_null(raw, v), let(lines(strip_reasoning(raw)), last), hierarchical(raw, v))


def vote_candidates(raw: Column, v: Vocabulary) -> Column:
    """The labels of the parts of a text that are shaped like one, in order."""
    chunks = F.filter(F.split(F.lower(strip_reasoning(raw)), r"[\n,;|]+"), looks_like_tag)
    return F.filter(F.transform(chunks, lambda c: auto_label(c, v)), lambda t: t != UNCATEGORIZED)


def most_voted(candidates: Column) -> Column:
    """The most frequent element; ties by first place, then length, then text."""

    def rank(all_of: Column) -> Column:
        return F.transform(F.array_distinct(all_of), lambda t: F.struct((-F.size(F.filter(all_of, lambda x: x == t))).alias("n"), F.array_position(all_of, t).alias("first"), F.length(t).alias("size"), t.alias("tag")))

    return let(candidates, lambda xs: F.array_min(rank(xs)))["tag"]


def normalise_auto(raw: Column, v: Vocabulary) -> Column:
    """An allowed tag, else the most voted candidate, else the whole text as a label."""
    winner = most_voted(vote_candidates(raw, v))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(UNCATEGORIZED)).otherwise(F.coalesce(exact_or_null(raw, v), winner, auto_label(F.lower(strip_reasoning(raw)), v)))


def clean_alias(raw: Column) -> Column:
    """An alias path: parts of at most 96 characters, 128 in all."""
    part = lambda p: F.substring(F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(stripped(p)), r"[^a-z0-9_/\-\s]+", " "), r"[\s\-]+", "_"), "_+", "_"), F.lit("_/")), 1, 96)
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "/"), part), lambda p: p != "")
    return F.btrim(F.substring(F.array_join(parts, "/"), 1, 128), F.lit("/"))


def prompts(tag: Column, description: Column) -> Column:
    """Text prompts of a tag; a long description is cut to 217 characters and dots; repeats (case aside) go."""
    label = F.coalesce(F.nullif(stripped(F.translate(tag, "_", " ")), F.lit("")), tag)
    squeezed = stripped(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " "))
    d = F.when(F.length(squeezed) > 220, F.concat(F.rtrim(F.substring(squeezed, 1, 217)), F.lit("..."))).otherwise(squeezed)
    photo = F.concat(F.lit("a photo of "), label)
    described = F.array(F.concat(photo, F.lit(".")), F.concat(photo, F.lit(", "), d), F.concat(F.lit("an image showing "), d), F.concat(F.lit("a picture of "), d), d)
    plain = F.array(F.concat(photo, F.lit(".")), F.concat(F.lit("a clear, well-lit photo of "), label, F.lit(".")), F.concat(F.lit("a picture of "), label, F.lit(".")))
    chosen = F.when(d != "", described).otherwise(plain)
    start = F.array().cast("array<string>")
    return F.aggregate(chosen, start, lambda acc, p: F.when(F.array_contains(F.transform(acc, F.lower), F.lower(p)), acc).otherwise(F.array_append(acc, p)))


def filename_heuristic(name: Column, width: Column, height: Column, tags: tuple[str, ...]) -> Column:
    """(tag, confidence, reason) of the first filename rule that fits and whose tag is allowed; null below 8 x 8 pixels."""
    out = F.lit(None).cast("struct<tag:string,confidence:double,reason:string>")
    for tag, confidence, reason, pattern in reversed(FILENAME_RULES):
        if tag in tags:
            out = F.when(name.rlike(f"(?iu){pattern}"), F.struct(F.lit(tag).alias("tag"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))).otherwise(out)
    return F.when((width >= 8) & (height >= 8), out)


def api_base(url: Column) -> Column:
    """Without trailing slashes and an ending /v1 or /api/v1."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(stripped(url), "/+$", ""), "(/api)?/v1$", ""))


def yes_or_no(reply: Column) -> Column:
    """True if the first word starts with Y; else false, an empty reply too."""
    return F.startswith(F.upper(_first(F.split(stripped(strip_reasoning(reply)), r"\s+"))), F.lit("Y"))
