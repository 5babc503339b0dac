"""Settings, paths and messages in columns: values as they are stored, cleaned and shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.endpoints import valid_model_id
from shelfmark.functions.hashing import from_hex
from shelfmark.functions.text import clean_alias, let, stripped

DEFAULT_MODEL = "local-model"
# Seconds before another try, and their cap.
RETRY_S, RETRY_CAP_S, RELOAD_CAP_S, CHANNEL_S = (1.5, 3.0, 5.0, 8.0), 8.0, 12.0, 0.5


def unquoted(value: Column) -> Column:
    """Without blanks at its ends, and without one pair of equal quotes around it."""
    return let(stripped(value), lambda v: F.when((F.length(v) >= 2) & (F.left(v, F.lit(1)) == F.right(v, F.lit(1))) & F.left(v, F.lit(1)).isin("'", '"'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))


def clamped_number(raw: Column, low: float, high: float, default: float, whole: bool = False) -> Column:
    """A number within its limits; the default where there is none. Whole numbers lose their fraction."""
    number = F.coalesce(raw.try_cast("double"), F.lit(float(default)))
    number = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)) if whole else number
    out = F.greatest(F.lit(low), F.least(F.lit(high), number))
    return out.cast("long") if whole else out.cast("double")


def eta_words(seconds: Column) -> Column:
    """Seconds below a minute, else minutes, else hours and minutes."""
    s = F.greatest(F.lit(0.0), seconds.cast("double"))
    minutes = F.floor(s / 60)
    hours = F.format_string("%d h %02d min", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)))
    return F.when(s < 60, F.format_string("%d s", F.bround(s).cast("long"))).when(minutes < 60, F.format_string("%d min", minutes)).otherwise(hours)


def eta_about(seconds: Column) -> Column:
    """About how long: the two greatest units; a dash where nothing is left."""
    s = F.bround(seconds.cast("double")).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(seconds <= 0, "—").when(h > 0, F.format_string("~%d h %d min", h, m)).when(m > 0, F.format_string("~%d min %d s", m, rest)).otherwise(F.format_string("~%d s", rest))


def alias_lines(aliases: Column) -> Column:
    """A map of aliases as text, cleaned and in order; empty without any."""
    cleaned = F.transform(F.map_entries(aliases), lambda e: F.struct(clean_alias(e["key"]).alias("k"), clean_alias(e["value"]).alias("v")))
    rules = F.array_sort(F.filter(cleaned, lambda e: (e["k"] != "") & (e["v"] != "") & (e["k"] != e["v"])))
    shown = F.transform(rules, lambda e: F.concat(F.lit("- "), e["k"], F.lit(" => "), e["v"]))
    head = F.lit("Category alias rules (apply before creating new folders):\n")
    return let(shown, lambda xs: F.when(F.size(xs) > 0, F.concat(head, F.array_join(xs, "\n"))).otherwise(""))


def session_category(mode: Column, profile: Column) -> Column:
    """The mode as a session stores it; a preset with its profile."""
    return F.when(mode == "preset", F.concat(F.lit("preset_"), profile)).otherwise(mode)


def normalised_path(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` segments, ``..`` resolved as far as there is something before it."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    rooted = F.startswith(F.translate(path, "\\", "/"), F.lit("/"))
    empty = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        up = F.when((F.size(acc) > 0) & (last != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(rooted, acc).otherwise(F.array_append(acc, p))
        return F.when(p == "..", up).otherwise(F.array_append(acc, p))

    joined = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)


def same_path(a: Column, b: Column, fold_case: bool = False) -> Column:
    x, y = normalised_path(a), normalised_path(b)
    return F.lower(x) == F.lower(y) if fold_case else x == y


def frame_hashes(json: Column) -> Column:
    """Hashes of a JSON list of two or more hex texts; null for anything else."""
    hashes = F.transform(F.from_json(json, "array<string>"), from_hex)
    return let(hashes, lambda xs: F.when((F.size(xs) >= 2) & F.forall(xs, lambda x: x.isNotNull()), xs))


def resized(width: Column, height: Column, most: int) -> Column:
    """(width, height) with the longer side at most ``most`` (64 at least), halves rounded to even, 1 at least."""
    side = float(max(64, most))
    longer = F.greatest(width, height)
    scale = F.lit(side) / longer.cast("double")
    fit = lambda x: F.when(longer > side, F.greatest(F.lit(1), F.bround(x * scale))).otherwise(x).cast("long")
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def retry_delay(attempt: Column, reloading: Column, channel: Column, jitter: Column) -> Column:
    """Seconds before the try after ``attempt`` (from 1): long while a model reloads, short after the first channel error, else by the table, spread by ``jitter`` in 0..1."""
    base = F.element_at(F.array(*map(F.lit, RETRY_S)), F.least(attempt, F.lit(len(RETRY_S))).cast("int"))
    spread = F.least(F.lit(RETRY_CAP_S), F.greatest(F.lit(0.1), base * (0.75 + 0.5 * jitter)))
    return F.when(reloading, F.least(F.lit(RELOAD_CAP_S), 3.0 + 2.0 * attempt)).when(channel, CHANNEL_S).otherwise(spread)


def chosen_model(manual: Column, listed: Column, profile: Column, saved: Column, default: str = DEFAULT_MODEL) -> Column:
    """The model to use: a listed choice (a manual one that isn't the default before it), then manual, profile (unless default), saved, profile, default."""
    clean = [stripped(F.coalesce(c, F.lit(""))) for c in (manual, listed, profile, saved)]
    m, c, p, s = (F.when(valid_model_id(x), x) for x in clean)
    own = lambda x: F.when(x != default, x)
    return F.when(c.isNotNull(), F.coalesce(own(m), c)).otherwise(F.coalesce(m, own(p), s, p, F.lit(default)))


def embedding_key(settings: Column) -> Column:
    """Key of cached embeddings: model and every knob that changes them. ``settings`` is a struct of ClassifySettings' fields."""
    crops = F.when(settings["multi_crop"], settings["multi_crop_views"]).otherwise(1)
    flag = lambda name: settings[name].cast("int")
    return F.format_string(
        "%s|%s|%s|fp16=%d|side=%d|crops=%d|tf=%.2f|tpmax=%d|cpool=%d|topk=%d|ex=%.2f:%.2f:%.2f",
        settings["model_name"], settings["pretrained"], settings["device"], flag("use_fp16"), settings["image_max_side"], crops, settings["text_prompt_fusion"],
        flag("text_prompt_max_pool"), flag("crop_score_max_pool"), settings["top_k_softmax"], settings["min_exemplar_similarity"], settings["exemplar_max_delta"], settings["exemplar_boost"],
    )


def fingerprint(*parts: Column) -> Column:
    """24 hex digits that change when any part does."""
    return F.substring(F.sha2(F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts)))), 256), 1, 24)


def system_prompt(header: Column, rule: Column, definitions: Column, context: Column, extra: Column, title: str = "Definitions (tag: meaning):") -> Column:
    """Header, output rule, definitions (array of lines), the user's context and extra settings as one text."""
    told = F.when(stripped(context) != "", F.concat(F.lit("User context for recognition (match these descriptions to identify personal subjects):\n"), context))
    said = F.coalesce(told, F.lit("User context: not provided. Use only visual content for classification."))
    more = F.when(stripped(extra) != "", F.array(F.lit(""), F.lit("Extra prompt settings:"), stripped(extra))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(header, rule, F.lit(""), F.lit(title)), definitions, F.array(F.lit(""), said), more), "\n")


def context_line(key: Column, description: Column) -> Column:
    """``key: description`` of a tag that has one, else null."""
    return F.when(stripped(F.coalesce(description, F.lit(""))) != "", F.concat(key, F.lit(": "), stripped(description)))
