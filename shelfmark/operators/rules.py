"""Re-weighting rules on tag scores, priorities and votes; every rule and class is a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCATEGORIZED = "uncategorized"
#: A score that stands for none.
NEVER = -1e9


@dataclass(frozen=True)
class RuleTables:
    """Ordered (generic, [specific...]) rules, tag classes by name, and specificity by tag."""

    specific: tuple[tuple[str, tuple[str, ...]], ...] = ()
    class_a: tuple[str, ...] = ()
    class_b: tuple[str, ...] = ()
    personal: tuple[str, ...] = ()
    generic_people: tuple[str, ...] = ()
    real: tuple[str, ...] = ()
    generated: tuple[str, ...] = ()
    specificity: tuple[tuple[str, int], ...] = ()


def _best(scores: Column, tags: tuple[str, ...]) -> Column:
    own = F.map_values(F.map_filter(scores, lambda k, _: k.isin(*tags)))
    return F.coalesce(F.array_max(own), F.lit(0.0)) if tags else F.lit(0.0)


def _scaled(scores: Column, tags: tuple[str, ...], by: float, when: Column) -> Column:
    return F.transform_values(scores, lambda k, v: F.when(when & k.isin(*tags), v * by).otherwise(v)) if tags else scores


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reweighted(scores: Column, t: RuleTables) -> Column:
    """The score map after all rules, in order; a later rule sees what earlier ones changed."""
    out = scores
    if t.specific:
        rules = F.array(*(F.struct(F.lit(g).alias("generic"), F.array(*map(F.lit, s)).alias("specific")) for g, s in t.specific))

        def apply(acc: Column, rule: Column) -> Column:
            def one(pair: Column) -> Column:
                held, generic, best = pair["m"], pair["generic"], pair["best"]
                strong = generic.isNotNull() & best.isNotNull() & (best >= 0.35 * generic) & (best >= 0.25 * F.array_max(F.map_values(held)))
                return F.transform_values(held, lambda k, v: F.when(strong & (k == rule["generic"]), F.least(v, 0.45 * best)).otherwise(v))

            best = F.array_max(F.map_values(F.map_filter(acc, lambda k, _: F.array_contains(rule["specific"], k))))
            return _let(F.struct(acc.alias("m"), F.try_element_at(acc, rule["generic"]).alias("generic"), best.alias("best")), one)

        out = F.aggregate(rules, out, apply)
    lesser = tuple(x for x in t.class_b if x not in t.class_a)  # a tag of both classes keeps its score
    out = _let(out, lambda m: _scaled(m, lesser, 0.5, (_best(m, t.class_a) >= 0.08) & (_best(m, t.class_a) >= 0.7 * _best(m, t.class_b))))
    out = _let(out, lambda m: _scaled(m, t.generic_people, 0.45, _best(m, t.personal) >= 0.20))

    def sides(m: Column) -> Column:
        real, made = _best(m, t.real), _best(m, t.generated)
        real_wins, made_wins = (real >= 0.12) & (real >= 1.05 * made), (made >= 0.12) & (made >= 1.05 * real)
        spared = tuple(x for x in t.real if x not in t.personal)
        return _let(_scaled(m, t.generated, 0.55, real_wins), lambda m2: _scaled(m2, spared, 0.55, made_wins & ~real_wins))

    return _let(out, sides)


def pick_tag(scores: Column, allowed: tuple[str, ...], t: RuleTables, apply_rules: bool = True, most: int = 5) -> Column:
    """Struct of tag, confidence and candidates (best first) of a map of scores; nothing allowed is uncategorized."""
    kept = F.map_filter(scores, lambda k, v: k.isin(*allowed) & (v > NEVER)) if allowed else F.map_filter(scores, lambda k, v: F.lit(False))
    weighed = reweighted(kept, t) if apply_rules else kept
    special = F.create_map(*(F.lit(x) for kv in t.specificity for x in kv)) if t.specificity else F.create_map().cast("map<string,int>")
    entries = F.transform(F.map_entries(weighed), lambda e: F.struct((-F.round(e["value"], 9)).alias("s"), (-F.coalesce(F.try_element_at(special, e["key"]), F.lit(1))).alias("p"), e["key"].alias("tag"), e["value"].alias("v")))
    none = F.struct(F.lit(UNCATEGORIZED).alias("tag"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("candidates"))
    best = _let(F.array_sort(entries), lambda es: F.when(F.size(es) == 0, none).otherwise(F.struct(F.get(es, F.lit(0))["tag"].alias("tag"), F.get(es, F.lit(0))["v"].alias("confidence"), F.filter(F.transform(F.slice(es, 1, most), lambda e: e["tag"]), lambda x: x != UNCATEGORIZED).alias("candidates"))))
    return best


def merge_by_priority(tags: DataFrame, item: str, tag: str, pos: str, priority: DataFrame) -> DataFrame:
    """(item, tag): the tag of least rank; one not ranked comes after all that are; ties to the first seen."""
    last = priority.agg(F.coalesce(F.max("rank") + 1, F.lit(0)).alias("last"))
    found = tags.join(F.broadcast(priority.withColumnRenamed("tag", tag)), tag, "left").crossJoin(F.broadcast(last))
    return found.groupBy(item).agg(F.min_by(tag, F.struct(F.coalesce("rank", "last"), F.col(pos))).alias(tag))


def frame_vote(frames: DataFrame, item: str, tag: str, confidence: str) -> DataFrame:
    """(item, tag, votes, confidence): most frames, then best confidence, then shorter, then by text."""
    counted = frames.where(F.col(tag) != UNCATEGORIZED).groupBy(item, tag).agg(F.count("*").alias("votes"), F.max(confidence).alias("confidence"))
    order = Window.partitionBy(item).orderBy(F.desc("votes"), F.desc("confidence"), F.length(tag), tag)
    return counted.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
