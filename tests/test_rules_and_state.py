"""Rules, results, names and state against values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark import scratch
from shelfmark.functions import text
from shelfmark.operators import classify, naming, ranking, rules, similarity, state
from shelfmark.plans.presets import ClassifyOptions, classify_settings, duplicate_options


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert scratch.shared_dir(Session()).startswith("file:")


def dests(spark, plan, existing=None):
    frame = spark.createDataFrame(plan, "source string, dest_dir string, name string, sha256 string")
    there = spark.createDataFrame(existing, "dest_dir string, name string, sha256 string") if existing else None
    return {r.source: r.dest for r in naming.destinations(frame, there).collect()}


def test_no_two_files_have_one_destination(spark):
    plan = [("1", "d", "a.jpg", "A"), ("2", "d", "a.jpg", "B"), ("3", "d", "a_1.jpg", "C"), ("4", "e", "a.jpg", "B")]
    assert dests(spark, plan) == {"1": "d/a.jpg", "2": "d/a_2.jpg", "3": "d/a_1.jpg", "4": "e/a.jpg"}


def test_files_already_there_are_respected_and_reused(spark):
    there = [("d", "a.jpg", "X"), ("d", "a_1.jpg", "B"), ("d", "A_2.JPG", "Y")]
    plan = [("1", "d", "a.jpg", "A"), ("2", "d", "a.jpg", "B"), ("3", "d", "a.jpg", "X"), ("4", "d", "a.jpg", None), ("5", "d", "b", "A"), ("6", "d", "a.jpg", "A")]
    assert dests(spark, plan, there) == {"1": "d/a_3.jpg", "2": "d/a_1.jpg", "3": "d/a.jpg", "4": "d/a_4.jpg", "5": "d/b", "6": "d/a_3.jpg"}


def test_destinations_are_distinct_for_distinct_contents(spark):
    rng = random.Random(9)
    names = ["x", "x_1", "x_2", "x.jpg", "x_1.jpg", "X_1.jpg", "x_1_1.jpg", "x_10.jpg", ".x_1"]
    plan = [(str(i).zfill(4), rng.choice("de"), rng.choice(names), rng.choice([None, *"ABCDEF"])) for i in range(300)]
    there = [(d, n, rng.choice("ABXYZ")) for d in "de" for n in ("x.jpg", "x_3.jpg", "x_1_2.jpg", "x")]
    got = dests(spark, plan, there)
    owner = {f"{d}/{n}".lower(): c for d, n, c in there}
    for source, d, name, digest in plan:
        dest = got[source].lower()
        content = digest or source
        assert owner.setdefault(dest, content) == content
        assert dest.startswith(f"{d}/{name.lower().removesuffix('.jpg')}")


def test_a_tag_of_both_classes_is_spared_and_scores_that_stand_for_none_are_left_out(spark):
    tables = rules.RuleTables(class_a=("both", "n"), class_b=("both", "s"))
    frame = spark.createDataFrame([({"n": 0.3, "both": 0.5},), ({"n": 0.4, "s": 0.5},), ({"n": -2e9},)], "m map<string,double>")
    picked = frame.select(rules.pick_tag(F.col("m"), ("n", "both", "s"), tables).alias("p")).select("p.tag", "p.confidence").collect()
    assert [tuple(r) for r in picked] == [("both", 0.5), ("n", 0.4), ("uncategorized", 0.0)]


def test_results_follow_the_picked_tag(spark):
    o = ClassifyOptions(top_k=3, min_raw=0.2, threshold=0.5, min_margin=0.1, min_raw_margin=0.01)
    rows = [(1, "a", 0.9, 0.9, 0.0), (1, "b", 0.3, 0.3, 0.0), (2, "a", 0.1, 0.1, 0.0), (2, "b", 0.05, 0.05, 0.0), (3, "x", 0.9, 0.9, 0.0), (3, "b", 0.3, 0.2, 0.1), (4, "a", 0.9, 0.9, 0.0), (5, "x", 0.9, 0.9, 0.0)]
    sims = spark.createDataFrame(rows, "item long, tag string, sim double, text_sim double, delta double")
    probs = classify.top_k_softmax(sims, "item", "tag", o)
    failed = spark.createDataFrame([(4,)], "item long")
    got = {r.item: (r.category, r.candidates, r.needs_review, r.reason) for r in classify.results(probs, "item", "tag", o, ("a", "b"), apply_rules=False, failed=failed).collect()}
    assert got == {
        1: ("a", ["a", "b"], False, "clip raw=0.90 margin=0.60"),
        2: ("uncategorized", [], True, "clip_low_sim raw=0.10"),
        3: ("b", ["b"], False, "clip raw=0.90 margin=0.60"),  # decisive by its margins, whoever has them
        4: ("uncategorized", [], True, "clip_embed_failed"),
        5: ("uncategorized", [], True, "clip raw=0.90 margin=0.90"),
    }


def test_similarities_in_a_join_and_as_a_matrix_are_the_same(spark, monkeypatch):
    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(5)]
    items = spark.createDataFrame([(i, vec() if i else None) for i in range(9)], "item long, v array<float>")
    protos = spark.createDataFrame([(f"t{k % 3}", vec()) for k in range(7)], "tag string, p array<double>")
    shown = lambda d: sorted((r["item"], r["tag"], round(r["sim"], 9)) for r in d.where("sim is not null").collect())
    few = shown(classify.similarities(items, protos, "item", "v", "tag", "p"))
    assert len(few) == 8 * 3
    monkeypatch.setattr(classify, "SMALL_ROWS", 0)
    assert shown(classify.similarities(items, protos, "item", "v", "tag", "p")) == few
    assert classify.similarities(items, protos.limit(0), "item", "v", "tag", "p").count() == 0


def test_records_without_a_hash_are_not_paired(spark):
    rows = [(k, 100, 100, p, None, 0, None, None, f"p{k}") for k, p in enumerate([None, None, 0, 0b1111111])]
    frame = spark.createDataFrame(rows, "id long, width long, height long, phash long, dhash long, colorhash long, phash_frames array<long>, sha256 string, path string")
    got = [(r.id_a, r.id_b) for r in similarity.verification_pairs(frame, duplicate_options("deep")).collect()]
    assert got == [(2, 3)]


@pytest.mark.parametrize("bands", [None, 2, 3, 4, 6])
def test_pairs_do_not_depend_on_the_bands(spark, bands):
    rng = random.Random(5)
    hashes = [rng.getrandbits(24) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(hashes)), "k long, h long")
    got = {(r.key_a, r.key_b, r.distance) for r in similarity.hamming_pairs(frame, "k", "h", 5, bits=24, bands=bands).collect()}
    assert got == {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 5}


def test_more_hashes_ask_for_fewer_bands():
    chosen = [similarity.choose_bands(n, 60, 10) for n in (100, 10**5, 10**7, 10**10)]
    assert chosen == sorted(chosen, reverse=True) and chosen[-1] < chosen[0]


def test_filename_rules_in_french(spark):
    frame = spark.createDataFrame([("Capture d'écran 2024.png",), ("capture décran",), ("capture",)], "n string")
    found = frame.select(text.filename_heuristic(F.col("n"), F.lit(100), F.lit(100), ("screenshot",))["tag"]).collect()
    assert [r[0] for r in found] == ["screenshot", "screenshot", None]


def test_moving_files_need_frame_hashes_in_the_cache(spark):
    items = spark.createDataFrame([("a", 1, 2, True), ("b", 1, 2, True), ("c", 1, 2, False)], "path_norm string, mtime long, size long, multiframe boolean")
    cache = spark.createDataFrame([("a", 1, 2, 7, "x", 1, None), ("b", 1, 2, 7, "x", 1, [1, 2]), ("c", 1, 2, 7, "x", 1, None)], "path_norm string, mtime long, size long, sig_version int, sha256 string, phash long, phash_frames array<long>")
    assert {r.path_norm: r.hit for r in state.with_cache(items, cache, 7, exact=True, visual=True).collect()} == {"a": False, "b": True, "c": True}


def test_running_totals_and_medians_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 10 else rng.choice("xyz"), rng.randrange(50), i) for i in range(2000)] + [(None, 5, -1), (None, 6, -2)]
    frame = spark.createDataFrame(rows, "k string, v int, i long").repartition(6)
    got = {r.i: (r.k, r.n) for r in ranking.running(frame, ["k"], ["v", "i"], 1, "n").collect()}
    by_key = {}
    for k, v, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        by_key[k] = by_key.get(k, 0) + 1
        assert got[i] == (k, by_key[k])
    import statistics

    mids = {r.k: (r.mid, r.n) for r in ranking.medians(frame.where("k is not null"), "k", "v", "i").collect()}
    assert mids == {k: (statistics.median(v for kk, v, _ in rows if kk == k), by_key[k]) for k in by_key if k}


def test_given_settings_come_before_the_preset_within_their_limits():
    s = classify_settings({"quality": "fast", "batch_size": 4000, "min_margin": 0.0}, card=True, cpus=4)
    assert (s["model_name"], s["batch_size"], s["min_margin"], s["prefetch_workers"], s["top_k_softmax"]) == ("ViT-B-32", 512, 0.01, 4, 8)
    assert classify_settings({"quality": "none"})["quality"] == "ultra"
