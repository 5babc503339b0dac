"""Scalar functions, rules, state, sources and sinks on small cases."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import geometry, hashing, replies, text, vectors
from shelfmark.operators import classify as C
from shelfmark.operators import naming as N
from shelfmark.operators import rules as R
from shelfmark.operators import state as S
from shelfmark.sources import providers, scan, sinks

V = text.Vocabulary(tags=("dog", "wild_cat", "landscape"), legacy={"hound": "old_dog", "old_dog": "dog"}, segment_aliases={"kitten": "cat"}, weak=("photo",), roots=("nature",), presets={"nature": "landscape"})


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("dog", "dog"), ("<think>x</think>\nDog", "dog"), ("<think>never closed dog", "dog"), ("prose\nTag: `hound`", "dog"), ("a wild_cat here", "wild_cat"), ("nothing", "uncategorized"), ("", "uncategorized"), (None, "uncategorized"), ("<|channel|>analysis x <|channel|>final wild_cat", "wild_cat")],
)
def test_normalise(spark, raw, wanted):
    assert one(spark, text.normalise(F.col("raw"), V), raw=raw) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [("A b / c--d /e/f/g", "a_b/c_d/e/f"), ("###", "uncategorized"), ("x" * 50, "x" * 32), ("", "uncategorized"), (None, "uncategorized")])
def test_hierarchical(spark, raw, wanted):
    assert one(spark, text.hierarchical(F.col("raw"), V), raw=raw) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [("kittens, dogs/a, kittens", "cat"), ("photos/nature", "landscape"), ("birds/nature/owls", "nature/bird"), ("", "uncategorized")])
def test_auto(spark, raw, wanted):
    assert one(spark, text.normalise_auto(F.col("raw"), V), raw=raw) == wanted


def test_reply_review_by_margin_and_percent(spark):
    near = '{"category":"dog","confidence":90,"top_candidates":[{"category":"dog","confidence":0.5},{"category":"wild_cat","confidence":0.45}]}'
    r = one(spark, replies.result(F.col("raw"), lambda c: text.normalise(c, V)), raw=near)
    assert (r.category, r.confidence, r.needs_review, r.candidates) == ("dog", 0.9, True, ["dog", "wild_cat"])
    plain = one(spark, replies.result(F.col("raw"), lambda c: text.normalise(c, V)), raw="dog")
    assert (plain.category, plain.confidence, plain.needs_review, plain.reason) == ("dog", 0.55, False, "legacy_tag_output")
    none = one(spark, replies.result(F.col("raw"), lambda c: text.normalise(c, V)), raw=None)
    assert (none.category, none.needs_review) == ("uncategorized", True)


def test_hashes(spark):
    assert one(spark, hashing.from_hex(F.col("h")), h="ffffffffffffffff") == -1
    assert one(spark, hashing.from_hex(F.col("h")), h="xyz") is None
    assert one(spark, hashing.hamming(F.lit(None).cast("long"), F.lit(1).cast("long")), h="") == 9999
    assert one(spark, hashing.dimension_block(F.col("w")), w=0) == -1


def test_mean_min_distance(spark):
    a, b = F.array(F.lit(0), F.lit(-1)).cast("array<bigint>"), F.array(F.lit(-1), F.lit(0)).cast("array<bigint>")
    assert one(spark, vectors.mean_min_distance(a, b), x="") == 0.0
    assert one(spark, vectors.mean_min_distance(a, F.lit(None).cast("array<bigint>")), x="") == 999.0


@pytest.mark.parametrize(("d", "k", "wanted"), [(100.0, 3, [0.0, 50.0, 99.999]), (10.0, 1, [0.0]), (0.0, 3, [0.0, 0.0, 0.0]), (8.0, 5, [0.0, 2.0, 4.0, 6.0, 7.999]), (5.0, 0, [])])
def test_sample_times(spark, d, k, wanted):
    assert one(spark, geometry.sample_times(F.col("d"), F.col("k")), d=d, k=k) == pytest.approx(wanted)


MERGES = [("dog", 0.72, False, "clip", "uncategorized", 0.5, "clip"), ("dog", 0.80, True, "clip", "cat", 0.60, "clip"), ("dog", 0.40, True, "clip", "cat", 0.92, "vlm"), ("dog", 0.62, True, "clip", "cat", 0.75, "clip"), ("x", 0.48, True, "clip", "y", 0.55, "clip"), ("uncategorized", 0.08, True, "clip_low_sim", "z", 0.72, "vlm")]


def test_merge_truth_table(spark):
    frame = spark.createDataFrame(MERGES, "cc string, cf double, cr boolean, why string, vc string, vf double, wanted string")
    assert frame.where(C.merged_choice(*(F.col(c) for c in ("cc", "cf", "cr", "why", "vc", "vf")), 0.55) != F.col("wanted")).count() == 0


T = R.RuleTables(specific=(("generic", ("special",)),), class_a=("a",), class_b=("b",), personal=("me",), generic_people=("person",), real=("real",), generated=("made",), specificity=(("special", 2),))
TAGS = ("generic", "special", "a", "b", "me", "person", "real", "made")


@pytest.mark.parametrize(
    ("scores", "rules", "wanted"),
    [({"generic": 0.5, "special": 0.3}, True, "special"), ({"generic": 1.0, "special": 0.3}, True, "generic"), ({"b": 0.5, "a": 0.4}, True, "a"), ({"b": 0.5, "a": 0.1}, True, "b"), ({"person": 0.5, "me": 0.25}, True, "me"), ({"real": 0.5, "made": 0.4}, True, "real"), ({"real": 0.4, "made": 0.5}, True, "made"), ({"a": 0.4, "special": 0.4}, True, "special"), ({"generic": 0.5, "special": 0.3}, False, "generic"), ({"zzz": 1.0}, True, "uncategorized")],
)
def test_pick_tag(spark, scores, rules, wanted):
    frame = spark.createDataFrame([(scores,)], "s map<string,double>")
    assert frame.select(R.pick_tag(F.col("s"), TAGS, T, rules).alias("x")).first()["x"]["tag"] == wanted


def test_state_machine(spark):
    files = spark.createDataFrame([("a", "processed", "dog", 2), ("b", "processed", "cat", 1), ("c", "pending", None, 1)], "sha256 string, status string, category string, pipeline_version int")
    seen = spark.createDataFrame([("a",), ("b",), ("d",), ("d",)], "sha256 string")
    got = {r.sha256: (r.status, r.category, r.pipeline_version, r.action) for r in S.upsert_files(files, seen, 2).collect()}
    assert got == {"a": ("processed", "dog", 2, "skip"), "b": ("pending", None, 2, "process"), "c": ("pending", None, 1, None), "d": ("pending", None, 2, "process")}


def test_merge_keeps_grows_and_handles_null_keys(spark):
    old = spark.createDataFrame([("k", 1, "s"), (None, 2, "t")], "k string, v int, started string")
    new = spark.createDataFrame([(None, 5, "u", True)], "k string, v int, started string, extra boolean")
    got = {tuple(r) for r in S.merge(old, new, ["k"], keep_old=("started",)).collect()}
    assert got == {("k", 1, "s", None), (None, 5, "t", True)}


def test_destinations(spark):
    rows = [("s/1", "d", "a.jpg", "x"), ("s/2", "d", "a.jpg", "y"), ("s/3", "d", "A.jpg", "x"), ("s/4", "d", "a.jpg", None), ("s/5", "d", "b", "z")]
    got = {r.source: r.dest for r in N.destinations(spark.createDataFrame(rows, "source string, dest_dir string, name string, sha256 string")).collect()}
    assert got == {"s/1": "d/a.jpg", "s/2": "d/a_1.jpg", "s/3": "d/A.jpg", "s/4": "d/a_2.jpg", "s/5": "d/b"}


def test_scan_modes_and_output_folder(spark, tmp_path):
    for name in ("x.JPG", "sub/y.mp4", "sub/z.gif", "out/w.png", "note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    names = lambda **k: [r.path.rsplit("/", 1)[1] for r in scan.media_files(spark, str(tmp_path), **k).collect()]
    assert names() == ["w.png", "y.mp4", "z.gif", "x.JPG"]
    assert names(mode="photos_only", exclude=str(tmp_path / "out")) == ["x.JPG"]
    assert scan.media_files(spark, str(tmp_path / "none")).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", "y" * 5000)], "path string, raw_output string")
    sinks.review_manifest(rows, str(tmp_path / "m"))
    sinks.review_manifest(rows, str(tmp_path / "m"))
    assert [len(r.raw_output) for r in spark.read.json(str(tmp_path / "m")).collect()] == [4000, 4000]
    sinks.export_run(rows, rows.union(rows), str(tmp_path / "run"), session_key="k")
    assert spark.read.json(str(tmp_path / "run/meta")).first().asDict() == {"session_key": "k", "groups_count": 1, "records_count": 2}


def test_first_success(spark):
    rows = spark.createDataFrame([(1, 1, "uncategorized"), (1, 2, "dog"), (1, 3, "cat"), (2, 1, "uncategorized")], "item int, attempt int, category string")
    assert {(r.item, r.category) for r in providers.first_success(rows, "item", "attempt", "category").collect()} == {(1, "dog"), (2, "uncategorized")}
