"""Truth tables of the duplicate finder, and its joins against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import groups as G
from shelfmark.operators import similarity as S
from shelfmark.operators.components import connected_components
from shelfmark.plans.presets import duplicate_options

RECORD = "id long, path string, path_norm string, size long, mtime long, width int, height int, sha256 string, phash long, dhash long, colorhash long, phash_frames array<long>"


def record(i, sha=None, phash=None, dhash=None, frames=None, w=80, h=60, size=10, mtime=5, path=None):
    path = path or f"p/{i}.jpg"
    return (i, path, path.lower(), size, mtime, w, h, sha, phash, dhash, None, frames)


def groups(spark, rows, **options):
    o = duplicate_options("balanced", **options)
    return [(r.paths, r.suggested_keep, r.is_exact) for r in G.duplicate_groups(spark.createDataFrame(rows, RECORD), o, bits=64).collect()]


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b and a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], None])
def test_components(spark, edges):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] if edges is None else edges
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute_components(edges)


@pytest.mark.parametrize(("radius", "bits", "bands"), [(0, 60, 4), (3, 60, 4), (10, 60, 4), (1, 12, 2), (7, 64, 4)])
def test_banded_join_is_brute_force(spark, radius, bits, bands):
    rng = random.Random(radius)
    base = [rng.getrandbits(bits) for _ in range(12)]
    hashes = [base[i % 12] ^ sum(1 << b for b in rng.sample(range(bits), rng.randrange(0, min(bits, radius + 3)))) for i in range(90)]
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in hashes]
    rows = [(i, h, i % 2) for i, h in enumerate(signed)] + [(990, None, 0)]
    got = S.hamming_pairs(spark.createDataFrame(rows, "k long, h long, b int"), "k", "h", radius, bits, ("b",), bands).collect()
    wanted = {(i, j): bin(hashes[i] ^ hashes[j]).count("1") for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2 and bin(hashes[i] ^ hashes[j]).count("1") <= radius}
    assert len(got) == len(wanted)
    assert {(r.key_a, r.key_b): r.distance for r in got} == wanted


def test_exact_pair_and_unhashed(spark):
    assert groups(spark, [record(1, "x"), record(2, "x"), record(3, "y")], perceptual=False) == [(["p/1.jpg", "p/2.jpg"], "p/1.jpg", True)]
    assert groups(spark, [record(1, "x"), record(2, "y"), record(3, None), record(4, None)]) == []


def test_radius_one_and_dhash(spark):
    near = [record(1, phash=0, dhash=0), record(2, phash=1, dhash=0)]
    assert len(groups(spark, near, phash_radius=1)) == 1
    assert groups(spark, near, phash_radius=0) == []
    assert groups(spark, [record(1, phash=0, dhash=0), record(2, phash=1, dhash=(1 << 20) - 1)], phash_radius=1) == []


def test_shifted_frames_match(spark):
    rows = [record(1, frames=[0, -1], phash=0, w=1280, h=720), record(2, frames=[-1, 0], phash=-1, w=1280, h=720)]
    assert [g[0] for g in groups(spark, rows, frame_mean=1.0, phash_radius=4)] == [["p/1.jpg", "p/2.jpg"]]


def test_chain_is_one_group_and_one_digest_with_null_is_exact(spark):
    rows = [record(1, "x", phash=0), record(2, None, phash=0b11), record(3, None, phash=0b1111)]
    assert groups(spark, rows, phash_radius=2) == [(["p/1.jpg", "p/2.jpg", "p/3.jpg"], "p/1.jpg", True)]


def test_unknown_width_is_a_block_of_its_own(spark):
    assert groups(spark, [record(1, phash=5, w=None), record(2, phash=5, w=80)]) == []
    assert len(groups(spark, [record(1, phash=5, w=None), record(2, phash=5, w=0)])) == 1


def test_keep_policies_and_ties(spark):
    rows = [record(1, "x", size=5, mtime=9, w=10, path="b"), record(2, "x", size=9, mtime=1, w=10, path="A"), record(3, "x", size=9, mtime=1, w=10, path="c")]
    keep = {p: groups(spark, rows, perceptual=False, keep=p)[0][1] for p in G.POLICIES}
    assert keep == {"largest_pixels": "A", "newest_mtime": "b", "largest_file": "A"}


def test_decisions_fresh_wins_whatever_the_order(spark):
    old = spark.createDataFrame([("a", "b", True), ("c", "d", True)], "path_a string, path_b string, same boolean")
    new = spark.createDataFrame([("b", "a", False)], "path_a string, path_b string, same boolean")
    assert {tuple(r) for r in G.merge_decisions(old, new).collect()} == {("a", "b", False), ("c", "d", True)}


def test_size_filter_prunes_columns(spark, tmp_path):
    spark.range(10).select((F.col("id") % 4).alias("size"), F.col("id").alias("path"), F.lit("x").alias("content")).write.parquet(str(tmp_path / "t"))
    plan = G.size_candidates(spark.read.parquet(str(tmp_path / "t"))).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def shuffled_rows(frame):
    """Rows that the exchanges of a collected frame's plan wrote."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(k)) for k in range(node.children().size()))

    return walk(frame._jdf.queryExecution().executedPlan())


def test_probed_values_are_not_shuffled(spark):
    rng = random.Random(8)
    hashes = [rng.getrandbits(60) for _ in range(300)]
    hashes += [h ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for h in hashes[:40]]
    rows = [(i, h, 0) for i, h in enumerate(hashes)]
    found = S.hamming_pairs(spark.createDataFrame(rows, "k long, h long, b int"), "k", "h", 10, 60, ("b",))
    got = {(r.key_a, r.key_b, r.distance) for r in found.collect()}
    assert got == {(i, j, d) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (d := (a ^ b).bit_count()) <= 10}
    assert shuffled_rows(found) <= 2 * len(hashes)


@pytest.mark.parametrize("bands", [None, 3])
def test_parts_of_a_block_meet_once(spark, monkeypatch, bands):
    rng = random.Random(9)
    hashes = [rng.getrandbits(24) for _ in range(200)]
    rows = [(i, h, "xyz"[i % 3] if i % 7 else None) for i, h in enumerate(hashes)]
    monkeypatch.setattr(S, "PART", 4)
    found = S.hamming_pairs(spark.createDataFrame(rows, "k long, h long, b string"), "k", "h", 6, 24, ("b",), bands).collect()
    wanted = [(i, j, d, rows[i][2]) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and rows[i][2] and rows[i][2] == rows[j][2] and (d := (a ^ b).bit_count()) <= 6]
    assert sorted((r.key_a, r.key_b, r.distance, r.b) for r in found) == sorted(wanted)


@pytest.mark.parametrize(("preset", "most", "part"), [("deep", 500, 16), ("deep", 10**6, 4096), ("strict", 10**6, 16), ("strict", 37, 4096)])
def test_verification_pairs_are_the_first_of_all(spark, monkeypatch, preset, most, part):
    rng = random.Random(10)
    o = duplicate_options(preset)
    facts = [(i, rng.choice([None, 0, 64, 70, 90]), rng.choice([64, 90]), rng.choice([None, *map(str, range(9))]), rng.getrandbits(20), rng.choice([None, rng.getrandbits(12)])) for i in rng.sample(range(10**6), 160)]
    rows = [(i, f"p/{i}", f"p/{i}", 1, 1, w, h, sha, p, None, c, None) for i, w, h, sha, p, c in facts]

    def pair(a, b):
        far = (a[4] ^ b[4]).bit_count()
        known = all((a[1], a[2], b[1], b[2]))
        areas, shapes = (a[1] * a[2], b[1] * b[2]) if known else (1, 1), (a[1] / a[2], b[1] / b[2]) if known else (1, 1)
        near = o.semantic and None not in (a[5], b[5]) and (a[5] ^ b[5]).bit_count() <= o.color_radius
        blocks = [(((x[1] or -1) // 32), x[2] // 32) for x in (a, b)]
        good = blocks[0] == blocks[1] and max(areas) / min(areas) <= 3.5 and max(shapes) / min(shapes) <= 2 and (a[3] is None or a[3] != b[3])
        return (*blocks[0], a[0], b[0], far) if good and (near or o.verify_least <= far <= o.verify_most) else None

    wanted = sorted(p for a in facts for b in facts if a[0] < b[0] and (p := pair(a, b)))[:most]
    monkeypatch.setattr(S, "PART", part)
    found = S.verification_pairs(spark.createDataFrame(rows, RECORD), o, most)
    assert [tuple(r) for r in found.collect()] == wanted
    assert shuffled_rows(found) < 10 * len(rows)


@pytest.mark.parametrize("part", [4, 4096])
def test_perceptual_components_are_those_of_all_matches(spark, monkeypatch, part):
    rng = random.Random(11)
    o = duplicate_options("balanced", frame_mean=6)
    base, films = [rng.getrandbits(64) for _ in range(14)], [[rng.getrandbits(64) for _ in range(3)] for _ in range(5)]

    def near(h, most):
        h ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(most)))
        return h - (1 << 64) if h >= 1 << 63 else h

    rows = []
    for i in rng.sample(range(10**6), 220):
        frames = rng.choice([None, None, None, [], [near(rng.choice(base), 9)], [near(h, 9) for h in rng.choice(films)[: rng.randrange(1, 4)]], [0, *(near(h, 9) for h in rng.choice(films))], [0, near(rng.choice(films)[1], 5), None]])
        rows.append(record(i, phash=rng.choice([None, *(near(rng.choice(base), 9) for _ in range(6))]), dhash=rng.choice([None, near(base[0], 16)]), frames=frames, w=rng.choice([None, 0, 64, 73, 82]), h=rng.choice([2, 20]), size=i))
    rows += [record(10**7 + k, *rows[k][7:10], frames=rows[k][11], w=rows[k][5], h=rows[k][6]) for k in range(20)]
    records = spark.createDataFrame(rows, RECORD)
    a, b = (S.with_blocks(records, o).alias(x) for x in "ab")
    matches = a.join(b, (F.col("a.bw") == F.col("b.bw")) & (F.col("a.bh") == F.col("b.bh")) & (F.col("a.id") < F.col("b.id"))).where(S.perceptual_match("a", "b", o)).select("a.id", "b.id").collect()
    monkeypatch.setattr(S, "PART", part)
    found = S.perceptual_edges(records, o, 64).collect()
    alike = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[5:7] == y[5:7] and x[8:] == y[8:] and (x[8] is not None or len(x[11] or []) > 1)]  # equal in every visual fact
    assert len(matches) > 100
    assert brute_components([(r.src, r.dst) for r in found]) == brute_components([tuple(m) for m in matches] + alike)


@pytest.mark.parametrize("film", [False, True])
def test_edges_of_a_cluster_follow_its_records(spark, film):
    rng = random.Random(12)
    hashes = rng.sample(range(1 << 8), 200)  # any two match, and films share a black frame too
    rows = [record(i, phash=h, frames=[0, h] if film else None) for i, h in enumerate(hashes)]
    found = S.perceptual_edges(spark.createDataFrame(rows, RECORD), duplicate_options("balanced"), 60)
    edges = [(r.src, r.dst) for r in found.collect()]
    assert brute_components(edges) == dict.fromkeys(range(200), 0)
    assert len(edges) == 199
    assert shuffled_rows(found) <= 10 * len(rows)


@pytest.mark.parametrize("bands", [None, 1, 4])
@pytest.mark.parametrize("most", [7, 1 << 16])
def test_only_joined_pairs_are_left_out(monkeypatch, bands, most):
    monkeypatch.setattr(S, "MOST_LINKED", most)
    rng = random.Random(13)
    base = [rng.getrandbits(24) for _ in range(12)]
    codes = np.array([rng.choice(base[:1] * 20 + base) ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24)) for _ in range(300)], np.uint64)
    left, right, root = np.arange(0, 300, 2), np.arange(1, 300, 2), np.arange(300)
    for x, y in S._few(S._near(codes[left], codes[right], 3, 24, bands, (root, left, right))):
        S._link(root, left[x], right[y])
    wanted = brute_components([(int(i), int(j)) for i in left for j in right if int(codes[i] ^ codes[j]).bit_count() <= 3])
    assert {i: int(r) for i, r in enumerate(root)} == {i: wanted.get(i, i) for i in range(300)}
    assert len(set(wanted.values())) > 5
