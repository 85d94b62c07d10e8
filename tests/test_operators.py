import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pixeltide.functions import geometry as G
from pixeltide.functions.columns import Vec, hash_uniform, vec, vec_of
from pixeltide.operators import annotations as A
from pixeltide.operators import cloud, evaluate, motion, ordered, pixels, placement, raster, trajectories, tree


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_numbering_by_position_and_by_order_agree(spark):
    rnd = random.Random(1)
    data = [(k, s, p) for k in "ab" for s in ("train", "val") for p in rnd.sample(range(1000), 60)]
    df = spark.createDataFrame(data, "k string, s string, p int").repartition(5)
    want = sorted((k, s, p, i) for k in "ab" for i, (_, s, p) in enumerate(sorted(d for d in data if d[0] == k)))
    assert rows(ordered.number_by_position(df, ["k"], ["s"], "p", "n", width=16), "k", "s", "p", "n") == want
    assert rows(ordered.number_by_order(df, ["k", "s", "p"], "n", within=["k"]), "k", "s", "p", "n") == want


def test_neighbour_and_running_sums_cross_chunks(spark):
    data = [(k, p, p * 1.5) for k in (1, None) for p in (0, 1, 5, 40, 41, 99, 500)]
    df = spark.createDataFrame(data, "k int, p int, v double")
    out = ordered.neighbour(df, ["k"], ["p"], ordered.chunk_of("p", 8), ["v"], "o").select(F.coalesce("k", F.lit(-1)).alias("k"), "p", F.coalesce("o.v", F.lit(-1.0)).alias("o"))
    ps = [0, 1, 5, 40, 41, 99, 500]
    assert rows(out, "k", "p", "o") == sorted((k, p, -1.0 if i == 0 else ps[i - 1] * 1.5) for k in (1, -1) for i, p in enumerate(ps))
    run = ordered.running_sums(df, ["k"], ["p"], ordered.chunk_of("p", 8), {"s": F.col("v")}).filter("k = 1")
    assert rows(run, "p", "s") == list(zip(ps, itertools.accumulate(p * 1.5 for p in ps)))


def test_subsample_is_exact_with_a_hot_key(spark):
    """k rows of each frame by the order of their draws, one frame holding two thirds of all rows."""
    rnd = random.Random(2)
    data = [(0 if i % 3 else i % 30, rnd.randrange(100), i) for i in range(3000)]
    df = spark.createDataFrame(data, "frame_id int, px_row int, px_col int")
    draws = df.withColumn("score", hash_uniform(5, "frame_id", "px_row", "px_col"))
    want = []
    for k in {d[0] for d in data}:
        own = sorted((r["score"], r["px_row"], r["px_col"]) for r in draws.filter(F.col("frame_id") == k).collect())
        want += [(k, r, c) for _, r, c in own[:50]]
    got = cloud.subsample(df, 50, 5, portable=True)
    assert rows(got, "frame_id", "px_row", "px_col") == sorted(want)


@pytest.mark.parametrize("gap", [1, 977, 10**13])
def test_scans_over_positions_spread_wide(spark, monkeypatch, gap):
    """Chunks of chunks: with few rows per chunk at every level, and gaps up to the whole range of 64 bits."""
    monkeypatch.setattr(ordered, "SPAN", 4)
    rnd = random.Random(gap)
    data = [(k, s, (p - 300) * gap + rnd.randrange(min(gap, 7)), rnd.random()) for k in ("a", None) for s in (0, 1) for p in rnd.sample(range(600), 150)]
    df = spark.createDataFrame(data, "k string, s int, p bigint, v double").repartition(3)
    by = lambda k: sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]))
    key = F.coalesce("k", F.lit("-")).alias("k")
    want = sorted((k or "-", s, p, i) for k in ("a", None) for i, (_, s, p, _) in enumerate(by(k)))
    assert rows(ordered.number_by_position(df, ["k"], ["s"], "p", "n", width=2).select(key, "s", "p", "n"), "k", "s", "p", "n") == want
    for following in (False, True):
        out = ordered.neighbour(df, ["k", "s"], ["p"], ordered.chunk_of("p", 2), ["p"], "o", following=following)
        near = []
        for k, s in itertools.product(("a", None), (0, 1)):
            ps = sorted(d[2] for d in data if d[:2] == (k, s))
            other = [*ps[1:], None] if following else [None, *ps[:-1]]
            near += [(k or "-", s, p, o if o is not None else -1) for p, o in zip(ps, other, strict=True)]
        assert rows(out.select(key, "s", "p", F.coalesce("o.p", F.lit(-1)).alias("o")), "k", "s", "p", "o") == sorted(near)
    sums = ordered.running_sums(df, ["k", "s"], ["p"], ordered.chunk_of("p", 2), {"t": F.lit(1)})
    want = sorted((k or "-", s, p, i + 1) for k, s in itertools.product(("a", None), (0, 1)) for i, p in enumerate(sorted(d[2] for d in data if d[:2] == (k, s))))
    assert rows(sums.select(key, "s", "p", "t"), "k", "s", "p", "t") == want
    samples = df.filter("k = 'a' and s = 0").select(F.lit(0).alias("grp"), F.col("p").alias("seq_id"), (F.col("v") + 1).alias("value"))
    stop = evaluate.sequential_ci_stop(samples, rel=0.08, width=2).first()
    values = [d[3] + 1 for d in by("a") if d[1] == 0]
    for n in range(8, len(values) + 1):
        mean = sum(values[:n]) / n
        var = sum((x - mean) ** 2 for x in values[:n]) / (n - 1)
        if 1.96 * math.sqrt(var / n) < 0.08 * mean:
            break
    assert (stop["n"], stop["stopped_early"]) == (n, True) and stop["mean"] == pytest.approx(mean)


def test_no_window_sees_a_whole_key_of_sparse_positions(spark, monkeypatch):
    """One key, 4,000 rows far apart: the window over the top level sees a few dozen of them."""
    monkeypatch.setattr(ordered, "SPAN", 1 << 10)
    df = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") * (1 << 20)).alias("p"))
    chunks = df.select("k", ordered.chunk_of("p").alias("__chunk"), F.lit(1).alias("n"))
    top = chunks.select(F.floor(F.col("__chunk") / float(ordered.SPAN)).alias("c")).distinct().count()
    assert chunks.distinct().count() == 4000 and top <= 64
    carried = ordered.carried_sums(chunks, ["k"], ["n"]).orderBy("__chunk").collect()
    assert [r["n"] for r in carried] == [None, *range(1, 4000)]


def test_sampling_does_not_depend_on_partitioning(spark):
    px = spark.range(2000).select((F.col("id") % 3).alias("frame_id"), F.col("id").cast("int").alias("px_row"), F.lit(0).alias("px_col"))
    a = rows(cloud.subsample(px.repartition(2), 40, 7), "frame_id", "px_row")
    assert a == rows(cloud.subsample(px.repartition(7, "px_row"), 40, 7), "frame_id", "px_row") and len(a) == 120
    assert a != rows(cloud.subsample(px, 40, 8), "frame_id", "px_row")


def cameras(spark):
    return motion.with_pose(
        spark.createDataFrame([(0, 64, 36, 35.0, 3.0, 2.0, 9.0, 0.5, 0.1, -1.0), (1, 32, 24, 40.0, -4.0, 6.0, 2.0, 0.0, 0.0, 0.0)],
                              "frame_id int, w int, h int, vfov double, ex double, ey double, ez double, ax double, ay double, az double")
    )


def test_round_trip_pixel_to_world_and_back(spark):
    cams = cameras(spark).withColumn("c2w", G.c2w_array(vec("u"), vec("v"), vec("w"), vec("e")))
    cams = G.with_affine_inverse(cams, "c2w", "w2c")
    px = cams.withColumn("p", F.explode(F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i, j in ((5, 7), (20, 12), (28, 3))])))
    for axis in ("t_up", "row_down"):
        world = cloud.world_point(F.lit(6.5), "p.i", "p.j", axis)
        cam = px.withColumns(G.apply_point("w2c", world).as_columns("q"))
        uv = G.project_camera_point(vec("q"), "fx", "fy", "cx", "cy", axis)
        for r in cam.select("p", uv["u"].alias("u"), uv["v"].alias("v")).collect():
            assert math.hypot(r["u"] - r["p"]["i"], r["v"] - r["p"]["j"]) < 1e-6
    same = cams.select(F.zip_with("w2c", G.rigid_inverse("c2w"), lambda a, b: F.abs(a - b)).alias("d"))
    assert all(x < 1e-12 for r in same.collect() for x in r["d"])


def test_rotation_is_orthonormal_and_centre_ray_hits_target(spark):
    for r in cameras(spark).collect():
        u, v, w = ([r[a + x] for x in "xyz"] for a in "uvw")
        for a, b in ((u, v), (u, w), (v, w)):
            assert abs(sum(x * y for x, y in zip(a, b))) < 1e-10
        for a in (u, v, w):
            assert abs(sum(x * x for x in a) - 1) < 1e-10


def test_point_behind_camera_and_bad_depth(spark):
    one = spark.range(1)
    uv = G.project_camera_point(vec_of(1.0, 1.0, -2.0), 1.0, 1.0, 0.0, 0.0)
    assert one.select(uv["u"].alias("u")).first()["u"] is None
    with pytest.raises(Exception, match="depth must be positive"):
        one.select(cloud.strict_depth(F.lit(float("nan")))).collect()


def test_cloud_mask_edges(spark):
    d = [0.0, 1e-4, 2e-3, float("nan"), float("inf"), 1e30, -1.0]
    px = spark.createDataFrame([(0, i, 0, x, 1) for i, x in enumerate(d)], "frame_id int, px_col int, px_row int, depth double, instance_id int")
    names = {n: [r["px_col"] for r in pixels.mask_filter(px, n).orderBy("px_col").collect()] for n in ("cloud", "train", "sky", "sky_coverage", "foreground")}
    assert names == {"cloud": [2, 5], "train": [1, 2], "sky": [3, 4, 5], "sky_coverage": [3, 4, 5], "foreground": [1, 2, 5]}
    pts = cloud.point_cloud(px, cameras(spark))
    assert {r["px_col"] for r in pts.collect()} == {2, 5}


def test_flow_sign_and_first_frame(spark):
    cams = spark.createDataFrame(
        [(0, 0, 64, 64, 45.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0), (0, 1, 64, 64, 45.0, 1.0, 0.0, 10.0, 1.0, 0.0, 0.0)],
        "run_id int, g int, w int, h int, vfov double, ex double, ey double, ez double, ax double, ay double, az double",
    ).withColumn("frame_id", F.col("g"))
    cams = motion.previous_camera(motion.with_pose(cams), motion.POSE, width=1)
    px = spark.createDataFrame([(g, 40, 20, d) for g in (0, 1) for d in (5.0, 1e30)], "frame_id int, px_col int, px_row int, depth double")
    out = {(r["frame_id"], r["depth"]): (r["flow_x"], r["flow_y"]) for r in motion.optical_flow(px, cams).collect()}
    assert all(abs(x) < 1e-9 for x in out[(0, 5.0)])
    # The camera moved right, so the point was further right in the previous image.
    assert out[(1, 5.0)][0] > 1 and abs(out[(1, 5.0)][1]) < 1e-9
    assert out[(0, 1e30)] == out[(1, 1e30)] == (0.0, 0.0)


def test_pixel_class_rounds_ids_and_last_entry_wins(spark):
    px = spark.createDataFrame([(0, x) for x in (0.0, 4.9, 5.1, 99.0, 3.0)], "frame_id int, instance_id double")
    obj = spark.createDataFrame([(0, 0, 5, 1), (0, 1, 3, 7), (0, 2, 5, 2)], "frame_id int, ord int, instance_id int, class_id int")
    assert rows(pixels.pixel_class(px, obj), "instance_id", "class_id") == [(0.0, 0), (3.0, 7), (4.9, 2), (5.1, 2), (99.0, 0)]


def test_gbuffer_arrays_and_id_range(spark):
    f = spark.createDataFrame([(1, 4, [float(i) for i in range(12)], [0.0] * 11 + [2.0])], "frame_id int, width int, depth array<float>, instance_id array<float>")
    px = pixels.explode_frames(f, channels=("depth", "instance_id", "flow_x", "flow_y"))
    last = px.filter("depth = 11").first()
    assert (last["px_row"], last["px_col"], last["instance_id"], last["flow_x"]) == (2, 3, 2, 0.0)
    with pytest.raises(ValueError):
        pixels.explode_frames(f, channels=("depth", "normal_x"))
    assert rows(pixels.channel_shapes(f), "channel", "width", "height") == [("depth", 4, 3), ("instance_id", 4, 3)]
    with pytest.raises(Exception, match="float32"):
        pixels.check_f32_ids(px.withColumn("instance_id", F.lit(16777216))).collect()


def walk_keyframes(kfs, a):
    """Closed intervals, first match, clamped ends."""
    kfs = sorted(kfs, key=lambda k: k[0])
    a = min(1.0, max(0.0, a))
    if len(kfs) == 1 or a <= kfs[0][0]:
        return kfs[0][1]
    if a >= kfs[-1][0]:
        return kfs[-1][1]
    for (t0, p0), (t1, p1) in zip(kfs, kfs[1:]):
        if t0 <= a <= t1:
            return p0 + ((a - t0) / (t1 - t0) if t1 > t0 else 0.0) * (p1 - p0)


def test_trajectories_against_plain_loop(spark):
    rnd = random.Random(3)
    tracks = {0: [(0.5, 7.0)], 1: [(0.0, 1.0), (1.0, 9.0)], 2: [(0.2, 1.0), (0.2, 5.0), (0.6, 3.0), (0.6, 8.0), (0.6, 2.0)], 3: [(0.4, 1.0), (0.4, 2.0)]}
    for k in range(4, 12):
        tracks[k] = [(rnd.choice([0.0, 0.25, 0.5, 0.77, 1.0]), float(rnd.randint(0, 99))) for _ in range(rnd.randint(1, 6))]
    kf = spark.createDataFrame([(k, i, t, p, 0.0, 0.0) for k, v in tracks.items() for i, (t, p) in enumerate(v)], "traj_id int, pos int, t double, px double, py double, pz double")
    times = [(k, i / 40 - 0.05) for k in [*tracks, 99] for i in range(45)]
    out = trajectories.trajectory_interp(spark.createDataFrame(times, "traj_id int, alpha double"), kf)
    got = {(r["traj_id"], r["alpha"]): r["px"] for r in out.collect()}
    assert len(got) == len(times)
    for k, a in times:
        want = walk_keyframes(tracks[k], a) if k in tracks else None
        assert got[k, a] == want or abs(got[k, a] - want) < 1e-9, (k, a)


def test_crowded_trajectory_and_catalogue_are_merged(spark):
    """20,000 keyframes within a thousandth of one trajectory, and a catalogue of 20,000 entries, each met by 5,000 times."""
    n = 20_000
    kf = spark.range(n).select(F.lit(1).alias("traj_id"), F.col("id").alias("pos"), (0.5 + F.col("id") / (n * 1000.0)).alias("t"), F.col("id").cast("double").alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"))
    rnd = random.Random(1)
    times = spark.createDataFrame([(1, 0.5 + rnd.random() / 1000 * 1.02 - 0.00001) for _ in range(5000)], "traj_id int, alpha double")
    for r in trajectories.trajectory_interp(times, kf).collect():
        want = min(max((r["alpha"] - 0.5) * n * 1000, 0), n - 1)
        assert r["px"] == pytest.approx(want, abs=1e-4)
    cat = spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("asset_ord"), F.col("id").cast("string").alias("name"), F.lit(1.0).alias("weight"))
    draws = spark.range(5000).select(F.lit(0).alias("k"), ((F.col("id") + 0.55) / 5000).alias("u"))
    got = placement.weighted_choice(draws, cat, ["k"]).collect()
    assert len(got) == 5000 and all(int(r["name"]) == int(r["u"] * n) for r in got)
    none = spark.createDataFrame([(7, 0.5)], "k int, u double")
    assert placement.weighted_choice(none, cat, ["k"]).collect() == []


@pytest.mark.parametrize(("fan", "at_once"), [(64, 1 << 20), (3, 1 << 20), (4, 0)])
def test_latest_before_against_plain_search(spark, monkeypatch, fan, at_once):
    monkeypatch.setattr(ordered, "FAN", fan)
    monkeypatch.setattr(ordered, "NUMBERED_AT_ONCE", at_once)
    rnd = random.Random(9)
    left = [(rnd.choice([None, "a", "b", "c"]), rnd.randrange(60) / 4, i) for i in range(300)]
    right = [(k, t / 4, f"{k}{t}") for k in (None, "a", "b") for t in rnd.sample(range(60), 20)]
    a, b = spark.createDataFrame(left, "k string, t double, id int"), spark.createDataFrame(right, "k string, s double, v string")
    for strict in (True, False):
        got = {r["id"]: r["m"] and r["m"]["v"] for r in ordered.latest_before(a, b, ["k"], "t", "s", ["v"], "m", strict).collect()}
        assert len(got) == 300
        for k, t, i in left:
            fits = [(s, v) for kk, s, v in right if kk == k and (s < t or (s == t and not strict))]
            assert got[i] == (max(fits)[1] if fits else None)


def test_spacing_conflicts_against_all_pairs(spark):
    rnd = random.Random(4)
    pts = [(i, rnd.random() * 4, rnd.random() * 4) for i in range(150)] + [(i, 1.0 + rnd.random() * 0.05, 1.0) for i in range(150, 220)]
    out = placement.spacing_conflicts(spark.createDataFrame(pts, "obj_id int, x double, z double"), 0.3)
    got = {r["obj_id"]: r["witness_id"] for r in out.collect()}
    at = {i: (x, z) for i, x, z in pts}
    for i, (x, z) in at.items():
        near = [j for j in at if j < i and math.dist(at[j], (x, z)) < 0.3]
        assert (got[i] is None) == (not near) and (not near or got[i] in near)
    assert len(got) == len(pts)


def test_weighted_choice_floor_and_shares(spark):
    cat = spark.createDataFrame([(0, 0, "a", 0.0), (0, 1, "b", 1.0), (0, 2, "c", 3.0)], "k int, asset_ord int, name string, weight double")
    iv = {r["name"]: (r["lo"], r["hi"]) for r in placement.weight_intervals(cat, ["k"]).collect()}
    assert iv["a"][0] == 0.0 and iv["a"][1] == iv["b"][0] and iv["b"][1] == iv["c"][0] and iv["c"][1] == 1.0 and iv["a"][1] > 0
    draws = spark.range(1000).select(F.lit(0).alias("k"), (F.col("id") / 1000.0).alias("u"))
    n = {r["name"]: r["count"] for r in placement.weighted_choice(draws, cat, ["k"]).groupBy("name").count().collect()}
    assert sum(n.values()) == 1000 and 740 < n["c"] < 760


def test_raster_plane_and_normal(spark):
    g = raster.Grid(-2.0, 2.0, -2.0, 2.0, 4, 4)
    ras = spark.createDataFrame([(i, k, 0.5 * (i - 2) + 0.25 * (k - 2)) for i in range(5) for k in range(5)], "i int, k int, hgt double")
    pts = spark.createDataFrame([(0, 0.3, -0.7), (1, 5.0, 0.0), (2, 1.0, 1.0)], "pt int, x double, z double")
    h = {r["pt"]: r["height"] for r in raster.raster_sample(pts, ras, g).collect()}
    assert h[0] == pytest.approx(0.5 * 0.3 - 0.25 * 0.7) and h[1] == pytest.approx(1.0) and h[2] == pytest.approx(0.75)
    n = raster.raster_normal(pts.filter("pt = 0"), ras, g, ["pt"]).first()
    want = Vec(-0.5, 1.0, -0.25)
    size = math.sqrt(sum(c * c for c in want))
    assert [n["nx"], n["ny"], n["nz"]] == pytest.approx([c / size for c in want])


def test_raster_with_gaps_and_many_tiles_against_plain_code(spark):
    g = raster.Grid(-3.0, 7.0, 1.0, 22.0, 20, 21)
    rnd = random.Random(6)
    h = {(i, k): rnd.random() for i in range(21) for k in range(22) if rnd.random() < 0.97}
    ras = spark.createDataFrame([(1, i, k, v) for (i, k), v in h.items()] + [(2, 0, 0, 1.0)], "grid_id int, i int, k int, hgt double")
    pts = [(n, 1, rnd.uniform(-4, 8), rnd.uniform(0, 23)) for n in range(400)] + [(900, 3, 0.0, 2.0), (901, 2, 0.0, 2.0)]

    def height(x, z):
        def axis(v, lo, hi, n):
            f = max(0.0, min(1.0, (v - lo) / (hi - lo))) * n
            c = max(0, min(n - 1, math.floor(f)))
            return c, f - c

        (i, u), (k, v) = axis(x, g.xmin, g.xmax, g.nx), axis(z, g.zmin, g.zmax, g.nz)
        c = [h.get((i + a, k + b)) for b in (0, 1) for a in (0, 1)]
        return None if None in c else (c[0] * (1 - u) + c[1] * u) * (1 - v) + (c[2] * (1 - u) + c[3] * u) * v

    got = {r["pt"]: r for r in raster.raster_surface(spark.createDataFrame(pts, "pt int, grid_id int, x double, z double"), ras, g, ["grid_id"]).collect()}
    for n, grid, x, z in pts:
        want = height(x, z) if grid == 1 else None
        assert got[n]["height"] == (want if want is None else pytest.approx(want)), n
        sides = [height(x + g.dx, z), height(x - g.dx, z), height(x, z + g.dz), height(x, z - g.dz)] if grid == 1 else [None]
        if None in sides:
            assert got[n]["nx"] is None
        else:
            v = (-(sides[0] - sides[1]) * 2 * g.dz, 4 * g.dx * g.dz, -(sides[2] - sides[3]) * 2 * g.dx)
            size = math.sqrt(sum(c * c for c in v))
            assert [got[n][c] for c in ("nx", "ny", "nz")] == pytest.approx([c / size for c in v])


def test_walk_takes_logarithmic_rounds(spark, monkeypatch):
    """A chain of 1,500 nodes with turns and uneven scales, cycles and an unknown parent beside it."""
    rounds, real = [], tree.cut
    monkeypatch.setattr(tree, "cut", lambda df: rounds.append(1) or real(df))
    rnd = random.Random(5)
    n = 1500
    parts = [(rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.uniform(-40, 40), rnd.choice([0.99, 1.0, 1.01]), rnd.choice([0.99, 1.0, 1.01])) for _ in range(n)]
    data = [(0, i, i - 1 if i else None, 0, x, y, z, 1.0, ry, 0.0, sx, 1.0, sz, i % 100 == 7) for i, (x, y, z, ry, sx, sz) in enumerate(parts)]
    data += [(0, 5000 + i, 5000 + (i + 1) % 3, 0, *[0.0] * 6, *[1.0] * 3, False) for i in range(3)] + [(0, 6000, 7777, 0, *[0.0] * 6, *[1.0] * 3, False)]
    nodes = spark.createDataFrame(data, "scene_id int, node_id int, parent_id int, ord int, lx double, ly double, lz double, rx double, ry double, rz double, sx double, sy double, sz double, grounded boolean")
    got = {r["node_id"]: r for r in tree.walk(nodes.withColumns({"path": F.lit("old"), "wx": F.lit(7)})).collect()}
    assert set(got) == set(range(n)) and len(rounds) <= 13
    x = y = z = yaw = 0.0
    sx = sz = 1.0
    for i, (lx, ly, lz, ry, kx, kz) in enumerate(parts):
        c, s = math.cos(math.radians(yaw)), math.sin(math.radians(yaw))
        x, y, z = x + lx * sx * c + lz * sz * s, y + ly, z + lz * sz * c - lx * sx * s
        yaw, sx, sz = yaw + ry, sx * kx, sz * kz
        r = got[i]
        assert [r["wx"], r["wy"], r["wz"], r["wry"], r["wsx"], r["wsz"], r["wrx"]] == pytest.approx([x, y, z, yaw, sx, sz, i + 1], abs=1e-6)
        assert r["depth"] == i and len(r["path"]) == i + 1 and r["anchor_id"] == (i // 100 * 100 + 7 if i % 100 >= 7 else i // 100 * 100 - 93 if i >= 100 else None)
    assert {r["node_id"] for r in tree.unreached(nodes, tree.walk(nodes)).collect()} == {5000, 5001, 5002, 6000}


def test_tree_ids_paths_and_grounding(spark):
    cols = "scene_id int, node_id int, parent_id int, ord int, name string, asset string, lx double, ly double, lz double, rx double, ry double, rz double, sx double, sy double, sz double, grounded boolean"
    z, one = (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)

    def node(i, p, o, asset, pos=z, rot=z, scale=one, grounded=False):
        return (0, i, p, o, f"n{i}", asset, *pos, *rot, *scale, grounded)

    nodes = spark.createDataFrame(
        [node(1, None, 1, "b"), node(2, None, 0, "", (1.0, 2.0, 0.0), (0.0, 90.0, 0.0), (2.0, 1.0, 1.0), True), node(3, 2, 1, "a", (1.0, 1.0, 0.0)), node(4, 2, 0, "x"), node(5, 3, 0, "a")], cols
    )
    walked = tree.walk(nodes)
    ids = {r["node_id"]: (r["instance_id"], r["p"]) for r in tree.preorder_ids(walked).withColumn("p", tree.node_path()).collect()}
    assert ids == {4: (1, "root_nodes[0].children[0]"), 3: (2, "root_nodes[0].children[1]"), 5: (3, "root_nodes[0].children[1].children[0]"), 1: (4, "root_nodes[1]")}
    w = {r["node_id"]: r for r in walked.collect()}
    # Offset (1, 1, 0) scaled by (2, 1, 1) and turned by a yaw of 90 degrees.
    assert [w[3]["wx"], w[3]["wy"], w[3]["wz"]] == pytest.approx([1.0, 3.0, -2.0])
    ras = spark.createDataFrame([(i, k, 5.0) for i in range(3) for k in range(3)], "i int, k int, hgt double")
    g = {r["node_id"]: r["wy"] for r in tree.ground(walked, ras, raster.Grid(-9.0, 9.0, -9.0, 9.0, 2, 2)).collect()}
    assert g == pytest.approx({1: 0.0, 2: 5.0, 3: 6.0, 4: 5.0, 5: 6.0})
    lost = nodes.unionByName(spark.createDataFrame([node(8, 9, 0, "a"), node(9, 8, 0, "a")], cols))
    assert rows(tree.unreached(lost, tree.walk(lost)), "node_id") == [(8,), (9,)]
    assets = spark.createDataFrame([("a", 0)], "name string, asset_ord int")
    assert rows(tree.unknown_asset_refs(nodes, assets), "node_id") == [(1,), (4,)]


def test_losses_and_stopping_rule(spark):
    df = spark.createDataFrame([(0, 1.0, 3.0, True), (0, 5.0, 4.0, True), (0, 9.0, 0.0, False), (1, 1.0, 9.0, False)], "b int, pred double, target double, mask boolean")
    assert rows(evaluate.masked_l1(df, ["b"]), "b", "loss", "valid") == [(0, 1.5, 2), (1, 0.0, 0)]
    mean = evaluate.epoch_loss(evaluate.masked_l1(df, ["b"]).withColumn("epoch", F.col("b")))
    got = {r["epoch"]: r["mean_loss"] for r in mean.collect()}
    assert got[0] == 1.5 and math.isnan(got[1])
    rnd = random.Random(5)
    data = [(g, i * 3, rnd.gauss(10, s)) for g, s in ((0, 0.5), (1, 30.0), (2, 4.0)) for i in range(300)]
    for budget in (None, 40):
        out = evaluate.sequential_ci_stop(spark.createDataFrame(data, "grp int, seq_id int, value double"), budget=budget, width=16)
        got = {r["grp"]: r for r in out.collect()}
        for g in (0, 1, 2):
            vals = [v for k, _, v in data if k == g][: budget or 300]
            n = len(vals)
            for m in range(8, len(vals) + 1):
                mu = sum(vals[:m]) / m
                var = sum((x - mu) ** 2 for x in vals[:m]) / (m - 1)
                if 1.96 * math.sqrt(var / m) < 0.1 * max(1e-3, mu):
                    n = m
                    break
            assert got[g]["n"] == n and got[g]["mean"] == pytest.approx(sum(vals[:n]) / n)


def test_merge_of_shards(spark):
    im = spark.createDataFrame([(0, 0, 1, "f0"), (1, 0, 1, "f2"), (1, 1, 2, "f3")], "shard_order int, pos int, image_id int, file_name string")
    an = spark.createDataFrame([(0, 0, 1, 5), (1, 0, 2, 5), (1, 1, 1, 6)], "shard_order int, pos int, image_id int, category_id int")
    ca = spark.createDataFrame([(0, 0, 5, "first"), (1, 0, 6, "six"), (1, 1, 5, "late")], "shard_order int, pos int, category_id int, name string")
    images, anns, cats = A.merge_shards(im, an, ca)
    assert rows(images, "new_id", "file_name") == [(1, "f0"), (2, "f2"), (3, "f3")]
    assert rows(anns, "new_id", "new_image_id") == [(1, 1), (2, 3), (3, 2)]
    assert [tuple(r) for r in cats.collect()] == [(5, "first"), (6, "six")]
    bad = an.withColumn("image_id", F.lit(9))
    with pytest.raises(Exception, match="unknown image id"):
        A.merge_shards(im, bad, ca)[1].collect()
    empty = A.merge_shards(im.limit(0), an.limit(0), ca.limit(0))
    assert [d.count() for d in empty] == [0, 0, 0]
