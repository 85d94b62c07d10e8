import json

import pytest
from pyspark.sql import functions as F

from pixeltide.operators import frames
from pixeltide.plans import configs as C
from pixeltide.plans import generation as GEN

MESH = {"path": "dir/mesh.obj", "name": "mesh"}


def table(spark, docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "config_id int, doc string")


def scenario(**kw):
    return {"assets": [MESH], "scenarios": [{"name": "s", **kw}]}


LINT = [
    ({"assets": [MESH], "dataset": {"root": "d"}}, []),
    ({"assets": [MESH], "bogus_root_key": True}, [("unknown_key", "bogus_root_key")]),
    ({"assets": [{**MESH, "albedo_path": "x.jpg"}]}, [("deprecated_key", "assets[0].albedo_path")]),
    ({"assets": [{**MESH, "normal_path": "x.jpg"}]}, [("deprecated_key", "assets[0].normal_path")]),
    ({"assets": [{"obj": "m.obj", "name": "m"}]}, [("deprecated_key", "assets[0].obj"), ("missing_asset", "assets")]),
    ({"dataset": {"root": "d"}}, [("missing_asset", "assets")]),
    ({"assets": [MESH], "scenarios": [{}]}, [("missing_name", "scenarios[0].name")]),
    (scenario(root_nodes=[{"name": "n", "asset": "nope"}]), [("unknown_asset", "scenarios[0].root_nodes[0].asset")]),
    (scenario(root_nodes=[{"name": "n", "asset": "mesh", "children": [{"children": [{"asset": "x", "odd": 1}]}]}]),
     [("unknown_asset", "scenarios[0].root_nodes[0].children[0].children[0].asset"), ("unknown_key", "scenarios[0].root_nodes[0].children[0].children[0].odd")]),
    (scenario(root_nodes=[{"name": "n", "asset": "mesh"}]), []),
    ({"assets": [MESH], "hdr": 42}, [("bad_hdr", "hdr")]),
    ({"assets": [MESH], "hdr": {"path": "p", "gain": 1}}, [("unknown_key", "hdr.gain")]),
    (scenario(camera={"trajectory": [{"t": 0, "pos": [0, 0, 0], "bogus": 1}]}), [("unknown_key", "scenarios[0].camera.trajectory[0].bogus")]),
    (scenario(camera={"trajectory": [{"t": 0}]}), [("bad_trajectory", "scenarios[0].camera.trajectory[0]")]),
    ({"assets": [MESH], "camera": {"trajectory": 1, "fov_deg": "wide", "lookfrom": [1, 2]}}, [("bad_range", "camera.fov_deg"), ("bad_range", "camera.lookfrom"), ("bad_trajectory", "camera.trajectory")]),
    ({"assets": [MESH], "lighting": {"sun_azimuth_deg": {"min": 1, "max": 2, "mid": 1}}}, [("unknown_key", "lighting.sun_azimuth_deg.mid")]),
    ({"assets": [MESH], "render": 3}, [("not_object", "render")]),
    ("{", [("config_json", "")]),
]


def test_lint(spark):
    got = {i: [] for i in range(len(LINT))}
    for r in C.lint(table(spark, [d for d, _ in LINT])).collect():
        got[r["config_id"]].append((r["code"], r["path"]))
        assert r["severity"] == "error"
    assert {i: sorted(g) for i, g in got.items()} == {i: sorted(w) for i, (_, w) in enumerate(LINT)}


def test_lenient_aliases_and_catalogue_defaults(spark):
    t = table(spark, [{"assets": [{"obj": "a\\b/c.obj", "albedo_path": "x.jpg", "roughness": {"min": 0.9, "max": 0.1}}, {}]}, {"asset": {"path": "p.obj", "name": "n", "class_id": 7}}])
    rows = {(r["config_id"], r["asset_ord"]): r for r in C.asset_catalog(t, strict=False).collect()}
    a = rows[0, 0]
    assert (a["path"], a["name"], a["label"], a["albedo_map"], tuple(a["roughness"]), a["class_id"]) == ("a\\b/c.obj", "c.obj", "c.obj", "x.jpg", (0.1, 0.9), 2)
    assert (rows[0, 1]["name"], rows[0, 1]["label"]) == ("", "model") and rows[1, 0]["class_id"] == 7
    issues = C.key_lint(C.config_keys(C.config_objects(t)), strict=False)
    assert {(r["severity"], r["code"]) for r in issues.collect()} == {("warning", "deprecated_key")}


def test_resolved_defaults_and_inheritance(spark):
    doc = {
        "assets": [MESH], "camera": {"lookat": [1, 2, 3], "trajectory": [{"t": 1, "pos": [9, 9, 9]}, {"t": 0, "pos": [1, 1, 1]}]},
        "terrain": {"bounds": {"xmin": -1, "xmax": 1}, "xmin": -5}, "dataset": {"train_split": 3},
        "scenarios": [{"name": "a", "camera": {"fov_deg": {"min": 50, "max": 20}}}, {"name": "b", "camera": {"lookfrom": [10, 5, 15], "trajectory": []}}],
    }
    r = C.resolved_json(C.resolve_config(table(spark, [doc, {}]))).orderBy("config_id").collect()
    one, bare = r
    assert one["terrain"]["xmin"] == -5 and one["terrain"]["xmax"] == 1 and one["train_split"] == 1.0
    assert [k["t"] for k in one["camera"]["trajectory"]] == [0, 1]
    a, b = (s["camera"] for s in one["scenarios"])
    assert tuple(a["fov_deg"]) == (20, 50) and a["lookat"] == [1, 2, 3] and len(a["trajectory"]) == 2
    assert b["lookfrom"]["max"] == [10, 5, 15] and b["trajectory"] == []
    assert (bare["render"]["width"], bare["dataset_root"], bare["train_split"], tuple(bare["placement"]["yaw_deg"])) == (1280, "dataset", 0.8, (0, 360))
    assert len(bare["resolved_config_sha256"]) == 64


def test_sampled_frames_do_not_depend_on_partitions_or_shards(spark):
    t = table(spark, [{"assets": [MESH], "camera": {"fov_deg": {"min": 32, "max": 38}}}])
    ranges, assets = GEN.config_ranges(C.resolve_config(t)), C.asset_catalog(t)
    plan = GEN.frame_ids(spark, 200).withColumn("config_id", F.lit(0))
    cols = ["g", "fov", "obj_x", "roughness", "y_offset", "split", "name"]
    a = sorted(map(tuple, GEN.sample_frames(plan.repartition(7), ranges, assets, F.lit(200)).select(cols).collect()))
    b = []
    for s in range(2):
        b += map(tuple, GEN.sample_frames(frames.frames_of_shard(plan, "g", s, 2), ranges, assets, F.lit(200)).select(cols).collect())
    assert a == sorted(b) and len(a) == 200
    assert all(32 <= r[1] <= 38 and -18 <= r[2] <= 18 and -0.05 <= r[4] <= -0.01 for r in a)
    assert [r[5] for r in a].count("train") == 160 and len({r[1] for r in a}) > 190
    nested = GEN.frame_objects(GEN.sample_frames(plan, ranges, assets, F.lit(200))).first()["objects"][0]
    assert nested["instance_id"] == 1 and nested["rotation_deg"][1] >= 0


def test_scenario_frames(spark):
    kf = spark.createDataFrame([("s", 0, 0.0, 18.0, 8.0, 24.0), ("s", 1, 1.0, -18.0, 8.0, 24.0)], "name string, pos int, t double, px double, py double, pz double")
    scen = spark.createDataFrame([("s", 0.0, 0.5, 0.0, 1.0, 1.0, 1.0), ("still", 0.0, 0.0, 0.0, 10.0, 5.0, 15.0)],
                                 "name string, ax double, ay double, az double, fallback_x double, fallback_y double, fallback_z double")
    plan = GEN.frame_ids(spark, 3).join(scen.select("name"))
    out = {(r["name"], r["g"]): (r["ex"], r["ey"], r["ez"]) for r in GEN.scenario_frames(plan, scen, kf, ["name"], F.lit(3)).collect()}
    assert [out["s", g] for g in range(3)] == [(18, 8, 24), (0, 8, 24), (-18, 8, 24)]
    assert {out["still", g] for g in range(3)} == {(10, 5, 15)}
    GEN.check_scenario(scen, "s")
    with pytest.raises(ValueError):
        GEN.check_scenario(scen, "t")


def test_split_and_shard_arguments(spark):
    df = frames.assign_split(spark.range(10), "id", F.lit(10), 1.7)
    assert df.filter("split = 'val'").isEmpty()
    for bad in ((0, 0), (2, 2), (-1, 3)):
        with pytest.raises(ValueError):
            frames.check_shard(*bad)
