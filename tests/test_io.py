import gzip
import json
import tarfile

import pytest
import trees
from pyspark.sql import functions as F

from pixeltide.checks.core import Views
from pixeltide.operators import annotations as A
from pixeltide.operators import frames, pixels
from pixeltide.sinks import labels as L
from pixeltide.sinks import manifests as M
from pixeltide.sinks.packing import pack_plan, write_webdataset
from pixeltide.sinks.textfiles import write_text_files
from pixeltide.sources import files as S


def boxes(spark):
    b = spark.createDataFrame(
        [(1, 2, 4, "dog", 0, 1, 3, 2), (1, 1, 3, "cat", 5, 5, 9, 9), (2, 1, 3, "cat", 0, 0, 0, 0)],
        "frame_id int, instance_id int, class_id int, label string, x0 int, y0 int, x1 int, y1 int",
    )
    return pixels.normalized_boxes(b, F.lit(10), F.lit(20))


def test_yolo_files_one_per_frame_and_back(spark, tmp_path):
    fr = frames.frame_names(spark.createDataFrame([(1, "train"), (2, "val"), (3, "val")], "frame_id int, split string"), "frame_id")
    assert L.write_yolo(boxes(spark), fr, str(tmp_path)) == 3
    assert (tmp_path / "train/frame_0001.txt").read_text() == "3 0.750000 0.375000 0.500000 0.250000\n4 0.200000 0.100000 0.400000 0.100000\n"
    assert (tmp_path / "val/frame_0003.txt").read_text() == ""
    assert not list(tmp_path.rglob("*.tmp"))
    back = S.read_yolo(spark, str(tmp_path))
    assert sorted((r["class_id"], r["line_no"], r["cx"]) for r in back.collect()) == [(3, 1, 0.05), (3, 1, 0.75), (4, 2, 0.2)]


def test_a_failed_write_leaves_nothing_and_a_second_one_replaces(spark, tmp_path):
    text = F.when(F.col("id") == 37, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("id").cast("string"))
    rows = spark.range(60).select(F.format_string("a/%d.txt", F.col("id") % 20).alias("path"), "id", text.alias("text"))
    with pytest.raises(Exception, match="broken row"):
        write_text_files(rows, str(tmp_path / "out"), ["id"])
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()] and not list((tmp_path / "out").glob("_staging*"))
    assert write_text_files(rows.filter("id <> 37"), str(tmp_path / "out"), ["id"]) == 20
    assert (tmp_path / "out/a/3.txt").read_text() == "32343" and (tmp_path / "out/a/17.txt").read_text() == "1757"
    assert write_text_files(rows.filter("id = 3").withColumn("text", F.unhex(F.lit("FF00"))), str(tmp_path / "out"), ["id"]) == 1
    assert (tmp_path / "out/a/3.txt").read_bytes() == b"\xff\x00"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a"] and len(list((tmp_path / "out/a").iterdir())) == 20
    assert write_text_files(rows.filter("false"), str(tmp_path / "none"), ["id"]) == 0


def test_coco_parts_assemble_to_a_document_and_read_back(spark, tmp_path):
    im = spark.createDataFrame([(i, f"frame_{i:04d}.png", 10, 20) for i in range(1, 41)], "image_id int, file_name string, width int, height int")
    an = A.renumber(boxes(spark).withColumns({"image_id": F.col("frame_id"), "category_id": F.col("class_id")}), ["frame_id", "instance_id"], "ann_id")
    cats = spark.createDataFrame([(4, "dog"), (3, "cat")], "category_id int, name string")
    folder, target = str(tmp_path / "parts"), tmp_path / "annotations_coco.json"
    L.write_coco(im, an, cats, folder)
    L.assemble(folder, str(target))
    doc = json.loads(target.read_text())
    assert [i["id"] for i in doc["images"]] == list(range(1, 41)) and doc["categories"] == [{"id": 3, "name": "cat"}, {"id": 4, "name": "dog"}]
    assert doc["annotations"][1] == {"id": 2, "image_id": 1, "category_id": 4, "bbox": [0.0, 1.0, 4.0, 2.0], "iscrowd": 0, "area": 8, "instance_id": 2, "label": "dog"}
    for reader in (S.read_coco, S.read_coco_lines):
        images, anns, categories = reader(spark, str(target))
        assert images.count() == 40 and categories.count() == 2
        assert sorted((r["ann_id"], r["image_id"], tuple(r["bbox"]), r["label"]) for r in anns.collect())[1] == (2, 1, (0.0, 1.0, 4.0, 2.0), "dog")


def test_line_reader_refuses_other_layouts(spark, tmp_path):
    for name, indent in (("compact", None), ("indented", 2)):
        (tmp_path / name).write_text(json.dumps(trees.coco(), indent=indent))
        with pytest.raises(Exception, match="no element of this layout"):
            for table in S.read_coco_lines(spark, str(tmp_path / name)):
                table.collect()


def test_shard_documents_merge_in_given_order(spark, tmp_path):
    names = []
    for i, fn in enumerate(("b", "a")):
        p = tmp_path / f"{fn} 1.json"
        p.write_text(json.dumps(trees.coco(images=[{"id": 1, "file_name": f"f{i}.png"}], annotations=[{"id": 9, "image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1]}])))
        names.append(str(p))
    images, anns, cats = A.merge_shards(*S.read_coco(spark, names))
    assert sorted((r["new_id"], r["file_name"]) for r in images.collect()) == [(1, "f0.png"), (2, "f1.png")]
    assert sorted((r["new_id"], r["new_image_id"]) for r in anns.collect()) == [(1, 1), (2, 2)] and cats.count() == 2


def test_merged_document_keeps_every_member(spark, tmp_path):
    names = []
    for i in range(2):
        ann = {"bbox": [0, 0, 1, 1], "id": 9, "segmentation": [[0.5, 1, 2]], "image_id": 7, "category_id": 5, "note": {"k": None}}
        doc = trees.coco(annotations=[ann, {"id": 3, "image_id": 99}], categories=[{"id": 5, "name": f"n{i}", "supercategory": "s"}])
        (tmp_path / f"s{i}.json").write_text(json.dumps(doc))
        names.append(str(tmp_path / f"s{i}.json"))
    issues = L.write_merged(S.read_coco_members(spark, names), str(tmp_path / "parts"))
    assert [r["code"] for r in issues.collect()] == ["coco_orphan_ann"] * 2
    L.assemble(str(tmp_path / "parts"), str(tmp_path / "all.json"))
    doc = json.loads((tmp_path / "all.json").read_text())
    assert [i["id"] for i in doc["images"]] == [1, 2] and doc["categories"] == [{"id": 5, "name": "n0", "supercategory": "s"}]
    assert [(a["id"], a["image_id"], a["segmentation"], a["note"], list(a)[0]) for a in doc["annotations"]] == [
        (1, 1, [[0.5, 1, 2]], {"k": None}, "bbox"), (3, 2, [[0.5, 1, 2]], {"k": None}, "bbox"),
    ]


def test_boxes_as_csv_and_json(spark, tmp_path):
    L.write_boxes_csv(boxes(spark), str(tmp_path / "csv"), F.lit(10), F.lit(20))
    got = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert got.columns == ["frame_id", *L.BOX_COLUMNS] and got.count() == 3
    assert L.write_boxes_json(boxes(spark), str(tmp_path / "j"), 10, 20, F.format_string("f%d.json", "frame_id")) == 2
    doc = json.loads((tmp_path / "j" / "f1.json").read_text())
    assert doc["image_width"] == 10 and [b["instance_id"] for b in doc["boxes"]] == [1, 2] and doc["boxes"][1]["xmax"] == 3


def test_point_file(spark, tmp_path):
    pts = spark.createDataFrame([(0, 1, 0, 1.5, 2.0, -3.0, 1.0, 0.5, -1.0), (0, 0, 0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0)],
                                "frame_id int, px_row int, px_col int, x double, y double, z double, r double, g double, b double")
    assert L.write_ply(pts, str(tmp_path), F.lit("scene.ply")) == 1
    lines = (tmp_path / "scene.ply").read_text().splitlines()
    assert lines[:3] == ["ply", "format ascii 1.0", "element vertex 2"] and lines[9] == "end_header"
    assert lines[10:] == ["0.0 0.0 0.0 255 0 0", "1.5 2.0 -3.0 255 127 0"]


def dataset(root):
    for split, stem, label in (("train", "frame_0000", "1 0 0 1 1\n"), ("train", "frame_0002", None), ("val", "frame_0001", None), ("val", "frame_12345", None)):
        trees.frame(root / split, stem, label, trees.meta())
        (root / split / f"{stem}_spatial.exr").write_bytes(b"px" + stem.encode())
    (root / "train" / "frame_0007.png").write_bytes(b"no meta")
    return root


def members(path):
    with tarfile.open(path) as t:
        return {m.name: t.extractfile(m).read() for m in t.getmembers()}


def test_packing(spark, tmp_path):
    root = dataset(tmp_path / "d")
    out = tmp_path / "shards"
    paths = write_webdataset(spark, str(root), str(out), frames_per_shard=2)
    assert paths == [str(out / f"shard-00000{i}.tar") for i in (0, 1)]
    first = members(paths[0])
    assert list(first) == [f"frame_0000.{e}" for e in ("exr", "json", "png", "txt")] + [f"frame_0002.{e}" for e in ("exr", "json", "png")]
    assert first["frame_0000.txt"] == b"1 0 0 1 1\n" and first["frame_0000.json"] == (root / "train/frame_0000_meta.json").read_bytes()
    assert {n.split(".")[0] for n in members(paths[1])} == {"frame_0001", "frame_12345"}
    assert write_webdataset(spark, str(root), str(out), frames_per_shard=2) == []
    val = write_webdataset(spark, str(root), str(tmp_path / "gz"), split="val", compress=True)
    assert [p[-21:] for p in val] == ["shard-000000.tar.gz"[-21:]] or val[0].endswith("shard-000000.tar.gz")
    assert gzip.open(val[0]).read(9) == b"frame_000"
    many = dataset(tmp_path / "many")
    for i in range(40):
        trees.frame(many / "train", f"frame_1{i:04d}", None, trees.meta())
    plan = pack_plan(spark, str(many), frames_per_shard=2)
    assert [(r["pack_index"], r["pack_shard"]) for r in plan.orderBy("pack_index").collect()] == [(i, i // 2) for i in range(44)]
    assert len(write_webdataset(spark, str(many), str(tmp_path / "more"), frames_per_shard=2)) == 22
    (tmp_path / "empty" / "train").mkdir(parents=True)
    assert write_webdataset(spark, str(tmp_path / "empty"), str(tmp_path / "none")) == []
    with pytest.raises(ValueError):
        pack_plan(spark, str(root), split="test")


def test_scan_stem_family_and_headers(spark, tmp_path):
    root = dataset(tmp_path / "d")
    inv = {(r["split"], r["stem"]): r for r in S.scan_frames(spark, str(root)).collect()}
    assert set(inv) == {("train", "frame_0000"), ("train", "frame_0002"), ("train", "frame_0007"), ("val", "frame_0001"), ("val", "frame_12345")}
    assert len(S.scan_frames(spark, str(root), strict=True).collect()) == 4
    as_uri = {(r["split"], r["stem"], r["has_meta"]) for r in S.scan_frames(spark, f"file://{root}").collect()}
    assert as_uri == {(*k, r["has_meta"]) for k, r in inv.items()}
    listed = [r["path"] for r in S.list_files(spark, f"file://{root}").collect()]
    assert all(p.startswith(f"file://{root}/") for p in listed) and len(listed) == 14
    assert inv["train", "frame_0000"]["has_txt"] and not inv["train", "frame_0007"]["has_meta"]
    trees.frame(root / "train", "sfrm_0001", None, trees.meta())
    assert frames.stem_family(S.list_files(spark, str(root))).first()["family"] == "frame"
    lone = tmp_path / "s"
    trees.frame(lone / "val", "sfrm_0001", None, trees.meta())
    assert frames.stem_family(S.list_files(spark, str(lone))).first()["family"] == "sfrm"
    pngs = S.image_dims(S.list_files(spark, str(root)).filter("name like '%.png'"))
    dims = {r["name"]: (r["hdr_w"], r["hdr_h"]) for r in pngs.collect()}
    assert dims["frame_0000.png"] == (6, 4) and dims["frame_0007.png"] == (None, None)
    found = S.coco_discover(S.list_files(spark, str(trees.good(tmp_path / "g")))).first()
    assert found["coco_path"].endswith("annotations_coco.json") and found["code"] is None


def test_frame_meta_files_round_trip(spark, tmp_path):
    from pixeltide.checks.document_checks import _meta_frames

    fr = _meta_frames(Views(spark, "/root/testdata/sf0.001")).filter("frame_id < 3")
    fr = frames.frame_names(fr, "frame_id")
    assert L.write_frame_meta(fr, str(tmp_path)) == 3
    doc = json.loads((tmp_path / "train/frame_0001_meta.json").read_text())
    assert doc["objects"][0]["transform_supervision"] == "logical_excludes_slope_and_vertex_snap" and len(doc["camera_extrinsics"]) == 16
    back = S.read_frame_meta(spark, str(tmp_path))
    assert [(r["frame_id"], r["w"], r["valid"], r["mismatch"]) for r in back.orderBy("frame_id").collect()] == [(i, 320, True, False) for i in range(3)]
    docs = spark.createDataFrame([("{}",), ("{",)], "text string")
    assert [(r["valid"], r["frame_id"], r["split"]) for r in S.parse_frame_meta(docs).orderBy("valid").collect()] == [(False, -1, ""), (True, -1, "")]


def test_manifest(spark, tmp_path):
    doc = M.manifest_document(argv="forge --frames 10", cwd="/w", timestamp_utc="2026-01-01T00:00:00Z", job_kind="forge", dataset_root=str(tmp_path), seed=42, frames_total=10, train_frames=8, frames_rendered=5, shard_index=1, shard_count=2)
    path = M.manifest_path(str(tmp_path), 1, 2)
    M.write_manifest(path, doc)
    M.write_manifest(path, doc)
    row = S.read_manifests(spark, str(tmp_path)).first()
    assert row["valid"] and row["dataset_layout"]["val_frames"] == 2 and row["dataset_layout"]["coco_annotations_file"] == "annotations_coco_shard_1.json"
    from pixeltide.functions.text import dataset_id

    one = spark.range(1).select(dataset_id(F.lit(str(tmp_path)), F.lit("2026-01-01T00:00:00Z"), F.lit("forge --frames 10"), F.lit(42), F.lit("forge")).alias("d"))
    assert one.first()["d"] == row["execution"]["dataset_id"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["manifest_shard_1.json"]


def test_samples_need_image_and_pixels(spark):
    idx = spark.createDataFrame([("train", 0), ("train", 1)], "split string, frame_id int")
    meta, px, im = idx.withColumn("w", F.lit(4)), idx, idx.filter("frame_id = 0")
    assert S.frame_samples(idx.filter("frame_id = 0"), meta, px, im).count() == 1
    with pytest.raises(Exception, match="lacks its image"):
        S.frame_samples(idx, meta, px, im).collect()
