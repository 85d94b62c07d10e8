import json

import pytest
import trees
from pyspark.sql import functions as F

from pixeltide.operators import annotations as A
from pixeltide.plans import validation as V
from pixeltide.plans.dataset_check import validate_dataset
from pixeltide.plans.validation import Limits
from pixeltide.sources import files as S

LOOSE = Limits(max_bbox_area_frac=1.5)


def codes(report):
    return sorted((r["severity"], r["code"]) for r in report.issues.collect())


def check(spark, root, **kw):
    kw.setdefault("limits", LOOSE)
    return validate_dataset(spark, str(root), **kw)


def test_good_tree_passes(spark, tmp_path):
    report = check(spark, trees.good(tmp_path), check_meta=True, strict=True)
    assert codes(report) == []
    assert report.exit_code(strict=True) == 0
    assert {r["category_id"]: (r["n"], r["name"]) for r in report.histogram.collect()} == {5: (2, "crate")}
    s = report.stats.first()
    assert (s["coco_images_referenced"], s["coco_images_checked_existing"]) == (1, 1)


def full_bleed(root):
    """A good tree whose one box is the whole image."""
    trees.good(root)
    trees.frame(root / "train", label="5 0.5 0.5 1.0 1.0\n")
    (root / "annotations_coco.json").write_text(json.dumps(trees.coco(annotations=[{**ANN, "bbox": [0, 0, 6, 4]}])))
    return root


def test_full_bleed_box_warns_by_default(spark, tmp_path):
    report = check(spark, full_bleed(tmp_path), limits=Limits())
    assert codes(report) == [("warning", "coco_bbox_huge_frac"), ("warning", "yolo_huge_frac")]
    assert (report.exit_code(), report.exit_code(strict=True)) == (0, 1)


IMG = {"id": 7, "file_name": "frame_0000.png", "width": 6, "height": 4}
ANN = {"id": 12, "image_id": 7, "category_id": 5, "bbox": [1, 0, 4, 3]}

DOCUMENTS = [
    (dict(), []),
    (dict(annotations=[ANN, {**ANN, "image_id": 9}]), [("error", "coco_orphan_ann")]),
    (dict(annotations=[{**ANN, "image_id": "7"}]), [("error", "coco_orphan_ann")]),
    (dict(annotations=[ANN, 5]), [("warning", "coco_ann_dtype")]),
    (dict(annotations=[{**ANN, "bbox": "x"}]), [("error", "coco_bbox_type")]),
    (dict(annotations=[{**ANN, "bbox": [1, 0, "wide", 3]}]), [("error", "coco_bbox_values")]),
    (dict(annotations=[{**ANN, "bbox": ["1", 0, " 4 ", 3]}]), []),
    (dict(annotations=[{**ANN, "bbox": [1, 0, 4]}]), [("error", "coco_bbox_len")]),
    (dict(annotations=[{**ANN, "bbox": [1, 0, float("nan"), float("inf")]}]), [("error", "coco_bbox_nan")] * 2),
    (dict(annotations=[{**ANN, "bbox": [1, 0, 0, 3]}]), [("error", "coco_bbox_nonpos_wh"), ("error", "coco_bbox_small_area")]),
    (dict(annotations=[{**ANN, "bbox": [3, 0, 4, 3]}]), [("warning", "coco_bbox_oob")]),
    (dict(images=[{**IMG, "width": 0}]), [("error", "coco_image_dim")]),
    (dict(images=[{"id": 7, "file_name": "frame_0000.png"}]), []),
    (dict(images=[IMG, {"id": "x"}]), [("error", "coco_image_schema")]),
    (dict(images=[IMG, {"id": 2}]), [("error", "coco_image_fname")]),
    (dict(images=[{**IMG, "id": 8}, IMG]), [("warning", "coco_duplicate_fname")]),
    (dict(images=[IMG, {**IMG, "id": 3, "file_name": "frame_0009.png"}]), [("error", "coco_image_missing")]),
]


def test_annotation_document_defects(spark):
    """Many documents in one table, told apart by a document key."""
    docs = spark.createDataFrame([(i, json.dumps(trees.coco(**c))) for i, (c, _) in enumerate(DOCUMENTS)], "doc int, text string")
    images, anns, _ = S.coco_tables(S.parse_coco(docs), ["doc"])
    files = docs.select("doc", F.lit("train").alias("split"), F.lit("frame_0000.png").alias("file_name"), F.lit(9).cast("bigint").alias("size_bytes"), F.lit(6).alias("hdr_w"), F.lit(4).alias("hdr_h"))
    resolved = A.resolve_images(images, files, ["doc"])
    boxes = A.annotation_dims(anns.filter("is_object"), resolved, ["doc"])
    issues = V.union_issues(
        [
            V.image_entry_rules(images, ["doc"]), V.duplicate_name_rule(images, ["doc"]), V.annotation_entry_rules(anns, images, ["doc"]),
            V.image_file_rules(resolved, LOOSE, ["doc"]), V.bbox_rules(boxes, LOOSE, ["doc"]),
        ]
    )
    got = {i: [] for i in range(len(DOCUMENTS))}
    for r in issues.collect():
        got[r["doc"]].append((r["severity"], r["code"]))
    assert {i: sorted(g) for i, g in got.items()} == {i: sorted(w) for i, (_, w) in enumerate(DOCUMENTS)}


LABELS = [
    ("", []),
    ("crate, left half\n", ["yolo_bad_line"]),
    ("x 0.5 0.5 1 1", ["yolo_class"]),
    ("2.0 0.5 0.5 1 1", ["yolo_class"]),
    ("2 0.5 0.5f 1 1", ["yolo_parse"]),
    ("2 0.5 0x1p-1 1 1", ["yolo_parse"]),
    ("+2 .5 5e-1 1_0.0e-1 1", []),
    ("2 nan 0.5 1 inf", ["yolo_nan"] * 2),
    ("2 0.5 0.5 -1 1", ["yolo_nonpos_wh", "yolo_small_area"]),
    ("2 0.5 0.5 0.5 0.5", ["yolo_small_area"]),
    ("2 0.6 0.5 1 1", ["yolo_oob_norm"]),
    ("\n\r\n 2\t0.5\u30000.5  1 1 \x0b\n2 0.5 0.5 1", ["yolo_bad_line"]),
]


def test_label_defects(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABELS)], "doc int, text string")
    lines = V.parse_label_tokens(V.split_label_text(docs)).withColumns({"iw": F.lit(1), "ih": F.lit(1)})
    got = {i: [] for i in range(len(LABELS))}
    for r in V.label_line_rules(lines, LOOSE, ["doc"]).collect():
        got[r["doc"]].append(r["code"])
    assert {i: sorted(g) for i, g in got.items()} == {i: w for i, (_, w) in enumerate(LABELS)}


def test_label_files_that_cannot_be_read_are_issues(spark, tmp_path):
    root = trees.good(tmp_path)
    (root / "train" / "frame_0000.txt").write_bytes(b"1 0.5 0.5 0.1 0.1\n\xff\xfe 2\n")
    report = check(spark, root)
    assert ("error", "yolo_io") in codes(report) and not any(c.startswith("yolo") and c != "yolo_io" for _, c in codes(report))
    listed = spark.createDataFrame([(str(root / "train/frame_0000.txt"), 1), (str(root / "gone.txt"), 2), (str(root / "empty.txt"), 3)], "path string, k int")
    (root / "empty.txt").write_text("")
    got = {r["k"]: (r["text"], r["error"]) for r in S.read_checked(listed).collect()}
    assert got == {1: (None, "not UTF-8 at byte 18"), 2: (None, "cannot be read: FileNotFoundError"), 3: ("", None)}


@pytest.mark.parametrize(
    ("text", "code"),
    [('{"images":[]}', "coco_schema"), ('{"images":{},"annotations":[]}', "coco_schema"), ("[]", "coco_io"), ('{"images":[1,],"annotations":[]}', "coco_io"), ("", "coco_io"), ('{"images":[', "coco_io")],
)
def test_documents_that_cannot_be_used(spark, tmp_path, text, code):
    root = trees.good(tmp_path)
    (root / "annotations_coco.json").write_text(text)
    assert codes(check(spark, root)) == [("error", code)]


METAS = [
    ("{", 1), ("", 1), ("[]", 1), (trees.meta(), 0), (trees.meta(frame_id=1.5), 1), (trees.meta(frame_id=True), 1), (trees.meta(frame_id=2.0), 0), (trees.meta(split=3), 1),
    (trees.meta(camera_extrinsics=[1] * 15), 1), (trees.meta(camera_extrinsics=[float("nan"), "x"] + [0] * 14), 2),
    (trees.meta(camera_intrinsics=[]), 1), (trees.meta(camera_intrinsics={"fx": "1", "fy": 1, "cx": 0}), 2), (trees.meta(sun=1), 1),
    (trees.meta(objects={}), 1), (trees.meta(objects=[1, {}]), 6), (trees.meta(objects=[{**trees.meta()["objects"][0], "scale": [1]}]), 1), ({}, 11),
]


def test_meta_defects(spark):
    docs = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, (d, _) in enumerate(METAS)], "doc int, text string")
    got = {i: 0 for i in range(len(METAS))}
    for r in V.meta_rules(docs, keep=["doc"]).collect():
        got[r["doc"]] += 1
        assert r["code"] == ("meta_json" if r["doc"] < 2 else "meta_schema")
    assert got == {i: n for i, (_, n) in enumerate(METAS)}


def broken_late_frame(root):
    """A good tree whose frame 10000 has a broken label and broken metadata."""
    trees.good(root)
    trees.frame(root / "train", "frame_10000", label="five is not\n", doc="{")
    return root


def test_late_frames_escaped_roots_and_uris_are_checked_alike(spark, tmp_path):
    want = [("error", "meta_json"), ("error", "yolo_bad_line"), ("warning", "png_not_in_coco")]
    plain = broken_late_frame(tmp_path / "plain")
    spaced = broken_late_frame(tmp_path / "my data+x %41")
    assert codes(check(spark, plain, check_meta=True)) == want
    assert codes(check(spark, f"file://{plain}", check_meta=True)) == want
    assert codes(check(spark, spaced, check_meta=True)) == want
    again = broken_late_frame(tmp_path / "plain" / "nested" / "plain")
    assert codes(check(spark, again, check_meta=True)) == want


def test_pairing_discovery_and_manifest(spark, tmp_path):
    a = trees.good(tmp_path / "a")
    trees.frame(a / "train", "frame_0001", label=None)
    trees.frame(a / "train", "frame_12345", label=None)
    assert codes(check(spark, a)) == [("error", "yolo_missing")] * 2 + [("warning", "png_not_in_coco")] * 2
    b = trees.good(tmp_path / "b")
    trees.frame(b / "val", "frame_0001", label="")
    assert codes(check(spark, b, check_meta=True)) == [("error", "meta_missing"), ("warning", "png_not_in_coco")]
    (b / "scenario_coco.json").write_text("{}")
    assert codes(check(spark, b)) == [("error", "coco_ambiguous")]
    assert codes(check(spark, b, split="train", coco=str(b / "annotations_coco.json"))) == []
    assert codes(check(spark, b, coco=str(b / "nope.json"))) == [("error", "coco_missing")]
    assert codes(check(spark, a, split="val")) == [("error", "split_missing")]
    assert codes(check(spark, tmp_path / "none")) == [("error", "bad_root")]
    c = trees.good(tmp_path / "c")
    (c / "manifest.json").write_text(json.dumps({"dataset_layout": {"dataset_root": "/other"}, "config_audit": {"resolved_config": {"dataset": {"root": str(c)}}}}))
    assert codes(check(spark, c)) == [("warning", "manifest_root_mismatch")]
    assert codes(check(spark, c, strict=True)) == [("error", "manifest_root_mismatch")]
    (c / "manifest.json").write_text("{")
    assert codes(check(spark, c)) == [("error", "manifest_io")]
    d = trees.good(tmp_path / "d")
    (d / "annotations_coco.json").write_text("{")
    assert codes(check(spark, d)) == [("error", "coco_io")]


def test_files_in_two_splits_and_bad_headers(spark, tmp_path):
    a = trees.good(tmp_path / "a")
    trees.frame(a / "val")
    assert codes(check(spark, a)) == [("error", "coco_image_missing"), ("error", "path_ambiguous")]
    assert codes(check(spark, a, split="train")) == []
    b = trees.good(tmp_path / "b")
    trees.frame(b / "train", png=b"junk", label="bad")
    assert codes(check(spark, b)) == [("warning", "png_ihdr")]
    trees.frame(b / "train", png=b"", label="bad")
    assert codes(check(spark, b)) == [("error", "image_small"), ("warning", "png_ihdr")]


def test_image_names_may_carry_a_subfolder(spark, tmp_path):
    a = trees.good(tmp_path / "a")
    trees.frame(a / "train" / "sub", "frame_0000")
    doc = trees.coco(images=[IMG, {**IMG, "id": 2, "file_name": "sub/frame_0000.png"}, {**IMG, "id": 3, "file_name": "sub/none.png"}])
    (a / "annotations_coco.json").write_text(json.dumps(doc))
    report = check(spark, a)
    assert codes(report) == [("error", "coco_image_missing")]
    assert report.stats.first()["coco_images_checked_existing"] == 2


def test_report_files(spark, tmp_path):
    from pixeltide.sinks.manifests import write_report

    report = check(spark, full_bleed(tmp_path / "a"), limits=Limits())
    code = write_report(report.issues, report.histogram, report.stats.first().asDict(), str(tmp_path / "report"))
    summary = json.loads((tmp_path / "report" / "summary.json").read_text())
    assert code == summary["exit_code"] == 0 and len(summary["issue_counts"]) == 2
