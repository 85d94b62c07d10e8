"""Validation of a dataset folder: reads the files, runs the rules of plans.validation, returns tables."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide import constants as K
from pixeltide.functions import jsonfn as J
from pixeltide.operators import annotations as A
from pixeltide.plans import validation as V
from pixeltide.session import cut
from pixeltide.sinks.storage import exists, locate
from pixeltide.sources import files as S


@dataclass
class Report:
    """issues and histogram are DataFrames; scan_folders, coco_path and stats are small driver-side facts."""

    issues: DataFrame
    histogram: DataFrame | None = None
    stats: DataFrame | None = None
    category_names: DataFrame | None = None
    coco_path: str | None = None
    scan_folders: list[str] = field(default_factory=list)

    def exit_code(self, strict: bool = False) -> int:
        return V.exit_code(self.issues, strict=strict).first()["exit_code"]


def _is_dir(path: str) -> bool:
    from pyarrow import fs

    system, p = locate(path)
    return system.get_file_info(p).type == fs.FileType.Directory


def _issues(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), V.ISSUE_SCHEMA)


def scan_folders(root: str, split: str) -> tuple[list[str], list[tuple]]:
    """Split folders to scan ('' for a flat layout) and a split_missing issue."""
    have = [s for s in ("train", "val") if _is_dir(f"{root}/{s}")]
    if not have:
        return [""], []
    if split == "all":
        return have, []
    if split not in have:
        return [], [("error", "split_missing", split, f"split folder {split} does not exist", f"{root}/{split}")]
    return [split], []


def validate_dataset(
    spark: SparkSession, root: str, *, split: str = "all", manifest: str | None = None, coco: str | None = None,
    limits: V.Limits = V.Limits(), strict: bool = False, check_meta: bool = False,
) -> Report:
    """All rules over one dataset root. Checks stop early where the annotation document cannot be used."""
    if split not in ("train", "val", "all"):
        raise ValueError("split must be 'train', 'val' or 'all'")
    root = root.rstrip("/")
    if not _is_dir(root):
        return Report(_issues(spark, ("error", "bad_root", root, "dataset root is not a folder", root)))
    folders, missing = scan_folders(root, split)
    if missing:
        return Report(_issues(spark, *missing), scan_folders=folders)
    parts = [_issues(spark)]

    manifest_path = manifest or f"{root}/manifest.json"
    if exists(manifest_path):
        text = S.read_texts(spark, manifest_path)
        empty = spark.createDataFrame([(manifest_path, "")] if text.isEmpty() else [], "path string, text string")
        parts.append(V.manifest_rules(text.unionByName(empty), root, strict, os.getcwd()))

    listing = S.list_files(spark, root)
    if coco is not None:
        if not exists(coco):
            parts.append(_issues(spark, ("error", "coco_missing", coco, "annotation document does not exist", coco)))
            return Report(V.union_issues(parts), scan_folders=folders)
        coco_path = coco
    else:
        hits = [n for n in K.COCO_DEFAULT_NAMES if exists(f"{root}/{n}")]
        if len(hits) != 1:
            code = "coco_not_found" if not hits else "coco_ambiguous"
            parts.append(_issues(spark, ("error", code, root, "need exactly one of " + ", ".join(K.COCO_DEFAULT_NAMES), root)))
            return Report(V.union_issues(parts), scan_folders=folders)
        coco_path = f"{root}/{hits[0]}"

    # Read once: parsed documents, image headers and label lines are kept on the checkpoint folder, and every rule starts from there.
    documents, elements = S.coco_documents(spark, coco_path)
    elements = cut(elements.withColumn("t", J.quote_nonfinite("text")).drop("text"))
    document = documents.first()
    readable = document["readable"] and elements.filter(F.try_parse_json("t").isNull()).isEmpty()
    if not readable or not {"images", "annotations"} <= set(document["sections"]):
        code = "coco_schema" if readable else "coco_io"
        parts.append(_issues(spark, ("error", code, coco_path, "annotation document is not usable", coco_path)))
        return Report(V.union_issues(parts), coco_path=coco_path, scan_folders=folders)

    images, anns, cats = S.element_tables(elements)
    where = F.lit(coco_path)
    scanned = listing.filter(F.col("split").isin(folders)).withColumns(
        {"stem": F.regexp_replace("name", r"(_meta\.json|\.png|\.txt)$", ""), "file_name": F.col("name")}
    )
    # Catalogue names are paths relative to a scanned folder; frame checks take frame names directly in it.
    whole = F.concat_ws("/", F.nullif("split", F.lit("")), "name")
    inside = [
        F.when(
            F.lit(f == "") | whole.startswith(f"{f}/"),
            F.struct(F.lit(f).alias("split"), (whole if f == "" else F.substring(whole, len(f) + 2, 1 << 30)).alias("file_name")),
        )
        for f in folders
    ]
    catalogue = listing.select(F.explode_outer(F.array(*inside)).alias("c"), "path", F.col("length").alias("size_bytes"))
    catalogue = catalogue.filter(F.col("c").isNotNull()).select("c.split", "c.file_name", "path", "size_bytes")
    headed = S.image_dims(catalogue.filter(F.lower("file_name").endswith(".png")))
    files = cut(catalogue.join(headed.select("path", "hdr_w", "hdr_h").distinct(), "path", "left"))
    resolved = A.resolve_images(images, files)
    boxes = A.annotation_dims(anns.filter("is_object"), resolved)

    side = scanned.groupBy("split", "stem").agg(
        F.bool_or(F.col("name") == F.concat("stem", F.lit(".txt"))).alias("has_txt"),
        F.bool_or(F.col("name") == F.concat("stem", F.lit("_meta.json"))).alias("has_meta"),
    )
    frames = files.filter(F.col("file_name").rlike(K.IMAGE_NAME_OPEN)).withColumn("stem", F.regexp_replace("file_name", r"\.png$", ""))
    frames = frames.join(side, ["split", "stem"], "left")

    parts += [
        V.image_entry_rules(images, path=where),
        V.duplicate_name_rule(images, path=where),
        V.annotation_entry_rules(anns, images, path=where),
        V.image_file_rules(resolved, limits),
        V.bbox_rules(boxes, limits, path=where),
        V.pairing_rules(frames, images, check_meta),
    ]
    here = frames.filter("has_txt").select("split", "stem", "hdr_w", "hdr_h")
    labels = scanned.filter(F.col("name") == F.concat("stem", F.lit(".txt"))).select("split", "stem", "name", "path")
    texts = cut(S.read_checked(labels.join(here.filter("hdr_w is not null"), ["split", "stem"])))
    parts.append(V.label_io_rules(texts, F.col("name"), F.col("path")))
    lines = cut(label_lines(texts))
    parts.append(V.label_line_rules(lines, limits, path=F.col("path")))
    if check_meta:
        docs = _folder_docs(spark, root, "*_meta.json", r"_meta\.json$", folders).join(here.select("split", "stem"), ["split", "stem"], "left_semi")
        hollow = scanned.filter((F.col("length") == 0) & F.col("name").endswith("_meta.json")).select("split", "stem", "path", F.lit("").alias("text"))
        hollow = hollow.join(here.select("split", "stem"), ["split", "stem"], "left_semi")
        parts.append(V.meta_rules(docs.select("path", "text").unionByName(hollow.select("path", "text"))))
    labels = V.countable_labels(lines).select(F.col("class_id").alias("category_id"))
    histogram = A.class_histogram(cats, boxes, labels)
    return Report(V.union_issues(parts), histogram, V.validation_stats(images, resolved), cats, coco_path, folders)


def _folder_docs(spark: SparkSession, root: str, glob: str, suffix: str, folders: list[str]) -> DataFrame:
    """Texts directly in the chosen folders; only those folders are read."""
    docs = S.read_texts(spark, [f"{root}/{f}" if f else root for f in folders], glob, deep=False)
    rel = S.below_root(F.col("path"), root)
    docs = docs.withColumns({"split": F.regexp_extract(rel, r"(?s)^(.*)/[^/]*$", 1), "stem": F.regexp_replace(F.regexp_extract(rel, r"([^/]*)$", 1), suffix, "")})
    return docs.filter(F.col("split").isin(folders))


def label_lines(texts: DataFrame) -> DataFrame:
    """Parsed lines of the label files that could be read, with the size of their image."""
    docs = texts.filter("error is null").drop("error", "name").withColumnsRenamed({"hdr_w": "iw", "hdr_h": "ih"})
    return V.parse_label_tokens(V.split_label_text(docs))
