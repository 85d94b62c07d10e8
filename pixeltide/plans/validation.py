"""Dataset validation: every rule as rows of one issue table.

Rules over one table are evaluated in one pass: a bit per rule and row, issue structs where a bit is set, so a new
rule adds an expression and not another scan. Issue columns: severity, code, subject, message,
path (plus document keys).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide import constants as K
from pixeltide.functions import jsonfn as J
from pixeltide.functions.columns import col, finite
from pixeltide.operators import annotations as A

ISSUE_COLUMNS = ("severity", "code", "subject", "message", "path")
ISSUE_SCHEMA = "severity string, code string, subject string, message string, path string"


@dataclass(frozen=True)
class Limits:
    max_bbox_area_frac: float = K.MAX_BBOX_AREA_FRAC
    min_bbox_area_pixels: int = K.MIN_BBOX_AREA_PIXELS
    min_image_bytes: int = K.MIN_IMAGE_BYTES


class Issue(NamedTuple):
    severity: str
    code: str
    cond: Column
    message: Column

    def row(self) -> Column:
        return F.struct(F.lit(self.severity).alias("severity"), F.lit(self.code).alias("code"), self.message.alias("message"))


def issue(severity: str, code: str, cond: Column, message: Column | str) -> Issue:
    return Issue(severity, code, cond, F.lit(message) if isinstance(message, str) else message)


_NO_ISSUES = "array<struct<severity:string,code:string,message:string>>"


def emit(df: DataFrame, issues: Sequence[Issue], subject: Column, path: Column, keep: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """Explode conditional issues (and ``more``: arrays of issues) into issue rows.

    A row's rules are first one number, a bit per rule; texts and structs are built for rows with a bit set only. The outer explode
    between the two keeps the optimizer from pushing the test for bits below the columns it is made of and evaluating them twice.
    """
    bits = [F.when(r.cond, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, r in enumerate(issues)]
    extra = reduce(F.concat, [F.coalesce(m, F.array().cast(_NO_ISSUES)) for m in more]) if more else None
    if extra is not None:
        df = df.withColumn("__more", extra)
        bits.append(F.when(F.size("__more") > 0, F.lit(1 << len(issues))).otherwise(F.lit(0)).cast("bigint"))
    df = df.withColumn("__bits", reduce(Column.bitwiseOR, bits))
    df = df.withColumn("__hit", F.explode_outer(F.when(F.col("__bits") != 0, F.array("__bits")))).filter(F.col("__hit").isNotNull())
    found = F.array_compact(F.array(*[F.when(F.col("__hit").bitwiseAND(1 << k) != 0, r.row()) for k, r in enumerate(issues)]))
    if extra is not None:
        found = F.concat(found, "__more")
    rows = df.select(
        *keep, subject.cast("string").alias("__subject"), path.cast("string").alias("__path"), F.explode_outer(found).alias("__i")
    ).filter(F.col("__i").isNotNull())
    return rows.select(
        *keep, F.col("__i.severity").alias("severity"), F.col("__i.code").alias("code"),
        F.col("__subject").alias("subject"), F.col("__i.message").alias("message"), F.col("__path").alias("path"),
    )


def union_issues(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- annotation documents


def image_entry_rules(images: DataFrame, keep: Sequence[str] = (), path: Column | None = None) -> DataFrame:
    path = F.lit(None) if path is None else path
    bad_id = ~F.col("is_object") | F.col("image_id").isNull()
    no_name = ~bad_id & (F.coalesce(F.length("file_name"), F.lit(0)) == 0)
    return emit(
        images,
        [
            issue("error", "coco_image_schema", bad_id, "image entry is not an object with an integer id"),
            issue("error", "coco_image_fname", no_name, "image entry has no file_name"),
        ],
        F.coalesce(F.col("image_id").cast("string"), F.concat(F.lit("pos="), F.col("pos").cast("string"))),
        path,
        keep,
    )


def duplicate_name_rule(images: DataFrame, keys: Sequence[str] = (), path: Column | None = None) -> DataFrame:
    path = F.lit(None) if path is None else path
    dup = A.duplicate_names(A.registered_images(images), keys)
    message = F.format_string("file_name already used by image %s", F.col("prev_id").cast("string"))
    return emit(dup, [issue("warning", "coco_duplicate_fname", F.lit(True), message)], F.col("image_id"), path, keys)


def annotation_entry_rules(annotations: DataFrame, images: DataFrame, keys: Sequence[str] = (), path: Column | None = None) -> DataFrame:
    path = F.lit(None) if path is None else path
    loose = emit(
        annotations, [issue("warning", "coco_ann_dtype", ~F.col("is_object"), "annotation entry is not an object")],
        F.concat(F.lit("pos="), F.col("pos").cast("string")), path, keys,
    )
    orphans = A.orphan_annotations(annotations.filter("is_object"), A.registered_images(images), keys)
    orphan = emit(
        orphans, [issue("error", "coco_orphan_ann", F.lit(True), "annotation refers to an unknown image id")],
        F.format_string("image_id=%s ann_id=%s", F.col("image_id").cast("string"), F.col("ann_id").cast("string")), path, keys,
    )
    return loose.unionByName(orphan)


def image_file_rules(resolved: DataFrame, limits: Limits = Limits(), keys: Sequence[str] = ()) -> DataFrame:
    """Rules on the kept images (annotations.resolve_images)."""
    one = F.col("hits") == 1
    rules = [
        issue("error", "path_ambiguous", F.col("hits") > 1, "file found in several scanned folders"),
        issue("error", "coco_image_missing", ~one, "referenced image file does not exist"),
    ]
    if "size_bytes" in resolved.columns:
        small = one & (F.col("size_bytes") < limits.min_image_bytes)
        rules.append(issue("error", "image_small", small, F.format_string("image has %d bytes", F.col("size_bytes"))))
    if "hdr_w" in resolved.columns:
        blind = one & (F.col("width").isNull() | F.col("height").isNull()) & F.col("hdr_w").isNull()
        rules.append(issue("warning", "png_ihdr", blind, "no catalogue size and no readable image header; boxes not checked"))
    path = F.col("path") if "path" in resolved.columns else F.lit(None)
    return emit(resolved, rules, F.col("file_name"), path, keys)


def bbox_rules(rows: DataFrame, limits: Limits = Limits(), keep: Sequence[str] = (), subject: Column | None = None, path: Column | None = None) -> DataFrame:
    """Box rules on annotations with their image size iw, ih (annotations.annotation_dims)."""
    subject = F.format_string("image_id=%s ann_id=%s", F.col("image_id").cast("string"), F.col("ann_id").cast("string")) if subject is None else subject
    path = F.lit(None) if path is None else path
    box = F.col("bbox")
    # Conditions used by many rules are columns of their own: generated code evaluates them once per row.
    rows = rows.withColumns(
        {
            **{f"__{n}": F.get(box, F.lit(i)) for i, n in enumerate("xywh")},
            "__iw": F.col("iw").cast("double"), "__ih": F.col("ih").cast("double"),
            "__list": F.coalesce(F.col("bbox_is_list"), F.lit(False)),
        }
    )
    x, y, w, h, iw, ih, is_list = (F.col(f"__{n}") for n in ("x", "y", "w", "h", "iw", "ih", "list"))
    all_four = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    sized = is_list & iw.isNotNull() & ih.isNotNull()
    numeric = sized & F.when(F.size(box) == 4, all_four).otherwise(~F.exists(box, lambda e: e.isNull()))
    rows = rows.withColumns({"__sized": sized, "__numeric": F.coalesce(numeric, F.lit(False)), "__area": w * h, "__denom": iw * ih})
    sized, numeric, area, denom = (F.col(f"__{n}") for n in ("sized", "numeric", "area", "denom"))
    four = numeric & (F.size(box) == 4)
    rows = rows.withColumn("__fin", F.coalesce(four & finite(x) & finite(y) & finite(w) & finite(h), F.lit(False)))
    fin = F.col("__fin")
    usable = fin & (denom > 0)
    eps = K.BBOX_EDGE_EPS
    outside = (x < -eps) | (y < -eps) | (x + w > iw + eps) | (y + h > ih + eps)
    component = [
        issue("error", "coco_bbox_nan", four & ~finite(c), f"box component {n} is not finite")
        for n, c in (("x", x), ("y", y), ("w", w), ("h", h))
    ]
    return emit(
        rows,
        [
            issue("error", "coco_bbox_type", ~is_list, "bbox is not a list"),
            issue("error", "coco_bbox_values", sized & ~numeric, "bbox holds a value that is not a number"),
            issue("error", "coco_bbox_len", numeric & ~four, "bbox does not have four values"),
            *component,
            issue("error", "coco_bbox_small_area", fin & (area < float(limits.min_bbox_area_pixels)), F.format_string("box area %s is below the minimum", area.cast("string"))),
            issue("error", "coco_bbox_nonpos_wh", fin & ((w <= 0) | (h <= 0)), "box width or height is not positive"),
            issue("error", "coco_image_dim", fin & (denom <= 0), "image size is not positive"),
            issue("warning", "coco_bbox_huge_frac", usable & (area / F.nullif(denom, F.lit(0.0)) >= limits.max_bbox_area_frac), "box covers nearly the whole image"),
            issue("warning", "coco_bbox_oob", usable & outside, "box leaves the image"),
        ],
        subject,
        path,
        keep,
    )


# ---------------------------------------------------------------- label lines


# Line breaks, and the characters that separate tokens inside a line (fixed values).
_BREAKS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
_SPACES = "\t\x1f\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def split_label_text(labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line: line_no (from 1 over non-blank lines), tokens.

    One translate() maps every break to a newline and every separator to a space; what follows splits on single
    characters, which is far cheaper than regexes over character classes.
    """
    plain = F.translate(text, _BREAKS + _SPACES, "\n" * len(_BREAKS) + " " * len(_SPACES))
    lines = F.filter(F.split(plain, "\n"), lambda s: F.trim(s) != "")
    rest = [c for c in labels.columns if c != text]
    out = labels.select(*rest, F.posexplode(lines).alias("__n", "line"))
    return out.withColumns({"line_no": (F.col("__n") + 1).cast("int"), "tokens": F.split(F.trim("line"), " +")}).drop("__n")


def parse_label_tokens(lines: DataFrame) -> DataFrame:
    """Adds class_id, cx, cy, w, h (null where a token does not parse) to rows with ``tokens``."""
    t = [F.get("tokens", F.lit(i)) for i in range(5)]
    return lines.withColumns(
        {"class_id": J.parse_int(t[0]), **{n: J.parse_float(t[i + 1]) for i, n in enumerate(("cx", "cy", "bw", "bh"))}}
    )


def label_io_rules(files: DataFrame, subject: Column, path: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Label files that cannot be read or decoded (sources.files.read_checked)."""
    return emit(files, [issue("error", "yolo_io", F.col("error").isNotNull(), F.concat(F.lit("label file "), F.col("error")))], subject, path, keep)


def label_line_rules(lines: DataFrame, limits: Limits = Limits(), keep: Sequence[str] = (), subject: Column | None = None, path: Column | None = None) -> DataFrame:
    """Rules on parsed label lines (parse_label_tokens) with image size iw, ih."""
    subject = F.concat(F.lit("line "), F.col("line_no").cast("string")) if subject is None else subject
    path = F.lit(None) if path is None else path
    parts = [F.col(n) for n in ("cx", "cy", "bw", "bh")]
    cx, cy, w, h = parts
    five = F.size("tokens") == 5
    has_class = five & F.col("class_id").isNotNull()
    parsed = has_class & cx.isNotNull() & cy.isNotNull() & w.isNotNull() & h.isNotNull()
    # As above: shared conditions are columns.
    lines = lines.withColumns({"__five": five, "__class": has_class, "__parsed": parsed, "__frac": w * h})
    five, has_class, parsed, frac = (F.col(f"__{n}") for n in ("five", "class", "parsed", "frac"))
    lines = lines.withColumn("__fin", parsed & finite(cx) & finite(cy) & finite(w) & finite(h))
    fin = F.col("__fin")
    pixel_area = frac * F.col("iw").cast("double") * F.col("ih").cast("double")
    eps = K.BBOX_EDGE_EPS
    outside = (cx - w / 2.0 < -eps) | (cy - h / 2.0 < -eps) | (cx + w / 2.0 > 1.0 + eps) | (cy + h / 2.0 > 1.0 + eps)
    component = [
        issue("error", "yolo_nan", parsed & ~finite(c), f"label value {n} is not finite") for n, c in zip(("cx", "cy", "w", "h"), parts)
    ]
    return emit(
        lines,
        [
            issue("error", "yolo_bad_line", ~five, "label line does not have five tokens"),
            issue("error", "yolo_class", five & ~has_class, "class id is not an integer"),
            issue("error", "yolo_parse", has_class & ~parsed, "label coordinate is not a number"),
            *component,
            issue("error", "yolo_nonpos_wh", fin & ((w <= 0) | (h <= 0)), "label width or height is not positive"),
            issue("warning", "yolo_huge_frac", fin & (frac >= limits.max_bbox_area_frac), "label covers nearly the whole image"),
            issue("error", "yolo_small_area", fin & (pixel_area + 1e-12 < float(limits.min_bbox_area_pixels)), "label area is below the minimum"),
            issue("warning", "yolo_oob_norm", fin & outside, "label leaves the image"),
        ],
        subject,
        path,
        keep,
    )


def countable_labels(lines: DataFrame) -> DataFrame:
    """Label lines that count towards the class histogram: five tokens and an integer class."""
    return lines.filter((F.size("tokens") == 5) & F.col("class_id").isNotNull())


# ---------------------------------------------------------------- pairing of files


def pairing_rules(frames: DataFrame, images: DataFrame, check_meta: bool = False, keys: Sequence[str] = (), name: str = "file_name") -> DataFrame:
    """Rules on scanned frame images: catalogue membership and sidecars.

    frames: file_name, path, has_txt, has_meta and hdr_w/hdr_h if headers were read. A frame without a label gets no
    further checks.
    """
    names = A.registered_images(images).select(*keys, F.col("file_name").alias(name), F.lit(True).alias("__known")).distinct()
    rows = frames.join(names, [*keys, name], "left")
    labelled = F.col("has_txt")
    rules = [
        issue("warning", "png_not_in_coco", F.col("__known").isNull(), "image is not in the annotation document"),
        issue("error", "yolo_missing", ~labelled, "image has no label file"),
    ]
    if check_meta:
        rules.append(issue("error", "meta_missing", labelled & ~F.col("has_meta"), "image has no meta file"))
    if "hdr_w" in frames.columns:
        rules.append(issue("warning", "png_ihdr", labelled & F.col("hdr_w").isNull(), "image header is not readable; labels not checked"))
    path = F.col("path") if "path" in frames.columns else F.lit(None)
    return emit(rows, rules, F.col(name), path, keys)


# ---------------------------------------------------------------- frame metadata documents

META_REQUIRED = ("frame_id", "split", "image_width", "image_height", "camera_extrinsics", "camera_intrinsics", "convention", "render", "camera", "sun", "objects")
META_OBJECT_REQUIRED = ("instance_id", "local_to_world_row_major", "position", "rotation_deg", "scale")
META_OBJECT_VECTORS = ("position", "rotation_deg", "scale")


def _bad(message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit("error").alias("severity"), F.lit("meta_schema").alias("code"), text.alias("message"))


def _not_finite_positions(v: Column, label) -> Column:
    """Issues for the elements of an array variant that are not finite numbers."""
    marked = F.transform(J.items(v), lambda x, i: F.when(~J.is_finite_number(x), _bad(label(i))))
    return F.filter(marked, lambda x: x.isNotNull())


def _object_issues(entry: Column, i: Column) -> Column:
    """Issues of one objects[] entry, given as struct(v, ok) with ok = it is an object."""
    ob, ok = entry["v"], entry["ok"]
    at = F.concat(F.lit("objects["), i.cast("string"), F.lit("]"))
    matrix = J.field(ob, "local_to_world_row_major")
    flags = [F.when(~ok, _bad(F.concat(at, F.lit(" is not an object"))))]
    flags += [F.when(ok & J.field(ob, k).isNull(), _bad(F.concat(at, F.lit(f" lacks '{k}'")))) for k in META_OBJECT_REQUIRED]
    short = F.coalesce(F.size(J.items(matrix)) != 16, F.lit(True))
    flags.append(F.when(matrix.isNotNull() & short, _bad(F.concat(at, F.lit(".local_to_world_row_major is not 16 values")))))
    for k in META_OBJECT_VECTORS:
        v = J.field(ob, k)
        flags.append(F.when(v.isNotNull() & F.coalesce(F.size(J.items(v)) != 3, F.lit(True)), _bad(F.concat(at, F.lit(f".{k} is not 3 values")))))
    here = F.filter(F.array(*flags), lambda x: x.isNotNull())
    cells = F.when(~short, _not_finite_positions(matrix, lambda j: F.concat(at, F.lit(".local_to_world_row_major["), j.cast("string"), F.lit("] is not finite"))))
    return F.concat(here, F.coalesce(cells, F.array().cast(_NO_ISSUES)))


def meta_rules(docs: DataFrame, text: str = "text", keep: Sequence[str] = (), subject: Column | None = None, path: Column | None = None) -> DataFrame:
    """Rules on frame metadata texts. Members and their types are columns, so a document is taken apart once."""
    subject = (F.col("path") if "path" in docs.columns else F.lit(None)) if subject is None else subject
    path = (F.col("path") if "path" in docs.columns else F.lit(None)) if path is None else path
    d = docs.withColumn("__v", J.parse(text))
    d = d.withColumns({"__obj": J.is_object(F.col("__v")), **{f"__f_{k}": J.field(F.col("__v"), k) for k in META_REQUIRED}})
    at = {k: F.col(f"__f_{k}") for k in META_REQUIRED}
    d = d.withColumns(
        {
            **{f"__o_{k}": J.is_object(at[k]) for k in ("camera_intrinsics", "render", "camera", "sun")},
            "__short": F.coalesce(F.size(J.items(at["camera_extrinsics"])) != 16, F.lit(True)),
            "__list": J.is_array(at["objects"]),
            "__objs": F.transform(J.items(at["objects"]), lambda x: F.struct(x.alias("v"), J.is_object(x).alias("ok"))),
            **{f"__k_{k}": J.field(at["camera_intrinsics"], k) for k in ("fx", "fy", "cx", "cy")},
        }
    )
    v, obj, short = F.col("__v"), F.col("__obj"), F.col("__short")
    ext, intr, inner = at["camera_extrinsics"], at["camera_intrinsics"], {k: F.col(f"__k_{k}") for k in ("fx", "fy", "cx", "cy")}

    def bad(cond: Column, message: str) -> Column:
        return issue("error", "meta_schema", cond, message)

    rules = [
        issue("error", "meta_json", v.isNull(), "document is not valid JSON"),
        bad(v.isNotNull() & ~obj, "document root is not an object"),
        *[bad(obj & at[k].isNull(), f"missing field '{k}'") for k in META_REQUIRED],
        bad(obj & ext.isNotNull() & short, "camera_extrinsics is not a list of 16 values"),
        bad(obj & intr.isNotNull() & ~F.col("__o_camera_intrinsics"), "camera_intrinsics is not an object"),
        *[bad(obj & F.col("__o_camera_intrinsics") & c.isNull(), f"camera_intrinsics lacks '{k}'") for k, c in inner.items()],
        *[bad(obj & c.isNotNull() & ~J.is_finite_number(c), f"camera_intrinsics.{k} is not a finite number") for k, c in inner.items()],
        *[bad(obj & at[k].isNotNull() & ~J.integral_number(at[k]), f"{k} is not an integral number") for k in ("frame_id", "image_width", "image_height")],
        bad(obj & at["split"].isNotNull() & ~J.is_string(at["split"]), "split is not a string"),
        *[bad(obj & at[k].isNotNull() & ~F.col(f"__o_{k}"), f"'{k}' is not an object") for k in ("render", "camera", "sun")],
        bad(obj & at["objects"].isNotNull() & ~F.col("__list"), "objects is not an array"),
    ]
    cells = F.when(obj & ~short, _not_finite_positions(ext, lambda i: F.concat(F.lit("camera_extrinsics["), i.cast("string"), F.lit("] is not finite"))))
    per_object = F.when(obj, F.flatten(F.transform("__objs", _object_issues)))
    return emit(d, rules, subject, path, keep, more=[cells, per_object])


# ---------------------------------------------------------------- manifests


def normal_path(p: Column | str, cwd: str = "/") -> Column:
    """Absolute path without scheme, doubled slashes, '.' parts and trailing slash; symlinks are not followed."""
    p = F.regexp_replace(col(p), r"^file:(?://)?", "")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), p))
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    # '..' takes back the part before it.
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def manifest_rules(docs: DataFrame, root: str, strict: bool = False, cwd: str = "/") -> DataFrame:
    """Recorded roots against the dataset root; docs: path, text."""
    v = F.col("__v")
    hints = F.array(
        J.text_of(F.try_variant_get(v, "$.dataset_layout.dataset_root", "variant")),
        J.text_of(F.try_variant_get(v, "$.config_audit.resolved_config.dataset.root", "variant")),
    )
    want = normal_path(F.lit(root), cwd)
    severity = "error" if strict else "warning"
    rows = docs.withColumn("__v", J.parse("text"))
    unreadable = emit(rows, [issue("error", "manifest_io", v.isNull(), "manifest is not valid JSON")], F.col("path"), F.col("path"))
    hinted = rows.withColumn("__h", F.explode(hints)).filter(F.length(F.trim("__h")) > 0)
    differs = emit(
        hinted, [issue(severity, "manifest_root_mismatch", normal_path("__h", cwd) != want, F.concat(F.lit("manifest records root "), F.col("__h")))],
        F.col("__h"), F.col("path"),
    )
    return unreadable.unionByName(differs)


# ---------------------------------------------------------------- rollups


def issue_rollup(issues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return issues.groupBy(*keys, "severity", "code").agg(F.count(F.lit(1)).alias("n"))


def exit_code(issues: DataFrame, keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """1 with any error, or with any warning when strict; else 0. Without keys always one row."""
    failing = F.col("severity") == "error"
    if strict:
        failing = failing | (F.col("severity") == "warning")
    return issues.groupBy(*keys).agg(F.when(F.coalesce(F.bool_or(failing), F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("int").alias("exit_code"))


def validation_stats(images: DataFrame, resolved: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct image ids referenced and kept images that exist."""
    referenced = A.registered_images(images).groupBy(*keys).agg(F.count_distinct("image_id").alias("coco_images_referenced"))
    checked = resolved.groupBy(*keys).agg(F.count_if(F.col("hits") == 1).alias("coco_images_checked_existing"))
    if keys:
        return referenced.join(checked, list(keys), "left")
    # Two one-row aggregates side by side.
    return referenced.withColumn("__one", F.lit(1)).join(checked.withColumn("__one", F.lit(1)), "__one").drop("__one")
