"""Sinks for labels, boxes, clouds and frame metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide import constants as K
from pixeltide.functions import masks
from pixeltide.functions.columns import Vec, col, vec
from pixeltide.functions.geometry import intrinsics, object_matrix, transform_supervision
from pixeltide.operators import annotations as A
from pixeltide.sinks.storage import open_read, replacing
from pixeltide.sinks.textfiles import write_text_files


def _one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", c)


def coco_lines(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(section, ord, value) lines of an annotation document, one element per line.

    Ids follow document order; the first of a section has no comma before it, whatever its id. Boxes print with one decimal.
    """
    lit = F.lit

    def fixed(section: int, text: str) -> DataFrame:
        spark = images.sparkSession
        return spark.range(1).select(lit(section).alias("section"), lit(0).cast("bigint").alias("ord"), lit(text).alias("value"))

    def comma(first: Column) -> Column:
        return F.when(first, lit("")).otherwise(lit(","))

    def with_low(df: DataFrame, key: str) -> DataFrame:
        """Adds the smallest id, which opens its section: a one-row side, whatever the ids start with."""
        low = df.agg(F.min(key).alias("__low"))
        return df.join(F.broadcast(low), F.col(key) >= F.col("__low"))

    im = with_low(images, "image_id").select(
        lit(1).alias("section"), F.col("image_id").cast("bigint").alias("ord"),
        F.concat(comma(F.col("image_id") == F.col("__low")), F.to_json(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height"))).alias("value"),
    )
    box = F.concat(lit("["), F.concat_ws(",", *[_one_decimal(F.col(c)) for c in ("bx", "by", "bw", "bh")]), lit("]"))
    head = F.format_string('{"id":%d,"image_id":%d,"category_id":%d,"bbox":', F.col("ann_id"), F.col("image_id"), F.col("category_id"))
    tail = F.to_json(F.struct(lit(0).alias("iscrowd"), F.col("area").cast("bigint").alias("area"), "instance_id", "label"))
    an = with_low(annotations, "ann_id").select(
        lit(3).alias("section"), F.col("ann_id").cast("bigint").alias("ord"),
        F.concat(comma(F.col("ann_id") == F.col("__low")), head, box, lit(","), F.substring(tail, 2, 1 << 30)).alias("value"),
    )
    ca = with_low(categories, "category_id").select(
        lit(5).alias("section"), F.col("category_id").cast("bigint").alias("ord"),
        F.concat(comma(F.col("category_id") == F.col("__low")), F.to_json(F.struct(F.col("category_id").alias("id"), "name"))).alias("value"),
    )
    parts = [fixed(0, '{"images":['), im, fixed(2, '],"annotations":['), an, fixed(4, '],"categories":['), ca, fixed(6, "]}")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """Annotation document as a folder of ordered text parts; their concatenation is the document.

    Lines are range-sorted, so no task sees the whole document. assemble() joins the parts into one file.
    """
    lines = coco_lines(images, annotations, categories)
    lines.orderBy("section", "ord").select("value").write.mode("overwrite").text(path)


def merged_lines(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(section, ord, value) lines of one document from shard elements (sources.files.read_coco_members), and issue rows.

    Images and annotations are numbered anew from 1 in (shard, position) order and references follow; the first definition of a
    category counts. Every other member of an element stays as it is. Annotations of unknown images become issues, not lines.
    """
    of = lambda s: members.filter(F.col("section") == s)
    im = A.renumber(of("images").withColumnRenamed("image_id", "__none").withColumnRenamed("id", "image_id"), ["shard_order", "pos"])
    an = A.remap_image_ids(A.renumber(of("annotations"), ["shard_order", "pos"]), im, strict=False)
    cats = of("categories").filter("id is not null").groupBy("id").agg(F.min_by("members", F.struct("shard_order", "pos")).alias("members"))

    def text(**new: str) -> Column:
        # A new number takes the old one's place, so an element keeps the order it was written in.
        numbers = {k: F.parse_json(F.col(c).cast("string")) for k, c in new.items()}

        def value(key: Column, old: Column) -> Column:
            for k, n in numbers.items():
                old = F.when(key == k, n).otherwise(old)
            return old

        return F.to_json(F.transform_values("members", value))

    parts = [
        (1, im.select(F.col("new_id").alias("ord"), text(id="new_id").alias("t"))),
        (3, an.filter("new_image_id is not null").select(F.col("new_id").alias("ord"), text(id="new_id", image_id="new_image_id").alias("t"))),
        (5, cats.select(F.col("id").alias("ord"), F.to_json("members").alias("t"))),
    ]
    spark = members.sparkSession
    fixed = spark.createDataFrame([(0, 0, '{"images":['), (2, 0, '],"annotations":['), (4, 0, '],"categories":['), (6, 0, "]}")], "section int, ord bigint, value string")
    for section, rows in parts:
        # A one-row side: the smallest number of the section, which opens it.
        low = rows.agg(F.min("ord").alias("__low"))
        opened = rows.join(F.broadcast(low), F.col("ord") >= F.col("__low"))
        value = F.concat(F.when(F.col("ord") == F.col("__low"), F.lit("")).otherwise(F.lit(",")), "t")
        fixed = fixed.unionByName(opened.select(F.lit(section).alias("section"), F.col("ord").cast("bigint").alias("ord"), value.alias("value")))
    return fixed, A.unresolved(an)


def write_merged(members: DataFrame, path: str) -> DataFrame:
    """Writes the merged document as ordered text parts (see assemble) and returns the issue rows."""
    lines, issues = merged_lines(members)
    lines.orderBy("section", "ord").select("value").write.mode("overwrite").text(path)
    return issues


def assemble(folder: str, target: str, block: int = 1 << 20) -> None:
    """Concatenate the part files of a local or Arrow-readable folder, block by block."""
    from pyarrow import fs

    from pixeltide.sinks.storage import locate

    system, p = locate(folder)
    parts = sorted(f.path for f in system.get_file_info(fs.FileSelector(p)) if f.base_name.startswith("part-"))
    scheme = folder[: len(folder) - len(p)] if folder.endswith(p) and not folder.startswith("/") else ""
    with replacing(target) as out:
        for part in parts:
            with open_read(scheme + part) as src:
                while chunk := src.read(block):
                    out.write(chunk)


def write_yolo(boxes: DataFrame, frames: DataFrame, base: str, keys: Sequence[str] = ("frame_id",)) -> int:
    """One label file per frame at frames.label_path; frames without boxes get an empty file."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f\n", F.col("class_id").cast("bigint"), "cx_n", "cy_n", "w_n", "h_n")
    rows = frames.select(*keys, F.col("label_path").alias("path")).join(boxes, list(keys), "left")
    rows = rows.select("path", F.coalesce("instance_id", F.lit(0)).alias("ord"), F.when(F.col("class_id").isNotNull(), line).otherwise(F.lit("")).alias("text"))
    return write_text_files(rows, base, ["ord"])


BOX_COLUMNS = ("instance_id", "class_id", "label", "xmin", "ymin", "xmax", "ymax", "width", "height")


def _box_rows(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    return boxes.withColumns(
        {"xmin": F.col("x0"), "ymin": F.col("y0"), "xmax": F.col("x1"), "ymax": F.col("y1"), "width": width, "height": height}
    )


def write_boxes_csv(boxes: DataFrame, path: str, width: Column, height: Column, keys: Sequence[str] = ("frame_id",)) -> None:
    _box_rows(boxes, width, height).select(*keys, *BOX_COLUMNS).write.mode("overwrite").option("header", "true").csv(path)


def write_boxes_json(boxes: DataFrame, base: str, width: int, height: int, name: Column, keys: Sequence[str] = ("frame_id",)) -> int:
    """One JSON document per frame: image size and boxes. ``name`` gives the file of a frame."""
    rows = _box_rows(boxes, F.lit(width), F.lit(height)).withColumn("path", name)
    first = rows.groupBy("path").agg(F.min("instance_id").alias("__first"))
    body = F.to_json(F.struct("instance_id", "class_id", "label", "xmin", "ymin", "xmax", "ymax"))
    sep = F.when(F.col("instance_id") == F.col("__first"), F.lit("\n")).otherwise(F.lit(",\n"))
    items = rows.join(first, "path").select("path", F.lit(1).alias("section"), F.col("instance_id").cast("bigint").alias("ord"), F.concat(sep, F.lit("    "), body).alias("text"))
    zero = F.lit(0).cast("bigint").alias("ord")
    head = first.select("path", F.lit(0).alias("section"), zero, F.lit(f'{{\n  "image_width": {width},\n  "image_height": {height},\n  "boxes": [').alias("text"))
    tail = first.select("path", F.lit(2).alias("section"), zero, F.lit("\n  ]\n}\n").alias("text"))
    return write_text_files(items.unionByName(head).unionByName(tail), base, ["section", "ord"])


# Header of an ASCII point file between the vertex count and the data (fixed format).
_PLY_HEAD = (
    "property float x\nproperty float y\nproperty float z\n"
    "property uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
)


def write_ply(points: DataFrame, base: str, name: Column, keys: Sequence[str] = ("frame_id",)) -> int:
    """One ASCII point file per frame from x, y, z and r, g, b in [0, 1]; the header carries the exact count."""
    pts = points.withColumn("path", name)
    counts = pts.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    u8 = [masks.unit_to_rgb(c).cast("string") for c in ("r", "g", "b")]
    line = F.concat(F.concat_ws(" ", *[F.col(a).cast("string") for a in "xyz"], *u8), F.lit("\n"))
    body = pts.select("path", F.lit(1).alias("section"), "px_row", "px_col", line.alias("text"))
    head = counts.select(
        "path", F.lit(0).alias("section"), F.lit(0).alias("px_row"), F.lit(0).alias("px_col"),
        F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n").cast("string"), F.lit("\n" + _PLY_HEAD)).alias("text"),
    )
    return write_text_files(body.unionByName(head), base, ["section", "px_row", "px_col"])


def with_object_matrices(objects: Column | str) -> Column:
    """Objects array with transform_supervision and local_to_world_row_major filled in."""

    def one(o: Column) -> Column:
        v3 = {k: Vec(*[o[k][i] for i in range(3)]) for k in ("rotation_deg", "scale", "position")}
        return F.struct(
            *[o[k].alias(k) for k in ("instance_id", "class_id", "label", "position", "rotation_deg", "scale", "roughness", "metallic", "grounding_constraint", "terrain_normal")],
            transform_supervision(o["grounding_constraint"]).alias("transform_supervision"),
            object_matrix(v3["rotation_deg"], v3["scale"], v3["position"]).alias("local_to_world_row_major"),
        )

    return F.transform(col(objects), one)


def frame_meta_json(frames: DataFrame) -> DataFrame:
    """Adds meta_json to frame rows: frame_id, split, w, h, vfov, c2w, e*, a*, up*, focus_dist, sun_az, sun_el,
    spp_target, spp_avg, max_depth, seed, objects."""
    k = intrinsics("w", "h", "vfov")
    lit = F.lit
    doc = F.struct(
        "frame_id", "split", F.col("w").alias("image_width"), F.col("h").alias("image_height"),
        F.struct(
            lit(K.META_CAMERA_TO_WORLD).alias("camera_to_world"), lit(K.META_HANDEDNESS).alias("handedness"), lit(K.META_OBJECT_NOTE).alias("object_transform_note")
        ).alias("convention"),
        F.col("c2w").alias("camera_extrinsics"),
        F.struct(*[k[n].alias(n) for n in ("fx", "fy", "cx", "cy")], F.col("vfov").alias("vfov_deg"), lit(0).alias("skew"), lit(K.META_PIXEL_RAY).alias("pixel_ray")).alias("camera_intrinsics"),
        F.struct("spp_target", "spp_avg", "max_depth", "seed").alias("render"),
        F.struct(
            F.array(*vec("e")).alias("lookfrom"), F.array(*vec("a")).alias("lookat"), F.array(*vec("up")).alias("up"), F.col("vfov").alias("fov_deg"), "focus_dist"
        ).alias("camera"),
        F.struct(F.col("sun_az").alias("azimuth_deg"), F.col("sun_el").alias("elevation_deg")).alias("sun"),
        with_object_matrices("objects").alias("objects"),
    )
    return frames.withColumn("meta_json", F.to_json(doc))


def write_frame_meta(frames: DataFrame, base: str) -> int:
    """One metadata file per frame at frames.meta_path."""
    rows = frame_meta_json(frames).select(F.col("meta_path").alias("path"), F.lit(0).alias("ord"), F.concat("meta_json", F.lit("\n")).alias("text"))
    return write_text_files(rows, base, ["ord"])
