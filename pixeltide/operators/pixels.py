"""Pixel tables: frame arrays to long form, id mapping, boxes from instance masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide import constants as K
from pixeltide.functions import masks
from pixeltide.functions.columns import col, dbl

CHANNELS = ("depth", "instance_id", "normal_x", "normal_y", "normal_z", "flow_x", "flow_y")


def explode_frames(frames: DataFrame, channels=CHANNELS, keep=("run_id", "frame_id")) -> DataFrame:
    """One row per pixel from one row per frame; ``width`` gives the row stride.

    Missing flow channels read as zero. Channels go by name. A later groupBy on frame keys combines map-side, so
    the exploded pixels themselves are not shuffled.
    """
    have = [c for c in channels if c in frames.columns]
    lost = [c for c in channels if c not in frames.columns]
    if bad := [c for c in lost if not c.startswith("flow_")]:
        raise ValueError(f"frame table lacks channels {bad}")
    keep = [k for k in keep if k in frames.columns]
    px = frames.select(*keep, "width", F.posexplode(F.arrays_zip(*have)).alias("pos", "__p"))
    out = px.select(
        *keep,
        F.floor(F.col("pos") / F.col("width")).cast("int").alias("px_row"),
        (F.col("pos") % F.col("width")).cast("int").alias("px_col"),
        *[F.col(f"__p.{c}").alias(c) for c in have],
    )
    for c in channels:
        if c.startswith("flow_"):
            value = F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)
            out = out.withColumn(c, value.cast("float"))
    if "instance_id" in have:
        out = out.withColumn("instance_id", F.bround(F.col("instance_id").cast("double")).cast("bigint"))
    return out


def channel_shapes(frames: DataFrame, channels=CHANNELS) -> DataFrame:
    """(run, frame, channel, width, height) of the channels a frame table carries."""
    have = [c for c in channels if c in frames.columns]
    keys = [k for k in ("run_id", "frame_id") if k in frames.columns]
    return frames.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("channel"),
                        F.col("width").cast("int").alias("width"),
                        F.floor(F.size(c) / F.col("width")).cast("int").alias("height"),
                    )
                    for c in have
                ]
            )
        ).alias("s"),
    ).select(*keys, "s.*")


def last_entry(objects: DataFrame, keys, payload, order: str) -> DataFrame:
    """Last entry per keys, as a dictionary filled in order would keep it."""
    agg = objects.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(order)).alias("__last"))
    return agg.select(*keys, *[F.col(f"__last.{p}").alias(p) for p in payload])


def pixel_class(pixels: DataFrame, objects: DataFrame, keys=("frame_id",), order: str = "ord") -> DataFrame:
    """class_id per pixel; unknown ids and background are 0. Float ids are rounded half to even.

    A plain left join: the optimizer broadcasts the id table if its measured size allows and splits skewed frames.
    """
    known = last_entry(objects, [*keys, "instance_id"], ["class_id"], order)
    known = known.withColumnRenamed("instance_id", "__id")
    px = pixels.withColumn("__id", F.bround(dbl("instance_id")).cast("bigint"))
    joined = px.join(known.withColumn("__id", F.col("__id").cast("bigint")), [*keys, "__id"], "left")
    return joined.withColumn("class_id", F.coalesce("class_id", F.lit(0)).cast("int")).drop("__id")


def frame_classes(frames: DataFrame, objects: DataFrame, keys=("frame_id",), order: str = "ord") -> DataFrame:
    """Adds the array class_id to frames with an instance_id array: pixel_class at the level of frames.

    A frame's registry becomes one map on the frame's row, so the join moves frames and never pixels.
    """
    keys = list(keys)
    known = last_entry(objects, [*keys, "instance_id"], ["class_id"], order)
    entry = F.struct(F.col("instance_id").cast("bigint").alias("id"), F.col("class_id").cast("int").alias("class_id"))
    maps = known.filter("instance_id is not null").groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("__classes"))
    of = lambda x: F.coalesce(F.try_element_at("__classes", F.bround(x.cast("double")).cast("bigint")), F.lit(0))
    return frames.join(maps, keys, "left").withColumn("class_id", F.transform("instance_id", of)).drop("__classes")


def boxes_from_mask(pixels: DataFrame, keys=("frame_id",), row="px_row", column="px_col") -> DataFrame:
    """Tight inclusive box per frame and instance; id 0 is background. Depth plays no part."""
    return (
        pixels.filter(col("instance_id") != 0)
        .groupBy(*keys, "instance_id")
        .agg(
            F.min(column).alias("x0"), F.min(row).alias("y0"), F.max(column).alias("x1"), F.max(row).alias("y1")
        )
    )


def attach_registry(boxes: DataFrame, objects: DataFrame, keys=("frame_id",), order: str = "ord") -> DataFrame:
    """class (default 0) and label (default 'unknown') of each box."""
    known = last_entry(objects, [*keys, "instance_id"], ["class_id", "label"], order)
    out = boxes.join(known, [*keys, "instance_id"], "left")
    return out.withColumns(
        {
            "class_id": F.coalesce("class_id", F.lit(0)).cast("int"),
            "label": F.coalesce("label", F.lit("unknown")),
        }
    )


def normalized_boxes(boxes: DataFrame, width: Column | str, height: Column | str) -> DataFrame:
    """Pixel xywh + area and normalized centre/size of inclusive boxes; empty boxes are dropped."""
    w = (col("x1") - col("x0") + 1).cast("int")
    h = (col("y1") - col("y0") + 1).cast("int")
    iw, ih = dbl(width), dbl(height)
    return boxes.filter((w > 0) & (h > 0)).withColumns(
        {
            "bx": dbl("x0"), "by": dbl("y0"), "bw": w.cast("double"), "bh": h.cast("double"),
            "area": w * h,
            "cx_n": (col("x0") + col("x1") + 1) * 0.5 / iw,
            "cy_n": (col("y0") + col("y1") + 1) * 0.5 / ih,
            "w_n": w / iw,
            "h_n": h / ih,
        }
    )


def first_category(boxes: DataFrame) -> DataFrame:
    """First label seen per class, in (frame, instance) order."""
    order = F.struct("frame_id", "instance_id")
    return boxes.groupBy("class_id").agg(F.min_by("label", order).alias("name"))


def check_f32_ids(pixels: DataFrame) -> DataFrame:
    """Fails the job on ids a float32 channel cannot hold."""
    ok = col("instance_id") <= K.MAX_F32_ID
    checked = F.when(ok, col("instance_id")).otherwise(F.raise_error(F.lit("instance id above float32 range")).cast("bigint"))
    return pixels.withColumn("instance_id", checked)


def mask_filter(pixels: DataFrame, name: str) -> DataFrame:
    """Rows passing one of the named masks: cloud, train, sky, sky_coverage, foreground."""
    conds = {
        "cloud": masks.cloud(),
        "train": masks.train(),
        "sky": masks.sky(),
        "sky_coverage": masks.sky(threshold=K.SKY_DEPTH_COVERAGE),
        "foreground": masks.foreground(),
    }
    return pixels.filter(conds[name])
