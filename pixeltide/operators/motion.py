"""Previous cameras, optical flow and flow coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide import constants as K
from pixeltide.functions import masks
from pixeltide.functions.columns import Vec, dbl, vec
from pixeltide.functions.geometry import with_camera_basis, with_intrinsics
from pixeltide.operators import ordered
from pixeltide.operators.pixels import explode_frames

POSE = [p + a for p in ("e", "u", "v", "w") for a in "xyz"]


def with_pose(cams: DataFrame) -> DataFrame:
    """Basis and intrinsics for camera rows (w, h, vfov, eye e*, target a*). u*, v*, w* are unit axes."""
    return with_intrinsics(with_camera_basis(cams, vec("e"), vec("a")))


def previous_camera(
    cams: DataFrame,
    payload: Sequence[str],
    run_keys: Sequence[str] = ("run_id",),
    index: str = "g",
    num_shards: int = 1,
    width: int = ordered.CHUNK,
) -> DataFrame:
    """Adds struct ``prev`` with the payload of the previous frame; the first frame gets its own.

    With num_shards > 1 "previous" means the last frame of the same shard (g - num_shards), as when every shard is
    produced by its own process.
    """
    keys = list(run_keys)
    if num_shards > 1:
        cams = cams.withColumn("shard", F.pmod(F.col(index), F.lit(num_shards)).cast("int"))
        keys.append("shard")
    out = ordered.neighbour(cams, keys, [index], ordered.chunk_of(index, width), payload, "prev")
    return out.withColumn("prev", F.coalesce("prev", F.struct(*payload)))


def flow_columns(depth, column, row, prev: Vec, pu: Vec, pv: Vec, pw: Vec) -> dict[str, Column]:
    """Previous minus current pixel position; zero for sky and for points behind the previous camera.

    Expects the current camera as e*, u*, v*, w* with intrinsics fx, fy, cx, cy and size w, h. The current
    intrinsics are used for both cameras.
    """
    x = F.when(F.col("w") > 1, (dbl(column) - F.col("cx")) / F.col("fx")).otherwise(F.lit(0.0))
    y = F.when(F.col("h") > 1, (F.col("cy") - dbl(row)) / F.col("fy")).otherwise(F.lit(0.0))
    ray = vec("u").times(x).plus(vec("v").times(y)).minus(vec("w"))
    scale = dbl(depth) / ray.length()
    d = vec("e").plus(ray.times(scale)).minus(prev)
    z = -d.dot(pw)
    seen = (F.col("depth") < K.SKY_DEPTH_FLOW) & (z > 0)
    zs = F.when(seen, z)
    u_prev = F.col("fx") * d.dot(pu) / zs + F.col("cx")
    v_prev = -F.col("fy") * d.dot(pv) / zs + F.col("cy")
    zero = F.lit(0.0)
    return {
        "flow_x": F.when(seen, u_prev - dbl(column)).otherwise(zero),
        "flow_y": F.when(seen, v_prev - dbl(row)).otherwise(zero),
    }


def optical_flow(pixels: DataFrame, cams: DataFrame, keys=("frame_id",)) -> DataFrame:
    """Adds flow_x, flow_y to pixels; cams carry pose (with_pose) and ``prev`` (previous_camera)."""
    prev = [F.col(f"prev.{n}").alias(f"p{n}") for n in POSE]
    side = cams.select(*keys, "w", "h", "fx", "fy", "cx", "cy", *POSE, *prev)
    joined = pixels.join(side, list(keys))
    flow = flow_columns("depth", "px_col", "px_row", vec("pe"), vec("pu"), vec("pv"), vec("pw"))
    return joined.withColumns(flow).select(*pixels.columns, "flow_x", "flow_y")


def frame_flow(frames: DataFrame, cams: DataFrame, keys=("frame_id",)) -> DataFrame:
    """optical_flow from frame arrays (width, depth): keys, px_row, px_col, depth, flow_x, flow_y.

    The camera joins the frame's row and the pixels unfold after it, so whatever the size of the camera table, no pixel is shuffled.
    """
    keys = list(keys)
    side = cams.select(*keys, "w", "h", "fx", "fy", "cx", "cy", *POSE, *[F.col(f"prev.{n}").alias(f"p{n}") for n in POSE])
    given = [c for c in side.columns if c not in keys]
    px = explode_frames(frames.select(*keys, "width", "depth").join(side, keys), channels=("depth",), keep=[*keys, *given])
    flow = flow_columns("depth", "px_col", "px_row", vec("pe"), vec("pu"), vec("pv"), vec("pw"))
    return px.withColumns(flow).select(*keys, "px_row", "px_col", "depth", "flow_x", "flow_y")


def flow_coverage(pixels: DataFrame, keys=("frame_id",), magnitude: float = 0.1, floor: float = 0.10) -> DataFrame:
    """Share of non-sky pixels that move more than ``magnitude``; null share where all is sky."""
    visible = ~masks.sky(threshold=K.SKY_DEPTH_COVERAGE)
    mag = F.sqrt(dbl("flow_x") * dbl("flow_x") + dbl("flow_y") * dbl("flow_y"))
    agg = pixels.groupBy(*keys).agg(
        F.count_if(visible).alias("visible"), F.count_if(visible & (mag > magnitude)).alias("moving")
    )
    share = F.col("moving") / F.nullif(F.col("visible"), F.lit(0).cast("bigint"))
    return agg.withColumn("fraction", share).withColumn("ok", F.col("fraction") >= floor)
