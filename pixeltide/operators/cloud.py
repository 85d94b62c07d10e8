"""World-space point clouds, sampling, projection audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixeltide.functions import masks
from pixeltide.functions.columns import Vec, dbl, finite, hash_uniform, vec
from pixeltide.functions.geometry import apply_point, intrinsics, pixel_ray, project_camera_point, translation, with_affine_inverse
from pixeltide.operators.pixels import explode_frames


def camera_to_world_ray(ray: Vec, u: Vec, v: Vec, w: Vec) -> Vec:
    """Rotation with columns u, -v, -w applied to a camera-space direction."""
    return u.times(ray.x).minus(v.times(ray.y)).minus(w.times(ray.z))


def world_point(depth, column, row, v_axis: str = "t_up") -> Vec:
    """origin + depth * unit ray for camera columns e*, u*, v*, w*, fx, fy, cx, cy. Depth is radial."""
    ray = pixel_ray(column, row, "fx", "fy", "cx", "cy", v_axis)
    return vec("e").plus(camera_to_world_ray(ray, vec("u"), vec("v"), vec("w")).times(dbl(depth)))


def strict_depth(depth) -> Column:
    """Depth that must be positive and finite; anything else fails the row's job."""
    ok = finite(depth) & (dbl(depth) > 0)
    return F.when(ok, dbl(depth)).otherwise(F.raise_error(F.lit("depth must be positive finite")).cast("double"))


def point_cloud(pixels: DataFrame, cams: DataFrame, keys=("frame_id",), mask: Column | None = None, v_axis: str = "t_up") -> DataFrame:
    """Adds x, y, z for valid pixels. The mask has no upper bound by default, so misses stay in."""
    mask = masks.cloud() if mask is None else mask
    side = cams.select(*keys, "fx", "fy", "cx", "cy", *[p + a for p in "euvw" for a in "xyz"])
    joined = pixels.filter(mask).join(side, list(keys))
    p = world_point("depth", "px_col", "px_row", v_axis)
    return joined.withColumns(p.as_columns("")).select(*pixels.columns, "x", "y", "z")


def frame_cloud(frames: DataFrame, cams: DataFrame, keys=("frame_id",), mask: Column | None = None, v_axis: str = "t_up") -> DataFrame:
    """point_cloud from frame arrays (width, depth): the camera joins the frame's row, pixels unfold after it and are not shuffled."""
    keys = list(keys)
    given = ["fx", "fy", "cx", "cy", *[p + a for p in "euvw" for a in "xyz"]]
    joined = frames.select(*keys, "width", "depth").join(cams.select(*keys, *given), keys)
    px = explode_frames(joined, channels=("depth",), keep=[*keys, *given]).filter(masks.cloud() if mask is None else mask)
    return px.withColumns(world_point("depth", "px_col", "px_row", v_axis).as_columns("")).select(*keys, "px_row", "px_col", "depth", "x", "y", "z")


def subsample(
    points: DataFrame, k: int, seed: int = 0, keys=("frame_id",), row_keys=("px_row", "px_col"), portable: bool = False
) -> DataFrame:
    """At most k points per frame, uniform without replacement, same rows under any partitioning.

    The engine keeps the k best rows of each frame before the shuffle as long as k is at most
    spark.sql.optimizer.windowGroupLimitThreshold; raise that setting with k.
    ``portable`` draws from MD5 so that another engine can repeat the choice; the default hash is faster.
    """
    ids = [*keys, *row_keys]
    if portable:
        score = hash_uniform(seed, *ids)
    else:
        h = F.xxhash64(F.lit(seed), *ids)
        score = F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__score", *row_keys))
    return points.withColumn("__score", score).withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__score", "__rank")


def foreground_probe(pixels: DataFrame, k: int = 8, seed: int = 0, keys=("frame_id",), row_keys=("px_row", "px_col"), portable: bool = False) -> DataFrame:
    """Up to k foreground pixels per frame."""
    return subsample(pixels.filter(masks.foreground()), k, seed, keys, row_keys, portable)


def cloud_summary(pixels: DataFrame, cams: DataFrame, keys=("frame_id",)) -> DataFrame:
    """Point count, depth range and origin per frame; the camera joins after the aggregate."""
    agg = (
        pixels.filter(masks.cloud())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("points"), F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"))
    )
    return agg.join(cams.select(*keys, "ex", "ey", "ez"), list(keys))


def point_extent(points: DataFrame, keys, x="x", y="y", z="z") -> DataFrame:
    aggs = []
    for name, c in (("x", x), ("y", y), ("z", z)):
        aggs += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    return points.groupBy(*keys).agg(*aggs)


def pose_audit(
    cams: DataFrame, keys=("frame_id",), centre_depth: float = 5.0, pixel_tol: float = 0.5, origin_tol: float = 1e-4, basis_tol: float = 1e-4, focal_tol: float = 1e-3
) -> DataFrame:
    """Stored poses against each other: keys, centre_err, origin_err, basis_err, focal_err, ok.

    cams: c2w (16 values), lookfrom (3 values), fx, fy, cx, cy, w, h, vfov, all as stored. A point ahead of ``lookfrom`` along
    the matrix's viewing axis goes through the general inverse of the matrix and the stored intrinsics and must meet the principal point; the
    matrix's origin must be ``lookfrom``, its axes a rotation, and the focal lengths those of the field of view. A singular matrix
    or a point behind the camera has no centre_err and is not ok.
    """
    d = with_affine_inverse(cams, "c2w", "__w2c")
    ahead = Vec(*[F.col("c2w")[4 * r + 2] for r in range(3)]).unit()
    eye = Vec(*[F.col("lookfrom")[r].cast("double") for r in range(3)])
    seen = project_camera_point(apply_point("__w2c", eye.plus(ahead.times(F.lit(centre_depth)))), "fx", "fy", "cx", "cy")
    axes = [Vec(*[F.col("c2w")[4 * r + c] for r in range(3)]) for c in range(3)]
    uneven = [F.abs(axes[i].dot(axes[j]) - F.lit(float(i == j))) for i in range(3) for j in range(i, 3)]
    derived = intrinsics("w", "h", "vfov")
    d = d.withColumns(
        {
            "centre_err": F.hypot(seen["u"] - dbl("cx"), seen["v"] - dbl("cy")),
            "origin_err": eye.minus(translation("c2w")).length(),
            "basis_err": F.greatest(*uneven),
            "focal_err": F.greatest(F.abs(derived["fx"] - dbl("fx")), F.abs(derived["fy"] - dbl("fy"))),
        }
    )
    ok = (F.col("centre_err") <= pixel_tol) & (F.col("origin_err") <= origin_tol) & (F.col("basis_err") <= basis_tol) & (F.col("focal_err") <= focal_tol)
    return d.select(*keys, "centre_err", "origin_err", "basis_err", "focal_err", F.coalesce(ok, F.lit(False)).alias("ok"))


def roundtrip_error(depth, column, row) -> dict[str, Column]:
    """Pixel error of unproject followed by project through the same camera.

    The world point is built first and brought back by the rigid inverse, as an outside user would do it.
    """
    d = world_point(depth, column, row).minus(vec("e"))
    back = Vec(d.dot(vec("u")), -d.dot(vec("v")), -d.dot(vec("w")))
    uv = project_camera_point(back, "fx", "fy", "cx", "cy")
    return {"err": F.hypot(uv["u"] - dbl(column), uv["v"] - dbl(row))}


def projection_audit(
    pixels: DataFrame,
    cams: DataFrame,
    keys=("frame_id",),
    probes: int = 8,
    seed: int = 0,
    row_keys=("px_row", "px_col"),
    centre_depth: float = 5.0,
    centre_tol: float = 0.5,
    pixel_tol: float = 1.0,
    portable: bool = False,
) -> DataFrame:
    """Per frame: centre-ray error, worst foreground error over the probes, probes used, verdict."""
    pose = cams.select(*keys, "fx", "fy", "cx", "cy", *[p + a for p in "euvw" for a in "xyz"])
    centre = pose.withColumns(roundtrip_error(F.lit(centre_depth), "cx", "cy")).select(
        *keys, F.col("err").alias("centre_err")
    )
    picked = foreground_probe(pixels, probes, seed, keys, row_keys, portable)
    errs = picked.join(pose, list(keys)).withColumns(roundtrip_error("depth", "px_col", "px_row"))
    worst = errs.groupBy(*keys).agg(
        F.max("err").alias("pixel_err"), F.count("err").alias("samples"), F.bool_and(F.col("err") <= pixel_tol).alias("__px")
    )
    out = centre.join(worst, list(keys), "left")
    ok = (F.col("centre_err") <= centre_tol) & F.coalesce("__px", F.lit(True))
    return out.withColumns({"samples": F.coalesce("samples", F.lit(0).cast("bigint")), "ok": ok}).drop("__px")


def foreground_audit(
    pixels: DataFrame, cams: DataFrame, keys=("frame_id",), probes: int = 8, seed: int = 0, row_keys=("px_row", "px_col"), pixel_tol: float = 1.0, portable: bool = False
) -> DataFrame:
    """Foreground pixels through the pose a frame was made with and back through the pose that is stored for it.

    cams: the camera by eye, target and field of view (with_pose) and what the frame's metadata stores, stored_c2w (16 values) and
    stored_fx, stored_fy. keys, pixel_err (worst of the probes, null where one lies behind the stored camera or the matrix is singular),
    samples, ok. Frames without foreground have no samples and are ok.
    """
    stored = with_affine_inverse(cams, "stored_c2w", "__w2c")
    pose = stored.select(*keys, "fx", "fy", "cx", "cy", "stored_fx", "stored_fy", "__w2c", *[p + a for p in "euvw" for a in "xyz"])
    picked = foreground_probe(pixels, probes, seed, keys, row_keys, portable).join(pose, list(keys))
    seen = project_camera_point(apply_point("__w2c", world_point("depth", "px_col", "px_row")), "stored_fx", "stored_fy", "cx", "cy")
    errs = picked.withColumn("err", F.hypot(seen["u"] - dbl("px_col"), seen["v"] - dbl("px_row")))
    worst = errs.groupBy(*keys).agg(F.when(F.bool_and(F.col("err").isNotNull()), F.max("err")).alias("pixel_err"), F.count(F.lit(1)).alias("samples"))
    out = cams.select(*keys).join(worst, list(keys), "left").withColumn("samples", F.coalesce("samples", F.lit(0).cast("bigint")))
    return out.withColumn("ok", (F.col("samples") == 0) | F.coalesce(F.col("pixel_err") <= pixel_tol, F.lit(False)))
