"""Frame plans: randomized frames, scenario frames along a trajectory, objects per frame.

All draws are counter-based: a draw depends on (seed, frame, field) only. Frames can therefore be planned in any
partitioning and any shard without walking the frames before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.functions.columns import col, hash_uniform
from pixeltide.functions.geometry import focus_distance
from pixeltide.functions.columns import vec
from pixeltide.operators import frames as FR
from pixeltide.operators.placement import weighted_choice
from pixeltide.operators.raster import Grid
from pixeltide.operators.trajectories import normalized_time, trajectory_interp
from pixeltide.operators.tree import ground, preorder_ids, walk

# Sink depth of a grounded object (fixed values).
SINK_MIN, SINK_MAX = 0.01, 0.05

# Drawn fields and the config ranges they come from.
FIELDS = ("lookfrom_x", "lookfrom_y", "lookfrom_z", "fov", "sun_az", "sun_el", "obj_x", "obj_z", "obj_yaw")


def frame_ids(spark: SparkSession, frames: int) -> DataFrame:
    return spark.range(frames).withColumnRenamed("id", "g")


def draw(seed: Column | int | str, index: str, field: str, lo, hi) -> Column:
    """Uniform draw between two columns or numbers."""
    a = F.lit(float(lo)) if isinstance(lo, (int, float)) else col(lo)
    b = F.lit(float(hi)) if isinstance(hi, (int, float)) else col(hi)
    return a + (b - a) * hash_uniform(seed, index, F.lit(field))


def config_ranges(resolved: DataFrame) -> DataFrame:
    """Flat min/max columns per drawn field from resolved configurations."""
    src = {
        "lookfrom_x": ("camera.lookfrom", 0), "lookfrom_y": ("camera.lookfrom", 1), "lookfrom_z": ("camera.lookfrom", 2),
        "fov": ("camera.fov_deg", None), "sun_az": ("lighting.sun_azimuth_deg", None), "sun_el": ("lighting.sun_elevation_deg", None),
        "obj_x": ("placement.x", None), "obj_z": ("placement.z", None), "obj_yaw": ("placement.yaw_deg", None),
    }
    cols = []
    for name, (path, i) in src.items():
        for end in ("min", "max"):
            c = F.col(f"{path}.{end}")
            cols.append((c if i is None else c[i]).alias(f"{name}_{end}"))
    at = F.col("camera.lookat")
    return resolved.select("config_id", *cols, *[at[i].alias(f"a{a}") for i, a in enumerate("xyz")], "train_split", F.col("render.seed").alias("seed"))


def sample_frames(
    frames: DataFrame, ranges: DataFrame, assets: DataFrame, total: str | Column, keys: Sequence[str] = ("config_id",)
) -> DataFrame:
    """Randomized frame specs: frames (keys, g) with the ranges of their configuration and one asset by weight.

    assets: keys, asset_ord, name, label, class_id, scale, y_offset, weight, roughness, metallic (ranges).
    """
    keys = list(keys)
    f = frames.join(ranges, keys)
    f = f.withColumns({n: draw(F.col("seed"), "g", n, f"{n}_min", f"{n}_max") for n in FIELDS})
    f = f.withColumn("u", hash_uniform(F.col("seed"), "g", F.lit("asset")))
    f = f.drop(*[f"{n}_{e}" for n in FIELDS for e in ("min", "max")])
    payload = ["asset_ord", "name", "label", "class_id", "scale", "y_offset", "roughness", "metallic"]
    f = weighted_choice(f, assets, keys, payload).drop("u")
    sink = draw(F.col("seed"), "g", "sink", SINK_MIN, SINK_MAX)
    f = f.withColumns(
        {
            "roughness": draw(F.col("seed"), "g", "roughness", F.col("roughness.min"), F.col("roughness.max")),
            "metallic": draw(F.col("seed"), "g", "metallic", F.col("metallic.min"), F.col("metallic.max")),
            "y_offset": F.col("y_offset") - sink,
            "ex": F.col("lookfrom_x"), "ey": F.col("lookfrom_y"), "ez": F.col("lookfrom_z"),
        }
    ).drop("lookfrom_x", "lookfrom_y", "lookfrom_z")
    f = f.withColumn("focus_dist", focus_distance(vec("e"), vec("a")))
    return FR.assign_split(f, "g", total, F.col("train_split"))


def check_scenario(scenarios: DataFrame, name: str) -> None:
    """Unknown scenario names fail before any frame is planned."""
    if scenarios.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"scenario {name!r} is not defined")


def scenario_frames(frames: DataFrame, scenarios: DataFrame, keyframes: DataFrame, keys: Sequence[str], total: str | Column) -> DataFrame:
    """Camera specs along each scenario's trajectory; frames: keys, g. Scenario rows carry a*, fov_max, fallback f*.

    Times are g / (frames - 1); without keyframes the camera stays at the upper lookfrom corner (fx, fy, fz).
    """
    keys = list(keys)
    f = frames.join(scenarios, keys).withColumn("alpha", normalized_time("g", total))
    f = trajectory_interp(f, keyframes, keys, fallback=("fallback_x", "fallback_y", "fallback_z"))
    f = f.withColumns({"ex": F.col("px"), "ey": F.col("py"), "ez": F.col("pz")}).drop("px", "py", "pz")
    return f.withColumn("focus_dist", focus_distance(vec("e"), vec("a")))


def frame_objects(frames: DataFrame, heights: DataFrame | None = None, keys: Sequence[str] = ("config_id", "g")) -> DataFrame:
    """The object of each sampled frame in the nested form of frame metadata.

    heights (keys, height, nx, ny, nz) ground the object; without it the plane is flat at 0.
    """
    if heights is not None:
        frames = frames.join(heights, list(keys), "left")
    else:
        frames = frames.withColumns({"height": F.lit(0.0), "nx": F.lit(0.0), "ny": F.lit(1.0), "nz": F.lit(0.0)})
    obj = F.struct(
        F.lit(1).cast("bigint").alias("instance_id"),
        F.col("class_id").cast("bigint").alias("class_id"),
        "label",
        F.array("obj_x", "height", "obj_z").alias("position"),
        F.array(F.lit(0.0), F.col("obj_yaw"), F.lit(0.0)).alias("rotation_deg"),
        F.array("scale", "scale", "scale").alias("scale"),
        "roughness",
        "metallic",
        F.lit(True).alias("grounding_constraint"),
        F.array("nx", "ny", "nz").alias("terrain_normal"),
    )
    return frames.withColumn("objects", F.array(obj)).drop("height", "nx", "ny", "nz")


def scenario_objects(nodes: DataFrame, assets: DataFrame, raster: DataFrame | None = None, grid: Grid | None = None, keys: Sequence[str] = ("config_id", "scenario")) -> DataFrame:
    """(keys, objects): all nodes of a scenario that carry an asset, in pre-order with ids from 1, in the nested form of frame metadata.

    nodes: configs.scene_nodes. Class and material come from the asset of that name, the first one if a name repeats. With a height
    field, grounded nodes stand on it and take its normal. The list is as long as a scenario has objects; join it to the
    scenario's frames.
    """
    keys = list(keys)
    placed = walk(nodes, keys)
    flat = {"tnx": F.lit(0.0), "tny": F.lit(1.0), "tnz": F.lit(0.0)}
    placed = ground(placed, raster, grid, keys) if raster is not None and grid is not None else placed.withColumns(flat)
    numbered = preorder_ids(placed, keys)
    payload = ["label", "class_id", "roughness", "metallic"]
    first = assets.groupBy("config_id", "name").agg(F.min_by(F.struct(*payload), "asset_ord").alias("__a"))
    found = numbered.join(first.withColumnRenamed("name", "asset"), ["config_id", "asset"], "left")
    obj = F.struct(
        F.col("instance_id").cast("bigint").alias("instance_id"),
        F.coalesce("__a.class_id", F.lit(0).cast("bigint")).alias("class_id"),
        F.coalesce(F.col("__a.label"), F.col("name")).alias("label"),
        "name",
        F.array("wx", F.col("wy") + F.col("y_offset"), "wz").alias("position"),
        F.array("wrx", "wry", "wrz").alias("rotation_deg"),
        F.array("wsx", "wsy", "wsz").alias("scale"),
        *[F.coalesce((F.col(f"__a.{m}.min") + F.col(f"__a.{m}.max")) / 2.0, F.lit(d)).alias(m) for m, d in (("roughness", 0.5), ("metallic", 0.0))],
        F.col("grounded").alias("grounding_constraint"),
        F.array("tnx", "tny", "tnz").alias("terrain_normal"),
    )
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list(obj)).alias("objects"))
