"""Packed training shards: tar files of image, pixel, metadata and label bytes per frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.operators.frames import select_split, shard_pack_index
from pixeltide.sinks.filesource import write_files
from pixeltide.sources.files import scan_frames, spread


def pack_plan(spark: SparkSession, root: str, split: str = "both", frames_per_shard: int = 1000) -> DataFrame:
    """Frames with metadata in pack order: stem, folder and shard number. Stems may have more than four digits."""
    frames = select_split(scan_frames(spark, root).filter("has_meta"), split)
    plan = shard_pack_index(frames, frames_per_shard)
    return plan.select("pack_shard", "pack_index", "stem", F.concat_ws("/", F.lit(root.rstrip("/")), "split").alias("folder"))


def write_webdataset(spark: SparkSession, root: str, out: str, split: str = "both", frames_per_shard: int = 1000, compress: bool = False) -> list[str]:
    """Writes shard-NNNNNN.tar[.gz] files and returns the paths of the new ones, sorted; no frames, no files.

    Only the plan is shuffled. Each shard is streamed by one task, which opens the frame files itself, so no frame bytes
    pass through Spark. Shards appear when all are written, or not at all.
    """
    plan = pack_plan(spark, root, split, frames_per_shard)
    # An explicit count keeps adaptive execution from merging the small plan into one task that would read every frame.
    shards = (plan.agg(F.max("pack_shard")).first()[0] or 0) + 1
    placed = plan.repartition(min(int(shards), 4 * spread(spark)), "pack_shard").sortWithinPartitions("pack_shard", "pack_index")
    done = write_files(placed.select("pack_shard", "stem", "folder"), out, "shards", compress)
    return [f"{out.rstrip('/')}/{name}" for name in done["new"]]
