"""Frame tables: inventory from listings, splits, shards, numbering, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide import constants as K
from pixeltide.functions import text
from pixeltide.functions.columns import col
from pixeltide.operators import ordered


def train_count(total: str | Column, split: str | Column | float) -> Column:
    """round(total * split) with the split clamped to [0, 1], half away from zero."""
    s = F.lit(float(split)) if isinstance(split, (int, float)) else col(split)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s.cast("double")))
    return F.floor(col(total) * clamped + 0.5).cast("bigint")


def assign_split(df: DataFrame, index: str, total: str | Column, split, out: str = "split") -> DataFrame:
    """First train_count frames are train, the rest val."""
    return df.withColumn(out, F.when(col(index) < train_count(total, split), F.lit("train")).otherwise(F.lit("val")))


def check_shard(shard_id: int, num_shards: int) -> None:
    if num_shards < 1:
        raise ValueError("num_shards must be at least 1")
    if not 0 <= shard_id < num_shards:
        raise ValueError("shard_id must lie in [0, num_shards)")


def assign_shard(df: DataFrame, index: str, num_shards: int, out: str = "shard") -> DataFrame:
    check_shard(0, num_shards)
    return df.withColumn(out, F.pmod(col(index), F.lit(num_shards)).cast("int"))


def frames_of_shard(df: DataFrame, index: str, shard_id: int, num_shards: int) -> DataFrame:
    check_shard(shard_id, num_shards)
    return df.filter(F.pmod(col(index), F.lit(num_shards)) == shard_id)


def frame_names(df: DataFrame, index: str, split: str = "split", kind: str = "frame") -> DataFrame:
    """Stem and the four sidecar paths of each frame."""
    df = df.withColumn("stem", text.frame_stem(index, kind))
    return df.withColumns(
        {
            "png_path": text.sidecar_path(split, "stem", K.SIDECAR_SUFFIXES[0]),
            "pixels_path": text.sidecar_path(split, "stem", K.SIDECAR_SUFFIXES[1]),
            "meta_path": text.sidecar_path(split, "stem", K.SIDECAR_SUFFIXES[2]),
            "label_path": text.sidecar_path(split, "stem", K.SIDECAR_SUFFIXES[3]),
        }
    )


def select_split(df: DataFrame, split: str = "both", column: str = "split") -> DataFrame:
    """train, val or both; a partition-column filter when the table is laid out by split."""
    if split == "both":
        return df.filter(F.col(column).isin("train", "val"))
    if split not in ("train", "val"):
        raise ValueError("split must be 'train', 'val' or 'both'")
    return df.filter(F.col(column) == split)


def frame_inventory(listing: DataFrame, strict: bool = False, root_keys: Sequence[str] = ("root",)) -> DataFrame:
    """One row per frame from a file listing (root, split, name, length): which sidecars exist, image size.

    Suffixes are turned into flags by one conditional aggregate; other files drop out. Names carry four or more digits; strict takes
    exactly four.
    """
    digits = r"\d{4}" if strict else r"\d{4,}"
    stem = F.regexp_extract("name", rf"^((?:frame|sfrm)_{digits})(\.png|_spatial\.exr|_meta\.json|\.txt)$", 1)
    suffix = F.regexp_extract("name", rf"^((?:frame|sfrm)_{digits})(\.png|_spatial\.exr|_meta\.json|\.txt)$", 2)
    rows = listing.withColumns({"stem": stem, "suffix": suffix}).filter(F.col("stem") != "")
    has = {
        "has_png": ".png", "has_pixels": "_spatial.exr", "has_meta": "_meta.json", "has_txt": ".txt",
    }
    agg = rows.groupBy(*root_keys, "split", "stem").agg(
        *[F.bool_or(F.col("suffix") == s).alias(n) for n, s in has.items()],
        F.max(F.when(F.col("suffix") == ".png", F.col("length"))).alias("size_bytes"),
    )
    return agg.withColumns(
        {
            "kind": F.substring_index("stem", "_", 1),
            "frame_id": F.substring_index("stem", "_", -1).cast("bigint"),
        }
    )


def stem_family(listing: DataFrame, root_keys: Sequence[str] = ("root",)) -> DataFrame:
    """frame or sfrm per root: the first split (train, val) holding only one family decides; else frame."""
    name = F.col("name")
    meta = listing.filter(name.endswith("_meta.json") & F.col("split").isin("train", "val"))
    per = meta.groupBy(*root_keys, "split").agg(
        F.coalesce(F.bool_or(name.startswith("frame_")), F.lit(False)).alias("f"),
        F.coalesce(F.bool_or(name.startswith("sfrm_")), F.lit(False)).alias("s"),
    )
    vote = F.when(F.col("f") & ~F.col("s"), "frame").when(F.col("s") & ~F.col("f"), "sfrm")
    agg = per.withColumn("vote", vote).groupBy(*root_keys).agg(
        F.min_by("vote", F.when(F.col("vote").isNotNull(), F.col("split"))).alias("family")
    )
    roots = listing.select(*root_keys).distinct()
    return roots.join(agg, list(root_keys), "left").withColumn("family", F.coalesce("family", F.lit("frame")))


def frame_index(frames: DataFrame, root_keys: Sequence[str] = ("root",), width: int = ordered.CHUNK) -> DataFrame:
    """Dense 0-based sample index per root in (split, frame id) order."""
    ties = [c for c in ("stem",) if c in frames.columns]
    return ordered.number_by_position(frames, list(root_keys), ["split"], "frame_id", "sample_index", width=width, ties=ties)


def loader_index(listing: DataFrame, root_keys: Sequence[str] = ("root",), width: int = ordered.CHUNK) -> DataFrame:
    """What a loader of a dataset folder sees: frames of the folder's stem family that have metadata, numbered from 0."""
    found = frame_inventory(listing, root_keys=root_keys).filter(F.col("has_meta") & F.col("split").isin("train", "val"))
    family = stem_family(listing, root_keys)
    own = found.join(family, list(root_keys)).filter(F.col("kind") == F.col("family")).drop("family")
    return frame_index(own, root_keys, width)


def shard_pack_index(frames: DataFrame, frames_per_shard: int, root_keys: Sequence[str] = ("root",), width: int = ordered.CHUNK) -> DataFrame:
    """Global pack order (train before val, then frame id, then stem) and the shard each sample goes to."""
    ties = [c for c in ("stem",) if c in frames.columns]
    out = ordered.number_by_position(frames, list(root_keys), ["split"], "frame_id", "pack_index", width=width, ties=ties)
    return out.withColumn("pack_shard", F.floor(F.col("pack_index") / F.lit(float(frames_per_shard))).cast("bigint"))


def batches(indexed: DataFrame, batch_size: int, index: str = "sample_index") -> DataFrame:
    """Batch number by index; samples stay rows."""
    return indexed.withColumn("batch", F.floor(F.col(index) / F.lit(float(batch_size))).cast("bigint"))


def head_samples(indexed: DataFrame, n: int, index: str = "sample_index") -> DataFrame:
    """First n samples in index order."""
    return indexed.orderBy(index).limit(n)


def sidecar_gaps(inventory: DataFrame) -> DataFrame:
    """Frames lacking any of image, label, meta or pixels, one row per missing part."""
    parts = {"png": "has_png", "label": "has_txt", "meta": "has_meta", "pixels": "has_pixels"}
    present = [c for c in inventory.columns if c not in parts.values()]
    lost = F.filter(
        F.array(*[F.when(~F.col(f), F.lit(n)) for n, f in parts.items() if f in inventory.columns]),
        lambda x: x.isNotNull(),
    )
    return inventory.withColumn("missing", F.explode(lost)).select(*present, "missing")


def layout_counts(frames: DataFrame, run_keys: Sequence[str], shard: str | None = None) -> DataFrame:
    """Frames total, train, val per run (and per shard: rendered there)."""
    keys = [*run_keys, *([shard] if shard else [])]
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_total"),
        F.count_if(F.col("split") == "train").alias("train_frames"),
        F.count_if(F.col("split") == "val").alias("val_frames"),
    )


def resolution_check(frames: DataFrame, group: Sequence[str], width="w", height="h") -> DataFrame:
    """Groups mixing image sizes."""
    agg = frames.groupBy(*group).agg(F.count_distinct(F.struct(width, height)).alias("sizes"))
    return agg.filter(F.col("sizes") > 1)
