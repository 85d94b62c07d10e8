"""Pixel predicates. Each keeps the exact window its consumer uses; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixeltide import constants as K
from pixeltide.functions.columns import col, dbl, finite


def cloud(depth="depth", eps: float = K.CLOUD_DEPTH_EPS) -> Column:
    """Finite and above eps. No upper bound: miss pixels pass."""
    return finite(depth) & (col(depth) > eps)


def train(depth="depth") -> Column:
    return finite(depth) & (col(depth) > K.TRAIN_DEPTH_MIN) & (col(depth) < K.TRAIN_DEPTH_MAX)


def sky(depth="depth", threshold: float = K.SKY_DEPTH_FLOW) -> Column:
    return col(depth) >= threshold


def foreground(depth="depth", instance_id="instance_id") -> Column:
    return (col(instance_id) > 0) & (col(depth) > 0) & finite(depth)


def mask_u8(instance_id="instance_id") -> Column:
    return F.least(col(instance_id).cast("bigint"), F.lit(255).cast("bigint")).cast("int")


def rgb_to_unit(u8) -> Column:
    return dbl(u8) / 255.0


def unit_to_rgb(x) -> Column:
    """Clip to 0..255 and truncate."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), dbl(x) * 255.0)).cast("int")
