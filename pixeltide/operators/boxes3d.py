"""Screen boxes of rotated cubes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.functions.columns import dbl, vec, vec_of
from pixeltide.functions.geometry import project_pixel_int


def project_cubes(cubes: DataFrame, ids: Sequence[str]) -> DataFrame:
    """2D box of each cube: corners turned by roll (z) then pitch (x), moved to m*, projected, min/max.

    Needs camera pose (e*, u*, v*, w*, vfov, w, h), centre mx my mz, edge, roll, pitch in degrees. ``ids`` must be
    unique per cube. valid is false where no corner is in front of the camera.
    """
    signs = [(a, b, c) for a in (-0.5, 0.5) for b in (-0.5, 0.5) for c in (-0.5, 0.5)]
    corner = F.explode(F.array(*[F.struct(*[F.lit(s).alias(n) for s, n in zip(t, ("i", "j", "k"))]) for t in signs]))
    rows = cubes.withColumn("__c", corner)
    x, y, z = (F.col(f"__c.{n}") * F.col("edge") for n in ("i", "j", "k"))
    cr, sr = F.cos(F.radians("roll")), F.sin(F.radians("roll"))
    cp, sp = F.cos(F.radians("pitch")), F.sin(F.radians("pitch"))
    x1, y1 = cr * x - sr * y, sr * x + cr * y
    point = vec_of(x1 + F.col("mx"), cp * y1 - sp * z + F.col("my"), sp * y1 + cp * z + F.col("mz"))
    aspect = dbl("w") / F.nullif(dbl("h"), F.lit(0.0))
    px = project_pixel_int(point, vec("e"), vec("u"), vec("v"), vec("w"), "vfov", aspect, "w", "h")
    shot = rows.withColumns(px)
    agg = shot.groupBy(*ids).agg(
        F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1")
    )
    return agg.withColumn("valid", F.col("x0").isNotNull())
