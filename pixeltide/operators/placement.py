"""Spacing conflicts and weighted choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.functions.columns import dbl
from pixeltide.operators import ordered


def spacing_conflicts(objects: DataFrame, spacing: float, keys: Sequence[str] = (), obj_id: str = "obj_id", x="x", z="z") -> DataFrame:
    """Per object the earlier object it stands too close to (witness_id), null where it is free.

    Grid cells are small enough that any two objects of one cell conflict, so all but the first of a cell are
    settled by the cell's first object (an aggregate). Only those firsts are compared with the 24 cells around
    them: work stays linear in the objects however crowded a cell is, and no pairs are listed.
    """
    keys = list(keys)
    side = spacing / 1.5
    cell = {"__cx": F.floor(dbl(x) / side), "__cz": F.floor(dbl(z) / side)}
    pts = objects.select(*keys, obj_id, dbl(x).alias("__x"), dbl(z).alias("__z")).withColumns(
        {k: v for k, v in {"__cx": F.floor(F.col("__x") / side), "__cz": F.floor(F.col("__z") / side)}.items()}
    )
    firsts = pts.groupBy(*keys, "__cx", "__cz").agg(
        F.min(obj_id).alias("__first"), F.min_by(F.struct("__x", "__z"), F.col(obj_id)).alias("__at")
    )
    around = [(dx, dz) for dx in range(-2, 3) for dz in range(-2, 3) if (dx, dz) != (0, 0)]
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dz")) for a, b in around]))
    asks = firsts.select(*keys, "__cx", "__cz", "__first", "__at", offsets.alias("__o")).select(
        *keys,
        (F.col("__cx") + F.col("__o.dx")).alias("__cx"),
        (F.col("__cz") + F.col("__o.dz")).alias("__cz"),
        "__first",
        F.col("__at.__x").alias("__fx"),
        F.col("__at.__z").alias("__fz"),
    )
    dx, dz = F.col("__fx") - F.col("__x"), F.col("__fz") - F.col("__z")
    near = (
        asks.join(pts, [*keys, "__cx", "__cz"])
        .filter((F.col(obj_id) < F.col("__first")) & (F.sqrt(dx * dx + dz * dz) < spacing))
        .groupBy(*keys, "__first")
        .agg(F.min(obj_id).alias("__near"))
        .withColumnRenamed("__first", obj_id)
    )
    out = objects.withColumns(cell).join(firsts.drop("__at"), [*keys, "__cx", "__cz"]).join(near, [*keys, obj_id], "left")
    witness = F.when(F.col("__first") < F.col(obj_id), F.col("__first")).otherwise(F.col("__near"))
    return out.withColumn("witness_id", witness).select(*objects.columns, "witness_id")


WEIGHT_FLOOR = 0.001


def weight_intervals(catalog: DataFrame, keys: Sequence[str], order: str = "asset_ord") -> DataFrame:
    """Cumulative shares [lo, hi) per catalogue entry; weights below the floor count as the floor.

    Sums run over whole billionths, so neighbouring intervals meet exactly and the last one ends at 1.
    """
    keys = list(keys)
    units = F.round(F.greatest(dbl("weight"), F.lit(WEIGHT_FLOOR)) * 1e9).cast("bigint")
    cat = catalog.withColumn("__w", units)
    run = ordered.running_sums(cat, keys, [order], ordered.chunk_of(order), {"__hi": F.col("__w")})
    total = cat.groupBy(*keys).agg(F.sum("__w").alias("__total"))
    joined = run.join(total, keys)
    share = F.col("__total").cast("double")
    return joined.withColumns({"lo": (F.col("__hi") - F.col("__w")) / share, "hi": F.col("__hi") / share}).drop("__w", "__hi", "__total")


def weighted_choice(
    draws: DataFrame, catalog: DataFrame, keys: Sequence[str], payload: Sequence[str] = ("name",), u: str = "u", order: str = "asset_ord"
) -> DataFrame:
    """Catalogue entry whose share interval holds the uniform draw ``u`` in [0, 1).

    Intervals meet end to end, so a draw's entry is the latest that starts at it or before: an as-of join (ordered.latest_before), linear
    in draws and entries for a catalogue of any size. Draws of keys without a catalogue are left out.
    """
    shares = weight_intervals(catalog, keys, order)
    met = ordered.latest_before(draws, shares, keys, u, "lo", ["hi", *payload], "__entry", strict=False)
    return met.filter(F.col(u) < F.col("__entry.hi")).select(*draws.columns, *[F.col(f"__entry.{p}").alias(p) for p in payload])
