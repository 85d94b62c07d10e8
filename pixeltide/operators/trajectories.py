"""Keyframe trajectories: segments and position at a normalized time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.functions.columns import col, dbl
from pixeltide.operators import ordered

AXES = ("px", "py", "pz")


def time_chunk(t: str | Column, bins: int = 1024) -> Column:
    return F.floor(dbl(t) * float(bins)).cast("bigint")


def keyframe_segments(keyframes: DataFrame, keys: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Consecutive keyframe pairs ordered by t, then by input position ``pos``."""
    nxt = ordered.neighbour(
        keyframes, list(keys), ["t", "pos"], time_chunk("t"), ["t", *AXES], "__next", following=True
    )
    return nxt.filter(F.col("__next").isNotNull()).select(
        *keys,
        "pos",
        F.col("t").alias("t0"),
        F.col("__next.t").alias("t1"),
        *[F.col(a).alias(f"{a}0") for a in AXES],
        *[F.col(f"__next.{a}").alias(f"{a}1") for a in AXES],
    )


def _spans(keyframes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half-open spans (t0, t1] that cover the whole time axis, so that each time meets exactly one.

    The first closed interval holding a time is the one with t0 < time <= t1; a zero-length interval never wins, and
    the clamped ends become two constant spans.
    """
    seg = keyframe_segments(keyframes, keys).drop("pos")
    first, last = F.struct("t", "pos"), F.struct("t", "pos")
    ends = keyframes.groupBy(*keys).agg(
        F.min_by(F.struct("t", *AXES), first).alias("a"), F.max_by(F.struct("t", *AXES), last).alias("b")
    )
    inf = float("inf")
    head = ends.select(
        *keys, F.lit(-inf).alias("t0"), F.col("a.t").alias("t1"),
        *[F.col(f"a.{x}").alias(f"{x}0") for x in AXES], *[F.col(f"a.{x}").alias(f"{x}1") for x in AXES],
        F.lit(None).cast("double").alias("t_end"),
    )
    tail = ends.select(
        *keys, F.col("b.t").alias("t0"), F.lit(inf).alias("t1"),
        *[F.col(f"b.{x}").alias(f"{x}0") for x in AXES], *[F.col(f"b.{x}").alias(f"{x}1") for x in AXES],
        F.lit(None).cast("double").alias("t_end"),
    )
    # A time equal to the last keyframe takes the last position exactly; t_end marks it in the spans that touch it.
    inner = seg.filter("t1 > t0").join(ends.select(*keys, F.col("b.t").alias("t_end"), F.col("b").alias("__b")), list(keys))
    inner = inner.select(
        *keys, "t0", "t1", *[f"{x}0" for x in AXES],
        *[F.when(F.col("t1") == F.col("t_end"), F.col(f"__b.{x}")).otherwise(F.col(f"{x}1")).alias(f"{x}e") for x in AXES],
        *[f"{x}1" for x in AXES], "t_end",
    )
    head = head.withColumns({f"{x}e": F.col(f"{x}1") for x in AXES})
    tail = tail.withColumns({f"{x}e": F.col(f"{x}1") for x in AXES})
    return inner.unionByName(head).unionByName(tail)


def trajectory_interp(
    times: DataFrame, keyframes: DataFrame, keys: Sequence[str] = ("traj_id",), alpha: str = "alpha", fallback: Sequence[str] | None = None
) -> DataFrame:
    """Adds px, py, pz at ``alpha`` (clamped to [0, 1]) along each trajectory.

    Spans cover the whole axis, so the span of a time is the latest that starts before it: an as-of join, linear in times and
    keyframes, whether they crowd in one moment or on one trajectory. Times without keyframes take the ``fallback`` columns
    (null without it).
    """
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dbl(alpha)))
    names = ["t0", "t1", "t_end", *[f"{x}{k}" for x in AXES for k in "01e"]]
    met = ordered.latest_before(times.withColumn("__a", a), _spans(keyframes, keys), keys, "__a", "t0", names, "__span")
    s = {n: F.col(f"__span.{n}") for n in names}
    flat = s["t0"].isin(float("-inf")) | s["t1"].isin(float("inf"))
    u = (F.col("__a") - s["t0"]) / (s["t1"] - s["t0"])
    out = {}
    for i, x in enumerate(AXES):
        mid = s[f"{x}0"] + u * (s[f"{x}1"] - s[f"{x}0"])
        value = F.when(flat, s[f"{x}0"]).when(F.col("__a") == s["t_end"], s[f"{x}e"]).otherwise(mid)
        out[x] = F.coalesce(value, col(fallback[i])) if fallback else value
    return met.withColumns(out).select(*times.columns, *AXES)


def normalized_time(index: str | Column, frames: str | Column) -> Column:
    """g / (frames - 1), 0 for a single frame."""
    n = col(frames).cast("double")
    return F.when(n > 1, col(index).cast("double") / F.nullif(n - 1.0, F.lit(0.0))).otherwise(F.lit(0.0))
