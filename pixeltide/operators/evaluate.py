"""Masked losses, run statistics and the sequential stopping rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixeltide.functions.columns import Vec, dbl
from pixeltide.operators import ordered

DENOMINATOR_FLOOR = 1e-8
NORMALIZE_EPS = 1e-6


def masked_mean(value: Column, mask: Column) -> Column:
    """Sum over the mask divided by its size, the size floored so that an empty mask gives 0."""
    m = F.coalesce(mask, F.lit(False))
    total = F.coalesce(F.sum(F.when(m, value)), F.lit(0.0))
    return total / F.greatest(F.count_if(m).cast("double"), F.lit(DENOMINATOR_FLOOR))


def masked_l1(df: DataFrame, keys: Sequence[str], pred="pred", target="target", mask: Column | str = "mask") -> DataFrame:
    m = F.col(mask) if isinstance(mask, str) else mask
    return df.groupBy(*keys).agg(
        masked_mean(F.abs(dbl(pred) - dbl(target)), m).alias("loss"), F.count_if(m).alias("valid")
    )


def one_minus_cosine(a: Vec, b: Vec) -> Column:
    """1 - cosine of the normalized vectors (length floored at 1e-6), cosine clamped to [-1, 1]."""

    def unit(v: Vec) -> Vec:
        n = F.greatest(v.length(), F.lit(NORMALIZE_EPS))
        return Vec(v.x / n, v.y / n, v.z / n)

    cos = unit(a).dot(unit(b))
    return F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))


def masked_cosine(df: DataFrame, keys: Sequence[str], pred: Vec, target: Vec, mask: Column | str = "mask") -> DataFrame:
    m = F.col(mask) if isinstance(mask, str) else mask
    return df.groupBy(*keys).agg(
        masked_mean(one_minus_cosine(pred, target), m).alias("loss"), F.count_if(m).alias("valid")
    )


def epoch_loss(steps: DataFrame, keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """Mean of the step losses that had a valid pixel; NaN where none had."""
    mean = F.avg(F.when(F.col("valid") > 0, F.col("loss")))
    return steps.groupBy(*keys).agg(F.coalesce(mean, F.lit(float("nan"))).alias("mean_loss"))


def run_timing(frames: DataFrame, keys: Sequence[str], ms="render_ms", samples="samples", pixels="pixels") -> DataFrame:
    """Average milliseconds per frame and samples per pixel, the latter rounded half up."""
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg(ms).alias("avg_ms"),
        F.floor(F.sum(dbl(samples)) / F.nullif(F.sum(dbl(pixels)), F.lit(0.0)) + 0.5).cast("bigint").alias("avg_spp"),
    )


def sequential_ci_stop(
    samples: DataFrame,
    keys: Sequence[str] = ("grp",),
    order: str = "seq_id",
    value: str = "value",
    min_n: int = 8,
    rel: float = 0.1,
    budget: int | None = None,
    width: int = ordered.CHUNK,
) -> DataFrame:
    """Per group: first n >= min_n with 1.96 * sigma / sqrt(n) < rel * max(1e-3, mean), and the mean of those n.

    Without such an n, all samples (at most ``budget``) are used. Running moments are window aggregates inside a chunk
    of the order column, merged with the moments of the chunks before (ordered.carried_sums: the order may have any gaps); chunks past the budget are dropped
    before the windows run.
    """
    keys = list(keys)
    part = [*keys, "__chunk"]
    v = dbl(value)
    rows = samples.select(*keys, F.col(order).alias("__o"), v.alias("__v"), ordered.chunk_of(order, width).alias("__chunk"))
    n = F.count(F.lit(1))
    stats = rows.groupBy(*part).agg(
        n.alias("__n"), F.avg("__v").alias("__m"), (F.coalesce(F.var_pop("__v"), F.lit(0.0)) * n).alias("__q")
    )
    moments = stats.select(*part, "__n", (F.col("__m") * F.col("__n")).alias("__v"), (F.col("__q") + F.col("__n") * F.col("__m") * F.col("__m")).alias("__q"))
    sums = ordered.carried_sums(moments, keys, ["__n", "__v", "__q"])
    sum_n, sum_v, sum_q = F.col("__n"), F.col("__v"), F.col("__q")
    carry = sums.select(
        *part,
        F.coalesce(sum_n, F.lit(0).cast("bigint")).alias("__n0"),
        F.coalesce(sum_v / F.nullif(sum_n, F.lit(0).cast("bigint")), F.lit(0.0)).alias("__m0"),
        F.coalesce(F.greatest(F.lit(0.0), sum_q - sum_v * sum_v / F.nullif(sum_n, F.lit(0).cast("bigint"))), F.lit(0.0)).alias("__q0"),
    )
    if budget is not None:
        carry = carry.filter(F.col("__n0") < budget)
    upto = Window.partitionBy(*part).orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(carry, part).withColumns(
        {
            "__n1": F.row_number().over(upto).cast("bigint"),
            "__m1": F.avg("__v").over(upto),
            "__p1": F.coalesce(F.var_pop("__v").over(upto), F.lit(0.0)),
        }
    )
    nn = F.col("__n0") + F.col("__n1")
    delta = F.col("__m1") - F.col("__m0")
    merged = run.select(
        *keys,
        nn.alias("n"),
        F.when(F.col("__n0") == 0, F.col("__m1")).otherwise(F.col("__m0") + delta * F.col("__n1") / nn).alias("mean"),
        (F.col("__q0") + F.col("__p1") * F.col("__n1") + delta * delta * F.col("__n0") * F.col("__n1") / nn).alias("__q"),
    )
    if budget is not None:
        merged = merged.filter(F.col("n") <= budget)
    var = F.when(F.col("n") > 1, F.col("__q") / F.nullif(F.col("n") - 1, F.lit(0).cast("bigint"))).otherwise(F.lit(0.0))
    ci = F.sqrt(F.greatest(F.lit(0.0), var)) * 1.96 / F.sqrt(F.col("n").cast("double"))
    stop = (F.col("n") >= min_n) & (ci < F.greatest(F.lit(1e-3), F.col("mean")) * rel)
    at = F.when(stop, F.col("n"))
    agg = merged.groupBy(*keys).agg(
        F.min(at).alias("__stop"), F.min_by("mean", at).alias("__mean_stop"), F.max("n").alias("__all"), F.max_by("mean", "n").alias("__mean_all")
    )
    return agg.select(
        *keys,
        F.coalesce("__stop", "__all").alias("n"),
        F.coalesce("__mean_stop", "__mean_all").alias("mean"),
        F.col("__stop").isNotNull().alias("stopped_early"),
    )
