"""Small column helpers used everywhere."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: str | Column | float) -> Column:
    if isinstance(c, (int, float)):
        return F.lit(float(c))
    return col(c).cast("double")


def finite(c: str | Column) -> Column:
    """NaN sorts above every number in Spark, so a plain comparison does not exclude it."""
    c = col(c)
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def rnd(c: str | Column, places: int = 6) -> Column:
    """Double rounded half away from zero, without negative zero.

    The built-in round() of doubles goes through BigDecimal; this stays in double arithmetic and is an order of
    magnitude cheaper.
    """
    t = col(c).cast("double") * F.lit(10.0**places)
    near = F.signum(t) * F.floor(F.abs(t) + 0.5).cast("double")
    return F.when(F.abs(t) < 9e15, near).otherwise(t) / F.lit(10.0**places) + F.lit(0.0)


class Vec(NamedTuple):
    """Three double columns. Arithmetic stays in plain column expressions."""

    x: Column
    y: Column
    z: Column

    def plus(self, o: "Vec") -> "Vec":
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: "Vec") -> "Vec":
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, k: Column) -> "Vec":
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: "Vec") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "Vec") -> "Vec":
        return Vec(
            self.y * o.z - self.z * o.y,
            self.z * o.x - self.x * o.z,
            self.x * o.y - self.y * o.x,
        )

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> "Vec":
        """Null for a zero vector."""
        n = F.nullif(self.length(), F.lit(0.0))
        return Vec(self.x / n, self.y / n, self.z / n)

    def as_columns(self, prefix: str) -> dict[str, Column]:
        return {f"{prefix}x": self.x, f"{prefix}y": self.y, f"{prefix}z": self.z}


def vec(prefix: str) -> Vec:
    """Vec over the columns <prefix>x, <prefix>y, <prefix>z."""
    return Vec(F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z"))


def vec_of(x, y, z) -> Vec:
    return Vec(dbl(x), dbl(y), dbl(z))


def hash_uniform(*parts: Column | str | int) -> Column:
    """Draw in [0, 1) that depends on the given keys only, so re-partitioning cannot change it.

    52 bits of an MD5 of the joined keys; any engine with md5 gives the same number.
    """
    cols = [F.lit(p).cast("string") if isinstance(p, int) else col(p).cast("string") for p in parts]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *cols).cast("binary")), 1, 13), 16, 10)
    return bits.cast("bigint").cast("double") / F.lit(float(1 << 52))
