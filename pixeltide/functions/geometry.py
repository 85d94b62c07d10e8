"""Camera and pose formulas as column builders.

Two vertical conventions exist in the data and both are kept. ``t_up`` counts pixel rows upward like
the ray parameter t (the convention of the project/unproject pair), ``row_down`` counts framebuffer rows
from the top (the convention of optical flow). Every function that depends on it takes ``v_axis``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide import constants as K
from pixeltide.functions.columns import Vec, col, dbl, vec


def _v_sign(v_axis: str) -> float:
    if v_axis == "t_up":
        return -1.0
    if v_axis == "row_down":
        return 1.0
    raise ValueError("v_axis must be 't_up' or 'row_down'")


def intrinsics(width, height, vfov) -> dict[str, Column]:
    """fx, fy, cx, cy of the pinhole camera; a side of one pixel counts as span 1."""
    w, h = dbl(width), dbl(height)
    aspect = F.when(h > 0, w / F.nullif(h, F.lit(0.0))).otherwise(F.lit(1.0))
    view_h = F.tan(F.radians(dbl(vfov)) * 0.5) * 2.0
    span_w = F.when(w > 1, w - 1.0).otherwise(F.lit(1.0))
    span_h = F.when(h > 1, h - 1.0).otherwise(F.lit(1.0))
    return {
        "fx": span_w / (aspect * view_h),
        "fy": span_h / view_h,
        "cx": span_w * 0.5,
        "cy": span_h * 0.5,
    }


def with_intrinsics(df: DataFrame, width="w", height="h", vfov="vfov") -> DataFrame:
    return df.withColumns(intrinsics(width, height, vfov))


def intrinsics_mismatch(width, height, vfov, fx, fy, cx, cy, tol: float = 1e-3) -> Column:
    """True where stored intrinsics differ from the derived ones by more than tol."""
    want = intrinsics(width, height, vfov)
    checks = [F.abs(dbl(c) - want[k]) > tol for k, c in (("fx", fx), ("fy", fy), ("cx", cx), ("cy", cy))]
    out = checks[0]
    for c in checks[1:]:
        out = out | c
    return out


def with_camera_basis(df: DataFrame, eye: Vec, at: Vec, up: Vec | None = None, prefix: str = "") -> DataFrame:
    """Adds <prefix>ux.. (right), vx.. (up), wx.. (backward)."""
    up = up or Vec(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    u, v, w = (prefix + n for n in "uvw")
    df = df.withColumns(eye.minus(at).unit().as_columns(w))
    df = df.withColumns(up.cross(vec(w)).unit().as_columns(u))
    return df.withColumns(vec(w).cross(vec(u)).as_columns(v))


def c2w_array(u: Vec, v: Vec, w: Vec, origin: Vec) -> Column:
    """Row-major 4x4 camera-to-world: columns u, -v, -w, origin."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        u.x, -v.x, -w.x, origin.x,
        u.y, -v.y, -w.y, origin.y,
        u.z, -v.z, -w.z, origin.z,
        zero, zero, zero, one,
    )


def k_matrix(fx, fy, cx, cy) -> Column:
    zero = F.lit(0.0)
    return F.array(
        F.array(dbl(fx), zero, dbl(cx)), F.array(zero, dbl(fy), dbl(cy)), F.array(zero, zero, F.lit(1.0))
    )


def rows_of_4x4(m16) -> Column:
    """Flat row-major 16 array as four rows of four."""
    return F.array(*[F.slice(col(m16), 1 + 4 * r, 4) for r in range(4)])


def _at(m, r: int, c: int) -> Column:
    # Item access, not element_at: the optimizer reads straight through array(...) built in the same plan.
    return col(m)[4 * r + c]


def with_affine_inverse(df: DataFrame, m16: str, out: str) -> DataFrame:
    """Adds the inverse of an affine row-major 4x4 by 3x3 cofactors; its elements are null where the determinant is 0.

    Cofactors and determinant are columns of their own, so generated code computes each of them once.
    """
    cells = {f"__m{r}{c}": _at(m16, r, c) for r in range(3) for c in range(4)}
    m = [[F.col(f"__m{r}{c}") for c in range(4)] for r in range(3)]

    def cof(r: int, c: int) -> Column:
        r1, r2 = (r + 1) % 3, (r + 2) % 3
        c1, c2 = (c + 1) % 3, (c + 2) % 3
        return m[r1][c1] * m[r2][c2] - m[r1][c2] * m[r2][c1]

    df = df.withColumns(cells)
    df = df.withColumns({f"__k{r}{c}": cof(r, c) for r in range(3) for c in range(3)})
    det = m[0][0] * F.col("__k00") + m[0][1] * F.col("__k01") + m[0][2] * F.col("__k02")
    df = df.withColumn("__det", F.nullif(det, F.lit(0.0)))
    df = df.withColumns({f"__i{r}{c}": F.col(f"__k{c}{r}") / F.col("__det") for r in range(3) for c in range(3)})
    inv = [[F.col(f"__i{r}{c}") for c in range(3)] for r in range(3)]
    flat = []
    for r in range(3):
        flat += [*inv[r], -(inv[r][0] * m[0][3] + inv[r][1] * m[1][3] + inv[r][2] * m[2][3])]
    df = df.withColumn(out, F.array(*flat, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return df.drop("__det", *cells, *[f"__{k}{r}{c}" for k in "ki" for r in range(3) for c in range(3)])


def rigid_inverse(m16) -> Column:
    """Inverse of a rotation + translation: the transpose."""
    inv = [[_at(m16, c, r) for c in range(3)] for r in range(3)]
    t = [-(inv[r][0] * _at(m16, 0, 3) + inv[r][1] * _at(m16, 1, 3) + inv[r][2] * _at(m16, 2, 3)) for r in range(3)]
    flat = []
    for r in range(3):
        flat += [*inv[r], t[r]]
    return F.array(*flat, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def apply_point(m16, p: Vec) -> Vec:
    """Affine row-major 4x4 times a point."""
    return Vec(*[_at(m16, r, 0) * p.x + _at(m16, r, 1) * p.y + _at(m16, r, 2) * p.z + _at(m16, r, 3) for r in range(3)])


def rotate(m16, d: Vec) -> Vec:
    return Vec(*[_at(m16, r, 0) * d.x + _at(m16, r, 1) * d.y + _at(m16, r, 2) * d.z for r in range(3)])


def translation(m16) -> Vec:
    return Vec(*[_at(m16, r, 3) for r in range(3)])


def pixel_ray(i, j, fx, fy, cx, cy, v_axis: str = "t_up") -> Vec:
    """Unit camera-space ray of pixel (i, j); camera axes are right, down, forward."""
    s = F.lit(_v_sign(v_axis))
    return Vec((dbl(i) - dbl(cx)) / dbl(fx), s * (dbl(j) - dbl(cy)) / dbl(fy), F.lit(1.0)).unit()


def project_camera_point(p: Vec, fx, fy, cx, cy, v_axis: str = "t_up", z_eps: float = K.FRONT_Z_EPS) -> dict[str, Column]:
    """Continuous pixel of a camera-space point; null at or behind z_eps."""
    s = F.lit(_v_sign(v_axis))
    z = F.when(p.z > z_eps, p.z)
    return {"u": dbl(fx) * (p.x / z) + dbl(cx), "v": s * dbl(fy) * (p.y / z) + dbl(cy)}


def project_pixel_int(p: Vec, eye: Vec, u: Vec, v: Vec, w: Vec, vfov, aspect, width, height) -> dict[str, Column]:
    """World point to an integer pixel clamped to the image, rows from the top; null behind the camera.

    Rounding is half away from zero, which is what round() does for doubles here.
    """
    d = p.minus(eye)
    z = -d.dot(w)
    z = F.when(z > K.FRONT_Z_EPS, z)
    half_h = F.tan(F.radians(dbl(vfov)) * 0.5)
    half_w = dbl(aspect) * half_h
    sx = (d.dot(u) / (z * half_w) + 1.0) * 0.5
    sy = (F.lit(1.0) - d.dot(v) / (z * half_h)) * 0.5
    ok = z.isNotNull() & ~F.isnan(sx) & ~F.isnan(sy)

    def pixel(s: Column, span) -> Column:
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
        return F.when(ok, F.floor(clamped * (dbl(span) - 1.0) + 0.5).cast("int"))

    return {"px": pixel(sx, width), "py": pixel(sy, height)}


def euler_rotation(rx_deg, ry_deg, rz_deg) -> list[list[Column]]:
    """Rz * Ry * Rx for column vectors."""
    rx, ry, rz = (F.radians(dbl(a)) for a in (rx_deg, ry_deg, rz_deg))
    cx, sx, cy, sy, cz, sz = F.cos(rx), F.sin(rx), F.cos(ry), F.sin(ry), F.cos(rz), F.sin(rz)
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def object_matrix(rotation: Vec, scale: Vec, position: Vec) -> Column:
    """Row-major local-to-world of a logical object: rotation times scale, plus translation."""
    r = euler_rotation(rotation.x, rotation.y, rotation.z)
    flat = []
    for row, t in zip(r, position):
        flat += [row[0] * scale.x, row[1] * scale.y, row[2] * scale.z, t]
    return F.array(*flat, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def transform_supervision(grounded) -> Column:
    return F.when(col(grounded), F.lit(K.SUPERVISION_GROUNDED)).otherwise(F.lit(K.SUPERVISION_FREE))


def focus_distance(eye: Vec, at: Vec) -> Column:
    return eye.minus(at).length()
