from pyspark.sql import functions as F

from pixeltide.checks.core import query, r
from pixeltide.functions import geometry as G
from pixeltide.functions import text
from pixeltide.functions.columns import Vec, dbl, hash_uniform, rnd, vec, vec_of
from pixeltide.operators import cloud, frames, motion

_K = "319e0 / (2e0 * tan(radians(vfov) / 2e0) * 320e0 / 180e0) as fx, 179e0 / (2e0 * tan(radians(vfov) / 2e0)) as fy, 1595e-1 as cx, 895e-1 as cy"


def _basis_sql(view: str) -> str:
    """Camera rows with axes u (right), v (up), w (backward) and intrinsics; up is +y."""
    return f"""(select *, wy * uz as vx, wz * ux - wx * uz as vy, - wy * ux as vz from (
        select *, wz / sqrt(wz * wz + wx * wx) as ux, 0e0 as uy, - wx / sqrt(wz * wz + wx * wx) as uz from (
        select *, dx / dl as wx, dy / dl as wy, dz / dl as wz from (
        select *, sqrt(dx * dx + dy * dy + dz * dz) as dl, {_K} from (
        select *, ex - ax as dx, ey - ay as dy, ez - az as dz from ${view} as c0) c1) c2) c3) c4)"""


POSE_SQL, FCAM_SQL = _basis_sql("pose"), _basis_sql("fcam")


def _rounded(df, keep, cols, places=6):
    return df.select(*keep, *[rnd(c, places).alias(c) for c in cols])


def _rsql(cols, places=6):
    return ", ".join(f"{r(c, places)} as {c}" for c in cols)


_IN = ["fx", "fy", "cx", "cy"]


@query("intrinsics", f"select frame_id, {_rsql(_IN)} from (select *, {_K} from $pose as p) q")
def _(v):
    return _rounded(G.with_intrinsics(v.pose), ["frame_id"], _IN)


@query(
    "intrinsics_check",
    f"""select frame_id, cast(abs(sx - fx) > 1e-3 or abs(fy - fy) > 1e-3 as boolean) as mismatch from (
          select *, case when frame_id % 6 = 0 then fx + 1e-2 else fx + 1e-4 end as sx from (select *, {_K} from $pose as p) q) t""",
)
def _(v):
    p = G.with_intrinsics(v.pose)
    p = p.withColumn("sx", F.when(F.col("frame_id") % 6 == 0, F.col("fx") + 1e-2).otherwise(F.col("fx") + 1e-4))
    return p.select("frame_id", G.intrinsics_mismatch("w", "h", "vfov", "sx", "fy", "cx", "cy").alias("mismatch"))


_AX = [p + a for p in "uvw" for a in "xyz"]


@query("camera_basis", f"select frame_id, {_rsql(_AX)} from {POSE_SQL} b")
def _(v):
    return _rounded(motion.with_pose(v.pose), ["frame_id"], _AX)


_M_SQL = "[ux, -vx, -wx, ex, uy, -vy, -wy, ey, uz, -vz, -wz, ez, 0e0, 0e0, 0e0, 1e0]"


def _cells(m, n=16):
    return [rnd(F.element_at(m, i + 1)).alias(f"m{i:02d}") for i in range(n)]


def _cells_sql(expr, n=16):
    return ", ".join(f"{r(f'({expr})[{i + 1}]')} as m{i:02d}" for i in range(n))


def _c2w(df):
    return df.withColumn("c2w", G.c2w_array(vec("u"), vec("v"), vec("w"), vec("e")))


@query("c2w_matrix", f"select frame_id, {_cells_sql(_M_SQL)} from {POSE_SQL} b")
def _(v):
    return _c2w(motion.with_pose(v.pose)).select("frame_id", *_cells(F.col("c2w")))


@query(
    "k_matrix",
    f"""select frame_id, {r("fx")} as k00, {r("cx")} as k02, {r("fy")} as k11, {r("cy")} as k12, 1e0 as k22,
               {r("uy")} as row1_0, {r("ey")} as row1_3 from {POSE_SQL} b""",
)
def _(v):
    p = _c2w(motion.with_pose(v.pose)).withColumns({"k": G.k_matrix("fx", "fy", "cx", "cy"), "rows": G.rows_of_4x4("c2w")})
    k = F.col("k")
    return p.select(
        "frame_id", rnd(k[0][0]).alias("k00"), rnd(k[0][2]).alias("k02"), rnd(k[1][1]).alias("k11"), rnd(k[1][2]).alias("k12"),
        k[2][2].alias("k22"), rnd(F.col("rows")[1][0]).alias("row1_0"), rnd(F.col("rows")[1][3]).alias("row1_3"),
    )


_W2C_SQL = """[ux, uy, uz, -(ux*ex + uy*ey + uz*ez), -vx, -vy, -vz, vx*ex + vy*ey + vz*ez,
               -wx, -wy, -wz, wx*ex + wy*ey + wz*ez, 0e0, 0e0, 0e0, 1e0]"""


@query("w2c", f"select frame_id, {_cells_sql(_W2C_SQL)} from {POSE_SQL} b")
def _(v):
    return G.with_affine_inverse(_c2w(motion.with_pose(v.pose)), "c2w", "inv").select("frame_id", *_cells(F.col("inv")))


@query(
    "unproject_ray",
    f"""select frame_id, {r("rx / n")} as rx, {r("ry / n")} as ry, {r("1e0 / n")} as rz from (
          select *, sqrt(rx * rx + ry * ry + 1e0) as n from (
            select *, (g * 3e0 - cx) / fx as rx, -(g * 17e-1 - cy) / fy as ry from {POSE_SQL} b) q) t""",
)
def _(v):
    p = motion.with_pose(v.pose)
    ray = G.pixel_ray(F.col("g") * 3.0, F.col("g") * 1.7, "fx", "fy", "cx", "cy")
    return p.select("frame_id", *[rnd(c).alias(f"r{a}") for a, c in zip("xyz", ray)])


_POINT = "(g % 5) - 2e0", "(g % 7) / 2e0", "(g % 60) - 5e0"


@query(
    "project_points",
    f"""select frame_id, case when zc > 1e-9 then {r("fx * xc / zc + cx", 4)} end as u, case when zc > 1e-9 then {r("-fy * yc / zc + cy", 4)} end as v from (
          select *, qx*ux + qy*uy + qz*uz as xc, -(qx*vx + qy*vy + qz*vz) as yc, -(qx*wx + qy*wy + qz*wz) as zc from (
            select *, {_POINT[0]} - ex as qx, {_POINT[1]} - ey as qy, {_POINT[2]} - ez as qz from {POSE_SQL} b) q) t""",
)
def _(v):
    p = _c2w(motion.with_pose(v.pose)).withColumn("w2c", G.rigid_inverse("c2w"))
    world = vec_of(F.col("g") % 5 - 2.0, F.col("g") % 7 / 2.0, F.col("g") % 60 - 5.0)
    p = p.withColumns(G.apply_point("w2c", world).as_columns("q"))
    uv = G.project_camera_point(vec("q"), "fx", "fy", "cx", "cy")
    return p.select("frame_id", rnd(uv["u"], 4).alias("u"), rnd(uv["v"], 4).alias("v"))


def _int_pixel_sql(px, py, pz):
    return f"""select *, case when zc > 1e-9 then cast(round(greatest(0e0, least(1e0, 5e-1 * (xc / (zc * hw) + 1e0))) * 319e0) as int) end as px,
                      case when zc > 1e-9 then cast(round(greatest(0e0, least(1e0, 5e-1 * (1e0 - yc / (zc * hh)))) * 179e0) as int) end as py from (
          select *, qx*ux + qy*uy + qz*uz as xc, qx*vx + qy*vy + qz*vz as yc, -(qx*wx + qy*wy + qz*wz) as zc,
                 tan(radians(vfov) / 2e0) as hh, tan(radians(vfov) / 2e0) * 320e0 / 180e0 as hw from (
            select *, {px} - ex as qx, {py} - ey as qy, {pz} - ez as qz from {{src}} b) q) t"""


@query("project_pixel_int", "select frame_id, px, py from (" + _int_pixel_sql(*_POINT).replace("{src}", POSE_SQL) + ") z")
def _(v):
    p = motion.with_pose(v.pose)
    world = vec_of(F.col("g") % 5 - 2.0, F.col("g") % 7 / 2.0, F.col("g") % 60 - 5.0)
    px = G.project_pixel_int(world, vec("e"), vec("u"), vec("v"), vec("w"), "vfov", F.lit(320.0) / 180.0, "w", "h")
    return p.select("frame_id", px["px"].alias("px"), px["py"].alias("py"))


_ROLL, _PITCH = "radians((g % 36) * 1e1)", "radians((g % 18) * 5e0)"
_CORNERS = f"""(select *, qx + (g % 5) - 2e0 as tx, cos({_PITCH}) * qy - sin({_PITCH}) * qz + 1e0 as ty, sin({_PITCH}) * qy + cos({_PITCH}) * qz + (g % 50) - 25e0 as tz from (
    select *, cos({_ROLL}) * sx - sin({_ROLL}) * sy as qx, sin({_ROLL}) * sx + cos({_ROLL}) * sy as qy, sz as qz from (
    select b.*, a.s * 75e-2 as sx, c.s * 75e-2 as sy, d.s * 75e-2 as sz from {POSE_SQL} b,
      (values (-1e0), (1e0)) a(s), (values (-1e0), (1e0)) c(s), (values (-1e0), (1e0)) d(s)) k) l)"""


@query(
    "project_box3d",
    "select frame_id, min(px) as x0, min(py) as y0, max(px) as x1, max(py) as y1, cast(count(px) > 0 as boolean) as valid from ("
    + _int_pixel_sql("tx", "ty", "tz").replace("{src}", f"(select * exclude (qx, qy, qz) from {_CORNERS} m)")
    + ") z group by 1",
)
def _(v):
    cubes = motion.with_pose(v.pose).withColumns(
        {
            "mx": F.col("g") % 5 - 2.0, "my": F.lit(1.0), "mz": F.col("g") % 50 - 25.0,
            "edge": F.lit(1.5), "roll": (F.col("g") % 36) * 10.0, "pitch": (F.col("g") % 18) * 5.0,
        }
    )
    from pixeltide.operators.boxes3d import project_cubes

    return project_cubes(cubes, ["frame_id"]).select("frame_id", "x0", "y0", "x1", "y1", "valid")


@query(
    "object_matrix",
    f"""select frame_id, {_cells_sql('''[cz*cy*2e0, (cz*sy*sx - sz*cx)*3e0, (cz*sy*cx + sz*sx)*5e-1, ex, sz*cy*2e0, (sz*sy*sx + cz*cx)*3e0, (sz*sy*cx - cz*sx)*5e-1, ey,
          -sy*2e0, cy*sx*3e0, cy*cx*5e-1, ez, 0e0, 0e0, 0e0, 1e0]''')},
          case when frame_id % 2 = 0 then 'logical_excludes_slope_and_vertex_snap' else 'logical_matches_baked_mesh' end as supervision
        from (select *, cos(radians(g * 3e0)) as cx, sin(radians(g * 3e0)) as sx, cos(radians(g * 7e0)) as cy, sin(radians(g * 7e0)) as sy,
                     cos(radians(g * 11e0)) as cz, sin(radians(g * 11e0)) as sz from $pose as p) q""",
)
def _(v):
    m = G.object_matrix(vec_of(F.col("g") * 3.0, F.col("g") * 7.0, F.col("g") * 11.0), vec_of(2.0, 3.0, 0.5), vec("e"))
    p = v.pose.withColumn("m", m)
    sup = G.transform_supervision(F.col("frame_id") % 2 == 0).alias("supervision")
    return p.select("frame_id", *_cells(F.col("m")), sup)


@query("focus_distance", f"select frame_id, {r('sqrt((ex-ax)*(ex-ax) + (ey-ay)*(ey-ay) + (ez-az)*(ez-az))')} as focus from $pose as p")
def _(v):
    return v.pose.select("frame_id", rnd(G.focus_distance(vec("e"), vec("a"))).alias("focus"))


_PREV_COLS = ["ex", "ey", "ez"]


def _prev_sql(src, part):
    lag = ", ".join(f"coalesce(lag({c}) over (partition by {part} order by g), {c}) as p_{c}" for c in _PREV_COLS)
    return f"select frame_id, {lag} from {src} b"


@query("prev_camera", _prev_sql("$pose", "run_id"))
def _(v):
    out = motion.previous_camera(v.pose, _PREV_COLS, width=16)
    return out.select("frame_id", *[F.col(f"prev.{c}").alias(f"p_{c}") for c in _PREV_COLS])


@query("prev_camera_sharded", _prev_sql("$pose", "run_id, g % 3"))
def _(v):
    out = motion.previous_camera(v.pose, _PREV_COLS, num_shards=3, width=16)
    return out.select("frame_id", *[F.col(f"prev.{c}").alias(f"p_{c}") for c in _PREV_COLS])


_PCOLS = [p + a for p in "euvw" for a in "xyz"]
_FLOW_CAM = f"""(select *, {", ".join(f"coalesce(lag({c}) over (partition by run_id order by g), {c}) as p{c}" for c in _PCOLS)} from {FCAM_SQL} b)"""
_FLOW = f"""(select *, case when vis then fx * xc / zc + cx - px_col else 0e0 end as flow_x, case when vis then fy * yc / zc + cy - px_row else 0e0 end as flow_y from (
    select *, depth < 1e29 and zc > 0 as vis from (
    select *, sx*pux + sy*puy + sz*puz as xc, -(sx*pvx + sy*pvy + sz*pvz) as yc, -(sx*pwx + sy*pwy + sz*pwz) as zc from (
    select *, ex + depth * rx / rl - pex as sx, ey + depth * ry / rl - pey as sy, ez + depth * rz / rl - pez as sz from (
    select *, sqrt(rx*rx + ry*ry + rz*rz) as rl from (
    select *, a*ux + b*vx - wx as rx, a*uy + b*vy - wy as ry, a*uz + b*vz - wz as rz from (
    select c.*, p.* exclude (frame_id), (px_col - cx) / fx as a, (cy - px_row) / fy as b from $px as p join {_FLOW_CAM} c on p.frame_id = c.frame_id) f0) f1) f2) f3) f4) f5)"""


def _flow(v):
    cams = motion.previous_camera(motion.with_pose(v.fcam), motion.POSE)
    return motion.optical_flow(v.px, cams)


@query(
    "optical_flow",
    f"select frame_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, px_col, px_row, {r('flow_x', 3)} as flow_x, {r('flow_y', 3)} as flow_y from {_FLOW} f",
)
def _(v):
    return _rounded(_flow(v), ["frame_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px_col", "px_row"], ["flow_x", "flow_y"], 3)


@query(
    "flow_coverage",
    f"""select frame_id, visible, moving, {r("fraction")} as fraction, cast(fraction >= 1e-1 as boolean) as ok from (
          select *, cast(moving as double) / nullif(visible, 0) as fraction from (
            select frame_id, cast(count(case when depth < 1e28 then 1 end) as bigint) as visible,
                   cast(count(case when depth < 1e28 and sqrt(flow_x*flow_x + flow_y*flow_y) > 1e-1 then 1 end) as bigint) as moving
            from {_FLOW} f group by 1) g) h""",
)
def _(v):
    return motion.flow_coverage(_flow(v)).withColumn("fraction", rnd("fraction"))


_CLOUD = f"""(select *, ex + depth * dx_ as x, ey + depth * dy_ as y, ez + depth * dz_ as z from (
    select *, (a*ux - b*vx - wx) / rl as dx_, (a*uy - b*vy - wy) / rl as dy_, (a*uz - b*vz - wz) / rl as dz_ from (
    select *, sqrt(a*a + b*b + 1e0) as rl from (
    select c.*, p.* exclude (frame_id), (px_col - cx) / fx as a, -(px_row - cy) / fy as b from $px as p join {FCAM_SQL} c on p.frame_id = c.frame_id
    where not isnan(depth) and abs(depth) < cast('infinity' as double) and depth > 1e-3) f0) f1) f2)"""
_CLOUD_KEYS = ["frame_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px_col", "px_row"]


@query(
    "point_cloud",
    f"""select {", ".join(_CLOUD_KEYS)}, {r("x / greatest(depth, 1e0)")} as x, {r("y / greatest(depth, 1e0)")} as y, {r("z / greatest(depth, 1e0)")} as z from {_CLOUD} c""",
)
def _(v):
    # Coordinates are compared in units of the depth: miss pixels stay in the cloud at 1e30.
    pts = cloud.point_cloud(v.px, motion.with_pose(v.fcam))
    return pts.select(*_CLOUD_KEYS, *[rnd(F.col(a) / F.greatest("depth", F.lit(1.0))).alias(a) for a in "xyz"])


# Pixels of frame arrays; frames stay arrays on the Spark side until their camera has joined them.
_EPX = """(select vec_id as frame_id, cast(pos % 8 as int) as px_col, cast(floor(pos / 8e0) as int) as px_row, abs(cast(depth as double)) * 2e1 + 1e0 as depth
           from (select vec_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as depth from @embeddings@) e) p"""


def _frame_arrays(v):
    emb = v.spark.read.parquet(f"{v.sf_dir}/embeddings.parquet")
    return emb.select(F.col("vec_id").alias("frame_id"), F.lit(8).alias("width"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * 2e1 + 1e0).alias("depth"))


_FRAME_FLOW = _FLOW.replace("$px as p", _EPX).replace("$fcam", "$ecam")


@query("frame_flow", f"select frame_id, px_row, px_col, {r('flow_x', 3)} as flow_x, {r('flow_y', 3)} as flow_y from {_FRAME_FLOW} f")
def _(v):
    cams = motion.previous_camera(motion.with_pose(v.ecam), motion.POSE)
    return _rounded(motion.frame_flow(_frame_arrays(v), cams), ["frame_id", "px_row", "px_col"], ["flow_x", "flow_y"], 3)


_FRAME_CLOUD = _CLOUD.replace("$px as p", _EPX).replace("$fcam", "$ecam")


@query("frame_cloud", f"select frame_id, px_row, px_col, {r('x', 5)} as x, {r('y', 5)} as y, {r('z', 5)} as z from {_FRAME_CLOUD} c")
def _(v):
    return _rounded(cloud.frame_cloud(_frame_arrays(v), motion.with_pose(v.ecam)), ["frame_id", "px_row", "px_col"], ["x", "y", "z"], 5)


_EXT = [f"{a}_{m}" for a in "xyz" for m in ("min", "max")]


@query(
    "point_extent",
    f"""select frame_id, {", ".join(f"{r(f'{m}({a})', 4)} as {a}_{m}" for a in "xyz" for m in ("min", "max"))} from {_CLOUD} c where depth < 1e6 group by 1""",
)
def _(v):
    from pixeltide.functions import masks

    pts = cloud.point_cloud(v.px, motion.with_pose(v.fcam), mask=masks.train())
    return _rounded(cloud.point_extent(pts, ["frame_id"]), ["frame_id"], _EXT, 4)


@query(
    "cloud_summary",
    """select p.frame_id, n as points, depth_min, depth_max, ex, ey, ez from (
         select frame_id, cast(count(*) as bigint) as n, min(depth) as depth_min, max(depth) as depth_max from $px as p
         where not isnan(depth) and abs(depth) < cast('infinity' as double) and depth > 1e-3 group by 1) p
       join $fcam as c on p.frame_id = c.frame_id""",
)
def _(v):
    return cloud.cloud_summary(v.px, v.fcam)


_ROW_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def md5_unit(*parts):
    joined = ", ".join(f"cast({p} as string)" for p in parts)
    return f"(cast(cast('0x' || substr(md5(concat_ws(':', {joined})), 1, 13) as bigint) as double) / 4503599627370496e0)"


def _pick_sql(seed, k, where):
    return f"""select frame_id, {", ".join(_ROW_KEYS)} from (
        select *, row_number() over (partition by frame_id order by {md5_unit(seed, "frame_id", *_ROW_KEYS)}, {", ".join(_ROW_KEYS)}) as rn
        from $px as p where {where}) q where rn <= {k}"""


@query("subsample_points", _pick_sql(7, 100, "depth > 1e-3"))
def _(v):
    from pixeltide.functions import masks

    pts = v.px.filter(masks.cloud()).select("frame_id", *_ROW_KEYS)
    return cloud.subsample(pts, 100, 7, row_keys=_ROW_KEYS, portable=True)


@query("foreground_probe", _pick_sql(0, 8, "instance_id > 0 and depth > 0 and abs(depth) < cast('infinity' as double)"))
def _(v):
    px = v.px.select("frame_id", "depth", "instance_id", *_ROW_KEYS)
    return cloud.foreground_probe(px, 8, 0, row_keys=_ROW_KEYS, portable=True).select("frame_id", *_ROW_KEYS)


# Stored poses, some with a moved origin, a stretched axis or a wrong focal length.
_STORED = f"""(select *, ex + case when frame_id % 7 = 1 then 5e-1 else 0e0 end as qx, ux * case when frame_id % 11 = 2 then 11e-1 else 1e0 end as sux,
                      uz * case when frame_id % 11 = 2 then 11e-1 else 1e0 end as suz, fx + case when frame_id % 13 = 3 then 2e0 else 0e0 end as sfx from {POSE_SQL} b)"""
# In the matrix's own axes (right and down are orthogonal to the view, and stay so when right is stretched).
_AHEAD = """(select *, ((qx - ex) * sux + 0e0) / (sux * sux + suz * suz) as pr, -((qx - ex) * vx) as pd, 5e0 - (qx - ex) * wx as pz from """ + _STORED + " s)"
_AUDIT = f"""(select frame_id, case when pz > 1e-9 then sqrt((sfx * pr / pz) * (sfx * pr / pz) + (fy * pd / pz) * (fy * pd / pz)) end as centre_err, abs(qx - ex) as origin_err,
                     greatest(abs(sux * sux + suz * suz - 1e0), abs(vx * vx + vy * vy + vz * vz - 1e0), abs(wx * wx + wy * wy + wz * wz - 1e0),
                              abs(sux * vx + suz * vz), abs(sux * wx + suz * wz), abs(vx * wx + vy * wy + vz * wz)) as basis_err, abs(sfx - fx) as focal_err from {_AHEAD} a)"""


@query(
    "pose_audit",
    f"""select frame_id, {r("centre_err", 5)} as centre_err, {r("origin_err", 5)} as origin_err, {r("basis_err", 5)} as basis_err, {r("focal_err", 5)} as focal_err,
               coalesce(centre_err <= 5e-1 and origin_err <= 1e-4 and basis_err <= 1e-4 and focal_err <= 1e-3, false) as ok from {_AUDIT} q""",
)
def _(v):
    p = motion.with_pose(v.pose)
    one = F.when(F.col("frame_id") % 11 == 2, 1.1).otherwise(1.0)
    u = Vec(F.col("ux") * one, F.col("uy") * one, F.col("uz") * one)
    p = p.withColumns(
        {
            "c2w": G.c2w_array(u, vec("v"), vec("w"), vec("e")),
            "lookfrom": F.array(F.col("ex") + F.when(F.col("frame_id") % 7 == 1, 0.5).otherwise(0.0), "ey", "ez"),
            "fx": F.col("fx") + F.when(F.col("frame_id") % 13 == 3, 2.0).otherwise(0.0),
        }
    )
    out = cloud.pose_audit(p)
    return out.select("frame_id", *[rnd(c, 5).alias(c) for c in ("centre_err", "origin_err", "basis_err", "focal_err")], "ok")


@query(
    "projection_audit",
    f"""select c.frame_id, true as centre_ok, cast(coalesce(s.n, 0) as bigint) as samples, true as ok from $fcam as c
        left join (select frame_id, count(*) as n from ({_pick_sql(0, 8, "instance_id > 0 and depth > 0 and abs(depth) < cast('infinity' as double)")}) q group by 1) s
        on c.frame_id = s.frame_id""",
)
def _(v):
    out = cloud.projection_audit(v.px, motion.with_pose(v.fcam), row_keys=_ROW_KEYS, portable=True)
    return out.select("frame_id", (F.col("centre_err") < 1e-6).alias("centre_ok"), "samples", "ok")


# Probes from the true camera to one whose origin, right axis or focal length may be off, in that one's own axes.
_PROBE = f"""(select p.frame_id, p.px_col, p.px_row, c.* exclude (frame_id), depth / sqrt(a * a + b * b + 1e0) as s, a, b from (
        select p.*, (p.px_col - c.cx) / c.fx as a, (p.px_row - c.cy) / c.fy as b from (
          select p.* from $px as p join ({_pick_sql(0, 8, "instance_id > 0 and depth > 0 and abs(depth) < cast('infinity' as double)")}) k
          on {" and ".join(f"p.{k} = k.{k}" for k in ("frame_id", *_ROW_KEYS))}) p join {FCAM_SQL} c on p.frame_id = c.frame_id) p
      join (select *, case when frame_id % 7 = 1 then 5e-1 else 0e0 end as ox, case when frame_id % 11 = 2 then 11e-1 else 1e0 end as k, fx + case when frame_id % 13 = 3 then 2e0 else 0e0 end as sfx from {FCAM_SQL} b) c
      on p.frame_id = c.frame_id)"""
_BACK = f"""(select *, (hx * ux + hy * uy + hz * uz) / k as pr, -(hx * vx + hy * vy + hz * vz) as pd, -(hx * wx + hy * wy + hz * wz) as pz from (
        select *, (ux * a + vx * b - wx) * s - ox as hx, (uy * a + vy * b - wy) * s as hy, (uz * a + vz * b - wz) * s as hz from {_PROBE} q) q)"""
_ERRS = f"(select frame_id, sqrt((sfx * pr / pz + cx - px_col) * (sfx * pr / pz + cx - px_col) + (cy - fy * pd / pz - px_row) * (cy - fy * pd / pz - px_row)) as err, pz > 1e-9 as ahead from {_BACK} q)"


@query(
    "foreground_audit",
    f"""select c.frame_id, case when ahead then {r("err", 4)} end as pixel_err, cast(coalesce(n, 0) as bigint) as samples, coalesce(n, 0) = 0 or (ahead and err <= 1e0) as ok
        from $fcam as c left join (select frame_id, max(err) as err, bool_and(ahead) as ahead, count(*) as n from {_ERRS} q group by 1) s on c.frame_id = s.frame_id""",
)
def _(v):
    f = F.col("frame_id")
    cams = motion.with_pose(v.fcam)
    right = Vec(*[F.col(f"u{a}") * F.when(f % 11 == 2, 1.1).otherwise(1.0) for a in "xyz"])
    eye = Vec(F.col("ex") + F.when(f % 7 == 1, 0.5).otherwise(0.0), F.col("ey"), F.col("ez"))
    cams = cams.withColumns({"stored_c2w": G.c2w_array(right, vec("v"), vec("w"), eye), "stored_fx": F.col("fx") + F.when(f % 13 == 3, 2.0).otherwise(0.0), "stored_fy": F.col("fy")})
    return cloud.foreground_audit(v.px, cams, row_keys=_ROW_KEYS, portable=True).select("frame_id", rnd("pixel_err", 4).alias("pixel_err"), "samples", "ok")


@query(
    "split_assign",
    "select run_id, g, case when g < round(100 * greatest(0e0, least(1e0, (run_id % 14) / 1e1))) then 'train' else 'val' end as split from $pose as p",
)
def _(v):
    p = v.pose.withColumn("s", F.col("run_id") % 14 / 1e1)
    return frames.assign_split(p, "g", F.lit(100), "s").select("run_id", "g", "split")


@query("shard_assign", "select frame_id, cast(frame_id % 6 as int) as shard from $pose as p")
def _(v):
    return frames.assign_shard(v.pose, "frame_id", 6).select("frame_id", "shard")


@query(
    "frame_names",
    """select frame_id, stem, concat('train/', stem, '.png') as png_path, concat('train/', stem, '_spatial.exr') as pixels_path,
              concat('train/', stem, '_meta.json') as meta_path, concat('train/', stem, '.txt') as label_path
       from (select frame_id, concat('sfrm_', lpad(cast(frame_id as string), cast(greatest(4, length(cast(frame_id as string))) as int), '0')) as stem from $pose as p) q""",
)
def _(v):
    p = v.pose.select("frame_id", F.lit("train").alias("split"))
    return frames.frame_names(p, "frame_id", kind="sfrm").drop("split")
