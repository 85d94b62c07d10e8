from pyspark.sql import functions as F

from pixeltide.checks.camera_checks import md5_unit
from pixeltide.checks.core import query, r
from pixeltide.checks.frame_checks import _interp_sql
from pixeltide.functions.columns import rnd
from pixeltide.plans import configs as C
from pixeltide.plans import generation as GEN


def _register(name, sql):
    """JSON paths carry a dollar sign, which the view syntax also uses; they are put back after expansion."""
    from pixeltide.checks.core import ORACLES

    def wrap(fn):
        query(name, sql)(fn)
        ORACLES[name] = ORACLES[name].replace("\x00", "$")
        return fn

    return wrap


@_register(
    "config_keys",
    """select config_id, path, unnest(json_keys(o)) as key from (
         select config_id, '' as path, doc::json as o from $cfg as c
         union all select config_id, 'assets[0]', json_extract(doc, '\x00.assets[0]') from $cfg as c
         union all select config_id, 'dataset', json_extract(doc, '\x00.dataset') from $cfg as c
         union all select config_id, 'camera', json_extract(doc, '\x00.camera') from $cfg as c where json_extract(doc, '\x00.camera') is not null
         union all select config_id, 'camera.fov_deg', json_extract(doc, '\x00.camera.fov_deg') from $cfg as c where json_extract(doc, '\x00.camera') is not null
         union all select config_id, 'assets[0].roughness', json_extract(doc, '\x00.assets[0].roughness') from $cfg as c where json_type(doc, '\x00.assets[0].roughness') = 'OBJECT') q""",
)
def _(v):
    return C.config_keys(C.config_objects(v.cfg)).select("config_id", "path", "key")


@_register(
    "config_lint",
    """select config_id, 'error' as severity, 'unknown_key' as code, 'assets[0].bogus' as path from $cfg as c where json_extract(doc, '\x00.assets[0].bogus') is not null
       union all select config_id, 'error', 'unknown_key', 'mystery' from $cfg as c where json_extract(doc, '\x00.mystery') is not null
       union all select config_id, 'error', 'deprecated_key', 'assets[0].obj' from $cfg as c where json_extract(doc, '\x00.assets[0].obj') is not null
       union all select config_id, 'error', 'bad_range', 'assets[0].roughness' from $cfg as c where json_type(doc, '\x00.assets[0].roughness') = 'VARCHAR'
       union all select config_id, 'error', 'bad_hdr', 'hdr' from $cfg as c where json_type(doc, '\x00.hdr') = 'UBIGINT'""",
)
def _(v):
    return C.lint(v.cfg)


_RNG = """json_type(doc, '{p}') = 'OBJECT' then {f}(cast(json_extract(doc, '{p}.min') as double), cast(json_extract(doc, '{p}.max') as double))
   when json_type(doc, '{p}') in ('DOUBLE', 'UBIGINT', 'BIGINT') then cast(json_extract(doc, '{p}') as double)"""


def _rng(path, fn, default):
    return ("case when " + _RNG.replace("{p}", path).replace("{f}", fn) + f" else {default} end").replace("$", "\x00")


_NAME = "json_extract_string(doc, '\x00.assets[0].name')"
_PATH = "json_extract_string(doc, '\x00.assets[0].path')"


@_register(
    "asset_catalog",
    f"""select config_id, cast(0 as int) as asset_ord, coalesce({_NAME}, regexp_extract({_PATH}, '[^/]*$', 0)) as name, {_PATH} as path,
               coalesce({_NAME}, regexp_extract({_PATH}, '[^/]*$', 0)) as label, cast(json_extract(doc, '\x00.assets[0].scale') as double) as scale,
               {_rng("$.assets[0].roughness", "least", "5e-1")} as rough_min, {_rng("$.assets[0].roughness", "greatest", "5e-1")} as rough_max from $cfg as c""",
)
def _(v):
    a = C.asset_catalog(v.cfg)
    return a.select("config_id", "asset_ord", "name", "path", "label", "scale", F.col("roughness.min").alias("rough_min"), F.col("roughness.max").alias("rough_max"))


@_register(
    "range_norm",
    f"select config_id, {_rng('$.camera.fov_deg', 'least', 'null')} as fov_min, {_rng('$.camera.fov_deg', 'greatest', 'null')} as fov_max from $cfg as c",
)
def _(v):
    from pixeltide.functions import jsonfn as J

    c = C.parsed(v.cfg).withColumn("f", J.scalar_range(J.field(J.field(F.col("__v"), "camera"), "fov_deg")))
    return c.select("config_id", F.col("f.min").alias("fov_min"), F.col("f.max").alias("fov_max"))


@_register(
    "resolve_config",
    f"""select config_id, cast(1280 as bigint) as width, {_rng("$.camera.fov_deg", "least", "35e0")} as fov_min, {_rng("$.camera.fov_deg", "greatest", "35e0")} as fov_max,
               18e0 as eye_x, 3e2 as sun_az, -22e0 as xmin, cast(96 as bigint) as nx, coalesce(case when json_type(doc, '\x00.hdr') = 'VARCHAR' then json_extract_string(doc, '\x00.hdr') end, '') as hdr_path,
               'out' as dataset_root, least(1e0, cast(json_extract(doc, '\x00.dataset.train_split') as double)) as train_split from $cfg as c""",
)
def _(v):
    c = C.resolve_config(v.cfg)
    return c.select(
        "config_id", F.col("render.width").alias("width"), F.col("camera.fov_deg.min").alias("fov_min"), F.col("camera.fov_deg.max").alias("fov_max"),
        F.col("camera.lookfrom.max")[0].alias("eye_x"), F.col("lighting.sun_azimuth_deg.min").alias("sun_az"), F.col("terrain.xmin").alias("xmin"),
        F.col("terrain.nx").alias("nx"), "hdr_path", "dataset_root", "train_split",
    )


@query("config_digest")
def _(v):
    return C.resolved_json(C.resolve_config(v.cfg)).select("config_id", "resolved_config", "resolved_config_sha256")


_NODES = """(select config_id, 0 as scenario, 'scenarios[0].root_nodes[0]' as path, cast(null as string) as parent, 0 as ord, 'a' as name, 'crate' as asset,
           cast(config_id % 9 as double) as lx, 0e0 as ry, case when config_id % 2 = 0 then 2e0 else 3e0 end as sz, false as grounded from $scfg as c
    union all select config_id, 0, 'scenarios[0].root_nodes[0].children[0]', 'scenarios[0].root_nodes[0]', 0, 'b', '', 0e0, cast(config_id % 7 as double), 1e0, false from $scfg as c
    union all select config_id, 0, 'scenarios[0].root_nodes[0].children[1]', 'scenarios[0].root_nodes[0]', 1, 'c', 'crate', 0e0, 0e0, 1e0, true from $scfg as c
    union all select config_id, 0, 'scenarios[0].root_nodes[1]', null, 1, 'd', 'crate', 0e0, 0e0, 1e0, false from $scfg as c
    union all select config_id, 1, 'scenarios[1].root_nodes[0]', null, 0, 'e', '', 0e0, 0e0, 1e0, false from $scfg as c)"""


@query("scene_nodes", f"select * from {_NODES} n")
def _(v):
    nodes = C.scene_nodes(C.config_objects(v.scfg))
    up = nodes.select("config_id", F.col("node_id").alias("parent_id"), F.col("path").alias("parent"))
    nodes = nodes.join(up, ["config_id", "parent_id"], "left")
    return nodes.select("config_id", "scenario", "path", "parent", "ord", "name", "asset", "lx", "ry", "sz", "grounded")


@query(
    "config_keyframes",
    """select config_id, 0 as scenario, k as pos, cast(k as double) as t, case when k = 0 then 4e0 else 1e0 end as px, case when k = 0 then 6e0 else 3e0 end as pz
       from (select config_id, unnest([0, 1]) as k from $scfg as c where config_id % 3 = 0) q""",
)
def _(v):
    return C.config_keyframes(C.resolve_config(v.scfg)).select("config_id", "scenario", "pos", "t", "px", "pz")


@query(
    "scenario_objects",
    """select config_id, scenario, instance_id, name, x, grounded from (
         select config_id, 0 as scenario, 1 as instance_id, 'a' as name, cast(config_id % 9 as double) as x, false as grounded from $scfg as c
         union all select config_id, 0, 2, 'c', cast(config_id % 9 as double), true from $scfg as c
         union all select config_id, 0, 3, 'd', 0e0, false from $scfg as c) q""",
)
def _(v):
    nodes = C.scene_nodes(C.config_objects(v.scfg))
    objects = GEN.scenario_objects(nodes, C.asset_catalog(v.scfg))
    return objects.select("config_id", "scenario", F.explode("objects").alias("o")).select(
        "config_id", "scenario", F.col("o.instance_id").cast("int").alias("instance_id"), F.col("o.name").alias("name"), F.col("o.position")[0].alias("x"),
        F.col("o.grounding_constraint").alias("grounded"),
    )


@query("scene_lint", "select config_id, 'error' as severity, 'bad_type' as code, 'scenarios[1].root_nodes[0].position' as path from $scfg as c where config_id % 5 = 0")
def _(v):
    return C.lint(v.scfg)


def _plan_inputs(v):
    o = v.spark.read.parquet(f"{v.sf_dir}/orders.parquet")
    plan = o.select(F.floor(F.col("o_custkey") / 1e1).cast("bigint").alias("config_id"), F.col("o_orderkey").alias("g"))
    ranges = GEN.config_ranges(C.resolve_config(v.cfg))
    one = F.struct(F.lit(0.2).alias("min"), F.lit(0.6).alias("max"))
    assets = v.assets.withColumnRenamed("catalog_id", "config_id").withColumns(
        {"label": F.col("name"), "class_id": F.lit(1), "scale": F.lit(1.5), "y_offset": F.lit(0.5), "roughness": one, "metallic": one}
    )
    return plan, ranges, assets


def _u(field):
    return md5_unit(1337, "g", f"'{field}'")


_SAMPLED = f"""(select p.config_id, p.g, asset_ord, s.name as label, sp, lo, hi
        from (select cast(floor(o_custkey / 1e1) as bigint) as config_id, o_orderkey as g from @orders@) p
        join (select config_id, {_rng("$.camera.fov_deg", "least", "35e0")} as lo, {_rng("$.camera.fov_deg", "greatest", "35e0")} as hi, cast(config_id % 12 as double) / 1e1 as sp from $cfg as c) c on p.config_id = c.config_id
        join (select *, sum(wi) over (partition by catalog_id order by asset_ord) as top, sum(wi) over (partition by catalog_id) as total from (
                select *, cast(round(greatest(weight, 1e-3) * 1e9) as bigint) as wi from $assets as a) q) s
          on s.catalog_id = p.config_id and {_u('asset')} >= cast(s.top - s.wi as double) / cast(s.total as double) and {_u('asset')} < cast(s.top as double) / cast(s.total as double))"""


@_register(
    "sample_frames",
    f"""select config_id, g, asset_ord, {r(f"lo + (hi - lo) * {_u('fov')}")} as fov, {r(f"-18e0 + 36e0 * {_u('obj_x')}")} as obj_x, {r(f"36e1 * {_u('obj_yaw')}")} as obj_yaw,
               {r(f"5e-1 - (1e-2 + 4e-2 * {_u('sink')})")} as y_offset, {r(f"2e-1 + 4e-1 * {_u('roughness')}")} as roughness
        from {_SAMPLED} p""",
)
def _(v):
    plan, ranges, assets = _plan_inputs(v)
    out = GEN.sample_frames(plan, ranges, assets, F.lit(1000))
    return out.select("config_id", "g", "asset_ord", *[rnd(c).alias(c) for c in ("fov", "obj_x", "obj_yaw", "y_offset", "roughness")])


@_register(
    "frame_object_rows",
    f"""select config_id, g, case when g < round(1000 * greatest(0e0, least(1e0, sp))) then 'train' else 'val' end as split, cast(1 as bigint) as instance_id, cast(1 as bigint) as class_id, label,
               {r(f"-18e0 + 36e0 * {_u('obj_x')}")} as x, 0e0 as y, {r(f"-18e0 + 36e0 * {_u('obj_z')}")} as z, {r(f"36e1 * {_u('obj_yaw')}")} as yaw, 15e-1 as sz,
               {r(f"2e-1 + 4e-1 * {_u('metallic')}")} as metallic, true as grounded, 1e0 as ny
        from {_SAMPLED} p""",
)
def _(v):
    out = GEN.frame_objects(GEN.sample_frames(*_plan_inputs(v), F.lit(1000))).select("config_id", "g", "split", F.explode("objects").alias("o"))
    at = lambda name, i: F.col(f"o.{name}")[i]
    return out.select(
        "config_id", "g", "split", "o.instance_id", "o.class_id", "o.label", rnd(at("position", 0)).alias("x"), at("position", 1).alias("y"), rnd(at("position", 2)).alias("z"),
        rnd(at("rotation_deg", 1)).alias("yaw"), at("scale", 2).alias("sz"), rnd("o.metallic").alias("metallic"), F.col("o.grounding_constraint").alias("grounded"), at("terrain_normal", 1).alias("ny"),
    )


@query("frame_objects")
def _(v):
    out = GEN.frame_objects(GEN.sample_frames(*_plan_inputs(v), F.lit(1000)))
    return out.select("config_id", "g", "split", "objects")


@query(
    "scenario_frames",
    "select g, px as ex, py as ey, pz as ez from ("
    + _interp_sql("(select g, traj_id, g / greatest(1e0, (select max(o_orderkey) from @orders@)) as alpha from $kf_time as t0)")
    + ") q",
)
def _(v):
    # The number of frames joins as one row.
    plan = v.kf_time.select("g", "traj_id").withColumn("one", F.lit(1))
    last = plan.groupBy("one").agg((F.max("g") + 1).alias("total"))
    plan = plan.join(F.broadcast(last), "one").drop("one")
    scen = v.kf.select("traj_id").distinct().withColumns(
        {"ax": F.lit(0.0), "ay": F.lit(1.2), "az": F.lit(0.0), "fallback_x": F.lit(0.0), "fallback_y": F.lit(0.0), "fallback_z": F.lit(0.0)}
    )
    out = GEN.scenario_frames(plan, scen, v.kf, ["traj_id"], "total")
    return out.select("g", *[rnd(c).alias(c) for c in ("ex", "ey", "ez")])
