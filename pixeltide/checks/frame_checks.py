from pyspark.sql import functions as F

from pixeltide import constants as K
from pixeltide.checks.camera_checks import md5_unit
from pixeltide.checks.core import query, r
from pixeltide.functions import text
from pixeltide.functions.columns import hash_uniform, rnd
from pixeltide.operators import frames, placement, raster, trajectories, tree

GRID = raster.Grid(-10.0, 10.0, -10.0, 10.0, 4, 4)


def file_listing(v):
    """Frame images and their sidecars as single files."""
    f = v.files.withColumn("stem", F.regexp_replace("file_name", r"\.png$", ""))
    names = F.array(
        F.struct(F.col("file_name").alias("name"), F.col("size_bytes").alias("length")),
        F.when(F.col("has_txt"), F.struct(F.concat("stem", F.lit(".txt")).alias("name"), F.lit(1).cast("bigint").alias("length"))),
        F.when(F.col("has_meta"), F.struct(F.concat("stem", F.lit("_meta.json")).alias("name"), F.lit(2).cast("bigint").alias("length"))),
    )
    return f.select(F.lit("r").alias("root"), "split", F.explode(names).alias("n")).filter("n is not null").select("root", "split", "n.*")


@query(
    "scan_frames",
    """select split, replace(file_name, '.png', '') as stem, true as has_png, bool_or(has_txt) as has_txt, bool_or(has_meta) as has_meta, max(size_bytes) as size_bytes,
              max(cast(regexp_extract(file_name, 'frame_(\\d+)', 1) as bigint)) as frame_id
       from $files as f group by 1, 2""",
)
def _(v):
    inv = frames.frame_inventory(file_listing(v))
    return inv.select("split", "stem", "has_png", "has_txt", "has_meta", "size_bytes", "frame_id")


@query(
    "stem_family",
    """select root, case when min(case when kind = 0 then 1 else 0 end) = 1 and bool_or(split = 'train') then 'frame' when max(vote) is not null then min(vote) else 'frame' end as family from (
         select root, split, min(odd) as kind, case when min(odd) = max(odd) then (case when min(odd) = 0 then 'frame' else 'sfrm' end) end as vote from (
           select concat('r', cast(o_custkey % 50 as string)) as root, case when o_custkey % 50 % 3 = 0 then 'train' else 'val' end as split,
                  case when o_custkey % 50 < 20 then 0 when o_custkey % 50 < 40 then 1 else o_orderkey % 2 end as odd from @orders@) t group by 1, 2) q group by 1""",
)
def _(v):
    o = v.spark.read.parquet(f"{v.sf_dir}/orders.parquet")
    k = F.col("o_custkey") % 50
    odd = F.when(k < 20, 0).when(k < 40, 1).otherwise(F.col("o_orderkey") % 2)
    listing = o.select(
        F.concat(F.lit("r"), k.cast("string")).alias("root"),
        F.when(k % 3 == 0, "train").otherwise("val").alias("split"),
        F.concat(text.frame_stem("o_orderkey", F.when(odd == 0, "frame").otherwise("sfrm")), F.lit("_meta.json")).alias("name"),
    )
    return frames.stem_family(listing)


@query(
    "stem_parse",
    """select file_name, 'frame' as kind, cast(regexp_extract(file_name, 'frame_(\\d+)', 1) as bigint) as idx,
              case when length(file_name) = 14 then cast(substr(file_name, 7, 4) as bigint) end as idx_four from (select distinct file_name from $files as f) q""",
)
def _(v):
    f = v.files.select("file_name").distinct()
    p, four = text.parse_stem("file_name"), text.parse_stem("file_name", K.IMAGE_NAME_STRICT)
    return f.select("file_name", p["kind"].alias("kind"), p["index"].alias("idx"), four["index"].alias("idx_four"))


_INV = """(select split, replace(file_name, '.png', '') as stem, bool_or(has_txt) as has_txt, bool_or(has_meta) as has_meta from $files as f group by 1, 2)"""


@query(
    "sidecar_pairing",
    f"select split, stem, 'label' as missing from {_INV} i where not has_txt union all select split, stem, 'meta' from {_INV} i where not has_meta",
)
def _(v):
    inv = frames.frame_inventory(file_listing(v)).drop("has_pixels")
    return frames.sidecar_gaps(inv).select("split", "stem", "missing")


@query("select_split", "select root, frame_id from $fr as f where split = 'val'")
def _(v):
    return frames.select_split(v.fr, "val").select("root", "frame_id")


@query("union_splits", "select root, split, frame_id from $fr as f where split in ('train', 'val') order by root, split, frame_id")
def _(v):
    return frames.select_split(v.fr, "both").select("root", "split", "frame_id").orderBy("root", "split", "frame_id")


_IDX = "(select root, split, frame_id, row_number() over (partition by root order by split, frame_id) - 1 as sample_index from $fr as f)"


@query("frame_index", f"select * from {_IDX} i")
def _(v):
    return frames.frame_index(v.fr, width=64).select("root", "split", "frame_id", "sample_index")


@query("shard_pack_index", f"select root, split, frame_id, sample_index as pack_index, cast(floor(sample_index / 1e2) as bigint) as pack_shard from {_IDX} i")
def _(v):
    return frames.shard_pack_index(v.fr, 100, width=64).select("root", "split", "frame_id", "pack_index", "pack_shard")


@query("head_samples", f"select * from {_IDX} i order by sample_index, root limit 50")
def _(v):
    idx = frames.frame_index(v.fr).select("root", "split", "frame_id", "sample_index")
    return idx.orderBy("sample_index", "root").limit(50)


@query(
    "resolution_check",
    f"select root, batch, cast(count(distinct w * 10000 + h) as bigint) as sizes from (select root, w, h, cast(floor((row_number() over (partition by root order by split, frame_id) - 1) / 4e0) as bigint) as batch from $fr as f) b group by 1, 2 having count(distinct w * 10000 + h) > 1",
)
def _(v):
    b = frames.batches(frames.frame_index(v.fr), 4)
    return frames.resolution_check(b, ["root", "batch"])


@query(
    "layout_counts",
    """select root, cast(frame_id % 3 as int) as shard, cast(count(*) as bigint) as frames_total, cast(count(case when split = 'train' then 1 end) as bigint) as train_frames,
              cast(count(case when split = 'val' then 1 end) as bigint) as val_frames from $fr as f group by 1, 2""",
)
def _(v):
    return frames.layout_counts(frames.assign_shard(v.fr, "frame_id", 3), ["root"], "shard")


_SEG = """(select *, lead(t) over w as t1, lead(px) over w as px1, lead(py) over w as py1, lead(pz) over w as pz1 from $kf as k window w as (partition by traj_id order by t, pos))"""


@query("keyframe_segments", f"select traj_id, pos, t as t0, t1, px as px0, py as py0, pz as pz0, px1, py1, pz1 from {_SEG} s where t1 is not null")
def _(v):
    return trajectories.keyframe_segments(v.kf)


def _interp_sql(times):
    """Closed intervals, first match, clamped ends: written independently of the half-open form used on Spark."""
    return f"""select a.g, {", ".join(f"(round(case when a.alpha <= e.t_lo then e.first.{x} when a.alpha >= e.t_hi then e.last.{x} else m.{x} end, 6) + 0e0) as {x}" for x in ("px", "py", "pz"))}
      from {times} a
      left join (select traj_id, min(t) as t_lo, max(t) as t_hi, arg_min({{'px': px, 'py': py, 'pz': pz}}, t * 100 + pos) as first, arg_max({{'px': px, 'py': py, 'pz': pz}}, t * 100 + pos) as last from $kf as k group by 1) e on a.traj_id = e.traj_id
      left join (select g, px, py, pz from (select a.g, {", ".join(f"s.{x} + case when s.t1 > s.t then (a.alpha - s.t) / (s.t1 - s.t) else 0e0 end * (s.{x}1 - s.{x}) as {x}" for x in ("px", "py", "pz"))},
                   row_number() over (partition by a.g order by s.t, s.pos) as rn
                 from {times} a join {_SEG} s on a.traj_id = s.traj_id and a.alpha >= s.t and a.alpha <= s.t1) q where rn = 1) m on a.g = m.g"""


@query("trajectory_interp", _interp_sql("$kf_time"))
def _(v):
    out = trajectories.trajectory_interp(v.kf_time, v.kf)
    return out.select("g", *[rnd(a).alias(a) for a in ("px", "py", "pz")])


def _height(px, pz, src="$pts as p"):
    """Bilinear height by four corner subqueries joined on the grid."""
    loc = f"""(select *, least(3, cast(floor(fx) as int)) as ci, least(3, cast(floor(fz) as int)) as ck from (
        select p.*, greatest(0e0, least(1e0, (({px}) + 1e1) / 2e1)) * 4e0 as fx, greatest(0e0, least(1e0, (({pz}) + 1e1) / 2e1)) * 4e0 as fz from {src}) l0)"""
    joins = " ".join(f"left join $raster as r{a}{b} on r{a}{b}.grid_id = l.grid_id and r{a}{b}.i = l.ci + {a} and r{a}{b}.k = l.ck + {b}" for a in (0, 1) for b in (0, 1))
    du, dv = "(l.fx - l.ci)", "(l.fz - l.ck)"
    return f"""(select l.pt_id, (r00.hgt * (1e0 - {du}) + r10.hgt * {du}) * (1e0 - {dv}) + (r01.hgt * (1e0 - {du}) + r11.hgt * {du}) * {dv} as height from {loc} l {joins})"""


@query("raster_sample", f"select pt_id, {r('height')} as height from {_height('p.x', 'p.z')} h")
def _(v):
    return raster.raster_sample(v.pts, v.raster, GRID, ["grid_id"]).select("pt_id", rnd("height").alias("height"))


@query(
    "raster_normal",
    f"""select pt_id, {r("nx / n")} as nx, {r("ny / n")} as ny, {r("nz / n")} as nz from (select *, sqrt(nx * nx + ny * ny + nz * nz) as n from (
          select l.pt_id, -(rr.height - l.height) * 1e1 as nx, 1e2 as ny, -(u.height - d.height) * 1e1 as nz
          from {_height("p.x - 5e0", "p.z")} l join {_height("p.x + 5e0", "p.z")} rr on l.pt_id = rr.pt_id
          join {_height("p.x", "p.z - 5e0")} d on l.pt_id = d.pt_id join {_height("p.x", "p.z + 5e0")} u on l.pt_id = u.pt_id) q) t""",
)
def _(v):
    out = raster.raster_normal(v.pts, v.raster, GRID, ["pt_id"], ["grid_id"])
    return out.select("pt_id", *[rnd(c).alias(c) for c in ("nx", "ny", "nz")])


_CELL = "(select *, cast(floor(x / (4e-1 / 15e-1)) as bigint) as cx, cast(floor(z / (4e-1 / 15e-1)) as bigint) as cz from $placed as p)"


@query(
    "spacing_conflicts",
    f"""select a.obj_id, case when min(f.first_id) < a.obj_id then min(f.first_id) else min(b.obj_id) end as witness_id
        from {_CELL} a join (select zone, cx, cz, min(obj_id) as first_id from {_CELL} c group by 1, 2, 3) f on a.zone = f.zone and a.cx = f.cx and a.cz = f.cz
        left join {_CELL} b on a.zone = b.zone and b.obj_id < a.obj_id and sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) < 4e-1
        group by a.obj_id""",
)
def _(v):
    return placement.spacing_conflicts(v.placed, 0.4, ["zone"]).select("obj_id", "witness_id")


_SHARE = """(select *, sum(wi) over (partition by catalog_id order by asset_ord) as hi, sum(wi) over (partition by catalog_id) as total from (
    select *, cast(round(greatest(weight, 1e-3) * 1e9) as bigint) as wi from $assets as a) q)"""


@query(
    "weighted_choice",
    f"""select d.g, s.asset_ord, s.name from (select o_orderkey as g, cast(floor(o_custkey / 1e1) as bigint) as catalog_id, {md5_unit(5, "o_orderkey")} as u from @orders@) d
        join {_SHARE} s on d.catalog_id = s.catalog_id and d.u >= cast(s.hi - s.wi as double) / cast(s.total as double) and d.u < cast(s.hi as double) / cast(s.total as double)""",
)
def _(v):
    o = v.spark.read.parquet(f"{v.sf_dir}/orders.parquet")
    draws = o.select(F.col("o_orderkey").alias("g"), F.floor(F.col("o_custkey") / 1e1).cast("bigint").alias("catalog_id"), hash_uniform(5, "o_orderkey").alias("u"))
    return placement.weighted_choice(draws, v.assets, ["catalog_id"], ["asset_ord", "name"]).select("g", "asset_ord", "name")


_WALK = """with recursive n as (select * from $nodes as n0),
  w as (select node_id, lx as wx, ly as wy, lz as wz, ry as wry, sx as wsx, sy as wsy, sz as wsz, [ord] as path, case when grounded then node_id end as anchor_id, grounded, asset, name from n where parent_id is null
    union all
    select n.node_id, w.wx + n.lx * w.wsx * cos(radians(w.wry)) + n.lz * w.wsz * sin(radians(w.wry)), w.wy + n.ly * w.wsy,
           w.wz - n.lx * w.wsx * sin(radians(w.wry)) + n.lz * w.wsz * cos(radians(w.wry)), w.wry + n.ry, w.wsx * n.sx, w.wsy * n.sy, w.wsz * n.sz,
           list_append(w.path, n.ord), case when n.grounded then n.node_id else w.anchor_id end, n.grounded, n.asset, n.name
    from n join w on n.parent_id = w.node_id)"""
_W = ["wx", "wy", "wz", "wry", "wsx"]


@query("node_world", f"{_WALK} select node_id, cast(len(path) - 1 as int) as depth, anchor_id, {', '.join(f'{r(c)} as {c}' for c in _W)} from w")
def _(v):
    return tree.walk(v.nodes).select("node_id", "depth", "anchor_id", *[rnd(c).alias(c) for c in _W])


_ONE = "(select i, k, hgt from $raster as r where grid_id = 0)"


@query("node_grounded", f"""{_WALK}, loc as (select *, least(3, cast(floor(fx) as int)) as ci, least(3, cast(floor(fz) as int)) as ck from (
        select node_id, wy, greatest(0e0, least(1e0, (wx + 1e1) / 2e1)) * 4e0 as fx, greatest(0e0, least(1e0, (wz + 1e1) / 2e1)) * 4e0 as fz from w where grounded) q),
      dy as (select l.node_id, (a.hgt * (1e0 - (fx - ci)) + b.hgt * (fx - ci)) * (1e0 - (fz - ck)) + (c.hgt * (1e0 - (fx - ci)) + d.hgt * (fx - ci)) * (fz - ck) - wy as dy from loc l
        join {_ONE} a on a.i = ci and a.k = ck join {_ONE} b on b.i = ci + 1 and b.k = ck join {_ONE} c on c.i = ci and c.k = ck + 1 join {_ONE} d on d.i = ci + 1 and d.k = ck + 1)
      select w.node_id, {r("w.wy + coalesce(dy.dy, 0e0)")} as wy, w.grounded from w left join dy on w.anchor_id = dy.node_id""")
def _(v):
    walked = tree.walk(v.nodes.withColumn("grid_id", F.col("scene_id").cast("bigint")))
    out = tree.ground(walked, v.raster, GRID, grid_keys=["grid_id"])
    return out.select("node_id", rnd("wy").alias("wy"), "grounded")


@query("preorder_ids", f"{_WALK} select node_id, row_number() over (order by path) as instance_id from w where asset <> ''")
def _(v):
    return tree.preorder_ids(tree.walk(v.nodes)).select("node_id", "instance_id")


@query("asset_refs", "select node_id, asset from $nodes as n where asset <> '' and not exists (select 1 from $assets as a where a.name = n.asset)")
def _(v):
    return tree.unknown_asset_refs(v.nodes, v.assets).select("node_id", "asset")


@query(
    "asset_lookup",
    """select n.node_id, coalesce(a.roughness, 5e-1) as roughness, coalesce(a.metallic, 0e0) as metallic from $nodes as n
       left join (select * from (select *, row_number() over (partition by name order by asset_ord) as rn from $assets as a) q where rn = 1) a on a.name = coalesce(nullif(n.asset, ''), n.name)""",
)
def _(v):
    return tree.asset_lookup(v.nodes.withColumn("label", F.col("asset")), v.assets).select("node_id", "roughness", "metallic")


@query("fingerprint", """select run_id, substr(sha256(concat_ws(chr(10), dataset_root, timestamp_utc, argv, cast(seed as string), job_kind)), 1, 32) as dataset_id, sha256(argv) as digest from $runs as r""")
def _(v):
    return v.runs.select("run_id", text.dataset_id("dataset_root", "timestamp_utc", "argv", "seed", "job_kind").alias("dataset_id"), text.sha256_text("argv").alias("digest"))


@query("utc_stamp", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp from @events@")
def _(v):
    ev = v.spark.read.parquet(f"{v.sf_dir}/events.parquet")
    return ev.select("event_id", text.utc_stamp(F.col("ts").cast("timestamp_ntz")).alias("stamp"))
