"""Views that shape the given tables into frames, pixels, cameras, annotations and so on.

The text runs on Spark and on DuckDB. ``@name@`` is a given table, ``$name`` another view. All views read whole
tables and grow with them. Doubles are written with exponents so that no engine infers decimals.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

# Pixels in long form. A frame is 64 orders. Instance 0 is background, line number 7 is sky.
VIEWS["px"] = """
select cast(floor(l_orderkey / 64e0) as bigint) as frame_id,
       cast(l_partkey % 320 as int) as px_col, cast(l_suppkey % 180 as int) as px_row,
       cast(l_linenumber - 1 as int) as instance_id,
       case when l_linenumber = 7 then 1e30 else l_extendedprice / 1e3 end as depth,
       l_discount - 5e-2 as nx, l_tax - 4e-2 as ny, 1e0 as nz,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
from @lineitem@"""

# Object entries per frame: 64 entries for instances 1..4 (so ids repeat); 5 and 6 stay unregistered.
VIEWS["obj"] = """
select cast(floor(o_orderkey / 64e0) as bigint) as frame_id, o_orderkey % 64 as ord,
       cast(1 + o_orderkey % 4 as int) as instance_id, cast(o_custkey % 4 as int) as class_id,
       concat('obj_', cast(o_custkey % 4 as string)) as label
from @orders@"""

# One camera per order, 100 frames per run.
VIEWS["pose"] = """
select o_orderkey as frame_id, cast(floor(o_orderkey / 1e2) as bigint) as run_id, o_orderkey % 100 as g,
       cast(320 as int) as w, cast(180 as int) as h, 3e1 + (o_custkey % 11) as vfov,
       14e0 + (o_custkey % 7) as ex, 7e0 + (o_custkey % 4) as ey, 2e1 + (o_custkey % 9) as ez,
       0e0 as ax, 12e-1 as ay, 0e0 as az
from @orders@"""

# One camera per pixel frame, 50 frames per run.
VIEWS["fcam"] = """
select frame_id, cast(floor(frame_id / 5e1) as bigint) as run_id, frame_id % 50 as g,
       cast(320 as int) as w, cast(180 as int) as h, 3e1 + (k % 11) as vfov,
       14e0 + (k % 7) as ex, 7e0 + (k % 4) as ey, 2e1 + (k % 9) as ez, 0e0 as ax, 12e-1 as ay, 0e0 as az
from (select cast(floor(o_orderkey / 64e0) as bigint) as frame_id, max(o_custkey) + min(o_custkey) as k
      from @orders@ group by cast(floor(o_orderkey / 64e0) as bigint)) f"""

# One camera per embedding, 50 frames per run; a frame is 8 x 8 pixels in the corner of the image.
VIEWS["ecam"] = """
select vec_id as frame_id, cast(floor(vec_id / 5e1) as bigint) as run_id, vec_id % 50 as g,
       cast(320 as int) as w, cast(180 as int) as h, 3e1 + (vec_id % 11) as vfov,
       14e0 + (vec_id % 7) as ex, 7e0 + (vec_id % 4) as ey, 2e1 + (vec_id % 9) as ez, 0e0 as ax, 12e-1 as ay, 0e0 as az
from @embeddings@"""

# Images of an annotation document; every 50th shares a name, every 500th has height 0.
VIEWS["img"] = """
select o_orderkey as pos, o_orderkey as image_id, o_orderkey % 4 as shard_id,
       concat('frame_', lpad(cast(n as string), cast(greatest(4, length(cast(n as string))) as int), '0'), '.png') as file_name,
       cast(320 as int) as width, cast(case when o_orderkey % 500 = 3 then 0 else 180 end as int) as height
from (select o_orderkey, case when o_orderkey % 50 = 49 then o_orderkey - 1 else o_orderkey end as n from @orders@) t"""

# Annotations; the shift makes orphans, some boxes are out of bounds, tiny, huge or NaN.
VIEWS["ann"] = """
select l_orderkey + 100 as image_id, l_linenumber as ann_seq, cast(l_suppkey % 7 as int) as category_id,
       cast(l_partkey % 330 as double) - 5e0 as x, cast(l_suppkey as double) - 2e0 as y,
       case when l_partkey % 400 = 1 then cast('NaN' as double) when l_partkey % 400 = 2 then 4e2 else l_quantity - 1e0 end as w,
       case when l_partkey % 400 = 2 then 18e1 else l_quantity * 2e0 end as h,
       l_orderkey % 4 as shard_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate
from @lineitem@"""

# Files on disk: shifted names (some images missing, some extra), and one extra val copy per customer.
VIEWS["files"] = """
select concat('frame_', lpad(cast(n as string), cast(greatest(4, length(cast(n as string))) as int), '0'), '.png') as file_name,
       split, size_bytes, has_txt, has_meta
from (select case when o_orderkey % 61 = 0 then o_orderkey + 1000000 else o_orderkey + 20 end as n,
             case when o_orderkey % 10 < 8 then 'train' else 'val' end as split,
             cast(o_custkey % 40 as bigint) as size_bytes,
             o_orderkey % 97 <> 0 as has_txt, o_orderkey % 89 <> 0 as has_meta from @orders@
      union all
      select c_custkey * 7 + 21, 'val2', cast(1 as bigint), true, true from @customer@) t"""

# Label lines as text, some malformed.
VIEWS["yolo"] = """
select l_orderkey as frame_id, l_linenumber, l_partkey, l_suppkey, l_shipdate,
       case when l_partkey % 100 = 1 then 'class and box missing'
            when l_partkey % 100 = 2 then 'x 0.5 0.5 0.1 0.1'
            when l_partkey % 100 = 3 then '1 0.5 abc 0.1 0.1'
            when l_partkey % 100 = 4 then '1 nan 0.5 0.1 0.1'
            when l_partkey % 100 = 5 then '1 0.5 0.5 -0.1 0.1'
            when l_partkey % 100 = 6 then '1 0.5 0.5 0.99 0.98'
            when l_partkey % 100 = 7 then '2 0.5 0.5 0.001 0.001'
            when l_partkey % 100 = 8 then '  3 0.95 0.5 0.2 0.1  '
            else concat(cast(l_suppkey % 7 as string), ' 0.', cast(10 + l_partkey % 90 as string), ' 0.',
                        cast(10 + l_suppkey % 90 as string), ' 0.', cast(10 + l_linenumber as string), ' 0.05') end as line
from @lineitem@"""

# Five keyframes per trajectory with a repeated time.
VIEWS["kf"] = """
select cast(floor(c_custkey / 5e0) as bigint) as traj_id, cast(c_custkey % 5 as int) as pos,
       case when c_custkey % 5 = 3 then 5e-1 else (c_custkey % 5) / 4e0 end as t,
       c_acctbal / 1e2 as px, cast(c_custkey % 3 as double) as py, 2e0 * c_nationkey as pz
from @customer@"""

# Times on those trajectories.
VIEWS["kf_time"] = """
select o_orderkey as g, cast(floor(o_custkey / 5e0) as bigint) as traj_id, (o_orderkey % 41) / 4e1 as alpha from @orders@"""

# Scene forest: region > nation > customer > order. Orders carry assets, some undefined.
VIEWS["nodes"] = """
select 0 as scene_id, cast(r_regionkey as bigint) as node_id, cast(null as bigint) as parent_id, cast(r_regionkey as int) as ord,
       cast(r_name as string) as name, '' as asset, 1e1 * r_regionkey as lx, 0e0 as ly, 0e0 as lz,
       0e0 as rx, 3e1 * r_regionkey as ry, 0e0 as rz, 1e0 as sx, 1e0 as sy, 1e0 as sz, false as grounded from @region@
union all
select 0, cast(100 + n_nationkey as bigint), cast(n_regionkey as bigint), cast(n_nationkey as int), n_name, '',
       1e0 * n_nationkey, 1e0, 5e-1, 0e0, 1e1, 0e0, 5e-1, 5e-1, 5e-1, n_nationkey % 3 = 0 from @nation@
union all
select 0, 1000 + c_custkey, cast(100 + c_nationkey as bigint), cast(c_custkey as int), c_name, '',
       1e-1 * (c_custkey % 50), 5e-1, 2e-1, 0e0, 5e0, 0e0, 2e0, 1e0, 2e0, c_custkey % 5 = 0 from @customer@
union all
select 0, 1000000000 + o_orderkey, 1000 + o_custkey, cast(o_orderkey as int), 'leaf',
       concat('asset_', cast(o_orderkey % 300 as string)),
       (o_orderkey % 17) / 1e1, 1e-1, 3e-1, 0e0, 1e0, 0e0, 1e0, 1e0, 1e0, o_orderkey % 7 = 0 from @orders@"""

# Asset catalogues of ten entries with weights; every seventh name repeats its predecessor's.
VIEWS["assets"] = """
select cast(floor(p_partkey / 1e1) as bigint) as catalog_id, p_partkey as asset_ord,
       concat('asset_', cast(case when p_partkey % 7 = 6 then p_partkey - 1 else p_partkey end as string)) as name,
       p_size / 5e1 as weight, (p_partkey % 10) / 1e1 as roughness, (p_partkey % 4) / 4e0 as metallic
from @part@"""

# Sequential samples per group.
VIEWS["samples"] = "select user_id as grp, event_id as seq_id, ts, value from @events@"

# 5 x 5 height grids over [-10, 10] squared.
VIEWS["raster"] = """
select cast(floor(p_partkey / 25e0) as bigint) as grid_id, cast(p_partkey % 5 as int) as i,
       cast(floor((p_partkey % 25) / 5e0) as int) as k, p_retailprice / 1e3 as hgt from @part@"""

# Query points, some outside the grid.
VIEWS["pts"] = """
select o_orderkey as pt_id, cast(floor(o_custkey / 25e0) as bigint) as grid_id,
       (o_orderkey % 251) / 1e1 - 125e-1 as x, (o_custkey % 241) / 1e1 - 12e0 as z from @orders@"""

# Placed objects on a plane.
VIEWS["placed"] = """
select c_custkey as obj_id, cast(c_nationkey % 5 as int) as zone, c_acctbal / 1e3 as x, (c_custkey % 97) / 1e1 as z from @customer@"""

# Prediction and target pairs per pixel and step.
VIEWS["pred"] = """
select l_orderkey, cast(l_orderkey % 3 as int) as epoch, cast(floor(l_orderkey / 256e0) as bigint) as batch_id,
       l_extendedprice / 1e4 as pred, l_quantity / 5e0 as target, l_linenumber <> 7 and floor(l_orderkey / 256e0) % 9 <> 4 as mask,
       l_discount - 4e-2 as ax, l_tax - 3e-2 as ay, l_quantity / 1e2 as az,
       l_tax - 5e-2 as bx, l_discount - 2e-2 as by_, l_quantity / 2e2 - 1e-1 as bz
from @lineitem@"""

# Run records.
VIEWS["runs"] = """
select c_custkey as run_id, concat('/data/', c_name) as dataset_root, '2026-01-01T00:00:00Z' as timestamp_utc,
       concat('forge --frames ', cast(c_custkey as string)) as argv, cast(c_nationkey as bigint) as seed, 'forge' as job_kind
from @customer@"""

# Frames of datasets: id within root, split by position.
VIEWS["fr"] = """
select concat('root_', cast(o_custkey % 7 as string)) as root, case when o_orderkey % 10 < 8 then 'train' else 'val' end as split,
       o_orderkey as frame_id, cast(case when o_orderkey % 1000 = 0 then 640 else 320 end as int) as w, cast(180 as int) as h
from @orders@"""

# Config documents with good, unknown and deprecated keys, reversed and malformed ranges, bad environment entries.
VIEWS["cfg"] = """
select event_id as config_id,
       concat('{"assets":[{"path":"m/', event_type, '.obj","scale":', cast(event_id % 5 as string),
              case when event_id % 7 = 0 then ',"bogus":1' else '' end,
              case when event_id % 11 = 0 then ',"obj":"x.obj"' else '' end,
              case when event_id % 3 = 0 then ',"name":"cube"' else '' end,
              ',"roughness":',
              case when event_id % 2 = 0 then '0.5' when event_id % 13 = 0 then '"rough"' else '{"min":0.9,"max":0.1}' end, '}]',
              case when event_id % 17 = 0 then ',"mystery":true' else '' end,
              case when event_id % 19 = 0 then ',"hdr":42' when event_id % 19 = 1 then ',"hdr":"sky.hdr"' else '' end,
              case when event_id % 4 = 1 then concat(',"camera":{"fov_deg":{"min":', cast(50 - event_id % 30 as string), ',"max":40}}') else '' end,
              ',"dataset":{"root":"out","train_split":', cast((event_id % 12) / 1e1 as string), '}}') as doc
from @events@"""


# Scenario configurations: two or three root nodes, one with children, scalar and vector scales, some with keyframes.
VIEWS["scfg"] = """
select c_custkey as config_id,
       concat('{"assets":[{"path":"m.obj","name":"crate"}],"scenarios":[{"name":"s0","root_nodes":[{"name":"a","asset":"crate","position":[', cast(c_custkey % 9 as string),
              ',0,1],"scale":', case when c_custkey % 2 = 0 then '2' else '[1,2,3]' end, ',"children":[{"name":"b","rotation":[0,', cast(c_custkey % 7 as string),
              ',0]},{"name":"c","asset":"crate","grounding_constraint":true}]},{"name":"d","asset":"crate"}]',
              case when c_custkey % 3 = 0 then ',"camera":{"trajectory":[{"t":1,"pos":[1,2,3]},{"t":0,"pos":[4,5,6]}]}' else '' end, '},{"name":"s1","root_nodes":[{"name":"e","position":',
              case when c_custkey % 5 = 0 then '"left"' else '[0,0,0]' end, '}]}]}') as doc
from @customer@"""


def expand(sql: str, engine: str, sf_dir: str = "") -> str:
    """Replace $views and @tables@ in a query text for one engine."""

    def view(m: re.Match) -> str:
        return f"({expand(VIEWS[m.group(1)], engine, sf_dir)})"

    sql = re.sub(r"\$([a-z_]+)", view, sql)
    if engine == "spark":
        return re.sub(r"@([a-z]+)@", lambda m: f"parquet.`{sf_dir.rstrip('/')}/{m.group(1)}.parquet`", sql)
    return re.sub(r"@([a-z]+)@", r"\1", sql)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(expand(f"select * from ${name} as {name}_", "spark", sf_dir))
