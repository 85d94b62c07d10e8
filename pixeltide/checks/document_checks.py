from pyspark.sql import functions as F

from pixeltide.checks import fixtures
from pixeltide.checks.camera_checks import POSE_SQL, _c2w
from pixeltide.checks.core import query, r
from pixeltide.functions import jsonfn as J
from pixeltide.functions.columns import rnd
from pixeltide.operators import annotations as A
from pixeltide.operators import motion, pixels
from pixeltide.plans import generation as GEN
from pixeltide.plans import validation as V
from pixeltide.sinks import labels as L
from pixeltide.sources import files as S

# Metadata documents with one defect class each, by order key.
fixtures.VIEWS["meta"] = """
select o_orderkey as doc_id,
       case when o_orderkey % 29 = 0 then '{"frame_id":'
            when o_orderkey % 31 = 0 then '[1, 2]'
            else concat('{"frame_id":', case when o_orderkey % 7 = 1 then '1.5' else cast(o_orderkey as string) end,
              case when o_orderkey % 5 = 1 then '' else ',"split":"train"' end, ',"image_width":320,"image_height":', case when o_orderkey % 11 = 2 then '"tall"' else '180' end,
              ',"camera_extrinsics":[', case when o_orderkey % 13 = 3 then '1,0,0' when o_orderkey % 13 = 4 then '1,0,0,0,0,"x",0,0,0,0,1,0,0,0,0,1' else '1,0,0,0,0,1,0,0,0,0,1,0,0,0,0,1' end, ']',
              ',"camera_intrinsics":{"fx":1.5', case when o_orderkey % 3 = 1 then '' else ',"fy":2.5' end, ',"cx":0,"cy":0},"convention":"c","render":', case when o_orderkey % 17 = 5 then '7' else '{}' end,
              ',"camera":{},"sun":{},"objects":[{"instance_id":1,"local_to_world_row_major":[1,0,0,0,0,1,0,0,0,0,1,0,0,0,0,1],"position":[0,0,', case when o_orderkey % 19 = 6 then '0,0' else '0' end, '],"rotation_deg":[0,0,0],"scale":[1,1,1]}',
              case when o_orderkey % 23 = 7 then ',5' else '' end, ']}') end as text
from @orders@"""

_META = [
    ("meta_json", "not json_valid(text)"),
    ("meta_schema", "json_valid(text) and json_type(text) <> 'OBJECT'"),
    ("meta_schema", "ok and json_type(text, '\x00.frame_id') = 'DOUBLE'"),
    ("meta_schema", "ok and json_extract(text, '\x00.split') is null"),
    ("meta_schema", "ok and json_type(text, '\x00.image_height') = 'VARCHAR'"),
    ("meta_schema", "ok and json_array_length(text, '\x00.camera_extrinsics') <> 16"),
    ("meta_schema", "ok and json_array_length(text, '\x00.camera_extrinsics') = 16 and json_type(text, '\x00.camera_extrinsics[5]') = 'VARCHAR'"),
    ("meta_schema", "ok and json_extract(text, '\x00.camera_intrinsics.fy') is null"),
    ("meta_schema", "ok and json_type(text, '\x00.render') <> 'OBJECT'"),
    ("meta_schema", "ok and json_array_length(text, '\x00.objects[0].position') <> 3"),
    ("meta_schema", "ok and json_array_length(text, '\x00.objects') = 2"),
]


def _dollar(name):
    from pixeltide.checks.core import ORACLES

    ORACLES[name] = ORACLES[name].replace("\x00", "$")


_DOCS = "(select doc_id, text, coalesce(case when json_valid(text) then json_type(text) = 'OBJECT' end, false) as ok from $meta as m)"
query(
    "rules_meta",
    "select doc_id, code, cast(count(*) as bigint) as n from ("
    + " union all ".join(f"select doc_id, '{c}' as code from {_DOCS} d where case when ok or json_valid(text) then {w} else {w if c == 'meta_json' else 'false'} end" for c, w in _META)
    + ") q group by 1, 2",
)(lambda v: V.meta_rules(v.meta, keep=["doc_id"], subject=F.col("doc_id")).groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n")))
_dollar("rules_meta")


def _meta_frames(v):
    """Frame rows in the shape of the metadata writer."""
    p = _c2w(motion.with_pose(v.pose))
    zero = [F.lit(x) for x in (0.0, 0.0, 0.0)]
    obj = F.struct(
        F.lit(1).cast("bigint").alias("instance_id"), F.lit(2).cast("bigint").alias("class_id"), F.lit("cube").alias("label"),
        F.array(*zero).alias("position"), F.array(F.lit(0.0), F.col("g") * 1.0, F.lit(0.0)).alias("rotation_deg"),
        F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("scale"), F.lit(0.5).alias("roughness"), F.lit(0.0).alias("metallic"),
        F.lit(True).alias("grounding_constraint"), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("terrain_normal"),
    )
    return p.withColumns(
        {
            "split": F.lit("train"), "upx": F.lit(0.0), "upy": F.lit(1.0), "upz": F.lit(0.0), "focus_dist": F.lit(1.0), "sun_az": F.lit(300.0),
            "sun_el": F.lit(12.0), "spp_target": F.lit(24), "spp_avg": F.lit(24), "max_depth": F.lit(10), "seed": F.col("frame_id"), "objects": F.array(obj),
        }
    )


@query(
    "read_frame_meta",
    f"""select frame_id, 'train' as split, w, h, {r("fx")} as fx, {r("cy")} as cy, vfov, {r("ux")} as m00, {r("ez")} as m11, {r("cos(radians(g * 1e0))")} as o00, false as mismatch, true as valid
        from {POSE_SQL} b""",
)
def _(v):
    docs = L.frame_meta_json(_meta_frames(v)).select(F.col("meta_json").alias("text"))
    m = S.parse_frame_meta(docs)
    return m.select(
        "frame_id", "split", "w", "h", rnd("fx").alias("fx"), rnd("cy").alias("cy"), "vfov", rnd(F.col("c2w")[0]).alias("m00"), rnd(F.col("c2w")[11]).alias("m11"),
        rnd(F.col("objects")[0]["local_to_world_row_major"][0]).alias("o00"), "mismatch", "valid",
    )


@query("write_frame_meta")
def _(v):
    return L.frame_meta_json(_meta_frames(v)).select("frame_id", "meta_json")


def _documents(v):
    im = A.renumber(v.img, ["shard_id", "pos"]).select(F.col("new_id").alias("image_id"), "file_name", "width", "height")
    boxes = pixels.normalized_boxes(pixels.attach_registry(pixels.boxes_from_mask(v.px), v.obj), F.lit(320), F.lit(180))
    anns = A.renumber(boxes, ["frame_id", "instance_id"], "ann_id").withColumns({"image_id": F.col("frame_id"), "category_id": F.col("class_id")})
    return im, anns, pixels.first_category(boxes).withColumnRenamed("class_id", "category_id")


@query("write_coco")
def _(v):
    return L.coco_lines(*_documents(v))


_B = """(select frame_id, instance_id, min(px_col) as x0, min(px_row) as y0, max(px_col) as x1, max(px_row) as y1 from $px as p where instance_id <> 0 group by 1, 2)"""


@query(
    "read_coco",
    f"""select row_number() over (order by frame_id, instance_id) as ann_id, frame_id as image_id, cast(instance_id as bigint) as instance_id,
               cast(x0 as double) as bx, cast(y1 - y0 + 1 as double) as bh, cast((x1 - x0 + 1) * (y1 - y0 + 1) as double) as area from {_B} b""",
)
def _(v):
    docs = L.coco_lines(*_documents(v)).filter("section = 3").select(F.lit(0).alias("doc"), F.regexp_replace("value", "^,", "").alias("t"))
    # Each annotation line as a one-element document, through the element reader.
    parsed = S.parse_coco(docs.select(F.concat(F.lit('{"images":[],"annotations":['), "t", F.lit("]}")).alias("text")))
    _, anns, _ = S.coco_tables(parsed)
    return anns.select("ann_id", "image_id", "instance_id", F.get("bbox", F.lit(0)).alias("bx"), F.get("bbox", F.lit(3)).alias("bh"), "area")


@query(
    "coco_discover",
    """select root, case when n = 1 then p end as coco_path, case when n = 0 then 'coco_not_found' when n > 1 then 'coco_ambiguous' end as code from (
         select concat('root_', cast(c_custkey as string)) as root, (c_custkey % 3 > 0)::int + (c_custkey % 3 > 1)::int as n,
                case when c_custkey % 3 > 0 then concat('root_', cast(c_custkey as string), '/annotations_coco.json') end as p from @customer@) q""",
)
def _(v):
    c = v.spark.read.parquet(f"{v.sf_dir}/customer.parquet")
    k = F.col("c_custkey") % 3
    names = F.filter(
        F.array(F.when(k > 0, F.lit("annotations_coco.json")), F.when(k > 1, F.lit("scenario_coco.json")), F.lit("notes.md")), lambda x: x.isNotNull()
    )
    root = F.concat(F.lit("root_"), F.col("c_custkey").cast("string"))
    listing = c.select(root.alias("root"), F.lit("").alias("split"), F.explode(names).alias("name"))
    return S.coco_discover(listing.withColumn("path", F.concat_ws("/", "root", "name")))


@query(
    "image_dims",
    """select o_orderkey, case when o_orderkey % 5 <> 0 then o_custkey + 1 end as hdr_w, case when o_orderkey % 5 <> 0 then o_orderkey + 1 end as hdr_h from @orders@""",
)
def _(v):
    o = v.spark.read.parquet(f"{v.sf_dir}/orders.parquet")

    def be32(c):
        return F.unhex(F.lpad(F.hex(c), 8, "0"))

    magic = F.when(F.col("o_orderkey") % 5 != 0, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("0000000000000000")))
    head = F.concat(magic, F.unhex(F.lit("0000000D49484452")), be32(F.col("o_custkey") + 1), be32(F.col("o_orderkey") + 1))
    dims = S.png_dims("content")
    return o.withColumn("content", head).select("o_orderkey", dims["hdr_w"].alias("hdr_w"), dims["hdr_h"].alias("hdr_h"))


@query(
    "read_manifests",
    """select run_id, dataset_root, cast(10 + run_id % 90 as bigint) as frames_total, case when run_id % 4 = 0 then 'manifest_root_mismatch' end as code from $runs as r""",
)
def _(v):
    docs = v.runs.withColumns({"total": (10 + F.col("run_id") % 90)}).select(
        "run_id", "dataset_root", F.concat(F.lit("/runs/"), F.col("run_id").cast("string")).alias("path"),
        F.to_json(F.struct(F.struct("job_kind", F.when(F.col("run_id") % 4 == 0, F.lit("/elsewhere")).otherwise(F.lit("/data/x/")).alias("dataset_root"), F.col("total").alias("frames_total")).alias("dataset_layout"))).alias("text"),
    )
    issues = V.manifest_rules(docs.select("path", "text"), "/data/x").select("path", "code")
    m = docs.withColumn("m", F.from_json("text", S.MANIFEST_SCHEMA))
    return m.join(issues, "path", "left").select("run_id", "dataset_root", F.col("m.dataset_layout.frames_total").alias("frames_total"), "code")


@query(
    "frame_samples",
    """select split, frame_id, w, case when frame_id % 9 = 0 then 'image' when frame_id % 8 = 0 then 'pixels' end as missing from $fr as f""",
)
def _(v):
    f = v.fr
    meta = f.select("split", "frame_id", "w", "h")

    def partly(k):
        """The same rows, every k-th under an id no frame has."""
        return f.select("split", F.when(F.col("frame_id") % k == 0, -1 - F.col("frame_id")).otherwise(F.col("frame_id")).alias("frame_id"))

    px, im = partly(8), partly(9)
    out = S.frame_samples(f.select("split", "frame_id"), meta, px, im, strict=False)
    return out.select("split", "frame_id", "w", "missing")


@query(
    "finite_array",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 400 = 1 then false else true end as ok from $ann as a""",
)
def _(v):
    from pixeltide.functions import jsonfn as J

    return v.ann.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", J.finite_array(F.array("x", "y", "w", "h"), 4).alias("ok"))


query(
    "integral_number",
    "select doc_id, coalesce(json_type(text, '\x00.frame_id') = 'UBIGINT', false) as integral from (select doc_id, case when json_valid(text) then text else '{}' end as text from $meta as m) d",
)(lambda v: v.meta.select("doc_id", J.integral_number(J.field(J.parse("text"), "frame_id")).alias("integral")))
_dollar("integral_number")
