from pyspark.sql import functions as F

from pixeltide.checks.core import query, r
from pixeltide.functions import masks
from pixeltide.functions.columns import rnd
from pixeltide.operators import cloud, evaluate, pixels
from pixeltide.functions.columns import vec

PX_COLS = "frame_id, px_col, px_row, instance_id, depth, l_orderkey, l_linenumber"
FINITE = "not isnan(depth) and abs(depth) < cast('infinity' as double)"

_MASKS = {
    "mask_cloud": ("cloud", f"{FINITE} and depth > 1e-3"),
    "mask_train": ("train", f"{FINITE} and depth > 1e-6 and depth < 1e6"),
    "mask_sky": ("sky", "depth >= 1e29"),
    "mask_foreground": ("foreground", f"instance_id > 0 and depth > 0 and {FINITE}"),
}
for _name, (_mask, _cond) in _MASKS.items():
    query(_name, f"select {PX_COLS} from $px as p where {_cond}")(
        lambda v, m=_mask: pixels.mask_filter(v.px, m).select(*PX_COLS.split(", "))
    )


@query("mask_u8", f"select {PX_COLS}, cast(least(instance_id * 100, 255) as int) as mask from $px as p")
def _(v):
    return v.px.withColumn("mask", masks.mask_u8(F.col("instance_id") * 100)).select(*PX_COLS.split(", "), "mask")


@query(
    "rgb_scale",
    f"""select l_orderkey, l_linenumber, l_partkey, {r("px_col / 255e0")} as unit,
               cast(trunc(greatest(0e0, least(255e0, (nx * 4e0 + 5e-1) * 255e0))) as int) as u8
        from $px as p""",
)
def _(v):
    return v.px.select(
        "l_orderkey", "l_linenumber", "l_partkey", rnd(masks.rgb_to_unit("px_col")).alias("unit"),
        masks.unit_to_rgb(F.col("nx") * 4.0 + 0.5).alias("u8"),
    )


@query(
    "read_gbuffer",
    """select frame_id, cast(floor(pos / 8e0) as int) as px_row, cast(pos % 8 as int) as px_col, cast(depth as double) as depth,
              cast(round_even(abs(depth) * 1e1, 0) as bigint) as instance_id, 0e0 as flow_x
       from (select vec_id as frame_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as depth from @embeddings@) t""",
)
def _(v):
    emb = v.spark.read.parquet(f"{v.sf_dir}/embeddings.parquet")
    frames = emb.select(
        F.col("vec_id").alias("frame_id"),
        F.lit(8).alias("width"),
        F.col("embedding").alias("depth"),
        F.transform("embedding", lambda x: F.abs(x.cast("double")) * 1e1).alias("instance_id"),
    )
    px = pixels.explode_frames(frames, channels=("depth", "instance_id", "flow_x"))
    return px.select(
        "frame_id", "px_row", "px_col", F.col("depth").cast("double").alias("depth"), "instance_id",
        F.col("flow_x").cast("double").alias("flow_x"),
    )


_CLASSES = """(select frame_id, instance_id, class_id, label from (
    select *, row_number() over (partition by frame_id, instance_id order by ord desc) as rn from $obj as o) q where rn = 1)"""


@query(
    "pixel_class",
    f"""select p.frame_id, p.instance_id, cast(coalesce(c.class_id, 0) as int) as class_id, cast(count(*) as bigint) as n
        from $px as p left join {_CLASSES} c on p.frame_id = c.frame_id and p.instance_id = c.instance_id
        group by 1, 2, 3""",
)
def _(v):
    out = pixels.pixel_class(v.px, v.obj)
    return out.groupBy("frame_id", "instance_id", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "frame_classes",
    """select frame_id, pos, cast(case when id between 1 and 3 then (frame_id + id) % 5 else 0 end as int) as class_id
       from (select vec_id as frame_id, generate_subscripts(embedding, 1) - 1 as pos, cast(round_even(abs(unnest(embedding)) * 1e1, 0) as bigint) as id from @embeddings@) t""",
)
def _(v):
    emb = v.spark.read.parquet(f"{v.sf_dir}/embeddings.parquet")
    frames = emb.select(F.col("vec_id").alias("frame_id"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * 1e1).alias("instance_id"))
    # Each id is entered twice; the last entry counts.
    entry = F.explode(F.sequence(F.lit(0), F.lit(5)))
    objects = emb.select(F.col("vec_id").alias("frame_id"), entry.alias("ord")).withColumn("instance_id", F.col("ord") % 3 + 1)
    objects = objects.withColumn("class_id", F.when(F.col("ord") < 3, 77).otherwise((F.col("frame_id") + F.col("instance_id")) % 5).cast("int"))
    out = pixels.frame_classes(frames, objects)
    return out.select("frame_id", F.posexplode("class_id").alias("pos", "class_id")).withColumn("pos", F.col("pos").cast("bigint"))


_BOXES = """(select frame_id, instance_id, min(px_col) as x0, min(px_row) as y0, max(px_col) as x1, max(px_row) as y1
             from $px as p where instance_id <> 0 group by 1, 2)"""
_REG = f"""(select b.*, cast(coalesce(c.class_id, 0) as int) as class_id, coalesce(c.label, 'unknown') as label
            from {_BOXES} b left join {_CLASSES} c on b.frame_id = c.frame_id and b.instance_id = c.instance_id)"""


@query("boxes_from_mask", f"select * from {_BOXES} b")
def _(v):
    return pixels.boxes_from_mask(v.px)


@query("box_registry", f"select * from {_REG} b")
def _(v):
    return pixels.attach_registry(pixels.boxes_from_mask(v.px), v.obj)


def labelled_boxes(v):
    """Flagship chain: pixels to boxes to registry to normalized boxes."""
    boxes = pixels.attach_registry(pixels.boxes_from_mask(v.px), v.obj)
    out = pixels.normalized_boxes(boxes, F.lit(320), F.lit(180))
    return out.select(
        "frame_id", "instance_id", "class_id", "label", "bx", "by", "bw", "bh", "area",
        *[rnd(c, 9).alias(c) for c in ("cx_n", "cy_n", "w_n", "h_n")],
    )


query(
    "norm_bbox",
    f"""select frame_id, instance_id, class_id, label, cast(x0 as double) as bx, cast(y0 as double) as by,
               cast(x1 - x0 + 1 as double) as bw, cast(y1 - y0 + 1 as double) as bh,
               cast((x1 - x0 + 1) * (y1 - y0 + 1) as int) as area,
               {r("(x0 + x1 + 1) / 2e0 / 320e0", 9)} as cx_n, {r("(y0 + y1 + 1) / 2e0 / 180e0", 9)} as cy_n,
               {r("(x1 - x0 + 1) / 320e0", 9)} as w_n, {r("(y1 - y0 + 1) / 180e0", 9)} as h_n
        from {_REG} b""",
)(labelled_boxes)


@query(
    "first_category",
    f"""select class_id, label as name from (
          select class_id, label, row_number() over (partition by class_id order by frame_id, instance_id) as rn from {_REG} b) q
        where rn = 1""",
)
def _(v):
    return pixels.first_category(pixels.attach_registry(pixels.boxes_from_mask(v.px), v.obj))


@query(
    "masked_l1",
    f"""select batch_id, {r("coalesce(sum(case when mask then abs(pred - target) end), 0e0) / greatest(sum(case when mask then 1e0 else 0e0 end), 1e-8)")} as loss,
               cast(count(case when mask then 1 end) as bigint) as valid
        from $pred as p group by 1""",
)
def _(v):
    out = evaluate.masked_l1(v.pred, ["batch_id"])
    return out.withColumn("loss", rnd("loss"))


_COS = """(select *, 1e0 - greatest(-1e0, least(1e0, ax / an * bx / bn + ay / an * by_ / bn + az / an * bz / bn)) as omc from (
    select *, greatest(sqrt(ax*ax + ay*ay + az*az), 1e-6) as an, greatest(sqrt(bx*bx + by_*by_ + bz*bz), 1e-6) as bn from $pred as p) q)"""


@query(
    "masked_cosine",
    f"""select batch_id, {r("coalesce(sum(case when mask then omc end), 0e0) / greatest(sum(case when mask then 1e0 else 0e0 end), 1e-8)")} as loss,
               cast(count(case when mask then 1 end) as bigint) as valid
        from {_COS} c group by 1""",
)
def _(v):
    p = v.pred.withColumnRenamed("by_", "by")
    out = evaluate.masked_cosine(p, ["batch_id"], vec("a"), vec("b"))
    return out.withColumn("loss", rnd("loss"))


@query(
    "epoch_loss",
    f"""select epoch, {r("coalesce(avg(case when valid > 0 then loss end), cast('nan' as double))")} as mean_loss from (
          select epoch, batch_id, sum(case when mask then abs(pred - target) end) / greatest(sum(case when mask then 1e0 else 0e0 end), 1e-8) as loss,
                 count(case when mask then 1 end) as valid from $pred as p group by 1, 2) s group by 1""",
)
def _(v):
    steps = evaluate.masked_l1(v.pred, ["epoch", "batch_id"])
    return evaluate.epoch_loss(steps).withColumn("mean_loss", rnd("mean_loss"))


_RUNNING = """(select grp, row_number() over w as n, avg(value) over w as mean, coalesce(var_samp(value) over w, 0e0) as var
    from $samples as s window w as (partition by grp order by seq_id rows between unbounded preceding and current row))"""


@query(
    "sequential_ci_stop",
    f"""select a.grp, cast(coalesce(s.n, a.n) as bigint) as n, {r("coalesce(s.mean, a.mean)")} as mean, s.n is not null as stopped_early
        from (select grp, n, mean from (select *, row_number() over (partition by grp order by n desc) as rn from {_RUNNING} q where n <= 60) t where rn = 1) a
        left join (select grp, n, mean from (select *, row_number() over (partition by grp order by n) as rn from {_RUNNING} q
                   where n <= 60 and n >= 8 and 196e-2 * sqrt(var) / sqrt(n) < 2e-1 * greatest(1e-3, mean)) t where rn = 1) s on a.grp = s.grp""",
)
def _(v):
    out = evaluate.sequential_ci_stop(v.samples, rel=0.2, budget=60, width=1024)
    return out.withColumn("mean", rnd("mean"))


@query(
    "run_timing",
    f"""select cast(floor(event_id / 1e3) as bigint) as run_id, cast(count(*) as bigint) as frames, {r("avg(value)")} as avg_ms,
               cast(floor(sum(value * 1e2) / sum(1e1 + user_id % 7) + 5e-1) as bigint) as avg_spp
        from @events@ group by 1""",
)
def _(v):
    ev = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").select(
        F.floor(F.col("event_id") / 1e3).cast("bigint").alias("run_id"),
        F.col("value").alias("render_ms"),
        (F.col("value") * 1e2).alias("samples"),
        (F.col("user_id") % 7 + 1e1).alias("pixels"),
    )
    return evaluate.run_timing(ev, ["run_id"]).withColumn("avg_ms", rnd("avg_ms"))
