from pyspark.sql import functions as F

from pixeltide.checks.core import query, r
from pixeltide.functions.columns import rnd
from pixeltide.operators import annotations as A
from pixeltide.plans import validation as V

_ANN = ["image_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ANN_SQL = ", ".join(f"a.{c}" for c in _ANN)


def images(v):
    return v.img.withColumn("is_object", F.lit(True))


def annotations(v):
    return v.ann.withColumns(
        {
            "is_object": F.lit(True), "bbox_is_list": F.lit(True), "bbox": F.array("x", "y", "w", "h"),
            "ann_id": F.col("ann_seq"), "pos": F.col("l_orderkey"),
        }
    )


def listing(v):
    return v.files.withColumn("path", F.concat_ws("/", "split", "file_name"))


@query("orphan_annotations", f"select {_ANN_SQL} from $ann as a where not exists (select 1 from $img as i where i.image_id = a.image_id)")
def _(v):
    return A.orphan_annotations(v.ann, v.img).select(*_ANN)


_KEPT = """(select file_name, image_id, width, height from (select *, row_number() over (partition by file_name order by pos desc) as rn from $img as i) k where rn = 1)"""
_HITS = """(select file_name, count(distinct split) as hits, min(size_bytes) as any_size from $files as f group by 1)"""
_RES = f"""(select k.*, cast(coalesce(h.hits, 0) as bigint) as hits, f.size_bytes from {_KEPT} k left join {_HITS} h on k.file_name = h.file_name
          left join (select file_name, size_bytes from (select *, row_number() over (partition by file_name order by split) as rn from $files as f) q where rn = 1) f
          on k.file_name = f.file_name)"""


@query("coco_image_missing", f"select file_name, image_id, hits from {_RES} r where hits <> 1")
def _(v):
    return A.images_missing(v.img, listing(v)).select("file_name", "image_id", "hits")


@query("path_ambiguous", f"select file_name, image_id, hits from {_RES} r where hits > 1")
def _(v):
    return A.ambiguous_paths(v.img, listing(v)).select("file_name", "image_id", "hits")


@query("png_not_in_coco", "select split, file_name from $files as f where not exists (select 1 from $img as i where i.file_name = f.file_name)")
def _(v):
    return A.uncatalogued(v.files, v.img).select("split", "file_name")


@query("dup_file_name", """select image_id, file_name, prev_id from (
         select image_id, file_name, lag(image_id) over (partition by file_name order by pos) as prev_id from $img as i) q
       where prev_id is not null and prev_id <> image_id""")
def _(v):
    return A.duplicate_names(v.img, width=16).select("image_id", "file_name", "prev_id")


@query("keep_last_image", f"select * from {_KEPT} k")
def _(v):
    return A.keep_last_image(v.img).select("file_name", "image_id", "width", "height")


_DIMS = f"""(select a.*, k.file_name, k.width as iw, k.height as ih from $ann as a join (select * from {_RES} r where hits = 1) k on a.image_id = k.image_id)"""


def dims(v):
    return A.annotation_dims(annotations(v), A.resolve_images(images(v), listing(v)))


@query("annotation_dims", f"select {_ANN_SQL}, file_name, iw, ih from {_DIMS} a")
def _(v):
    return dims(v).select(*_ANN, "file_name", "iw", "ih")


_CLASSNAMES = "(select c.id as category_id, concat('class_', cast(c.id as string)) as name from (select distinct cast(l_suppkey % 5 as bigint) as id from @lineitem@) c)"


@query(
    "class_histogram",
    f"""select h.category_id, cast(count(*) as bigint) as n, max(c.name) as name from (
          select cast(category_id as bigint) as category_id from {_DIMS} a
          union all
          select cast(split_part(trim(line), ' ', 1) as bigint) from $yolo as y where not (line like 'class%' or line like 'x %')) h
        left join {_CLASSNAMES} c on h.category_id = c.category_id group by 1""",
)
def _(v):
    lines = V.parse_label_tokens(V.split_label_text(v.yolo.withColumnRenamed("line", "text")))
    labels = V.countable_labels(lines).select(F.col("class_id").alias("category_id"))
    li = v.spark.read.parquet(f"{v.sf_dir}/lineitem.parquet")
    cats = li.select((F.col("l_suppkey") % 5).alias("category_id")).distinct()
    cats = cats.withColumns({"name": F.concat(F.lit("class_"), F.col("category_id").cast("string")), "pos": F.lit(0)})
    return A.class_histogram(cats, dims(v), labels)


@query(
    "coco_renumber",
    """select shard_id, image_id, row_number() over (order by shard_id, pos) as new_id from $img as i""",
)
def _(v):
    return A.renumber(v.img, ["shard_id", "pos"]).select("shard_id", "image_id", "new_id")


_ORDER = ["shard_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "w", "h", "l_shipdate"]


@query("coco_renumber_annotations", f"select {_ANN_SQL}, row_number() over (order by {', '.join(_ORDER)}) as new_id from $ann as a")
def _(v):
    return A.renumber(v.ann, _ORDER).select(*_ANN, "new_id")


@query(
    "shard_id_remap",
    f"""select {_ANN_SQL}, n.new_id as new_image_id from $ann as a left join
        (select shard_id, image_id, row_number() over (order by shard_id, pos) as new_id from $img as i) n
        on a.shard_id = n.shard_id and a.image_id = n.image_id""",
)
def _(v):
    im = A.renumber(v.img, ["shard_id", "pos"])
    return A.remap_image_ids(v.ann, im, shard="shard_id", strict=False).select(*_ANN, "new_image_id")


@query(
    "merge_coco",
    f"""select {", ".join("a." + c for c in _ANN)}, a.category_id, a.new_id, n.new_id as new_image_id, c.name, case when n.new_id is null then 'coco_orphan_ann' end as issue from
        (select {_ANN_SQL}, shard_id as s_, category_id, row_number() over (order by {', '.join(_ORDER)}) as new_id from $ann as a) a
        left join (select shard_id, image_id, row_number() over (order by shard_id, pos) as new_id from $img as i) n on a.s_ = n.shard_id and a.image_id = n.image_id
        left join (select category_id, name from (select category_id, concat('s', cast(shard_id as string), '_', cast(category_id as string)) as name,
                     row_number() over (partition by category_id order by shard_id) as rn from (select distinct shard_id, category_id from $ann as a) d) q where rn = 1) c
          on a.category_id = c.category_id""",
)
def _(v):
    """The merge with every row; annotations of unknown images carry their issue."""
    cats = v.ann.select(F.col("shard_id").alias("shard_order"), "category_id").distinct().withColumn("pos", F.col("category_id"))
    cats = cats.withColumn("name", F.concat(F.lit("s"), F.col("shard_order").cast("string"), F.lit("_"), F.col("category_id").cast("string")))
    im = v.img.withColumnRenamed("shard_id", "shard_order")
    an = v.ann.withColumnRenamed("shard_id", "shard_order")
    _, merged, first = A.merge_shards(im, an, cats, ann_order=["shard_order", *_ORDER[1:]], strict=False)
    merged = merged.withColumn("issue", F.when(F.col("new_image_id").isNull(), F.lit("coco_orphan_ann")))
    return merged.select(*_ANN, "category_id", "new_id", "new_image_id", "issue").join(first, "category_id", "left")


# ---------------------------------------------------------------- rules

_FIN = "(not isnan(w) and abs(w) < cast('infinity' as double))"
_BBOX = {
    "coco_bbox_nan": ("error", f"not {_FIN}"),
    "coco_bbox_small_area": ("error", f"{_FIN} and w * h < 1e0"),
    "coco_bbox_nonpos_wh": ("error", f"{_FIN} and (w <= 0 or h <= 0)"),
    "coco_image_dim": ("error", f"{_FIN} and iw * ih <= 0"),
    "coco_bbox_huge_frac": ("warning", f"{_FIN} and iw * ih > 0 and w * h / (iw * ih) >= 95e-2"),
    "coco_bbox_oob": ("warning", f"{_FIN} and iw * ih > 0 and (x < -1e-6 or y < -1e-6 or x + w > iw + 1e-6 or y + h > ih + 1e-6)"),
}


def _bbox_issues(v):
    return V.bbox_rules(dims(v), keep=_ANN)


_BBOX_SQL = " union all ".join(f"select {_ANN_SQL}, '{s}' as severity, '{c}' as code from {_DIMS} a where {w}" for c, (s, w) in _BBOX.items())
query("rules_bbox", _BBOX_SQL)(lambda v: _bbox_issues(v).select(*_ANN, "severity", "code"))
for _code, (_sev, _where) in _BBOX.items():
    query(f"rule_{_code}", f"select {_ANN_SQL}, '{_sev}' as severity from {_DIMS} a where {_where}")(
        lambda v, c=_code: _bbox_issues(v).filter(F.col("code") == c).select(*_ANN, "severity")
    )

_Y = ["frame_id", "l_linenumber", "l_partkey", "l_suppkey"]
_TOK = """(select *, regexp_split_to_array(trim(line), '\\s+') as tk from $yolo as y)"""
_PARSED = f"""(select *, len(tk) = 5 as five, try_cast(tk[1] as bigint) as cls, try_cast(tk[2] as double) as cx, try_cast(tk[3] as double) as cy,
               try_cast(tk[4] as double) as bw, try_cast(tk[5] as double) as bh from {_TOK} t)"""
_YP = "five and cls is not null"
_YA = f"{_YP} and cx is not null and cy is not null and bw is not null and bh is not null"
_YF = f"{_YA} and not isnan(cx)"
_YOLO = {
    "yolo_bad_line": ("error", "not five"),
    "yolo_class": ("error", "five and cls is null"),
    "yolo_parse": ("error", f"{_YP} and (cx is null or cy is null or bw is null or bh is null)"),
    "yolo_nan": ("error", f"{_YA} and isnan(cx)"),
    "yolo_nonpos_wh": ("error", f"{_YF} and (bw <= 0 or bh <= 0)"),
    "yolo_huge_frac": ("warning", f"{_YF} and bw * bh >= 95e-2"),
    "yolo_small_area": ("error", f"{_YF} and bw * bh * 57600e0 + 1e-12 < 1e0"),
    "yolo_oob_norm": ("warning", f"{_YF} and (cx - bw / 2e0 < -1e-6 or cy - bh / 2e0 < -1e-6 or cx + bw / 2e0 > 1e0 + 1e-6 or cy + bh / 2e0 > 1e0 + 1e-6)"),
}


def label_lines(v):
    lines = V.split_label_text(v.yolo.withColumnRenamed("line", "text")).withColumns({"iw": F.lit(320), "ih": F.lit(180)})
    return V.parse_label_tokens(lines)


_YOLO_SQL = " union all ".join(f"select {', '.join(_Y)}, '{s}' as severity, '{c}' as code from {_PARSED} p where {w}" for c, (s, w) in _YOLO.items())
query("rules_yolo", _YOLO_SQL)(lambda v: V.label_line_rules(label_lines(v), keep=_Y).select(*_Y, "severity", "code"))
for _code, (_sev, _where) in _YOLO.items():
    query(f"rule_{_code}", f"select {', '.join(_Y)}, '{_sev}' as severity from {_PARSED} p where {_where}")(
        lambda v, c=_code: V.label_line_rules(label_lines(v), keep=_Y).filter(F.col("code") == c).select(*_Y, "severity")
    )


@query("read_yolo", f"""select {', '.join(_Y)}, cls as class_id, {r('cx')} as cx, {r('cy')} as cy, {r('bw')} as bw, {r('bh')} as bh from {_PARSED} p where five""")
def _(v):
    return label_lines(v).filter(F.size("tokens") == 5).select(*_Y, "class_id", *[rnd(c).alias(c) for c in ("cx", "cy", "bw", "bh")])


_PAIR = """(select f.*, i.file_name is not null as known from $files as f left join (select distinct file_name from $img as i) i on f.file_name = i.file_name)"""
_PAIRS = {
    "png_not_in_coco": ("warning", "not known"),
    "yolo_missing": ("error", "not has_txt"),
    "meta_missing": ("error", "has_txt and not has_meta"),
}
_PAIR_SQL = " union all ".join(f"select file_name, concat(split, '/', file_name) as path, '{s}' as severity, '{c}' as code from {_PAIR} p where {w}" for c, (s, w) in _PAIRS.items())


def _pair_issues(v):
    return V.pairing_rules(listing(v), images(v), check_meta=True)


query("rules_pairing", _PAIR_SQL)(lambda v: _pair_issues(v).select(F.col("subject").alias("file_name"), "path", "severity", "code"))
for _code, (_sev, _where) in list(_PAIRS.items())[1:]:
    query(f"rule_{_code}", f"select file_name, concat(split, '/', file_name) as path from {_PAIR} p where {_where}")(
        lambda v, c=_code: _pair_issues(v).filter(F.col("code") == c).select(F.col("subject").alias("file_name"), "path")
    )

_IMG_RULES = {
    "path_ambiguous": ("error", "hits > 1"),
    "coco_image_missing": ("error", "hits <> 1"),
    "image_small": ("error", "hits = 1 and size_bytes < 3"),
}


def _image_issues(v):
    return V.image_file_rules(A.resolve_images(images(v), listing(v)), V.Limits(min_image_bytes=3))


query("rules_images", " union all ".join(f"select file_name, '{s}' as severity, '{c}' as code from {_RES} r where {w}" for c, (s, w) in _IMG_RULES.items()))(
    lambda v: _image_issues(v).select(F.col("subject").alias("file_name"), "severity", "code")
)
query("rule_image_small", f"select file_name from {_RES} r where hits = 1 and size_bytes < 3")(
    lambda v: _image_issues(v).filter("code = 'image_small'").select(F.col("subject").alias("file_name"))
)


def all_issues(v):
    return V.union_issues(
        [
            V.bbox_rules(dims(v)), V.label_line_rules(label_lines(v)), _pair_issues(v), _image_issues(v),
            V.duplicate_name_rule(images(v)), V.annotation_entry_rules(annotations(v), images(v)), V.image_entry_rules(images(v)),
        ]
    )


_ALL_SQL = f"""select severity, code from ({_BBOX_SQL}) b union all select severity, code from ({_YOLO_SQL}) y union all select severity, code from ({_PAIR_SQL}) p
   union all {" union all ".join(f"select '{s}', '{c}' from {_RES} r where {w}" for c, (s, w) in _IMG_RULES.items())}
   union all select 'warning', 'coco_duplicate_fname' from (select image_id, lag(image_id) over (partition by file_name order by pos) as prev_id from $img as i) q where prev_id <> image_id
   union all select 'error', 'coco_orphan_ann' from $ann as a where not exists (select 1 from $img as i where i.image_id = a.image_id)"""


@query("issues_union", f"select severity, code, cast(count(*) as bigint) as n from ({_ALL_SQL}) a group by 1, 2")
def _(v):
    return V.issue_rollup(all_issues(v))


query("rules", f"select severity, code, cast(count(*) as bigint) as n from ({_ALL_SQL}) a group by 1, 2")(lambda v: V.issue_rollup(all_issues(v)))


@query("issue_rollup", f"select frame_id, severity, code, cast(count(*) as bigint) as n from ({_YOLO_SQL}) y group by 1, 2, 3")
def _(v):
    return V.issue_rollup(V.label_line_rules(label_lines(v), keep=["frame_id"]), ["frame_id"])


@query(
    "exit_code",
    f"""select frame_id, cast(max(case when severity = 'error' then 1 else 0 end) as int) as plain, cast(max(1) as int) as strict from ({_YOLO_SQL}) y group by 1""",
)
def _(v):
    issues = V.label_line_rules(label_lines(v), keep=["frame_id"])
    plain = V.exit_code(issues, ["frame_id"]).withColumnRenamed("exit_code", "plain")
    return plain.join(V.exit_code(issues, ["frame_id"], strict=True).withColumnRenamed("exit_code", "strict"), "frame_id")


@query(
    "validation_stats",
    f"""select cast((select count(distinct image_id) from $img as i) as bigint) as coco_images_referenced,
               cast((select count(*) from {_RES} r where hits = 1) as bigint) as coco_images_checked_existing""",
)
def _(v):
    return V.validation_stats(images(v), A.resolve_images(images(v), listing(v)))


@query("sorted_report", f"select category_id, cast(count(*) as bigint) as n from {_DIMS} a group by 1 order by 1")
def _(v):
    return dims(v).groupBy("category_id").agg(F.count(F.lit(1)).alias("n")).orderBy("category_id")


def _simple_rule(code, sql, issues):
    query(f"rule_{code}", sql)(lambda v: issues(v).filter(F.col("code") == code).groupBy("subject").agg(F.count(F.lit(1)).alias("n")))


_simple_rule("png_not_in_coco", f"select file_name as subject, cast(count(*) as bigint) as n from {_PAIR} p where not known group by 1", _pair_issues)
_simple_rule("path_ambiguous", f"select file_name as subject, cast(count(*) as bigint) as n from {_RES} r where hits > 1 group by 1", _image_issues)
_simple_rule("coco_image_missing", f"select file_name as subject, cast(count(*) as bigint) as n from {_RES} r where hits <> 1 group by 1", _image_issues)
_simple_rule(
    "coco_duplicate_fname",
    "select cast(image_id as string) as subject, cast(count(*) as bigint) as n from (select image_id, lag(image_id) over (partition by file_name order by pos) as prev_id from $img as i) q where prev_id <> image_id group by 1",
    lambda v: V.duplicate_name_rule(images(v)),
)
_simple_rule(
    "coco_orphan_ann",
    "select concat('image_id=', cast(image_id as string), ' ann_id=', cast(ann_seq as string)) as subject, cast(count(*) as bigint) as n from $ann as a where not exists (select 1 from $img as i where i.image_id = a.image_id) group by 1",
    lambda v: V.annotation_entry_rules(annotations(v), images(v)),
)
