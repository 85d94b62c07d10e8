"""Files written from the given tables, read back and compared: sinks, the splittable document reader, rules on files and elements."""

import io
import tarfile
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from pixeltide.checks.core import query, r
from pixeltide.checks.document_checks import _documents
from pixeltide.checks.pixel_checks import _REG
from pixeltide.functions.columns import rnd
from pixeltide.operators import annotations as A
from pixeltide.operators import frames, pixels
from pixeltide.plans import validation as V
from pixeltide.session import ensure_checkpoint_dir
from pixeltide.sinks import labels as L
from pixeltide.sinks.packing import write_webdataset
from pixeltide.sinks.storage import open_read
from pixeltide.sinks.textfiles import write_text_files
from pixeltide.sources import files as S

#: Small ranges, so that small documents are read by many tasks as well.
_RANGE = 1 << 16


def _folder(v):
    """A new folder beside the checkpoints, which all executors see, as a plain path where it is a local one."""
    ensure_checkpoint_dir(v.spark)
    base = v.spark.sparkContext.getCheckpointDir().rstrip("/").removeprefix("file://").removeprefix("file:")
    return f"{base}/files-{uuid.uuid4().hex}"


_BOX_SQL = f"select row_number() over (order by frame_id, instance_id) as ann_id, * from {_REG} b"


@query(
    "coco_round_trip",
    f"""select 'image' as kind, new_id as id, cast(null as bigint) as image_id, cast(null as bigint) as category_id, cast(null as double) as bx, cast(null as double) as bh, file_name as name from (
          select row_number() over (order by shard_id, pos) as new_id, file_name from $img as i) q
        union all select 'annotation', ann_id, frame_id, class_id, cast(x0 as double), cast(y1 - y0 + 1 as double), label from ({_BOX_SQL}) q
        union all select 'category', class_id, null, null, null, null, label from (
          select class_id, label, row_number() over (partition by class_id order by frame_id, instance_id) as rn from {_REG} b) q where rn = 1""",
)
def _(v):
    """The tables as one document, written in parts, put together, and read by ranges."""
    base = _folder(v)
    L.write_coco(*_documents(v), f"{base}/parts")
    L.assemble(f"{base}/parts", f"{base}/annotations_coco.json")
    images, anns, cats = S.read_coco(v.spark, f"{base}/annotations_coco.json", _RANGE)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    im = images.select(F.lit("image").alias("kind"), F.col("image_id").alias("id"), none("bigint", "image_id"), none("bigint", "category_id"), none("double", "bx"), none("double", "bh"), F.col("file_name").alias("name"))
    an = anns.select(F.lit("annotation").alias("kind"), F.col("ann_id").alias("id"), "image_id", "category_id", F.get("bbox", F.lit(0)).alias("bx"), F.get("bbox", F.lit(3)).alias("bh"), F.col("label").alias("name"))
    ca = cats.select(F.lit("category").alias("kind"), F.col("category_id").alias("id"), none("bigint", "image_id"), none("bigint", "category_id"), none("double", "bx"), none("double", "bh"), "name")
    return im.unionByName(an).unionByName(ca)


# Lines of the document as text; ids and boxes print as SQL prints them.
@query(
    "coco_document_lines",
    f"""select 1 as section, new_id as ord, concat(case when new_id = 1 then '' else ',' end, '{{"id":', new_id, ',"file_name":"', file_name, '","width":', width, ',"height":', height, '}}') as value
        from (select row_number() over (order by shard_id, pos) as new_id, file_name, width, height from $img as i) q
        union all select 3, ann_id, concat(case when ann_id = 1 then '' else ',' end, '{{"id":', ann_id, ',"image_id":', frame_id, ',"category_id":', class_id, ',"bbox":[', x0, '.0,', y0, '.0,', x1 - x0 + 1, '.0,', y1 - y0 + 1,
          '.0],"iscrowd":0,"area":', (x1 - x0 + 1) * (y1 - y0 + 1), ',"instance_id":', instance_id, ',"label":"', label, '"}}') from ({_BOX_SQL}) q
        union all select 5, class_id, concat(case when class_id = min(class_id) over () then '' else ',' end, '{{"id":', class_id, ',"name":"', label, '"}}') from (
          select class_id, label, row_number() over (partition by class_id order by frame_id, instance_id) as rn from {_REG} b) q where rn = 1
        union all select * from (values (0, 0, '{{"images":['), (2, 0, '],"annotations":['), (4, 0, '],"categories":['), (6, 0, ']}}')) f""",
)
def _(v):
    return L.coco_lines(*_documents(v)).select("section", "ord", "value")


_IMAGE_OK = "k % 41 <> 1 and k % 43 <> 2 and k % 47 <> 3"


@query(
    "rules_elements",
    f"""with im as (select o_orderkey as k from @orders@), an as (select l_orderkey as k, l_partkey as p, {_IMAGE_OK.replace("k %", "l_orderkey %")} as sized from @lineitem@)
        select code, severity, cast(count(*) as bigint) as n from (
          select 'coco_image_schema' as code, 'error' as severity from im where k % 41 = 1 or k % 43 = 2
          union all select 'coco_image_fname', 'error' from im where k % 41 <> 1 and k % 43 <> 2 and k % 47 = 3
          union all select 'coco_ann_dtype', 'warning' from an where p % 37 = 1
          union all select 'coco_bbox_type', 'error' from an where p % 37 <> 1 and p % 41 = 2 and sized
          union all select 'coco_bbox_values', 'error' from an where p % 37 <> 1 and p % 41 <> 2 and p % 43 = 3 and sized
          union all select 'coco_bbox_len', 'error' from an where p % 37 <> 1 and p % 41 <> 2 and p % 43 <> 3 and p % 47 = 4 and sized) q group by 1, 2""",
)
def _(v):
    """Elements with one defect each, as one document in a file of its own, read by ranges."""
    k, p = F.col("o_orderkey"), F.col("l_partkey")
    orders, lines = (v.spark.read.parquet(f"{v.sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    image = (
        F.when(k % 41 == 1, F.lit("5")).when(k % 43 == 2, F.lit('{"id":"x"}')).when(k % 47 == 3, F.format_string('{"id":%d}', k))
        .otherwise(F.format_string('{"id":%d,"file_name":"f%d.png","width":320,"height":180}', k, k))
    )
    box = F.when(p % 41 == 2, F.lit('"wide"')).when(p % 43 == 3, F.lit('[1,2,"wide",4]')).when(p % 47 == 4, F.lit("[1,2,3]")).otherwise(F.lit("[1,2,3,4]"))
    ann = F.when(p % 37 == 1, F.lit("null")).otherwise(F.concat(F.format_string('{"id":%d,"image_id":%d,"category_id":1,"bbox":', p, F.col("l_orderkey")), box, F.lit("}")))
    # Every element is followed by a comma, and the last by one that ends its section.
    section = lambda df, n, text, *order: df.select(F.lit(n).alias("section"), *[c.cast("bigint").alias(f"o{i}") for i, c in enumerate(order)], F.concat(text, F.lit(",\n")).alias("text"))
    fixed = lambda n, text: v.spark.range(1).select(F.lit(n).alias("section"), F.col("id").alias("o0"), F.col("id").alias("o1"), F.lit(text).alias("text"))
    rows = section(orders, 1, image, k, F.lit(0)).unionByName(section(lines, 3, ann, F.col("l_orderkey"), F.col("l_linenumber")))
    head, middle, tail = fixed(0, '{ "images" : [\n'), fixed(2, '{"id":-1,"file_name":"-"}],\n"annotations":[ '), fixed(4, '{"image_id":-1,"bbox":[1,2,3,4]}], "categories":[]}\n')
    rows = rows.unionByName(head).unionByName(middle).unionByName(tail)
    base = _folder(v)
    # Many tasks sort and write it in parts; one file written by path would be one task's work.
    rows.orderBy("section", "o0", "o1").select("text").write.text(f"{base}/parts")
    L.assemble(f"{base}/parts", f"{base}/document.json")
    images, anns, _ = S.read_coco(v.spark, f"{base}/document.json", _RANGE)
    sized = images.filter("is_object and image_id is not null and file_name is not null and width is not null").withColumn("hits", F.lit(1))
    wrong = V.union_issues([V.image_entry_rules(images), V.annotation_entry_rules(anns, images), V.bbox_rules(A.annotation_dims(anns.filter("is_object"), sized))])
    codes = ["coco_image_schema", "coco_image_fname", "coco_ann_dtype", "coco_bbox_type", "coco_bbox_values", "coco_bbox_len"]
    return wrong.filter(F.col("code").isin(*codes)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rule_yolo_io",
    """select concat('s', cast(c_custkey as string), '.txt') as name, case when c_custkey % 7 = 0 then 'undecodable' when c_custkey % 11 = 0 then 'gone' end as fault,
              cast(case when c_custkey % 7 = 0 or c_custkey % 11 = 0 then 0 when c_custkey % 5 = 0 then 0 else 2 end as bigint) as lines from @customer@""",
)
def _(v):
    """A label file per customer: some are no UTF-8, some are gone when they are read, some are empty; the rest is parsed all the same."""
    key = F.col("c_custkey")
    files = v.spark.read.parquet(f"{v.sf_dir}/customer.parquet").select(F.format_string("s%d.txt", key).alias("path"), key)
    good = F.when(key % 5 == 0, F.lit("")).otherwise(F.lit("1 0.5 0.5 0.1 0.1\n\n2 0.5 0.5 0.1 0.1")).cast("binary")
    content = F.when(key % 7 == 0, F.unhex(F.lit("3120FF0A"))).otherwise(good)
    base = _folder(v)
    write_text_files(files.filter((key % 11 != 0) | (key % 7 == 0)).withColumns({"o": F.lit(0), "text": content}), base, ["o"])
    texts = S.read_checked(files.select(F.concat(F.lit(f"{base}/"), "path").alias("path"), F.col("path").alias("name")))
    issues = V.label_io_rules(texts, F.col("name"), F.col("path"))
    fault = F.when(F.col("message").contains("UTF-8"), "undecodable").when(F.col("message").contains("cannot be read"), "gone")
    found = issues.select(F.col("subject").alias("name"), fault.alias("fault"))
    lines = V.parse_label_tokens(V.split_label_text(texts.filter("error is null").select("name", "text"))).groupBy("name").agg(F.count(F.lit(1)).alias("lines"))
    return texts.select("name").join(found, "name", "left").join(lines, "name", "left").select("name", "fault", F.coalesce("lines", F.lit(0)).alias("lines"))


# Rounded as printed: half up on the decimal digits.
_SIX = "cast(round(cast({0} as decimal(18, 9)), 6) as double)"


@query(
    "write_yolo",
    f"""select frame_id, instance_line, class_id, {r(_SIX.format("(x0 + x1 + 1) / 2e0 / 320e0"))} as cx, {r(_SIX.format("(y0 + y1 + 1) / 2e0 / 180e0"))} as cy,
               {r(_SIX.format("(x1 - x0 + 1) / 320e0"))} as bw, {r(_SIX.format("(y1 - y0 + 1) / 180e0"))} as bh
        from (select *, cast(row_number() over (partition by frame_id order by instance_id) as int) as instance_line from {_REG} b) q""",
)
def _(v):
    """A label file per frame and back."""
    boxes = pixels.normalized_boxes(pixels.attach_registry(pixels.boxes_from_mask(v.px), v.obj), F.lit(320), F.lit(180))
    named = frames.frame_names(v.px.select("frame_id").distinct().withColumn("split", F.when(F.col("frame_id") % 5 == 0, "val").otherwise("train")), "frame_id")
    base = _folder(v)
    L.write_yolo(boxes, named, base)
    back = S.read_yolo(v.spark, base)
    frame = F.regexp_extract("path", r"frame_(\d+)\.txt$", 1).cast("bigint")
    return back.select(frame.alias("frame_id"), F.col("line_no").alias("instance_line"), F.col("class_id").cast("int").alias("class_id"), *[rnd(c).alias(c) for c in ("cx", "cy", "bw", "bh")])


@query(
    "write_boxes",
    f"""select frame_id, cast(count(*) as bigint) as n, cast(min(instance_id) as bigint) as first_id, cast(sum(x0 + 3 * y1) as bigint) as total, min(label) as label, cast(320 as bigint) as width from {_REG} b group by 1""",
)
def _(v):
    """A document of boxes per frame and back."""
    boxes = pixels.attach_registry(pixels.boxes_from_mask(v.px), v.obj)
    base = _folder(v)
    L.write_boxes_json(boxes, base, 320, 180, F.format_string("boxes/f%d.json", "frame_id"))
    kind = "image_width bigint, image_height bigint, boxes array<struct<instance_id:bigint,class_id:bigint,label:string,xmin:bigint,ymin:bigint,xmax:bigint,ymax:bigint>>"
    docs = S.read_texts(v.spark, base, "*.json").select(F.regexp_extract("path", r"f(\d+)\.json$", 1).cast("bigint").alias("frame_id"), F.from_json("text", kind).alias("d"))
    rows = docs.select("frame_id", F.col("d.image_width").alias("width"), F.posexplode("d.boxes").alias("at", "b"))
    return rows.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("b.instance_id", "at").alias("first_id"), F.sum(F.col("b.xmin") + 3 * F.col("b.ymax")).alias("total"), F.min("b.label").alias("label"), F.max("width").alias("width"),
    )


@query(
    "write_ply",
    """select frame_id, cast(count(*) as bigint) as header, cast(count(*) as bigint) as points, cast(sum(px_col * 2 + px_row) as double) as total, cast(sum(cast(floor(l_linenumber / 7e0 * 255e0) as int)) as bigint) as red
       from $px as p group by 1""",
)
def _(v):
    """A point file per frame: the count in the header, and what the lines add up to."""
    points = v.px.select("frame_id", "px_row", "px_col", (F.col("px_col") * 2.0).alias("x"), F.col("px_row").cast("double").alias("y"), F.lit(0.0).alias("z"), (F.col("l_linenumber") / 7.0).alias("r"), F.lit(1.0).alias("g"), F.lit(0.0).alias("b"))
    base = _folder(v)
    L.write_ply(points, base, F.format_string("cloud_%d.ply", "frame_id"))
    docs = S.read_texts(v.spark, base, "*.ply").select(F.regexp_extract("path", r"cloud_(\d+)\.ply$", 1).cast("bigint").alias("frame_id"), F.split("text", "end_header\n").alias("h"))
    header = F.regexp_extract(F.col("h")[0], r"element vertex (\d+)", 1).cast("bigint")
    lines = docs.select("frame_id", header.alias("header"), F.explode(F.split(F.regexp_replace(F.col("h")[1], "\n$", ""), "\n")).alias("l")).withColumn("v", F.split("l", " "))
    n = lambda i: F.col("v")[i].cast("double")
    return lines.groupBy("frame_id").agg(F.max("header").alias("header"), F.count(F.lit(1)).alias("points"), F.sum(n(0) + n(1)).alias("total"), F.sum(n(3).cast("bigint")).alias("red"))


def _members(path):
    with open_read(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as t:
        return [(m.name, m.size) for m in t.getmembers()]


@query(
    "write_webdataset",
    """select cast(floor((dense_rank() over (order by split, s_suppkey) - 1) / 16e0) as int) as shard, concat('frame_', lpad(cast(s_suppkey as string), 4, '0'), '.', e) as name,
              cast(length(case when e = 'txt' then '' else s_name end) as bigint) as size
       from (select s_suppkey, s_name, case when s_suppkey % 5 = 0 then 'val' else 'train' end as split from @supplier@ where s_suppkey % 9 <> 4) s,
            (values ('json'), ('png'), ('txt')) as t(e) where not (e = 'txt' and s_suppkey % 3 = 0)""",
)
def _(v):
    """Frames of a dataset tree in shards of 16: which parts of which frame lie in which shard."""
    key, base = F.col("s_suppkey"), _folder(v)
    rows = v.spark.read.parquet(f"{v.sf_dir}/supplier.parquet")
    stem = F.concat(F.when(key % 5 == 0, "val").otherwise("train"), F.format_string("/frame_%04d", key))
    parts = F.array(F.when(key % 9 != 4, F.lit("_meta.json")), F.lit(".png"), F.when(key % 3 != 0, F.lit(".txt")))
    files = rows.select("s_name", stem.alias("stem"), F.explode(parts).alias("suffix")).filter("suffix is not null")
    files = files.select(F.concat("stem", "suffix").alias("path"), F.lit(0).alias("o"), F.when(F.col("suffix") == ".txt", "").otherwise(F.col("s_name")).alias("text"))
    write_text_files(files, f"{base}/data", ["o"])
    shards = write_webdataset(v.spark, f"{base}/data", f"{base}/shards", frames_per_shard=16)

    def read(batches):
        for batch in batches:
            found = [(p, *m) for p in batch.column(0).to_pylist() for m in _members(p)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "name", "size"])

    held = v.spark.createDataFrame([(s,) for s in shards], "path string").mapInArrow(read, "path string, name string, size bigint")
    return held.select(F.regexp_extract("path", r"shard-(\d+)\.tar$", 1).cast("int").alias("shard"), "name", "size")


@query(
    "loader_index",
    """select split, file_name, sample_index from (
         select split, file_name, row_number() over (order by split, n) - 1 as sample_index from (
           select split, file_name, cast(substr(file_name, 7, length(file_name) - 10) as bigint) as n from $files as f where has_meta and split in ('train', 'val')) q) s""",
)
def _(v):
    """A listing of frames and sidecars as a loader sees it; the val split of one family decides nothing here."""
    stem = F.regexp_replace("file_name", r"\.png$", "")
    names = F.array(F.col("file_name"), F.when(F.col("has_txt"), F.concat(stem, F.lit(".txt"))), F.when(F.col("has_meta"), F.concat(stem, F.lit("_meta.json"))), F.lit("notes.md"))
    listing = v.files.select(F.lit("root").alias("root"), "split", F.explode(names).alias("name"), F.lit(1).cast("bigint").alias("length")).filter("name is not null")
    out = frames.loader_index(listing)
    return out.select("split", F.concat("stem", F.lit(".png")).alias("file_name"), "sample_index")


@query("rule_png_ihdr", "select file_name, concat(split, '/', file_name) as path from $files as f where has_txt and size_bytes % 5 = 0")
def _(v):
    """Labelled images whose header could not be read."""
    listed = v.files.withColumns({"path": F.concat_ws("/", "split", "file_name"), "hdr_w": F.when(F.col("size_bytes") % 5 != 0, F.lit(6))})
    issues = V.pairing_rules(listed, v.img.withColumn("is_object", F.lit(True)))
    return issues.filter("code = 'png_ihdr'").select(F.col("subject").alias("file_name"), "path")


@query(
    "rules_manifest",
    """select c_custkey as id, case when c_custkey % 3 = 0 then 'manifest_io' else 'manifest_root_mismatch' end as code, case when c_custkey % 3 = 0 then 'error' else 'warning' end as severity
       from @customer@ where c_custkey % 3 = 0 or c_custkey % 4 = 1""",
)
def _(v):
    """A manifest per customer: some break off, some record another root."""
    key = F.col("c_custkey")
    whole = F.concat(F.lit('{"dataset_layout":{"dataset_root":"'), F.when(key % 4 == 1, "/elsewhere").otherwise("/data/x/"), F.lit('"}}'))
    docs = v.spark.read.parquet(f"{v.sf_dir}/customer.parquet").select(F.format_string("/m/%d", key).alias("path"), F.when(key % 3 == 0, F.lit('{"dataset_layout":')).otherwise(whole).alias("text"))
    issues = V.manifest_rules(docs, "/data/x")
    return issues.select(F.regexp_extract("path", r"(\d+)$", 1).cast("bigint").alias("id"), "code", "severity")
