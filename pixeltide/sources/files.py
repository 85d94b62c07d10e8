"""File-based sources: listings, frame metadata, annotation documents, label texts, manifests, image headers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixeltide import constants as K
from pixeltide.functions import jsonfn as J
from pixeltide.functions.geometry import intrinsics_mismatch, k_matrix, rows_of_4x4
from pixeltide.operators import ordered
from pixeltide.operators.frames import frame_inventory
from pixeltide.plans.validation import parse_label_tokens, split_label_text
from pixeltide.session import cut, spread, stored
from pixeltide.sinks.storage import locate, open_read
from pixeltide.sources import bigjson

META_SCHEMA = (
    "frame_id bigint, split string, image_width bigint, image_height bigint,"
    " convention struct<camera_to_world:string,handedness:string,object_transform_note:string>,"
    " camera_extrinsics array<double>,"
    " camera_intrinsics struct<fx:double,fy:double,cx:double,cy:double,vfov_deg:double,skew:bigint,pixel_ray:string>,"
    " render struct<spp_target:bigint,spp_avg:bigint,max_depth:bigint,seed:bigint>,"
    " camera struct<lookfrom:array<double>,lookat:array<double>,up:array<double>,fov_deg:double,focus_dist:double>,"
    " sun struct<azimuth_deg:double,elevation_deg:double>,"
    " objects array<struct<instance_id:bigint,class_id:bigint,label:string,position:array<double>,rotation_deg:array<double>,"
    "scale:array<double>,roughness:double,metallic:double,grounding_constraint:boolean,terrain_normal:array<double>,"
    "transform_supervision:string,local_to_world_row_major:array<double>>>"
)

MANIFEST_SCHEMA = (
    "version_info struct<engine_version:string,schema_version:string,git_commit:string>,"
    " execution struct<argv:string,cwd:string,timestamp_utc:string,dataset_id:string,active_scenario:string,"
    "random_seed:struct<render_config_seed:bigint>>,"
    " config_audit struct<config_path:string,resolved_config:string,resolved_config_sha256:string>,"
    " dataset_layout struct<job_kind:string,dataset_root:string,frames_total:bigint,frames_rendered_this_process:bigint,"
    "train_frames:bigint,val_frames:bigint,shard:struct<index:int,count:int>,coco_annotations_file:string>"
)


def list_files(spark: SparkSession, root: str, batch: int = 10_000) -> DataFrame:
    """root, split (folder below the root, '' at the root), name, path, length of every file.

    Folders are listed by tasks, level by level: what a task finds to be a folder is another task's work, and the rows of each level
    are kept on the checkpoint folder. Spark's own file sources leave out empty files, and an empty label file is a valid one.
    ``path`` is the root as given, with the scheme it has, and the place below it.
    """
    clean = root.rstrip("/")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = locate(clean)
        base = base.rstrip("/")
        for pdf in batches:
            for below in pdf["rel"]:
                infos = system.get_file_info(fs.FileSelector(base + below, allow_not_found=True))
                for i in range(0, len(infos), batch):
                    part = [f for f in infos[i : i + batch] if f.type in (fs.FileType.File, fs.FileType.Directory)]
                    yield pd.DataFrame(
                        {
                            "rel": [f"{below}/{f.base_name}" for f in part],
                            "length": [0 if f.size is None else f.size for f in part],
                            "folder": [f.type == fs.FileType.Directory for f in part],
                        }
                    )

    listed = spark.createDataFrame([], "rel string, length bigint")
    todo = spark.createDataFrame([("",)], "rel string")
    while True:
        found = cut(todo.mapInPandas(walk, "rel string, length bigint, folder boolean"))
        listed = listed.union(found.filter("not folder").select("rel", "length"))
        n = found.filter("folder").count()
        if not n:
            break
        todo = found.filter("folder").select("rel").repartition(min(n, spread(spark)))
    return listed.select(
        F.lit(clean).alias("root"),
        F.regexp_extract("rel", r"(?s)^/(.*)/[^/]*$", 1).alias("split"),
        F.regexp_extract("rel", r"([^/]*)$", 1).alias("name"),
        F.concat(F.lit(clean), "rel").alias("path"),
        "length",
    )


def scan_frames(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Frames below a root with their sidecars; flat layouts have split ''. strict takes names of exactly four digits only."""
    return frame_inventory(list_files(spark, root).filter(F.col("split").isin("", "train", "val")), strict)


def read_texts(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, deep: bool = True) -> DataFrame:
    """path, text of whole files, in all folders below unless ``deep`` is off. Empty files give no row."""
    reader = spark.read.option("recursiveFileLookup", str(deep).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    texts = reader.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return texts.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))


def read_checked(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``text`` of each listed file, or ``error`` where it cannot be read or is not UTF-8; one file's fault fails no job.

    Unlike a scan, this sees empty files, and files that went since they were listed. A task holds one file at a time.
    """
    kept = [f for f in files.schema.fields]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for p in batch.column(batch.schema.get_field_index(path)).to_pylist():
                try:
                    with open_read(p) as f:
                        texts.append(f.read().decode("utf-8"))
                    errors.append(None)
                except UnicodeDecodeError as ex:
                    texts.append(None)
                    errors.append(f"not UTF-8 at byte {ex.start}")
                except OSError as ex:
                    texts.append(None)
                    errors.append(f"cannot be read: {type(ex).__name__}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "text", "error"])

    return files.repartition(spread(files.sparkSession)).mapInArrow(read, schema)


def plain_path(path: Column) -> Column:
    """A file path as Spark reports it (escaped, with a scheme) in the form that listings give local ones."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def below_root(path: Column, root: str) -> Column:
    """What follows ``root`` in a path of plain_path form; null elsewhere."""
    prefix = re.sub("^file:/+", "/", root.rstrip("/")) + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30))


# ---------------------------------------------------------------- frame metadata


def parse_frame_meta(docs: DataFrame, text: str = "text") -> DataFrame:
    """Typed frame metadata from document texts; ``valid`` is false where the text does not parse.

    A missing frame_id reads as -1, a missing split as ''. mismatch marks intrinsics that disagree with the field of view.
    """
    m = docs.withColumn("m", F.from_json(J.quote_nonfinite(text), META_SCHEMA, {"mode": "PERMISSIVE"}))
    i = F.col("m.camera_intrinsics")
    out = m.select(
        *[c for c in docs.columns if c != text],
        F.try_parse_json(J.quote_nonfinite(text, True)).isNotNull().alias("valid"),
        F.coalesce("m.frame_id", F.lit(-1).cast("bigint")).alias("frame_id"),
        F.coalesce("m.split", F.lit("")).alias("split"),
        F.col("m.image_width").cast("int").alias("w"),
        F.col("m.image_height").cast("int").alias("h"),
        F.col("m.camera_extrinsics").alias("c2w"),
        *[i[k].alias(k) for k in ("fx", "fy", "cx", "cy")],
        i["vfov_deg"].alias("vfov"),
        "m.camera", "m.render", "m.sun", "m.objects",
    )
    out = out.withColumns({"k": k_matrix("fx", "fy", "cx", "cy"), "c2w_rows": F.when(F.size("c2w") == 16, rows_of_4x4("c2w"))})
    return out.withColumn("mismatch", F.coalesce(intrinsics_mismatch("w", "h", "vfov", "fx", "fy", "cx", "cy"), F.lit(False)))


def read_frame_meta(spark: SparkSession, root: str) -> DataFrame:
    docs = read_texts(spark, root, "*_meta.json")
    return parse_frame_meta(docs)


# ---------------------------------------------------------------- annotation documents

_PARTS = "images array<string>, annotations array<string>, categories array<string>, _bad string"


def parse_coco(docs: DataFrame) -> DataFrame:
    """path, readable, images[], annotations[], categories[] as element texts.

    Elements stay JSON texts here, so a document may be larger than one variant value can be.
    """
    p = F.from_json(J.quote_nonfinite("text"), _PARTS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    keys = F.json_object_keys(J.quote_nonfinite("text"))
    return docs.withColumns({"p": p, "readable": keys.isNotNull()}).select(
        *[c for c in docs.columns if c != "text"], "readable", "p.images", "p.annotations", "p.categories"
    )


def coco_tables(parsed: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loose image, annotation and category rows in document order (operators.annotations describes the columns)."""
    return _coco_rows(lambda part: parsed.select(*keep, F.posexplode(part).alias("pos", "__t")), keep)


def _coco_rows(texts: Callable[[str], DataFrame], keep: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows from (keep, pos, __t) of each section."""

    def rows(part: str) -> DataFrame:
        return texts(part).withColumn("e", F.try_parse_json("__t"))

    e = F.col("e")

    def whole(key: str) -> Column:
        f = J.field(e, key)
        return F.when(J.is_int(f), F.try_variant_get(f, "$", "bigint"))

    common = [*keep, F.col("pos").cast("bigint").alias("pos"), J.is_object(e).alias("is_object")]
    images = rows("images").select(
        *common, whole("id").alias("image_id"), J.text_of(J.field(e, "file_name")).alias("file_name"),
        whole("width").cast("int").alias("width"), whole("height").cast("int").alias("height"),
    )
    box = J.field(e, "bbox")
    values = F.transform(
        J.items(box), lambda x: F.when(J.is_string(x), J.parse_float(F.trim(F.try_variant_get(x, "$", "string")))).otherwise(J.number(x))
    )
    anns = rows("annotations").select(
        *common, whole("id").alias("ann_id"), whole("image_id").alias("image_id"), whole("category_id").alias("category_id"),
        J.is_array(box).alias("bbox_is_list"), values.alias("bbox"), J.number(J.field(e, "area")).alias("area"),
        whole("iscrowd").cast("int").alias("iscrowd"), whole("instance_id").alias("instance_id"), J.text_of(J.field(e, "label")).alias("label"),
    )
    cats = rows("categories").select(
        *keep, F.col("pos").cast("bigint").alias("pos"), whole("id").alias("category_id"), J.text_of(J.field(e, "name")).alias("name")
    )
    return images, anns, cats.filter(F.col("category_id").isNotNull() & F.col("name").isNotNull())


def coco_documents(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = bigjson.RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(shard_order, path, readable) of documents and (shard_order, section, pos, text) of their elements, read by byte ranges."""
    found = bigjson.array_elements(spark, [paths] if isinstance(paths, str) else list(paths), K.COCO_SECTIONS, range_bytes)
    # Numbered by the byte an element follows.
    numbered = ordered.number_by_position(found.elements, ["shard_order", "section"], [], "place", "pos")
    return found.documents, numbered.select("shard_order", "section", "pos", "text")


def read_coco(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = bigjson.RANGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Image, annotation and category rows of documents of any size and layout, with shard_order by path order.

    Documents are read by many tasks each (sources.bigjson); unreadable ones have no rows. The rows are kept in the checkpoint folder:
    each rule on them would parse all elements again, and a filter on several columns several times.
    """
    _, elements = coco_documents(spark, paths, range_bytes)
    images, anns, cats = element_tables(elements.withColumn("t", J.quote_nonfinite("text")), ["shard_order"])
    return stored(images), stored(anns), stored(cats)


def element_tables(elements: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Image, annotation and category rows from (keep, section, pos, t) elements, t being JSON."""
    return _coco_rows(lambda part: elements.filter(F.col("section") == part).select(*keep, "pos", F.col("t").alias("__t")), keep)


def read_coco_members(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(shard_order, section, pos, id, image_id, members) of every object element of several documents.

    members keeps all of an element as a map of variants in document order, so what no column names is not lost.
    """
    _, elements = coco_documents(spark, paths)
    rows = elements.select("shard_order", "section", "pos", J.quote_nonfinite("text").alias("t"))
    rows = rows.withColumns({"members": F.from_json("t", "map<string,variant>"), "e": F.try_parse_json("t")}).filter(J.is_object(F.col("e")))
    whole = lambda key: F.try_variant_get(J.field(F.col("e"), key), "$", "bigint")
    return rows.select("shard_order", "section", "pos", whole("id").alias("id"), whole("image_id").alias("image_id"), "members")


def read_coco_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of a document written one element per line (sinks.labels.write_coco).

    The text source splits such a file, so a document of any size is read in parallel. Positions come from the ids, which the
    writer numbers in document order. A line that is neither an element nor the writer's frame around the sections fails the job,
    so a document in another layout is refused, not read in part; read_coco takes it.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^,|,\s*$", "")).alias("t"))
    frame = F.col("t").rlike(r'^[\[\]{}]*$|^\{?"(images|annotations|categories)":\s*\[\]?$|^\],?"(images|annotations|categories)":\s*\[\]?$')
    element = F.startswith(F.col("t"), F.lit("{")) & F.endswith(F.col("t"), F.lit("}")) & F.json_object_keys("t").isNotNull()
    has = lambda key: F.array_contains(F.json_object_keys("t"), key)
    kind = (
        F.when(frame, "frame").when(element & has("image_id"), "annotation").when(element & has("file_name"), "image").when(element & has("name"), "category")
    )
    refused = F.raise_error(F.concat(F.lit("line is no element of this layout: "), F.substring("t", 1, 80))).cast("string")
    lines = lines.withColumn("kind", F.coalesce(kind, refused))
    im = F.from_json("t", "id bigint, file_name string, width int, height int")
    an = F.from_json("t", "id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, iscrowd int, instance_id bigint, label string")
    ca = F.from_json("t", "id bigint, name string")
    of = lambda k, r: lines.filter(F.col("kind") == k).select(r.alias("r"))
    images = of("image", im).select(F.col("r.id").alias("pos"), F.lit(True).alias("is_object"), F.col("r.id").alias("image_id"), "r.file_name", "r.width", "r.height")
    anns = of("annotation", an).select(
        F.col("r.id").alias("pos"), F.lit(True).alias("is_object"), F.col("r.id").alias("ann_id"), "r.image_id", "r.category_id",
        F.col("r.bbox").isNotNull().alias("bbox_is_list"), "r.bbox", "r.area", "r.iscrowd", "r.instance_id", "r.label",
    )
    cats = of("category", ca).select(F.col("r.id").alias("pos"), F.col("r.id").alias("category_id"), "r.name")
    return images, anns, cats.filter(F.col("category_id").isNotNull())


def coco_discover(listing: DataFrame, root_keys: Sequence[str] = ("root",)) -> DataFrame:
    """Per root: the annotation document if exactly one default name exists, else an issue code."""
    roots = listing.select(*root_keys).distinct()
    hits = listing.filter((F.col("split") == "") & F.col("name").isin(*K.COCO_DEFAULT_NAMES)).groupBy(*root_keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("p")
    )
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return roots.join(hits, list(root_keys), "left").select(
        *root_keys, F.when(n == 1, F.col("p")).alias("coco_path"), F.when(n == 0, F.lit("coco_not_found")).when(n > 1, F.lit("coco_ambiguous")).alias("code")
    )


# ---------------------------------------------------------------- labels, manifests, images


def read_yolo(spark: SparkSession, root: str) -> DataFrame:
    """path, line_no, tokens, class_id, cx, cy, bw, bh of all label files below a root."""
    return parse_label_tokens(split_label_text(read_texts(spark, root, "*.txt")))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per manifest (shard manifests included); valid is false where the text does not parse."""
    docs = read_texts(spark, root, "manifest*.json")
    m = docs.withColumns({"m": F.from_json("text", MANIFEST_SCHEMA), "valid": J.parse("text").isNotNull()})
    return m.select("path", "text", "valid", "m.*")


def png_dims(content: Column | str) -> dict[str, Column]:
    """Width and height from PNG bytes already in a column; the header chunk is always the first."""
    c = F.col(content) if isinstance(content, str) else content
    ok = (F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(c, 13, 4)) == "49484452") & (F.octet_length(c) >= 24)

    def number(at: int) -> Column:
        return F.when(ok, F.conv(F.hex(F.substring(c, at, 4)), 16, 10).cast("bigint"))

    return {"hdr_w": number(17), "hdr_h": number(21)}


def _header_dims(path: str) -> tuple[int | None, int | None]:
    try:
        with open_read(path) as f:
            head = f.read(24)
    except OSError:
        return None, None
    if len(head) < 24 or head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        return None, None
    return int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")


def image_dims(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds hdr_w, hdr_h by reading the first 24 bytes of each file, where a scan would read whole images."""
    schema = T.StructType([*files.schema.fields, T.StructField("hdr_w", T.LongType()), T.StructField("hdr_h", T.LongType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = [_header_dims(p) for p in pdf[path]]
            pdf = pdf.assign(hdr_w=pd.array([d[0] for d in dims], dtype="Int64"), hdr_h=pd.array([d[1] for d in dims], dtype="Int64"))
            yield pdf

    # Opening files is the work: spread it, however few partitions the listing has.
    return files.repartition(spread(files.sparkSession)).mapInPandas(read, schema)


def frame_samples(index: DataFrame, meta: DataFrame, pixels: DataFrame, images: DataFrame, keys: Sequence[str] = ("split", "frame_id"), strict: bool = True) -> DataFrame:
    """Index rows with metadata, pixel arrays and image. A sample without image or pixels fails the job when strict.

    Left joins on the frame key keep every index row; ``missing`` names what a lenient row lacks.
    """
    keys = list(keys)
    px = pixels.withColumn("__px", F.lit(True))
    im = images.withColumn("__im", F.lit(True))
    out = index.join(meta, keys, "left").join(px, keys, "left").join(im, keys, "left")
    missing = F.when(F.col("__im").isNull(), F.lit("image")).when(F.col("__px").isNull(), F.lit("pixels"))
    if strict:
        missing = F.when(missing.isNotNull(), F.raise_error(F.concat(F.lit("sample lacks its "), missing)).cast("string"))
    return out.withColumn("missing", missing).drop("__px", "__im")
