"""Work of few splits or of many small ranges is dealt to a number of tasks that fits."""

from pyspark.sql import functions as F

from pixeltide.checks import all as checks
from pixeltide.functions import jsonfn as J
from pixeltide.plans import configs as C
from pixeltide.session import spread
from pixeltide.sources import bigjson


def test_documents_of_one_split_are_read_by_many_tasks(spark):
    docs = spark.range(40).coalesce(1).select(F.col("id").alias("config_id"), F.format_string('{"mystery":%d}', "id").alias("doc"))
    assert C.parsed(docs).select("config_id").rdd.getNumPartitions() == spread(spark)
    assert sorted(r["config_id"] for r in C.lint(docs).collect() if r["path"] == "mystery") == list(range(40))


def test_objects_are_told_from_other_values(spark):
    texts = ["{}", '{"a":[{}]}', "[]", "[{}]", "null", "1", '"{}"', "true", "nope", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert sorted(r["i"] for r in df.filter(J.is_object(F.try_parse_json("t"))).collect()) == [0, 1]


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"images":[' + ",".join(f'{{"id":{i}}}' for i in range(400)) + "]}")
    found = bigjson.array_elements(spark, [str(tmp_path / "a.json")], ("images",), 16)
    assert found.elements.rdd.getNumPartitions() <= spread(spark)
    assert [r["text"] for r in found.elements.orderBy("place").collect()] == [f'{{"id":{i}}}' for i in range(400)]


def test_a_document_is_written_in_parts(spark, tmp_path, monkeypatch):
    from pixeltide.checks import file_checks

    monkeypatch.setattr(file_checks, "_folder", lambda v: str(tmp_path / "made"))
    rows = [(k, 1) for k in range(1, 200)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, k, 1) for k, _ in rows], "l_orderkey bigint, l_partkey bigint, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one part
    got = {r["code"]: r["n"] for r in checks.QUERIES["rules_elements"](spark, str(tmp_path)).collect()}
    ks = range(1, 200)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sized = [k for k in ks if k % 41 != 1 and k % 43 != 2 and k % 47 != 3]
    boxed = [k for k in sized if k % 37 != 1]
    assert got == {
        "coco_image_schema": sum(k % 41 == 1 or k % 43 == 2 for k in ks), "coco_image_fname": sum(k % 41 != 1 and k % 43 != 2 and k % 47 == 3 for k in ks),
        "coco_ann_dtype": sum(k % 37 == 1 for k in ks), "coco_bbox_type": sum(k % 41 == 2 for k in boxed),
        "coco_bbox_values": sum(k % 41 != 2 and k % 43 == 3 for k in boxed), "coco_bbox_len": sum(k % 41 != 2 and k % 43 != 3 and k % 47 == 4 for k in boxed),
    }
    assert len(list((tmp_path / "made" / "parts").glob("part-*"))) > 1
