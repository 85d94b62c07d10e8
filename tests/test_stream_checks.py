"""Streams of the registered queries: tables of one file or many, batches of many files."""

import pytest
from pyspark.sql import functions as F

from pixeltide.checks import all as checks
from pixeltide.checks import stream_checks as SC
from pixeltide.streaming import jobs as J


@pytest.mark.parametrize("files", [1, 3])
def test_table_streams_take_one_file_or_a_folder(spark, tmp_path, files):
    rows = [(i, [0.0, 0.1, 0.1, 0.2] * 4, i) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    if files == 1:
        df.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    else:
        df.repartition(files).write.parquet(str(tmp_path / "embeddings.parquet"))
    df.write.parquet(str(tmp_path / "more_embeddings.parquet"))
    got = checks.QUERIES["stream_boxes"](spark, str(tmp_path)).collect()
    assert sorted((r["frame_id"], r["instance_id"], r["x0"], r["y0"], r["x1"], r["y1"], r["class_id"]) for r in got) == sorted(
        (i, *box) for i in range(9) for box in [(1, 1, 0, 6, 1, i % 3), (2, 3, 0, 7, 1, 0)]
    )


def test_a_batch_of_many_files_is_one_trigger(spark, tmp_path):
    df = spark.range(60).repartition(5)
    stream = SC._in_batches(spark, df, F.col("id") % 3, 3, spark.createDataFrame([(99,)], "id bigint"))
    seen = []
    q = stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r["id"] for r in b.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == [*(list(range(b, 60, 3)) for b in range(3)), [99]]


def test_pairs_of_many_short_runs_take_a_call_per_bucket(spark, tmp_path, monkeypatch):
    """Runs whose numbers no double tells apart, null runs and null frame numbers share buckets."""
    monkeypatch.setattr(J, "BUCKETS", 2)
    big = 1 << 60
    rows = [(r, g, float(g)) for r in (big, big + 1, big + 2, None) for g in (0, 5, 40, 41, big + 41, big + 42)] + [(big, None, 7.0), (None, None, 8.0)]
    schema = "run_id bigint, g bigint, ex double"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    cams = J.frame_stream(spark, str(tmp_path / "in"), spark.createDataFrame(rows, schema).schema, 1)
    q = J.flow_pairs(cams, ["ex"], width=16).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r["run_id"], r["g"]): (r["prev"]["ex"], r["status"] == "first") for r in J.latest_pairs(spark.read.parquet(str(tmp_path / "out")), width=16).collect()}
    before = {0: 0.0, 5: 0.0, 40: 5.0, 41: 40.0, big + 41: 41.0, big + 42: float(big + 41)}
    want = {(r, g): (p, g == 0) for r in (big, big + 1, big + 2, None) for g, p in before.items()}
    assert got == want | {(big, None): (7.0, True), (None, None): (8.0, True)}
    assert max(p["numRowsUpdated"] for b in q.recentProgress for p in b["stateOperators"]) <= 2 * 4


def test_only_state_in_a_local_folder_is_written_by_way_of_the_file_system(spark):
    key = "spark.sql.streaming.checkpointFileManagerClass"
    for base, used in (("/a/b", True), ("file:///a/b", True), ("hdfs://a/b", False)):
        with SC._local_files(spark, base):
            assert (spark.conf.get(key, None) or "").endswith("FileSystemBasedCheckpointFileManager") == used
        assert spark.conf.get(key, None) is None
    spark.conf.set(key, "given")
    with SC._local_files(spark, "/a/b"):
        assert spark.conf.get(key) == "given"
    assert spark.conf.get(key) == "given"
    spark.conf.unset(key)
