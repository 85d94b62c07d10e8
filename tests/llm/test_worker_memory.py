"""What goes to Python workers: texts once and nothing else, hashed in short runs, each text judged once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixeltide.llm import common, decontaminate, langid, mixing


def docs(spark):
    rows = [(1, "the cat sat on the mat and the dog ran off", "a"), (2, None, "b"), (None, "", None), (1, "a third text stands here for the test of it", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, other string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["mixing", "language", "benchmarks"])
def test_rows_stay_with_the_engine(spark, kind):
    given = docs(spark)
    if kind == "mixing":
        zero = np.zeros(((1 << mixing.BUCKET_BITS) + mixing.SHAPES + 1, len(mixing.DOMAINS)))
        out = mixing.memberships(given, mixing.Classifier(zero), given.columns)
        assert sorted(r.n_tokens for r in out.collect()) == [0, 0, 10, 11]
        kept = out.filter((F.col("n_tokens") > 3) & (F.col("shares")[0] > 0.1))
    elif kind == "language":
        out = langid.identify(given, langid.learn(given.withColumn("lang", F.lit("en"))))
        assert sorted(r.lang_pred for r in out.collect()) == ["en", "en", "und", "und"]
        kept = out.filter((F.col("lang_pred") != "und") & (F.col("score") > 0.5))
    else:
        items = spark.createDataFrame([(7, "the cat sat on the mat and the dog")], "item_id long, text string")
        out = kept = decontaminate.decontaminate(given, items)
        assert len(out.collect()) == 3
    assert out.columns[:3] == given.columns
    told = plan(kept)
    assert "MapInArrow" not in told and told.count("ArrowEvalPython") == 1
    assert len(kept.collect()) == (3 if kind == "benchmarks" else 2)


def test_features_need_little_memory():
    rng = random.Random(3)
    column = pa.array([" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(1000)])
    list(mixing._features(column))
    tracemalloc.start()
    for _ in mixing._features(column):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 22 * common.STEP_BYTES


def test_hashes_do_not_depend_on_runs(monkeypatch):
    data = np.frombuffer(b" ".join(b"word%d" % (k % 50) for k in range(400)) + b" " + b"x" * 3000 + b" word7", np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    whole = common.word_hashes(data, starts, ends)
    monkeypatch.setattr(common, "HASH_BYTES", 64)
    assert (common.word_hashes(data, starts, ends) == whole).all() and len(set(whole.tolist())) == 51
