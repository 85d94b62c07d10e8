"""Vectors that are shown to many cells are read where they lie, not sent to each of them."""

import numpy as np

from pixeltide.llm import cells


def test_vectors_without_structure_are_shuffled_a_few_times_only(spark, monkeypatch):
    monkeypatch.setattr(cells, "PER_CELL", 40)
    monkeypatch.setattr(cells, "BLOCK", 64)
    rng = np.random.default_rng(5)
    many = rng.normal(size=(1200, 64))
    many[600:1000] = many[:400] + rng.normal(scale=0.16, size=(400, 64))  # about half of these link
    many[1100:] = many[0] + rng.normal(scale=0.05, size=(100, 64))  # a group larger than a block
    many = many.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(many)], "vec_id long, embedding array<float>")
    status = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return status.executorSummary("driver").totalShuffleWrite()

    before = written()
    spark.conf.set("spark.sql.shuffle.partitions", "48")  # copies in one partition would be packed to one
    got = {r.vec_id: r for r in cells.near_vectors(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert written() - before < 8 * many.nbytes
    unit = many.astype(np.float64) / np.linalg.norm(many.astype(np.float64), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    assert [got[i].n_links for i in range(len(many))] == links.sum(axis=1).tolist()
    least = np.arange(len(many))
    while True:
        new = np.minimum(least, np.where(links, least[None, :], len(many)).min(axis=1))
        if (new == least).all():
            break
        least = new
    assert [got[i].component_id for i in range(len(many))] == least.tolist()
    assert 100 < (links.sum(axis=1) > 0).sum() < 1100
