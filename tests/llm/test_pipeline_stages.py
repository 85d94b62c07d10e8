"""Stages of the pipeline against plain rules: unknown scripts, clashing columns, repeats, null ids, empty tables, targets out of reach."""

import itertools
import random

import numpy as np
import pytest
from test_corpus import Groups, prose, shingles

import corpus_pipeline
from pixeltide.llm import langid, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, spans string, known int, fit string, letters string, __terms string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7.0, "x", "y", 3, "f", "l", "t") for i, t, lang in rows], SCHEMA)


def test_unknown_languages_go_and_columns_stay(spark):
    rng = random.Random(3)
    word = {"aa": ["tion", "the", "ing", "and"], "bb": ["chen", "ung", "sch", "ei"]}
    text = lambda k, n: " ".join("".join(rng.choice(word[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text("aa" if i % 2 else "bb", 60), "aa" if i % 2 else "bb") for i in range(400)]
    russian, chinese = "Это обычный русский текст о погоде и природе " * 5, "这是一个关于天气的普通中文文本" * 8
    other = "zwykx qvjxz wwrkq xjqzv pqwzx " * 20
    rows += [(1000, russian, None), (1001, chinese, None), (1002, other, None), (1003, f"{text('aa', 30)} {text('bb', 30)}", None), (1004, text("aa", 3), None)]
    rows += [(1005, None, "aa"), (1006, "", "aa"), (1007, "12 !?", "aa"), (None, text("bb", 50), None), (1, rows[1][1], "bb"), (1008, f"{text('aa', 60)} привет", None)]
    docs = frame(spark, rows)
    out = corpus_pipeline.known_language(spark, docs, "").collect()
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in out)
    assert ids == sorted([-1, *range(400), 1, 1003, 1004, 1008])
    assert out[0].__fields__ == docs.columns and all((r.score, r.lang_pred, r.spans, r.known, r.fit, r.letters) == (7.0, "x", "y", 3, "f", "l") for r in out)
    assert {r.doc_id: r.lang for r in out}[1] == "aa" and {r.doc_id: r.lang for r in out}[2] == "bb"
    assert corpus_pipeline.known_language(spark, docs.filter("false"), "").collect() == []
    found = langid.identify(docs.filter("doc_id = 1000"), langid.learn(docs.filter("doc_id < 400"))).first()
    assert found.known == 0.0 and found.lang_pred in ("aa", "bb")


def test_one_of_each_group_repeat_and_null_id(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(12)]
    near = lambda t: " ".join([*t.split(" ")[:-1], "changed"])
    rows = [(10 + i, t, "en") for i, t in enumerate(texts)]
    rows += [(100, near(texts[0]), "en"), (5, near(texts[1]), "en"), (10, texts[0], "en"), (10, texts[0], "en"), (11, prose(rng, 30), "en")]
    rows += [(None, texts[2], "en"), (None, prose(rng, 40), "en"), (None, near(texts[3]), "de"), (200, None, "en"), (201, "", "en"), (None, "", "en"), (None, "", "en"), (None, None, "en")]
    rows += [rows[-7], (300, rows[-7][1], "fr")]
    docs = frame(spark, rows)
    out = corpus_pipeline.one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    node = lambda r: r[0] if r[0] is not None else ("~", r[1] or "")
    order = {n: k for k, n in enumerate(sorted({node(r) for r in rows}, key=lambda n: (isinstance(n, tuple), n)))}
    groups = Groups(order.values())
    for a, b in itertools.combinations(rows, 2):
        x, y = shingles(a[1]), shingles(b[1])
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            groups.join(order[node(a)], order[node(b)])
    want = sorted(str(n[1] if isinstance(n, tuple) else n) for n, k in order.items() if groups.root(k) == k)
    got = [r for r in out.collect()]
    assert sorted(str((r.text or "") if r.doc_id is None else r.doc_id) for r in got) == want
    assert corpus_pipeline.one_of_each(spark, docs.filter("false"), "").collect() == []


def test_all_stages_on_null_ids_repeats_and_empty_tables(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80) + (" write to a.b@corp.example" if i % 9 == 0 else ""), "en") for i in range(120)]
    rows += [(None, prose(rng, 80), "en"), (3, rows[3][1], "en"), (None, None, None), (500, "", None)]
    docs = frame(spark, rows)
    items = spark.createDataFrame([(0, " ".join(rows[7][1].split(" ")[:40])), (1, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 10 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    for name, table in (("documents", docs), ("benchmark", items), ("labels", labels)):
        table.write.parquet(str(tmp_path / "some" / f"{name}.parquet"))
        table.filter("false").write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted([*(str(i) for i in range(120) if i != 7), "None"])
    assert all("@" not in r.text and r.n_chars == len(r.text) and r.score == 7.0 and r.rate >= 0 for r in out)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_rates_follow_projected_least_squares(spark):
    """Rates recomputed in plain code, and the totals against many small steps of plain projected gradient."""
    rng = random.Random(11)
    members = [([a / (a + b + c), b / (a + b + c), c / (a + b + c)], rng.randrange(1, 400)) for a, b, c in ([rng.random() ** 3 for _ in range(3)] for _ in range(400))]
    df = spark.createDataFrame(members, "shares array<double>, n_tokens long")
    turned, reached, miss = mixing.fit_rates(df)
    total = sum(n for _, n in members)
    rates = [max(0.0, 1 - sum(s * x for s, x in zip(shares, turned, strict=True))) for shares, _ in members]
    assert [r.r for r in df.select(mixing._rate(turned).alias("r")).collect()] == pytest.approx(rates)
    goal = [mixing.TARGETS[d] * total for d in mixing.DOMAINS]
    for k, d in enumerate(mixing.DOMAINS):
        assert sum(r * n * s[k] for r, (s, n) in zip(rates, members, strict=True)) == pytest.approx(reached[d], rel=1e-9)
    off = [reached[d] - g for d, g in zip(mixing.DOMAINS, goal, strict=True)]
    assert miss == pytest.approx(max(abs(x) for x in off) / total)
    # Plain projected gradient over many small steps comes no nearer.
    a = np.array([[n * s[k] for s, n in members] for k in range(3)])
    rate, step = np.ones(len(members)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(100_000):
        rate = np.maximum(0, rate - step * (a.T @ (a @ rate - goal)))
    nearest = np.linalg.norm(a @ rate - goal) / total
    assert np.linalg.norm(off) / total <= nearest + 1e-6


def test_targets_out_of_reach_are_told(spark):
    """No document has a share of the third domain, so nothing can meet its target."""
    df = spark.createDataFrame([([1.0, 0.0, 0.0], 100), ([0.0, 1.0, 0.0], 50)], "shares array<double>, n_tokens long")
    _, reached, miss = mixing.fit_rates(df)
    assert miss == pytest.approx(0.01, abs=1e-4) and reached["toxic"] == 0
    assert reached["high"] == pytest.approx(135, abs=1e-2) and reached["low"] == pytest.approx(13.5, abs=1e-2)
    # Shares that always hold too much of one domain: the nearest totals, by plain steps.
    members = [([0.7, 0.3, 0.0], 100), ([0.2, 0.8, 0.0], 50)]
    _, reached, miss = mixing.fit_rates(spark.createDataFrame(members, "shares array<double>, n_tokens long"))
    a, goal = np.array([[n * s[k] for s, n in members] for k in range(3)]), np.array([135, 13.5, 1.5])
    rate = np.ones(2)
    for _ in range(100_000):
        rate = np.maximum(0, rate - a.T @ (a @ rate - goal) / np.linalg.norm(a, 2) ** 2)
    assert np.linalg.norm([reached[d] - g for d, g in zip(mixing.DOMAINS, goal, strict=True)]) <= 1.02 * np.linalg.norm(a @ rate - goal)
