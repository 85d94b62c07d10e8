"""Decontamination by joined seeds and beside a block agree with the plain rule; scripts without spaces; null and repeated items."""

import random

import pytest
from test_corpus import docs_frame, plain_tiles, prose

from pixeltide.llm import decontaminate


def plain_tokens(text):
    import pyarrow as pa

    return [w.tolist() for _, words, first in decontaminate.tokens(pa.array([text], pa.large_string())) for w in [words]][0]


@pytest.mark.parametrize("most", [decontaminate.BLOCK_CHARS, 0])
@pytest.mark.parametrize("filtered", [True, False])
def test_matches_of_all_pairs(spark, monkeypatch, most, filtered):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", most)
    if not filtered:
        monkeypatch.setattr(decontaminate, "FILTERED_SEEDS", 0)
    rng = random.Random(31)
    common = prose(rng, 8)
    items = [(k, f"{prose(rng, rng.choice([6, 12, 30]))} {common if k % 3 == 0 else ''} {prose(rng, 6)}") for k in range(14)]
    items += [(3, prose(rng, 20)), (None, prose(rng, 15)), (50, "one two three"), (51, None), (52, ""), (53, items[0][1])]
    items += [(60, "这是一个关于天气和自然的普通中文句子"), (61, "これは天気についての普通の文です")]
    texts = [prose(rng, 60) for _ in range(10)] + [common * 3, None, "", "one two three"]
    for _, t in items:
        w = (t or "").split()
        cut = rng.randrange(len(w) + 1)
        texts += [f"{prose(rng, 20)} {t} {prose(rng, 5)}", " ".join([*w[cut:], "zz", *w[:cut]]).upper(), " ".join(w[: len(w) // 2 - 2]), " ".join(w[::-1])]
    texts += ["前言，这是一个关于天气和自然的普通中文句子。后记", "天气和自然的普通中文句子「这是一个关于」", "完全不同的文字内容在这里没有关系"]
    rows = list(enumerate(texts)) + [(None, texts[20]), (20, texts[20])]
    docs = docs_frame(spark, rows)
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, id string, unit int")
    want = []
    held = sorted({(i, t) for i, t in items if t is not None}, key=str)
    for i, text in rows:
        doc = plain_tokens(text or "")
        for item, t in held:
            own = plain_tokens(t)
            n = plain_tiles(doc, own, 5) if len(own) >= 5 else 0
            if own and n >= 0.5 * len(own) and n:
                want.append((str(i), str(item), n, len(own)))
    got = sorted((str(r.doc_id), str(r.item_id), r.n_covered, r.n_tokens) for r in decontaminate.matches(docs, bench).collect())
    assert got == sorted(want) and len(got) > 30 and any(item == "60" for _, item, *_ in got)
    left = decontaminate.decontaminate(docs, bench)
    gone = {d for d, *_ in want}
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if str(i) not in gone)
    assert decontaminate.matches(docs.filter("false"), bench).collect() == [] and decontaminate.matches(docs, bench.filter("false")).collect() == []
