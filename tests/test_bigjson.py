"""Documents cut anywhere give the elements that a parser gives for the whole."""

import json
import random

import numpy as np
import pytest
import trees

from pixeltide.operators import annotations as A
from pixeltide.sources import bigjson
from pixeltide.sources import files as S

SECTIONS = ("images", "annotations", "categories")


def odd_document(rng):
    """Texts with quotes, brackets and runs of backslashes, nested members, other members before, between and after."""
    word = lambda: "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", ":", "é", "\n", "a", "images", '"annotations":[']) for _ in range(rng.randrange(9)))
    element = lambda i: {"id": i, "file_name": word(), "k" + word(): [word(), {"x": [1, [word()]]}], "image_id": i, "bbox": [1, 2.5, 3, 4]}
    doc = {"info": {"images": [1, 2], "text": word()}, "images": [element(i) for i in range(rng.randrange(30))], word() + "q": [[1], [2]], "note": word()}
    doc |= {"annotations": [rng.choice([element(i), i, None, word(), [i, [word()]], True]) for i in range(40)], "categories": [], "last": {"annotations": [word()]}}
    return doc


@pytest.mark.parametrize("range_bytes", [7, 64, 1 << 20])
def test_elements_of_documents_in_any_layout(spark, tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(bigjson, "MORE_BYTES", 16)
    rng = random.Random(range_bytes)
    docs = [odd_document(rng) for _ in range(3)]
    for i, (doc, layout) in enumerate(zip(docs, [{}, {"indent": 3, "ensure_ascii": False}, {"separators": (" ,  ", "\n:\t")}], strict=True)):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, **layout))
    if range_bytes == 7:  # small ranges, smaller documents
        docs = [{k: v[:4] if isinstance(v, list) else v for k, v in d.items()} for d in docs[:1]]
        (tmp_path / "0.json").write_text(json.dumps(docs[0]))
    paths = [str(tmp_path / f"{i}.json") for i in range(len(docs))]
    found = bigjson.array_elements(spark, paths, SECTIONS, range_bytes)
    got = {}
    for r in sorted(found.elements.collect(), key=lambda r: r["place"]):
        got.setdefault((r["shard_order"], r["section"]), []).append(json.loads(r["text"]))
    assert got == {(i, s): d[s] for i, d in enumerate(docs) for s in SECTIONS if d[s]}
    assert all(r["readable"] and set(r["sections"]) == set(SECTIONS) for r in found.documents.collect())


def test_states_of_cut_texts():
    rng = random.Random(4)
    for _ in range(300):
        text = json.dumps([rng.choice(['a"b', "\\", "\\\\", '\\"', "[", ""]) for _ in range(6)]).encode()
        whole, end = bigjson.quoted(np.frombuffer(text, np.uint8), bigjson.OUTSIDE)
        assert end == bigjson.OUTSIDE
        cut = rng.randrange(len(text) + 1)
        left, state = bigjson.quoted(np.frombuffer(text[:cut], np.uint8), bigjson.OUTSIDE)
        right, end = bigjson.quoted(np.frombuffer(text[cut:], np.uint8), state)
        assert end == bigjson.OUTSIDE and np.array_equal(np.r_[left, right], whole)


def test_unreadable_documents_and_repeated_members(spark, tmp_path):
    texts = ['{"images":[{"id":1}],"images":[{"id":2},{"id":3}],"annotations":{"a":[1]}}', "[1]", '{"images":[{"id":1}', '{"images":["a]}', "", " \n{ }", '\ufeff{"images":[{"id":5}]}']
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(t)
    found = bigjson.array_elements(spark, [str(tmp_path / f"{i}.json") for i in range(len(texts))], SECTIONS, 16)
    assert [(r["readable"], r["sections"]) for r in sorted(found.documents.collect(), key=lambda r: r["shard_order"])] == [
        (True, ["images"]), (False, []), (False, []), (False, []), (False, []), (True, []), (True, ["images"]),
    ]
    assert sorted((r["shard_order"], r["text"]) for r in found.elements.collect()) == [(0, '{"id":2}'), (0, '{"id":3}'), (6, '{"id":5}')]


def test_one_document_takes_many_tasks_and_gives_the_rows_of_the_whole_reader(spark, tmp_path):
    images = [{"id": i, "file_name": f"f{i}.png", "width": 10, "height": 20} for i in range(3000)]
    anns = [{"id": 7 * i, "image_id": i % 3000, "category_id": i % 5, "bbox": [i, 0.5, float("nan") if i % 97 == 0 else 1, "2"], "label": 'a "b"'} for i in range(6000)] + [5, None]
    path = tmp_path / "a b.json"
    path.write_text(json.dumps(trees.coco(images=images, annotations=anns, categories=[{"id": 1, "name": "n"}, {"id": 2}]), indent=1))
    ranges = 20_000
    got = S.read_coco(spark, str(path), ranges)
    assert path.stat().st_size > 40 * ranges
    want = S.coco_tables(S.parse_coco(S.read_texts(spark, str(path))))
    for a, b in zip(got, want, strict=True):
        rows = lambda df: sorted(repr({k: v for k, v in r.asDict(True).items() if k != "shard_order"}) for r in df.collect())
        assert rows(a) == rows(b) and rows(a)
    merged = A.merge_shards(*got, strict=False)
    assert merged[1].count() == 6002
