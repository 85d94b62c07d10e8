"""Elements that cross the end of their range, and how often elements are parsed."""

from pixeltide.sources import bigjson
from pixeltide.sources import files as S


def test_an_element_is_read_on_only_as_far_as_it_goes(tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    items = [f'{{"id":{i},"file_name":"f{i:09d}.png"}}' for i in range(20_000)]
    items[30] = '{"id":30,"file_name":"' + "x" * 50_000 + '"}'
    path.write_text('{"images":[' + ",".join(items) + "]}")
    whole, read, got = path.read_bytes(), [], bigjson._read

    def counted(*a):
        read.append(len(data := got(*a)))
        return data

    monkeypatch.setattr(bigjson, "_read", counted)
    short = [t for kind, _, t in bigjson.elements_of(str(path), 0, whole[:1000], bigjson.OUTSIDE, 0) if kind == "element"]
    assert short == items[: len(short)] and len(short) > 20 and sum(read) < 4096
    read.clear()
    long = [t for kind, _, t in bigjson.elements_of(str(path), 0, whole[:2000], bigjson.OUTSIDE, 0) if kind == "element"]
    assert long == items[:31] and 50_000 < sum(read) < 150_000


def test_rules_on_a_document_do_not_parse_it_again(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"images":[{"id":1,"file_name":"a"},5],"annotations":[{"id":2,"image_id":1,"bbox":[1,NaN,"x",4]}],"categories":[{"id":3,"name":"n"}]}')
    images, anns, cats = S.read_coco(spark, str(tmp_path / "a.json"))
    for df in (images, anns, cats):
        assert df._jdf.queryExecution().optimizedPlan().toString().startswith("Relation")
    assert sorted((r["pos"], r["is_object"], r["image_id"]) for r in images.collect()) == [(0, True, 1), (1, False, None)]
    bbox = anns.first()["bbox"]
    assert bbox[0] == 1 and bbox[1] != bbox[1] and bbox[2] is None and bbox[3] == 4
    assert [tuple(r) for r in cats.select("category_id", "name").collect()] == [(3, "n")]
