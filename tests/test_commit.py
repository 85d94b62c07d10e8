"""What a write of many files sends to the driver and what its commit holds."""

import pickle

import pyarrow as pa

from pixeltide.sinks import filesource


def test_a_commit_is_told_no_list_of_files(tmp_path, monkeypatch):
    monkeypatch.setattr(filesource, "MOVES", 7, raising=False)
    names = [f"a/file_with_a_rather_long_name_{i:06d}.txt" for i in range(500)] + ["b/two\nlines.txt", "b/grün  .txt", "top.txt"]
    writer = filesource.TextWriter({"base": str(tmp_path / "out"), "job": "j"})
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(part), pa.array([f"<{n}>" for n in part])], names=["path", "text"])
    messages = [writer.write(iter([batch(names[k::2])])) for k in range(2)] + [writer.write(iter([])), None]
    sent = [pickle.dumps(m) for m in messages]
    assert max(map(len, sent)) < 1000
    assert not [p for p in (tmp_path / "out").rglob("*.txt") if "_staging" not in str(p)]
    writer.commit([pickle.loads(m) for m in sent])
    made = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert made == {n: f"<{n}>" for n in names}
    writer.abort(messages)
    assert not list((tmp_path / "out").glob("_staging*"))
