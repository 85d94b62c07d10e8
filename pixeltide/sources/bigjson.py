"""Elements of the array members of JSON documents of any size and layout, read by byte ranges.

A range of a document says little by itself: it may begin inside a text, after a backslash, at any depth. So each range is
first read for all three ways it may begin; what it adds to depth and where it ends are put together in order (one row per
range); and ranges whose beginning is then known give out the elements that begin in them. An element that crosses the end
of its range is read on by the task it begins in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.session import cut, spread
from pixeltide.sinks.storage import locate

#: Bytes of a range, and the most ranges of a document: larger documents have larger ranges.
RANGE_BYTES, MOST_RANGES = 8 << 20, 100_000
#: Bytes before an array within which its key must stand, and bytes by which an element is read on, at first and at most.
KEY_BYTES, FIRST_BYTES, MORE_BYTES = 1 << 16, 1 << 10, 1 << 20
#: How a range may begin: outside of texts, in one, in one after a backslash that escapes what follows.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2

_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def quoted(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Which bytes belong to texts (their quotes included), and how the bytes end."""
    n = len(data)
    if not n:
        return np.zeros(0, bool), state
    marks = np.flatnonzero(data == ord('"'))
    solid = np.flatnonzero(data != ord("\\"))

    def escaped(at: np.ndarray) -> np.ndarray:
        """Whether an odd number of backslashes stands right before each place."""
        before = np.searchsorted(solid, at, "left") - 1
        last = np.where(before >= 0, solid[np.maximum(before, 0)] if len(solid) else -1, -1)
        run = at - 1 - last
        return (run % 2 == 1) ^ ((last < 0) & (state == ESCAPED))

    real = marks[~escaped(marks)] if len(marks) else marks
    turn = np.zeros(n, bool)
    turn[real] = True
    inside = (np.cumsum(turn, dtype=np.int32) % 2 == 1) ^ (state != OUTSIDE)
    end = OUTSIDE if not inside[-1] else ESCAPED if escaped(np.array([n]))[0] else INSIDE
    return inside | turn, end


def depths(data: np.ndarray, state: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Bytes outside of texts, the depth after each byte, and how the bytes end."""
    inside, end = quoted(data, state)
    after = np.cumsum(np.where(inside, 0, _STEP[data]), dtype=np.int32) + np.int32(depth)
    return ~inside, after, end, int(after[-1]) if len(after) else depth


def _read(path: str, begin: int, n: int) -> bytes:
    system, p = locate(path)
    with system.open_input_file(p) as f:
        return f.read_at(n, begin)


def _ends(path: str, begin: int, data: bytes) -> str:
    """The element that follows a separator; ``data`` are the bytes after it, from ``begin``, and hold no end of it yet."""
    parts = [data]
    at, state, depth = begin + len(data), *_after(data)
    # Most elements end soon: what is read on grows with what has been read.
    step = FIRST_BYTES
    while True:
        more = _read(path, at, step)
        step = min(2 * step, MORE_BYTES)
        if not more:
            return b"".join(parts).decode("utf-8", "replace")
        array = np.frombuffer(more, np.uint8)
        free, after, state, end_depth = depths(array, state, depth)
        stop = np.flatnonzero(free & ((after < 2) | ((array == ord(",")) & (after == 2))))
        if len(stop):
            return b"".join([*parts, more[: stop[0]]]).decode("utf-8", "replace")
        parts.append(more)
        at, depth = at + len(more), end_depth


def _after(data: bytes) -> tuple[int, int]:
    _, _, state, depth = depths(np.frombuffer(data, np.uint8), OUTSIDE, 2)
    return state, depth


def elements_of(path: str, begin: int, data: bytes, state: int, depth: int) -> Iterator[tuple[str, int, str | None]]:
    """('[' or '{', place, key) for each value that opens at depth 1 in the range, ('end', place, None) where one closes, and
    ('element', place, text) for what begins there between the separators of an array at depth 1."""
    array = np.frombuffer(data, np.uint8)
    free, after, _, _ = depths(array, state, depth)
    opens = free & (_STEP[array] == 1) & (after == 2)
    closes = free & (_STEP[array] == -1) & (after == 1)
    commas = free & (array == ord(",")) & (after == 2)
    cuts = np.flatnonzero(opens | closes | commas)
    for n, at in enumerate(cuts.tolist()):
        if closes[at]:
            yield "end", begin + at, None
            continue
        if opens[at]:
            # The key may stand in the range before.
            low = max(0, begin + at - KEY_BYTES)
            found = re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', _read(path, low, begin + at - low))
            yield chr(array[at]), begin + at, found[1].decode("utf-8", "replace") if found else None
        if n + 1 < len(cuts):
            text = data[at + 1 : cuts[n + 1]].decode("utf-8", "replace")
        else:
            text = _ends(path, begin + at + 1, data[at + 1 :])
        # Nothing between the brackets is no element; nothing between commas is one that cannot be read.
        if text.strip(" \t\r\n") or commas[at]:
            yield "element", begin + at, text


class Documents(NamedTuple):
    """documents: (shard_order, path, readable, sections), sections being the arrays that are there. elements: (shard_order,
    section, place, text) in the order of place."""

    documents: DataFrame
    elements: DataFrame


def array_elements(spark: SparkSession, paths: Sequence[str], sections: Sequence[str], range_bytes: int = RANGE_BYTES) -> Documents:
    """Texts of the elements of the named array members of each document's root object.

    The last of several members of one name counts. A document whose root is no object, or whose brackets and quotes do not close, is
    not readable and has no elements; what is wrong inside an element is the element's own matter. shard_order is the place of the path
    in ``paths``. A task holds one range at a time; an element must fit into memory, a document need not.
    """
    rows = []
    for order, path in enumerate(paths):
        system, p = locate(path)
        size = system.get_file_info(p).size or 0
        step = max(range_bytes, -(-size // MOST_RANGES))
        rows += [(order, path, at, min(step, size - at)) for at in range(0, size, step)]
    ranges = spark.createDataFrame(rows, "shard_order int, path string, begin bigint, size bigint")
    # Small ranges share a task, which holds one at a time: tasks follow the bytes, and what they report to the driver with them.
    tasks = max(1, min(len(rows), max(spread(spark), sum(r[3] for r in rows) // RANGE_BYTES)))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = np.frombuffer(_read(r["path"], r["begin"], r["size"]), np.uint8)
                told = [depths(data, state, 0)[2:] for state in (OUTSIDE, INSIDE, ESCAPED)]
                lead = data[:4096].tobytes().removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n")[:1] if r["begin"] == 0 else b""
                out.append(r | {"ends": [t[0] for t in told], "adds": [t[1] for t in told], "object": lead == b"{"})
            if out:
                yield pa.RecordBatch.from_pylist(out, shape)

    shape = pa.schema([("shard_order", pa.int32()), ("path", pa.string()), ("begin", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int32())), ("adds", pa.list_(pa.int32())), ("object", pa.bool_())])
    kind = "shard_order int, path string, begin bigint, size bigint, ends array<int>, adds array<int>, object boolean"
    # One small row per range, MOST_RANGES at most for a document.
    told = ranges.repartition(tasks, "shard_order", "begin").mapInArrow(survey, kind).collect()
    known, readable, state, depth = [], {}, OUTSIDE, 0
    for r in sorted(told, key=lambda r: (r.shard_order, r.begin)):
        if r.begin == 0:
            state, depth, readable[r.shard_order] = OUTSIDE, 0, False
            is_object = r.object
        known.append((r.shard_order, r.path, r.begin, r.size, state, depth))
        state, depth = r.ends[state], depth + r.adds[state]
        readable[r.shard_order] = is_object and state == OUTSIDE and depth == 0
    known = [r for r in known if readable[r[0]]]
    placed = spark.createDataFrame(known, "shard_order int, path string, begin bigint, size bigint, state int, depth int")

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = list(elements_of(r["path"], r["begin"], _read(r["path"], r["begin"], r["size"]), r["state"], r["depth"]))
                columns = [pa.array([r["shard_order"]] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([f[2] for f in found], pa.string())], names=["shard_order", "kind", "place", "text"])

    events = cut(placed.repartition(tasks, "shard_order", "begin").mapInArrow(give, "shard_order int, kind string, place bigint, text string"))
    # Members of the root are few: those named here, the last of each name, with the end that follows.
    named = events.filter(F.col("kind").isin("[", "{") & F.col("text").isin(*sections)).groupBy("shard_order", F.col("text").alias("section"))
    named = named.agg(F.max(F.struct("place", "kind")).alias("m")).select("shard_order", "section", F.col("m.place").alias("first"), F.col("m.kind").alias("opens"))
    ends = events.filter("kind = 'end'").select("shard_order", F.col("place").alias("end"))
    spans = named.filter("opens = '['").join(ends, "shard_order").filter("end > first").groupBy("shard_order", "section", "first").agg(F.min("end").alias("end"))
    inside = (F.col("place") >= F.col("first")) & (F.col("place") < F.col("end"))
    # One row per document and section.
    spans = cut(spans)
    there: dict[int, list[str]] = {}
    for r in spans.select("shard_order", "section").collect():
        there.setdefault(r.shard_order, []).append(r.section)
    documents = [(i, p, readable.get(i, False), sorted(there.get(i, []))) for i, p in enumerate(paths)]
    documents = spark.createDataFrame(documents, "shard_order int, path string, readable boolean, sections array<string>")
    elements = events.filter("kind = 'element'").join(F.broadcast(spans), "shard_order").filter(inside)
    return Documents(documents, elements.select("shard_order", "section", "place", "text"))
