"""Exact repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A string of ``length`` bytes is repeated if it starts at two places of the corpus. One transform of a whole corpus fits no
task, so the strings are dealt out first, without loss: every string is filed under the smallest hashed gram inside it (its
anchor), which equal strings share. The strings of one anchor form a short stretch of text; equal stretches become one with
a weight. All stretches filed under one gram are then one collection whose transform is small, and the breadth-first
backward extension finds which of their strings are shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import STEP_BYTES, mix64, prefix_hash, random_words, span_hash, steps, stored, text_buffer

GRAM = 64
#: Bytes of stretches in one transform.
TRANSFORM_BYTES = 1 << 20
#: Stretches under one gram beyond which they are cut into stretches of PIECE strings, dealt by the bytes these share.
CROWD = 2048
PIECE = 16

_SECOND = random_words(256, 31)
_ANCHOR_SALT = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- one collection, in numpy


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse; the symbols end with one that stands nowhere else."""
    n = len(symbols)
    codes = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = codes.max() + 1
    take = 1
    key = codes.copy()
    while take < min(8, n) and key.max() < (1 << 62) // width:
        shifted = np.zeros(n, np.int64)
        shifted[: n - take] = codes[take:]
        key = key * width + shifted
        take += 1
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    slots = np.arange(n)
    head = np.r_[True, ranked[1:] != ranked[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    while True:
        alone = head & np.r_[head[1:], True]
        if alone.all():
            return order, rank
        open_slots = np.flatnonzero(~alone)
        sub = order[open_slots]
        follow = np.where(sub + take < n, rank[np.minimum(sub + take, n - 1)] + 1, 0)
        key = rank[sub] * (n + 1) + follow
        o = np.argsort(key, kind="stable")
        sub, key = sub[o], key[o]
        order[open_slots] = sub
        fresh = np.r_[True, key[1:] != key[:-1]]
        head[open_slots] = fresh
        rank[sub] = np.maximum.accumulate(np.where(fresh, open_slots, 0))
        take *= 2


def shared_runs(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and, per slot, the number of the run of suffixes that agree in their first ``length`` symbols.

    Breadth-first over the intervals of the transform: a frontier holds the intervals of strings of one size, each is
    extended backward by every symbol before it (the LF step), and the place after an extension's end that no
    smaller size has closed is closed now, with the size as its common prefix. Only such extensions go on. Stops at
    ``length``; places still open have common prefixes of at least that.
    """
    order, rank = suffix_order(symbols)
    n = len(order)
    step = rank[order - 1]
    front = symbols[order]
    closed = np.zeros(n + 1, bool)
    closed[[0, n]] = True
    lo, hi = np.array([0]), np.array([n - 1])
    for _ in range(length):
        if not len(lo):
            break
        sizes = hi - lo + 1
        owner = np.repeat(np.arange(len(lo)), sizes)
        inside = np.arange(len(owner)) + np.repeat(lo - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        place = step[inside]
        o = np.argsort(place)
        place, owner = place[o], owner[o]
        symbol = front[place]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]))
        first, last = place[np.r_[0, cut + 1]], place[np.r_[cut, len(place) - 1]]
        fresh = ~closed[last + 1]
        closed[last + 1] = True
        lo, hi = first[fresh], last[fresh]
    return order, np.cumsum(closed[:n]) - 1


def repeated_starts(stretches: list[np.ndarray], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """Per stretch: for each start of a string of ``length`` bytes, whether the collection holds it twice or more."""
    m = len(stretches)
    sizes = np.array([len(s) for s in stretches])
    total = int(sizes.sum()) + m
    symbols = np.empty(total, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    symbols[np.delete(np.arange(total), ends)] = np.concatenate(stretches).astype(np.int64) + m
    symbols[ends] = np.arange(m)
    order, run = shared_runs(symbols, length)
    text = np.searchsorted(ends, order)
    full = order + length <= ends[text]
    weight = np.bincount(run[full], weights[text[full]], minlength=run[-1] + 1)
    often = np.zeros(total, bool)
    often[order] = full & (weight[run] >= 2)
    begins = ends - sizes
    return [often[begins[i] : begins[i] + sizes[i] - length + 1] for i in range(m)]


# ---------------------------------------------------------------- dealing strings out


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys."""
    n = len(keys)
    if n < width:
        return keys[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(first text, end text, ...) runs as (i, begin, end) byte ranges: short texts together, a long one in overlapping parts."""
    for i, j in steps(offsets):
        begin, end = int(offsets[i]), int(offsets[j])
        if j - i > 1 or end - begin <= 2 * STEP_BYTES:
            yield i, begin, end
        else:
            for at in range(begin, max(end - length + 1, begin + 1), STEP_BYTES):
                yield i, at, min(at + STEP_BYTES + length - 1, end)


def stretches_of(data: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Stretches of the texts data[bounds[k]:bounds[k + 1]]: text, start, strings, anchor offset, gram hash, two content hashes."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(bounds)
    n_strings = np.maximum(sizes - length + 1, 0)
    if not n_strings.sum():
        return {"text": none, "start": none, "strings": none, "anchor": none, "gram": none, "hash_a": none, "hash_b": none}
    prefix, second = prefix_hash(data), prefix_hash(data, _SECOND)
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hash(prefix, at, at + GRAM)
    # Smallest hash first, of equal ones the rightmost: decided by the string's own bytes alone.
    top = mix64(grams ^ _ANCHOR_SALT) & np.uint64(0xFFFFFFFF00000000)
    least = sliding_least(top | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64)), length - GRAM + 1)
    anchor = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), n_strings)
    start = np.arange(len(text)) + np.repeat(bounds[:-1] - np.r_[0, np.cumsum(n_strings)[:-1]], n_strings)
    own = anchor[start]
    cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[cut, len(start)])
    begin, own, text = start[cut], own[cut], text[cut]
    end = begin + count - 1 + length
    return {
        "text": text,
        "start": begin,
        "strings": count,
        "anchor": own - begin,
        "gram": grams[own].view(np.int64),
        "hash_a": span_hash(prefix, begin, end).view(np.int64),
        "hash_b": span_hash(second, begin, end).view(np.int64),
    }


_PLACE_NAMES = ["id", "text_hash", "start", "strings", "anchor"]
_PLACE = "id long, text_hash long, start long, strings int, anchor int"
_FOUND = "id long, text_hash long, begin long, end long"


def _all_stretches(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, begin, end in _pieces(offsets, length):
                inner = offsets[(offsets > begin) & (offsets < end)]
                bounds = np.r_[begin, inner, end] - begin
                # Empty texts share an offset and have no string; count them to find each text's row.
                row = np.searchsorted(offsets, np.r_[begin, inner], "right") - 1
                s = stretches_of(data[begin:end], bounds if len(inner) else np.array([0, end - begin]), length)
                rows = pa.array(row[s["text"]] if len(s["text"]) else s["text"])
                inside = s["start"] + begin - offsets[row][s["text"]] if len(s["text"]) else s["start"]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(inside, pa.int64()),
                        pa.array(s["strings"], pa.int32()),
                        pa.array(s["anchor"], pa.int32()),
                        *[pa.array(s[k], pa.int64()) for k in ("gram", "hash_a", "hash_b")],
                    ],
                    names=["id", "text_hash", "start", "strings", "anchor", "gram", "hash_a", "hash_b"],
                )

    return docs.mapInArrow(run, f"{_PLACE}, gram long, hash_a long, hash_b long")


def _cut_bytes(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Adds the bytes of each wanted stretch; one row of places per text, so a text is read once."""
    item = F.struct("start", "strings", "anchor", "gram", "weight")
    per_text = wanted.groupBy("id", "text_hash").agg(F.collect_list(item).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(3)
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                flat = places[i].values
                starts, strings = flat.field("start").to_numpy(), flat.field("strings").to_numpy()
                same = pa.array(np.full(len(starts), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(same),
                        batch.column(1).take(same),
                        *[flat.field(k) for k in ("start", "strings", "anchor", "gram", "weight")],
                        pa.array([text[a : a + n - 1 + length] for a, n in zip(starts, strings, strict=True)], pa.binary()),
                    ],
                    names=["id", "text_hash", "start", "strings", "anchor", "gram", "weight", "bytes"],
                )

    joined = docs.join(per_text, ["id", "text_hash"]).select("id", "text_hash", "text", "places")
    return joined.mapInArrow(run, f"{_PLACE}, gram long, weight long, bytes binary")


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _found_in_groups(rows: DataFrame, length: int) -> DataFrame:
    """Repeated byte ranges of stretches of weight 1, by one transform for some whole groups at a time."""

    def flush(held: list[dict]) -> pa.RecordBatch:
        found: list[tuple[int, int, int, int]] = []
        weights = np.array([r["weight"] for r in held], np.float64)
        flags = repeated_starts([np.frombuffer(r["bytes"], np.uint8) for r in held], weights, length)
        for r, often in zip(held, flags, strict=True):
            if r["weight"] == 1:
                for a, b in zip(*_runs_of(often), strict=True):
                    found.append((r["id"], r["text_hash"], r["start"] + int(a), r["start"] + int(b) - 1 + length))
        columns = zip(*found, strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["id", "text_hash", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, gram = 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["gram"] != gram and size >= TRANSFORM_BYTES:
                    yield flush(held)
                    held, size = [], 0
                gram = r["gram"]
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield flush(held)

    kept = rows.select("id", "text_hash", "start", "gram", "weight", "bytes")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(tasks, "gram").sortWithinPartitions("gram").mapInArrow(run, _FOUND)


def _cut_small(rows: DataFrame, length: int, piece: int) -> DataFrame:
    """Stretches cut at fixed distances from their anchor; filed anew under the bytes that all strings of a piece share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                data = np.frombuffer(r["bytes"], np.uint8)
                prefix, second = prefix_hash(data), prefix_hash(data, _SECOND)
                # Distance of a string's start from the leftmost start that its anchor allows.
                shift = length - GRAM - r["anchor"]
                cuts = np.arange(shift // piece, (shift + r["strings"] - 1) // piece + 1)
                begin = np.maximum(cuts * piece - shift, 0)
                stop = np.minimum((cuts + 1) * piece - shift, r["strings"])
                core_lo, core_hi = (cuts + 1) * piece - 1 - shift, cuts * piece - shift + length
                core_lo, core_hi = np.clip(core_lo, 0, len(data)), np.clip(core_hi, 0, len(data))
                core = mix64(span_hash(prefix, core_lo, core_hi) + cuts.astype(np.uint64)) ^ np.uint64(r["gram"] & (1 << 64) - 1)
                a, b = span_hash(prefix, begin, stop - 1 + length), span_hash(second, begin, stop - 1 + length)
                for k in range(len(cuts)):
                    s, e = int(begin[k]), int(stop[k])
                    out.append(
                        (r["id"], r["text_hash"], r["start"] + s, e - s, r["anchor"] - s, core[k].view(np.int64), a[k].view(np.int64), b[k].view(np.int64),
                         r["weight"], r["bytes"][s : e - 1 + length])
                    )
            names = ["id", "text_hash", "start", "strings", "anchor", "gram", "hash_a", "hash_b", "weight", "bytes"]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, f"{_PLACE}, gram long, hash_a long, hash_b long, weight long, bytes binary")


def _ranges(rows: DataFrame, length: int) -> DataFrame:
    return rows.select("id", "text_hash", F.col("start").alias("begin"), (F.col("start") + F.col("strings") - 1 + length).alias("end"))


def repeated_ranges(docs: DataFrame, length: int = 400) -> DataFrame:
    """(id, text_hash, begin, end): byte ranges covered by repeated strings, overlapping as they come.

    docs: (id, text_hash, text), one row per text to judge; equal rows are separate texts.
    """
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    everything = stored(_all_stretches(docs, length))
    # Stored, so that the join reads two plain exchanges, of which adaptive execution splits the partition of a very common gram.
    shared = stored(everything.groupBy("gram").count().filter("count > 1").select("gram"))
    shared = stored(everything.join(shared, "gram", "left_semi"))
    place = F.struct(*_PLACE_NAMES)
    classes = stored(shared.groupBy("gram", "hash_a", "hash_b").agg(F.count("*").alias("weight"), F.min(place).alias("place")))
    content = ["gram", "hash_a", "hash_b"]
    copies = _ranges(shared.join(classes.filter("weight > 1").select(*content), content, "left_semi"), length)

    # A gram with a single content is settled: its strings are repeated exactly if its weight says so.
    several = classes.groupBy("gram").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    open_classes = classes.join(several, "gram").select("gram", "weight", "crowd", "place.*")
    crowds = several.select("gram", (F.col("crowd") > CROWD).alias("crowded"))
    bytes_of = stored(_cut_bytes(open_classes, docs, length).join(crowds, "gram"))
    found = _found_in_groups(bytes_of.filter("not crowded"), length)

    pieces = stored(_cut_small(bytes_of.filter("crowded").drop("crowded"), length, PIECE))
    small = pieces.groupBy(*content).agg(F.sum("weight").alias("weight"), F.min(F.struct(*_PLACE_NAMES, "bytes")).alias("place"))
    small = stored(small)
    alike = pieces.filter("weight = 1").join(small.filter("weight > 1").select(*content), content, "left_semi")
    several = small.groupBy("gram").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    still = small.join(several, "gram").select("gram", "weight", "crowd", "place.*")
    inside = _found_in_groups(still.filter(F.col("crowd") <= CROWD), length)
    # What still crowds shares all but PIECE - 1 bytes: cut to single strings, whose content hashes settle them.
    single = _cut_small(still.filter(F.col("crowd") > CROWD).drop("crowd"), length, 1)
    often = single.groupBy("hash_a", "hash_b").agg(F.sum("weight").alias("w")).filter("w > 1").select("hash_a", "hash_b")
    last = single.filter("weight = 1").join(often, ["hash_a", "hash_b"], "left_semi")
    parts = [copies, found, _ranges(alike, length), inside, _ranges(last, length)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p.select(*out.columns))
    return out


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Per row: id_col, kept_bytes (what is left), n_bytes, n_removed, n_spans.

    Texts are UTF-8 bytes, matches never cross texts, and every byte covered by a repeated string of ``length`` bytes goes;
    strings are judged on the input. Null and short texts lose nothing, a null counts as empty. Rows with a null or repeated
    id are texts of their own, so repeated rows remove each other. Other columns are not read.
    """
    unknown = F.lit(-(1 << 63)).cast("long")
    source = docs.select(
        F.col(id_col).cast("long").alias("real_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumns({"id": F.coalesce("real_id", unknown), "text_hash": F.xxhash64("text")})
    source = source.select("id", "text_hash", "text", "real_id")
    ranges = repeated_ranges(source.select("id", "text_hash", "text"), length)
    per_text = ranges.groupBy("id", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    joined = source.join(per_text, ["id", "text_hash"], "left").select("real_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, sizes, removed, spans = [], [], [], []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                cell = batch.column(2)[i]
                keep, gone, count = [raw], 0, 0
                if cell.is_valid:
                    begin, end = cell.values.field("begin").to_numpy(), cell.values.field("end").to_numpy()
                    o = np.argsort(begin, kind="stable")
                    begin, end = begin[o], np.maximum.accumulate(end[o])
                    cut = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
                    lo, hi = begin[cut], end[np.r_[cut[1:] - 1, len(end) - 1]]
                    gone, count = int((hi - lo).sum()), len(lo)
                    keep = [raw[a:b] for a, b in zip(np.r_[0, hi], np.r_[lo, len(raw)], strict=True)]
                left.append(b"".join(keep))
                sizes.append(len(raw))
                removed.append(gone)
                spans.append(count)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(left, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)]],
                names=["id", "kept_bytes", "n_bytes", "n_removed", "n_spans"],
            )

    out = joined.mapInArrow(run, "id long, kept_bytes binary, n_bytes long, n_removed long, n_spans long")
    return out.withColumnRenamed("id", id_col)
