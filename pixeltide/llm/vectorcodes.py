"""Vectors as short codes: each part of a vector is replaced by the number of the nearest entry of that part's codebook.

Codebooks are fitted by k-means on whole numbers, with balls: an entry's radius and the distances between entries leave it a few
neighbours; a part closer to its own entry than half way to the nearest neighbour stays without a look, and any other is compared only
with the neighbours whose half way lies within its own distance. Both rules are exact, ties included, so the result is that of
comparing every part with every entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are held within this size, beyond which squared distances would not fit 64 bits.
LARGEST = 1 << 28
#: Rows that a task works on at once.
STEP_ROWS = 1 << 16


class Ball(NamedTuple):
    """One part's codebook, and for each entry its neighbours in the order of their distance (at most twice its radius)."""

    entries: np.ndarray
    neighbours: list[np.ndarray]
    apart: list[np.ndarray]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a to the rows of b, whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    size = max(int(np.abs(a).max()), int(np.abs(b).max()))
    # Doubles hold whole numbers up to 2**53.
    kind = np.float64 if 4 * size * size * a.shape[1] < 1 << 53 else np.int64
    x, y = a.astype(kind), b.astype(kind)
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
    return out.astype(np.int64)


def balls(entries: np.ndarray, radius: np.ndarray | None) -> Ball:
    """radius: at least the distance of any member of the entry, None if not known."""
    apart = squared(entries, entries)
    near, far = [], []
    for j in range(len(entries)):
        others = np.argsort(apart[j], kind="stable")
        others = others[others != j]
        if radius is not None:
            others = others[np.sqrt(apart[j][others].astype(np.float64)) <= 2.0 * radius[j] * (1 + 1e-9) + 1e-6]
        near.append(others)
        far.append(apart[j][others])
    return Ball(entries, near, far)


def assigned(x: np.ndarray, ball: Ball, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of x: the nearest entry, the lower number if several are. own: entries of the round before."""
    code, gap = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if own is None:
        for at in range(0, len(x), 8192):
            d = squared(x[at : at + 8192], ball.entries)
            code[at : at + 8192] = d.argmin(axis=1)
            gap[at : at + 8192] = d.min(axis=1)
        return code, gap
    away = x.astype(np.int64) - ball.entries[own]
    code[:], gap[:] = own, (away * away).sum(axis=1)
    order = np.argsort(own, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        if not len(rows):
            continue
        j = own[rows[0]]
        # A neighbour can be as near only if half way to it is within the own distance: so many of the first neighbours.
        reach = np.searchsorted(ball.apart[j], 4 * gap[rows], "right")
        ring = np.ceil(np.log2(np.maximum(reach, 1))).astype(int)
        for r in np.unique(ring[reach > 0]):
            mine = rows[(ring == r) & (reach > 0)]
            candidates = np.sort(ball.neighbours[j][: 1 << r])
            d = squared(x[mine], ball.entries[candidates])
            best = d.argmin(axis=1)
            entry, least = candidates[best], d[np.arange(len(mine)), best]
            better = (least < gap[mine]) | ((least == gap[mine]) & (entry < code[mine]))
            code[mine[better]], gap[mine[better]] = entry[better], least[better]
    return code, gap


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= STEP_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of equal length as rows."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32), pa.array(rows.ravel()))


def _coded(rows: DataFrame, cells: list[Ball], width: int, first: bool) -> DataFrame:
    """rows with the code and the squared distance of each part; codebooks are a few hundred entries, so every task gets them."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(shared.value)
        size = width // parts
        for table in _steps(batches):
            x = _matrix(table.column("vec"), width)
            before = None if first else _matrix(table.column("codes"), parts).astype(np.int64)
            found = [assigned(x[:, p * size : (p + 1) * size], ball, None if first else before[:, p]) for p, ball in enumerate(shared.value)]
            codes, gaps = np.stack([c for c, _ in found], axis=1).astype(np.int32), np.stack([g for _, g in found], axis=1)
            columns = [table.column("id"), table.column("label"), table.column("vec"), _lists(codes), _lists(gaps)]
            yield from pa.table(columns, names=["id", "label", "vec", "codes", "gaps"]).to_batches()

    return rows.mapInArrow(run, f"id {kind['id']}, label {kind['label']}, vec array<int>, codes array<int>, gaps array<bigint>")


def _totals(rows: DataFrame, width: int, parts: int, entries: int) -> dict[tuple[int, int], tuple[int, float, np.ndarray]]:
    """Members, largest squared distance and component sums of each used (part, entry); one row per task and entry is shuffled."""
    size = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for table in _steps(batches):
            x = _matrix(table.column("vec"), width).astype(np.int64)
            codes, gaps = _matrix(table.column("codes"), parts), _matrix(table.column("gaps"), parts)
            for p in range(parts):
                np.add.at(n[p], codes[:, p], 1)
                np.maximum.at(most[p], codes[:, p], gaps[:, p])
                np.add.at(sums[p], codes[:, p], x[:, p * size : (p + 1) * size])
        p, e = np.nonzero(n)
        if len(p):
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(most[p, e]), _lists(sums[p, e])]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "most", "sums"])

    each = rows.select("vec", "codes", "gaps").mapInArrow(run, "part int, entry int, n long, most long, sums array<bigint>")
    each = each.select("part", "entry", "n", "most", F.posexplode("sums").alias("place", "total"))
    found = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("total").alias("total")).collect()
    out: dict[tuple[int, int], tuple[int, float, np.ndarray]] = {}
    for r in found:
        out.setdefault((r.part, r.entry), (r.n, float(r.most), np.zeros(size, np.int64)))[2][r.place] = r.total
    return out


class Codes(NamedTuple):
    """rows: (id, label, codes, gaps), a code and a squared distance per part; codebooks: the entries of each part."""

    rows: DataFrame
    codebooks: list[np.ndarray]


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all vectors and the codebooks after ``rounds`` rounds.

    Components x become floor(scale * x), within +-LARGEST. Left out are rows whose vector is null or holds null or non-finite
    components, and those whose length is not the table's: the most frequent one that the parts divide, the smaller of equally frequent
    ones. Codebooks start as the parts of the ``entries`` smallest ids, nulls last, equal ids by their components; fewer rows give
    fewer entries. Each round gives every part its nearest entry (ties: the lower number), then every used entry the floor of its
    parts' mean. Repeated rows and null ids are rows like any other, other columns are not read, an empty table gives no rows and no entries.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    fine = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = source.filter(F.coalesce(fine & (F.size("vec") > 0) & (F.size("vec") % parts == 0), F.lit(False)))
    common = kept.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if common is None:
        none = kept.select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("array<bigint>").alias("gaps"))
        return Codes(none.filter("false"), [np.zeros((0, 0), np.int64)] * parts)
    width = common.width
    whole = F.transform("vec", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    kept = kept.filter(F.size("vec") == width).select("id", "label", whole.alias("vec"))
    seeds = np.array([r.vec for r in kept.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).select("vec").collect()], np.int64)
    size = width // parts
    books = [seeds[:, p * size : (p + 1) * size] for p in range(parts)]

    rows, radius = kept, None
    for turn in range(rounds):
        cells = [balls(b, None if radius is None else radius[p]) for p, b in enumerate(books)]
        rows = stored(_coded(rows, cells, width, turn == 0))
        found = _totals(rows, width, parts, len(seeds))
        radius, after = [np.zeros(len(seeds)) for _ in books], [b.copy() for b in books]
        for (p, e), (n, most, total) in found.items():
            after[p][e] = total // n
            moved = after[p][e] - books[p][e]
            radius[p][e] = np.sqrt(most) + np.sqrt(float((moved * moved).sum()))
        books = after
    cells = [balls(b, None if radius is None else radius[p]) for p, b in enumerate(books)]
    rows = stored(_coded(rows, cells, width, rounds == 0).select("id", "label", "codes", "gaps"))
    return Codes(rows, books)


def code_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors that are kept, see ``compressed``.

    Rows of a null label are one group. A label of any number of rows is summed by tasks before it meets its rows again.
    """
    found = compressed(vectors)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = found.rows.select("id", "label", code.alias("code"), F.aggregate("gaps", F.lit(0).cast("long"), lambda a, g: a + g).alias("error"))
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    books = hashlib.sha256(",".join(str(v) for book in found.codebooks for v in book.ravel().tolist()).encode()).hexdigest()
    both = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books).alias("codebooks_sha256"))
