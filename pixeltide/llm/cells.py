"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one vector of each group kept."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixeltide.llm.common import components, released, stored, two_hashes
from pixeltide.session import spread
from pixeltide.sinks.storage import locate

#: Vectors that the cell centres are fitted on (a documented bound; every vector is then assigned).
FIT_VECTORS = 16384
#: Vectors per cell aimed at (as large as one comparison of blocks takes), and the most cells.
PER_CELL, MOST_CELLS = 4096, 4096
ROUNDS = 8
BLOCK = 4096
#: The most tasks that pairs of blocks are dealt to.
MOST_TASKS = 10_000
#: Rows of a block that are multiplied at once.
STRIP = 512


def fit_cells(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of k cells; sample holds unit rows, the first k of which are the seeds."""
    centres = sample[:k].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        good = norm > 1e-12
        centres[good] = sums[good] / norm[good, None]
    return centres


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _packed(vectors: DataFrame, kind: str) -> DataFrame:
    """(id, h1, h2, vec) to (id, h1, h2, dim, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            data = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], kind)
            ends = (offsets - offsets[0]) * data.itemsize
            raw = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets), pa.int32()), raw], names=["id", "h1", "h2", "dim", "raw"])

    return vectors.mapInArrow(run, "id long, h1 long, h2 long, dim int, raw binary")


def _centres_of(shared: Broadcast, dim: int) -> np.ndarray:
    return shared.value.get(dim, np.zeros((1, dim)))


def _placed(packed: DataFrame, shared: Broadcast, kind: str, blocks: dict[tuple[int, int], int]) -> DataFrame:
    """Adds the cell whose centre is nearest, and the block of the cell (``blocks`` of them, one if it is not named) by h2."""
    names = packed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(names.index("dim")).to_numpy()
            raw, h2 = batch.column(names.index("raw")), batch.column(names.index("h2")).to_numpy()
            cell, block = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32)
            for dim in np.unique(dims).tolist():
                c = _centres_of(shared, dim)
                own = np.flatnonzero(dims == dim)
                for rows in np.array_split(own, max(1, len(own) * len(c) // 1_000_000)) if len(c) > 1 else []:
                    cell[rows] = (unit_rows(raw.take(pa.array(rows)).to_pylist(), kind) @ c.T).argmax(axis=1)
                block[own] = h2[own] % np.array([blocks.get((dim, k), 1) for k in range(len(c))], np.int64)[cell[own]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(block)], names=[*names, "cell", "block"])

    return packed.mapInArrow(run, T.StructType([*packed.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType())]))


def _near(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left and right that link with any row of the other, and which of them do (double precision, ties at 1e-12 summed exactly).

    Single precision finds rows that may link: its error is far below the slack.
    """
    slack = threshold - 1e-5 - 1e-6 * left.shape[1]
    some_left, some_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
    low_left, low_right = left.astype(np.float32), right.astype(np.float32).T.copy()
    for at in range(0, len(left), STRIP):
        may = low_left[at : at + STRIP] @ low_right >= slack
        some_left[at : at + STRIP] = may.any(axis=1)
        some_right |= may.any(axis=0)
    rows, cols = np.flatnonzero(some_left), np.flatnonzero(some_right)
    linked = np.zeros((len(rows), len(cols)), bool)
    for at in range(0, len(rows), STRIP):
        cosine = left[rows[at : at + STRIP]] @ right[cols].T
        linked[at : at + STRIP] = cosine >= threshold
        for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12), strict=True):
            linked[at + i, j] = math.fsum((left[rows[at + i]] * right[cols[j]]).tolist()) >= threshold
    return rows, cols, linked


def _local_roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable inside one block comparison, for its rows and columns."""
    of_left, of_right = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    strips = range(0, len(left), STRIP)
    while True:
        new_left, new_right = of_left.copy(), of_right.copy()
        for at in strips:
            part = linked[at : at + STRIP]
            new_left[at : at + STRIP] = np.minimum(of_left[at : at + STRIP], np.where(part, of_right[None, :], top).min(axis=1, initial=top))
            new_right = np.minimum(new_right, np.where(part, new_left[at : at + STRIP, None], top).min(axis=0, initial=top))
        # An id on both sides is one vertex.
        both = np.r_[left, right]
        ids, where = np.unique(both, return_inverse=True)
        least = np.full(len(ids), top)
        np.minimum.at(least, where, np.r_[new_left, new_right])
        new = least[where]
        if np.array_equal(new, np.r_[of_left, of_right]):
            return of_left, of_right
        of_left, of_right = new[: len(left)], new[len(left) :]


class _Block(NamedTuple):
    cell: int
    ids: np.ndarray
    weights: np.ndarray
    units: np.ndarray

    def shown(self, others: np.ndarray, centres: np.ndarray, margin: float) -> np.ndarray:
        """Which rows lie within ``margin`` of the border to which of the other cells.

        Two unit vectors that link are at most sqrt(2 - 2 threshold) apart, so one at home on the other side of the plane between two
        centres is within that distance of the plane: both ends of a link are shown to each other's cell.
        """
        out = np.empty((len(self.ids), len(others)), bool)
        apart = np.sqrt(np.maximum(2.0 - 2.0 * (centres[others] @ centres[self.cell]), 1e-12))
        for at in range(0, len(out), STRIP):
            near = self.units[at : at + STRIP]
            out[at : at + STRIP] = ((near @ centres[self.cell])[:, None] - near @ centres[others].T) / apart <= margin
        out[:, others == self.cell] = True
        return out


def _read_block(cell: int, paths: list[str], kind: str) -> _Block:
    parts = []
    for path in paths:
        system, p = locate(path)
        with system.open_input_file(p) as f:
            parts.append(pq.read_table(f, columns=["rep", "weight", "raw"]))
    rows = pa.concat_tables(parts)
    return _Block(cell, rows["rep"].to_numpy(), rows["weight"].to_numpy(), unit_rows(rows["raw"].to_pylist(), kind))


def _links(left: _Block, right: _Block, rows: np.ndarray, cols: np.ndarray, threshold: float, same: bool) -> pa.RecordBatch | None:
    """(id, n, root) of rows of one block against rows of another, or against themselves (``same``)."""
    near_rows, near_cols, linked = _near(left.units[rows], right.units[cols], threshold)
    rows, cols = rows[near_rows], cols[near_cols]
    linked &= left.ids[rows][:, None] != right.ids[cols][None, :]
    if not linked.any():
        return None
    n_rows = np.array([right.weights[cols][own].sum() for own in linked], np.int64)
    n_cols = np.zeros(len(cols), np.int64) if same else np.array([left.weights[rows][own].sum() for own in linked.T], np.int64)
    roots = np.r_[_local_roots(linked, left.ids[rows], right.ids[cols])]
    ids, n = np.r_[left.ids[rows], right.ids[cols]], np.r_[n_rows, n_cols]
    keep = (n > 0) | (roots != ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(n[keep]), pa.array(roots[keep])], names=["id", "n", "root"])


def _compared(spark: SparkSession, path: str, shared: Broadcast, threshold: float, kind: str) -> DataFrame:
    """(id, n, root) from block against block: weights linked to a vector, and a root for whatever is linked.

    A pair of blocks is met once. Tasks read the blocks they compare from the shared folder, two at a time, and hand on links only: no
    copy of a vector is shuffled, however many cells it is shown to. Each block meets the half of the blocks that follows it in a
    ring, so that all have the same to do.
    """
    margin = math.sqrt(max(2.0 - 2.0 * threshold, 0.0)) + 1e-9
    files = spark.read.schema("rep long, weight long, raw binary, dim int, cell int, block int").parquet(path)
    # One row per block of about BLOCK vectors.
    found: dict[tuple[int, int, int], list[str]] = {}
    for r in files.select("dim", "cell", "block", F.col("_metadata.file_path").alias("file")).distinct().collect():
        found.setdefault((r.dim, r.cell, r.block), []).append(r.file)
    rings: dict[int, list[tuple[int, list[str]]]] = {}
    for (dim, cell, _), paths in sorted(found.items()):
        rings.setdefault(dim, []).append((cell, sorted(paths)))
    stripes = max(1, -(-2 * spread(spark) // max(1, len(found))))
    work = [(dim, i, s) for dim, ring in rings.items() for i in range(len(ring)) for s in range(min(stripes, len(ring) // 2 + 1))]
    listed = spark.sparkContext.broadcast((rings, stripes, work))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings, stripes, work = listed.value
        for dim, i, s in (work[k] for batch in batches for k in batch.column(0).to_pylist()):
            ring, centres = rings[dim], _centres_of(shared, dim)
            left = _read_block(*ring[i], kind)
            ways = [k for k in range(s, len(ring) // 2 + 1, stripes) if 2 * k < len(ring) or i < k]
            cells = np.unique([ring[(i + k) % len(ring)][0] for k in ways]).astype(np.int64)
            shown = left.shown(cells, centres, margin)
            for k in ways:
                cell, paths = ring[(i + k) % len(ring)]
                rows = np.flatnonzero(shown[:, np.searchsorted(cells, cell)])
                if not len(rows):
                    continue
                right = _read_block(cell, paths, kind) if k else left
                cols = np.flatnonzero(right.shown(np.array([left.cell]), centres, margin)[:, 0])
                if len(cols) and (links := _links(left, right, rows, cols, threshold, k == 0)) is not None:
                    yield links

    tasks = spark.range(0, len(work), 1, max(1, min(len(work), MOST_TASKS)))
    return tasks.mapInArrow(released(run), "id long, n long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) per row.

    Equal vectors collapse to one with a weight first. Vectors lie once, in blocks of the cell whose centre is nearest; a pair is
    compared where its two blocks meet, if each end lies near the border to the other's cell. Nothing is capped: cells of any size
    are compared block by block. Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of different sizes are
    never compared. Rows with a null id link with nothing, have a null component and are kept. Repeated ids are one vertex and
    equal repeated rows count once. Other columns are not read.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vec_col].dataType.elementType.typeName()
    kind = "f4" if element == "float" else "f8"
    vec = F.col(vec_col) if kind == "f4" else F.col(vec_col).cast("array<double>")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = source.filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    usable = usable.filter(~bad & F.exists("vec", lambda x: x != 0)).withColumns(dict(zip(["h1", "h2"], two_hashes(F.col("vec")), strict=True)))
    packed = _packed(usable.select("id", "h1", "h2", "vec"), kind)
    keyed = stored(usable.select("id", "h1", "h2", F.size("vec").alias("dim")))
    members = keyed.distinct()
    classes = stored(members.groupBy("h1", "h2", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))
    members = members.drop("dim")

    centres = {}
    for dim, n in [(r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(16).collect()]:
        # The most common sizes have fitted cells, any other is one cell, compared in blocks like the rest.
        k = min(MOST_CELLS, n // PER_CELL)
        if k > 1:
            draw = F.pmod(F.col("h1"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FIT_VECTORS / n)) + 1
            drawn = usable.filter((F.size("vec") == dim) & draw).select("id", "h1", "h2", "vec")
            picked = _packed(drawn, kind).dropDuplicates(["h1", "h2"]).select("h1", "h2", "raw").collect()
            picked = [r.raw for r in sorted(picked, key=lambda r: (r.h2, r.h1))]
            centres[dim] = fit_cells(unit_rows(picked, kind), min(k, len(picked)))
    shared = spark.sparkContext.broadcast(centres)

    # At most one row per BLOCK vectors; a few hundredths more or less in a block do no harm.
    sizes = _placed(packed, shared, kind, {}).groupBy("dim", "cell").agg(F.approx_count_distinct("h1").alias("n")).filter(F.col("n") > BLOCK)
    blocks = {(r.dim, r.cell): -(-r.n // BLOCK) for r in sizes.collect()}
    # Dealt by hash and id, the copies of a vector leave one row where the join has put them.
    own = packed.join(classes.drop("dim"), [packed.h1 == classes.h1, packed.h2 == classes.h2, packed.id == classes.rep])
    reps = own.select("id", packed.h1, packed.h2, "rep", "weight", "dim", "raw").dropDuplicates(["h1", "h2", "id"])
    placed = _placed(reps.select("rep", "weight", "h2", "dim", "raw"), shared, kind, blocks).drop("h2")
    folder = f"{spark.sparkContext.getCheckpointDir()}/vectors-{uuid.uuid4().hex}"
    by = ["dim", "cell", "block"]
    placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).write.partitionBy(*by).parquet(folder)
    found = stored(_compared(spark, folder, shared, threshold, kind))
    counted = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    edges = found.filter("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
    placed = members.join(classes, ["h1", "h2"])
    own = placed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last"))
    several = own.filter("a <> last").select("id", "a").join(placed, "id").select("a", F.col("rep").alias("b"))
    comp = components(edges.union(several)).withColumnRenamed("node", "rep")
    per_class = classes.join(counted, "rep", "left").join(comp, "rep", "left")
    per_class = per_class.select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = keyed.select("id", "h1", "h2").join(per_class, ["h1", "h2"]).select("id", "n_links", "component_id")
    unusable = source.withColumn("fine", F.coalesce(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0), F.lit(False)))
    alone = unusable.filter(~F.col("fine")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
