"""What several corpus operators share: scratch tables, word hashes over Arrow text buffers, components of links."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.session import stored as stored

#: Bytes of text that one numpy step handles; keeps a worker's arrays at some tens of MB.
STEP_BYTES = 1 << 20
#: Bytes whose words are hashed at once; eight bytes of running sums and two powers stand beside each.
HASH_BYTES = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def two_hashes(*columns: Column) -> list[Column]:
    """128 bits of hash as two longs."""
    return [F.xxhash64(*columns, F.lit(1)), F.xxhash64(*columns, F.lit(2))]


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives the memory of its arrays back to the system: workers are reused and stand idle beside the JVM."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return done


# ---------------------------------------------------------------- text buffers


def text_buffer(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and n + 1 offsets; a null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    array = array.cast(pa.large_binary())
    array = array.fill_null(b"") if array.null_count else array
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with about ``limit`` bytes each, a longer text alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int, odd: bool = False) -> np.ndarray:
    out = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64)
    return out | np.uint64(1) if odd else out


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = random_words(256, 11)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, (STEP_BYTES if n > HASH_BYTES + 65535 else HASH_BYTES) + 65536)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray, codes: np.ndarray = _BYTE_CODE) -> np.ndarray:
    """Running polynomial sums, one longer than data; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mix64((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER_CODE = _BYTE_CODE.copy()
_LOWER_CODE[65:91] = _BYTE_CODE[97:123]


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without bytes that stand ``between``: ASCII white space) and each text's first word."""
    solid = ~between[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word after A-Z are lower-cased."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + HASH_BYTES)))
        base = starts[i]
        prefix = prefix_hash(data[base : ends[j - 1]], _LOWER_CODE)
        out[i:j] = span_hash(prefix, starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


# ---------------------------------------------------------------- components


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node reachable.

    Alternates two kinds of star rounds: hang larger neighbours onto a node's smallest neighbour, then smaller ones.
    A round is one aggregate (combined before the shuffle) and one join; no neighbour list is ever built, and the number of
    links does not grow. Rounds are logarithmic in the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    edges = stored(edges)
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = edges.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = stored(least.withColumnRenamed("m", "lo").union(hung).distinct())
    roots = edges.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
