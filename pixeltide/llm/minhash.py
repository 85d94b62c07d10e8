"""Near duplicates by b-bit MinHash: bands of full minima give candidates, packed low bits estimate, full sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import components, mix64, random_words, released, steps, stored, text_buffer, word_hashes, word_spans

WORDS = 5
#: A pair at similarity 0.75 shares no band of 4 minima among 32 with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
BITS = 4
#: Rows, and shingle hashes, of one side of a block comparison.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: A group of more rows is large; up to so many large groups have their sizes sent to all tasks.
LARGE_GROUP, FEW_GROUPS = 1024, 100_000
#: Standard errors of the estimate below the threshold at which a candidate is still confirmed on its full set.
SLACK = 5.0

_MUL, _ADD = random_words(PERMUTATIONS, 21, odd=True), random_words(PERMUTATIONS, 22)
_BAND_MUL = random_words(ROWS, 23, odd=True)
_WORD_MUL = random_words(WORDS, 24, odd=True)


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 5-word runs, text by text, and per text the index of its first one.

    A text of one to four words gives one hash of the whole sequence; one without words gives none. Repeats are kept.
    """
    n_words = np.diff(first)
    n = np.where(n_words >= WORDS, n_words - WORDS + 1, (n_words > 0).astype(n_words.dtype))
    out_first = np.concatenate(([0], np.cumsum(n)))
    begin = np.repeat(first[:-1] - out_first[:-1], n) + np.arange(out_first[-1])
    length = np.repeat(np.minimum(n_words, WORDS), n)
    acc = mix64(length.astype(np.uint64))
    top = max(len(words) - 1, 0)
    for k in range(WORDS):
        term = words[np.minimum(begin + k, top)] * _WORD_MUL[k]
        acc = acc + np.where(k < length, term ^ (term >> np.uint64(29)), np.uint64(0))
    return mix64(acc), out_first


def _distinct(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(first) - 1)]


def _sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    data, offsets = text_buffer(column)
    for i, j in steps(offsets):
        part, part_offsets = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = word_spans(part, part_offsets)
        yield _distinct(*shingle_hashes(word_hashes(part, starts, ends), first))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PERMUTATIONS minima per non-empty set."""
    out = np.empty((len(sets), PERMUTATIONS), np.uint64)
    lengths = np.array([len(s) for s in sets])
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + lengths[j] <= 65536):
            total += lengths[j]
            j += 1
        flat = np.concatenate(sets[i:j])
        at = np.concatenate(([0], np.cumsum(lengths[i : j - 1]))).astype(np.int64)
        for p in range(PERMUTATIONS):
            out[i:j, p] = np.minimum.reduceat(flat * _MUL[p] + _ADD[p], at)
        i = j
    return mix64(out)


def pack_low_bits(values: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, packed into 64-bit words."""
    per = 64 // BITS
    low = (values & np.uint64((1 << BITS) - 1)).reshape(len(values), PERMUTATIONS // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


_LOWEST = np.uint64(sum(1 << i for i in range(0, 64, BITS)))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: shared low bits, corrected for those that agree by chance."""
    x = a ^ b
    folded = x
    for k in range(1, BITS):
        folded = folded | (x >> np.uint64(k))
    agree = 1.0 - np.bitwise_count(folded & _LOWEST).sum(axis=-1) / PERMUTATIONS
    chance = 2.0**-BITS
    return (agree - chance) / (1.0 - chance)


def estimate_floor(percent: int) -> float:
    """Estimates below this are dropped: SLACK standard errors under the threshold."""
    j, chance = percent / 100.0, 2.0**-BITS
    agree = j + (1 - j) * chance
    return j - SLACK * (agree * (1 - agree) / PERMUTATIONS) ** 0.5 / (1 - chance)


_SIGNATURE = "n_shingles long, set_a long, set_b long, bands array<long>, signature binary"


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, set size, a 128-bit digest of the set, band keys and the packed signature (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _sets(batch.column(1)):
                full = [k for k, s in enumerate(sets) if len(s)]
                lows = minima([sets[k] for k in full]) if full else np.empty((0, PERMUTATIONS), np.uint64)
                packed = pack_low_bits(lows)
                keys = mix64((lows.reshape(-1, BANDS, ROWS) * _BAND_MUL).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                where = dict(zip(full, range(len(full)), strict=True))
                digest_a = [int(np.add.reduce(s)) if len(s) else 0 for s in sets]
                digest_b = [int(np.add.reduce(mix64(s))) if len(s) else 0 for s in sets]
                signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        signed(digest_a),
                        signed(digest_b),
                        pa.array([keys[where[k]].view(np.int64) if k in where else None for k in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([packed[where[k]].tobytes() if k in where else None for k in range(len(sets))], pa.binary()),
                    ],
                    names=["id", "n_shingles", "set_a", "set_b", "bands", "signature"],
                )
                at += len(sets)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(released(run), f"id long, {_SIGNATURE}")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, text) to (id, distinct shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _sets(batch.column(1)):
                lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), lists], names=["id", "shingles"])
                at += len(sets)

    return docs.mapInArrow(released(run), "id long, shingles array<long>")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose estimated similarity does not rule them out."""
    floor = estimate_floor(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array(similarity(a, b) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(released(run), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold, in whole numbers."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("in_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("in_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("in_a", "in_b")))
    return both.filter(100 * F.col("shared") >= percent * (F.size("in_a") + F.size("in_b") - F.col("shared"))).select("a", "b")


def _block_links(members: DataFrame, signatures_of: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join different components inside groups of candidates, compared block against block.

    members: (leader, id, comp, n_shingles); signatures_of and sets give (id, signature) and (id, shingles). A group is dealt into
    blocks of about BLOCK rows and BLOCK_SHINGLES hashes; each task holds two of them, compares packed bits as matrices and confirms
    likely pairs on the full sets, the likeliest first, as long as the two still belong to different components. So at most one link
    per row comes out, and no pair that is not joined otherwise stays unchecked.
    """
    floor = estimate_floor(percent)
    members = stored(members)
    groups = members.groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("hashes"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("hashes") / BLOCK_SHINGLES)).cast("int")
    groups = stored(groups.filter("x <> y").select("leader", "n", blocks.alias("blocks")))
    # Rows of a large group would meet its size in one task. Groups so large are few, and their sizes are sent out while they are.
    large = groups.filter(F.col("n") > LARGE_GROUP).select("leader", "blocks")
    if 0 < large.count() <= FEW_GROUPS:
        big = members.join(F.broadcast(large), "leader")
        small = members.join(F.broadcast(large.select("leader")), "leader", "left_anti")
        dealt = big.unionByName(small.join(groups.filter(F.col("n") <= LARGE_GROUP).select("leader", "blocks"), "leader"))
    else:
        dealt = members.join(groups.select("leader", "blocks"), "leader")
    # Signatures and sets join by id, which repeats at most once for each of its buckets.
    dealt = dealt.join(signatures_of, "id").join(sets, "id")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})

    def compare(group: pa.Table) -> pa.Table:
        ids, comps, mine, lo, hi = (group.column(c).to_numpy() for c in ("id", "comp", "mine", "lo", "hi"))
        sigs = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint64).reshape(len(ids), -1)
        lists = group.column("shingles").combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        size = np.diff(at)
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        found = []
        for i in left:
            near = right[(comps[right] != comps[i]) & (ids[right] != ids[i])]
            # No two sets are more alike than their sizes.
            near = near[100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i])]
            likely = similarity(sigs[i], sigs[near])
            found.append(np.stack([np.full(len(near), i), near, likely])[:, likely >= floor])
        pairs = np.concatenate(found, axis=1) if found else np.empty((3, 0))
        parent = {int(c): int(c) for c in comps}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        links = []
        for k in np.argsort(-pairs[2], kind="stable"):
            i, j = int(pairs[0, k]), int(pairs[1, k])
            x, y = root(int(comps[i])), root(int(comps[j]))
            if x == y:
                continue
            shared = len(np.intersect1d(flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]], assume_unique=True))
            if 100 * shared >= percent * (size[i] + size[j] - shared):
                parent[max(x, y)] = min(x, y)
                links.append((int(ids[i]), int(ids[j])))
        a, b = zip(*links, strict=True) if links else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = dealt.select("leader", "lo", "hi", "mine", "id", "comp", "signature", "shingles")
    # Dealt by all three: partitioned by leader alone, as the join leaves it, all blocks of a large group would be one task's.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "leader", "lo", "hi")
    return dealt.groupBy("leader", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) per row of docs.

    Texts are linked when 100 * shared shingles >= percent * all shingles of both, confirmed on full sets.

    1. Equal sets collapse onto their smallest id by a 128-bit digest, so copies are never paired.
    2. Each band bucket links its members to its smallest member: likely by estimate, confirmed on the sets.
    3. Buckets that still hold several components compare the rest in blocks, by packed bits, then on the sets.
    4. Components of all links; every copy takes its representative's.

    Null, empty and white-space texts have no shingles and stay alone. A row with a null id comes back with a null component,
    kept. A repeated id is one node: equal rows give equal result rows, and different texts under one id link together.
    Other columns of docs are not read, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = stored(signatures(source, "id", "text"))
    full = sigs.filter("n_shingles > 0 and id is not null")
    classes = full.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"))
    member = stored(full.select("id", "set_a", "set_b").distinct().join(classes, ["set_a", "set_b"]))
    reps = full.join(member.filter("id = rep").select("id", "set_a", "set_b"), ["id", "set_a", "set_b"], "left_semi")
    reps = reps.dropDuplicates(["id", "set_a", "set_b"])

    bands = reps.select("id", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    placed = stored(bands.join(buckets, "band"))
    # An id with several texts has several signatures, and is likely if one of them is.
    one_sig = reps.select("id", "signature").distinct()
    # A bucket of an id with two sets may hold the id twice; it needs no pair.
    pairs = placed.filter("leader <> id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    with_bits = pairs.join(one_sig.select(F.col("id").alias("a"), F.col("signature").alias("sig_a")), "a").join(
        one_sig.select(F.col("id").alias("b"), F.col("signature").alias("sig_b")), "b"
    )
    likely = stored(_likely(with_bits, percent))

    ids = placed.select("id").distinct()
    sets = stored(shingle_sets(source.join(ids, "id", "left_semi")))
    links = stored(_confirmed(likely, sets, percent))

    comp = components(links)
    labelled = placed.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    # Only buckets of three and more can hold a pair that the leader has not settled. Buckets of one leader overlap: one group.
    labelled = labelled.filter("n > 2")
    mixed = stored(labelled.groupBy("band", "n").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("band", "n"))
    # The rows of a large bucket would meet in one task. Buckets so large are few, and are sent out while they are.
    large = mixed.filter(F.col("n") > LARGE_GROUP).select("band")
    large = F.broadcast(large) if large.count() <= FEW_GROUPS else large
    rest = labelled.filter(F.col("n") > LARGE_GROUP).join(large, "band", "left_semi")
    rest = rest.unionByName(labelled.filter(F.col("n") <= LARGE_GROUP).join(mixed.select("band"), "band", "left_semi"))
    rest = rest.filter("id <> leader").select("leader", "id", "comp").distinct()
    rest = rest.join(full.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), "id")
    more = stored(_block_links(rest, one_sig, sets, percent))
    own = member.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    # A repeated id with several texts joins their classes.
    several = own.filter("rep <> last").select("id", F.col("rep").alias("a")).join(member, "id").select("a", F.col("rep").alias("b"))
    found = components(links.union(more).union(several)).withColumnRenamed("node", "rep")
    placed_ids = own.select("id", "rep").join(found, "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("id", "n_shingles").join(placed_ids, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
