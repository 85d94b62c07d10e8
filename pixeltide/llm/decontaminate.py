"""Benchmark decontamination by greedy string tiling over token hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import mix64, powers, random_words, released, steps, stored, text_buffer, two_hashes, word_hashes, word_spans

#: Tokens of a seed and of the shortest tile.
SEED = 5
#: Share of a test item's tokens that tiles must cover.
COVERAGE = 0.5
#: Characters of benchmark text that travel to the documents, which then never move. Seeds of a larger benchmark are joined.
BLOCK_CHARS = 8 << 20
#: Different seeds up to which a filter of them keeps seeds that no item has out of that join, and the filter's bits.
FILTERED_SEEDS, JOIN_FILTER_BITS = 4_000_000, 26

_MUL = random_words(SEED, 51, odd=True)
_NO_TOKEN = np.ones(256, bool)
_NO_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FILTER_BITS = 22
# Scripts written without spaces, whose characters are tokens of their own, and marks beyond ASCII, which are none.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"
_MARKS = r"[^\x00-\x7F\p{L}\p{N}\p{M}]"


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, index of each row's first token) for runs of rows.

    A token is a run of ASCII letters, digits and non-ASCII letters, digits and accents, after lower-casing; in scripts without
    spaces every character is one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for pattern, put in ((_MARKS, " "), (_UNSPACED, r" \1 ")):
        if pc.any(pc.match_substring_regex(column, pattern)).as_py():
            column = pc.replace_substring_regex(column, pattern, put)
    data, offsets = text_buffer(pc.utf8_lower(column))
    for i, j in steps(offsets):
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = word_spans(part, bounds, _NO_TOKEN)
        yield i, word_hashes(part, starts, ends), first


def seeds(words: np.ndarray) -> np.ndarray:
    """Hash of each run of SEED tokens, whatever text they stand in."""
    n = max(len(words) - SEED + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(SEED):
        term = words[k : k + n] * _MUL[k]
        total += term ^ (term >> np.uint64(31))
    return mix64(total)


def _run_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` tokens, from running sums: one subtraction a run, whatever its size."""
    n = len(tokens)
    forward, back = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(tokens) * forward[:n], out=sums[1:])
    return (sums[size:] - sums[: n - size + 1]) * back[: n - size + 1]


def _free_runs(used: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` places that are all free."""
    taken = np.r_[0, np.cumsum(used)]
    return np.flatnonzero(taken[size:] == taken[: len(used) - size + 1])


def tile(doc: list[int | None], item: list[int], shortest: int = SEED) -> int:
    """Tokens of item covered by greedy tiles: longest unmarked common runs first, found by hashed runs of a falling size.

    doc may hold None between parts that do not stand together; None equals nothing.
    """
    used_doc, used_item = np.array([token is None for token in doc], bool), np.zeros(len(item), bool)
    in_doc, in_item = np.array([token or 0 for token in doc], np.uint64), np.array(item, np.uint64)
    covered, size = 0, max(shortest, min(20, len(item)))
    while True:
        index: dict[int, list[int]] = {}
        longest, found = 0, []
        if min(len(doc), len(item)) >= size:
            starts, places = _free_runs(used_item, size), _free_runs(used_doc, size)
            hashes, own = _run_hashes(in_doc, size)[places], _run_hashes(in_item, size)[starts]
            for p, h in zip(starts.tolist(), own.tolist(), strict=True):
                index.setdefault(h, []).append(p)
            alike = np.isin(hashes, own)
            for t, h in zip(places[alike].tolist(), hashes[alike].tolist(), strict=True):
                for p in index[h]:
                    k = 0
                    while p + k < len(item) and t + k < len(doc) and item[p + k] == doc[t + k] and not used_item[p + k] and not used_doc[t + k]:
                        k += 1
                    if k >= size:
                        longest = max(longest, k)
                        found.append((-k, p, t))
                    if k == len(item):
                        return len(item)
        if longest > 2 * size:
            size = longest
            continue
        for minus, p, t in sorted(found):
            k = -minus
            # What an earlier tile has taken of a run leaves shorter runs to a later, smaller size.
            if not (used_item[p : p + k].any() or used_doc[t : t + k].any()):
                used_item[p : p + k] = True
                used_doc[t : t + k] = True
                covered += k
        if size == shortest:
            left = [1 for minus, p, t in found if not (used_item[p : p + size].any() or used_doc[t : t + size].any())]
            if not left:
                return covered
        elif size > 2 * shortest:
            size //= 2
        else:
            size = shortest


@dataclass
class Block:
    """Some test items: their tokens, and which items hold a seed."""

    ids: list[int | None]
    words: np.ndarray
    first: np.ndarray
    keys: np.ndarray
    key_first: np.ndarray
    key_items: np.ndarray
    maybe: np.ndarray

    @staticmethod
    def of(ids: list[int], texts: list[str | None]) -> Block:
        words, first = [], [0]
        for _, w, f in tokens(pa.array(texts, pa.large_string())):
            words.append(w)
            first.extend((f[1:] + first[-1]).tolist())
        flat, bounds = (np.concatenate(words) if words else np.zeros(0, np.uint64)), np.array(first)
        hashes = seeds(flat)
        at = np.arange(len(hashes))
        item = np.searchsorted(bounds, at, "right") - 1
        inside = at + SEED <= bounds[item + 1]
        pairs = np.unique(np.stack([hashes[inside], item[inside].astype(np.uint64)]), axis=1)
        keys, key_first = np.unique(pairs[0], return_index=True)
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[keys >> np.uint64(64 - _FILTER_BITS)] = True
        return Block(list(ids), flat, bounds, keys, np.r_[key_first, pairs.shape[1]], pairs[1].astype(np.int64), maybe)

    def candidates(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(row, item): where in the run of rows their shared seeds start."""
        hashes = seeds(words)
        hit = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _FILTER_BITS)])
        if not len(hit) or not len(self.keys):
            return {}
        pos = np.minimum(np.searchsorted(self.keys, hashes[hit]), len(self.keys) - 1)
        row = np.searchsorted(first, hit, "right") - 1
        good = (self.keys[pos] == hashes[hit]) & (hit + SEED <= first[row + 1])
        hit, pos, row = hit[good], pos[good], row[good]
        if not len(hit):
            return {}
        n = self.key_first[pos + 1] - self.key_first[pos]
        item = self.key_items[np.repeat(self.key_first[pos] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        hit, row = np.repeat(hit, n), np.repeat(row, n)
        o = np.lexsort((hit, item, row))
        hit, row, item = hit[o], row[o], item[o]
        cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
        ends = np.r_[cut[1:], len(hit)]
        return {(int(row[a]), int(item[a])): hit[a:b] for a, b in zip(cut, ends, strict=True)}

    def covered(self, words: np.ndarray, where: np.ndarray, item: int) -> int:
        """Item tokens that tiles cover; only tokens under shared seeds can be in a tile."""
        return tile(_under(where.tolist(), lambda a, b: words[a:b].tolist()), self.words[self.first[item] : self.first[item + 1]].tolist())


def _under(where: list[int], between) -> list[int | None]:
    """Tokens under seeds that start at the places ``where``, with None between parts that do not stand together."""
    parts: list[int | None] = []
    end = -1
    for at in where:
        if at > end and parts:
            parts.append(None)
        parts.extend(between(max(at, end), at + SEED))
        end = at + SEED
    return parts


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, text) of the items, and how many characters they have."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    return rows, rows.agg(F.sum(F.length("text"))).first()[0] or 0


def _block(rows: DataFrame) -> Block:
    own = rows.collect()
    return Block.of([r.id for r in own], [r.text for r in own])


def _filter(of_items: DataFrame) -> np.ndarray | None:
    """Packed bits of the seeds that items have, None if they are too many for it to keep others out."""
    different = of_items.select("seed").distinct()
    if different.count() > FILTERED_SEEDS:
        return None
    maybe = np.zeros(1 << JOIN_FILTER_BITS, bool)
    known = np.array([r.seed for r in different.toLocalIterator()], np.int64).view(np.uint64)
    maybe[known >> np.uint64(64 - JOIN_FILTER_BITS)] = True
    return np.packbits(maybe)


def _joined(texts: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """(h1, h2, item, n_covered, n_tokens, coverage) of (h1, h2, text) rows by joining seeds, for a benchmark of any size.

    Texts are read once. Of their seeds those that some item has go out, with the tokens they hold; texts and items with a common seed
    meet by an equi-join, and each such pair is tiled by itself. Pairs whose common seeds cannot cover enough are dropped before.
    """
    items = items.withColumn("unit", F.xxhash64("id", "text"))

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words, first in tokens(batch.column(2)):
                n = len(first) - 1
                hashes = seeds(words)
                own = [np.unique(hashes[first[k] : max(first[k], first[k + 1] - SEED + 1)]).view(np.int64) for k in range(n)]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own) if own else np.zeros(0, np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.view(np.int64))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), *lists], names=["unit", "item", "item_words", "seeds"])

    of_items = stored(items.select("unit", "id", "text").mapInArrow(released(spelt), "unit long, item long, item_words array<long>, seeds array<long>"))
    by_seed = of_items.select("unit", F.size("item_words").alias("n_tokens"), F.explode("seeds").alias("seed"))
    bits = _filter(by_seed)
    shared = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = None if shared is None else np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for row, words, first in tokens(batch.column(2)):
                hashes = seeds(words)
                at = np.arange(len(hashes)) if maybe is None else np.flatnonzero(maybe[hashes >> np.uint64(64 - JOIN_FILTER_BITS)])
                owner = np.searchsorted(first, at, "right") - 1
                inside = at + SEED <= first[owner + 1]
                at, owner = at[inside], owner[inside]
                take = pa.array(owner + row)
                lists = words[at[:, None] + np.arange(SEED)].view(np.int64).ravel()
                held = pa.ListArray.from_arrays(pa.array(np.arange(0, lists.size + 1, SEED), pa.int32()), pa.array(lists))
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(at - first[owner]), pa.array(hashes[at].view(np.int64)), held]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "at", "seed", "words"])

    # Equal texts are one; a seed of very many texts or items is a skewed key, which adaptive execution splits.
    found = texts.mapInArrow(released(hits), "h1 long, h2 long, at long, seed long, words array<long>").distinct()
    pairs = found.join(by_seed, "seed").groupBy("h1", "h2", "unit", "n_tokens").agg(F.collect_list(F.struct("at", "words")).alias("hits"))
    pairs = pairs.filter(F.size("hits") * SEED >= F.col("n_tokens") * coverage).join(of_items.select("unit", "item", "item_words"), "unit")
    shape = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("item", pa.int64()), ("n_covered", pa.int64()), ("n_tokens", pa.int64()), ("coverage", pa.float64())])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (1 << 64) - 1  # hashes travel as signed numbers
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                held = {h["at"] + k: w & whole for h in r["hits"] for k, w in enumerate(h["words"])}
                doc = _under(sorted(h["at"] for h in r["hits"]), lambda a, b, held=held: [held[x] for x in range(a, b)])
                n, size = tile(doc, [w & whole for w in r["item_words"]]), len(r["item_words"])
                if n >= coverage * size:
                    out.append({"h1": r["h1"], "h2": r["h2"], "item": r["item"], "n_covered": n, "n_tokens": size, "coverage": n / size})
            yield pa.RecordBatch.from_pylist(out, shape)

    return pairs.mapInArrow(released(tiled), "h1 long, h2 long, item long, n_covered long, n_tokens long, coverage double")


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", coverage: float = COVERAGE, item_text_col: str = "text"
) -> DataFrame:
    """(id_col, item_col, n_covered, n_tokens, coverage) of each document that holds at least ``coverage`` of a test item.

    Coverage counts the item's tokens under tiles of five tokens and more, in any order, so passages that were cut up and
    reordered count in full. Items of fewer than five tokens match nothing. Null or empty texts match nothing; repeated
    rows give repeated results; a null id stays null. Documents are read once: beside a benchmark of up to BLOCK_CHARS characters,
    which meets them where they lie, or for their seeds, which are joined with those of a larger one.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items, chars = _items(benchmark, item_col, item_text_col)
    if chars <= BLOCK_CHARS:
        shared = docs.sparkSession.sparkContext.broadcast(_block(items))
        out = source.mapInArrow(released(_finder(shared, coverage)), "id long, item long, n_covered long, n_tokens long, coverage double")
        return out.withColumnsRenamed({"id": id_col, "item": item_col})
    keyed = source.withColumns(dict(zip(["h1", "h2"], two_hashes(F.col("text")), strict=True)))
    found = stored(_joined(keyed.select("h1", "h2", "text"), items, coverage))
    out = keyed.select("id", "h1", "h2").join(found, ["h1", "h2"])
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_covered", "n_tokens", "coverage")


def _hits(block: Block, column: pa.Array, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    for row, words, first in tokens(column):
        for (r, item), where in block.candidates(words, first).items():
            size = int(block.first[item + 1] - block.first[item])
            n = block.covered(words, where, item)
            if n >= coverage * size:
                yield row + r, item, n, size


def _finder(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_hits(shared.value, batch.column(1), coverage))
            rows, items, n, size = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 4))
            ids = batch.column(0).take(pa.array(rows))
            columns = [ids, pa.array([shared.value.ids[i] for i in items.tolist()], pa.int64()), pa.array(n), pa.array(size), pa.array(n / np.maximum(size, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "n_covered", "n_tokens", "coverage"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", coverage: float = COVERAGE, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows that ``matches`` would report; all columns stay. Nothing is shuffled beside a benchmark of up to
    BLOCK_CHARS characters; of a larger one the texts to drop are joined by their hashes."""
    items, chars = _items(benchmark, item_col, item_text_col)
    if chars > BLOCK_CHARS:
        keys = dict(zip(["__h1", "__h2"], two_hashes(F.col(text_col).cast("string")), strict=True))
        keyed = docs.withColumns(keys)
        texts = keyed.select(F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), F.col(text_col).cast("string").alias("text"))
        gone = stored(_joined(texts, items, coverage).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct())
        return keyed.join(gone, ["__h1", "__h2"], "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(_block(items))

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            kept = np.ones(len(column), bool)
            kept[[h[0] for h in _hits(shared.value, column, coverage)]] = False
            yield pa.array(kept)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(clean)(batches)

    # Only the text goes to the workers; not called deterministic, so that no later filter is put before it.
    keep = F.arrow_udf(run, "boolean").asNondeterministic()
    return docs.withColumn("__clean", keep(F.col(text_col).cast("string"))).filter("__clean").drop("__clean")
