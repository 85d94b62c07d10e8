"""Exact histogram of encoded lengths; suffix sums answer totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixeltide.llm.common import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths per block of the suffix sums.
BLOCK = 1024


@cache
def encoder(path: str):
    """Byte-level BPE read from a file of ranks; one per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` and n_tokens of each whole text; a null text has 0."""
    kept = docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*keep, "n_tokens"])

    schema = kept.withColumn("n_tokens", F.lit(0).cast("long")).schema
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per occurring length: n_tokens, n_docs, and over all documents at least that long docs_at_least and tokens_at_least;
    docs_total, tokens_total; truncated_total, the tokens left if every document is cut to n_tokens.

    Lengths are counted before the shuffle. Suffix sums run inside blocks of lengths; what crosses a block border is one row
    per block, so no window grows with the documents. An empty input gives no rows.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    # Kept, as it is read three times below and stands for all the encoding.
    counts = stored(counts).withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "tokens": F.col("n_tokens") * F.col("n_docs")})
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    # One row per block of lengths: as many as the longest document has thousands of tokens.
    above, whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), zero).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), zero).alias("tokens_above"),
        F.sum("block_docs").over(whole).alias("docs_total"),
        F.sum("block_tokens").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.join(blocks, "block").withColumns(
        {
            "docs_at_least": F.sum("n_docs").over(inside) + F.col("docs_above"),
            "tokens_at_least": F.sum("tokens").over(inside) + F.col("tokens_above"),
        }
    )
    cut = F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return summed.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_total", "tokens_total", cut.alias("truncated_total")
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens left at any context limit, and the documents cut."""
    longer = F.col("n_tokens") > limit
    kept = F.when(longer, F.lit(limit)).otherwise(F.col("n_tokens")) * F.col("n_docs")
    return histogram.agg(
        F.coalesce(F.sum(kept), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).cast("long").alias("cut_docs")
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents do not exceed."""
    up_to = F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")
    return histogram.filter(up_to >= F.ceil(q * F.col("docs_total"))).agg(F.min("n_tokens").alias("n_tokens"))
