"""Order-dependent operators (numbering, previous row, running sums) that no single key can overload.

A plain window over a key puts the whole key into one task. Here the key is cut into chunks of the order
column first; a window only ever sees one chunk, and what crosses a chunk border travels through a table with
one row per chunk. With a unique integer order column a chunk of width C holds at most C rows. Where ids are spread
so wide that there are about as many chunks as rows, that table is cut into chunks of chunks in turn: totals are swept
up a level and what stands before is swept down again, so no window sees more than about SPAN small rows of a key.
As-of joins (latest_before) go down a search tree, one join per level.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixeltide.functions.columns import col
from pixeltide.session import cut

CHUNK = 1 << 16
#: Chunks per chunk of the next level. Two levels and the width of a chunk span all 64-bit positions.
SPAN = 1 << 24
LEVELS = 2


def chunk_of(order: str | Column, width: int = CHUNK) -> Column:
    """Chunk number of an integer order column."""
    return F.floor(col(order) / F.lit(float(width))).cast("bigint")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that matches null keys, keeping the left side's key columns."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _sum_before(name: str, over) -> Column:
    return F.sum(name).over(over.rowsBetween(Window.unboundedPreceding, -1))


def _carry(
    chunks: DataFrame, keys: Sequence[str], names: Sequence[str], up: Callable, before: Callable, merge: Callable, levels: int = LEVELS
) -> DataFrame:
    """(keys, __chunk, names) with what stands before each chunk of its key.

    up folds the chunks of a chunk of the next level, before folds those that precede within it, merge adds what the level above
    says. Rows of chunks are one per key and ``__chunk``.
    """
    keys = list(keys)
    if levels == 1:
        over = Window.partitionBy(*keys).orderBy("__chunk")
        return chunks.select(*keys, "__chunk", *[before(n, over).alias(n) for n in names])
    wide = chunks.withColumn("__up", F.floor(F.col("__chunk") / F.lit(float(SPAN))).cast("bigint"))
    above = wide.groupBy(*keys, "__up").agg(*[up(n).alias(n) for n in names]).withColumnRenamed("__up", "__chunk")
    above = _carry(above, keys, names, up, before, merge, levels - 1).withColumnsRenamed({"__chunk": "__up", **{n: f"__above_{n}" for n in names}})
    over = Window.partitionBy(*keys, "__up").orderBy("__chunk")
    inside = wide.select(*keys, "__up", "__chunk", *[before(n, over).alias(n) for n in names])
    return join_on(inside, above, [*keys, "__up"]).select(*keys, "__chunk", *[merge(F.col(n), F.col(f"__above_{n}")).alias(n) for n in names])


def carried_sums(chunks: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, __chunk, names): sums over the earlier chunks of a key, null where there is none."""
    add = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return _carry(chunks, keys, names, F.sum, _sum_before, add)


def carried_last(chunks: DataFrame, keys: Sequence[str], name: str, following: bool = False) -> DataFrame:
    """(keys, __chunk, name): the value of the nearest earlier (or following) chunk of the key, null where there is none."""
    nearest, shift = (F.min_by, F.lead) if following else (F.max_by, F.lag)
    return _carry(chunks, keys, [name], lambda n: nearest(n, "__chunk"), lambda n, over: shift(n).over(over), F.coalesce)


def number_by_position(
    df: DataFrame,
    keys: Sequence[str],
    leading: Sequence[str],
    position: str,
    out: str,
    start: int = 0,
    width: int = CHUNK,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Consecutive numbers per keys in the order (leading..., position, ties...).

    position is an integer, unique within (keys, leading, ties), so with few ties a chunk holds about ``width`` rows. Of the chunk
    counts no window sees more than about SPAN rows; of the leading values it sees those of one key, one row each.
    """
    df = df.withColumn("__chunk", chunk_of(position, width))
    part = [*keys, *leading, "__chunk"]
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    offsets = carried_sums(counts, [*keys, *leading], ["__n"]).withColumnRenamed("__n", "__off")
    if leading:
        groups = counts.groupBy(*keys, *leading).agg(F.sum("__n").alias("__n"))
        groups = groups.select(*keys, *leading, _sum_before("__n", Window.partitionBy(*keys).orderBy(*leading)).alias("__first"))
        offsets = join_on(offsets, groups, [*keys, *leading])
    local = F.row_number().over(Window.partitionBy(*part).orderBy(position, *ties))
    numbered = df.withColumn("__local", local)
    zero = F.lit(0).cast("bigint")
    before = F.coalesce("__off", zero) + (F.coalesce("__first", zero) if leading else zero)
    return (
        join_on(numbered, offsets, part)
        .withColumn(out, before + F.col("__local").cast("bigint") + F.lit(start - 1).cast("bigint"))
        .drop("__chunk", "__local", "__off", "__first")
    )


def number_by_order(
    df: DataFrame, order: Sequence[str], out: str, start: int = 0, within: Sequence[str] = ()
) -> DataFrame:
    """Consecutive numbers in any order, by range partitioning instead of a window.

    Rows are range-partitioned and sorted once, the position inside the partition is fixed by a checkpoint, and
    each partition is shifted by the rows before it (one count per partition). With ``within`` (a prefix of
    ``order``) numbering restarts per group by subtracting the group's first number.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    placed = cut(placed)
    pid = F.shiftright("__mid", 33)
    placed = placed.withColumns({"__pid": pid, "__idx": F.col("__mid") - F.shiftleft(pid, 33)})
    counts = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: the only unpartitioned window here, as small as the partition count.
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("bigint")).alias("__off"))
    numbered = placed.join(F.broadcast(offsets), "__pid").withColumn(out, F.col("__off") + F.col("__idx"))
    numbered = numbered.drop("__mid", "__pid", "__idx", "__off")
    if within:
        first = numbered.groupBy(*within).agg(F.min(out).alias("__first"))
        numbered = join_on(numbered, first, list(within)).withColumn(out, F.col(out) - F.col("__first"))
        numbered = numbered.drop("__first")
    return numbered.withColumn(out, F.col(out) + F.lit(start).cast("bigint"))


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    payload: Sequence[str],
    out: str,
    following: bool = False,
) -> DataFrame:
    """Struct of the previous (or following) row's payload per keys; null at the end.

    chunk must not decrease along ``order``. Inside a chunk this is lag/lead; across chunk borders the border row of
    the nearest non-empty chunk is used.
    """
    value = F.struct(*payload)
    rank = F.struct(*order)
    df = df.withColumn("__chunk", chunk)
    part = [*keys, "__chunk"]
    border = F.min_by(value, rank) if following else F.max_by(value, rank)
    borders = df.groupBy(*part).agg(border.alias("__border"))
    over_rows = Window.partitionBy(*part).orderBy(*order)
    shift = F.lead if following else F.lag
    carry = carried_last(borders, keys, "__border", following).withColumnRenamed("__border", "__carry")
    inside = df.withColumn("__inside", shift(value).over(over_rows))
    return (
        join_on(inside, carry, part)
        .withColumn(out, F.coalesce(F.col("__inside"), F.col("__carry")))
        .drop("__chunk", "__inside", "__carry")
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums per keys; ``sums`` maps output names to summed expressions."""
    df = df.withColumn("__chunk", chunk)
    part = [*keys, "__chunk"]
    totals = df.groupBy(*part).agg(*[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    carry = carried_sums(totals, keys, [f"__t_{n}" for n in sums]).withColumnsRenamed({f"__t_{n}": f"__c_{n}" for n in sums})
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumns({f"__s_{n}": F.sum(e).over(upto) for n, e in sums.items()})
    joined = join_on(inside, carry, part)
    joined = joined.withColumns(
        {n: F.when(F.col(f"__c_{n}").isNull(), F.col(f"__s_{n}")).otherwise(F.col(f"__s_{n}") + F.col(f"__c_{n}")) for n in sums}
    )
    return joined.drop("__chunk", *[f"__s_{n}" for n in sums], *[f"__c_{n}" for n in sums])


#: Entries of a node of the search tree of latest_before, and marks of a key up to which one task numbers them.
FAN, NUMBERED_AT_ONCE = 64, 1 << 20


def latest_before(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str, payload: Sequence[str], out: str, strict: bool = True
) -> DataFrame:
    """As-of join: adds struct ``out``, the payload of the right row of the key with the greatest ``since`` below ``at``.

    strict=False takes equal ones too. Null where there is none; ``since`` is unique per key. The right side becomes a search tree per
    key, with nodes of FAN entries, and left rows go down it: one equi-join on (keys, node) and one look through a node per level. So
    work is linear in both sides however they crowd, left rows are not shuffled while the tree is small enough to be sent out, and a
    hot key is an ordinary skewed join side beyond.
    """
    keys = list(keys)
    marks = right.select(*keys, F.col(since).alias("__t"), F.struct(*payload).alias("__mark"))
    most = marks.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= NUMBERED_AT_ONCE:
        ranked = marks.withColumn("__n", (F.row_number().over(Window.partitionBy(*keys).orderBy("__t")) - 1).cast("bigint"))
    else:
        ranked = number_by_order(marks, [*keys, "__t"], "__n", within=keys)

    def nodes(rows: DataFrame, value: str) -> DataFrame:
        """(keys, __node, __entries): entries (time, value) of each node in order."""
        entry = F.struct(F.col("__t").alias("t"), F.col(value).alias("v"))
        return rows.groupBy(*keys, F.floor(F.col("__n") / FAN).alias("__node")).agg(F.sort_array(F.collect_list(F.struct("__n", entry.alias("e")))).alias("__e")).select(
            *keys, "__node", F.transform("__e", lambda x: x["e"]).alias("__entries")
        )

    levels, n = [nodes(ranked, "__mark")], -(-most // FAN)
    while n > 1:
        starts = levels[-1].select(*keys, F.col("__node").alias("__n"), F.get("__entries", F.lit(0))["t"].alias("__t"))
        levels.append(nodes(starts, "__n"))
        n = -(-n // FAN)
    found = left.withColumn("__node", F.lit(0).cast("bigint"))
    below = (lambda t: t < F.col(at)) if strict else (lambda t: t <= F.col(at))
    for depth, level in reversed(list(enumerate(levels))):
        met = join_on(found, level, [*keys, "__node"])
        # Entries are in order, so the last one below is as many as there are below.
        last = F.get("__entries", F.size(F.filter("__entries", lambda e: below(e["t"]))) - 1)["v"]
        found = met.withColumn("__v", F.when(F.col("__entries").isNotNull(), last)).drop("__entries", "__node")
        found = found.withColumnRenamed("__v", "__node" if depth else out)
    return found.select(*left.columns, out)
