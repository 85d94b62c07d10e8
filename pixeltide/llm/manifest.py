"""Merkle manifest of a dataset: digests of rows, of runs of rows, of groups, one root, and a proof for every row.

A row's rank in its group is cut into base-16 digits. Blocks of 256 rows are rolled up by grouping the lowest digit away twice, the
children nested as structs in their parent; the block digests are the rows of the next round. Proofs come out by unnesting from the
top: a row inherits the path of its block. No row of the dataset is ever joined; only one row per block meets its block's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import stored
from pixeltide.operators.ordered import number_by_order

#: Binary levels per digit; a block has two digits, so 256 rows at most, whatever the group's size.
DIGIT = 4
FANOUT = 1 << DIGIT
BLOCK = FANOUT * FANOUT
#: Groups up to this number have their first rank and size broadcast; more are joined.
FEW_GROUPS = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<sibling:string,right:boolean>>"


def field_text(column: Column) -> Column:
    """A field as hashed: ``-`` if null, else its length in UTF-8 bytes, a colon and the value (integers decimal)."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in columns]), 256)


def _levels(digests: Column, climbs: Column) -> Column:
    """The digests and the ``climbs`` (0 to 4) binary levels above them, lowest first; an odd last one is hashed by itself."""

    def up(level: Column) -> Column:
        pair = lambda i: F.sha2(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))), 256)
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)

    step = lambda levels, t: F.when(t < climbs, F.concat(levels, F.array(up(F.element_at(levels, -1))))).otherwise(levels)
    return F.aggregate(F.sequence(F.lit(0), F.lit(DIGIT - 1)), F.array(digests), step)


def _climbs(digit: int) -> Column:
    """Binary levels that the tree of the group has within this digit of a block."""
    return F.least(F.greatest(F.col("height") - digit * DIGIT, F.lit(0)), F.lit(DIGIT))


def _rolled(nodes: DataFrame) -> DataFrame:
    """(key, rank, height, digest, item) to blocks (key, block, height, digest, levels, kids): two digits grouped away."""
    digit = lambda k: F.pmod(F.floor(F.col("rank") / FANOUT**k), F.lit(FANOUT)).cast("int")
    rows = nodes.select("key", F.floor(F.col("rank") / BLOCK).alias("block"), digit(1).alias("high"), digit(0).alias("low"), "height", "digest", "item")
    # Dealt once: grouping by more columns than these needs no other exchange.
    rows = rows.repartition(F.col("key"), F.col("block"))
    runs = rows.groupBy("key", "block", "height", "high").agg(F.sort_array(F.collect_list(F.struct("low", "digest", "item"))).alias("kids"))
    runs = runs.withColumn("levels", _levels(F.transform("kids", lambda k: k["digest"]), _climbs(0)))
    runs = runs.withColumn("digest", F.get(F.element_at("levels", -1), F.lit(0)))
    tops = runs.groupBy("key", "block", "height").agg(F.sort_array(F.collect_list(F.struct("high", "digest", "levels", "kids"))).alias("kids"))
    tops = tops.withColumn("levels", _levels(F.transform("kids", lambda k: k["digest"]), _climbs(1)))
    return tops.withColumn("digest", F.get(F.element_at("levels", -1), F.lit(0)))


def _steps(levels: Column, place: Column, climbs: Column) -> Column:
    """Path of child ``place`` through the binary levels of one digit: its sibling at each (null for the odd last one) and its side."""

    def step(t: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(2), t)).cast("int")
        odd = at % 2 == 1
        return F.struct(F.get(F.get(levels, t), F.when(odd, at - 1).otherwise(at + 1)).alias("sibling"), odd.alias("right"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(DIGIT - 1)), F.lit(1), climbs), step).cast(_PATH)


def _unrolled(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, rank, digest, item, path, subroot) of what was rolled into blocks; paths: (key, block, path, subroot)."""
    rows = blocks.drop("digest").join(paths, ["key", "block"])
    rows = rows.select("key", "block", "height", "levels", "path", "subroot", F.explode("kids").alias("run"))
    above = F.concat(_steps(F.col("levels"), F.col("run.high"), _climbs(1)), F.col("path"))
    own = [F.col("run.high").alias("high"), F.col("run.levels").alias("levels"), F.explode("run.kids").alias("kid")]
    rows = rows.select("key", "block", "height", above.alias("path"), "subroot", *own)
    path = F.concat(_steps(F.col("levels"), F.col("kid.low"), _climbs(0)), F.col("path"))
    rank = F.col("block") * BLOCK + F.col("high") * FANOUT + F.col("kid.low")
    return rows.select("key", rank.alias("rank"), F.col("kid.digest").alias("digest"), F.col("kid.item").alias("item"), path.alias("path"), "subroot")


def _climbed(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of blocks, lowest first, until each key has one block."""
    rounds = []
    while True:
        rounds.append(stored(_rolled(nodes)))
        if not (rounds[-1].agg(F.max("block")).first()[0] or 0):
            return rounds
        height = F.greatest(F.col("height") - 2 * DIGIT, F.lit(0)).alias("height")
        nodes = rounds[-1].select("key", F.col("block").alias("rank"), height, "digest", F.lit(None).cast("string").alias("item"))


def _height(n: Column) -> Column:
    """Binary levels above n nodes. The logarithm of a power of two is rounded first, so that it isn't a hair too large."""
    return F.ceil(F.round(F.log2(n.cast("double")), 12)).cast("int")


def proofs(leaves: DataFrame, group: str, order: str, keep: list[str]) -> DataFrame:
    """(order, group, keep..., leaf, subroot, root, path) of each row of ``leaves``, which has a digest in its column ``leaf``.

    Leaves of a group ascend by ``order``, nulls first, equal ones by digest; while several nodes remain, every two consecutive ones
    become the digest of both and an odd last one the digest of itself. What remains is the group's subroot, a lone leaf itself.
    Subroots by group, null first and then in the order of UTF-8 bytes, give the root alike. path goes from the leaf to the root: the
    other node at each level (null where there is none) and whether the own one stands right of it. Repeated rows are leaves of their
    own. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0"))
    rows = stored(leaves.select(key.alias("key"), F.col(order).alias("place"), F.col("leaf").alias("digest"), F.struct(order, group, *keep).alias("item")))
    ranked = number_by_order(rows, ["key", "place", "digest"], "number")
    groups = stored(ranked.groupBy("key").agg(F.min("number").alias("first"), F.count("*").alias("n")))
    n_groups = groups.count()
    sizes = F.broadcast(groups) if n_groups <= FEW_GROUPS else groups
    nodes = ranked.join(sizes, "key").select("key", (F.col("number") - F.col("first")).alias("rank"), _height(F.col("n")).alias("height"), "digest", "item")
    inside = _climbed(nodes)

    subroots = inside[-1].select(F.col("key").alias("name"), "digest")
    top = number_by_order(subroots, ["name"], "rank").select(F.lit("").alias("key"), "rank", _height(F.lit(max(n_groups, 1))).alias("height"), "digest", F.col("name").alias("item"))
    above = _climbed(top)
    root = above[-1].select("digest").first()

    paths = above[-1].select("key", "block", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    for blocks in reversed(above):
        found = _unrolled(blocks, paths)
        paths = found.select("key", F.col("rank").alias("block"), "path", "subroot")
    paths = found.select(F.col("item").alias("key"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"))
    for blocks in reversed(inside):
        found = _unrolled(blocks, paths)
        paths = found.select("key", F.col("rank").alias("block"), "path", "subroot")
    return found.select("item.*", F.col("digest").alias("leaf"), "subroot", F.lit(root.digest if root else None).cast("string").alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    both = lambda own, s: F.when(s["right"], F.concat(F.coalesce(s["sibling"], F.lit("")), own)).otherwise(F.concat(own, F.coalesce(s["sibling"], F.lit(""))))
    return F.aggregate(path, leaf, lambda own, s: F.sha2(both(own, s), 256))


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(order, group, keep..., leaf, subroot, root, path) per row: each row's digest over its fields and its proof, see ``proofs``.

    Nulls are allowed in every field and hash as ``-``. Columns that are neither fields nor kept are not read.
    """
    own = docs.select(order, group, *[c for c in keep if c not in (order, group)], leaf_digest(*[F.col(c) for c in fields]).alias("leaf"))
    return proofs(own, group, order, [c for c in keep if c not in (order, group)])


def tampering_report(docs: DataFrame) -> DataFrame:
    """Proofs of documents and what they say of rows whose n_chars was raised by one after the manifest was made.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): rows with crc32 of the decimal doc_id divisible by 7 are
    altered unless n_chars or doc_id is null..
    """
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    columns = [F.col(c) for c in FIELDS]
    altered = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    own = docs.select("doc_id", "lang", leaf_digest(*columns).alias("leaf"), F.when(changed, leaf_digest(*altered)).alias("found"))
    rows = proofs(own, "lang", "doc_id", ["found"])
    siblings = F.transform(F.filter("path", lambda s: s["sibling"].isNotNull()), lambda s: s["sibling"])
    rows = rows.withColumn("folded_root", folded(F.coalesce("found", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
