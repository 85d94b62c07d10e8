"""Scene trees held as adjacency tables: world transforms, pre-order ids, asset references.

Node columns: scene keys, node_id, parent_id (null at a root), ord (position among its siblings), name, asset,
lx ly lz, rx ry rz (degrees), sx sy sz, grounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.operators import ordered
from pixeltide.operators.raster import Grid, raster_surface
from pixeltide.session import cut


#: World transform columns of walk().
WORLD = tuple(f"w{k}{a}" for k in ("", "r", "s") for a in "xyz")
# A node relative to a node above it: summed angles, multiplied scales, and the sums over the nodes in between (the node itself included) from
# which offsets follow: with v an offset scaled by all above it and t their yaw, of cos t vx, sin t vz, cos t vz, sin t vx and vy.
_SUMS = ("__cx", "__sz", "__cz", "__sx", "__y")
_RELATIVE = ("wrx", "wry", "wrz", "wsx", "wsy", "wsz", *_SUMS)


def _composed(low: str, high: str) -> dict[str, Column]:
    """Node relative to an ancestor's ancestor: its own part (prefix low) under that of the ancestor (prefix high)."""
    a, b = (lambda n: F.col(f"{low}{n}")), (lambda n: F.col(f"{high}{n}"))
    c, s = F.cos(F.radians(b("wry"))), F.sin(F.radians(b("wry")))
    return {
        **{f"wr{x}": b(f"wr{x}") + a(f"wr{x}") for x in "xyz"},
        **{f"ws{x}": b(f"ws{x}") * a(f"ws{x}") for x in "xyz"},
        "__cx": b("__cx") + b("wsx") * (c * a("__cx") - s * a("__sx")),
        "__sx": b("__sx") + b("wsx") * (s * a("__cx") + c * a("__sx")),
        "__cz": b("__cz") + b("wsz") * (c * a("__cz") - s * a("__sz")),
        "__sz": b("__sz") + b("wsz") * (s * a("__cz") + c * a("__sz")),
        "__y": b("__y") + b("wsy") * a("__y"),
    }


def walk(nodes: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Adds depth, path (sibling positions from the root), world transform w*, and anchor_id.

    Offsets turn with the yaw of what stands above and scale with its scales, angles add, scales multiply; anchor_id is the nearest
    grounded node on the way up (itself included). Pointers double: after k rounds a node knows itself relative to its 2**k-th
    ancestor, so a tree of depth d takes log2(d) rounds, each one join of the nodes that have not reached their root, and a
    checkpoint. A node with very many children only skews one join side, which adaptive execution splits. Nodes that no root
    leads to (unknown parent, or a cycle) have no row.
    """
    keys = list(keys)
    own = nodes.select(
        *keys, "node_id", F.col("parent_id").alias("__up"), F.lit(0).alias("depth"), F.array(F.col("ord").cast("int")).alias("path"),
        F.when(F.col("grounded"), F.col("node_id")).alias("anchor_id"),
        *[F.col(f"r{a}").cast("double").alias(f"wr{a}") for a in "xyz"], *[F.col(f"s{a}").cast("double").alias(f"ws{a}") for a in "xyz"],
        F.col("lx").cast("double").alias("__cx"), F.lit(0.0).alias("__sz"), F.col("lz").cast("double").alias("__cz"), F.lit(0.0).alias("__sx"),
        F.col("ly").cast("double").alias("__y"),
    )
    own = own.withColumn("depth", F.when(F.col("__up").isNull(), 0).otherwise(1))
    active, done, reach, most = cut(own), None, 1, None
    while True:
        ended = active.filter(F.col("__up").isNull())
        done = ended if done is None else done.unionByName(ended)
        left = active.filter(F.col("__up").isNotNull())
        if left.isEmpty():
            break
        most = active.count() if most is None else most
        if reach > most:  # a way up that is longer than there are nodes is a cycle
            break
        told = ["__up", "depth", "path", "anchor_id", *_RELATIVE]
        above = done.unionByName(left).select(*[F.col(k).alias(f"__p_{k}") for k in keys], F.col("node_id").alias("__p_node"), *[F.col(c).alias(f"__p_{c}") for c in told])
        on = F.col("__up") == F.col("__p_node")
        for k in keys:
            on = on & (F.col(k) == F.col(f"__p_{k}"))
        met = left.join(above, on).select(
            *keys, "node_id", F.col("__p___up").alias("__up"), (F.col("depth") + F.col("__p_depth")).alias("depth"), F.concat("__p_path", "path").alias("path"),
            F.coalesce("anchor_id", "__p_anchor_id").alias("anchor_id"), *[e.alias(n) for n, e in _composed("", "__p_").items()],
        )
        active, reach = cut(met), reach * 2
    placed = done.select(
        *keys, "node_id", "depth", "path", "anchor_id", (F.col("__cx") + F.col("__sz")).alias("wx"), F.col("__y").alias("wy"), (F.col("__cz") - F.col("__sx")).alias("wz"), *WORLD[3:]
    )
    # Columns of the nodes that are named like a new one are replaced.
    added = ["depth", "path", "anchor_id", *WORLD]
    own = nodes.drop(*added)
    return own.join(placed, [*keys, "node_id"]).select(*own.columns, *added)


def unreached(nodes: DataFrame, walked: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Nodes no root leads to (unknown parent, or a cycle). walk() has no row for them."""
    ids = [*keys, "node_id"]
    return nodes.join(walked.select(*ids), ids, "left_anti")


def ground(walked: DataFrame, raster: DataFrame, grid: Grid, keys: Sequence[str] = ("scene_id",), grid_keys: Sequence[str] = ()) -> DataFrame:
    """Puts grounded nodes on the height field and shifts their subtrees; adds the normal (tnx, tny, tnz).

    The shift of a node is the height minus raw y of its nearest grounded ancestor: x and z do not depend on y, so
    heights and normals are taken once for all grounded nodes and handed down by one join.
    """
    keys, ids = list(keys), [*keys, "node_id"]
    anchors = walked.filter("grounded").select(*dict.fromkeys([*ids, *grid_keys]), F.col("wx").alias("x"), F.col("wz").alias("z"), "wy")
    found = raster_surface(anchors, raster, grid, grid_keys)
    shift = found.select(*keys, F.col("node_id").alias("anchor_id"), (F.col("height") - F.col("wy")).alias("__dy"), "nx", "ny", "nz")
    out = walked.join(shift, [*keys, "anchor_id"], "left")
    own = F.col("grounded")
    return out.withColumns(
        {
            "wy": F.col("wy") + F.coalesce("__dy", F.lit(0.0)),
            "tnx": F.when(own, F.col("nx")).otherwise(F.lit(0.0)),
            "tny": F.when(own, F.col("ny")).otherwise(F.lit(1.0)),
            "tnz": F.when(own, F.col("nz")).otherwise(F.lit(0.0)),
        }
    ).drop("__dy", "nx", "ny", "nz")


def preorder_ids(walked: DataFrame, keys: Sequence[str] = ("scene_id",), has_object: Column | None = None) -> DataFrame:
    """instance_id 1, 2, ... in pre-order over the nodes that carry an object."""
    has_object = (F.coalesce(F.col("asset"), F.lit("")) != "") if has_object is None else has_object
    return ordered.number_by_order(walked.filter(has_object), [*keys, "path"], "instance_id", start=1, within=list(keys))


def node_path(path: Column | str = "path", prefix: str = "") -> Column:
    """root_nodes[i].children[j]... of a path array."""
    p = F.col(path) if isinstance(path, str) else path
    head = F.concat(F.lit(f"{prefix}root_nodes["), F.element_at(p, 1).cast("string"), F.lit("]"))
    tail = F.transform(F.slice(p, 2, F.size(p)), lambda o: F.concat(F.lit(".children["), o.cast("string"), F.lit("]")))
    return F.concat(head, F.array_join(tail, ""))


def unknown_asset_refs(nodes: DataFrame, assets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes naming an asset that is not defined."""
    named = nodes.filter(F.coalesce(F.col("asset"), F.lit("")) != "")
    known = assets.select(*keys, F.col("name").alias("asset")).distinct()
    return named.join(known, [*keys, "asset"], "left_anti")


def asset_lookup(
    nodes: DataFrame, assets: DataFrame, payload: Sequence[str] = ("roughness", "metallic"), keys: Sequence[str] = (),
    defaults: Sequence[float] = (0.5, 0.0), order: str = "asset_ord",
) -> DataFrame:
    """Material of each node by label, or by name where it has none; first matching asset wins."""
    first = assets.groupBy(*keys, "name").agg(F.min_by(F.struct(*payload), F.col(order)).alias("__m"))
    lookup = first.select(*keys, F.col("name").alias("__name"), *[F.col(f"__m.{p}").alias(p) for p in payload])
    key = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("name"))
    out = nodes.withColumn("__name", key).join(lookup, [*keys, "__name"], "left").drop("__name")
    return out.withColumns({p: F.coalesce(F.col(p), F.lit(d)) for p, d in zip(payload, defaults)})
