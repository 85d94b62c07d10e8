"""World configurations as a table (config_id, doc): key lint, semantic lint, asset catalogue, resolved form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.functions import jsonfn as J
from pixeltide.functions.text import base_name
from pixeltide.session import cut, spread

# Keys each object may carry (fixed values).
ALLOWED_KEYS = {
    "root": ["render", "camera", "lighting", "terrain", "assets", "asset", "hdr", "placement", "dataset", "scenarios"],
    "render": ["width", "height", "spp", "max_depth", "exposure", "sky_gain", "preview", "seed"],
    "camera": ["lookat", "up", "lookfrom", "fov_deg", "trajectory"],
    "keyframe": ["t", "pos"],
    "lighting": ["sun_azimuth_deg", "sun_elevation_deg"],
    "terrain": ["amp", "scale", "nx", "nz", "bounds", "xmin", "xmax", "zmin", "zmax"],
    "bounds": ["xmin", "xmax", "zmin", "zmax"],
    "asset": [
        "name", "path", "weight", "scale", "color", "label", "class_id", "y_offset", "roughness", "metallic",
        "albedo_map", "normal_map", "roughness_map", "metallic_map",
    ],
    "hdr": ["path", "intensity"],
    "placement": ["x", "z", "yaw_deg"],
    "dataset": ["root", "train_split"],
    "scenario": ["name", "camera", "root_nodes"],
    "node": ["name", "asset", "position", "rotation", "scale", "grounding_constraint", "y_offset", "children"],
    "range": ["min", "max"],
}

# Old asset keys and what replaces them (fixed values).
DEPRECATED_ASSET_KEYS = {
    "obj": "path",
    "albedo_path": "albedo_map",
    "normal_path": "normal_map",
    "roughness_path": "roughness_map",
    "metallic_path": "metallic_map",
}

# Fields holding a number or a {min, max} range, per object.
RANGE_FIELDS = {
    "camera": ["fov_deg"],
    "lighting": ["sun_azimuth_deg", "sun_elevation_deg"],
    "asset": ["roughness", "metallic"],
    "placement": ["x", "z", "yaw_deg"],
}

# Defaults of a resolved configuration (fixed values).
DEFAULT_RENDER = {
    "width": 1280, "height": 720, "spp": 24, "max_depth": 10, "exposure": 6.5, "sky_gain": 45.0, "preview": False, "seed": 1337,
}
DEFAULT_CAMERA = {"lookat": [0.0, 1.2, 0.0], "up": [0.0, 1.0, 0.0], "lookfrom": [18.0, 8.0, 24.0], "fov_deg": 35.0}
DEFAULT_LIGHTING = {"sun_azimuth_deg": (300.0, 300.0), "sun_elevation_deg": (12.0, 12.0)}
DEFAULT_TERRAIN = {"xmin": -22.0, "xmax": 22.0, "zmin": -22.0, "zmax": 22.0, "amp": 1.8, "scale": 0.14, "nx": 96, "nz": 96}
DEFAULT_PLACEMENT = {"x": (-18.0, 18.0), "z": (-18.0, 18.0), "yaw_deg": (0.0, 360.0)}
DEFAULT_DATASET_ROOT, DEFAULT_TRAIN_SPLIT = "dataset", 0.8
DEFAULT_GROUND_SCALE = 2.0

def _doc() -> Column:
    return F.col("__v")


def parsed(configs: DataFrame) -> DataFrame:
    """Adds __v. Reading a document is work, and many fit into one split of a table: they are spread first, and shuffled once for all
    that is read from them."""
    return configs.repartition(spread(configs.sparkSession)).withColumn("__v", J.parse("doc"))


def _obj(path: Column | str, kind: str, v: Column) -> Column:
    p = F.lit(path) if isinstance(path, str) else path
    return F.struct(p.alias("path"), F.lit(kind).alias("kind"), v.alias("v"))


def _indexed(items: Column, prefix: Column | str, kind: str) -> Column:
    """Objects of an array variant, with [i] paths; empty where it is no array."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    made = F.transform(items, lambda x, i: _obj(F.concat(p, F.lit("["), i.cast("string"), F.lit("]")), kind, x))
    return F.coalesce(made, F.array().cast("array<struct<path:string,kind:string,v:variant>>"))


def asset_items(v: Column) -> Column:
    """assets[], or the single legacy asset where assets is no array."""
    listed, single = J.field(v, "assets"), J.field(v, "asset")
    return F.when(J.is_array(listed), J.items(listed)).when(single.isNotNull(), F.array(single))


def config_objects(configs: DataFrame) -> DataFrame:
    """Every known object of each configuration: config_id, path, kind, v.

    All but scene nodes come from one explode per document. Nodes nest freely, so they are unfolded level by level;
    a level is checkpointed before the next is built from it.
    """
    c = parsed(configs)
    fixed = [_obj("", "root", _doc())]
    fixed += [_obj(k, k, J.field(_doc(), k)) for k in ("render", "camera", "lighting", "terrain", "placement", "dataset")]
    fixed.append(_obj("terrain.bounds", "bounds", J.field(J.field(_doc(), "terrain"), "bounds")))
    hdr = J.field(_doc(), "hdr")
    fixed.append(_obj("hdr", "hdr", F.when(J.is_object(hdr), hdr)))
    listed = J.field(_doc(), "assets")
    assets = F.when(J.is_array(listed), _indexed(J.items(listed), "assets", "asset")).otherwise(F.array(_obj("asset", "asset", J.field(_doc(), "asset"))))
    scenarios = _indexed(J.items(J.field(_doc(), "scenarios")), "scenarios", "scenario")
    cameras = F.transform(scenarios, lambda s: _obj(F.concat(s["path"], F.lit(".camera")), "camera", J.field(s["v"], "camera")))
    frames = _indexed(J.items(J.field(J.field(_doc(), "camera"), "trajectory")), "camera.trajectory", "keyframe")
    more_frames = F.flatten(F.transform(cameras, lambda k: _indexed(J.items(J.field(k["v"], "trajectory")), F.concat(k["path"], F.lit(".trajectory")), "keyframe")))
    roots = F.flatten(F.transform(scenarios, lambda s: _indexed(J.items(J.field(s["v"], "root_nodes")), F.concat(s["path"], F.lit(".root_nodes")), "node")))
    every = F.concat(F.array(*fixed), assets, scenarios, cameras, frames, more_frames)
    flat = c.select("config_id", F.explode(every).alias("o")).select("config_id", "o.*").filter(F.col("v").isNotNull())
    # Range objects are listed next to the object they belong to, in the same pass.
    v = F.col("v")
    spans = [
        F.when(
            (F.col("kind") == kind) & J.is_object(J.field(v, name)),
            _obj(F.concat_ws(".", F.nullif("path", F.lit("")), F.lit(name)), "range", J.field(v, name)),
        )
        for kind, names in [*RANGE_FIELDS.items(), ("camera", ["lookfrom"])] for name in names
    ]
    own = F.struct("path", "kind", "v")
    flat = flat.select("config_id", F.explode_outer(F.filter(F.array(own, *spans), lambda o: o.isNotNull())).alias("o")).filter(F.col("o").isNotNull()).select("config_id", "o.*")
    level = cut(c.select("config_id", F.explode(roots).alias("o")).select("config_id", "o.*"))
    while not level.isEmpty():
        flat = flat.unionByName(level)
        kids = level.select("config_id", F.explode(_indexed(J.items(J.field(F.col("v"), "children")), F.concat("path", F.lit(".children")), "node")).alias("o"))
        level = cut(kids.select("config_id", "o.*"))
    return flat


def scene_nodes(objects: DataFrame) -> DataFrame:
    """Scene nodes of all scenarios (of config_objects) as operators.tree takes them, keyed by config_id and scenario.

    node_id is a hash of the node's place in the document, parent_id that of its parent's (null for a root), ord its position
    among its siblings. Scales are a number or three; position and rotation default to 0, scale to 1. A member of the wrong type reads as its
    default and is what ``lint`` reports.
    """
    v = F.col("v")
    rows = objects.filter((F.col("kind") == "node") & J.is_object(v))
    parent = F.regexp_extract("path", r"^(.*)\.children\[\d+\]$", 1)
    factor = J.number(J.field(v, "scale"))
    scale = F.coalesce(J.vec3(J.field(v, "scale")), F.when(factor.isNotNull(), F.array(factor, factor, factor)), F.array(*[F.lit(1.0)] * 3))
    rows = rows.withColumns(
        {
            "__p": _vec_or(J.field(v, "position"), [0.0] * 3), "__r": _vec_or(J.field(v, "rotation"), [0.0] * 3), "__s": scale,
            "name": F.coalesce(J.text_of(J.field(v, "name")), F.lit("")), "asset": F.coalesce(J.text_of(J.field(v, "asset")), F.lit("")),
            "grounded": F.coalesce(F.try_variant_get(J.field(v, "grounding_constraint"), "$", "boolean"), F.lit(False)),
            "y_offset": F.coalesce(J.number(J.field(v, "y_offset")), F.lit(0.0)),
        }
    )
    return rows.select(
        "config_id",
        F.regexp_extract("path", r"^scenarios\[(\d+)\]", 1).cast("int").alias("scenario"),
        F.xxhash64("path").alias("node_id"),
        F.when(parent != "", F.xxhash64(parent)).alias("parent_id"),
        F.regexp_extract("path", r"\[(\d+)\]$", 1).cast("int").alias("ord"),
        "path", "name", "asset", *[F.col(f"__{g}")[i].alias(f"{n}{a}") for g, n in (("p", "l"), ("r", "r"), ("s", "s")) for i, a in enumerate("xyz")],
        "grounded", "y_offset",
    )


def config_keyframes(resolved: DataFrame) -> DataFrame:
    """(config_id, scenario, pos, t, px, py, pz): camera keyframes of resolved configurations in time order.

    scenario is null for the configuration's own camera; a scenario without keyframes of its own has those.
    """
    tracks = F.concat(
        F.array(F.struct(F.lit(None).cast("int").alias("scenario"), F.col("camera.trajectory").alias("track"))),
        F.coalesce(
            F.transform("scenarios", lambda s, i: F.struct(i.cast("int").alias("scenario"), s["camera"]["trajectory"].alias("track"))),
            F.array().cast("array<struct<scenario:int,track:array<struct<t:double,ord:int,pos:array<double>>>>>"),
        ),
    )
    rows = resolved.select("config_id", F.explode(tracks).alias("k")).select("config_id", "k.scenario", F.posexplode("k.track").alias("pos", "f"))
    return rows.select("config_id", "scenario", "pos", "f.t", *[F.col("f.pos")[i].alias(f"p{a}") for i, a in enumerate("xyz")])


def config_keys(objects: DataFrame) -> DataFrame:
    """(config_id, path, kind, key) of every known object."""
    keys = F.json_object_keys(F.to_json("v"))
    return objects.filter(J.is_object(F.col("v"))).select("config_id", "path", "kind", F.explode(keys).alias("key"))


def _lint(df: DataFrame, code: str, path: Column, severity: str = "error") -> DataFrame:
    return df.select("config_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.alias("path"))


def key_lint(keys: DataFrame, strict: bool = True) -> DataFrame:
    """unknown_key, and deprecated_key (an error when strict, else a warning)."""
    allowed = F.lit(False)
    for kind, names in ALLOWED_KEYS.items():
        allowed = allowed | ((F.col("kind") == kind) & F.col("key").isin(names))
    old = (F.col("kind") == "asset") & F.col("key").isin(list(DEPRECATED_ASSET_KEYS))
    odd = keys.filter(~allowed & (F.lit(strict) | (F.col("kind") != "range")))
    path = F.concat_ws(".", F.nullif("path", F.lit("")), "key")
    return odd.select(
        "config_id",
        F.when(old & F.lit(not strict), F.lit("warning")).otherwise(F.lit("error")).alias("severity"),
        F.when(old, F.lit("deprecated_key")).otherwise(F.lit("unknown_key")).alias("code"),
        path.alias("path"),
    )


def asset_catalog(configs: DataFrame, strict: bool = True) -> DataFrame:
    """One row per asset entry. Names default to the file name, labels to the name, then 'model'."""
    a = F.col("a")
    rows = parsed(configs).select("config_id", F.posexplode(asset_items(_doc())).alias("asset_ord", "a"))

    def text(key: str, old: str | None = None) -> Column:
        value = J.text_of(J.field(a, key))
        return F.coalesce(value, J.text_of(J.field(a, old))) if old and not strict else value

    def num(key: str, default: float) -> Column:
        return F.coalesce(J.number(J.field(a, key)), F.lit(default))

    def spread(key: str, default: float) -> Column:
        d = F.struct(F.lit(default).alias("min"), F.lit(default).alias("max"))
        return F.coalesce(J.scalar_range(J.field(a, key)), d)

    out = rows.select(
        "config_id", F.col("asset_ord").cast("int").alias("asset_ord"),
        text("name").alias("name"), F.coalesce(text("path", "obj"), F.lit("")).alias("path"),
        num("weight", 1.0).alias("weight"), num("scale", 1.0).alias("scale"),
        F.coalesce(text("color"), F.lit("white")).alias("color"), text("label").alias("label"),
        num("class_id", 2).cast("bigint").alias("class_id"), num("y_offset", 0.0).alias("y_offset"),
        spread("roughness", 0.5).alias("roughness"), spread("metallic", 0.0).alias("metallic"),
        *[F.coalesce(text(f"{m}_map", f"{m}_path"), F.lit("")).alias(f"{m}_map") for m in ("albedo", "normal", "roughness", "metallic")],
    )
    name = F.coalesce(F.nullif("name", F.lit("")), base_name("path"))
    out = out.withColumn("name", name)
    return out.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.nullif("name", F.lit("")), F.lit("model")))


def _found(code: str, cond: Column, path: Column) -> Column:
    return F.when(cond, F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code"), path.alias("path")))


def _emit(df: DataFrame, found: list[Column]) -> DataFrame:
    # Nulls go before the explode, which else makes a row of every check; the outer one keeps the checks from being evaluated twice.
    rows = df.select("config_id", F.explode_outer(F.filter(F.array(*found), lambda i: i.isNotNull())).alias("i")).filter(F.col("i").isNotNull())
    return rows.select("config_id", "i.*")


def _is_scale(v: Column) -> Column:
    return J.is_number(v) | J.vec3(v).isNotNull()


def _is_vec3(v: Column) -> Column:
    return J.vec3(v).isNotNull()


_NUMBER, _TEXT, _FLAG, _VECTOR = ("number", J.is_number), ("text", J.is_string), ("boolean", J.is_bool), ("vector", _is_vec3)
# Members that hold one plain value, by the object they stand in (ranges and references are checked on their own).
SCALAR_TYPES = {
    "render": {k: _NUMBER for k in ("width", "height", "spp", "max_depth", "exposure", "sky_gain", "seed")} | {"preview": _FLAG},
    "terrain": {k: _NUMBER for k in ("amp", "scale", "nx", "nz", "xmin", "xmax", "zmin", "zmax")},
    "bounds": {k: _NUMBER for k in ("xmin", "xmax", "zmin", "zmax")},
    "asset": {k: _NUMBER for k in ("weight", "scale", "class_id", "y_offset")}
    | {k: _TEXT for k in ("name", "path", "color", "label", "albedo_map", "normal_map", "roughness_map", "metallic_map")},
    "hdr": {"path": _TEXT, "intensity": _NUMBER},
    "dataset": {"root": _TEXT, "train_split": _NUMBER},
    "node": {"name": _TEXT, "asset": _TEXT, "position": _VECTOR, "rotation": _VECTOR, "scale": ("number or vector", _is_scale), "y_offset": _NUMBER, "grounding_constraint": _FLAG},
}


def semantic_lint(configs: DataFrame, objects: DataFrame, strict: bool = True) -> DataFrame:
    """Everything but key spelling: documents, types, ranges, assets, references, names, environment, trajectories.

    One pass over the documents, one over their objects, and an anti-join for asset references.
    """
    v, path, kind = F.col("v"), F.col("path"), F.col("kind")

    def sub(name: str) -> Column:
        return F.concat_ws(".", F.nullif(path, F.lit("")), F.lit(name))

    objects = objects.withColumn("__ok", J.is_object(v))
    ok = F.col("__ok")
    per_object = [_found("not_object", ~ok, path)]
    for k, names in RANGE_FIELDS.items():
        for n in names:
            per_object.append(_found("bad_range", (kind == k) & J.field(v, n).isNotNull() & J.scalar_range(J.field(v, n)).isNull(), sub(n)))
    for n, read in (("lookat", J.vec3), ("up", J.vec3), ("lookfrom", J.vec3_range)):
        per_object.append(_found("bad_range", (kind == "camera") & J.field(v, n).isNotNull() & read(J.field(v, n)).isNull(), sub(n)))
    for k, kinds in SCALAR_TYPES.items():
        for n, (what, good) in kinds.items():
            per_object.append(_found("bad_type", (kind == k) & ok & J.field(v, n).isNotNull() & ~F.coalesce(good(J.field(v, n)), F.lit(False)), sub(n)))
    track = J.field(v, "trajectory")
    per_object.append(_found("bad_trajectory", (kind == "camera") & track.isNotNull() & ~J.is_array(track), sub("trajectory")))
    no_time = ~J.is_number(J.field(v, "t")) | J.vec3(J.field(v, "pos")).isNull()
    per_object.append(_found("bad_trajectory", (kind == "keyframe") & ok & no_time, path))
    unnamed = F.coalesce(J.text_of(J.field(v, "name")), F.lit("")) == ""
    per_object.append(_found("missing_name", (kind == "scenario") & ok & unnamed, sub("name")))

    doc, hdr = _doc(), J.field(_doc(), "hdr")
    items = asset_items(doc)
    first = F.get(items, F.lit(0))
    mesh = J.text_of(J.field(first, "path")) if strict else F.coalesce(J.text_of(J.field(first, "path")), J.text_of(J.field(first, "obj")))
    lacking = F.coalesce(F.size(items) < 1, F.lit(True)) | (F.coalesce(mesh, F.lit("")) == "")
    per_doc = [
        _found("config_json", doc.isNull(), F.lit("")),
        _found("bad_hdr", hdr.isNotNull() & ~J.is_string(hdr) & ~J.is_object(hdr), F.lit("hdr")),
        _found("missing_asset", J.is_object(doc) & lacking, F.lit("assets")),
    ]
    named = objects.filter(kind == "node").withColumn("name", J.text_of(J.field(v, "asset")))
    named = named.filter(F.coalesce("name", F.lit("")) != "")
    known = asset_catalog(configs, strict).select("config_id", "name").distinct()
    unknown = _lint(named.join(known, ["config_id", "name"], "left_anti"), "unknown_asset", F.concat("path", F.lit(".asset")))
    return _emit(objects, per_object).unionByName(_emit(parsed(configs), per_doc)).unionByName(unknown)


def lint(configs: DataFrame, strict: bool = True) -> DataFrame:
    objects = config_objects(configs)
    return key_lint(config_keys(objects), strict).unionByName(semantic_lint(configs, objects, strict))


def _range_or(v: Column, lo: float, hi: float) -> Column:
    return F.coalesce(J.scalar_range(v), F.struct(F.lit(lo).alias("min"), F.lit(hi).alias("max")))


def _vec_or(v: Column, default) -> Column:
    return F.coalesce(J.vec3(v), default if isinstance(default, Column) else F.array(*[F.lit(x) for x in default]))


def _camera(cam: Column, base: Column | None) -> Column:
    """Camera with defaults, or with another camera's values where fields are absent. Keyframes are stably sorted by t."""
    d = DEFAULT_CAMERA
    start = F.array(*[F.lit(x) for x in d["lookfrom"]])
    b = base if base is not None else F.struct(
        F.array(*[F.lit(x) for x in d["lookat"]]).alias("lookat"), F.array(*[F.lit(x) for x in d["up"]]).alias("up"),
        F.struct(start.alias("min"), start.alias("max")).alias("lookfrom"),
        F.struct(F.lit(d["fov_deg"]).alias("min"), F.lit(d["fov_deg"]).alias("max")).alias("fov_deg"),
        F.array().cast("array<struct<t:double,ord:int,pos:array<double>>>").alias("trajectory"),
    )
    keyframes = F.array_sort(
        F.transform(
            J.items(J.field(cam, "trajectory")),
            lambda k, i: F.struct(J.number(J.field(k, "t")).alias("t"), i.cast("int").alias("ord"), J.vec3(J.field(k, "pos")).alias("pos")),
        )
    )
    return F.struct(
        _vec_or(J.field(cam, "lookat"), b["lookat"]).alias("lookat"),
        _vec_or(J.field(cam, "up"), b["up"]).alias("up"),
        F.coalesce(J.vec3_range(J.field(cam, "lookfrom")), b["lookfrom"]).alias("lookfrom"),
        F.coalesce(J.scalar_range(J.field(cam, "fov_deg")), b["fov_deg"]).alias("fov_deg"),
        F.coalesce(keyframes, b["trajectory"]).alias("trajectory"),
    )


def resolve_config(configs: DataFrame) -> DataFrame:
    """Typed configuration with all defaults filled, one row per document that parses.

    Scenario cameras inherit the root camera; flat terrain bounds win over nested ones; the split is clamped.
    """
    c = parsed(configs).filter(J.is_object(_doc()))

    def fill(parent: Column, defaults: dict) -> Column:
        cols = []
        for k, d in defaults.items():
            value = J.field(parent, k)
            if isinstance(d, bool):
                got = F.try_variant_get(value, "$", "boolean")
            elif isinstance(d, int):
                got = F.try_variant_get(value, "$", "bigint")
            else:
                got = J.number(value)
            cols.append(F.coalesce(got, F.lit(d).cast("bigint") if isinstance(d, int) and not isinstance(d, bool) else F.lit(d)).alias(k))
        return F.struct(*cols)

    terrain, nested = J.field(_doc(), "terrain"), J.field(J.field(_doc(), "terrain"), "bounds")
    edges = [
        F.coalesce(J.number(J.field(terrain, k)), J.number(J.field(nested, k)), F.lit(DEFAULT_TERRAIN[k])).alias(k)
        for k in ("xmin", "xmax", "zmin", "zmax")
    ]
    rest = {k: DEFAULT_TERRAIN[k] for k in ("amp", "scale", "nx", "nz")}
    light, place, data = (J.field(_doc(), k) for k in ("lighting", "placement", "dataset"))
    hdr = J.field(_doc(), "hdr")
    split = F.coalesce(J.number(J.field(data, "train_split")), F.lit(DEFAULT_TRAIN_SPLIT))
    c = c.withColumns(
        {
            "render": fill(J.field(_doc(), "render"), DEFAULT_RENDER),
            "camera": _camera(J.field(_doc(), "camera"), None),
            "lighting": F.struct(*[_range_or(J.field(light, k), *d).alias(k) for k, d in DEFAULT_LIGHTING.items()]),
            "__rest": fill(terrain, rest),
            "hdr_path": F.coalesce(J.text_of(hdr), J.text_of(J.field(hdr, "path")), F.lit("")),
            "hdr_intensity": F.coalesce(J.number(J.field(hdr, "intensity")), F.lit(1.0)),
            "ground_tex": F.lit(""), "ground_scale": F.lit(DEFAULT_GROUND_SCALE),
            "placement": F.struct(*[_range_or(J.field(place, k), *d).alias(k) for k, d in DEFAULT_PLACEMENT.items()]),
            "dataset_root": F.coalesce(J.text_of(J.field(data, "root")), F.lit(DEFAULT_DATASET_ROOT)),
            "train_split": F.greatest(F.lit(0.0), F.least(F.lit(1.0), split)),
        }
    )
    c = c.withColumn("terrain", F.struct(*edges, "__rest.amp", "__rest.scale", "__rest.nx", "__rest.nz"))
    scenarios = F.transform(
        J.items(J.field(_doc(), "scenarios")),
        lambda s: F.struct(J.text_of(J.field(s, "name")).alias("name"), _camera(J.field(s, "camera"), F.col("camera")).alias("camera")),
    )
    c = c.withColumn("scenarios", scenarios)
    return c.select(
        "config_id", "render", "camera", "lighting", "terrain", "hdr_path", "hdr_intensity", "ground_tex", "ground_scale",
        "placement", "dataset_root", "train_split", "scenarios",
    )


def resolved_json(resolved: DataFrame) -> DataFrame:
    """Adds resolved_config (JSON text, keys in alphabetical order) and its SHA-256.

    Assets and scene trees live in their own tables and are not repeated in the text.
    """
    doc = F.to_json(
        F.struct(
            "camera", F.struct(F.col("dataset_root").alias("root"), "train_split").alias("dataset"), "ground_scale", "ground_tex",
            F.struct(F.col("hdr_intensity").alias("intensity"), F.col("hdr_path").alias("path")).alias("hdr"),
            "lighting", "placement", "render", "scenarios", "terrain",
        )
    )
    out = resolved.withColumn("resolved_config", doc)
    return out.withColumn("resolved_config_sha256", F.sha2(F.col("resolved_config").cast("binary"), 256))
