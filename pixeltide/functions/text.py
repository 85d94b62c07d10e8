"""Names, stamps and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixeltide import constants as K
from pixeltide.functions.columns import col


def frame_stem(index, kind: str | Column = "frame") -> Column:
    """<kind>_%04d; indices from 10000 on take more digits."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.format_string("%s_%04d", k, col(index).cast("bigint"))


def sidecar_path(split, stem, suffix: str) -> Column:
    return F.concat(col(split), F.lit("/"), col(stem), F.lit(suffix))


def parse_stem(name, pattern: str = K.IMAGE_NAME_OPEN) -> dict[str, Column]:
    """kind and index of a frame file name; null where the pattern does not match."""
    hit = col(name).rlike(pattern)
    return {
        "kind": F.when(hit, F.regexp_extract(col(name), pattern, 1)),
        "index": F.when(hit, F.regexp_extract(col(name), pattern, 2).cast("bigint")),
    }


def dataset_id(root, timestamp_utc, argv, seed, job_kind) -> Column:
    """First 32 hex digits of SHA-256 over the newline-joined run description."""
    joined = F.concat_ws(
        "\n", col(root), col(timestamp_utc), col(argv), col(seed).cast("string"), col(job_kind)
    )
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 32)


def sha256_text(text) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def utc_stamp(ts) -> Column:
    """UTC ISO-8601 with whole seconds. The session time zone must be UTC or ts be NTZ."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def base_name(path) -> Column:
    """Part after the last slash or backslash."""
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)
