"""Many files from one DataFrame: rows (path, order..., text) become files, each the concatenation of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.sinks.filesource import write_files


def write_text_files(rows: DataFrame, base: str, order: Sequence[str], path: str = "path", text: str = "text") -> int:
    """Writes <base>/<path> files of text or bytes; returns how many.

    Files are spread over tasks by path and streamed: a task holds one Arrow batch, whatever the size of a file. They appear when all
    are written, or not at all.
    """
    placed = rows.select(path, *order, text).repartition(F.col(path)).sortWithinPartitions(path, *order).select(path, text)
    return write_files(placed, base, "text")["files"]
