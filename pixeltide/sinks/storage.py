"""File access inside tasks, on any filesystem Arrow knows; writes are temp-and-rename, so a retried task is harmless."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from urllib.parse import unquote

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and the path on it. Plain paths are taken as they are; file: URIs may be escaped; other URIs go to Arrow."""
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if local := re.match(r"file:(?://)?(?=/)", path):
        plain = path[local.end() :]
        # Spark escapes what it reports; a path that exists as written is not one of those.
        if "%" in plain and fs.LocalFileSystem().get_file_info(plain).type == fs.FileType.NotFound:
            plain = unquote(plain)
        return fs.LocalFileSystem(), plain
    return fs.FileSystem.from_uri(path)


def open_read(path: str):
    system, p = locate(path)
    return system.open_input_stream(p)


def exists(path: str) -> bool:
    system, p = locate(path)
    return system.get_file_info(p).type == fs.FileType.File


@contextmanager
def replacing(path: str):
    """Output stream that becomes ``path`` only when the block ends without an error."""
    system, p = locate(path)
    system.create_dir(p.rsplit("/", 1)[0], recursive=True)
    temp = f"{p}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(temp) as out:
            yield out
        system.move(temp, p)
    except BaseException:
        if system.get_file_info(temp).type == fs.FileType.File:
            system.delete_file(temp)
        raise
