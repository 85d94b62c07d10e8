"""Files from DataFrames as a Spark data source: tasks stage what they write, the job's commit puts it in place, its abort removes it.

Nothing of a job that fails, and nothing that a lost or doubled attempt of a task has written, is ever seen under the target folder.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from pixeltide.sinks.storage import exists, locate, open_read

#: Moves that a commit has under way at once, and file names that it holds.
MOVERS, MOVES = 32, 10_000
#: Archive entry extension and file suffix, in archive order (fixed values).
ENTRIES = (("exr", "_spatial.exr"), ("json", "_meta.json"), ("png", ".png"), ("txt", ".txt"))


@dataclass
class Staged(WriterCommitMessage):
    """How many files one task has staged; their names lie beside its folder, so that no list of files travels to the driver."""

    folder: str
    n: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.base, self.job, self.compress = options["base"].rstrip("/"), options["job"], options.get("compress") == "true"

    @property
    def staging(self) -> str:
        return f"{self.base}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        folder, n = f"{self.staging}/{uuid.uuid4().hex}", 0
        system, p = locate(f"{folder}.names")
        system.create_dir(p.rpartition("/")[0], recursive=True)
        with system.open_output_stream(p, compression=None, buffer_size=1 << 16) as out:
            for name in self.written(iterator, folder):
                out.write(json.dumps(name).encode() + b"\n")
                n += 1
        return Staged(folder, n)

    def written(self, batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[str]:
        raise NotImplementedError

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = locate(self.base)

        def place(folder: str, names: list[str]) -> list[str]:
            """Moves staged files; gives back those that are new, if they are to be listed."""
            new = [name for name in names if self.lists_new and not exists(f"{self.base}/{name}")]
            for name in names:
                system.move(f"{folder}/{name}", f"{base}/{name}")
            return new

        fresh = []
        with ThreadPoolExecutor(MOVERS) as pool:
            for m in (m for m in messages if m is not None and m.n):
                folder = locate(m.folder)[1]
                with open_read(f"{m.folder}.names") as f:
                    names = (json.loads(line) for line in io.TextIOWrapper(io.BufferedReader(f), "utf-8"))
                    while part := list(islice(names, MOVES)):
                        for parent in {f"{base}/{name}".rpartition("/")[0] for name in part}:
                            system.create_dir(parent, recursive=True)
                        for new in pool.map(lambda k: place(folder, part[k::MOVERS]), range(MOVERS)):
                            fresh += new
        _, staging = locate(self.staging)
        system.create_dir(staging, recursive=True)
        with system.open_output_stream(f"{staging}/done.json") as out:
            out.write(json.dumps({"files": sum(m.n for m in messages if m is not None), "new": sorted(fresh)}).encode())

    lists_new = False

    def abort(self, messages: list[Staged | None]) -> None:
        _remove(self.staging)


def _remove(folder: str) -> None:
    system, p = locate(folder)
    if system.get_file_info(p).type == fs.FileType.Directory:
        system.delete_dir(p)


class TextWriter(_Writer):
    """Rows (path, content) in the order of path become files, each the concatenation of its rows; content is text or bytes."""

    def written(self, batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[str]:
        system, base = locate(folder)
        current, out = None, None
        with ExitStack() as stack:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if path != current:
                        stack.pop_all().close()
                        system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                        out = stack.enter_context(system.open_output_stream(f"{base}/{path}", compression=None))
                        current = path
                        yield path
                    out.write(content.encode("utf-8") if isinstance(content, str) else content)


class ShardWriter(_Writer):
    """Rows (shard, stem, folder) in the order of shard become tar files of the frames' parts, which the task opens itself."""

    lists_new = True

    def written(self, batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[str]:
        system, base = locate(folder)
        current, tar = None, None
        with ExitStack() as stack:
            for batch in batches:
                for shard, stem, source in zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True):
                    if shard != current:
                        stack.pop_all().close()
                        name = f"shard-{int(shard):06d}.tar{'.gz' if self.compress else ''}"
                        system.create_dir(base, recursive=True)
                        sink = stack.enter_context(system.open_output_stream(f"{base}/{name}", compression=None))
                        tar = stack.enter_context(tarfile.open(fileobj=sink, mode="w|gz" if self.compress else "w|"))
                        current = shard
                        yield name
                    for entry, suffix in ENTRIES:
                        if exists(f"{source}/{stem}{suffix}"):
                            with open_read(f"{source}/{stem}{suffix}") as f:
                                data = f.read()
                            info = tarfile.TarInfo(f"{stem}.{entry}")
                            info.size = len(data)
                            tar.addfile(info, io.BytesIO(data))


class Files(DataSource):
    """Options: base (target folder), job (a name of its own), kind (text or shards), compress."""

    @classmethod
    def name(cls) -> str:
        return "pixeltide_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return (ShardWriter if self.options.get("kind") == "shards" else TextWriter)(dict(self.options))


def write_files(rows: DataFrame, base: str, kind: str, compress: bool = False) -> dict:
    """Writes rows that lie in the order of their files, and says how many files there are and (of shards) which are new."""
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(Files)
    target = base.rstrip("/")
    writer = rows.write.format(Files.name()).mode("append").option("base", target).option("job", job).option("kind", kind)
    writer.option("compress", str(compress).lower()).save()
    # The commit runs in a process of its own and leaves what it has to say beside what it has put in place.
    with open_read(f"{target}/_staging-{job}/done.json") as f:
        done = json.loads(f.read())
    _remove(f"{target}/_staging-{job}")
    return done
