"""Row-format file sink with a rolling policy and a commit of its own.

Format "rolling": rows of one text column go to part files of bounded size. Tasks write
pending files; when all tasks of a batch are done, the driver gives the files their names,
which follow from batch, task and number. A batch that runs again replaces what it has
written, and nobody sees a part of a batch.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PENDING = "_pending"


@dataclass
class Parts(WriterCommitMessage):
    """Pending files of a task, in order, and its number."""

    task: int
    files: list[str] = field(default_factory=list)


class RollingSource(DataSource):
    """Options: path (in a file system that driver and executors share), prefix, suffix, maxbytes, maxrows, seconds.

    A part is closed when it has reached ``maxbytes`` (128 MB unless given) or ``maxrows``,
    or has been open for ``seconds``.
    """

    @classmethod
    def name(cls) -> str:
        return "rolling"

    def writer(self, schema: StructType, overwrite: bool) -> BatchParts:
        return BatchParts(schema, self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamParts:
        return StreamParts(schema, self.options, overwrite)


class _Parts:
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        if len(schema) != 1 or schema[0].dataType.typeName() not in ("string", "varchar", "char"):
            raise ValueError("rolling files take one text column")
        self.options, self.overwrite = dict(options), overwrite

    def place(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"]
        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def write(self, rows: Iterator) -> Parts:
        files, base = self.place()
        files.create_dir(f"{base}/{PENDING}", recursive=True)
        most_bytes, most_rows, most_s = int(self.options.get("maxbytes", 128 << 20)), int(self.options.get("maxrows", 1 << 62)), float(self.options.get("seconds", "inf"))
        out, n_bytes, n_rows, since = None, 0, 0, 0.0
        done = Parts(TaskContext.get().partitionId())
        try:
            for row in rows:
                if out is not None and (n_bytes >= most_bytes or n_rows >= most_rows or time.monotonic() - since >= most_s):
                    out.close()
                    out = None
                if out is None:
                    done.files.append(f"{base}/{PENDING}/{uuid.uuid4().hex}")
                    out, n_bytes, n_rows, since = files.open_output_stream(done.files[-1]), 0, 0, time.monotonic()
                line = (row[0] or "").encode() + b"\n"
                out.write(line)
                n_bytes, n_rows = n_bytes + len(line), n_rows + 1
        finally:
            if out is not None:
                out.close()
        return done

    def named(self, batch: int | str, messages: list[Parts | None]) -> None:
        """Second phase: the batch's earlier files go, the pending ones get their names."""
        files, base = self.place()
        start = f"{self.options.get('prefix', 'part')}-{batch}-"
        for old in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if old.base_name.startswith(start):
                files.delete_file(old.path)
        for m in messages:
            for k, file in enumerate(m.files if m else []):
                files.move(file, f"{base}/{start}{m.task:05}-{k:03}{self.options.get('suffix', '')}")

    def dropped(self, messages: list[Parts | None]) -> None:
        files, _ = self.place()
        for m in messages:
            for file in m.files if m else []:
                if files.get_file_info(file).type == fs.FileType.File:
                    files.delete_file(file)


class BatchParts(_Parts, DataSourceWriter):
    """A bounded write is one batch of its own; with overwrite, earlier parts go."""

    def commit(self, messages: list[Parts | None]) -> None:
        if self.overwrite:
            files, base = self.place()
            for old in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.type == fs.FileType.File:
                    files.delete_file(old.path)
        self.named(uuid.uuid4().hex[:8], messages)

    def abort(self, messages: list[Parts | None]) -> None:
        self.dropped(messages)


class StreamParts(_Parts, DataSourceStreamWriter):
    """Batches are named by their number."""

    def commit(self, messages: list[Parts | None], batchId: int) -> None:
        self.named(f"{batchId:06}", messages)

    def abort(self, messages: list[Parts | None], batchId: int) -> None:
        self.dropped(messages)
