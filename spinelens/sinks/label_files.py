"""Label text files, one per image stem, streamed from sorted partitions.

Lines are range-partitioned by stem and line number, so a stem with very many lines is sorted by
several tasks. A task streams its lines: stems that lie wholly inside it become finished files, its
first and last stem, which other tasks may share, become parts. The commit lists the parts, a small
job joins those of each stem, and the finished directory is renamed into place at the end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from spinelens.sources.storage import importable, opened

#: Bytes copied at a time when parts are joined.
COPY = 8 << 20


@dataclass
class Parts(WriterCommitMessage):
    """First and last stem of a task with their part files: (stem, file, lines)."""

    partition: int
    parts: list[tuple[str, str, int]]
    files: int


class _Open:
    """A file being written under a temporary name."""

    def __init__(self, system: fs.FileSystem, name: str, stem: str):
        self.system, self.name, self.stem, self.lines = system, name, stem, 0
        self.stream = system.open_output_stream(name)

    def add(self, line: str | None) -> None:
        if line is not None:
            self.stream.write(("\n" if self.lines else "").encode() + line.encode())
            self.lines += 1


class LabelFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.path)
        context = TaskContext.get()
        task = f"{context.partitionId():07d}-{context.taskAttemptId()}"
        parts: list[tuple[str, str, int]] = []
        now: _Open | None = None
        count = 0
        for folder in ("files", "parts"):
            system.create_dir(f"{root}/{folder}")

        def close(last: bool) -> None:
            nonlocal count
            now.stream.close()
            if last or not parts:
                parts.append((now.stem, now.name.removeprefix(f"{root}/"), now.lines))
            else:
                system.move(now.name, f"{root}/files/{now.stem}.txt")
                count += 1

        number = 0
        for batch in iterator:
            for stem, line in zip(batch.column("stem").to_pylist(), batch.column("line").to_pylist()):
                if now is None or stem != now.stem:
                    if not stem or "/" in stem or "\0" in stem:
                        raise ValueError(f"no file can be named {stem!r}")
                    if now is not None:
                        close(False)
                    now = _Open(system, f"{root}/parts/{task}-{number}", stem)
                    number += 1
                now.add(line)
        if now is not None:
            close(True)
        return Parts(context.partitionId(), parts, count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(f"{root}/files")
        told = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        with system.open_output_stream(f"{root}/parts.json") as stream:
            stream.write(json.dumps([p for m in told for p in m.parts]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


class LabelFiles(DataSource):
    """``df.write.format("label_files").save(staging)``: rows ``stem, line`` in file order within each partition."""

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def writer(self, schema, overwrite: bool):
        return LabelFileWriter(dict(self.options))


def _join_parts(lines: DataFrame, staging: str) -> None:
    """One task per stem that begins or ends a partition: its parts, one after the other, become its file."""
    system, root = opened(staging)
    with system.open_input_stream(f"{root}/parts.json") as stream:
        parts = json.loads(stream.read())
    rows = [(stem, [name for _, name, n in group if n]) for stem, group in groupby(parts, key=lambda p: p[0])]
    if not rows:
        return

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(staging)
        for batch in batches:
            for stem, names in zip(batch.column("stem").to_pylist(), batch.column("names").to_pylist()):
                whole = f"{root}/parts/{stem}.whole-{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(whole) as out:
                    for i, name in enumerate(names):
                        if i:
                            out.write(b"\n")
                        with system.open_input_stream(f"{root}/{name}") as part:
                            while block := part.read(COPY):
                                out.write(block)
                system.move(whole, f"{root}/files/{stem}.txt")
            yield batch.select(["stem"])

    spark = lines.sparkSession
    frame = spark.createDataFrame(rows, "stem string, names array<string>")
    frame.repartition(min(len(rows), spark.sparkContext.defaultParallelism)).mapInArrow(join, "stem string").agg(F.count("*")).collect()


def write_label_files(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``<path>/<stem>.txt`` for every stem of ``lines`` (stem, line_no, line): its lines in order, joined by newlines.

    ``path`` appears at once when all is written; a failed run leaves nothing there. Modes are ``errorifexists``,
    ``ignore`` and ``overwrite``. Rows with a null line make an empty file if the stem has no other; rows with a null stem
    are left out; equal line numbers come in any order; a stem that cannot be a file name fails the run. Without rows the
    directory is empty.
    """
    spark = lines.sparkSession
    importable(spark)
    spark.dataSource.register(LabelFiles)
    system, final = opened(path)
    there = system.get_file_info(final).type != fs.FileType.NotFound
    if there and mode == "ignore":
        return
    if mode not in ("errorifexists", "error", "ignore", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    if there and mode != "overwrite":
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    _, root = opened(staging)
    order = ["stem", "line_no"]
    ordered = lines.where("stem IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).select("stem", "line")
    try:
        ordered.write.format("label_files").mode("append").save(staging)
        _join_parts(lines, staging)
        if there:
            system.move(final, f"{root}/before")
        system.move(f"{root}/files", final)
    finally:
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)
