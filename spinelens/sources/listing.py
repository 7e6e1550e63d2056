"""Listing of a corpus ``<root>/<sample>/<file>`` with its empty files and empty directories.

Spark's file sources skip files of zero bytes, names that begin with a dot or an underscore, and
directories without files. A corpus is counted with them, so this data source lists it itself:
the driver lists the sample directories, the tasks list what is in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spinelens.sources.storage import importable, opened

#: Directories that one task lists.
DIRECTORIES = 256
#: Rows of a batch.
ROWS = 10_000
SCHEMA = pa.schema([
    ("sample_id", pa.string()), ("file_name", pa.string()), ("path", pa.string()), ("length", pa.int64())])


@dataclass
class Directories(InputPartition):
    """Names of directories below the root; an empty name is the root itself."""

    names: list[str]


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/") or "/"
        self.flat = options.get("flat", "false").lower() == "true"
        self.size = int(options.get("directories", DIRECTORIES))

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.root)
        if self.flat:
            return [Directories([""])]
        found = system.get_file_info(fs.FileSelector(root))
        names = sorted(i.base_name for i in found if i.type == fs.FileType.Directory)
        return [Directories(names[i : i + self.size]) for i in range(0, len(names), self.size)] or [Directories([])]

    def read(self, partition: Directories) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.root)
        rows: list[tuple] = []
        for name in partition.names:
            folder = f"{root}/{name}" if name else root
            shown = f"{self.root}/{name}" if name else self.root
            sample = name or shown.rsplit("/", 1)[-1]
            rows.append((sample, None, shown, None))
            files = system.get_file_info(fs.FileSelector(folder))
            rows.extend((sample, i.base_name, f"{shown}/{i.base_name}", i.size)
                        for i in sorted(files, key=lambda i: i.base_name) if i.type == fs.FileType.File)
            while len(rows) >= ROWS:
                yield self.batch(rows[:ROWS])
                del rows[:ROWS]
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, f.type) for column, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


class CorpusFiles(DataSource):
    """``spark.read.format("corpus_files").load(root)``; option ``flat`` lists the files of the root itself."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return "sample_id string, file_name string, path string, length bigint"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


def list_corpus(spark: SparkSession, path: str, *, flat: bool = False) -> DataFrame:
    """``sample_id, file_name, path, length``: a row per sample directory (``file_name`` null) and one per file in it.

    Empty files, empty directories and hidden names are rows like all others; deeper directories are not entered. With
    ``flat`` the one directory ``path`` is listed. Directories are listed by the tasks, ``DIRECTORIES`` at a time.
    """
    importable(spark)
    spark.dataSource.register(CorpusFiles)
    return spark.read.format("corpus_files").option("flat", str(flat).lower()).load(path)


def samples(listing: DataFrame) -> DataFrame:
    """One ``sample_id`` per sample directory."""
    return listing.where("file_name IS NULL").select("sample_id")


def files(listing: DataFrame, extensions: list[str]) -> DataFrame:
    """Files with one of the extensions (case-sensitive)."""
    ending = " OR ".join(f"endswith(file_name, '.{e}')" for e in extensions)
    return listing.where(f"file_name IS NOT NULL AND ({ending})")


def with_content(files: DataFrame) -> DataFrame:
    """Files with their bytes as ``content``; null where a file cannot be read."""
    importable(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    system, plain = opened(path)
                    with system.open_input_stream(plain) as stream:
                        content = stream.read()
                except OSError:
                    content = None
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([content], pa.binary())], names=[*row.schema.names, "content"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(read, kinds + ", content binary")


def skipped_by_spark() -> Column:
    """Files that Spark's own sources leave out."""
    return F.expr("length = 0 OR startswith(file_name, '.') OR startswith(file_name, '_')")
