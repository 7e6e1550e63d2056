"""Width and height of PNG and JPEG files from their headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from spinelens.sources.storage import importable, opened

#: Bytes read at first, and for each JPEG segment head that lies beyond what was read.
HEAD = 4096
#: Files of a task that are open at the same time.
OPEN_FILES = 8
PNG = b"\x89PNG\r\n\x1a\n"
#: JPEG markers that begin a frame, and those that stand without a length (fixed values of the format).
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
ALONE = {0x01, *range(0xD0, 0xD8)}


class _Window:
    """Random reads of a few bytes, a block at a time."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.start, self.block = 0, file.read_at(min(HEAD, self.size), 0)

    def bytes(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.block):
            if at + n > self.size:
                return b""
            self.start, self.block = at, self.file.read_at(min(HEAD, self.size - at), at)
        return self.block[at - self.start : at - self.start + n]


def header_size(window) -> tuple[int, int] | None:
    """Width and height by the content, whatever the file's name; None if broken, short or of another format."""
    if window.bytes(0, 8) == PNG:
        head = window.bytes(8, 16)
        if head[4:8] != b"IHDR":
            return None
        width, height = struct.unpack(">II", head[8:])
        return (width, height) if 0 < width < 1 << 31 and 0 < height < 1 << 31 else None
    if window.bytes(0, 2) != b"\xff\xd8":
        return None
    at = 2
    while True:
        mark = window.bytes(at, 2)
        if len(mark) < 2 or mark[0] != 0xFF:
            return None
        if mark[1] == 0xFF:  # fill byte
            at += 1
        elif mark[1] in ALONE:
            at += 2
        elif mark[1] in FRAMES:
            frame = window.bytes(at + 4, 5)
            if len(frame) < 5:
                return None
            height, width = struct.unpack(">HH", frame[1:])
            return (width, height) if width and height else None
        elif mark[1] in (0xD8, 0xD9, 0xDA):  # another start, the end or pixels before any frame
            return None
        else:
            length = window.bytes(at + 2, 2)
            if len(length) < 2 or (n := struct.unpack(">H", length)[0]) < 2:
                return None
            at += 2 + n


def file_size(path: str) -> tuple[int, int] | None:
    try:
        system, plain = opened(path)
        with system.open_input_file(plain) as file:
            return header_size(_Window(file))
    except (OSError, ValueError):
        return None


def with_image_size(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``files`` with ``width`` and ``height``, null where the image is missing, broken, short or of another format.

    Only headers are read, a few kilobytes a file, and no pixel is decoded. Each task keeps some files open at a time,
    as remote stores answer slowly. Null paths have null sizes; other columns pass through.
    """
    importable(files.sparkSession)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(OPEN_FILES) as pool:
            for batch in batches:
                paths = batch.column(path_col).to_pylist()
                found = [s or (None, None) for s in pool.map(lambda p: file_size(p) if p is not None else None, paths)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array([s[i] for s in found], pa.int32()) for i in (0, 1))],
                    names=[*batch.schema.names, "width", "height"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(sizes, kinds + ", width int, height int")
