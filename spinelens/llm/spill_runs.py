"""Sorted runs of counted keys: compressed columns, and a heap merge over many of them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import zstandard

#: Keys that a merge takes from the run with the smallest head before it looks at the heap again.
BLOCK = 1 << 14


def packed(*columns: np.ndarray) -> bytes:
    """Integer columns as one zstd frame; the bytes of equal weight stand together."""
    parts = [np.array([len(columns), *(x for c in columns for x in (len(c), c.itemsize))], "<i8").tobytes()]
    for column in columns:
        planes = np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.itemsize)
        parts.append(np.ascontiguousarray(planes.T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(frame: bytes) -> list[np.ndarray]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(frame))
    (n,) = np.frombuffer(data[:8], "<i8")
    shape = np.frombuffer(data[8 : 8 + 16 * n], "<i8").reshape(n, 2).tolist()
    at, out = 8 + 16 * int(n), []
    for length, width in shape:
        planes = np.frombuffer(data[at : at + length * width], np.uint8).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<i{width}"))
        at += length * width
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted ``keys`` with the sums of their counts."""
    if not len(keys):
        return keys, counts
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and their summed counts over sorted runs, in key order, block by block.

    A heap holds the head of every run. The run with the smallest head gives a block; all runs give what
    is not greater than its end, so a key's counts always meet in one block.
    """
    at = [0] * len(runs)
    heap = [(int(keys[0]), i) for i, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    while heap:
        keys = runs[heap[0][1]][0]
        fence = keys[min(at[heap[0][1]] + BLOCK, len(keys)) - 1]
        some_keys, some_counts = [], []
        while heap and heap[0][0] <= fence:
            i = heapq.heappop(heap)[1]
            keys, counts = runs[i]
            end = at[i] + int(np.searchsorted(keys[at[i] :], fence, "right"))
            some_keys.append(keys[at[i] : end])
            some_counts.append(counts[at[i] : end])
            at[i] = end
            if end < len(keys):
                heapq.heappush(heap, (int(keys[end]), i))
        keys, counts = np.concatenate(some_keys), np.concatenate(some_counts)
        order = np.argsort(keys, kind="stable")
        yield summed(keys[order], counts[order])


def with_best(blocks: Iterator[tuple[np.ndarray, np.ndarray]], shift: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks with a flag for keys whose count is the highest of their side (the bits from ``shift`` on).

    Keys come side by side, so only the last, perhaps unfinished, side of a block waits for the next.
    """
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def flagged(keys, counts):
        sides = keys >> shift
        starts = np.flatnonzero(np.r_[True, sides[1:] != sides[:-1]])
        top = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.r_[starts, len(keys)]))
        return keys, counts, counts == top

    for keys, counts in blocks:
        keys, counts = np.concatenate([held[0], keys]), np.concatenate([held[1], counts])
        cut = int(np.searchsorted(keys, (keys[-1] >> shift) << shift, "left"))
        held = (keys[cut:], counts[cut:])
        if cut:
            yield flagged(keys[:cut], counts[:cut])
    if len(held[0]):
        yield flagged(*held)
