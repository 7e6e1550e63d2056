"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spinelens.llm import _encode
from spinelens.llm._store import importable

#: Context sizes, each a power of two; documents go to the smallest that holds them.
TIERS = (256, 512, 1024, 2048)
#: A worker packs whenever it holds about this many ids (4 bytes each), so memory is bounded.
POOL_TOKENS = 4 << 20
#: Words whose ids a worker keeps (about 200 bytes each); the rank table is quick enough for the others.
KEPT_WORDS = 1 << 17
#: Characters of the texts that are encoded together; no more of a batch are Python strings at a time.
GROUP_CHARS = 4 << 20
#: Bytes of ids after which a worker hands on a batch of rows.
OUT_BYTES = 2 << 20
#: Tokens of a step group: so many of them make one training step, whatever their tier.
STEP_TOKENS = 64 * 2048

_memos: dict[tuple[str, int], _encode.Memo] = {}


def _memo(path: str, batch_bytes: int) -> _encode.Memo:
    if (path, batch_bytes) not in _memos:
        _memos[path, batch_bytes] = _encode.Memo(_encode.RankedWords(path), batch_bytes, KEPT_WORDS)
    return _memos[path, batch_bytes]


def encode(texts: list[str], path: str, end_id: int, batch_bytes: int = 1 << 20) -> list[bytes]:
    """Little-endian 32-bit ids of whole texts, each followed by ``end_id``.

    Words between ASCII white space are encoded apart: the tokenizer drops white space and joins
    nothing across it.
    """
    memo, end = _memo(path, batch_bytes), end_id.to_bytes(4, "little")
    out, group, size = [], [], 0

    def flush() -> None:
        found = [list(map(memo.known.get, words)) for words in group]
        unseen = {}
        for words, ids in zip(group, found):
            if None in ids:
                unseen.update((w, None) for w, i in zip(words, ids) if i is None)
        learned = memo.learn(list(unseen))
        for words, ids in zip(group, found):
            if None in ids:
                ids = [learned[w] if i is None else i for w, i in zip(words, ids)]
            out.append(b"".join(ids) + end)
        group.clear()

    for text in texts:
        group.append(text.encode().split())
        size += len(text)
        if size >= 2 * batch_bytes:
            flush()
            size = 0
    flush()
    return out


@dataclass
class Piece:
    """Ids ``start`` to ``start + len(ids) / 4`` of a document."""

    doc: int | None
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens),
                Piece(self.doc, self.start + n, self.ids[4 * n:], self.doc_tokens))


@dataclass
class Pool:
    """Pieces by length; bit n of ``mask`` says that there are pieces of n ids."""

    pieces: dict[int, list[Piece]] = field(default_factory=dict)
    mask: int = 0
    tokens: int = 0

    def put(self, piece: Piece) -> None:
        self.pieces.setdefault(piece.length, []).append(piece)
        self.mask |= 1 << piece.length
        self.tokens += piece.length

    def take(self, length: int) -> Piece:
        stack = self.pieces[length]
        piece = stack.pop()
        if not stack:
            self.mask &= ~(1 << length)
        self.tokens -= length
        return piece

    def longest(self, limit: int) -> int:
        """Length of the longest piece of at most ``limit`` ids, 0 if there is none."""
        return max(0, (self.mask & ((1 << (limit + 1)) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1


def pack_pool(pool: Pool, tiers: tuple[int, ...] = TIERS, *, last: bool) -> list[list[Piece]]:
    """Windows filled to the last id.

    From the largest tier down, the longest piece that belongs to the tier opens a window; the gap is
    filled by the longest pieces that fit, which belong to shorter tiers, and at the end by a cut of the
    shortest piece left. What cannot fill a window stays in the pool; with ``last`` it is cut into windows
    whose lengths are descending powers of two, so nothing is padded.
    """
    windows = []
    floors = (0, *tiers[:-1])
    for tier, floor in zip(reversed(tiers), reversed(floors)):
        while (first := pool.longest(tier)) > floor and pool.tokens >= tier:
            window, gap = [pool.take(first)], tier - first
            while gap:
                if fit := pool.longest(gap):
                    window.append(pool.take(fit))
                    gap -= fit
                else:
                    head, tail = pool.take(pool.shortest()).cut(gap)
                    window.append(head)
                    pool.put(tail)
                    gap = 0
            windows.append(window)
    while last and pool.tokens:
        gap = min(max(tiers), 1 << (pool.tokens.bit_length() - 1))
        window = []
        while gap:
            piece = pool.take(pool.longest(gap) or pool.shortest())
            if piece.length > gap:
                piece, tail = piece.cut(gap)
                pool.put(tail)
            window.append(piece)
            gap -= piece.length
        windows.append(window)
    return windows


def step_groups(windows: list[list[Piece]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group number per window, so that groups of a tier cost alike.

    Windows of one length share groups of ``step_tokens``. Attention costs the squares of the pieces'
    lengths; windows are dealt to the groups of their length from costly to cheap, turning at either end.
    """
    by_length: dict[int, list[tuple[int, int]]] = {}
    for i, window in enumerate(windows):
        by_length.setdefault(sum(p.length for p in window), []).append((sum(p.length ** 2 for p in window), i))
    out, first = [0] * len(windows), 0
    for length in sorted(by_length, reverse=True):
        ranked = sorted(by_length[length], key=lambda x: (-x[0], x[1]))
        groups = -(-len(ranked) * length // step_tokens)
        for rank, (_, i) in enumerate(ranked):
            turn, place = divmod(rank, groups)
            out[i] = first + (groups - 1 - place if turn % 2 else place)
        first += groups
    return out


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()),
    ("step_id", pa.int64()), ("ids", pa.binary()),
])


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
         tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS,
         with_ids: bool = True) -> DataFrame:
    """Pieces of documents in full windows; every id lies in exactly one piece.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id``
    and, unless ``with_ids`` is false, the ids as little-endian 32-bit ``ids``. Documents longer than the
    largest tier give full windows of their own; the rest of each is routed and packed with others of the
    same input partition. Nothing is shuffled: hot sources and copies do not matter, and at most the
    windows of a partition's last few ids are short. ``sequence_id`` and ``step_id`` carry the partition
    number in their upper bits, so a task run again gives the same rows.

    Null and empty texts are their end id alone. Null ids stay null; repeated rows are packed each; further
    columns are left out. An empty table gives no rows.
    """
    importable(docs.sparkSession)
    largest, tiers = max(tiers), tuple(sorted(tiers))
    fields = [f for f in SCHEMA if with_ids or f.name != "ids"]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        pool, full, held, sequences, steps = Pool(), [], 0, 0, 0

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps
            windows = full + pack_pool(pool, tiers, last=last)
            full.clear()
            groups = step_groups(windows, step_tokens)
            columns: dict[str, list] = {f.name: [] for f in fields}
            size = 0
            for at, group in enumerate(groups):
                window, windows[at] = windows[at], None
                offset, tier = 0, sum(p.length for p in window)
                for p in window:
                    row = (p.doc, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, base + sequences, offset,
                           tier, base + steps + group)
                    for name, value in zip(columns, row):
                        columns[name].append(value)
                    if with_ids:
                        columns["ids"].append(p.ids)
                    offset += p.length
                sequences += 1
                size += 4 * offset
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_pydict(columns, schema=schema)
                    columns, size = {f.name: [] for f in fields}, 0
            steps += max(groups, default=-1) + 1
            yield pa.RecordBatch.from_pydict(columns, schema=schema)

        for batch in batches:
            lengths, first = pc.utf8_length(batch.column(1)).fill_null(0).to_pylist(), 0
            while first < len(lengths):
                stop, size = first, 0
                while stop < len(lengths) and (stop == first or size < GROUP_CHARS):
                    size += lengths[stop]
                    stop += 1
                some = batch.slice(first, stop - first)
                group = ["" if t is None else t for t in some.column(1).to_pylist()]
                for doc, ids in zip(some.column(0).to_pylist(), encode(group, tokenizer_path, end_id)):
                    n = len(ids) // 4
                    for at in range(0, n, largest):
                        piece = Piece(doc, at, ids[4 * at: 4 * (at + largest)], n)
                        if piece.length == largest:
                            full.append([piece])
                            held += largest
                        else:
                            pool.put(piece)
                if held + pool.tokens >= pool_tokens:
                    yield from rows(last=False)
                    held = 0
                first = stop
        yield from rows(last=True)

    names = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary' if f.type == pa.binary() else 'bigint'}"
                      for f in fields)
    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(
        run, names)
