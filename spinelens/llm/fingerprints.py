"""Document fingerprints: sketches of all shingle hashes below a fixed fraction."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.llm._store import importable, settle

#: Code points of a shingle; a shorter text is one shingle.
SHINGLE = 16
#: One of so many shingle hashes is kept, the same for every text.
SCALE = 16
#: Bits of a kept hash that are written.
BITS = 40
#: Code points hashed at a time.
SLICE = 1 << 20
#: Bytes of text of a partition at least, and partitions at most: a driver's list has an entry for each.
PARTITION_BYTES, PARTITIONS = 16 << 20, 200_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` (a power of two) numbers, by doubling."""
    out, power, done = codes, _MULTIPLIER, 1
    while done < width:
        out = out[:-done] * power + out[done:]
        power, done = power * power, 2 * done
    return out


def sketches(texts: list[str], shingle: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """Per text the sorted distinct kept hashes (the ``BITS`` bits below the fixed fraction) of all its shingles.

    The sketch of a union of shingle sets is the union of their sketches, whatever their sizes.
    """
    out: list[list[np.ndarray]] = [[] for _ in texts]
    limit, shift = np.uint64((1 << 64) // scale - 1), np.uint64(64 - (scale - 1).bit_length() - BITS)

    def take(text: str, starts: np.ndarray, owners: list[int]) -> None:
        """Windows of joined texts; ``starts`` are their places, a window across two belongs to none."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if len(codes) < shingle:
            return
        hashes = _mixed(_rolled(codes + np.uint64(1), shingle))
        at = np.flatnonzero(hashes <= limit)
        owner = np.searchsorted(starts, at, "right") - 1
        ends = np.r_[starts[1:], len(codes)]
        inside = at + shingle <= ends[owner]
        at, owner = at[inside], owner[inside]
        cuts = np.searchsorted(owner, np.arange(len(owners) + 1))
        kept = hashes[at] >> shift
        for i, number in enumerate(owners):
            if cuts[i] < cuts[i + 1]:
                out[number].append(kept[cuts[i] : cuts[i + 1]])

    joined: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if owners:
            take("".join(joined), np.cumsum([0, *map(len, joined[:-1])]), owners)
        joined.clear()
        owners.clear()
        size = 0

    with np.errstate(over="ignore"):
        for i, text in enumerate(texts):
            if len(text) < shingle:
                text = text + "\0" * (shingle - len(text)) if text else ""
            if len(text) > SLICE:
                for at in range(0, len(text) - shingle + 1, SLICE):
                    take(text[at : at + SLICE + shingle - 1], np.zeros(1, np.int64), [i])
                continue
            if size + len(text) > SLICE:
                flush()
            joined.append(text)
            owners.append(i)
            size += len(text)
        flush()
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in out]


def written(sketch: np.ndarray) -> str:
    """The sketch as text: sorted hashes of ``BITS`` bits, base 64."""
    data = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
    return base64.b64encode(np.ascontiguousarray(data).tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    data = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, 8 - BITS // 8 :] = data
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merged(one: str, other: str) -> str:
    """The fingerprint of both texts' shingles together."""
    return written(np.union1d(read(one), read(other)))


def containment(one: np.ndarray, other: np.ndarray) -> float | None:
    """Estimated share of the first text's shingles that the other has; None if the first kept no hash."""
    return len(np.intersect1d(one, other, assume_unique=True)) / len(one) if len(one) else None


def likeness(one: np.ndarray, other: np.ndarray, equal: bool) -> float:
    """Containment of the first in the second; of texts too short to keep a hash, 1 if they are equal, else 0."""
    found = 1.0 if equal else containment(one, other)
    return 0.0 if found is None else found


def _order() -> list:
    """Descending ids, nulls last; among equals the hash of the text."""
    return [F.col("__id").desc_nulls_last(), F.col("__hash")]


def _cuts(docs: DataFrame) -> list[tuple]:
    """Keys (id, hash of the text) at which the documents in descending id order are cut, the first one's included.

    Only ids, hashes and sizes are sorted. A cut is made where a partition begins and wherever the bytes since the
    last cut pass the bound.
    """
    keys = settle(docs.selectExpr("__id", "__hash", "__bytes"))
    total = keys.agg(F.sum("__bytes")).first()[0]
    if total is None:
        return []
    bound = max(PARTITION_BYTES, total // PARTITIONS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            size = np.cumsum(batch.column("__bytes").to_numpy())
            rows, before = [], 0
            if waiting is None:
                rows, waiting = [0], 0
            while True:
                at = int(np.searchsorted(size, before + bound - waiting))
                if at + 1 >= len(size):
                    break
                rows.append(at + 1)
                before, waiting = int(size[at]), 0
            waiting += int(size[-1]) - before if len(size) else 0
            yield batch.take(pa.array(rows, pa.int64()))

    found = keys.repartitionByRange(*_order()).sortWithinPartitions(*_order()).mapInArrow(cut, keys.schema)
    return [(r["__id"], r["__hash"]) for r in found.select("__id", "__hash").distinct().collect()]


def _place(key: tuple) -> tuple:
    """Sorts keys by descending id, nulls last, then by hash."""
    return (key[0] is None, 0 if key[0] is None else -key[0], key[1])


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents by descending id in partitions, each ending with a copy of the next partition's first document.

    ``__part, __guest, __id, __hash, __text`` in order; the last partition ends with the first document of all. Texts are
    moved once. Rows of equal id follow the hash of their texts, null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__hash", F.xxhash64("__text"))
    cuts = sorted(_cuts(rows.withColumn("__bytes", F.octet_length("__text").cast("long"))), key=_place)
    held = spark.sparkContext.broadcast(
        (np.array([c[0] is None for c in cuts]), np.array([-(c[0] or 0) for c in cuts], np.int64),
         np.array([c[1] for c in cuts], np.int64)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        null, minus, hashes = held.value
        n = len(null)
        for batch in batches:
            ids = batch.column("__id")
            own_null = np.asarray(ids.is_null())
            own = -ids.fill_null(0).to_numpy()
            own_hash = batch.column("__hash").to_numpy()
            # cuts first among equals, so a row equal to a cut lies behind it
            order = np.lexsort((np.r_[np.zeros(n, np.int8), np.ones(len(own), np.int8)], np.r_[hashes, own_hash],
                                np.r_[minus, own], np.r_[null, own_null]))
            before = np.cumsum(order < n)
            part = np.empty(n + len(own), np.int64)
            part[order] = before - 1
            part = part[n:]
            first = (own_null == null[part]) & (own == minus[part]) & (own_hash == hashes[part])
            at = np.r_[np.arange(len(own)), np.flatnonzero(first)]
            guest = np.r_[np.zeros(len(own), np.int8), np.ones(int(first.sum()), np.int8)]
            part = np.r_[part, (part[first] - 1) % n]
            moved = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(guest), *(moved.column(c) for c in ("__id", "__hash", "__text"))],
                names=["__part", "__guest", "__id", "__hash", "__text"])

    dealt = rows.select("__id", "__hash", "__text").mapInArrow(
        deal, "__part int, __guest tinyint, __id bigint, __hash bigint, __text string")
    dealt = dealt.repartitionById(max(1, len(cuts)), F.col("__part"))
    return dealt.sortWithinPartitions("__part", "__guest", *_order())


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by as many code points (or all) of the start of ``other``."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    A fingerprint holds every hash of a shingle (``shingle`` code points, a power of two) below one ``scale``-th of the
    range: equal texts have equal fingerprints, fingerprints merge by union, and as the fraction is the same for all texts
    the share of one's hashes in another estimates containment between texts of any sizes.

    ``n_chars`` (code points), ``edited_sha256`` (UTF-8) of the text whose last third gave way to the start of the next
    document, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``: the share of the document's kept
    hashes that the edited text, the next document has; texts too short to keep a hash are 1 like an equal text, else 0.

    Documents follow each other by descending id; of equal ids by the hash of the text, null ids last, and the first
    follows the last. Null texts count as empty: no shingles. Repeated rows come back row by row; further columns are left
    out; an empty table gives no rows. Ids are integers.
    """
    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = in_order(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, part = 0, None

        def results(n: int) -> pa.RecordBatch:
            """Of the first ``n`` documents, each of which has its next one behind it."""
            own = sketches(texts[: n + 1], shingle, scale)
            changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
            theirs = sketches(changed, shingle, scale)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                 pa.array([written(s) for s in own[:n]]), pa.array([written(s) for s in theirs]),
                 pa.array([likeness(own[i], theirs[i], texts[i] == changed[i]) for i in range(n)]),
                 pa.array([likeness(own[i], own[i + 1], texts[i] == texts[i + 1]) for i in range(n)])],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        over = False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("__part", "__guest", "__id", "__text")]
            for number, guest, one, text in zip(*columns):
                if number != part:
                    part, over = number, False
                    ids.clear()
                    texts.clear()
                    size = 0
                if over:  # copies of the next partition's first document
                    continue
                ids.append(one)
                texts.append(text)
                size += len(text)
                if guest or size > 4 * SLICE:
                    if len(texts) > 1:
                        yield results(len(texts) - 1)
                    del ids[:-1], texts[:-1]
                    size = len(texts[0])
                    over = bool(guest)

    out = rows.mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
                               " edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
