"""Class-based bigram language model: exchange clustering, transitions, emissions, text scores."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.llm._store import ensure_checkpoint_dir, importable, settle, sized

#: Model size. The exchange vocabulary is clustered first, with all other words in the class of their last two bytes;
#: then every training word is. Words that no training text has keep the class of their last two bytes.
EXCHANGE_WORDS, CLASSES, ENDINGS = 2048, 64, 16
#: Words whose counts every worker holds (a few MB); counts of all others are joined.
HELD_WORDS = 1 << 18
ROUNDS = 8
#: Rounds over all training words: the words outside the exchange vocabulary, then one half of all words, then the other.
WORD_ROUNDS = 3
#: Keys of a context: the class of the neighbour, and past this number if it comes after the word.
AFTER = 128
#: Weight of the class's own share in a transition.
PRIOR = 20.0
#: The token after a text's last word; no word has white space.
END = b"\n"
#: Tokens after which a worker hands on its counts, and those after which it hands on neighbours.
FLUSH, NEAR_FLUSH = 1 << 21, 3 << 19
#: Bytes of text that are cut into words at once; a longer text is alone.
PIECE = 1 << 22
#: Blocks of words per bucket of the words' table, and training tokens per bucket. What is handed from bucket to block is a row, so
#: that neither may depend on the number of partitions.
BLOCKS, BUCKET_TOKENS = 8, 3 << 19


def words(text: str) -> list[bytes]:
    """Runs outside ``[\\x20\\x09-\\x0D]``, A-Z in lower case."""
    return text.encode().lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


@cache
def _ending_table() -> np.ndarray:
    """Endings by the last two bytes, then by a single byte, then that of no byte."""
    return np.array([ending(bytes([i >> 8, i & 255])) for i in range(1 << 16)] + [ending(bytes([i])) for i in range(1 << 8)] + [ending(b"")], np.int64)


def endings_of(found: pa.Array) -> np.ndarray:
    """``ending`` of all words."""
    if not len(found):
        return np.zeros(0, np.int64)
    _, offsets, data = found.buffers()
    at = np.frombuffer(offsets, np.int32)[found.offset: found.offset + len(found) + 1].astype(np.int64)
    sizes, last = np.diff(at), at[1:] - 1
    # two bytes before the first one, so that no place is negative
    held = np.r_[np.zeros(2, np.uint8), np.frombuffer(data, np.uint8)[: at[-1]] if data is not None else np.zeros(0, np.uint8)]
    one, two = held[last + 2].astype(np.int64), held[last + 1].astype(np.int64)
    return _ending_table()[np.where(sizes > 1, two << 8 | one, np.where(sizes == 1, (1 << 16) + one, (1 << 16) + (1 << 8)))]


def _pieces(column: pa.Array) -> Iterator[pa.Array]:
    """The texts of a column, some at a time."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // PIECE
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(column)] if len(column) else np.zeros(1, np.int64)
    for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield column.slice(start, stop - start)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words`` of all texts in one line, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    lengths, flat = np.diff(parts.offsets.to_numpy()).astype(np.int64), parts.flatten().cast(pa.binary())
    some = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty part
    if not pc.all(some).as_py():
        row = np.repeat(np.arange(len(lengths)), lengths)
        lengths = np.bincount(row[some.to_numpy(zero_copy_only=False)], minlength=len(lengths))
        flat = flat.filter(some)
    return flat, lengths


def _counted(texts: DataFrame) -> DataFrame:
    """``word, n`` over all tokens: counted per worker, then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[pa.Array] = []
        tokens = ends = 0

        def rows() -> pa.RecordBatch:
            counts = pa.chunked_array(lines, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([pa.concat_arrays([counts.field(0), pa.array([END], pa.binary())]),
                                               pa.concat_arrays([counts.field(1), pa.array([ends], pa.int64())])], names=["word", "n"])

        for batch in batches:
            for piece in _pieces(batch.column(0)):
                lines.append(_split(piece)[0])
                tokens, ends = tokens + len(lines[-1]), ends + len(piece)
                if tokens > FLUSH:
                    yield rows()
                    lines, tokens, ends = [], 0, 0
                    pa.default_memory_pool().release_unused()
        if ends:
            yield rows()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Units(dict):
    """Unit of a word: its rank in the exchange vocabulary, a class of endings, or the end."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(vocabulary))
        self.base, self.end = len(vocabulary), len(vocabulary) + ENDINGS
        self[END] = self.end

    def __missing__(self, word: bytes) -> int:
        return self.base + ending(word)


def _pairs(texts: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``l, r, n``: how often unit r follows unit l in all texts; texts begin after an end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _Units(vocabulary)
        size = units.end + 1
        total = np.zeros(size * size, np.int32)
        for batch in batches:
            codes = []
            for text in batch.column(0):
                found = words(text.as_py() or "")
                line = np.empty(len(found) + 2, np.int64)
                line[0] = line[-1] = units.end
                line[1:-1] = np.fromiter(map(units.__getitem__, found), np.int64, len(found))
                codes.append(line[:-1] * size + line[1:])
                if sum(map(len, codes)) > 1 << 19:
                    at, n = np.unique(np.concatenate(codes), return_counts=True)
                    total[at] += n.astype(np.int32)
                    codes = []
            if codes:
                at, n = np.unique(np.concatenate(codes), return_counts=True)
                total[at] += n.astype(np.int32)
        at = np.flatnonzero(total)
        for start in range(0, len(at), 1 << 18):
            some = at[start: start + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((some // size).astype(np.int32)), pa.array((some % size).astype(np.int32)),
                 pa.array(total[some].astype(np.int64))], names=["l", "r", "n"])

    return (texts.mapInArrow(run, "l int, r int, n long")
            .groupBy("l", "r").agg(F.sum("n").alias("n")))


def _unit_rows(pairs: DataFrame) -> DataFrame:
    """``word, nbrs, counts``: a row per unit with the units after it, stored; at most one row and one entry per unit."""
    return _stored(pairs.groupBy(F.col("l").cast("long").alias("word")).agg(F.collect_list(F.struct("r", "n")).alias("x"))
                   .selectExpr("word", "transform(x, e -> CAST(e.r AS LONG)) AS nbrs", "x.n AS counts"))


def _contexts(units: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Per unit, how often each class stands before and after it: units x classes, summed per worker, then in Spark.
    Units without a class (-1) are left out on both sides."""
    size = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size * n_classes)
        for batch in batches:
            row, nbr, n = _flat(batch, "nbrs")
            left = batch.column("word").to_numpy()[row]
            some = (classes[left] >= 0) & (classes[nbr] >= 0)
            left, nbr, n = left[some], nbr[some], n[some]
            np.add.at(total, nbr * n_classes + classes[left], n)
            np.add.at(total, (size + left) * n_classes + classes[nbr], n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["at", "n"])

    table = units.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * size * n_classes)
    out[table.column("at").to_numpy()] = table.column("n").to_numpy()
    return tuple(out.reshape(2, size, n_classes))


def _gain(before: np.ndarray, after: np.ndarray, classes: np.ndarray, n_classes: int):
    """Class bigrams, and per unit the log likelihood of its contexts under each class."""
    bigrams = np.zeros((n_classes, n_classes))
    np.add.at(bigrams, classes, after)  # class of the unit, then the class after it
    smooth = bigrams + 0.05
    left, right = smooth.sum(1), smooth.sum(0)
    pmi = np.log(smooth) - np.log(left)[:, None] - np.log(right)[None, :] + np.log(smooth.sum())
    return bigrams, before @ pmi + after @ pmi.T


def information(bigrams: np.ndarray) -> float:
    """Mutual information of neighbouring classes, in nats; what exchanges raise."""
    p = bigrams / max(bigrams.sum(), 1)
    outer = p.sum(1)[:, None] * p.sum(0)[None, :]
    some = p > 0
    return float((p[some] * np.log(p[some] / outer[some])).sum())


def cluster(pairs: DataFrame, n_words: int, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """Class of every unit of ``l, r, n``, by exchange, and the mutual information before each round."""
    return cluster_units(_unit_rows(pairs), n_words, n_classes, rounds)


def cluster_units(units: DataFrame, n_words: int, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """``cluster`` over a stored row per unit.

    Units past ``n_words`` (endings, the end) keep classes of their own. In each round the contexts of all
    units by class are summed in Spark; then half of the words, in turn, move to the class under which their
    contexts are likeliest. The assignment with the largest information is returned.
    """
    total = n_classes + ENDINGS + 1
    classes = np.concatenate([np.arange(n_words) % n_classes, n_classes + np.arange(ENDINGS + 1)]).astype(np.int64)
    best, history = (-np.inf, classes), []
    for turn in range(rounds):
        before, after = _contexts(units, classes, total)
        bigrams, score = _gain(before, after, classes, total)
        history.append(information(bigrams))
        if history[-1] > best[0]:
            best = (history[-1], classes.copy())
        if turn == rounds - 1:
            break
        moving = np.arange(n_words)[np.arange(n_words) % 2 == turn % 2] if turn else np.arange(n_words)
        classes = classes.copy()
        classes[moving] = score[moving, :n_classes].argmax(1)
    return best[1], history


def rest_ids(found: list[bytes]) -> np.ndarray:
    """Negative 63-bit hashes of words that are not held; the same as ``_REST_ID`` in SQL."""
    from xxhash import xxh64_digest

    return (np.frombuffer(b"".join(map(xxh64_digest, found, repeat(42))), ">u8").astype(np.uint64) | np.uint64(1 << 63)).view(np.int64)


def rest_id(word: bytes) -> int:
    """``rest_ids`` of one word."""
    return int(rest_ids([word])[0])


_REST_ID = "xxhash64(word) | shiftleft(1L, 63)"
_ENDING = f"CAST(crc32(substring(word, greatest(length(word) - 1, 1), 2)) % {ENDINGS} AS INT)"


def _stored(df: DataFrame) -> DataFrame:
    """A wide table, written once to the shared checkpoint folder as compressed columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/lm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _word_pairs(texts: DataFrame, held: list[bytes]) -> DataFrame:
    """``l, r, n``: how often word r follows word l. Held words are their rank, the end comes after them, all other
    words are ``rest_id``."""
    model = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(model.value)}
        end, get = len(known), known.get
        lines: list[np.ndarray] = []
        size = 0

        def rows() -> pa.RecordBatch:
            line = np.concatenate(lines) if lines else np.zeros(0, np.int64)
            # texts stand between ends; two ends in a row lie between texts
            names, code = np.unique(line, return_inverse=True)
            inner = np.ones(max(len(line) - 1, 0), bool)
            inner[np.cumsum([len(x) for x in lines[:-1]], dtype=np.int64) - 1] = False
            at, n = np.unique((code[:-1] * len(names) + code[1:])[inner], return_counts=True)
            width = max(len(names), 1)
            return pa.RecordBatch.from_arrays([pa.array(names[at // width]), pa.array(names[at % width]), pa.array(n.astype(np.int64))],
                                              names=["l", "r", "n"])

        for batch in batches:
            for text in batch.column(0):
                found = words(text.as_py() or "")
                line = np.full(len(found) + 2, end, np.int64)
                line[1:-1] = [rest_id(w) if c is None else c for w, c in zip(found, map(get, found))]
                lines.append(line)
                size += len(line)
                if size > 1 << 21:
                    yield rows()
                    lines, size = [], 0
        yield rows()

    return texts.mapInArrow(run, "l long, r long, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))


def _numbers(found: pa.Array, held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word, its rank if it is held, else ``rest_id``; and the ending of those that are not held."""
    number = pc.index_in(found, held).fill_null(-1).to_numpy().astype(np.int64)
    rest, kinds = np.flatnonzero(number < 0), np.zeros(len(number), np.int64)
    others = found.take(pa.array(rest))
    number[rest], kinds[rest] = rest_ids(others.to_pylist()), endings_of(others)
    return number, kinds


_PARTS = "block long, words binary, sizes binary, nbrs binary, counts binary"
_TABLE = ("block long, words binary, near_sizes binary, near binary, near_counts binary, far_sizes binary, far binary,"
          " far_counts binary")
_STATE = "block long, words binary, n binary, ending binary, class binary"
#: What a word that is not held hands on: how often its class stands on one side of another word.
_HANDED = np.dtype([("word", np.int64), ("slot", np.int16), ("v", np.int64)])


def _buckets(tokens: int) -> int:
    """Buckets of the words' table."""
    return max(1, -(-tokens // BUCKET_TOKENS))


def _numpy(batch: pa.RecordBatch | pa.Table, i: int, column: str, dtype=np.int64) -> np.ndarray:
    """The numbers that a binary cell holds; none if it is null."""
    cell = batch.column(column)[i].as_buffer()
    return np.zeros(0, dtype) if cell is None else np.frombuffer(cell, dtype)


def _least(n: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    top = int(np.abs(n).max(initial=0))
    return n.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(k).max))


def _counts(batch: pa.RecordBatch | pa.Table, i: int, column: str, entries: int) -> np.ndarray:
    """The counts of ``_least``; the length of the cell says how many bytes each has."""
    cell = batch.column(column)[i].as_buffer()
    return np.frombuffer(cell, f"i{cell.size // entries}").astype(np.int64) if entries else np.zeros(0, np.int64)


def _cells(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())


def _parts(block: np.ndarray, word: np.ndarray, sizes: np.ndarray, nbr: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row per block of words, which stand together; each word has ``sizes`` neighbours and counts."""
    cuts = np.flatnonzero(np.diff(block)) + 1
    at = np.r_[0, np.cumsum(sizes)][np.r_[0, cuts, len(block)]]
    entries = [[least(x[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())] for x, least in ((nbr, np.asarray), (n, _least))]
    own = [np.split(x.astype(np.int64), cuts) if len(block) else [] for x in (word, sizes)]
    return pa.RecordBatch.from_arrays([pa.array(block[np.r_[0, cuts]] if len(block) else block), *map(_cells, own),
                                       *(_cells(x if len(block) else []) for x in entries)], names=[c.split()[0] for c in _PARTS.split(", ")])


def _neighbours(texts: DataFrame, held: list[bytes], n_hot: int, buckets: int = 1) -> DataFrame:
    """Rows of ``_block_table`` in parts: one pass over the texts gives, per worker and 1.5 million tokens, the neighbours of the words
    that are not among the ``n_hot`` first, and per worker, of each unit (``_Units``), the units after it."""
    model = texts.sparkSession.sparkContext.broadcast(pa.array(held, pa.binary()))
    blocks = BLOCKS * buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        end, size = len(held), n_hot + ENDINGS + 1
        unit_of = np.r_[np.arange(min(n_hot, end)), n_hot + endings_of(held.slice(n_hot)), size - 1]
        units = np.zeros(size * size, np.int64)
        lines: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        tokens = 0

        def rows() -> pa.RecordBatch:
            coded = pa.concat_arrays(lines).dictionary_encode()
            names, kinds = _numbers(coded.dictionary, held)
            names, kinds = np.r_[names, end], np.r_[kinds, 0]
            # words of a block stand together
            order = np.argsort(names % blocks, kind="stable")
            place = np.empty(len(names), np.int32)
            place[order] = np.arange(len(names))
            names, kinds = names[order], kinds[order]
            per_text = np.concatenate(lengths)
            line = np.full(len(coded) + len(per_text) + 1, place[-1])  # an end before, between and after the texts
            word = np.ones(len(line), bool)
            word[np.r_[0, np.cumsum(per_text + 1)]] = False
            line[word] = place[coded.indices.to_numpy()]
            del coded, word
            bits = len(names).bit_length()
            unit = np.where(names < 0, n_hot + kinds, unit_of[np.maximum(names, 0)])
            own = (names < 0) | ((names >= n_hot) & (names != end))
            sides = []
            for a, b in ((line[:-1], line[1:]), (line[1:], line[:-1])):
                at = a.astype(np.int64)
                at <<= bits
                at |= b
                at.sort()
                first = np.flatnonzero(np.diff(at, prepend=-1))
                n, at = np.diff(first, append=len(at)), at[first]
                word, nbr = at >> bits, at & ((1 << bits) - 1)
                del at, first
                if not sides:
                    np.add.at(units, unit[word] * size + unit[nbr], n)
                # neighbours that are not held stand in the rows of words that are not held only
                some = own[word] & ((names[word] < 0) | (names[nbr] >= 0))
                sides.append((np.bincount(word[some], minlength=len(names)), names[nbr[some]], n[some]))
            (many, nbr, n), (more, other, k) = sides
            # each word's neighbours after it, then those before it
            out, count = np.empty(len(nbr) + len(other), np.int64), np.empty(len(nbr) + len(other), np.int64)
            first = np.arange(len(nbr)) + np.repeat(np.cumsum(more) - more, many)
            second = np.arange(len(other)) + np.repeat(np.cumsum(many), more)
            out[first], out[second], count[first], count[second] = nbr, other, n, -k
            return _parts(names[own] % blocks, names[own], (many + more)[own], out, count)

        for batch in batches:
            for piece in _pieces(batch.column(0)):
                found, many = _split(piece)
                lines.append(found)
                lengths.append(many)
                tokens += len(found) + len(many)
                if tokens > NEAR_FLUSH:
                    yield rows()
                    lines, lengths, tokens = [], [], 0
                    pa.default_memory_pool().release_unused()
        if lines:
            yield rows()
        at = np.flatnonzero(units)
        left = np.unique(at // size)
        yield _parts(-1 - left, left, np.bincount(at // size, minlength=size)[left], at % size, units[at])

    return texts.mapInArrow(run, _PARTS)


def _pair_rows(pairs: DataFrame, n_hot: int, end: int, buckets: int) -> DataFrame:
    """Rows of ``_block_table`` in parts, from ``l, r, n``; its units are the first ``n_hot`` words and the end."""
    own = f"({{0}} < 0 OR ({{0}} >= {n_hot} AND {{0}} <> {end}))"
    blocks = BLOCKS * buckets
    sides = pairs.selectExpr("l AS word", "r AS nbr", "n").unionByName(pairs.selectExpr("r AS word", "l AS nbr", "-n AS n"))
    rows = sides.where(own.format("word")).selectExpr(f"pmod(word, {blocks}L) AS block", "word", "nbr", "n", "word < 0 OR nbr >= 0 AS kept")
    hot = pairs.where(f"NOT {own.format('l')} AND NOT {own.format('r')}").selectExpr(
        f"-1 - least(l, {n_hot}) AS block", f"least(l, {n_hot}) AS word", f"least(r, {n_hot}) AS nbr", "n", "true AS kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, word, nbr, n, kept = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.argsort(block, kind="stable")
            block, word, nbr, n, kept = (x[order] for x in (block, word, nbr, n, kept))
            yield _parts(block, word, kept, nbr[kept], n[kept])

    return rows.unionByName(hot).mapInArrow(run, _PARTS)


def _merge_block(block: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row of ``_TABLE`` from all parts of a block: its words in order, counts of the same neighbour on the same side added."""
    words, sizes, nbr, n = (np.concatenate(x) for x in zip(*parts))
    names, row = np.unique(words, return_inverse=True)
    others, code = np.unique(nbr, return_inverse=True)
    key = (np.repeat(row, sizes) * 2 + (n < 0)) * max(len(others), 1) + code
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n, key = np.add.reduceat(n, first) if len(first) else n, key[first]
    row, nbr = key // (2 * max(len(others), 1)), others[key % max(len(others), 1)]
    cells = [names]
    for some, kind in ((nbr >= 0, np.int32), (nbr < 0, np.int64)):
        cells += [np.bincount(row[some], minlength=len(names)).astype(np.int32), nbr[some].astype(kind), _least(n[some])]
    return pa.RecordBatch.from_arrays([pa.array([block]), *(_cells([x]) for x in cells)], names=[c.split()[0] for c in _TABLE.split(", ")])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block from parts sorted by block; a block may go on in the next batch."""
    block, parts = None, []
    for batch in batches:
        for i, at in enumerate(batch.column("block").to_pylist()):
            if parts and at != block:
                yield _merge_block(block, parts)
                parts = []
            block, nbr = at, _numpy(batch, i, "nbrs")
            parts.append((_numpy(batch, i, "words"), _numpy(batch, i, "sizes"), nbr, _counts(batch, i, "counts", len(nbr))))
    if parts:
        yield _merge_block(block, parts)


def _word_rows(table: DataFrame) -> DataFrame:
    """``word, nbrs, counts``: a row per word of the table's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = _numpy(batch, i, "words")
                sizes = [_numpy(batch, i, c, np.int32) for c in ("near_sizes", "far_sizes")]
                row = np.concatenate([np.repeat(np.arange(len(words)), x) for x in sizes])
                order = np.argsort(row, kind="stable")
                nbrs = [_numpy(batch, i, c, kind) for c, kind in (("near", np.int32), ("far", np.int64))]
                n = np.concatenate([_counts(batch, i, c, len(x)) for c, x in zip(("near_counts", "far_counts"), nbrs)])[order]
                nbr = np.concatenate(nbrs)[order]
                offsets = pa.array(np.r_[0, np.cumsum(sizes[0] + sizes[1])].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words), pa.ListArray.from_arrays(offsets, pa.array(nbr.astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(n))],
                    names=["word", "nbrs", "counts"])

    return table.mapInArrow(run, "word long, nbrs array<long>, counts array<long>")


def _table(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word, nbrs, counts`` of all words that are not among the most frequent, and of all units, from ``_block_table``."""
    table, units = _block_table(parts)
    return _word_rows(table), units


def _block_table(parts: DataFrame, buckets: int = 1) -> tuple[DataFrame, DataFrame]:
    """``_TABLE`` of all words that are not among the most frequent, a row per block of words; ``word, nbrs, counts`` of all units.

    Counts are negative where the neighbour stands before the word. The words' table is bucketed by block, so that what a round
    finds out about words meets it without moving it. A held word has held neighbours only, two entries each at most; the
    words that are not held hand it the rest in every round.
    """
    spark = parts.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"lm_{uuid.uuid4().hex}"
    (parts.repartition(buckets, "block").sortWithinPartitions("block").mapInArrow(_merged, _TABLE)
     .write.bucketBy(buckets, "block").option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name))
    table = spark.table(name)
    return table.where("block >= 0"), _stored(_word_rows(table.where("block < 0")).coalesce(8))


def _state(rest: DataFrame, buckets: int) -> DataFrame:
    """``word, n, ending, class`` of words that are not held as a row per block, words in order; stored."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if rows:
            block, *columns = (np.concatenate(x) for x in zip(*rows))
            order = np.lexsort((columns[0], block))
            block = block[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[np.r_[0, cuts]] if len(block) else block),
                 *(_cells(np.split(x[order].astype(kind), cuts) if len(block) else []) for x, (_, kind) in zip(columns, _STATE_TYPES))],
                names=[c.split()[0] for c in _STATE.split(", ")])

    return _stored(rest.selectExpr(f"pmod(word, {BLOCKS * buckets}L) AS block", "word", "n", "ending", "class")
                   .repartition(buckets, "block").mapInArrow(pack, _STATE))


_STATE_TYPES = (("word", np.int64), ("n", np.int64), ("ending", np.int8), ("class", np.int8))


def _state_rows(state: DataFrame) -> DataFrame:
    """``word, n, ending, class``, a row per word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                word, n, kind, own = _state_of(batch, i)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n), pa.array(kind.astype(np.int32)), pa.array(own.astype(np.int32))],
                                                 names=["word", "n", "ending", "class"])

    return state.mapInArrow(run, "word long, n long, ending int, class int")


def _state_of(batch: pa.RecordBatch, i: int, prefix: str = "") -> list[np.ndarray]:
    return [_numpy(batch, i, prefix + c, kind) for c, kind in (("words", np.int64), *_STATE_TYPES[1:])]


def _far(table: DataFrame, state: DataFrame, n_hot: int, end: int, buckets: int) -> DataFrame:
    """``block, handed``: how often words that are not held stand beside a word, by their class (``_HANDED``); per block of that word,
    in parts, at most one entry per word, class and side in each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nbrs, slots, counts = [], [], []
            for i in range(batch.num_rows):
                words, own = (_numpy(batch, i, c, kind) for c, kind in (("s_words", np.int64), ("class", np.int8)))
                mine = _numpy(batch, i, "words")
                own = np.r_[own, np.int8(0)][np.searchsorted(words, mine)]  # held words hand on nothing
                for side, kind in (("near", np.int32), ("far", np.int64)):
                    row, nbr = np.repeat(np.arange(len(mine)), _numpy(batch, i, side + "_sizes", np.int32)), _numpy(batch, i, side, kind)
                    n = _counts(batch, i, side + "_counts", len(nbr))
                    some = (mine[row] < 0) & ((nbr < 0) | ((nbr >= n_hot) & (nbr != end)))
                    row, nbr, n = row[some], nbr[some], n[some]
                    nbrs.append(nbr.astype(np.int64))
                    slots.append(own[row].astype(np.int64) + np.where(n < 0, AFTER, 0))
                    counts.append(np.abs(n))
            names, code = np.unique(np.concatenate(nbrs) if nbrs else np.zeros(0, np.int64), return_inverse=True)
            if not len(names):
                continue
            order = np.argsort(names % (BLOCKS * buckets), kind="stable")
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            names = names[order]
            total = np.concatenate(counts)
            at, code = np.unique(place[code] * 2 * AFTER + np.concatenate(slots), return_inverse=True)
            out = np.empty(len(at), _HANDED)
            out["word"], out["slot"] = names[at // (2 * AFTER)], at % (2 * AFTER)
            out["v"] = np.bincount(code, total, len(at))
            block = out["word"] % (BLOCKS * buckets)
            cuts = np.flatnonzero(np.diff(block)) + 1
            yield pa.RecordBatch.from_arrays([pa.array(block[np.r_[0, cuts]]), _cells(np.split(out, cuts))], names=["block", "handed"])

    rows = (table.join(state.selectExpr("block", "words AS s_words", "class").hint("shuffle_hash"), "block"))
    return rows.mapInArrow(run, "block long, handed binary").repartition(buckets, "block").groupBy("block").agg(F.collect_list("handed").alias("handed"))


_CONTEXTS = _STATE + ", sizes binary, slots binary, counts binary"


def _word_contexts(table: DataFrame, state: DataFrame, held: tuple[np.ndarray, ...], n_hot: int, end: int, buckets: int) -> DataFrame:
    """``_CONTEXTS``: how often each class stands before and after every word, a row per block, stored.

    ``held`` are counts, endings and classes of the held words and the end, ``state`` has those of all others. The most frequent
    words and the end come in parts, in blocks of -1, and without what stands between two of them.
    """
    model = table.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, endings, classes = model.value
        width = 2 * AFTER
        hot = np.zeros((n_hot + 1) * width)

        def out(block: int, word, n, kind, own, at: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            sizes = np.bincount(at // width, minlength=len(word))
            cells = (word, n, kind.astype(np.int8), own.astype(np.int8), sizes.astype(np.int32), (at % width).astype(np.int16), _least(total))
            return pa.RecordBatch.from_arrays([pa.array([block]), *(_cells([x]) for x in cells)], names=[c.split()[0] for c in _CONTEXTS.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                word = _numpy(batch, i, "words")
                is_held, known = word >= 0, np.maximum(word, 0)
                rest, *of_rest = _state_of(batch, i, "s_")
                at_rest = np.searchsorted(rest, word[~is_held])
                n, kind, own = counts[known], endings[known], classes[known]
                for of, given in zip((n, kind, own), of_rest):
                    of[~is_held] = given[at_rest]
                row, nbr = np.repeat(np.arange(len(word)), _numpy(batch, i, "near_sizes", np.int32)), _numpy(batch, i, "near", np.int32)
                k = _counts(batch, i, "near_counts", len(nbr))
                slots, sums = row * width + classes[nbr] + np.where(k > 0, AFTER, 0), np.abs(k)
                # a frequent neighbour sees this word on the other side
                some = (nbr < n_hot) | (nbr == end)
                np.add.at(hot, np.minimum(nbr[some], n_hot).astype(np.int64) * width + own[row[some]] + np.where(k[some] < 0, AFTER, 0), sums[some])
                handed = batch.column("handed")[i].values
                far = np.frombuffer(b"".join(handed.to_pylist() if handed is not None else []), _HANDED)
                far_rows = np.searchsorted(word, far["word"])
                order = np.argsort(far_rows)
                far_rows, v = far_rows[order], far["v"][order]
                far_slots = far_rows * width + far["slot"][order]
                found, total = [], []
                for start in range(0, len(word), 256):  # a dense table that stays in the processor's cache
                    low, high = start * width, min(start + 256, len(word)) * width
                    a, b = np.searchsorted(row, [start, start + 256])
                    dense = np.bincount(slots[a:b] - low, sums[a:b], high - low)
                    if len(far_slots):
                        c, d = np.searchsorted(far_rows, [start, start + 256])
                        dense = dense + np.bincount(far_slots[c:d] - low, v[c:d], high - low)  # without entries bincount gives integers
                    at = np.flatnonzero(dense)
                    found.append(at + low)
                    total.append(dense[at])
                yield out(batch.column("block")[i].as_py(), word, n, kind, own, np.concatenate(found), np.concatenate(total))
        seen = np.flatnonzero(hot.reshape(-1, width).any(1))
        none = np.zeros(len(seen), np.int64)
        left = hot.reshape(-1, width)[seen].ravel()
        at = np.flatnonzero(left)
        yield out(-1, np.where(seen == n_hot, end, seen), none, none, none, at, left[at])

    rest = state.selectExpr("block", "words AS s_words", "n AS s_n", "ending AS s_ending", "class AS s_class")
    return _stored(table.select("block", "words", "near_sizes", "near", "near_counts")
                   .join(rest.hint("shuffle_hash"), "block", "left")
                   .join(_far(table, state, n_hot, end, buckets).hint("shuffle_hash"), "block", "left").mapInArrow(run, _CONTEXTS))


def _context_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """Row, slot and count of all entries in a block."""
    sizes, slot = _numpy(batch, i, "sizes", np.int32), _numpy(batch, i, "slots", np.int16).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), slot, _counts(batch, i, "counts", len(slot))


def _flat(batch: pa.RecordBatch, lists: str, values: str = "counts") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, entry and count of all entries in a batch of rows with lists."""
    entries, counts = batch.column(lists), batch.column(values)
    lengths = np.diff(entries.offsets.to_numpy())
    return (np.repeat(np.arange(batch.num_rows), lengths), entries.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy())


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, slots, v``: a row per entry."""
    for batch in batches:
        for i in range(batch.num_rows):
            row, slot, n = _context_of(batch, i)
            yield pa.RecordBatch.from_arrays([pa.array(_numpy(batch, i, "words")[row]), pa.array(slot), pa.array(n)], names=["word", "slots", "v"])


def _word_bigrams(rows: DataFrame, n_classes: int) -> np.ndarray:
    """Class bigrams by the first word's entries; then those of words seen once, under their ending and under their class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, n_classes, n_classes))
        for batch in batches:
            for i in range(batch.num_rows):
                row, slot, n = _context_of(batch, i)
                _, seen, kind, own = _state_of(batch, i)
                own, once, unseen = own.astype(np.int64)[row], (seen == 1)[row], CLASSES + kind.astype(np.int64)[row]
                after, c = slot >= AFTER, slot % AFTER
                np.add.at(total[0], (own[after], c[after]), n[after])
                for part, name in ((1, unseen), (2, own)):
                    for some, l, r in ((once & after, name, c), (once & ~after, c, name)):
                        np.add.at(total[part], (l[some], r[some]), n[some])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], names=["at", "n"])

    table = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(3 * n_classes * n_classes)
    out[table.column("at").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(3, n_classes, n_classes)


def _pmi(bigrams: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed transitions to the share of the class, so that words seen once do not go after chance pairs."""
    share = (bigrams.sum(0) + 1) / (bigrams.sum() + len(bigrams))
    return np.log(10) * _logs(bigrams) - np.log(share)


def exchange_words_all(pairs: DataFrame, assigned: DataFrame, n_hot: int, end: int,
                       rounds: int = WORD_ROUNDS) -> tuple[DataFrame, np.ndarray, list[float]]:
    """``exchange_rows`` of the pairs ``l, r, n``."""
    buckets = _buckets(pairs.agg(F.sum("n")).first()[0] or 0)
    table, units = _block_table(_pair_rows(pairs, n_hot, end, buckets), buckets)
    return exchange_rows(table, units, np.arange(n_hot + 1), assigned, n_hot, end, buckets, rounds)


def exchange_rows(table: DataFrame, units: DataFrame, hot_unit: np.ndarray, assigned: DataFrame, n_hot: int, end: int,
                  buckets: int = 1, rounds: int = WORD_ROUNDS) -> tuple[DataFrame, np.ndarray, list[float]]:
    """``word, n, ending, class`` of every training word after exchanges over all of them, the class bigrams, and the
    information before each round. In the bigrams a word seen once counts half as itself and half as a word never
    seen, under its ending.

    ``assigned`` has the first classes; ``hot_unit`` says which of the ``n_hot`` most frequent words (``n_hot``: the end) a unit
    is, or -1. In a round every word moves to the class under which its own contexts are likeliest. The words' blocks stay where
    they are: classes of held neighbours come as one array, those of other neighbours are handed on by these. Only tables of
    classes, the held words' classes and the contexts of the most frequent words and the end come to the driver.
    """
    given = assigned.where("word >= 0").toArrow()
    counts, endings, classes = (np.zeros(end + 1, np.int64) for _ in range(3))
    for of, c in ((counts, "n"), (endings, "ending"), (classes, "class")):
        of[given.column("word").to_numpy()] = given.column(c).to_numpy()
    classes, state, bigrams, history = _exchange(table, units, hot_unit, (counts, endings, classes),
                                                 _state(assigned.where("word < 0"), buckets), n_hot, end, buckets, rounds)
    known = table.sparkSession.createDataFrame(pa.table({
        "word": pa.array(np.arange(end + 1)), "n": pa.array(counts), "ending": pa.array(endings.astype(np.int32)),
        "class": pa.array(classes.astype(np.int32))}))
    return known.unionByName(_state_rows(state)), bigrams, history


def _exchange(table: DataFrame, units: DataFrame, hot_unit: np.ndarray, held: tuple[np.ndarray, ...], state: DataFrame, n_hot: int, end: int,
              buckets: int, rounds: int = WORD_ROUNDS) -> tuple[np.ndarray, DataFrame, np.ndarray, list[float]]:
    """``exchange_rows`` with the held words and the end as arrays (``held``: counts, endings, classes) and all others as the table
    ``state``: rows of held words in a plan would stay in the driver, once more with every plan made from it."""
    n_classes, width = CLASSES + ENDINGS + 1, 2 * AFTER
    counts, endings, classes = held
    hot = np.r_[np.arange(n_hot), end]
    best, history = None, []
    for turn in range(rounds + 1):
        contexts = _word_contexts(table, state, (counts, endings, classes), n_hot, end, buckets)
        own = contexts.where("block >= 0")
        main, *once = _word_bigrams(own, n_classes)
        few = (contexts.where("block < 0").mapInArrow(_context_rows, "word long, slots long, v long")
               .groupBy("word", "slots").agg(F.sum("v").alias("v")).toArrow())
        word, slot, v = (few.column(c).to_numpy().astype(np.int64) for c in ("word", "slots", "v"))
        seen = np.zeros((n_hot + 1, width))
        np.add.at(seen, (np.minimum(word, n_hot), slot), v)
        among = _contexts(units, np.where(hot_unit >= 0, classes[hot[hot_unit]], -1), n_classes)
        for part, start in zip(among, (0, AFTER)):
            np.add.at(seen, (hot_unit[hot_unit >= 0], slice(start, start + n_classes)), part[hot_unit >= 0])
        before, after = seen[:, :n_classes], seen[:, AFTER: AFTER + n_classes]
        np.add.at(main, classes[hot], after)
        for i in np.flatnonzero((counts[hot] == 1) & (hot != end)):  # frequent words seen once, in small corpora
            for part, name in zip(once, (CLASSES + endings[i], classes[i])):
                part[name] += after[i]
                part[:, name] += before[i]
        history.append(information(main))
        # in the first round endings are classes too, so that its information does not compare
        if best is None or len(history) == 2 or history[-1] > best[0]:
            best = (history[-1], classes, state, main + (once[0] - once[1]) / 2)
        if turn == rounds:
            break
        pmi = _pmi(main)
        weights = np.zeros((width, CLASSES))
        weights[:n_classes], weights[AFTER: AFTER + n_classes] = pmi[:, :CLASSES], pmi[:CLASSES].T

        def move(batches: Iterator[pa.RecordBatch], turn=turn, weights=weights) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row, slot, n = _context_of(batch, i)
                    word, seen, kind, old = _state_of(batch, i)
                    new = old.copy()
                    for start in range(0, len(word), 1024):
                        part = min(1024, len(word) - start)
                        a, b = np.searchsorted(row, [start, start + part])
                        dense = np.bincount((row[a:b] - start) * width + slot[a:b], n[a:b], part * width)
                        new[start: start + part] = (dense.reshape(part, width) @ weights).argmax(1)
                    if turn:
                        new = np.where(word % 2 == turn % 2, new, old)
                    rest = word < 0
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("block")[i: i + 1], *(_cells([x]) for x in (word[rest], seen[rest], kind[rest], new[rest], word[~rest], new[~rest]))],
                        names=["block", "words", "n", "ending", "class", "held", "held_class"])

        moved = _stored(own.mapInArrow(move, _STATE + ", held binary, held_class binary"))
        state, found_held = moved.drop("held", "held_class"), moved.where("length(held) > 0").select("held", "held_class").toArrow()
        moving = (hot != end) & (hot % 2 == turn % 2) & (turn > 0)
        found = np.where(moving, (seen @ weights).argmax(1), classes[hot])
        classes = classes.copy()
        for i in range(found_held.num_rows):
            classes[_numpy(found_held, i, "held")] = _numpy(found_held, i, "held_class", np.int8)
        classes[hot] = found
    _, classes, state, bigrams = best
    return classes, state, bigrams, history


def _logs(bigrams: np.ndarray) -> np.ndarray:
    """log10 of the smoothed transition probabilities between classes."""
    share = (bigrams.sum(0) + 1) / (bigrams.sum() + len(bigrams))
    return np.log10((bigrams + PRIOR * share) / (bigrams.sum(1, keepdims=True) + PRIOR))


def mixed(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """log10 of the mean of two probabilities given as log10."""
    top = np.maximum(one, other)
    return top + np.log10((10 ** (one - top) + 10 ** (other - top)) / 2)


_SCORED = ("row long, id long, held_out boolean, k long, known long, base double, score double, key long, at int, ending int, "
           "before int, after int, rough double, rough_after double, own_after double")


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: str | None = None,
                exchange_words: int = EXCHANGE_WORDS, held_words: int = HELD_WORDS) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``held_out`` is a SQL condition on ``id_col``; rows that meet it are scored and not learned from (default:
    crc32 of the id modulo 7 is 2). ``score`` is the log10 probability of the text, each token's being the
    mean of two models of transitions between classes times emissions of words: one with every training word in an
    exchanged class, one with words outside the exchange vocabulary in the class of their ending; ``base_score`` that of single tokens with one added to all counts and one
    unknown word. ``train_tokens`` is the number of training tokens, ends included.

    Counts of all words, pairs and classes come from all training texts, and every training word is exchanged between
    classes. The model in the workers has a size set by the parameters; counts and classes of words outside it are joined,
    one row per token. Words that training lacks are foreseen by the words seen once with the same ending.

    Null and empty texts are a single end; null ids are learned from; repeated rows are learned from and scored
    each; further columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    importable(spark)
    condition = held_out or f"crc32(CAST(`{id_col}` AS STRING)) % 7 = 2"
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.expr(f"coalesce({condition}, false)").alias("held_out"),
                         F.col(f"`{text_col}`").cast("string").alias("text"))
    training = source.where("NOT held_out").select("text")
    counts = settle(_counted(training))
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = totals["n"] or 0, totals["v"]
    top = (counts.where(F.col("word") != F.lit(bytearray(END))).orderBy(F.desc("n"), "word").limit(held_words)
           .select("word", "n").toArrow())
    held_words_in_order = top.column("word").combine_chunks()
    held, held_counts = held_words_in_order.to_pylist(), top.column("n").to_numpy().astype(np.float64)
    ends = counts.where(F.col("word") == F.lit(bytearray(END))).select("n").first()
    n_ends = ends["n"] if ends else 0
    vocabulary = held[:exchange_words]
    n_classes, end = CLASSES + ENDINGS + 1, len(held)
    buckets = _buckets(n_all)
    table, units = _block_table(_neighbours(training, held, len(vocabulary), buckets), buckets)
    classes, _ = cluster_units(units, len(vocabulary))
    _, after = _contexts(units, classes, n_classes)
    coarse = np.zeros((n_classes, n_classes))
    np.add.at(coarse, classes, after)
    coarse = _logs(coarse)
    first = endings_of(held_words_in_order).astype(np.int32)
    first_class = CLASSES + first
    first_class[: len(vocabulary)] = classes[: len(vocabulary)]
    # held words are the first by count and word: the others are those behind the last of them
    behind = f"n < {int(held_counts[-1])} OR n = {int(held_counts[-1])} AND word > X'{held[-1].hex()}'" if held and end == held_words else "false"
    others = _state(counts.where(F.col("word") != F.lit(bytearray(END))).where(behind)
                    .selectExpr(f"{_REST_ID} AS word", "n", f"{_ENDING} AS ending").withColumn("class", F.expr(f"{CLASSES} + ending")), buckets)
    hot_unit = np.r_[np.arange(len(vocabulary)), np.full(ENDINGS, -1), len(vocabulary)]
    held_n = held_counts.astype(np.int64)
    known = (np.r_[held_n, n_ends], np.r_[first, 0].astype(np.int64), np.r_[first_class, n_classes - 1].astype(np.int64))
    final, state, bigrams, _ = _exchange(table, units, hot_unit, known, others, len(vocabulary), end, buckets)
    rest = _state_rows(state)
    moves, held_class = _logs(bigrams), final[:end]

    # emissions: by counts within the class; of a word never seen, as one more word beside those seen once with its ending
    # in the coarse model, by counts within an exchange class; within a class of endings one is added, also for a word never seen
    core = len(vocabulary)
    mass, once = np.bincount(held_class, held_n, n_classes), np.bincount(first[held_n == 1], minlength=ENDINGS).astype(float)
    coarse_mass, tail = np.bincount(first_class[:core], held_n[:core], n_classes), 1 + np.bincount(first[core:], held_n[core:] + 1, ENDINGS)
    for r in rest.groupBy("class", "ending").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.expr("count_if(n = 1)").alias("once")).collect():
        mass[r["class"]] += r["n"]
        once[r["ending"]] += r["once"]
        tail[r["ending"]] += r["n"] + r["v"]
    tail_log = np.log10(tail)
    coarse_emit = np.r_[np.log10(held_counts[:core]) - np.log10(coarse_mass[first_class[:core]]),
                        np.log10(held_counts[core:] + 1) - tail_log[first[core:]]]
    mass_log, unseen_log = np.log10(np.maximum(mass, 1)), np.log10(once + 1)
    base_log = np.log10(n_all + v_all + 1) if v_all else 0.0
    emit = np.log10(held_counts) - mass_log[held_class]
    plus = np.log10(held_counts + 1)
    end_plus = np.log10(n_ends + 1)
    model = spark.sparkContext.broadcast((held_words_in_order, emit, plus, held_class, coarse_emit, first_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, emits, pluses, classes_of, coarse_emits, coarse_of = model.value
        end_class = n_classes - 1
        emits, coarse_emits = np.r_[emits, 0.0], np.r_[coarse_emits, 0.0]  # the end is certain within its class
        chance, coarse_chance, chances, coarse_chances = (10 ** x.ravel() for x in (moves, coarse, emits, coarse_emits))
        row = TaskContext.get().partitionId() << 40

        def scored(part: pa.RecordBatch, lengths: np.ndarray, codes: np.ndarray, endings: np.ndarray, row: int) -> pa.RecordBatch:
            """Rows of the texts, then one per word that is not held. The texts stand in one line, an end before and after each."""
            text = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(codes)) + text  # of a word among the tokens, ends included
            known = codes >= 0
            rest = np.flatnonzero(~known)
            ids, at, at_rest = codes[known], place[known], place[rest]
            kinds = endings[rest]
            # per token: its number and its classes in both models; a word not held has no class in the first
            size = len(codes) + len(lengths)
            number = np.full(size, len(names), np.int64)
            line, plain = np.full(size + 1, end_class, np.int64), np.full(size + 1, end_class, np.int64)
            number[at], line[at + 1], plain[at + 1] = ids, classes_of[ids], coarse_of[ids]
            line[at_rest + 1], plain[at_rest + 1] = -1, CLASSES + kinds
            both = (line[:-1] >= 0) & (line[1:] >= 0)
            some = np.flatnonzero(both)
            # the mean of two probabilities, all far above the least number that a double holds
            one, other, own = line[some] * n_classes + line[some + 1], plain[some] * n_classes + plain[some + 1], number[some]
            each = np.log10((chance[one] * chances[own] + coarse_chance[other] * coarse_chances[own]) / 2)
            rough, after = coarse[plain[at_rest], plain[at_rest + 1]] - tail_log[kinds], at_rest + 1
            rough_after = coarse[plain[after], plain[after + 1]] + coarse_emits[number[after]]
            starts = np.cumsum(lengths + 1) - lengths - 1
            score = [x.sum() for x in np.split(each, np.cumsum(np.add.reduceat(both.astype(np.int64), starts))[:-1])]
            own_known = np.bincount(text[known], minlength=len(lengths))
            plus = np.array([x.sum() for x in np.split(pluses[ids], np.cumsum(own_known)[:-1])])
            rows = row + np.arange(len(lengths))
            none = pa.nulls(len(rest))
            # a text's own row carries a key that no word has, so that it passes the join without gathering anywhere
            texts = [pa.array(rows), part.column(0), part.column(1), pa.array(lengths + 1), pa.array(own_known + int(n_ends > 0)),
                     pa.array(plus + end_plus - (lengths + 1) * base_log), pa.array(np.array(score)), pa.array(rows)]
            words_of = [pa.array(rows[text[rest]]), *[none.cast(x.type) for x in texts[1:7]], pa.array(codes[rest]),
                        pa.array((at_rest - starts[text[rest]]).astype(np.int32)), pa.array(kinds.astype(np.int32)),
                        pa.array(line[at_rest].astype(np.int32)), pa.array(line[at_rest + 2].astype(np.int32)),
                        pa.array(rough), pa.array(rough_after), pa.array(emits[number[after]])]
            texts += [pa.nulls(len(lengths), x.type) for x in words_of[8:]]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(texts, words_of)],
                                              names=[c.split()[0] for c in _SCORED.split(", ")])

        for batch in batches:
            first = 0
            for piece in _pieces(batch.column(2)):
                flat, lengths = _split(piece)
                coded = flat.dictionary_encode()
                number, kind = _numbers(coded.dictionary, names)
                code = coded.indices.to_numpy()
                at = np.r_[0, np.cumsum(lengths)]
                # up to 512 texts, with about 2^18 words
                group = at[:-1] >> 18
                start = 0
                while start < len(lengths):
                    stop = min(start + 512, int(np.searchsorted(group, group[start], "right")))
                    some = code[at[start]: at[stop]]
                    yield scored(batch.slice(first + start, stop - start), lengths[start:stop], number[some], kind[some], row)
                    row, start = row + stop - start, stop
                first += len(lengths)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, score = batch.column("rest"), batch.column("score").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(rest.offsets.to_numpy()))
            flat = rest.flatten()
            at, n, cls, before, after = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            order = np.lexsort((at, row))
            n, cls, before, after = n[order], cls[order], before[order], after[order]
            rough, rough_after, own_after = (flat.field(i).to_numpy(zero_copy_only=False).astype(float)[order] for i in (5, 6, 7))
            if len(cls):
                # a neighbour that is no held word either is the entry beside
                into = moves[np.where(before >= 0, before, np.r_[0, cls[:-1]]), cls]
                into += np.where(n > 0, np.log10(np.maximum(n, 1)) - mass_log[cls], -unseen_log[np.clip(cls - CLASSES, 0, ENDINGS - 1)])
                more = mixed(into, rough + np.log10(n + 1))
                more += np.where(after >= 0, mixed(moves[cls, np.maximum(after, 0)] + own_after, rough_after), 0)
                score = score + np.bincount(row[order], more, batch.num_rows)
            names = [f.name for f in batch.schema][:-2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    joined = source.mapInArrow(run, _SCORED).join(rest.selectExpr("word AS key", "n", "class").hint("merge"), "key", "left")
    texts = joined.groupBy("row").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("k").alias("n_tokens"),
        F.sum(F.expr("coalesce(known, CASE WHEN n > 0 THEN 1 ELSE 0 END)")).alias("n_known"),
        F.sum(F.expr("coalesce(base, log10(coalesce(n, 0) + 1))")).alias("base_score"), F.max("score").alias("score"),
        F.collect_list(F.expr(f"CASE WHEN at IS NOT NULL THEN struct(at, coalesce(n, 0L) AS n, coalesce(class, {CLASSES} + ending) AS class,"
                              " before, after, rough, rough_after, own_after) END")).alias("rest"))
    return (texts.drop("row").select("id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest")
            .mapInArrow(finish, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
            .select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score"))
