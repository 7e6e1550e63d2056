"""Benchmark passages in documents, also with other numbers, names and units."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.llm._store import importable, settle, sized

#: Template tokens of a window, and the fewest of a benchmark item that is searched for.
WIDTH, LEAST = 8, 4
#: Added to the width of a window of plain words.
PLAIN = 100
#: Share of an item's windows that must be found in line, or of its plain words that must be covered anywhere.
SHARE, COVERED = 0.3, 0.5
#: Words of an item in a row that are enough whatever its length.
RUN = 13
#: Characters of the texts that are searched together.
CHUNK_CHARS = 1 << 21
#: A window needs this share of literal words.
LITERAL = 0.5
#: Bits of the broadcast filter, as a power of two: 2 MB whatever the benchmark's size.
FILTER_POWER = 24
WORDS = 1 << 18
#: Unit words that become placeholders after a number.
UNITS = frozenset("""
    % mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs
    pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours
    day days week weeks month months year years hz khz mhz ghz b kb mb gb tb w kw v a c f k degrees degree usd eur gbp
    dollar dollars cent cents euro euros percent meter meters metre metres kilometer kilometers kilometre kilometres
    kilogram kilograms gram grams mph kmh km/h m/s
""".split())

_U = np.uint64
_END, _CAP, _NUMBER, _UNIT, _DROP, _SIGN = 1, 2, 4, 8, 12, 14
_NAME_T, _NUMBER_T, _UNIT_T = _U(0x1F3A5C7E9B2D4F61), _U(0x2E4C6A8B0D1F3E5D), _U(0x3D5B79A7C5E3F102)
_NUMERAL = re.compile(r"[+\-$€£]?\d[\d.,:/]*[^\W\d_]{0,3}%?")
_SIGNS = frozenset("* - – × ÷ −".split())
_EDGES = "\"'`“”‘’«»()[]{}<>*_.,;:!?…-–—"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Tokens(dict):
    """A word's hash with its kind in the low four bits."""

    def __missing__(self, word: str) -> int:
        import xxhash

        body = word.strip(_EDGES)
        kind = (_END if word.rstrip("\"'”’»)]}").endswith((".", "!", "?", ":", "…")) else 0)
        low = body.lower()
        if word in _SIGNS:
            low, kind = word, _SIGN
        elif not body:
            kind |= _DROP
        elif _NUMERAL.fullmatch(body):
            kind |= _NUMBER
        elif low in UNITS:
            kind |= _UNIT
        if body[:1].isupper() and body[1:] == body[1:].lower() and len(body) > 1:
            kind |= _CAP
        value = (xxhash.xxh3_64_intdigest(low.encode()) & ~15) | kind
        if len(self) < WORDS and len(word) <= 64:
            self[word] = value
        return value


_tokens = _Tokens()


class Words:
    """Words of many texts end to end: template tokens, plain words, their slot values (0: a literal word) and texts.

    Words are lower-cased and stripped of punctuation. In the template numerals become one placeholder, unit words
    after a numeral another, runs of capitalised words that do not start a sentence a third. The plain words stay
    single, with slot values for numerals and units only. Signs of arithmetic count as words after a numeral.
    """

    def __init__(self, texts: list[str]):
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        packed = np.fromiter(map(_tokens.__getitem__, chain.from_iterable(split)), _U, int(counts.sum()))
        text = np.repeat(np.arange(len(texts)), counts)
        first = np.ones(len(packed), bool)
        first[1:] = text[1:] != text[:-1]
        # a dropped mark still ends a sentence for what follows
        after_end = first | _before((packed & _U(_END)) > 0)
        middle = packed & _U(_DROP)
        sign = ((packed & _U(_SIGN)) == _U(_SIGN)) & _before(middle == _U(_NUMBER)) & ~first
        kept = (middle != _U(_DROP)) | sign
        packed, middle, text, after_end, sign = packed[kept], middle[kept], text[kept], after_end[kept], sign[kept]
        first = np.ones(len(packed), bool)
        first[1:] = text[1:] != text[:-1]
        number = middle == _U(_NUMBER)
        unit = (middle == _U(_UNIT)) & _before(number) & ~first
        name = ((packed & _U(_CAP)) > 0) & ~after_end & ~number & ~unit & ~sign
        value = packed >> _U(4)
        measured = np.where(number, _NUMBER_T, np.where(unit, _UNIT_T, value))
        slots = np.where(number | unit, value | _U(1), _U(0))
        start = first | ~(name & _before(name))
        self.plain, self.measured, self.plain_slots, self.plain_text = value, measured, slots, text
        self.tokens = np.where(name, _NAME_T, measured)[start]
        named = np.where(name, value | _U(1), slots)
        self.slots = np.add.reduceat(named, np.flatnonzero(start)) if len(named) else named
        self.text = text[start]

    def windows(self, plain: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of ``width`` words inside one text.

        Template windows need enough literal words. A plain window stands with placeholders for numerals and
        units if it has enough literal words, else as it is, so every place has one.
        """
        text, slots = (self.plain_text, self.plain_slots) if plain else (self.text, self.slots)
        n = len(text) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        inside = text[:n] == text[width - 1:]
        literal = np.concatenate([[0], np.cumsum(slots == 0)])
        enough = literal[width:] - literal[:n] >= LITERAL * width
        if not plain:
            at = np.flatnonzero(inside & enough)
            return at, _hashes(self.tokens, width)[at]
        at = np.flatnonzero(inside)
        return at, np.where(enough, _hashes(self.measured, width), _hashes(self.plain, width))[at]


def _before(flags: np.ndarray) -> np.ndarray:
    """Each word's flag at the word before it."""
    out = np.zeros(len(flags), bool)
    out[1:] = flags[:-1]
    return out


def _hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    n = len(tokens) - width + 1
    out = np.full(n, _U(width))
    for j in range(width):
        out *= _U(0x9E3779B97F4A7C15)
        out += tokens[j: n + j]
    return _mix(out)


_COLUMNS = "row_key long, id long, width int, pos int, n_windows int, h long, slots array<long>"


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch with a bounded number of characters; a longer text stands alone."""
    def part(begin: int, end: int) -> tuple[pa.RecordBatch, list[str]]:
        rows = batch.slice(begin, end - begin)
        return rows, [t or "" for t in rows["text"].to_pylist()]

    begin = size = 0
    for i, n in enumerate(pc.utf8_length(batch["text"]).fill_null(0).to_pylist()):
        if size + n > CHUNK_CHARS and i > begin:
            yield part(begin, i)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield part(begin, batch.num_rows)


def _window_table(texts: DataFrame, widths: tuple[int, ...] | None, bits: np.ndarray | None) -> DataFrame:
    """Windows of ``row_key, id, text`` rows. Without ``widths``, a short text is one window of its own width;
    with ``bits``, only windows that the filter may hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, chunk in _chunks(batch):
                words = Words(chunk)
                for plain, mark in ((False, 0), (True, PLAIN)):
                    text, slots = (words.plain_text, words.plain_slots) if plain else (words.text, words.slots)
                    size = np.bincount(text, minlength=len(chunk))
                    start = np.cumsum(size) - size
                    for width in ([w - mark for w in widths if (w >= PLAIN) == plain] if widths is not None
                                  else range(LEAST, WIDTH + 1)):
                        at, hashes = words.windows(plain, width)
                        if widths is None:
                            own = np.minimum(size, WIDTH)[text[at]] == width
                            at, hashes = at[own], hashes[own]
                        total = np.bincount(text[at], minlength=len(chunk))
                        if bits is not None:
                            place = hashes >> _U(64 - FILTER_POWER)
                            hit = (bits[place >> _U(6)] >> (place & _U(63)) & _U(1)).astype(bool)
                            at, hashes = at[hit], hashes[hit]
                        if not len(at):
                            continue
                        row = text[at]
                        values = slots[at[:, None] + np.arange(width)].view(np.int64).ravel()
                        yield pa.RecordBatch.from_arrays([
                            rows["row_key"].take(pa.array(row)), rows["id"].take(pa.array(row)),
                            pa.array(np.full(len(at), mark + width, np.int32)), pa.array((at - start[row]).astype(np.int32)),
                            pa.array(total[row].astype(np.int32)), pa.array(hashes.view(np.int64)),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(values)),
                        ], names=[c.split()[0] for c in _COLUMNS.split(", ")])

    return texts.mapInArrow(run, _COLUMNS)


def row_key(id_col: str, text_col: str) -> str:
    """Names a row also where ids are null or repeat; equal rows share it."""
    return f"xxhash64(CAST(`{id_col}` AS BIGINT), CAST(`{text_col}` AS STRING))"


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``row_key, id_col, item_col, n_windows, n_matched, exact``: items found in documents.

    Both sides become template tokens, and beside them plain words in which numerals and units alone are
    placeholders. An item's windows of ``WIDTH`` tokens (a shorter item is one window) are joined by hash with the
    windows of all whole texts that pass a broadcast filter of fixed size. Windows whose slot values differ count
    only if, at their offset, every slot value of the item stands for one value of the document. An item is found

    * where, at one offset, at least ``share`` of its windows match (copies, re-parameterised questions), or
    * where, at any offsets, plain windows cover ``RUN`` words of it in a row (quoted parts), or
    * where they cover at least ``COVERED`` of its words, and no fewer than ``RUN`` (edited copies).

    So an edited copy is missed if fewer than half of its words stand in runs of ``WIDTH`` unchanged ones.
    ``exact`` says that the template matched with no other slot value, or that all plain windows did. The
    reported counts are the larger ones of both.

    Items with fewer than ``LEAST`` words, null texts and empty texts are never found. Null ids come back
    null; equal rows are one; repeated items are found each; a document that holds an item twice is reported
    once; an empty table on either side gives no rows; further columns are left out.
    """
    importable(docs.sparkSession)
    items = benchmark.select(F.lit(0).cast("long").alias("row_key"), F.col(f"`{item_col}`").cast("long").alias("id"),
                             F.col(f"`{item_text_col}`").cast("string").alias("text"))
    known = settle(_window_table(items, None, None))
    widths = tuple(sorted(r["width"] for r in known.select("width").distinct().collect()))
    bits = np.zeros(1 << (FILTER_POWER - 6), _U)
    # at most one row per 64 bits of the filter
    for r in (known.select(F.shiftrightunsigned("h", 64 - FILTER_POWER).alias("p"))
              .groupBy(F.expr("p >> 6").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("b")).collect()):
        bits[r["w"]] = _U(r["b"] & 0xFFFFFFFFFFFFFFFF)
    texts = docs.select(F.expr(row_key(id_col, text_col)).alias("row_key"), F.col(f"`{id_col}`").cast("long").alias("id"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    seen = _window_table(texts, widths, bits)
    d, b = seen.alias("d"), sized(known.withColumnRenamed("id", "item")).alias("b")
    lines = settle(d.join(b, F.expr("d.h = b.h AND d.width = b.width")).selectExpr(
        "d.row_key", "d.id", "b.item", f"b.width >= {PLAIN} AS plain_words", f"b.width % {PLAIN} AS width", "d.pos - b.pos AS line",
        "b.pos AS pos", "b.n_windows AS n_windows", "b.slots AS theirs", "d.slots AS ours")
        .dropDuplicates(["row_key", "item", "plain_words", "line", "pos"]))
    key = ["row_key", "item", "plain_words", "line"]
    slots = (lines.select(*key, F.explode(F.arrays_zip("theirs", "ours")).alias("s")).where("s.theirs <> 0")
             .select(*key, "s.theirs", "s.ours").distinct()
             .groupBy(*key).agg((F.count("*") == F.count_distinct("theirs")).alias("consistent"),
                                F.bool_and(F.expr("theirs = ours")).alias("same")))
    # per offset at most the item's own windows
    runs = (lines.groupBy(*key).agg(F.max("id").alias("id"), F.max("n_windows").alias("n_windows"), F.max("width").alias("width"),
                                    F.collect_set("pos").alias("all"),
                                    F.collect_set(F.expr("CASE WHEN theirs = ours THEN pos END")).alias("unchanged"))
            .join(slots, key, "left")
            .selectExpr("row_key", "id", "item", "plain_words", "n_windows", "width",
                        "CASE WHEN coalesce(consistent, true) THEN all ELSE unchanged END AS at",
                        "CASE WHEN plain_words THEN size(unchanged) = n_windows ELSE coalesce(same, true) OR NOT consistent END AS exact"))
    in_line = runs.selectExpr("row_key", "id", "item", "n_windows", "CAST(size(at) AS BIGINT) AS n_matched", "exact").where(
        f"n_matched >= greatest(least(2, n_windows), ceil({share}D * n_windows))")
    spread = (runs.where("plain_words").select("row_key", "id", "item", "n_windows", "width", F.explode("at").alias("pos"))
              .groupBy("row_key", "item").agg(F.max("id").alias("id"), F.max("n_windows").alias("n_windows"),
                                              F.max("width").alias("width"), F.sort_array(F.collect_set("pos")).alias("at")))
    row = RUN - WIDTH  # from the first to the last window of a run
    spread = spread.selectExpr(
        "row_key", "id", "item", "n_windows", "CAST(size(at) AS BIGINT) AS n_matched", "false AS exact",
        "width + aggregate(sequence(1, size(at)), 0, (n, i) -> n + coalesce(least(width, get(at, i) - get(at, i - 1)), 0)) AS covered",
        f"width = {WIDTH} AND exists(sequence(0, size(at) - 1), i -> get(at, i + {row}) - get(at, i) = {row}) AS quoted",
    ).where(f"quoted OR covered >= greatest({RUN}, ceil({COVERED}D * (n_windows + {WIDTH} - 1)))").drop("covered", "quoted")
    return (in_line.unionByName(spread).groupBy("row_key", "item")
            .agg(F.max("id").alias("id"), F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"),
                 F.bool_or("exact").alias("exact"))
            .selectExpr("row_key", f"id AS `{id_col}`", f"item AS `{item_col}`", "CAST(n_windows AS BIGINT) AS n_windows",
                        "CAST(n_matched AS BIGINT) AS n_matched", "exact"))
