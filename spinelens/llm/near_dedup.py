"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.llm._store import importable, settle, settle_few, sized
from spinelens.llm.components import components, joined

#: MinHash samples: bands x rows. A pair of similarity 0.8 shares no band with a chance below 1e-6.
BANDS, ROWS = 36, 5
#: One-permutation MinHash samples (a power of two) that an odd sketch folds, and its bits, a multiple of 64.
SAMPLES, BITS = 1024, 1024
#: Standard deviations of the sketches' estimate by which it may fall short of the threshold.
SLACK = 4.0
#: Members of a bucket that meet in one block: outside its largest component, and all.
STRAYS, MEMBERS = 512, 1024
#: Hashes of words kept per worker; others are computed again.
WORDS = 1 << 18

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = _U(0x9E3779B97F4A7C15)
_SEEDS = _mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=_U) * _STEP)
_XOR, _ODD = _SEEDS[: BANDS * ROWS], _SEEDS[BANDS * ROWS:] | _U(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS and len(word) <= 64:
            self[word] = value
        return value


_hashes = _WordHashes()


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; with fewer words, of all its words.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z in lower case. No words, no shingles.
    """
    words = text.encode().lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), _U, len(words))
    if not len(h):
        return h
    width = min(k, len(h))
    out = h[: len(h) - width + 1]
    for j in range(1, width):
        out = _mix(out * _STEP + h[j: len(h) - width + 1 + j])
    return np.unique(_mix(out + _U(width)))


def bands_of(items: np.ndarray) -> np.ndarray:
    """Band keys of a non-empty set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, _U)
    for start in range(0, len(items), 1024):
        block = items[start: start + 1024, None] ^ _XOR
        block *= _ODD
        np.minimum(least, block.min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=_U)
    for j in range(ROWS):
        keys = _mix(keys * _STEP + bands[:, j])
    return keys.view(np.int64)


def sketch_of(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd sketch and occupied samples of a set (sorted hashes), as 64-bit words.

    The hashes' upper bits are a sample's number, its smallest hash is the sample; every sample flips one
    bit of the sketch. A small set is nearly its own sample, so the estimate is sharpest there.
    """
    place = items >> _U(64 - (SAMPLES.bit_length() - 1))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    occupied = np.zeros(SAMPLES, np.uint8)
    occupied[place[first].astype(np.int64)] = 1
    flips = np.bincount((_mix(items[first]) % _U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64), np.packbits(occupied).view(np.int64)


def _ready(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    importable(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _digest(items: np.ndarray) -> tuple[int, int]:
    import xxhash

    raw = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), dtype=np.int64)
    return int(raw[0]), int(raw[1])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``id, n, d1, d2, bands, odd, taken`` of ``id, text`` rows: set size and digest, band keys, sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, bands, odd, taken = [], [], [], [], [], []
            for text in batch.column(1):
                items = shingles(text.as_py() or "", k)
                one, two = _digest(items)
                sketch, occupied = sketch_of(items) if len(items) else (None, None)
                n.append(len(items))
                d1.append(one)
                d2.append(two)
                bands.append(bands_of(items) if len(items) else None)
                odd.append(sketch)
                taken.append(occupied)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 *(pa.array(c, pa.list_(pa.int64())) for c in (bands, odd, taken))],
                names=["id", "n", "d1", "d2", "bands", "odd", "taken"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, bands array<long>, odd array<long>, taken array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingles(t.as_py() or "", k).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "items"])

    return docs.mapInArrow(run, "id long, items array<long>")


def _bits(left: str, op: str, right: str) -> str:
    words = (SAMPLES if op == "|" else BITS) // 64
    return "(" + " + ".join(f"bit_count(get({left}, {i}) {op} get({right}, {i}))" for i in range(words)) + ")"


def _plausible(percent: int) -> str:
    """Set sizes allow the threshold, and the sketches' estimate does not lie ``SLACK`` deviations below it.

    With u occupied samples in either set, d of them told apart by the flipped bits and m + n in all, the
    estimate is (m + n - d) / 2u. Its variance is that of drawing u of the union's elements without
    replacement, and that of d, both at the threshold.
    """
    j = percent / 100
    union, total = _bits("x.taken", "|", "y.taken"), "(x.m + y.m)"
    differ = f"(ln(1D - 2D * least({_bits('x.odd', '^', 'y.odd')}, {BITS // 2 - 1}) / {BITS}D) / {math.log(1 - 2 / BITS)!r}D)"
    at = f"greatest({total} - {2 * j!r}D * {union}, 1D)"
    fade = f"exp(-4D * {at} / {BITS}D)"
    noise = f"(({BITS // 4}D * (1D - {fade}) - {at} * {fade}) / {fade} + 1D)"
    drawn = f"(1D - least(1D, {1 + j!r}D * {union} / (x.n + y.n)))"
    deviation = f"sqrt({j * (1 - j)!r}D / {union} * {drawn} + {noise} / (4D * {union} * {union}))"
    return (f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
            f" AND ({total} - {differ}) / (2D * {union}) >= {j!r}D - {SLACK}D * {deviation}")


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members outside their bucket's largest component, and all members, dealt into blocks of bounded size.

    Both sides have ``key, sb, mb``; every pair of the two meets in exactly one block.
    """
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    major = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("x"), F.sum("c").alias("all")).selectExpr(
        "key", "x.root AS major", f"CAST(ceil((all - x.c) / {STRAYS}) AS INT) AS ns", f"CAST(ceil(all / {MEMBERS}) AS INT) AS nm")
    placed = rows.join(major, "key").where("ns > 0")
    strays = placed.where("root <> major").withColumns({
        "sb": F.expr("CAST(pmod(xxhash64(node), ns) AS INT)"), "mb": F.explode(F.expr("sequence(0, nm - 1)"))})
    members = placed.withColumns({
        "mb": F.expr("CAST(pmod(xxhash64(node), nm) AS INT)"), "sb": F.explode(F.expr("sequence(0, ns - 1)"))})
    # fresh column identities: both sides come from the same rows
    names = [*rows.columns, "sb", "mb"]
    return strays.select(*names).toDF(*names), members.select(*names).toDF(*names)


def _words_of(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).view(_U).reshape(len(column), -1)


def _estimated(x: dict, y: dict, percent: int) -> np.ndarray:
    """Which pairs of two blocks are plausible; the numpy form of ``_plausible``."""
    j = percent / 100
    out = np.zeros((len(x["n"]), len(y["n"])), bool)
    for i in range(len(out)):
        union = np.bitwise_count(x["taken"][i] | y["taken"]).sum(1).astype(float)
        flips = np.bitwise_count(x["odd"][i] ^ y["odd"]).sum(1)
        total = (x["m"][i] + y["m"]).astype(float)
        differ = np.log(1 - 2 * np.minimum(flips, BITS // 2 - 1) / BITS) / math.log(1 - 2 / BITS)
        at = np.maximum(total - 2 * j * union, 1)
        fade = np.exp(-4 * at / BITS)
        noise = (BITS / 4 * (1 - fade) - at * fade) / fade + 1
        drawn = 1 - np.minimum(1, (1 + j) * union / (x["n"][i] + y["n"]))
        deviation = np.sqrt(j * (1 - j) / union * drawn + noise / (4 * union * union))
        out[i] = (100 * np.minimum(x["n"][i], y["n"]) >= percent * np.maximum(x["n"][i], y["n"])) & (
            (total - differ) / (2 * union) >= j - SLACK * deviation) & (x["root"][i] != y["root"])
    return out


def _sketched(table: pa.Table) -> dict:
    return {c: table.column(c).to_numpy() for c in ("node", "root", "n", "m")} | {
        c: _words_of(table, c) for c in ("odd", "taken")}


def _across(rows: DataFrame, sketches: DataFrame, source: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``a, b`` between different components of a bucket, from ``key, node, root`` and sketches by node.

    Members outside the largest component meet all members in blocks. The first pass only says which rows have
    a plausible partner; the second compares their full sets and gives, per member and other component, one
    link. Neither emits pairs that are no links. Sketches and sets join the dealt rows last, so they are moved once.
    """
    by = ["key", "sb", "mb"]

    def plausible(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            x, y = _sketched(left), _sketched(right)
            hit = _estimated(x, y, percent)
            found = np.unique(np.concatenate([x["node"][hit.any(1)], y["node"][hit.any(0)]]))
        key = left.column("key")[0].as_py() if left.num_rows else 0
        return pa.table({"key": pa.array([key] * len(found), pa.int64()), "node": pa.array(found, pa.int64())})

    def met(dealt: DataFrame, payload: DataFrame, compare, schema: str) -> DataFrame:
        sides = []
        for side in _blocks(dealt):
            full = side.join(payload, "node")
            sides.append(full.toDF(*full.columns).groupBy(*by))
        return sides[0].cogroup(sides[1]).applyInArrow(compare, schema).distinct()

    likely = settle_few(met(rows, sketches, plausible, "key long, node long"))
    wanted = settle_few(likely.select(F.col("node").alias("id")).distinct())
    sets = settle(_sets(source.join(sized(wanted), "id", "left_semi"), k)).withColumnRenamed("id", "node")

    def linked(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            x, y = _sketched(left), _sketched(right)
            hit = _estimated(x, y, percent)
            mine, theirs = ([s.values.to_numpy().view(_U) for s in t.column("items").combine_chunks()] for t in (left, right))
            for i in np.flatnonzero(hit.any(1)):
                met = set()
                for o in np.flatnonzero(hit[i]):
                    if y["root"][o] in met:
                        continue
                    s, t = mine[i], theirs[o]
                    at = np.minimum(np.searchsorted(s, t), len(s) - 1)
                    both = int((s[at] == t).sum())
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        met.add(y["root"][o])
                        a.append(max(x["node"][i], y["node"][o]))
                        b.append(min(x["node"][i], y["node"][o]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met(rows.join(likely, ["key", "node"]), sketches.join(sets, "node"), linked, "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked if their sets of k-word shingles have 100 * intersection >= percent * union;
    a component's id is its smallest document id, and that document is kept.

    Documents with equal sets are one node. A band's bucket proposes no pairs within itself: each member is
    paired with one member drawn for the bucket, which links dense groups over their many buckets. Buckets
    that still hold several components are merged by their smallest node; all members outside the largest
    component then meet all members, block by block, so no candidate of the bands stays untested unless its
    ends are connected already. Candidates pass set sizes and sketches, then are confirmed on full sets.

    Null ids are kept, linked with nothing, with a null component; texts without words have no shingles and
    link with nothing; rows that share an id are one document; ties go to the smaller id; further columns
    are left out; an empty table gives no rows.
    """
    source = _ready(docs, id_col, text_col)
    signed = settle(signatures(source, k))
    linked = signed.where("id IS NOT NULL AND n > 0")
    classes = linked.groupBy("d1", "d2").agg(F.min("id").alias("node"))
    nodes = settle(linked.join(classes, ["d1", "d2"]).where("id = node")
                   .select("node", "n", "d1", "d2", "bands", "odd", "taken", F.expr(f"{_bits('taken', '|', 'taken')} AS m"))
                   .dropDuplicates(["d1", "d2"]))
    narrow = nodes.select("node", "n", "m", "odd", "taken")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    # the member drawn for a bucket: the smallest id after an exclusive or with the bucket's random key
    shared = settle_few(banded.groupBy("key").agg(F.min(F.expr("node ^ key")).alias("low"), F.max(F.expr("node ^ key")).alias("high"))
                    .where("low <> high").select("key", F.expr("low ^ key").alias("drawn")))
    members = settle_few(banded.join(sized(shared), "key").select("key", "node", "drawn"))
    x, y = narrow.alias("x"), narrow.alias("y")
    pairs = (members.where("node <> drawn")
             .select(F.greatest("node", "drawn").alias("a"), F.least("node", "drawn").alias("b")).distinct())
    flips = _bits("x.odd", "^", "y.odd")
    pairs = settle_few(pairs.join(x, F.expr("a = x.node")).join(y, F.expr("b = y.node")).where(_plausible(percent))
                   .select("a", "b", F.expr(flips).alias("flips")).distinct())

    def confirmed(candidates: DataFrame) -> DataFrame:
        candidates = settle_few(candidates.select("a", "b").distinct())
        wanted = settle_few(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct())
        sets = settle(_sets(source.join(sized(wanted), "id", "left_semi"), k))
        return (candidates.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
                .selectExpr("a", "b", "size(s) AS m", "size(t) AS n", "size(array_intersect(s, t)) AS i")
                .where(f"100L * i >= {percent}L * (m + n - i)").select("a", "b"))

    def apart(candidates: DataFrame, roots: DataFrame) -> DataFrame:
        return (candidates.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
                .where("coalesce(ra, a) <> coalesce(rb, b)").drop("ra", "rb"))

    nearest = pairs.groupBy("a").agg(F.min(F.struct("flips", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    roots = components(confirmed(nearest))
    roots = joined(roots, confirmed(apart(pairs.join(nearest, ["a", "b"], "left_anti"), roots)))

    placed = (members.select("key", "node").distinct().join(roots, "node", "left")
              .select("key", "node", F.coalesce("root", "node").alias("root")))
    # torn buckets with the same smallest node are one: whoever is in it shares a band with that node
    torn = settle_few(placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("q"), F.min("node").alias("first"))
                  .where("r <> q").select("key", "first"))
    rest = settle_few(placed.join(sized(torn), "key").select(F.col("first").alias("key"), "node", "root").distinct())
    roots = joined(roots, _across(rest, narrow, source, k, percent))

    named = (classes.join(roots, "node", "left")
             .select("d1", "d2", F.coalesce("root", "node").alias("component_id")))
    return (signed.join(named, ["d1", "d2"], "left")
            .selectExpr(f"id AS `{id_col}`", "n AS n_shingles",
                        "CASE WHEN id IS NOT NULL THEN CASE WHEN n = 0 THEN id ELSE component_id END END AS component_id")
            .withColumn("kept", F.expr(f"component_id IS NULL OR component_id = `{id_col}`")))
