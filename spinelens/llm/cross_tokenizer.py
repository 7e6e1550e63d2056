"""Cross-tokenizer alignment: id pairs counted over the corpus by external spill counting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.llm import spill_runs, token_pairs
from spinelens.llm._store import importable, stored

#: Parts that the ids of B are dealt to. A part's counted pairs are held in one task, its records are not.
RADIXES = 16
#: Links and documents after which a task sorts what it has and writes it as one run per part.
RUN_LINKS = 1 << 20
RUN_DOCS = 1 << 16
#: Characters taken together by a worker.
BATCH_CHARS = 1 << 20
#: Runs merged by one task at a time, and runs of records that one task gives back.
FAN_IN = 256
RUNS_PER_TASK = 64

_WRITTEN = ("run bigint, row int, part int, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
            " groups_sha256 string, totals binary, records binary")


def _bits(n: int) -> int:
    return max(1, int(n - 1).bit_length())


class _Run:
    """Links of consecutive documents of one task; sorted by part, id of B, id of A and document."""

    def __init__(self, a_ids: int, b_ids: int, radixes: int):
        self.a_bits, self.radixes = _bits(a_ids), radixes
        self.per_part = -(-b_ids // radixes)
        self.keys: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.n_links = self.n_docs = 0

    def add(self, links: np.ndarray, row: np.ndarray) -> None:
        b = links[:, 1]
        self.keys.append((((b % self.radixes) * self.per_part + b // self.radixes) << self.a_bits) | links[:, 0])
        self.rows.append(row)
        self.n_links += len(links)

    def parts(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Per part: its pairs with their totals, and its pair-document records."""
        if not self.n_links:
            return
        doc_bits = _bits(self.n_docs + 1)
        record = np.sort((np.concatenate(self.keys) << doc_bits) | np.concatenate(self.rows))
        record, n = spill_runs.summed(record, np.ones(len(record), np.int64))
        pair, row = record >> doc_bits, record & ((1 << doc_bits) - 1)
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        docs = np.diff(np.r_[starts, len(pair)])
        totals, pairs = np.add.reduceat(n, starts), pair[starts]
        part = (pairs >> self.a_bits) // self.per_part
        n_kind = np.int32 if n.max() >= 1 << 15 else np.int16
        for p in np.unique(part).tolist():
            lo, hi = np.searchsorted(part, p, "left"), np.searchsorted(part, p, "right")
            at, end = starts[lo], starts[hi] if hi < len(starts) else len(pair)
            yield (p, spill_runs.packed(pairs[lo:hi], totals[lo:hi]),
                   spill_runs.packed(pairs[lo:hi], docs[lo:hi].astype(np.int32), row[at:end].astype(np.int32),
                                     n[at:end].astype(n_kind)))


def _encode_and_spill(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, radixes: int,
                      run_links: int) -> DataFrame:
    """A row per document with its own figures (``part`` null), and a row per run and part."""
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = docs.select(F.col(id_col).alias("id")).limit(0).toArrow().schema.field("id").type

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = token_pairs.load(a_path, b_path)
        task, number = TaskContext.get().partitionId(), 0
        empty = _Run(len(aligner.a.raw), len(aligner.b.raw), radixes)
        run = empty
        schema = pa.schema([
            ("run", pa.int64()), ("row", pa.int32()), ("part", pa.int32()), ("id", id_type),
            *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
            ("totals", pa.binary()), ("records", pa.binary())])

        def table(n, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def runs() -> Iterator[pa.RecordBatch]:
            for part, totals, records in run.parts():
                yield table(1, run=[key()], part=[part], totals=[totals], records=[records])

        def key() -> int:
            return (task << 32) | number

        for batch in batches:
            ids, texts = batch.column(0), ["" if t is None else t for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_CHARS):
                    size += len(texts[hi])
                    hi += 1
                found = aligner.numbers(texts[lo:hi])
                lens = np.array([len(x) for x in found], np.int64)
                flat = np.concatenate(found)
                links, counts = aligner.links_of(flat)
                doc = np.repeat(np.arange(hi - lo), lens)
                shape = np.zeros((hi - lo, 3), np.int64)
                np.add.at(shape, doc, aligner.shape[flat])
                n_links = np.zeros(hi - lo, np.int64)
                np.add.at(n_links, doc, counts)
                names = [hashlib.sha256(aligner.joined(x).encode()).hexdigest() if len(x) else "" for x in found]
                rows = run.n_docs + np.arange(hi - lo)
                run.add(links, np.repeat(rows[doc], counts))
                run.n_docs += hi - lo
                yield table(hi - lo, run=np.full(hi - lo, key()), row=rows, id=ids.slice(lo, hi - lo), n_a=shape[:, 0],
                            n_b=shape[:, 1], n_groups=shape[:, 2], n_links=n_links, groups_sha256=names)
                if aligner.full():
                    aligner.reset()
                if run.n_links >= run_links or run.n_docs >= RUN_DOCS:
                    yield from runs()
                    number += 1
                    run = _Run(len(aligner.a.raw), len(aligner.b.raw), radixes)
                lo = hi
        yield from runs()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(work, _WRITTEN.format(kind=kind)), "pairs")


def _merged(groups, shift: int, last: bool):
    """A function for ``applyInArrow``: totals of a group of runs, merged; finally with the best of each side."""
    def work(table: pa.Table) -> pa.Table:
        runs = [tuple(spill_runs.unpacked(f)) for f in table.column("totals").to_pylist()]
        blocks = spill_runs.merged(runs)
        if last:
            blocks = ((k, n, b.astype(np.int8)) for k, n, b in spill_runs.with_best(blocks, shift))
        columns = [np.concatenate(c) for c in zip(*blocks)]
        return pa.table({"part": table.column("part").slice(0, 1), "run": table.column("run").slice(0, 1),
                         "totals": pa.array([spill_runs.packed(*columns)], pa.binary())})

    return work


def _counts(runs: DataFrame, most: int, shift: int) -> DataFrame:
    """``part, totals``: all pairs of a part with their counts and whether these are their side's highest.

    Runs are merged ``FAN_IN`` at a time until one task can merge a part.
    """
    shape, totals = "part int, run bigint, totals binary", runs.select("part", "run", "totals")
    while most > FAN_IN:
        most = -(-most // FAN_IN)
        grouped = totals.withColumn("at", F.pmod(F.xxhash64("run"), F.lit(most))).groupBy("part", "at")
        totals = stored(grouped.applyInArrow(_merged(totals, shift, False), shape), "pairs")
    return totals.groupBy("part").applyInArrow(_merged(totals, shift, True), shape).select("part", "totals")


def _given_back(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of each run: per document, links that are their side's best, and the sum of the counts of its links."""
    out = {"run": [], "row": [], "n_best": [], "count_sum": []}
    if right.num_rows:
        keys, counts, best = spill_runs.unpacked(right.column("totals")[0].as_py())
    for run, frame in zip(left.column("run").to_pylist(), left.column("records").to_pylist()):
        pairs, docs, rows, n = spill_runs.unpacked(frame)
        at = np.repeat(np.searchsorted(keys, pairs), docs)
        n = n.astype(np.int64)
        n_best, count_sum = np.zeros((2, int(rows.max()) + 1), np.int64)
        np.add.at(n_best, rows, n * best[at])
        np.add.at(count_sum, rows, n * counts[at])
        some = np.flatnonzero(count_sum)
        out["run"].append(np.full(len(some), run))
        out["row"].append(some.astype(np.int32))
        out["n_best"].append(n_best[some])
        out["count_sum"].append(count_sum[some])
    kinds = {"run": np.int64, "row": np.int32, "n_best": np.int64, "count_sum": np.int64}
    return pa.table({c: np.concatenate([np.zeros(0, kinds[c]), *parts]) for c, parts in out.items()})


def _summed_by_document(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a run with what all parts gave back."""
    rows = left.column("row").to_numpy()
    size = int(rows.max()) + 1 if len(rows) else 0
    sums = {}
    for c in ("n_best", "count_sum"):
        sums[c] = np.zeros(size, np.int64)
        np.add.at(sums[c], right.column("row").to_numpy(), right.column(c).to_numpy())
    out = left.drop_columns(["run", "row"])
    for c in ("n_best", "count_sum"):
        out = out.append_column(c, pa.array(sums[c][rows]))
    return out


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text",
          radixes: int = RADIXES, run_links: int = RUN_LINKS) -> DataFrame:
    """Per document: tokens of A (a byte-level ``.json``) and B (a sentencepiece ``.model``), groups, links, their counts.

    A encodes a space and the text, B the text, before which it puts a space itself. Where tokens of both end, the text is
    cut into groups and the two tokens are linked. ``n_best`` counts the links whose pair is linked as often in the whole
    corpus as any pair of its id of B, ``count_sum`` adds the corpus-wide counts of the links, ``groups_sha256`` names the
    groups (``a1,a2|b1;a3|b2``).

    One pass over the texts writes, beside the documents' own figures, sorted runs of (pair, document, n) records to the
    shared checkpoint folder, dealt to parts by the id of B and compressed. Each run carries its pairs' totals; a heap
    merge over them, id of B by id of B, yields counts and maxima. Then the records of each run meet their part's counts
    in groups of ``RUNS_PER_TASK`` runs and go back as sums per document. So a pair or id that a third of all links have
    is one entry per run, and no task holds more than a part's distinct pairs and a bounded number of runs.

    Null and empty texts, and texts that an encoding does not give back (U+2581 for B), have no tokens: zeros and ``''``.
    Rows are told apart by their place, so repeated and null ids come back row by row; further columns are left out; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    importable(spark)
    aligner = token_pairs.load(a_path, b_path)
    shift = _bits(len(aligner.a.raw))
    written = _encode_and_spill(docs, a_path, b_path, id_col, text_col, radixes, run_links)
    runs = written.where("part IS NOT NULL")
    most = runs.groupBy("part").count().agg(F.max("count")).first()[0] or 1
    shares = -(-most // RUNS_PER_TASK)
    counts = _counts(runs, most, shift).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = runs.select("part", F.pmod(F.xxhash64("run"), F.lit(shares)).cast("int").alias("share"), "run", "records")
    back = dealt.groupBy("part", "share").cogroup(counts.groupBy("part", "share")).applyInArrow(
        _given_back, "run bigint, row int, n_best bigint, count_sum bigint")
    own = written.where("part IS NULL").drop("part", "totals", "records")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name not in ("run", "row"))
    out = own.groupBy("run").cogroup(back.groupBy("run")).applyInArrow(
        _summed_by_document, schema + ", n_best bigint, count_sum bigint")
    return out.withColumnRenamed("id", id_col)
