"""Token counts: Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spinelens.llm import _encode
from spinelens.llm._store import importable

_memos: dict[tuple[str, int], _encode.Memo] = {}


def _memo(path: str, batch_bytes: int) -> _encode.Memo:
    key = (path, batch_bytes)
    if key not in _memos:
        tokenizer = _encode.load(path)
        _memos[key] = _encode.Memo(
            lambda pieces: map(len, tokenizer.encode_batch_fast(pieces, add_special_tokens=False)),
            batch_bytes)
    return _memos[key]


def lengths(texts: list[str], path: str, batch_bytes: int, specials: list[str]) -> list[int]:
    """Token counts of whole texts.

    A text is split before each run of white space. Texts that hold a special string, or control
    characters on whose class the libraries differ, are encoded as they are.
    """
    memo = _memo(path, batch_bytes)
    totals, waiting, unseen, size = [0] * len(texts), [], {}, 0

    def flush() -> None:
        learned = memo.learn(list(unseen))
        for row, pieces in waiting:
            totals[row] += sum(map(learned.__getitem__, pieces))
        waiting.clear()
        unseen.clear()

    for row, text in enumerate(texts):
        if any(s in text for s in specials) or _encode.ODD_SPACE.search(text):
            pieces = [text]
        else:
            pieces = _encode.BEFORE_SPACE.findall(text)
        found = list(map(memo.known.get, pieces))
        if None in found:
            missing = [p for p, n in zip(pieces, found) if n is None]
            waiting.append((row, missing))
            unseen.update(dict.fromkeys(missing))
            totals[row] = sum(n for n in found if n is not None)
        else:
            totals[row] = sum(found)
        size += len(text)
        if size >= 4 * batch_bytes:
            flush()
            size = 0
    flush()
    return totals


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 batch_bytes: int = 1 << 20) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` of every whole text.

    Only the counts leave Python. Texts are taken in groups of about four ``batch_bytes``; what is new
    in a group is encoded in batches balanced by bytes. Row-local: no shuffle, a lost task is run again.
    Null and empty texts count as 0 bytes and 0 tokens; null ids and repeated rows come back as they
    are; further columns are left out, so their names cannot clash; an empty table gives no rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = _encode.special_strings(tokenizer_path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(lengths(texts, tokenizer_path, batch_bytes, specials), pa.int64())],
                names=["__id", "n_bytes", "n_tokens"])

    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS __id", f"CAST(`{text_col}` AS STRING) AS __text").mapInArrow(
        count, f"__id {kind}, n_bytes bigint, n_tokens bigint")
    return rows.withColumnRenamed("__id", id_col)
