"""What a Python worker holds and hands on at a time is bounded, whatever the size of a batch."""

import random
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa

from spinelens.llm import _encode, decontaminate, packing


def test_packing_hands_on_small_batches(monkeypatch):
    path, found, rng = public_tokenizers.path("word_bpe_49k.json"), [], random.Random(4)
    monkeypatch.setattr(packing, "importable", lambda spark: None)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    docs = SimpleNamespace(sparkSession=None)
    docs.selectExpr = lambda *columns: docs
    docs.mapInArrow = lambda run, names: found.append(run)
    packing.pack(docs, path)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(400))) for _ in range(2500)]
    out = list(found[0]([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})]))
    ids = [sum(map(len, b["ids"].to_pylist())) for b in out]
    assert max(ids) <= (2 << 20) + 4 * 2048 and sum(ids) > 2 * max(ids)
    by_doc = {}
    for row in sorted((r for b in out for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["start"])):
        by_doc[row["doc_id"]] = by_doc.get(row["doc_id"], b"") + row["ids"]
    assert [by_doc[i] for i in range(len(texts))] == packing.encode(texts, path, 1)
    memo = packing._memo(path, 1 << 20)
    assert 0 < len(memo.known) <= memo.entries < _encode.CACHE_ENTRIES


def test_few_texts_of_a_batch_are_strings_at_a_time(monkeypatch):
    """A chunk's texts are read when its turn comes, and all chunks together are the batch."""
    monkeypatch.setattr(decontaminate, "CHUNK_CHARS", 100)
    read = []

    class Rows:
        def __init__(self, batch):
            self.batch, self.num_rows = batch, batch.num_rows

        def __getitem__(self, name):
            read.append(self.num_rows)
            return self.batch[name]

        def slice(self, at, n=None):
            return Rows(self.batch.slice(at, n))

    texts = ["é" * 60, None, "b" * 30, "c" * 30, "d" * 300, "", "e" * 5]
    chunks = list(decontaminate._chunks(Rows(pa.RecordBatch.from_pydict({"text": texts}))))
    assert [c for _, part in chunks for c in part] == [t or "" for t in texts]
    assert [r.num_rows for r, _ in chunks] == [3, 1, 1, 2] and sorted(read) == [1, 1, 2, 3, 7]
