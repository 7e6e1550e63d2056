"""Cross-tokenizer alignment against plain encodings of whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row

from spinelens.llm import cross_tokenizer, spill_runs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "\n", "\r\n", "a\r\nb\r\n\r\n{\r\n  x();\r\n}\r\n", "foo ", "foo  bar   baz\t\tqux \n\n y", "x▁y and ▁",
       "<s> </s> <unk> <0x0A> <|endoftext|> <|endoftext|>", "nul \x00 byte", "fs \x1c gs \x1d", "漢字 かな 😀👩‍👩‍👧 é é",
       "nbsp here　wide em\u0085nel", "don't we'll I'M 12345 1,000.50 ... !!!", "same words same words same words",
       "word" * 500, "ab " * 700, "​zero width", "tab\tstart", "\tlead", "línea año ﬁ Ⅳ"]


def plain(texts):
    """Per text the contract's figures, from whole encodings."""
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    symbol = {c: b for b, c in zip(
        [*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    rest = [b for b in range(256) if b not in symbol.values()]
    symbol |= {chr(256 + i): b for i, b in enumerate(rest)}
    found, pairs = [], Counter()
    for text in texts:
        text = text or ""
        a = tokenizer.encode(" " + text, add_special_tokens=False)
        a_ids, a_raw = a.ids, [bytes(symbol[c] for c in t) for t in a.tokens]
        b_ids = model.encode(text)
        b_raw = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                 else model.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        want = (" " + text).encode()
        if not text or b"".join(a_raw) != want or b"".join(b_raw) != want:
            found.append(None)
            continue
        a_ends, b_ends = np.cumsum([len(r) for r in a_raw]).tolist(), np.cumsum([len(r) for r in b_raw]).tolist()
        at_a, at_b = dict(zip(a_ends, range(len(a_ids)))), dict(zip(b_ends, range(len(b_ids))))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(at_a.keys() & at_b.keys()):
            x, y = at_a[end] + 1, at_b[end] + 1
            groups.append(",".join(map(str, a_ids[i:x])) + "|" + ",".join(map(str, b_ids[j:y])))
            links.append((a_ids[x - 1], b_ids[y - 1]))
            i, j = x, y
        pairs.update(links)
        found.append((len(a_ids), len(b_ids), ";".join(groups), links))
    best = defaultdict(int)
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    for f in found:
        if f is None:
            yield (0, 0, 0, 0, "", 0, 0)
        else:
            yield (f[0], f[1], f[2].count(";") + 1, len(f[3]), hashlib.sha256(f[2].encode()).hexdigest(),
                   sum(pairs[x] == best[x[1]] for x in f[3]), sum(pairs[x] for x in f[3]))


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def check(spark, frame, rows, **more):
    got = cross_tokenizer.align(frame, A, B, **more).collect()
    want = Counter((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows])))
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == want


@pytest.mark.parametrize("run_links", [1 << 22, 300])
def test_given_documents(spark, real, run_links):
    frame = real["documents"]
    check(spark, frame, [(r["doc_id"], r["text"]) for r in frame.collect()], run_links=run_links)


def test_odd_texts_and_many_runs(spark, docs, monkeypatch):
    monkeypatch.setattr(cross_tokenizer, "FAN_IN", 2)
    monkeypatch.setattr(cross_tokenizer, "RUNS_PER_TASK", 2)
    rows = [*enumerate(ODD), (3, "same words"), (3, "same words"), (None, "null id"), (None, None)]
    check(spark, docs(rows), rows, run_links=40, radixes=3)


def test_no_rows_and_no_tokens(spark, docs):
    assert cross_tokenizer.align(docs([]), A, B).collect() == []
    got = cross_tokenizer.align(docs([(1, None), (2, "▁")]), A, B).collect()
    assert sorted((r["doc_id"], r["n_links"], r["groups_sha256"], r["n_best"]) for r in got) == [(1, 0, "", 0), (2, 0, "", 0)]


def test_repeated_text_is_one_entry_of_a_run(spark):
    rows = [(i, "the same words again and again") for i in range(5000)]
    frame = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows], "doc_id long, text string").repartition(7)
    got = cross_tokenizer.align(frame, A, B).collect()
    (want,) = set(plain([rows[0][1]]))
    assert {tuple(r[c] for c in COLUMNS[:-1]) for r in got} == {want[:-1]}
    assert {r["count_sum"] for r in got} == {5000 * want[-1]}


def test_heap_merge():
    rng = np.random.default_rng(1)
    runs, total = [], Counter()
    for size in (0, 1, 70_000, 40_000, 5):
        keys = np.unique(rng.integers(0, 90_000, size))
        counts = rng.integers(1, 9, len(keys))
        runs.append(tuple(spill_runs.unpacked(spill_runs.packed(keys, counts))))
        total.update(dict(zip(keys.tolist(), counts.tolist())))
    got = list(spill_runs.with_best(spill_runs.merged(runs), 3))
    keys, counts, best = (np.concatenate(c) for c in zip(*got))
    assert dict(zip(keys.tolist(), counts.tolist())) == total and (np.diff(keys) > 0).all()
    top = defaultdict(int)
    for k, n in total.items():
        top[k >> 3] = max(top[k >> 3], n)
    assert best.tolist() == [total[k] == top[k >> 3] for k in keys.tolist()]
