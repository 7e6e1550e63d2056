"""The language model's words are kept and moved in blocks, and texts are cut into words by Arrow: both hold what single words did."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spinelens.llm import brown_lm


def _model(texts, n_held):
    lines = [[*brown_lm.words(t or ""), b"\n"] for _, t in texts]
    counts = Counter(w for line in lines for w in line)
    held = [w for w, _ in counts.most_common() if w != b"\n"][:n_held]
    names = {**{w: i for i, w in enumerate(held)}, b"\n": len(held)}
    return lines, counts, held, lambda w: names.get(w, brown_lm.rest_id(w))


@pytest.fixture
def texts():
    rng = np.random.default_rng(8)
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.2, 60) % 900)) for i in range(80)] + [(98, None), (99, "")]


def test_neighbours_move_as_blocks_not_as_words(spark, docs, texts):
    lines, counts, held, number = _model(texts, 40)
    few = brown_lm._neighbours(docs(texts).coalesce(1).select("text"), held, 10, buckets=2)
    n_units = 10 + brown_lm.ENDINGS + 1
    assert len(counts) > 300
    assert few.count() <= 2 * brown_lm.BLOCKS + n_units  # a row per word before
    table, _ = brown_lm._block_table(few, 2)
    assert table.count() == len({number(w) % (2 * brown_lm.BLOCKS) for w in counts if not 0 <= number(w) < 10 and w != b"\n"})


@pytest.mark.parametrize("buckets", [1, 3])
def test_contexts_of_all_words(spark, docs, texts, buckets):
    n_hot, (lines, counts, held, number) = 10, _model(texts, 40)
    end = len(held)
    rng = np.random.default_rng(2)
    cls = {number(w): 80 if w == b"\n" else int(rng.integers(0, 64)) for w in sorted(counts)}
    want, want_hot = Counter(), Counter()
    hot = lambda w: 0 <= w < n_hot or w == end
    for line in lines:
        for l, r in zip(map(number, [b"\n", *line]), map(number, line)):
            for w, nbr, side in ((l, r, brown_lm.AFTER), (r, l, 0)):
                if not hot(w):
                    want[w, cls[nbr] + side] += 1
                elif not hot(nbr):
                    want_hot[w, cls[nbr] + side] += 1
    parts = brown_lm._neighbours(docs(texts).repartition(4).select("text"), held, n_hot, buckets)
    table, _ = brown_lm._block_table(parts, buckets)
    rest = spark.createDataFrame([(number(w), n, brown_lm.ending(w), cls[number(w)]) for w, n in counts.items() if number(w) < 0],
                                 "word long, n long, ending int, class int")
    state = brown_lm._state(rest, buckets)
    assert sorted(brown_lm._state_rows(state).collect()) == sorted(rest.collect())
    arrays = (np.array([counts[w] for w in held] + [counts[b"\n"]]), np.array([brown_lm.ending(w) for w in held] + [0]),
              np.array([cls[i] for i in range(end + 1)]))
    contexts = brown_lm._word_contexts(table, state, arrays, n_hot, end, buckets)
    got = Counter()
    for r in contexts.where("block >= 0").mapInArrow(brown_lm._context_rows, "word long, slots long, v long").collect():
        assert (r["word"], r["slots"]) not in got
        got[r["word"], r["slots"]] = r["v"]
    got_hot = Counter()
    for r in contexts.where("block < 0").mapInArrow(brown_lm._context_rows, "word long, slots long, v long").collect():
        got_hot[r["word"], r["slots"]] += r["v"]
    assert got == want and got_hot == want_hot
    names = {}
    for batch in contexts.where("block >= 0").select("block", "words", "n", "ending", "class").toArrow().to_batches():
        for i in range(batch.num_rows):
            names |= {w: x for w, *x in zip(*(a.tolist() for a in brown_lm._state_of(batch, i)))}
    assert names == {number(w): [n, brown_lm.ending(w), cls[number(w)]] for w, n in counts.items() if not hot(number(w))}


def test_counts_need_not_fit_few_bytes():
    for top in (0, 1, 127, 128, 1 << 15, 1 << 31, 1 << 40):
        n = np.array([1, -top, top, 0])
        batch = pa.RecordBatch.from_arrays([brown_lm._cells([brown_lm._least(n)])], names=["c"])
        assert brown_lm._counts(batch, 0, "c", 4).tolist() == n.tolist()


def test_texts_cut_by_arrow_are_the_words():
    rng = random.Random(1)
    letters = [chr(i) for i in range(0x22)] + ["A", "b", "Z", "É", "é", "\x85", " ", "　", " ", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(3000)] + [None, "", "   ", "a"]
    for column in (pa.array(texts), pa.array(["gone", *texts, "gone"]).slice(1, len(texts)), pa.array([None], pa.string()), pa.array([], pa.string())):
        flat, lengths = brown_lm._split(column)
        ends = np.cumsum(lengths).tolist()
        found = flat.to_pylist()
        assert [found[b - k: b] for b, k in zip(ends, lengths.tolist())] == [brown_lm.words(t or "") for t in column.to_pylist()]
        assert brown_lm.endings_of(flat).tolist() == [brown_lm.ending(w) for w in found]
        assert brown_lm.endings_of(flat.slice(3)).tolist() == [brown_lm.ending(w) for w in found[3:]]


def test_pieces_are_whole_columns(monkeypatch):
    monkeypatch.setattr(brown_lm, "PIECE", 10)
    for texts in ([], [None, None], ["a" * 50], ["", "abc", None, "a" * 25, "b", "c" * 9, "d" * 10, ""]):
        pieces = [x.to_pylist() for x in brown_lm._pieces(pa.array(texts, pa.string()))]
        assert [t for x in pieces for t in x] == texts and all(pieces)


def test_blocks_do_not_depend_on_partitions(spark, docs, texts, monkeypatch):
    """What rounds hand on is a row per bucket and block at most: many partitions must not make many rows."""
    lines, counts, held, number = _model(texts, 40)
    rest = spark.createDataFrame([(number(w), n, brown_lm.ending(w), 64) for w, n in counts.items() if number(w) < 0],
                                 "word long, n long, ending int, class int")
    handed = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (2, 40):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            buckets = brown_lm._buckets(sum(counts.values()))
            table, _ = brown_lm._block_table(brown_lm._neighbours(docs(texts).select("text"), held, 10, buckets), buckets)
            far = brown_lm._far(table, brown_lm._state(rest, buckets), 10, len(held), buckets)
            handed.append(far.selectExpr("sum(size(handed)) AS n").first()["n"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert handed[0] == handed[1] <= brown_lm.BLOCKS
