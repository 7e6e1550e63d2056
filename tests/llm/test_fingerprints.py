"""Fingerprints against hashes of every window in plain Python."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest

from spinelens.llm import fingerprints as fp

MASK = (1 << 64) - 1


def plain_sketch(text):
    if not text:
        return set()
    codes = [ord(c) + 1 for c in text] + [1] * (fp.SHINGLE - len(text))
    out = set()
    for i in range(len(codes) - fp.SHINGLE + 1):
        h = 0
        for c in codes[i : i + fp.SHINGLE]:
            h = (h * int(fp._MULTIPLIER) + c) & MASK
        h = ((h ^ h >> 30) * int(fp._MIX[0])) & MASK
        h = ((h ^ h >> 27) * int(fp._MIX[1])) & MASK
        h ^= h >> 31
        if h < 1 << 60:
            out.add(h >> 20)
    return out


def text_of(sketch):
    return base64.b64encode(b"".join(h.to_bytes(5, "big") for h in sorted(sketch))).decode()


def plain(rows, hashes):
    """Contract rows of (id, text) rows; ``hashes`` order texts of one id."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        m = len(text) // 3
        changed = text[: len(text) - m] + after[:m]
        own, new, other = map(plain_sketch, (text, changed, after))

        def near(x, equal):
            return 1.0 if equal else len(own & x) / len(own) if own else 0.0

        yield (i, len(text), hashlib.sha256(changed.encode()).hexdigest(), text_of(own), text_of(new),
               round(near(new, text == changed), 9), round(near(other, text == after), 9))


def got(frame):
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
                    round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fp.fingerprints(frame).collect())


def hashes(frame):
    return {r[0]: r[1] for r in frame.selectExpr("coalesce(text, '')", "xxhash64(coalesce(text, ''))").distinct().collect()}


@pytest.mark.parametrize("size", [1, 20_000, 16 << 20])
def test_given_documents(spark, real, monkeypatch, size):
    monkeypatch.setattr(fp, "PARTITION_BYTES", size)
    frame = real["documents"].repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert got(frame) == Counter(plain(rows, hashes(frame)))


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_awkward_rows(spark, docs, monkeypatch, size):
    monkeypatch.setattr(fp, "PARTITION_BYTES", size)
    rows = [(5, "short"), (5, "short"), (4, None), (4, "another text of the same id as the one above"), (3, ""), (None, "no id at all"),
            (None, None), (7, "x" * 15), (6, "y" * 16), (2, "漢字 😀 " * 30), (-3, "a\x00b" * 20), (9, "equal text, equal id " * 3)] + [
            (1, "many rows of one id and text, " * 2)] * 9
    frame = docs(rows).repartition(3)
    assert got(frame) == Counter(plain(rows, hashes(frame)))


def test_no_row_and_one_row(spark, docs):
    assert fp.fingerprints(docs([])).collect() == []
    (row,) = fp.fingerprints(docs([(1, "abcdefgh" * 9)])).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == 72


def test_slices_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(900))
    whole = fp.sketches([text, "a" * 20, text[:100]])
    monkeypatch.setattr(fp, "SLICE", 64)
    for one, other in zip(whole, fp.sketches([text, "a" * 20, text[:100]])):
        assert one.tolist() == other.tolist()
    assert whole[0].tolist() == sorted(plain_sketch(text))


def test_merging_and_containment_of_unequal_texts():
    rng = np.random.default_rng(3)
    small, large = ("".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (4_000, 200_000))
    one, both = fp.sketches([small, large + small])
    assert fp.containment(one, both) == 1.0
    assert 0.01 < fp.containment(both, one) < 0.03  # 4,000 of 204,000
    joined = fp.read(fp.merged(fp.written(one), fp.written(fp.sketches([large])[0])))
    assert set(joined.tolist()) <= set(both.tolist()) and len(both) - len(joined) <= 16  # but for windows across the seam
    assert fp.read(fp.written(one)).tolist() == one.tolist()
    half = fp.sketches([large[:100_000] + large[150_000:]])[0]
    assert abs(fp.containment(fp.sketches([large])[0], half) - 0.75) < 0.03
