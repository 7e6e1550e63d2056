"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest

from spinelens.llm import (
    brown_lm, decontaminate, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, token_counts,
    url_filter,
)

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
TEXTS = [(1, "one two three four five six seven eight nine"), (1, "one two three four five six seven eight nine"),
         (2, None), (3, ""), (None, "null id text here"), (4, LONG), (5, " \n\t \n"), (None, None), (6, "x")]
LABELS = "doc_id long, quality int, toxic int"
RULED = [(i, q, 0) for i in range(50) for q in (1,)]


def operators(spark):
    labels = spark.createDataFrame(RULED + RULED[:3] + [(None, 1, 0), (7, None, None)], LABELS)
    bench = spark.createDataFrame([(1, "two three four five six seven"), (2, None), (3, ""), (None, "null id text here")],
                                  "item_id long, text string")
    word, byte = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
    return {
        "pack": lambda d: packing.pack(d, word), "lines": line_dedup.duplicate_lines,
        "cut": lambda d: line_dedup.without_lines(d, line_dedup.duplicate_lines(d)),
        "rules": lambda d: quality_rules.judge(d, labels), "near": near_dedup.near_duplicates,
        "place": lambda d: sharding.place(d, ["a", "b", "c"], slots=13), "count": lambda d: token_counts.token_counts(d, byte),
        "lm": brown_lm.score_texts, "leaks": lambda d: decontaminate.leaks(d, bench),
        "quality": lambda d: quality_classifier.score_documents(d, labels),
    }


NAMES = ["pack", "lines", "cut", "rules", "near", "place", "count", "lm", "leaks", "quality"]
PER_ROW = {"rules", "near", "place", "count", "lm", "quality"}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, docs, name):
    found = operators(spark)[name](docs(TEXTS)).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, name):
    assert operators(spark)[name](docs([])).collect() == []


def test_defined_results(spark, docs):
    ops, frame = operators(spark), docs(TEXTS)
    near = ops["near"](frame).collect()
    assert all(r["kept"] for r in near)
    assert [r["component_id"] for r in near if r["doc_id"] is None] == [None, None]
    assert {r["n_shingles"] for r in near if r["doc_id"] in (2, 3, 5)} == {0}
    assert [r["edits"] for r in ops["lines"](frame).collect()] == []
    assert {(r["doc_id"], r["n_tokens"]) for r in ops["count"](frame).collect() if r["doc_id"] in (2, 3)} == {(2, 0), (3, 0)}
    lm = {r["doc_id"]: r for r in ops["lm"](frame).collect()}
    assert lm[3]["n_tokens"] == 1 and lm[4]["n_tokens"] == 60_001 and lm[3]["score"] < 0
    leaks = {(r["doc_id"], r["item_id"]) for r in ops["leaks"](frame).collect()}
    assert leaks == {(1, 1), (None, None)}
    pieces = ops["pack"](frame).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 3) == 1
    assert all(r["base_failed"] for r in ops["rules"](frame).collect() if r["doc_id"] != 4)


def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "https://WWW.a.Example.com/en/x?q", None), (2, None, '<a href="http://bad.site.org/">'), (3, "no scheme", ""),
        (4, "http://good.com/", '<a href="https://friend.org/x">f</a>'), (5, "http://friend.org", ""),
        (6, "http://evil.net/es/", ""), (7, "http://fan.org/", "<a href='http://evil.net/es/'>"), (7, "http://fan.org/", None),
        (None, "http://x.www.example.com/en/", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.a.example.com", "/en/x", "example.com/en/", "block")
    assert [got[i]["host"] for i in (2, 3)] == ["", ""] and got[2]["verdict"] == "allow"
    assert got[4]["rule"] == "com/" and got[5]["verdict"] == "allow" and got[5]["rule"] is None
    assert got[6]["verdict"] == "block" and got[7]["verdict"] == "block"  # linking to a blocked host spreads distrust
    assert got[None]["verdict"] == "allow"
    assert url_filter.judge_urls(pages.limit(0)).collect() == []
