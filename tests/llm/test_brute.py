"""Operators against plain versions, on given tables and planted cases."""

import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import re

import corpus_pipeline
from spinelens.llm import (
    _encode, brown_lm, components, decontaminate, line_dedup, near_dedup, packing, quality_classifier, quality_rules,
    queries, sharding, url_filter,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(real):
    return {r["doc_id"]: r["text"] for r in real["documents"].collect()}


def test_packing_is_a_partition_of_all_ids(spark, sf_dir, real):
    tokenizer = _encode.load(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in queries.op1_packing(spark, sf_dir).collect():
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc, text in texts_of(real).items():
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at: at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        total = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == total
            total += p["length"]
        assert total & (total - 1) == 0 and total <= 2048


def test_rank_table_covers_the_vocabulary():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    tokens = {"".join(m if isinstance(m, list) else m.split(" ")) for m in merges}
    assert _encode.RankedWords.reachable(path, sorted(tokens)) == tokens
    words = ["it's", "'s'S", "a<|endoftext|>b", "Ñandú²x¼_a-b'll", "Σας", "a\x01", "\x00", "ªº", "İ", "naïve-co-op", "́x"]
    exact = [np.array(e.ids, "<u4").tobytes() for e in _encode.load(path).encode_batch(words, add_special_tokens=False)]
    assert _encode.RankedWords(path)([w.encode() for w in words]) == exact


def test_token_counts(spark, sf_dir, real):
    tokenizer = _encode.load(public_tokenizers.path("byte_bpe_50k.json"))
    texts = texts_of(real)
    for r in queries.op6_token_counts(spark, sf_dir).collect():
        n = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


@pytest.mark.parametrize("text", ["a  b\n\n c  d", "x<|endoftext|> y", "\x1c a\x1d!", "  lead", "trail  ", "don't  DON'T", "a b 12 34"])
def test_token_counts_of_odd_texts(spark, docs, text):
    from spinelens.llm import token_counts
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_counts.lengths([text], path, 1 << 20, _encode.special_strings(path))
    assert got == [len(_encode.load(path).encode(text, add_special_tokens=False))]


def test_step_groups_are_balanced():
    pieces = [[packing.Piece(i, 0, b"\0" * 4 * n, n), packing.Piece(i, n, b"\0" * 4 * (256 - n), 256)] for i, n in enumerate(range(1, 129))]
    groups = packing.step_groups(pieces, step_tokens=32 * 256)
    cost = Counter()
    for window, group in zip(pieces, groups):
        cost[group] += sum(p.length ** 2 for p in window)
    assert len(cost) == 4 and max(cost.values()) < 1.01 * min(cost.values())


def test_quality_counts(spark, sf_dir, real):
    texts = texts_of(real)
    for r in queries.op3_quality_rules(spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        grams, covered, seen, dup = Counter(zip(words, words[1:], words[2:])), set(), set(), 0
        for i in range(len(words) - 2):
            if grams[tuple(words[i: i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_cutoffs_hold_their_risk(spark, docs):
    clean = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"w{i}###" for i in range(60))
    texts = [(i, clean if i < 1000 else junk) for i in range(1100)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in range(1100)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs(texts), labels).collect()}
    assert all(kept[i] == (i < 1000) for i in kept)
    few = labels.where("doc_id % 10 = 0")  # too few to guarantee anything
    assert all(r["kept"] for r in quality_rules.judge(docs(texts), few).collect())
    n, p, level = 1000, quality_rules.RISK / 5, quality_rules.DELTA / 5
    tail = [sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)) for k in range(11)]
    most = max(k for k in range(11) if tail[k] <= level)
    for extra in (most, most + 1):  # so many good documents are like the junk
        mixed = [(i, junk if i < extra else t) for i, t in texts]
        found = quality_rules.judge(docs(mixed), labels).where("doc_id >= 1000 AND NOT kept").count()
        assert found == (100 if extra <= most else 0)


def test_lines(spark, docs):
    base = "the quick brown fox jumps over a lazy dog today"
    rows = [(1, f"{base}\nshort line"), (2, base.upper()), (3, base.replace("fox", "cat") + "\nshort line\nsome other line of words"),
            (4, base + " again"), (5, base.replace("quick ", "").replace("lazy", "old")), (6, "a b c d e\na b c d e\na b c d f")]
    got = {(r["doc_id"], r["line_no"]): (r["keeper_id"], r["keeper_line_no"], r["edits"]) for r in line_dedup.duplicate_lines(docs(rows)).collect()}
    assert got == {(2, 0): (1, 0, 0), (3, 0): (1, 0, 1), (4, 0): (1, 0, 1), (6, 1): (6, 0, 0)}
    frame = docs(rows)
    left = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(frame, line_dedup.duplicate_lines(frame)).collect()}
    assert left[3] == "short line\nsome other line of words" and 2 not in left and 4 not in left and left[6] == "a b c d e\na b c d f"


def lines_by_hand(rows, min_words, edit_words):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or len(a) < edit_words:
            return False
        p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[p + (len(a) == len(b)):] == b[p + 1:]

    lines = sorted((d, i, line.lower().split()) for d, t in rows for i, line in enumerate(t.split("\n")))
    lines, found = [x for x in lines if len(x[2]) >= min_words], {}
    for j, (d, i, ws) in enumerate(lines):
        for e, k, other in lines[:j]:
            if ws == other or near(ws, other):
                found[d, i] = (e, k, int(ws != other))
                break
    return found


def test_short_lines(spark, docs, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(d, "\n".join(" ".join(rng.choice(list("abcdefghi"), rng.integers(0, 7))) for _ in range(8))) for d in range(40)]
    rows += [(50, "All rights reserved.\nx\nLicensed under the Apache License, Version 2.0."),
             (51, "all rights reserved.\nX\nLicensed under the Apache License, Version 1.1.")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line_no"]): (r["keeper_id"], r["keeper_line_no"], r["edits"])
           for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == lines_by_hand(rows, 1, 2)
    assert got[51, 0] == (50, 0, 0) and got[51, 1] == (50, 1, 0) and got[51, 2] == (50, 2, 1)
    kept = {(r["doc_id"], r["line_no"]): (r["keeper_id"], r["keeper_line_no"], r["edits"])
            for r in line_dedup.duplicate_lines(docs(rows)).collect()}
    assert kept == lines_by_hand(rows, 5, 8)


def test_lines_of_rows_without_an_id_of_their_own(spark, docs):
    line = "the quick brown fox jumps over a lazy dog today"
    rows = [(None, f"{line}\nfirst text"), (None, f"{line}\nsecond text"), (7, f"{line}\nthird"), (7, f"{line}\nfourth"),
            (-2**63, line), (2**63 - 1, line.replace("fox", "cat"))]
    got = line_dedup.duplicate_lines(docs(rows)).collect()
    keepers = {r["row_key"] for r in got}
    # of the two rows without an id one keeps the line; every other row loses it
    assert len(got) == len(keepers) == 5 and [r["doc_id"] for r in got].count(None) == 1
    assert {(r["doc_id"], r["keeper_id"], r["line_no"], r["keeper_line_no"]) for r in got} == {
        (None, None, 0, 0), (7, None, 0, 0), (-2**63, None, 0, 0), (2**63 - 1, None, 0, 0)}
    again = line_dedup.duplicate_lines(docs([r for r in rows if r[0] == 7])).collect()
    assert [(r["doc_id"], r["keeper_id"], r["edits"]) for r in again] == [(7, 7, 0)]


def components_by_hand(texts, k, percent):
    sets = {}
    for d, t in texts.items():
        w = tuple(WORD.findall(t.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}))))
        sets[d] = {w[i: i + k] for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates(spark, sf_dir, real):
    expected = components_by_hand(texts_of(real), 2, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_near_dedup(spark, sf_dir).collect()}
    assert got == expected


def test_near_duplicates_in_dense_groups(spark, docs):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(120):
        words = list(base)
        for i in rng.choice(120, int(rng.integers(0, 16)), replace=False):
            words[i] = f"x{d}_{i}"
        texts[d] = " ".join(words)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(list(texts.items())), k=2).collect()}
    assert got == components_by_hand(texts, 2, 80)


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (100, 100), (90, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_shard_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    less = sharding.fill_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, less)) < 2.2 * table.count(6)
    assert [names[::-1][i] for i in sharding.fill_table(names[::-1], 1009)] == [names[i] for i in table]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad)


def test_shards_of_rows(spark, sf_dir, real):
    table, names = sharding.fill_table([f"shard-{i:02}" for i in range(64)]), [f"shard-{i:02}" for i in range(64)]
    for r in queries.op5_sharding(spark, sf_dir).collect():
        slot = sharding._number(str(r["doc_id"]), sharding.SLOTS)
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])


def test_language_model(spark, sf_dir, real):
    texts = texts_of(real)
    tokens = {d: [*brown_lm.words(t), b"\n"] for d, t in texts.items()}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    total = np.zeros(2)
    # few held words, so that counts are joined too
    for r in brown_lm.score_texts(real["documents"], exchange_words=300, held_words=900).collect():
        ws = tokens[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        if r["held_out"]:
            total += (r["score"], r["base_score"])
    assert total[0] > total[1]


def test_exchange_raises_information(spark, real):
    pairs = brown_lm._pairs(real["documents"].select("text"), [w for w, _ in Counter(
        w for t in texts_of(real).values() for w in brown_lm.words(t)).most_common(400)])
    history = brown_lm.cluster(pairs.checkpoint(), 400)[1]
    assert max(history) > 1.5 * history[0]


def test_every_training_word_is_exchanged(spark, docs):
    # the rare words of each kind share no ending; what tells the kinds apart are their neighbours alone
    rare = {kind: [f"{kind}{i}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] for kind in "xy"}
    frames = {"x": "the big {} runs away", "y": "we often {} some bread"}
    texts = [(7 * i + j, frames[kind].format(w)) for i in range(60) for j, kind in enumerate("xy") for w in rare[kind][2 * i: 2 * i + 2]]
    lines = [[*brown_lm.words(t), b"\n"] for _, t in texts]
    counts = Counter(w for line in lines for w in line)
    held = [w for w, _ in counts.most_common() if w != b"\n"][:20]
    names = {**{w: i for i, w in enumerate(held)}, b"\n": len(held)}
    number = {w: names.get(w, brown_lm.rest_id(w)) for w in counts}
    pairs = brown_lm._word_pairs(docs(texts).select("text"), held).checkpoint()
    want = Counter((number[l], number[r]) for line in lines for l, r in zip([b"\n", *line], line))
    assert {(r["l"], r["r"]): r["n"] for r in pairs.collect()} == want
    words = {r["word"]: r["h"] for r in spark.createDataFrame([(w,) for w in counts if w not in names], "word binary").selectExpr(
        "word", f"{brown_lm._REST_ID} AS h").collect()}
    assert all(number[bytes(w)] == h for w, h in words.items())
    first = spark.createDataFrame([(number[w], n, brown_lm.ending(w), 80 if w == b"\n" else number[w] if w in names else 64 + brown_lm.ending(w))
                                   for w, n in counts.items()], "word long, n long, ending int, class int").checkpoint()
    got, bigrams, history = brown_lm.exchange_words_all(pairs, first, 8, len(held))
    classes = {r["word"]: r["class"] for r in got.collect()}
    assert set(classes) == set(number.values()) and all(c < 64 for w, c in classes.items() if w != len(held))
    tail = [{classes[number[w.encode()]] for w in rare[kind] if w.encode() not in names} for kind in "xy"]
    assert not tail[0] & tail[1] and len(tail[0] | tail[1]) < 32
    assert bigrams.sum() == sum(counts.values()) and bigrams.min() >= 0


def test_rows_of_words_hold_their_neighbours(spark, docs):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % 300)) for i in range(60)] + [(90, None), (91, "")]
    lines = [[*brown_lm.words(t or ""), b"\n"] for _, t in texts]
    held = [w for w, _ in Counter(w for line in lines for w in line).most_common() if w != b"\n"][:40]
    hot, end = 10, len(held)
    names = {**{w: i for i, w in enumerate(held)}, b"\n": end}
    number = lambda w: names.get(w, brown_lm.rest_id(w))
    unit = lambda w: hot + 16 if w == b"\n" else names[w] if names.get(w, hot) < hot else hot + brown_lm.ending(w)
    want, want_units = Counter(), Counter()
    for line in lines:
        for l, r in zip([b"\n", *line], line):
            want_units[unit(l), unit(r)] += 1
            for u, nbr, side in ((number(l), number(r), 1), (number(r), number(l), -1)):
                if (u < 0 or hot <= u < end) and (u < 0 or nbr >= 0):
                    want[u, nbr, side] += side
    rows, units = brown_lm._table(brown_lm._neighbours(docs(texts).repartition(5).select("text"), held, hot))
    got = rows.collect()
    assert {(r["word"], b, 1 if n > 0 else -1): n for r in got for b, n in zip(r["nbrs"], r["counts"])} == want
    assert sorted(r["word"] for r in got) == sorted({number(w) for line in lines for w in line if not (0 <= number(w) < hot or w == b"\n")})
    assert {(r["word"], b): n for r in units.collect() for b, n in zip(r["nbrs"], r["counts"])} == want_units


def test_numbers_of_words_equal_those_of_sql(spark):
    found = [b"x", "\u00e9t\u00e9".encode(), b"a" * 99]
    rows = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(found)], "i int, word binary").selectExpr("i", f"{brown_lm._REST_ID} AS id")
    assert [r["id"] for r in rows.orderBy("i").collect()] == brown_lm.rest_ids(found).tolist() == [brown_lm.rest_id(w) for w in found]
    assert len(brown_lm.rest_ids([])) == 0


def test_texts_scored_together_score_like_copies_elsewhere(spark, docs):
    """Texts are scored hundreds at a time: copies in other places, beside empty texts and others' words, score the same."""
    rng = np.random.default_rng(4)
    some = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 30)))) for _ in range(90)] + ["", None, "zz"]
    order = rng.permutation(7 * len(some))
    rows = docs([(int(i), some[int(i) % len(some)]) for i in order]).coalesce(1)
    scored = brown_lm.score_texts(rows, held_out="doc_id >= 93", held_words=20, exchange_words=10).collect()
    assert len(scored) == len(order)
    by = {}
    for r in scored:
        by.setdefault(r["doc_id"] % len(some), []).append(r)
    for i, found in by.items():
        assert len(found) == 7 and {r["n_tokens"] for r in found} == {len((some[i] or "").split()) + 1}
        assert np.ptp([r["score"] for r in found]) < 1e-9 and np.ptp([r["base_score"] for r in found]) < 1e-9
        assert {r["n_known"] for r in found} == {len((some[i] or "").split()) + 1}


def test_links_and_ranks(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("b", "d", 2.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("d", 0.0, 3.0)], "host string, good double, bad double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.host_scores(edges, seeds, iterations=60).collect()}
    hosts = "abcd"
    f = np.zeros((4, 4))
    for s, t, w in (("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("b", "d", 2)):
        f[hosts.index(s), hosts.index(t)] = w
    for column, (m, seed) in enumerate(((f, [1, 0, 0, 0]), (f.T, [0, 0, 0, 1]))):
        out, seed = m.sum(1, keepdims=True), np.array(seed, float)
        step = np.where(out > 0, m / np.where(out > 0, out, 1), seed)
        x = seed
        for _ in range(60):
            x = 0.15 * seed + 0.85 * x @ step
        assert [got[h][column] for h in hosts] == pytest.approx(list(x), abs=1e-9)


def test_leaks(spark, sf_dir, real):
    texts = texts_of(real)
    items = {r["item_id"]: r["text"] for r in real["benchmark"].collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_decontaminate(spark, sf_dir).collect()}
    assert {(d, i) for d, t in texts.items() for i, b in items.items() if b in t} <= got


def test_changed_questions(spark, docs):
    item = "A train leaves with Anna at 9 and travels 120 km in 3 hours before Anna meets Bob at the old station."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("Anna", "Carla").replace("120", "250").replace("Bob", "Dave")
    wrong = item.replace("with Anna", "with Carla")  # one name, two values
    rows = [(1, "Said before. " + item), (2, other), (3, "so " + wrong), (4, "A train leaves with him at once and never comes back to us here.")]
    got = {r["doc_id"]: r["exact"] for r in decontaminate.leaks(docs(rows), bench).collect()}
    assert got[1] is True and got[2] is False and 4 not in got


def test_verbatim_items_of_any_kind(spark, docs):
    items = [(1, "3 km 40 m 7 kg 12 s 9 Anna 5 lb"),  # hardly a literal word
             (2, "Great Barrier Reef Marine Park Authority"),  # one template token
             (3, "Anna has four red apples and eats one today")]  # one name: its kind depends on what stands before
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(10 * i, f"Heading\n{t} and more") for i, t in items] + [(99, "Great Barrier Island is 3 km long and Anna has four")]
    got = {(r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.leaks(docs(rows), bench).collect()}
    assert got == {(10, 1, True), (20, 2, True), (30, 3, True)}


def test_parts_edits_and_arithmetic(spark, docs):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 7))
    long, short = [word() for _ in range(400)], [word() for _ in range(39)]
    german = "Der Zug nach Berlin braucht 3 Stunden für 240 Kilometer und hält an 4 Orten ohne Pause"
    items = [(1, " ".join(long)), (2, " ".join(short)), (3, "12 + 30 * 7 - 45 = 177 ?"), (4, german)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    inserted = [*long[:80], word(), *long[80:160], word(), *long[160:240], word(), *long[240:320], word(), *long[320:]]
    replaced = [word() if i in (9, 19, 29) else w for i, w in enumerate(short)]
    rows = [(10, f"{word()} " + " ".join(long[150:250])), (11, " ".join(inserted)), (20, "So: " + " ".join(replaced)),
            (30, "What is 5 + 9 * 2 - 1 = 22 ?"), (40, german.replace("3", "5").replace("240", "410").replace("4 Orten", "6 Orten")),
            (90, " ".join(long[20:30]) + f" {word()} " + " ".join(short[5:15])),  # ten words of each
            (91, "5 + 9 - 2 * 1 = 12 and 3 - 4 - 5 = 2 * 7 + 1"), (92, "a list * of - marks * 9 8 7 6 5 4 3 2 1")]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.leaks(docs(rows), bench).collect()}
    assert got == {(10, 1): False, (11, 1): False, (20, 2): False, (30, 3): False, (40, 4): False}


def test_windows_do_not_depend_on_the_texts_beside(spark):
    rng = np.random.default_rng(3)
    texts = ["", " * ", *(" ".join(rng.choice(["Anna", "Bob", "red", "12", "km", "*", "-", "end.", "it"], rng.integers(1, 40))) for _ in range(60))]
    together = decontaminate.Words(texts)
    for plain in (False, True):
        for width in (4, 8):
            at, hashes = together.windows(plain, width)
            text = (together.plain_text if plain else together.text)[at]
            for i, t in enumerate(texts):
                assert list(hashes[text == i]) == list(decontaminate.Words([t]).windows(plain, width)[1])


def test_quality_scores(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in queries.op10_quality_classifier(spark, path).collect()}
    right = total = 0
    for r in spark.read.parquet(f"{path}/labels.parquet").collect():
        row = rows[r["doc_id"]]
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= row["score"] <= 1
        if row["held_out"]:
            total += 1
            right += row["predicted"] == r["quality"]
    assert right >= 0.9 * total


def test_isotonic():
    at, rates = quality_classifier.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 2.0, 1.0, 4.0]), np.array([2.0, 4.0, 4.0, 4.0]))
    assert list(rates) == [0.0, 3 / 8, 1.0] and list(at) == pytest.approx([0.1, 0.25, 0.4])


def test_pipeline(spark, sf_dir, real, tmp_path):
    frame, texts = real["documents"], texts_of(real)
    steps = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, sf_dir).write.parquet(str(tmp_path / str(i)))
        frame = spark.read.parquet(str(tmp_path / str(i)))
        steps.append(frame)
    for step in steps[:-1]:
        assert step.columns == real["documents"].columns
    kept = {r["doc_id"] for r in queries.op3_quality_rules(spark, sf_dir).where("kept").collect()}
    assert {r["doc_id"] for r in steps[0].select("doc_id").collect()} == kept
    after = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    assert all(set(after[d].split("\n")) <= set(texts[d].split("\n")) for d in after)
    groups = components_by_hand(after, 5, 80)
    assert {r["doc_id"] for r in steps[2].collect()} == {d for d, (_, root) in groups.items() if d == root}
    items = [r["text"] for r in real["benchmark"].collect()]
    last = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    assert not any(b in t for t in last.values() for b in items)
    assert {r["doc_id"] for r in steps[4].select("doc_id").distinct().collect()} == set(last)
    assert steps[4].count() == corpus_pipeline.run(spark, sf_dir).count()
