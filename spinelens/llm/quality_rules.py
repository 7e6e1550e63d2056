"""Quality rules whose cutoffs are chosen under a guaranteed rate of false rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.llm._store import settle

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rules: a count per thousand of another count; larger is worse.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "exclaims": ("n_exclaims", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "word_size": ("word_chars", "n_words"),
}
#: Cutoffs per thousand, from lax to strict; the last rule counts characters per thousand words.
CUTOFFS = {
    "symbols": (500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10),
    "exclaims": (2000, 1500, 1200, 1000, 800, 600, 500, 400, 300, 200, 100, 50),
    "dup_lines": (900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100),
    "repeats": (450, 400, 350, 300, 250, 200, 150, 120, 100, 80),
    "word_size": (40000, 30000, 25000, 20000, 16000, 14000, 12000, 11000, 10000, 9000),
}
#: Share of good documents that all rules of a stratum together may reject, and the chance that the
#: guarantee fails anywhere.
RISK, DELTA = 0.05, 0.05
#: Strata up to this number are broadcast with their cutoffs; more are joined by a shuffle.
BROADCAST_STRATA = 10_000


def measures(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``__``-prefixed counts of every whole text (null text: zeros).

    A word is a run of characters outside ``[\\x20\\x09-\\x0D]``. Everything is row-local; repeated
    three-word windows are found by sorting a text's window hashes, in n log n steps.
    """
    df = docs.withColumn("__t", F.expr(f"coalesce(CAST(`{text_col}` AS STRING), '')"))
    df = df.withColumns({
        "__words": F.expr(r"array_remove(split(__t, '[\\x20\\x09-\\x0D]+'), '')"),
        "__lines": F.expr(r"filter(split(__t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
        "__n_symbols": F.expr(f"CAST(octet_length(regexp_replace(__t, '[^{SYMBOLS}]+', '')) AS BIGINT)"),
        "__n_exclaims": F.expr("CAST(octet_length(__t) - octet_length(replace(__t, '!', '')) AS BIGINT)"),
    }).drop("__t", text_col)
    df = df.withColumns({
        "__n_words": F.expr("CAST(size(__words) AS BIGINT)"),
        "__word_chars": F.expr("CAST(char_length(array_join(__words, '')) AS BIGINT)"),
        "__n_lines": F.expr("CAST(size(__lines) AS BIGINT)"),
        "__n_dup_lines": F.expr("CAST(size(__lines) - size(array_distinct(__lines)) AS BIGINT)"),
        "__mask": F.expr("shiftleft(-1L, char_length(bin(size(__words))))"),
    }).drop("__lines")
    # window hashes with the window's place in their low bits; equal windows end up side by side
    df = df.withColumn("__sorted", F.expr(
        "CASE WHEN size(__words) >= 3 THEN sort_array(transform(sequence(0, size(__words) - 3), i ->"
        " (xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2)) & __mask) | i)) END"))
    same = (lambda x, y: f"(({x} ^ {y}) & __mask) = 0 AND " + " AND ".join(
        f"get(__words, CAST({x} & ~__mask AS INT) + {j}) = get(__words, CAST({y} & ~__mask AS INT) + {j})"
        for j in range(3)))
    df = df.withColumn("__at", F.expr(
        "sort_array(transform(filter(__sorted, (x, i) ->"
        f" coalesce({same('x', 'get(__sorted, i + 1)')}, false) OR coalesce({same('x', 'get(__sorted, i - 1)')}, false)),"
        " x -> x & ~__mask))")).drop("__sorted", "__words", "__mask")
    return df.withColumn("__n_repeat_words", F.expr(
        "CAST(coalesce(aggregate(transform(__at, (p, i) -> least(3L, coalesce(get(__at, i + 1) - p, 3L))),"
        " 0L, (s, x) -> s + x), 0) AS BIGINT)")).drop("__at")


def _value(rule: str) -> str:
    over, under = RULES[rule]
    return f"CASE WHEN __{under} > 0 THEN 1000 * __{over} / __{under} ELSE 0 END"


def base_failed() -> str:
    return f"(__n_words < {MIN_WORDS} OR 100 * __n_repeat_words > 50 * __n_words)"


def cutoffs(measured: DataFrame, labels: DataFrame, stratum_col: str, *, id_col: str = "doc_id",
            risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum and rule that got a cutoff: ``stratum, rule, cutoff, n_good, k_good``.

    Labelled documents that pass the base rules are the holdout. For each stratum and rule the cutoffs
    are tested from lax to strict (a fixed sequence, so no correction among them): a cutoff passes while
    P(Binomial(n_good, risk / rules) <= rejected good) is at most ``delta`` / (strata x rules). Among the
    passed ones the cutoff with the largest excess of rejected bad over rejected good shares is taken, the
    laxest of equals; without an excess, or with too few labels to pass a test, the rule stays off.
    """
    names = list(RULES)
    levels = ", ".join(
        f"named_struct('rule', '{r}', 'level', {' + '.join(f'int(({_value(r)}) > {c})' for c in CUTOFFS[r])})"
        for r in names)
    # repeated label rows vote once: a document is good if any of its labels says so
    votes = (labels.where("quality IS NOT NULL").groupBy(F.col(id_col).alias("__id"))
             .agg(F.max("quality").alias("__quality")))
    holdout = (measured.where(f"NOT {base_failed()}")
               .selectExpr(f"`{id_col}` AS __id", f"`{stratum_col}` AS stratum", f"array({levels}) AS __levels")
               .join(votes, "__id")
               .select("stratum", "__quality", F.explode("__levels").alias("x")))
    counted = (holdout.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.level").alias("level"))
               .agg(F.sum(F.expr("int(__quality = 1)")).alias("good"), F.sum(F.expr("int(__quality <> 1)")).alias("bad")))
    grid = " ".join(f"WHEN rule = '{r}' THEN array({', '.join(map(str, CUTOFFS[r]))})" for r in names)
    # levels and tests are few: rules x cutoffs per stratum
    per = (counted.groupBy("stratum", "rule")
           .agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
                F.collect_list(F.struct("level", "good", "bad")).alias("bins")))
    strata = per.agg(F.count_distinct("stratum").alias("s"), F.max(F.expr("int(stratum IS NULL)")).alias("z"))
    p = risk / len(names)
    per = per.crossJoin(strata.selectExpr(f"{len(names)} * (s + coalesce(z, 0)) AS tests"))
    per = per.withColumn("most", F.expr(f"""
        CASE WHEN n_good = 0 THEN CAST(-1 AS BIGINT) ELSE aggregate(
          sequence(CAST(0 AS BIGINT), CAST(floor(n_good * {p!r}D) AS BIGINT)),
          named_struct('t', n_good * ln(1D - {p!r}D), 's', n_good * ln(1D - {p!r}D), 'k', CAST(-1 AS BIGINT)),
          (a, i) -> named_struct(
            't', a.t + ln((n_good - i) / (i + 1D)) + ln({p!r}D / (1D - {p!r}D)),
            's', a.s + ln(1D + exp(a.t + ln((n_good - i) / (i + 1D)) + ln({p!r}D / (1D - {p!r}D)) - a.s)),
            'k', CASE WHEN a.s <= ln({delta!r}D / tests) THEN i ELSE a.k END),
          a -> a.k) END"""))
    tests = (per.withColumn("grid", F.expr(f"CASE {grid} END"))
             .select("stratum", "rule", "n_good", "n_bad", "most", "bins", "grid",
                     F.posexplode("grid").alias("i", "cutoff"))
             .withColumns({
                 "k_good": F.expr("aggregate(bins, 0L, (s, b) -> s + CASE WHEN b.level >= size(grid) - i THEN b.good ELSE 0 END)"),
                 "k_bad": F.expr("aggregate(bins, 0L, (s, b) -> s + CASE WHEN b.level >= size(grid) - i THEN b.bad ELSE 0 END)"),
             }))
    # rejections only grow with strictness, so passing is a prefix of the sequence by itself
    return (tests.where("k_good <= most AND k_bad * n_good > k_good * n_bad")
            .groupBy("stratum", "rule", "n_good")
            .agg(F.max_by("cutoff", F.expr("named_struct('gain', k_bad * n_good - k_good * n_bad, 'c', cutoff)"))
                 .alias("cutoff"),
                 F.max_by("k_good", F.expr("named_struct('gain', k_bad * n_good - k_good * n_bad, 'c', cutoff)"))
                 .alias("k_good"))
            .select("stratum", "rule", "cutoff", "n_good", "k_good"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum_col: str = "lang",
          text_col: str = "text", keep: tuple[str, ...] = (), risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Verdict per row of ``docs``: the id, ``keep`` columns, counts, ``base_failed``, ``failed_rules``, ``kept``.

    The counts are computed once, kept in the shared checkpoint folder and read twice: for the labelled
    documents and for the verdicts. Only ``n_words`` to ``kept`` and the kept columns come back, so further
    columns cannot clash. A null text has no words and fails the base rules; null strata form one stratum;
    null ids match no label; repeated rows are judged each; repeated labels count once; an empty table gives
    no rows; without labels only the base rules reject.
    """
    names = [n for n in dict.fromkeys((id_col, stratum_col, *keep)) if n != text_col]
    renamed = {n: f"__c{i}" for i, n in enumerate(names)}
    source = docs.select(*[F.col(f"`{n}`").alias(a) for n, a in renamed.items()], F.col(f"`{text_col}`").alias("__text"))
    measured = settle(measures(source, text_col="__text"))
    chosen = (cutoffs(measured, labels.select(F.col(id_col).alias(renamed[id_col]), F.col("quality").cast("int").alias("quality")),
                      renamed[stratum_col], id_col=renamed[id_col], risk=risk, delta=delta)
              .groupBy(F.col("stratum").alias("__stratum"))
              .agg(*[F.max(F.expr(f"CASE WHEN rule = '{r}' THEN cutoff END")).alias(f"__cut_{r}") for r in RULES]))
    chosen = settle(chosen)
    few = chosen.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    joined = measured.join(F.broadcast(chosen) if few else chosen,
                           F.col(renamed[stratum_col]).eqNullSafe(F.col("__stratum")), "left")
    failed = ", ".join(f"CASE WHEN ({_value(r)}) > __cut_{r} THEN '{r}' END" for r in RULES)
    return joined.selectExpr(
        *[f"`{a}` AS `{n}`" for n, a in renamed.items() if n == id_col or n in keep],
        "__n_words AS n_words", "__word_chars AS word_chars", "__n_symbols AS n_symbols",
        "__n_dup_lines AS n_dup_lines", "__n_repeat_words AS n_repeat_words",
        f"{base_failed()} AS base_failed", f"array_compact(array({failed})) AS failed_rules",
        f"NOT {base_failed()} AND size(array_compact(array({failed}))) = 0 AS kept")
