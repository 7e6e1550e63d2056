"""Near-duplicate lines by their deletion neighbourhoods, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.llm._store import sized, stored

#: Where lines are cut from texts, those with fewer words are left alone (they recur by chance), and those of at least
#: so many words may differ by one word from an earlier line. ``op2_line_dedup`` takes 1 and 2.
MIN_WORDS, EDIT_WORDS = 5, 8

#: Words of every line of a lower-cased text; split before the lines are spread, so that each is split once.
_WORDS = r"transform(split(lower(text), '\n'), l -> array_remove(split(l, '[\\x20\\x09-\\x0D]+'), ''))"
#: Orders lines by id, then row, then place in the text: 64 bits of id, 31 of the row's key, 31 of the line number.
#: Null ids come first; there the other bits of the key follow the least id downwards, so that all of it counts.
_SPAN = "4611686018427387904"
_OWNER = ("CASE WHEN id IS NULL THEN CAST(-9223372036854775809 AS DECIMAL(20, 0)) - CAST(shiftrightunsigned(row_key, 31) AS DECIMAL(20, 0))"
          " ELSE CAST(id AS DECIMAL(20, 0)) END")
_PLACE = f"CAST(CAST({_OWNER} AS DECIMAL(38, 0)) * {_SPAN} AS DECIMAL(38, 0)) + ((row_key & 2147483647) * 2147483648 + line_no)"


def _id_at(place: str) -> str:
    """The document id in a place, null for rows without one."""
    return f"CASE WHEN {place} < -9223372036854775808 * CAST({_SPAN} AS DECIMAL(38, 0)) THEN NULL ELSE CAST(({place} - pmod({place}, {_SPAN})) / {_SPAN} AS BIGINT) END"


def _line_at(place: str) -> str:
    return f"(CAST(pmod({place}, {_SPAN}) AS BIGINT) & 2147483647)"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def row_key(id_col: str, text_col: str) -> str:
    """Names a row also where ids are null or repeat; equal rows share it."""
    return f"xxhash64(CAST(`{id_col}` AS BIGINT), CAST(`{text_col}` AS STRING))"


def _lines(keyed: DataFrame, min_words: int) -> DataFrame:
    return (keyed.selectExpr("id", "xxhash64(id, text) AS row_key", f"posexplode({_WORDS}) AS (line_no, words)")
            .where(f"size(words) >= {min_words}"))


def _half(keep: str, n: str) -> str:
    """Key of a line that hides one half of a line of ``n`` words: what is kept, counted from its own end."""
    front, back = f"CAST({n} DIV 2 AS INT)", f"CAST({n} - {n} DIV 2 AS INT)"
    part = f"slice(words, 1, {front})" if keep == "front" else f"slice(words, size(words) - {back} + 1, {back})"
    return f"xxhash64('{keep}', {n}, {part})"


def duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS) -> DataFrame:
    """Lines to remove: ``row_key, id_col, line_no, keeper_id, keeper_line_no, edits``.

    Lines are split at ``\\n`` and compared as lower-cased words. A line is removed if an earlier line (by
    document id, then row, then place) has the same words (``edits`` 0), or, from ``edit_words`` words on, if one word
    replaced, inserted or deleted makes it an earlier line (1); ``keeper`` is the earliest such line. The
    keeper may itself be removed for a still earlier one.

    1. Every line gets two hashes of its words and, per length it can match, hashes of its halves: one edit
       leaves one half untouched, so two lines within the bound share a key. This is the neighbourhood of
       deleted halves; keys that only one distinct line has end here.
    2. The remaining distinct lines emit every deletion of one word, and every gap for the shorter side of an
       insertion, as hashed keys; equal keys are joined through the earliest line of each, so no group
       is paired with itself.
    3. Each pair is verified on its words.

    Hot lines are reduced map-side, and keys are made from distinct lines. Null ids sort first; rows with null or equal
    ids follow each other by a hash of id and text (31 bits of it where an id repeats); null and empty texts have no
    lines; rows that are equal in id and text are one document and keep or lose the same lines; lines of fewer than ``min_words``
    words stay; further columns are left out; an empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    long = f"size(words) >= {edit_words}"
    longer = f"size(words) > {edit_words}"
    lines = stored(_lines(keyed, min_words).selectExpr(
        "id", "row_key", "line_no", "xxhash64(words) AS h1", "xxhash64(1, words) AS h2",
        f"CASE WHEN {long} THEN {_half('front', 'size(words)')} END AS k1",
        f"CASE WHEN {long} THEN {_half('back', 'size(words)')} END AS k2",
        f"CASE WHEN {longer} THEN {_half('front', '(size(words) - 1)')} END AS k3",
        f"CASE WHEN {longer} THEN {_half('back', '(size(words) - 1)')} END AS k4"), "lines")
    classes = stored(lines.groupBy("h1", "h2").agg(
        F.min(F.expr(_PLACE)).alias("place"), F.count("*").alias("copies"), *(F.max(k).alias(k) for k in ("k1", "k2", "k3", "k4"))),
        "line-classes")

    keys = classes.select("h1", F.explode(F.array("k1", "k2", "k3", "k4")).alias("key")).where("key IS NOT NULL")
    shared = stored(keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"), "line-keys")
    close = stored(keys.join(sized(shared), "key", "left_semi").select("h1").distinct(), "close-lines")

    # the words of each such line, read at its earliest place
    spots = stored(classes.join(sized(close), "h1", "left_semi").select("h1", "h2", "place"), "line-spots")
    owners = stored(spots.select(F.expr(_id_at("place")).alias("id")).distinct(), "line-owners")
    texts = keyed.join(sized(owners), keyed["id"].eqNullSafe(owners["id"]), "left_semi")
    found = _lines(texts, min_words).selectExpr("xxhash64(words) AS h1", "xxhash64(1, words) AS h2", "words")
    worded = stored(found.join(sized(spots), ["h1", "h2"])
                    .select("h1", "h2", "place", "words").dropDuplicates(["h1", "h2"]), "line-words")

    spread = worded.selectExpr("h1", "h2", "place", "size(words) AS n", "posexplode(words) AS (i, word)").selectExpr(
        "h1", "h2", "place", "n", "i", "xxhash64(word, i) AS x", "xxhash64(word, n - i) AS y")
    spread = spread.selectExpr(
        "h1", "h2", "place", "n", "i", "x", "y",
        "coalesce(bit_xor(x) OVER (PARTITION BY h1, h2 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before",
        "coalesce(bit_xor(y) OVER (PARTITION BY h1, h2 ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS after")
    variants = spread.selectExpr("h1", "h2", "place", f"""explode(filter(array(
        xxhash64(n - 1, before, after),
        xxhash64(n, before, after ^ y),
        CASE WHEN i = n - 1 THEN xxhash64(n, before ^ x, 0L) END), k -> k IS NOT NULL)) AS key""")
    variants = stored(variants.distinct(), "line-variants")
    first = variants.groupBy("key").agg(F.min("place").alias("keeper"), F.max("place").alias("last")).where("keeper <> last")
    near = (variants.join(first, "key").where("keeper < place")
            .groupBy("h1", "h2", "place").agg(F.min("keeper").alias("keeper")))

    mine, theirs = worded.select("h1", "h2", "words"), worded.select(F.col("place").alias("keeper"), F.col("words").alias("kept_words"))
    pairs = near.join(mine, ["h1", "h2"]).join(theirs, "keeper")
    # common front, then equal backs after at most one word on either side
    pairs = pairs.withColumn("p", F.expr(
        "coalesce(array_position(transform(sequence(0, least(size(words), size(kept_words)) - 1),"
        " i -> get(words, i) = get(kept_words, i)), false) - 1, -1)"))
    pairs = pairs.withColumn("p", F.expr("CAST(CASE WHEN p < 0 THEN least(size(words), size(kept_words)) ELSE p END AS INT)"))
    rest = lambda w, skip: f"slice({w}, p + 1 + {skip}, greatest(size({w}) - p - {skip}, 0))"
    verified = pairs.where(
        f"(size(words) = size(kept_words) AND {rest('words', 1)} = {rest('kept_words', 1)})"
        f" OR (size(words) = size(kept_words) + 1 AND {rest('words', 1)} = {rest('kept_words', 0)})"
        f" OR (size(words) + 1 = size(kept_words) AND {rest('words', 0)} = {rest('kept_words', 1)})"
    ).select("h1", "h2", "keeper")

    decided = stored(classes.where("copies > 1").select("h1", "h2", "place")
                     .join(verified, ["h1", "h2"], "full").select("h1", "h2", "place", "keeper")
                     .join(classes.select("h1", "h2", F.col("place").alias("own")), ["h1", "h2"])
                     .selectExpr("h1", "h2", "own", "keeper"), "line-verdicts")
    return (lines.join(sized(decided), ["h1", "h2"])
            .withColumn("place", F.expr(_PLACE))
            .where("keeper IS NOT NULL OR place <> own")
            .selectExpr("row_key", f"id AS `{id_col}`", "line_no", "coalesce(least(keeper, own), own) AS kept",
                        "CASE WHEN place <> own AND (keeper IS NULL OR own < keeper) THEN 0L ELSE 1L END AS edits")
            .selectExpr("row_key", f"`{id_col}`", "CAST(line_no AS BIGINT) AS line_no",
                        f"{_id_at('kept')} AS keeper_id", f"{_line_at('kept')} AS keeper_line_no", "edits"))


def without_lines(docs: DataFrame, removed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut from their texts, and without documents that lose all their words.

    A document's removed lines are gathered by its row and meet its text in one exchange, at every size; documents
    without any go through unchanged.
    """
    cuts = stored(removed.groupBy("row_key").agg(F.collect_set(F.col("line_no").cast("int")).alias("__cut"))
                  .withColumnRenamed("row_key", "__row"), "line-cuts")
    columns = [f"`{c}`" for c in docs.columns]
    joined = docs.withColumn("__row", F.expr(row_key(id_col, text_col))).join(cuts.hint("shuffle_hash"), "__row", "left")
    left = joined.withColumn("__text", F.expr(
        rf"CASE WHEN __cut IS NULL THEN `{text_col}` ELSE array_join(transform(array_except(sequence(0,"
        rf" size(split(`{text_col}`, '\n')) - 1), __cut), i -> get(split(`{text_col}`, '\n'), i)), '\n') END"))
    return (left.where(r"__cut IS NULL OR __text rlike '[^\\x20\\x09-\\x0D]'")
            .withColumn(text_col, F.col("__text")).selectExpr(*columns))
