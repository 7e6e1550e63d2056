"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from spinelens.llm import quality_rules, sharding

ORACLES: dict[str, str] = {}


def _quality_rules() -> str:
    rules, risk, delta = quality_rules.RULES, quality_rules.RISK, quality_rules.DELTA
    p = risk / len(rules)
    values = " UNION ALL ".join(
        f"SELECT doc_id, lang, quality, base_failed, '{r}' AS rule, CASE WHEN {under} > 0 THEN 1000 * {over} / {under} ELSE 0 END AS value FROM judged"
        for r, (over, under) in rules.items())
    grid = ", ".join(f"('{r}', {c})" for r in rules for c in quality_rules.CUTOFFS[r])
    return rf"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM words WHERE len(ws) >= 3)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY doc_id),
votes AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, w.lang, v.quality, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{quality_rules.SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM words w LEFT JOIN repeats r USING (doc_id) LEFT JOIN votes v USING (doc_id)),
judged AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
ruled AS ({values}),
grid(rule, cutoff) AS (VALUES {grid}),
tests AS (
  SELECT lang, rule, cutoff, count(*) FILTER (WHERE quality = 1) AS n_good, count(*) FILTER (WHERE quality <> 1) AS n_bad,
    count(*) FILTER (WHERE quality = 1 AND value > cutoff) AS k_good,
    count(*) FILTER (WHERE quality <> 1 AND value > cutoff) AS k_bad
  FROM ruled JOIN grid USING (rule) WHERE NOT base_failed AND quality IS NOT NULL GROUP BY lang, rule, cutoff),
bounded AS (
  SELECT *, {len(rules)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM tests)) AS n_tests,
    list_sum(list_transform(range(0, k_good + 1), lambda k: exp(
      lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1) + k * ln({p!r}::DOUBLE) + (n_good - k) * ln(1 - {p!r}::DOUBLE)))) AS chance
  FROM tests WHERE n_good > 0 AND k_good <= floor(n_good * {p!r}::DOUBLE) AND k_bad * n_good > k_good * n_bad),
chosen AS (
  SELECT lang, rule, cutoff FROM bounded WHERE chance <= {delta!r}::DOUBLE / n_tests
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY k_bad * n_good - k_good * n_bad DESC, cutoff DESC) = 1),
failed AS (
  SELECT DISTINCT r.doc_id FROM ruled r JOIN chosen c ON r.lang IS NOT DISTINCT FROM c.lang AND r.rule = c.rule AND r.value > c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM judged"""


def _sharding() -> str:
    shards = [f"shard-{i:02}" for i in range(64)]
    owners = ",".join(map(str, sharding.fill_table(shards)))
    return f"""
WITH owners AS (SELECT string_split('{owners}', ',') AS shard_of),
placed AS (
  SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS INTEGER) AS slot
  FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(shard_of[slot + 1], 2, '0') AS shard FROM placed, owners"""


ORACLES["op3_quality_rules"] = _quality_rules()
ORACLES["op5_sharding"] = _sharding()

ORACLES["op13_hard_negatives"] = """
WITH vectors AS (
  SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row_id AS anchor_row, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.row_id <> b.row_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_row, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_row)
WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_row, p.id ORDER BY n.score DESC, n.id) <= 10"""
