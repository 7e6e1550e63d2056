"""Words of the model are arrays in the driver, not rows of plans that stay there with every plan made from them."""

import pytest
from pyspark.sql import SparkSession

from spinelens.llm import brown_lm


@pytest.mark.parametrize("held_words", [40, 1 << 18])
def test_scoring_has_no_rows_of_held_words_in_plans(spark, real, monkeypatch, held_words):
    def refuse(*given, **more):
        raise AssertionError("rows made in the driver")

    monkeypatch.setattr(SparkSession, "createDataFrame", refuse)
    scored = brown_lm.score_texts(real["documents"], exchange_words=30, held_words=held_words)
    assert "LocalRelation" not in scored._jdf.queryExecution().analyzed().toString()
    assert "Broadcast" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.count() == real["documents"].count()


def test_words_behind_the_last_held_one(spark, docs):
    """Ties at the last held word are told apart by the word itself, so known words and base scores do not depend on what is held."""
    texts = [(i, " ".join(w for w in ("é", "a'b", "b", "zz", "\x01", "c\\d") for _ in range(3 if w != "b" else 2))) for i in range(30)]
    want = None
    for held in (1, 2, 3, 5, 6, 50):
        rows = brown_lm.score_texts(docs(texts), held_words=held, exchange_words=2).collect()
        got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in rows)
        want = want or got
        assert got == want and all(r["n_known"] == r["n_tokens"] for r in rows)
