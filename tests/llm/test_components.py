"""Components found in steps, and what their rounds move."""

import random

import pytest

from spinelens.llm import components as C


def roots(df):
    return {r["node"]: r["root"] for r in df.collect()}


@pytest.mark.parametrize("per_partition", [100, 1_000_000])
def test_later_links_join_components(spark, monkeypatch, per_partition):
    monkeypatch.setattr(C, "PARTITION_LINKS", per_partition)
    rng = random.Random(4)
    pairs = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1600)]
    first, later = (spark.createDataFrame(p, "a long, b long") for p in (pairs[:1000], pairs[1000:]))
    whole = roots(C.components(first.union(later)))
    assert roots(C.joined(C.components(first), later)) == whole and len(set(whole.values())) > 100
    assert roots(C.joined(C.components(first), later.limit(0))) == roots(C.components(first))
    assert roots(C.joined(C.components(first.limit(0)), later)) == roots(C.components(later))


def test_rounds_broadcast_nothing(spark, monkeypatch):
    real, plans = C.settle, []

    def settled(df):
        out = real(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(C, "settle", settled)
    links = spark.range(500).selectExpr("id AS a", "id + 1 AS b")
    assert set(roots(C.components(links)).values()) == {0}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
    assert not any("Exchange" in p for p in plans[1:-1])  # few links are left where they are
