"""Numbering inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_within(
    df: DataFrame, keys: list[str], major: str, minor: str, out: str, rows: int = 65536
) -> DataFrame:
    """1-based position of each row of a group in (major, minor) order.

    Each group's range of the integer ``minor`` is cut into as many equal buckets as it has times ``rows``
    rows. Rows are ranked inside a bucket and moved by the size of the buckets before it, so a hot group is
    sorted by many tasks however dense its numbers are; what is summed up per group is one row per
    bucket. The sizes are the last ranks, so they share the ranked rows' exchange.
    """
    group = [*keys, major]
    spans = df.groupBy(*group).agg(
        F.min(minor).alias("__low"),
        F.expr(f"greatest(1, ceil((max({minor}) - min({minor}) + 1) / ceil(count(1) / {rows}D))) AS __width"))
    bucketed = df.join(spans, group).withColumn(
        "__bucket", F.expr(f"CAST(({minor} - __low) DIV __width AS BIGINT)")).drop("__low", "__width")
    parts = [*group, "__bucket"]
    ranked = bucketed.withColumn("__rank", F.row_number().over(Window.partitionBy(*parts).orderBy(minor)))
    before = Window.partitionBy(*keys).orderBy(major, "__bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = ranked.groupBy(*parts).agg(F.max("__rank").alias("__n"))
    offsets = sizes.select(*parts, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return ranked.join(offsets, parts).withColumn(
        out, F.col("__before") + F.col("__rank")
    ).drop("__bucket", "__rank", "__before")


def running_by_score(
    df: DataFrame, keys: list[str], score: str, values: dict[str, str], descending: bool = True,
    buckets: int = 4096,
) -> DataFrame:
    """Running aggregates (``sum`` or ``max`` calls, by output name) over a score between 0 and 1.

    The running frame of a key is cut into score buckets: a running aggregate inside each bucket, a
    running aggregate over one row per bucket, and their combination. No task sees more than one
    bucket of a key. Rows of equal score share the result of the last of them.
    """
    order = F.desc if descending else F.asc
    cut = df.withColumn("__bucket", F.expr(f"CAST(floor({score} * {buckets}) AS INT)"))
    parts = [*keys, "__bucket"]
    inside = Window.partitionBy(*parts).orderBy(order(score)).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(order("__bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    functions = {out: call.split("(")[0] for out, call in values.items()}
    totals = cut.groupBy(*parts).agg(*[F.expr(f"{call} AS {out}") for out, call in values.items()])
    before = totals.select(*parts, *[
        F.expr(f"{functions[out]}({out})").over(earlier).alias(f"__{out}") for out in values])
    local = cut.select("*", *[
        F.expr(call).over(inside).alias(out) for out, call in values.items()])
    joined = local.join(before, parts)
    combined = {
        out: F.expr(f"{out} + coalesce(__{out}, 0)" if fn == "sum" else f"greatest({out}, __{out})")
        for out, fn in functions.items()
    }
    return joined.select(*df.columns, *[c.alias(out) for out, c in combined.items()])
