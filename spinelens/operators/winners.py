"""One row per key: the first or the last in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def kept_rows(df: DataFrame, keys: list[str], order: list[str], last: bool = True) -> DataFrame:
    """The last (or first) row of each key in the order of the columns ``order``, which is unique inside a key.

    Rows of fixed-width columns with one order column are reduced by a hash aggregate in every map task. Other rows, with
    texts, lists or structs, are chosen on keys and order alone; the chosen meet the rows dealt by key and order. So a
    key with a third of all rows is dealt to many tasks, and no sort carries more than keys and order.
    Rows whose order is null are left out; null keys are no key.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = "max" if last else "min"
    fixed = all(isinstance(df.schema[c].dataType, _FIXED) for c in rest)
    if len(order) == 1 and fixed:
        kept = df.where(F.col(order[0]).isNotNull()).groupBy(*keys).agg(*[
            F.expr(f"{pick}_by(`{c}`, `{order[0]}`) AS `{c}`") for c in rest])
        return kept.select(*df.columns)
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, *order])
    narrow = df.where(known).select(*keys, *order)
    if len(order) == 1:
        chosen = narrow.groupBy(*keys).agg(F.expr(f"{pick}(`{order[0]}`) AS `{order[0]}`"))
    else:
        columns = ", ".join(f"`{c}`" for c in order)
        chosen = narrow.groupBy(*keys).agg(F.expr(f"{pick}(struct({columns})) AS __kept")).selectExpr(
            *[f"`{c}`" for c in keys], *[f"__kept.`{c}` AS `{c}`" for c in order])
    return df.join(chosen.hint("shuffle_hash"), [*keys, *order], "left_semi").select(*df.columns)
