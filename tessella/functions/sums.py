"""Sums that don't depend on how rows are dealt: ordered, and compensated for rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compensated(values: str | Column) -> Column:
    """The sum of an array of doubles in its order, after Neumaier: what each addition loses is kept aside and added last.

    Nulls count as nothing; an empty or null array gives 0. Overflow gives what plain addition would.
    """
    array = F.col(values) if isinstance(values, str) else values
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("rest"))

    def add(state: Column, x: Column) -> Column:
        value = F.coalesce(x.cast("double"), F.lit(0.0))
        total = state["sum"] + value
        lost = F.when(F.abs(state["sum"]) >= F.abs(value), (state["sum"] - total) + value).otherwise((value - total) + state["sum"])
        return F.struct(total.alias("sum"), (state["rest"] + lost).alias("rest"))

    def finish(state: Column) -> Column:
        whole = state["sum"] + state["rest"]
        return F.when(F.isnan(whole), state["sum"]).otherwise(whole)

    return F.coalesce(F.aggregate(array, start, add, finish), F.lit(0.0))


def ordered_sum(value: str | Column, *order: str | Column) -> Column:
    """An aggregate: the group's values summed by compensated() in the order given, and then of the values themselves.

    The same whatever the partitions. It holds a group's values in one array: for groups of a bounded size.
    """
    of = F.col(value) if isinstance(value, str) else value
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"o{k}") for k, o in enumerate(order)]
    rows = F.sort_array(F.collect_list(F.struct(*keys, of.cast("double").alias("v"))))
    return compensated(F.transform(rows, lambda r: r["v"]))
