"""Array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def computed(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Add columns by expressions (SQL or Column) that later ones may use within lambdas.

    The optimizer would otherwise inline an expression into a lambda that names it once, and evaluate it for every
    element; a one-row generator keeps it where it is.
    """
    for name, made in columns.items():
        df = df.select("*", F.explode(F.array(F.expr(made) if isinstance(made, str) else made)).alias(name))
    return df


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it: it is the one element of a lambda's array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_starts(lengths: str) -> str:
    """SQL for the exclusive prefix sums of an int array column.

    Two levels of blocks keep a long array nearly linear, where appending one by one would be quadratic.
    """
    blocks = f"sequence(0, cast((size({lengths}) - 1) div {BLOCK} as int))"
    total = f"(a, b) -> array_append(a, element_at(a, -1) + aggregate(slice({lengths}, b * {BLOCK} + 1, {BLOCK}), 0, (t, x) -> t + x))"
    base = f"aggregate({blocks}, array(0), {total})"
    own = f"aggregate(slice({lengths}, i - i % {BLOCK} + 1, i % {BLOCK}), 0, (t, x) -> t + x)"
    spread = f"slice(flatten(transform({base}, b -> array_repeat(b, {BLOCK}))), 1, size({lengths}))"
    return f"case when size({lengths}) > 0 then transform({spread}, (z, i) -> z + {own}) else array() end"


def sorted_join(column: str) -> str:
    """SQL: the non-empty elements, sorted and joined by '; '."""
    return f"array_join(array_sort(filter({column}, x -> x is not null and x != '')), '; ')"
