"""Array expressions that the built-in functions lack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that one block of a prefix sum holds.
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(values: Column, zero: Column | None = None) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint") if zero is None else zero, lambda a, x: a + x)


def prefix_sums(values: Column) -> Column:
    """For each value the sum of those before it, in blocks, so that a long array isn't summed anew for each of its places."""

    def one(s: Column) -> Column:
        def before(_: Column, k: Column) -> Column:
            full = F.floor(k / BLOCK).cast("int")
            return total(F.slice(s["blocks"], 1, full)) + total(F.slice(s["values"], full * BLOCK + 1, k % BLOCK))

        return F.transform(s["values"], before)

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: total(F.slice(v, b * BLOCK + 1, BLOCK)))).otherwise(F.array().cast("array<bigint>"))

    longs = F.transform(values, lambda x: x.cast("bigint"))
    return let(longs, lambda v: let(F.struct(v.alias("values"), blocks(v).alias("blocks")), one))
