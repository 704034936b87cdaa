"""Folds over an array with a small state, whose results grow in linear time, and values that are used twice but made once.

`aggregate` copies its accumulator's array at each step, so an array that gets an element per step costs the square of its
length. Here the items are taken in blocks: a block's results are one short array, and only those are joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocked(items: Column, zero: Column, step: Callable[[Column, Column], Column], emits: str, block: int = BLOCK) -> Column:
    """(state, out) after all items: `step(state, item)` gives (state, out), an array of none or more results of the type
    `emits`, which follow each other in `out`."""
    none = F.array().cast(f"array<{emits}>")

    def one(a: Column, x: Column) -> Column:
        return bind(step(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.when(F.size(r["out"]) == 0, a["out"]).otherwise(F.concat(a["out"], r["out"])).alias("out")))

    def over(xs: Column) -> Column:
        def several(a: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(xs, b * block + 1, F.lit(block)), F.struct(a["state"].alias("state"), none.alias("out")), one)
            return bind(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

        numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / block), F.lit(0)).cast("int"))
        whole = F.aggregate(numbers, F.struct(zero.alias("state"), F.array().cast(f"array<array<{emits}>>").alias("out")), several)
        return bind(whole, lambda r: F.struct(r["state"].alias("state"), F.flatten(r["out"]).alias("out")))

    return bind(items, over)
