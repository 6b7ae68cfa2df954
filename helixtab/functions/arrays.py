"""Expressions over arrays in about linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a running fold takes at once.
STEP = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """first and the fold after each of `values`, size(values) + 1 elements. A fold that appends to one array copies it at each step; this one
    folds STEP elements at a time from where the steps before have come to, so its time is about linear."""
    grow = lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda k: F.slice(values, k * STEP + 1, F.lit(STEP)))

    def of(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(first), lambda acc, b: F.array_append(acc, F.aggregate(b, F.element_at(acc, -1), step)))
        inner = let(begins, lambda s: F.transform(blocks, lambda b, k: F.slice(F.aggregate(b, F.array(F.get(s, k)), grow), F.lit(2), F.lit(STEP))))
        return F.concat(F.array(first), F.flatten(inner))

    return F.when(F.size(values) > STEP, let(blocks, of)).otherwise(F.aggregate(values, F.array(first), grow))
