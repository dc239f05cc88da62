"""Turning arrays into rows without evaluating them twice.

An inner ``explode`` lets the optimizer derive a ``size(array) > 0`` filter and
push it below the projection that builds the array, so a derived array would be
computed once for the filter (inside lambdas, many times) and once for the rows.
The outer generators have no such filter; dropping the null row afterwards gives
the same rows at a fraction of the cost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, *keep: Column | str, guard: str) -> DataFrame:
    """Rows of an array of structs; ``guard`` is a struct field that is never null."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(guard).isNotNull())


def unnest_at(df: DataFrame, array: Column | str, *keep: Column | str, pos: str = "pos", item: str = "item") -> DataFrame:
    """Rows of an array with their 0-based position."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def scan(xs: Column, zero: dict[str, Column], step: Callable[[Column, Column], dict[str, Column] | Column], kind: str) -> Column:
    """What a fold over an array has to say on its way: the ``emit`` of every step that is not null, in order.

    ``step`` maps (state, element) to the next state, a struct or its fields, with
    ``emit``, a value of type ``kind``. An accumulator that holds all of it would be copied at every
    step; here the array is cut into about as many pieces as each has elements, so a
    step copies what its own piece has said, and a piece what came before it once.
    """
    none = F.lit(None).cast(kind)
    empty = F.array().cast(f"array<{kind}>")
    state = lambda s: F.struct(*[c.alias(n) for n, c in s.items()]) if isinstance(s, dict) else s
    start = state({**zero, "emit": none})

    def inner(a: Column, x: Column) -> Column:
        def said(s: Column) -> Column:
            return F.struct(s.alias("state"), F.when(s["emit"].isNotNull(), F.array_append(a["out"], s["emit"])).otherwise(a["out"]).alias("out"))
        return F.element_at(F.transform(F.array(state(step(a["state"], x))), said), 1)

    def outer(a: Column, piece: Column) -> Column:
        return F.aggregate(piece, F.struct(a["state"].alias("state"), empty.alias("out")), inner,
                           lambda r: F.struct(r["state"].alias("state"), F.array_append(a["outs"], r["out"]).alias("outs")))

    def pieces(all_: Column) -> Column:
        n = F.size(all_)
        width = F.greatest(F.lit(32), F.ceil(F.sqrt(n)).cast("int"))
        cut = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / w).cast("int") - 1, F.lit(0))), lambda b: F.slice(all_, b * w + 1, w))
        return F.element_at(F.transform(F.array(width), cut), 1)

    cut = F.element_at(F.transform(F.array(xs), pieces), 1)
    return F.flatten(F.aggregate(cut, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs")), outer, lambda r: r["outs"]))
