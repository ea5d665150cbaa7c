"""Run-length arrays as columns: ARRAY<STRUCT<value, len>> and ARRAY<STRUCT<jump, len>>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from featmart.functions.scalars import as_column

# Statuses of a closed month.
CLOSED = ("C", "☗")


def bound(expr: Column, body) -> Column:
    """`body` of an expression that is computed once per row, however often it is used."""
    return F.get(F.transform(F.array(expr), body), F.lit(0))


def array_runs(values: str | Column) -> Column:
    """Runs of an array, nulls forming runs of their own."""

    def runs_of(a: Column) -> Column:
        n = F.size(a)
        changes = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)),
        )
        runs = bound(
            F.concat(changes, F.array(n)),
            lambda ends: F.transform(
                F.slice(ends, F.lit(1), F.size(ends) - 1),
                lambda start, k: F.struct(
                    F.get(a, start).alias("value"), (F.get(ends, k + 1) - start).alias("len")
                ),
            ),
        )
        return F.when(n > 0, runs)

    return bound(as_column(values), runs_of)


def total(runs: str | Column, term=lambda r: r["len"], where=None) -> Column:
    """Sum of a term over the runs, as BIGINT."""
    arr = as_column(runs)
    if where is not None:
        arr = F.filter(arr, where)
    return F.aggregate(arr, F.lit(0).cast("long"), lambda acc, r: acc + term(r))


def expand(runs: str | Column, field: str = "value") -> Column:
    """Write the runs out again."""
    return F.flatten(
        F.transform(as_column(runs), lambda r: F.array_repeat(r[field], r["len"].cast("int")))
    )


def support_positions(support: str | Column) -> Column:
    """Positions of a support: each run of jumps is written out from where the one before
    it ended."""

    def place(acc: Column, r: Column) -> Column:
        at, jump = acc["at"], r["jump"].cast("long")
        stop = at + jump * r["len"].cast("long")
        return F.struct(F.concat(acc["all"], F.sequence(at + jump, stop, jump)).alias("all"), stop.alias("at"))

    start = F.struct(F.array().cast("array<bigint>").alias("all"), F.lit(-1).cast("long").alias("at"))
    return F.aggregate(F.filter(as_column(support), lambda r: r["len"] > 0), start, place, lambda acc: acc["all"])


def support_size(support: str | Column) -> Column:
    return total(support)


def support_min(support: str | Column) -> Column:
    return F.get(as_column(support), F.lit(0))["jump"] - 1


def support_max(support: str | Column) -> Column:
    return total(support, lambda r: r["jump"] * r["len"]) - 1


def support_holes(support: str | Column) -> Column:
    return total(support, where=lambda r: r["jump"] > 1)


def dense_row(support: str | Column, frame: str | Column, width: int | Column | None = None) -> Column:
    """Dense array of `width` cells: frame values at the support positions, null elsewhere.

    Without a width the row reaches to its last position. `cut_cells` counts what a given
    width leaves out.
    """
    w = F.lit(width) if isinstance(width, int) else support_max(support) + 1 if width is None else width
    places = F.when(w > 0, F.sequence(F.lit(0).cast("long"), w.cast("long") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    known = as_column(support).isNotNull() & as_column(frame).isNotNull()
    return bound(
        F.map_from_arrays(support_positions(support), expand(frame)),
        lambda cells: F.transform(places, lambda i: F.when(known, F.try_element_at(cells, i))),
    )


def cut_cells(support: str | Column, width: int | Column) -> Column:
    """How many positions of a support lie beyond a row of `width` cells."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.size(F.filter(support_positions(support), lambda at: at >= w))


def is_closed(value: Column, closed: Sequence[str] = CLOSED) -> Column:
    return value.isNull() | value.isin(list(closed))


def divide(runs: str | Column, closed: Sequence[str] = CLOSED) -> Column:
    """Struct (n_closed, n_tracked, n_notrack, core): lengths of a closed first and of an
    empty last run, and what lies between them."""

    def parts(arr: Column) -> Column:
        n = F.size(arr)
        some = arr.isNotNull() & (n > 0)
        first, last = F.get(arr, F.lit(0)), F.get(arr, n - 1)
        cut_first = F.when(is_closed(first["value"], closed), 1).otherwise(0)
        cut_last = F.when(is_closed(last["value"], closed), 1).otherwise(0)
        core = F.slice(arr, cut_first + 1, F.greatest(n - cut_first - cut_last, F.lit(0)))
        none = F.lit(0).cast("long")
        return F.struct(
            F.when(some & (cut_first == 1), first["len"].cast("long")).otherwise(none).alias("n_closed"),
            F.when(some, total(core)).otherwise(none).alias("n_tracked"),
            F.when(some & (cut_last == 1), last["len"].cast("long")).otherwise(none).alias("n_notrack"),
            F.when(some, core).alias("core"),
        )

    return bound(as_column(runs), parts)


def runs_text(runs: str | Column, field: str = "value", missing: str = "-") -> Column:
    """Compact text such as 0*3,C*2."""
    return F.array_join(
        F.transform(
            as_column(runs),
            lambda r: F.concat(F.coalesce(r[field].cast("string"), F.lit(missing)), F.lit("*"), r["len"].cast("string")),
        ),
        ",",
    )
