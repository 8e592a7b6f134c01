"""Column functions over arrays whose work grows with an array's length, not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan_array(
    items: Column, begin: Column, step: Callable[[Column, Column], Column], show: Callable[[Column, Column], Column]
) -> Column:
    """``show(state before, item)`` of every item, the state starting as ``begin`` and going on by ``step``.

    Items are taken in runs of a fixed length: the state at the start of each run is found first, then the runs are
    shown one by one, so no array is copied more often than a run is long.
    """

    def through(run: Column, at: Column) -> Column:
        first = F.struct(step(at, run[0]).alias("at"), F.array(show(at, run[0])).alias("out"))
        on = lambda state, x: F.struct(step(state["at"], x).alias("at"), F.concat(state["out"], F.array(show(state["at"], x))).alias("out"))
        return F.aggregate(F.slice(run, 2, RUN), first, on, lambda state: state["out"])

    def states(runs: Column) -> Column:
        def on(state: Column, run: Column) -> Column:
            after = lambda at: F.struct(at.alias("at"), F.concat(state["all"], F.array(at)).alias("all"))
            return let(F.aggregate(run, state["at"], step), after)

        return F.aggregate(runs, F.struct(begin.alias("at"), F.array(begin).alias("all")), on, lambda state: state["all"])

    def every(held: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(held), F.lit(RUN)), lambda k: F.slice(held, k, RUN))
        return let(runs, lambda runs: let(states(runs), lambda at: F.flatten(F.transform(runs, lambda run, k: through(run, at[k])))))

    # Nothing to show keeps the type of what would be shown.
    return let(items, lambda held: F.when(F.size(held) > 0, every(held)).otherwise(F.transform(held, lambda x: show(begin, x))))
