"""Functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 64  # elements that are added one to another; longer arrays are cut into such runs


def running_totals(numbers: Column) -> Column:
    """For each of an array's integers the total of those before it. An aggregate that appends copies its array for each element; here these
    arrays are a run long, or have an element a run, so that the work grows with the array and not with its square."""

    def totals(values: Column, begin: Column) -> Column:
        add = lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n))
        return F.slice(F.aggregate(values, F.array(begin), add), 1, F.size(values))

    def long(values: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda i: F.slice(values, i * RUN + 1, RUN))
        begins = totals(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, n: a + n)), F.lit(0))
        return F.flatten(F.zip_with(runs, begins, totals))

    return F.when(F.size(numbers) <= RUN, totals(numbers, F.lit(0))).otherwise(long(numbers))
