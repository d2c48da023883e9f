"""Ordered passes over long groups, cut into slices.

A window over a whole track puts the track in one task. `Ordered` cuts each group into slices of
the order column, runs the window inside a slice, aggregates one summary row per slice (map-side
combined), carries the summaries forward along the group and joins the carry back on
(keys, slice). The answer equals the plain window; a hot group is spread over its slices, and only
its slice summaries meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICE = "_slice"


class Ordered:
    """Window functions over `keys` ordered by an integer column (+ ties), evaluated by slice.

    All rows must be distinct on (keys, order, ties) for a defined answer, and the order column
    must not be null.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: str, width: int, ties=(), descending=False):
        self.keys = list(keys)
        self.base = df.withColumn(_SLICE, F.floor(F.col(order) / F.lit(width)).cast("long"))
        self.descending = descending
        names = [order, *ties]
        self.order = [F.col(c).desc() if descending else F.col(c).asc() for c in names]
        self.rank = F.struct(*[F.col(c) for c in names])
        self.summary: list[Column] = []
        self.carry: list[Column] = []
        self.output: dict[str, Column] = {}
        self.local = Window.partitionBy(*self.keys, _SLICE).orderBy(*self.order)
        slice_order = F.col(_SLICE).desc() if descending else F.col(_SLICE).asc()
        self.along = Window.partitionBy(*self.keys).orderBy(slice_order)
        self.before = self.along.rowsBetween(Window.unboundedPreceding, -1)

    def _first(self, value: Column) -> Column:
        return F.max_by(value, self.rank) if self.descending else F.min_by(value, self.rank)

    def _last(self, value: Column) -> Column:
        return F.min_by(value, self.rank) if self.descending else F.max_by(value, self.rank)

    def _add(self, name: str, summary: Column, carried) -> Column:
        s, c = f"_s_{name}", f"_c_{name}"
        self.summary.append(summary.alias(s))
        self.carry.append(carried(F.col(s)).alias(c))
        return F.col(c)

    def row_number(self, name: str) -> "Ordered":
        carried = self._add(name, F.count(F.lit(1)), lambda s: F.sum(s).over(self.before))
        self.output[name] = F.row_number().over(self.local) + F.coalesce(carried, F.lit(0))
        return self

    def running_sum(self, name: str, value) -> "Ordered":
        value = _col(value)
        carried = self._add(name, F.sum(value), lambda s: F.sum(s).over(self.before))
        inside = F.sum(value).over(self.local.rowsBetween(Window.unboundedPreceding, 0))
        self.output[name] = F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return self

    def running_max(self, name: str, value, inclusive: bool = True) -> "Ordered":
        value = _col(value)
        carried = self._add(name, F.max(value), lambda s: F.max(s).over(self.before))
        stop = 0 if inclusive else -1
        inside = F.max(value).over(self.local.rowsBetween(Window.unboundedPreceding, stop))
        self.output[name] = F.greatest(inside, carried)
        return self

    def last_value(self, name: str, value) -> "Ordered":
        """Latest non-null value at or before the row."""
        value = _col(value)
        kept = F.when(value.isNotNull(), self.rank)
        by = F.min_by if self.descending else F.max_by
        carried = self._add(name, by(value, kept), lambda s: F.last(s, True).over(self.before))
        inside = F.last(value, True).over(self.local.rowsBetween(Window.unboundedPreceding, 0))
        self.output[name] = F.coalesce(inside, carried)
        return self

    def next_value(self, name: str, value) -> "Ordered":
        """Earliest non-null value at or after the row."""
        value = _col(value)
        kept = F.when(value.isNotNull(), self.rank)
        by = F.max_by if self.descending else F.min_by
        after = self.along.rowsBetween(1, Window.unboundedFollowing)
        carried = self._add(name, by(value, kept), lambda s: F.first(s, True).over(after))
        inside = F.first(value, True).over(self.local.rowsBetween(0, Window.unboundedFollowing))
        self.output[name] = F.coalesce(inside, carried)
        return self

    def lag(self, name: str, value) -> "Ordered":
        value = _col(value)
        carried = self._add(name, self._last(F.struct(value.alias("v"))), lambda s: F.lag(s).over(self.along))
        self.output[name] = F.when(
            F.row_number().over(self.local) > 1, F.lag(value).over(self.local)
        ).otherwise(carried["v"])
        return self

    def lead(self, name: str, value) -> "Ordered":
        value = _col(value)
        carried = self._add(name, self._first(F.struct(value.alias("v"))), lambda s: F.lead(s).over(self.along))
        self.output[name] = F.coalesce(
            F.lead(F.struct(value.alias("v"))).over(self.local), carried
        )["v"]
        return self

    def result(self) -> DataFrame:
        summary = self.base.groupBy(*self.keys, _SLICE).agg(*self.summary)
        carried = summary.select(*self.keys, _SLICE, *self.carry)
        joined = self.base.join(carried, [*self.keys, _SLICE])
        kept = [c for c in self.base.columns if c != _SLICE]
        return joined.select(*kept, *[expr.alias(name) for name, expr in self.output.items()])


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
