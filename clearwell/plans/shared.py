"""All metrics of a table from a few passes over it.

Every metric belongs to one of three shapes, and all metrics of a shape share a
scan:

- *wide*: aggregates that need a column's values one at a time (counts, ranges,
  blanks, unsafe characters, complete rows). One buffer a task is shuffled.
- *grouped*: distinct values, their looks and repeated rows. Values are counted
  by value before the shuffle, whole rows as one more column, and each distinct
  value is looked at behind it.
- *classified*: what texts look like. A pass of its own only where it is asked for
  alone: values are classified in long form, and one row of counts a column and
  task is shuffled. Where all passes run, it is summed up from the grouped one.

Exact medians narrow their ranks down by scans of their own, of the numeric
columns only (``operators.quantiles``); sketches take their place in the wide
pass with ``approx``. Tables of more than ``COLUMNS_PER_AGGREGATE`` columns take
a wide scan for each group of so many columns.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import as_list, col, is_numeric, is_text, no_rows, percent, profiled_fields
from ..operators.duplicates import duplicate_totals
from ..operators.frequency import WHOLE_ROW, mixed_types, value_groups
from ..operators.profile import _attach, _column_scan, _nulls, completeness_rows, profile_rows
from ..operators.quantiles import exact_median
from ..operators.validation import content_counts, content_rows, is_aged, tallied_contents, text_rows, validator_fields
from ..runtime import settle
from .findings import Metrics


@dataclass(frozen=True)
class Scans:
    """The passes over ``df``, and its medians; lazy until :meth:`settled`."""

    df: DataFrame
    by: tuple[str, ...]
    full: bool
    approx: bool
    wide: DataFrame
    classified: DataFrame
    grouped: DataFrame
    medians: DataFrame | None

    def settled(self, change: Callable[[DataFrame], DataFrame] = settle) -> Scans:
        """Run the passes side by side and write their results, a few rows for each column and the looks of its values."""
        with ThreadPoolExecutor(2) as pool:
            wide, grouped = pool.map(change, (self.wide, self.grouped))
        done = replace(self, wide=wide, grouped=grouped)
        return replace(done, classified=change(done._contents_of_groups()))

    def _contents_of_groups(self) -> DataFrame:
        """The classified form from the grouped one."""
        names = F.array(*[F.lit(f.name) for f in self.fields])
        place = F.when(F.col("position") > WHOLE_ROW, F.col("position")).otherwise(WHOLE_ROW - 1 - F.col("position"))
        cells = self.grouped.where("content IS NOT NULL").withColumn("column_name", F.element_at(names, place + 1))
        return tallied_contents(cells, validator_fields(self.df, None, self.by), self.by, self.full, "cells")

    @property
    def fields(self):
        return profiled_fields(self.df, None, self.by)

    def names(self, kind) -> list[str]:
        return [f.name for f in self.fields if kind(f)]

    def table(self) -> DataFrame:
        """Rows, null cells, complete rows and duplicate rows."""
        first = self.wide.where("position = 0")
        complete = completeness_rows(first, len(self.fields), self.by)
        keys = [col(b) for b in self.by]
        totals = self.grouped.where(F.col("position") == WHOLE_ROW).groupBy(*keys).agg(
            F.coalesce(F.sum("cells"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("cells") - F.col("distinct_values")), F.lit(0)).alias("duplicate_rows"),
        )
        double = duplicate_totals(totals, self.by).drop("rows")
        if not self.by:
            return complete.crossJoin(F.broadcast(double))  # one row each
        names = {b: f"__b{i}" for i, b in enumerate(self.by)}
        same = reduce(lambda a, b: a & b, [col(b).eqNullSafe(F.col(n)) for b, n in names.items()])
        return complete.join(double.withColumnsRenamed(names), same, "left").drop(*names.values())

    def _grouped_by_name(self) -> DataFrame:
        names = F.array(*[F.lit(f.name) for f in self.fields])
        cells = self.grouped.where(F.col("position") > WHOLE_ROW)
        return cells.withColumn("column_name", F.element_at(names, F.col("position") + 1))

    def columns(self) -> DataFrame:
        """The column profile; without distinct counts and medians where the scans are not full."""
        scan = _nulls(self.wide)
        if not self.full:
            scan = scan.withColumn("unique_count", F.lit(None).cast("bigint")).withColumn("median", F.lit(None).cast("double"))
        elif not self.approx:
            keys = [*[col(b) for b in self.by], F.col("column_name")]
            distinct = self._grouped_by_name().groupBy(*keys).agg(F.sum("distinct_values").alias("unique_count"))
            scan = _attach(scan, distinct, self.by).withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("bigint")))
            if self.medians is None:
                scan = scan.withColumn("median", F.lit(None).cast("double"))
            else:
                scan = _attach(scan, self.medians, self.by)
        return profile_rows(scan, self.by, self.approx)

    def types(self) -> DataFrame:
        cells = self._grouped_by_name().where(F.col("column_name").isin(self.names(is_text)))
        counts = cells.groupBy(*[col(b) for b in self.by], "column_name", "value_type").agg(F.sum("distinct_values").alias("distinct_values"))
        return mixed_types(counts, self.by)

    def contents(self) -> DataFrame:
        return content_rows(self.classified, [f.name for f in self.fields], by=self.by)

    def text(self) -> DataFrame:
        return text_rows(self.classified, self.names(is_text), self.by)

    def numeric(self) -> DataFrame:
        names = self.names(is_numeric)
        if not names:
            return no_rows(self.df, self.by, "column_name string, min double, max double, negative_count bigint, zero_count bigint, is_problematic boolean")
        aged = F.col("column_name").isin([n for n in names if is_aged(n)])
        return self.wide.where(F.col("column_name").isin(names)).select(
            *[col(b) for b in self.by], "column_name", "min", "max", "negative_count", "zero_count",
            ((F.col("negative_count") > 0) & aged).alias("is_problematic"),
        )

    def unsafe(self) -> DataFrame:
        return self.wide.select(
            *[col(b) for b in self.by], "column_name", "unsafe_count", percent("unsafe_count", "rows").alias("unsafe_percent"))

    def metrics(self) -> Metrics:
        more = {"numeric": self.numeric(), "text": self.text(), "unsafe": self.unsafe()} if self.full else {}
        return Metrics(table=self.table(), columns=self.columns(), types=self.types(), contents=self.contents(), by=self.by, **more)


def shared_scans(df: DataFrame, by=(), full: bool = True, approx: bool = False) -> Scans:
    """The passes that all metric tables of ``df`` can be taken from.

    ``full=False`` leaves out what no issue needs: distinct counts, medians,
    signs, unsafe characters and text checks.
    """
    by = tuple(as_list(by))
    fields = profiled_fields(df, None, by)
    if not fields:
        raise ValueError("the table has no column to look at")
    which = {"table", "blanks", "stats"} | ({"signs", "unsafe"} if full else set())
    numeric = [f.name for f in fields if is_numeric(f)]
    return Scans(
        df=df, by=by, full=full, approx=approx and full,
        wide=_column_scan(df, fields, by, which, approx and full),
        classified=content_counts(df, by=by, texts=full),
        grouped=value_groups(df, by, distinct=full and not approx),
        medians=exact_median(df, numeric, by) if numeric and full and not approx else None,
    )
