"""Duplicate rows and duplicate columns.

Groups of equal rows are counted before the shuffle, so a row repeated over a
third of the table costs no more than any other. Nulls equal nulls, NaN equals
NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import as_list, as_text, col, order_key, percent, present, profiled_fields
from ..functions import value_key


def _row_key_columns(fields):
    """Per column something groupable, bounded in width and exact."""
    keys = []
    for f in fields:
        if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            keys.append(present(f))
        else:
            keys.append(value_key(as_text(f)))
    return keys


def duplicate_rows(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Rows beyond the first of each group of identical rows, and their percent."""
    by = as_list(by)
    fields = profiled_fields(df, columns, by)
    keys = [k.alias(f"__k{i}") for i, k in enumerate(_row_key_columns(fields))]
    groups = (
        df.select(*[col(b) for b in by], *keys)
        .groupBy(*[col(b) for b in by], *[f"__k{i}" for i in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    totals = groups.groupBy(*[col(b) for b in by]).agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    return duplicate_totals(totals, by)


def duplicate_totals(totals: DataFrame, by) -> DataFrame:
    """``rows, duplicate_rows`` with their percent."""
    return totals.select(
        *[col(b) for b in by], "rows", "duplicate_rows",
        percent("duplicate_rows", "rows").alias("duplicate_percent"),
    )


def duplicate_examples(df: DataFrame, row_key, columns=None, k: int = 5) -> DataFrame:
    """The first ``k`` rows, by ``row_key``, that occur more than once.

    The first k such rows all belong to the k repeated groups that start
    earliest, so only those k groups are matched against the table again.
    """
    order = as_list(row_key)
    fields = profiled_fields(df, columns, () if columns is not None else order)
    names = [f"__k{i}" for i in range(len(fields))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(_row_key_columns(fields), names)])
    first = order_key(order)
    earliest = (
        keyed.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("__cnt"), F.min(first).alias("__first"))
        .where(F.col("__cnt") > 1)
        .orderBy("__first").limit(k)
        .select(*[F.col(n).alias(f"{n}_w") for n in names])
    )
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_w")) for n in names])
    return (
        keyed.join(F.broadcast(earliest), same, "left_semi")
        .orderBy(*[col(o) for o in order]).limit(k)
        .select(*[col(c) for c in df.columns])
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row of each group of identical rows."""
    return df.distinct()


def keep_first(df: DataFrame, row_key, columns=None) -> DataFrame:
    """The first row, by ``row_key``, of each group of rows equal in ``columns``.

    When the rows are equal in every column but the key, the group itself is the
    row and one aggregation is enough. Otherwise the first key of each group
    picks the row; the aggregation keeps one candidate per group and task.
    """
    order = as_list(row_key)
    rest = [c for c in df.columns if c not in order]
    keys = as_list(columns) or rest
    first = F.min(order_key(order)).alias("__first")
    if set(keys) >= set(rest):
        # A key column named on purpose stays part of the equality.
        grouped = df.groupBy(*[col(c) for c in keys]).agg(first)
        kept = F.col("__first")
        return grouped.select(
            *[col(c) if c in keys else (kept if len(order) == 1 else kept[c]).alias(c) for c in df.columns]
        )
    whole = F.min_by(F.struct(*[col(c) for c in df.columns]), order_key(order))
    return df.groupBy(*[col(c).alias(f"__k{i}") for i, c in enumerate(keys)]).agg(
        whole.alias("__row")
    ).select("__row.*")


def keep_min_id(df: DataFrame, id_column: str, columns=None) -> DataFrame:
    """Rows whose id is the smallest id of some group: the semi-join form."""
    keys = as_list(columns) or [c for c in df.columns if c != id_column]
    keyed = df.select(*[c.alias(f"__k{i}") for i, c in enumerate(_row_key_columns(profiled_fields(df, keys)))],
                      col(id_column).alias("__id"))
    kept = keyed.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min("__id").alias("__id")).select("__id")
    return df.join(kept, col(id_column) == F.col("__id"), "left_semi")


def duplicate_columns(df: DataFrame, columns=None) -> DataFrame:
    """Columns of one type that hold equal values in every row: ``column_a`` is the first of its class, ``column_b`` another.

    One aggregate takes a fingerprint per column; it can only rule columns out.
    A second one compares each column left with the first of its class, so w
    equal columns cost w - 1 comparisons. Columns that only share the
    fingerprint of their class are compared among themselves in a further one.
    """
    fields = profiled_fields(df, columns)
    prints = df.agg(*[
        F.struct(
            F.count(present(f)).alias("n"),
            F.bit_xor(F.xxhash64(as_text(f))).alias("x"),
            F.sum(F.xxhash64(as_text(f)).cast("decimal(28,0)")).alias("s"),
        ).alias(f"__f{i}")
        for i, f in enumerate(fields)
    ]).first()
    classes: dict[tuple, list[int]] = {}
    for i, f in enumerate(fields):
        classes.setdefault((f.dataType, prints[i]), []).append(i)
    open_, found = [c for c in classes.values() if len(c) > 1], []

    def same(f, g):
        a, b = present(f), present(g)
        return as_text(f).eqNullSafe(as_text(g)) if isinstance(f.dataType, T.MapType) else a.eqNullSafe(b)

    while open_:
        pairs = [(c[0], i) for c in open_ for i in c[1:]]
        equal = df.agg(*[F.coalesce(F.bool_and(same(fields[i], fields[j])), F.lit(True)) for i, j in pairs]).first()
        alike = {j for (_, j), ok in zip(pairs, equal) if ok}
        found += [(i, j) for i, j in pairs if j in alike]
        rest = [[i for i in c[1:] if i not in alike] for c in open_]
        open_ = [c for c in rest if len(c) > 1]
    # One row per column of the schema at most.
    return df.sparkSession.createDataFrame([(fields[i].name, fields[j].name) for i, j in found], "column_a string, column_b string")
