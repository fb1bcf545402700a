"""Value frequencies, and everything that follows from them.

Counting happens before the shuffle in every task, so a value that fills a third
of the table arrives as one row per task. Where only counts are asked for, long
texts travel as digests; results always hold and order by the values themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import as_list, as_text, col, is_temporal, is_text, long_form, order_key, present, profiled_fields, quoted
from ..functions import trim_space, value_key
from ..functions.text import KEY_BYTES, value_type_of
from .validation import content_marks, validator_fields


#: Characters of a value that are ranked before whole values are read.
PREFIX = 60


def _key(field):
    return value_key(as_text(field))


def value_frequencies(df: DataFrame, columns=None, by=()) -> DataFrame:
    """``by..., column_name, value, cnt``; nulls are no value."""
    by = as_list(by)
    cells = long_form(df, profiled_fields(df, columns, by), by)
    return cells.groupBy(*[col(b) for b in by], "column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _families(fields):
    """Columns that share a type values can be compared in, with that value.

    Counting distinct numbers as numbers is much cheaper than as text. Each
    family reads its own columns, so no column is read twice.
    """
    groups: dict[str, tuple[list, object]] = {}
    for f in fields:
        kind = f.dataType
        if isinstance(kind, T.IntegralType):
            family, value = "whole", lambda g: col(g.name).cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            family, value = "fraction", lambda g: present(g).cast("double") + F.lit(0.0)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            family, value = kind.simpleString(), lambda g: col(g.name)
        else:
            family, value = "text", _key
        groups.setdefault(family, ([], value))[0].append(f)
    return groups.values()


def distinct_counts(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Exact number of distinct non-null values per column."""
    by = as_list(by)
    keys = [*[col(b) for b in by], F.col("column_name")]
    parts = [
        long_form(df, fields, by, value=value).groupBy(*keys, "value").agg(F.lit(1).alias("one"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_count"))
        for fields, value in _families(profiled_fields(df, columns, by))
    ]
    return reduce(DataFrame.unionByName, parts)


#: The column number of whole rows in :func:`value_groups`; further columns that are no text count down from below it.
WHOLE_ROW = -1


def value_groups(df: DataFrame, by=(), distinct: bool = True) -> DataFrame:
    """Distinct values by column and looks, and repeated rows, in one pass and one shuffle.

    ``by..., position, value_type, <content_marks>, distinct_values, cells``: of
    each column how many distinct values look like what (nulls for columns that
    are no text) and how many cells hold them; nulls are no value. The position
    ``WHOLE_ROW`` counts whole rows in the same way, told apart by all their
    values, or the SHA-256 of these where they are long. Values are counted before the shuffle and looked at
    behind it, so that each distinct value is looked at once; texts that travel
    as digests are looked at before. Whole numbers, dates and times travel as 8
    bytes. Without ``distinct`` only text columns and whole rows are counted.

    Columns that are no text, but have the name of one that validators look at,
    have a further position, ``WHOLE_ROW - 1`` less their own, which counts
    their cells by looks alone.
    """
    by = as_list(by)
    fields = profiled_fields(df, None, by)
    looked_at = {f.name for f in validator_fields(df, None, by)}
    entries, texts, others, natives = [], [], [], []

    def entry(position, whole=None, fraction=None, text=None):
        kinds = (("whole", whole, "bigint"), ("fraction", fraction, "double"), ("text", text, "string"))
        return F.struct(F.lit(position).alias("position"), *[(F.lit(None) if v is None else v).cast(t).alias(n) for n, v, t in kinds])

    for i, f in enumerate(fields):
        if is_text(f):
            texts.append(i)
            entries.append(entry(i, text=as_text(f)))
        elif distinct and isinstance(f.dataType, T.IntegralType):
            entries.append(entry(i, whole=col(f.name)))
        elif distinct and isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            entries.append(entry(i, fraction=present(f).cast("double") + F.lit(0.0)))
        elif distinct and isinstance(f.dataType, T.DateType):
            entries.append(entry(i, whole=F.unix_date(col(f.name))))
        elif distinct and isinstance(f.dataType, T.TimestampType):
            entries.append(entry(i, whole=F.unix_micros(col(f.name))))
        elif distinct:
            entries.append(entry(i, text=as_text(f)))
        if f.name in looked_at and not is_text(f):
            others.append(WHOLE_ROW - 1 - i)
            natives += others[-1:] if is_temporal(f) else []
            entries.append(entry(others[-1], text=as_text(f)))
    marked = [F.coalesce(F.concat(F.length(as_text(f)).cast("string"), F.lit(":"), as_text(f)), F.lit("-")) for f in fields]
    entries.append(entry(WHOLE_ROW, text=F.concat(F.lit(""), *marked)))
    cells = df.select(*[col(b).alias(f"__b{i}") for i, b in enumerate(by)], F.inline(F.array(*entries)))
    cells = cells.where("whole IS NOT NULL OR fraction IS NOT NULL OR text IS NOT NULL")
    among = lambda places: F.col("position").isin(places) if places else F.lit(False)
    looks = lambda value: F.struct(
        F.when(~among(others), value_type_of(value, "__v")).alias("value_type"),
        *[m.alias(n) for n, m in content_marks(value, "__v", among(others), among(natives)).items()],
    )
    keys = [*[F.col(f"__b{i}") for i in range(len(by))], F.col("position")]
    early = cells.withColumn("early", among(others) | (among(texts) & (F.octet_length("text") > KEY_BYTES)))
    typed = early.withColumn("__v", F.when(F.col("early") & ~among(natives), trim_space("text"))).select(
        *keys, "whole", "fraction", F.when(~among(others), value_key("text")).alias("key"), F.when(F.col("early"), looks("text")).alias("looks"),
    )
    counted = typed.groupBy(*keys, "whole", "fraction", "key", "looks").agg(F.count(F.lit(1)).alias("cnt"))
    late = among(texts) & F.col("looks").isNull()
    seen = counted.withColumn("__v", F.when(late, trim_space("key"))).withColumn("looks", F.coalesce("looks", F.when(late, looks("key"))))
    return seen.groupBy(*keys, "looks").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("cnt").alias("cells")).select(
        *[F.col(f"__b{i}").alias(b) for i, b in enumerate(by)], "position", "looks.*", "distinct_values", "cells",
    )


def duplicates_per_column(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Rows beyond the first of each value, null being one value; columns with any."""
    by = as_list(by)
    fields = profiled_fields(df, columns, by)
    # Here a null is a value: a marker no key can equal stands for it.
    marker = F.concat(F.lit("null:"), F.repeat(F.lit("0"), F.lit(KEY_BYTES)))
    cells = long_form(df, fields, by, value=lambda f: F.coalesce(_key(f), marker))
    keys = [*[col(b) for b in by], F.col("column_name")]
    return (
        cells.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"))
        .groupBy(*keys).agg((F.sum("cnt") - F.count(F.lit(1))).alias("duplicate_values"))
        .where(F.col("duplicate_values") > 0)
    )


def top_values(df: DataFrame, k: int = 3, columns=None, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent values of each column; ties go to the lower value.

    Values are counted by key and by the first ``PREFIX`` characters, which sort
    as the values do as far as they differ there. Values of one count and prefix
    form a class; the classes that reach the first ``k`` are at most ``k`` a
    column, and no task ranks more than ``k`` of them for each that it read. Only
    texts of these classes are read whole, and where a class has more values
    than are wanted of it, its lowest ones are ranked, again ``k`` a task at most.
    """
    by = as_list(by)
    group = [*by, "column_name"]
    keys = [col(g) for g in group]
    fields = profiled_fields(df, columns, by)
    cells = long_form(df, fields, by).withColumn("value_key", value_key("value"))
    counts = cells.groupBy(*keys, "value_key", F.substring("value", 1, PREFIX).alias("prefix")).agg(F.count(F.lit(1)).alias("cnt"))
    whole = (F.col("value_key") == F.col("prefix")).alias("whole")
    classes = counts.groupBy(*keys, "cnt", "prefix", whole).agg(F.count(F.lit(1)).alias("ties"))
    # A value that is its own prefix comes before the longer ones.
    order = Window.partitionBy(*keys).orderBy(F.desc("cnt"), "prefix", F.desc("whole"))
    near = classes.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)
    before = F.coalesce(F.sum("ties").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("wanted", F.lit(k) - before).where(F.col("wanted") > 0)
    values = near.where("whole").select(*keys, "cnt", F.col("prefix").alias("value"))
    long = [f for f in fields if not _always_short(f)]
    if long:
        classes_ = near.where(~F.col("whole")).select(*[col(g).alias(f"__g{i}") for i, g in enumerate(group)], "prefix", F.col("cnt").alias("__cnt"), "wanted")
        here = reduce(lambda a, b: a & b, [col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)], F.substring("value", 1, PREFIX) == F.col("prefix"))
        texts = long_form(df, long, by).where((F.length("value") > PREFIX) | (F.octet_length("value") > KEY_BYTES))
        found = texts.join(classes_, here).groupBy(*keys, "prefix", "__cnt", "wanted", "value").agg(F.count(F.lit(1)).alias("cnt"))
        lowest = Window.partitionBy(*keys, "prefix", "__cnt").orderBy("value")
        found = found.where(F.col("cnt") == F.col("__cnt")).withColumn("__rank", F.row_number().over(lowest)).where(F.col("__rank") <= k)
        values = values.unionByName(found.where(F.col("__rank") <= F.col("wanted")).select(*keys, "cnt", "value"))
    last = Window.partitionBy(*keys).orderBy(F.desc("cnt"), "value")
    return values.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(*keys, "rank", "value", "cnt")


def _always_short(field) -> bool:
    return isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def type_counts(df: DataFrame, columns=None, by=(), max_distinct: int | None = None, row_key=None) -> DataFrame:
    """How many distinct values of each text column look like which type.

    ``max_distinct`` looks only at the values seen first in ``row_key`` order.
    """
    by = as_list(by)
    group = [*by, "column_name"]
    fields = [f for f in profiled_fields(df, columns, by) if is_text(f)]
    # The type is found before the shuffle; it depends on the value alone.
    keys = as_list(row_key)
    cells = long_form(df, fields, by, keys if max_distinct is not None else ())
    typed = (
        cells.withColumn("__v", trim_space("value"))
        .withColumn("value_type", value_type_of("value", "__v"))
        .withColumn("value_key", value_key("value"))
    )
    groups = [*[col(g) for g in group], F.col("value_key"), F.col("value_type")]
    if max_distinct is None:
        distinct = typed.select(*groups).distinct()
    else:
        first = typed.groupBy(*groups).agg(F.min(order_key(keys)).alias("__first"))
        window = Window.partitionBy(*[col(g) for g in group]).orderBy("__first")
        distinct = first.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= max_distinct)
    return distinct.groupBy(*[col(g) for g in group], "value_type").agg(
        F.count(F.lit(1)).alias("distinct_values")
    )


def mixed_types(counts: DataFrame, by=()) -> DataFrame:
    """Columns whose values have more than one type, from :func:`type_counts`."""
    by = as_list(by)
    return (
        counts.groupBy(*[col(b) for b in by], "column_name")
        .agg(
            F.count(F.lit(1)).alias("types"),
            # At most one entry per value type: eight.
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("value_type", "distinct_values"))),
                    lambda x: F.concat(x["value_type"], F.lit("="), x["distinct_values"].cast("string")),
                ), ", ",
            ).alias("detected_types"),
        )
        .where(F.col("types") > 1)
        .withColumn("is_problematic", F.col("types") > 2)
    )
