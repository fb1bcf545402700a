"""What type a column should have once it is cleaned.

Names and physical types decide first, while the plan is built. Only the text
columns left are read, all of them in one aggregate over every value.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S
from ..columns import as_list, as_text, col, is_fractional, is_numeric, is_text, long_form, order_key, profiled_fields
from ..functions import name_hint, normalize_boolean, normalize_number, parse_date, trim_space
from ..functions.dates import has_time_part
from ..functions.names import is_identifier_name

INTEGER, FLOAT, DATE, DATETIME = "Integer", "Float", "Date", "DateTime"
BOOLEAN, EMAIL, PHONE, URL, TEXT = "Boolean", "Email", "Phone", "URL", "Text"

_HINTED = {"Email": EMAIL, "URL": URL, "Teléfono": PHONE}

# Shares of the values that decide.
NUMBER_SHARE, BOOLEAN_SHARE, DATE_SHARE = 0.50, 0.90, 0.90


@dataclass(frozen=True)
class ColumnType:
    name: str
    semantic: str
    precision: int | None = None
    scale: int | None = None


def type_by_name(field: T.StructField) -> str | None:
    """Semantic type from name and physical type alone, None when values must tell."""
    hint = name_hint(field.name)
    if hint in _HINTED and is_text(field):
        return _HINTED[hint]
    if is_identifier_name(field.name):
        return TEXT
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if is_numeric(field):
        return FLOAT
    if isinstance(field.dataType, T.BooleanType):
        return BOOLEAN
    if isinstance(field.dataType, T.DateType):
        return DATE
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return None if is_text(field) else TEXT


def _date_named(field: T.StructField) -> bool:
    return any(word in field.name.lower() for word in S.SEMANTIC_DATE_KEYWORDS)


def _digits(number: Column) -> tuple[Column, Column]:
    """Integer and decimal digits of canonical decimal text, zeros at the edges dropped."""
    plain = F.regexp_replace(number, r"^-?0*", "")
    whole = F.length(F.substring_index(plain, ".", 1))
    fraction = F.when(number.contains("."), F.length(F.regexp_replace(F.regexp_extract(number, r"\.([0-9]*)$", 1), "0+$", "")))
    return F.greatest(whole, F.lit(1)), F.coalesce(fraction, F.lit(0))


def _precision(max_whole: Column, max_fraction: Column) -> tuple[Column, Column]:
    """Digits that hold every value; where 38 are too few, whole digits go first."""
    wanted = F.greatest(max_fraction, F.lit(2))
    precision = F.least(F.greatest(max_whole + wanted, F.lit(10)), F.lit(38))
    return precision.cast("int"), F.least(wanted, F.greatest(38 - max_whole, F.lit(0))).cast("int")


def fraction_digits(number: Column) -> Column:
    """Decimal digits of canonical decimal text, zeros at the end not counted."""
    return _digits(number)[1]


def _number_text(f: T.StructField) -> Column:
    if is_fractional(f):
        return col(f.name).cast("string").try_cast("decimal(38,18)").cast("string")
    return normalize_number(as_text(f))


def decimal_types(df: DataFrame, columns=None, by=()) -> DataFrame:
    """``column_name, precision, scale`` that hold every number of the columns."""
    by = as_list(by)
    fields = [f for f in profiled_fields(df, columns, by) if columns is not None or is_numeric(f)]
    cells = long_form(df, fields, by, value=_number_text)
    whole, fraction = _digits(F.col("value"))
    precision, scale = _precision(F.col("w"), F.col("f"))
    keys = [*[col(b) for b in by], F.col("column_name")]
    return cells.groupBy(*keys).agg(F.max(whole).alias("w"), F.max(fraction).alias("f")).select(
        *keys, precision.alias("precision"), scale.alias("scale")
    )


def value_shares(df: DataFrame, columns=None, sample: int | None = None, row_key=None) -> DataFrame:
    """Per text column: how many non-blank values read as number, boolean and date."""
    fields = [f for f in profiled_fields(df, columns) if is_text(f)]
    keys = as_list(row_key) if sample is not None else []
    cells = long_form(df, fields, (), keys).withColumn("value", trim_space("value")).where(F.length("value") > 0)
    if sample is not None:
        window = Window.partitionBy("column_name").orderBy(order_key(keys))
        cells = cells.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= sample)
    read = cells.select(
        "column_name", normalize_number("value").alias("number"), normalize_boolean("value").alias("flag"),
        parse_date("value").alias("day"), F.coalesce(has_time_part("value"), F.lit(False)).alias("timed"),
    )
    whole, fraction = _digits(F.col("number"))
    exact = F.col("number").rlike(r"^-?[0-9]+\.?0*$")
    return read.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("total_values"),
        F.count("number").alias("numbers"),
        F.count_if(exact).alias("whole_numbers"),
        F.count("flag").alias("booleans"),
        F.count("day").alias("dates"),
        F.count_if("timed").alias("timed"),
        F.max(whole).alias("max_whole"),
        F.max(fraction).alias("max_fraction"),
    )


def _decide(field_by_name: dict[str, T.StructField]) -> Column:
    """Semantic type from the shares of :func:`value_shares`."""
    total = F.col("total_values")
    dated = F.when(F.col("timed") > 0, DATETIME).otherwise(DATE)
    by_name = [n for n, f in field_by_name.items() if _date_named(f)]
    return (
        F.when(F.col("column_name").isin(by_name), dated)
        .when(F.col("numbers") >= total * NUMBER_SHARE,
              F.when(F.col("whole_numbers") == F.col("numbers"), INTEGER).otherwise(FLOAT))
        .when(F.col("booleans") >= total * BOOLEAN_SHARE, BOOLEAN)
        .when(F.col("dates") >= total * DATE_SHARE, dated)
        .otherwise(TEXT)
    )


def semantic_types(df: DataFrame, columns=None, sample: int | None = None, row_key=None) -> DataFrame:
    """``column_name, semantic_type, precision, scale``, one row per column."""
    spark = df.sparkSession
    fields = profiled_fields(df, columns)
    known = [(f.name, type_by_name(f)) for f in fields]
    schema = "column_name string, semantic_type string, precision int, scale int"
    decided = spark.createDataFrame([(n, t, None, None) for n, t in known if t], schema)
    open_fields = {f.name: f for f in fields if type_by_name(f) is None}
    if not open_fields:
        return decided
    shares = value_shares(df, list(open_fields), sample, row_key)
    names = F.broadcast(spark.createDataFrame([(n,) for n in open_fields], "__c string"))
    precision, scale = _precision(F.col("max_whole"), F.col("max_fraction"))
    found = names.join(shares, F.col("__c") == F.col("column_name"), "left").select(
        F.col("__c").alias("column_name"),
        F.when(
            F.col("total_values").isNull(),
            # A column without values: its name is all there is.
            F.when(F.col("__c").isin([n for n, f in open_fields.items() if _date_named(f)]), DATE).otherwise(TEXT),
        ).otherwise(_decide(open_fields)).alias("semantic_type"),
        precision.alias("p"), scale.alias("s"),
    )
    is_float = F.col("semantic_type") == FLOAT
    return decided.unionByName(found.select(
        "column_name", "semantic_type", F.when(is_float, F.col("p")).alias("precision"), F.when(is_float, F.col("s")).alias("scale"),
    ))


def column_types(df: DataFrame, overrides: dict[str, str] | None = None, sample=None, row_key=None) -> list[ColumnType]:
    """The semantic types on the driver: one small row per column of the schema."""
    overrides = overrides or {}
    unknown = set(overrides) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    rest = [c for c in df.columns if c not in overrides]
    found = {r["column_name"]: r for r in semantic_types(df, rest, sample, row_key).collect()} if rest else {}
    floats = [c for c, t in overrides.items() if t == FLOAT]
    sized = {r["column_name"]: r for r in decimal_types(df, floats).collect()} if floats else {}
    out = []
    for name in df.columns:
        if name in found:
            r = found[name]
            out.append(ColumnType(name, r["semantic_type"], r["precision"], r["scale"]))
        else:
            r = sized.get(name)
            out.append(ColumnType(name, overrides[name], r and r["precision"], r and r["scale"]))
    return out


# Formats counted to find the dominant one.
DOMINANT_CANDIDATES = ["%Y-%m-%d", "%d/%m/%Y", "%d-%b-%y", "%d-%b-%Y"]
_SHAPES = [r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
           r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2}$", r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$"]


def dominant_date_format(df: DataFrame, columns, by=()) -> DataFrame:
    """The candidate format most values of each column can be read in."""
    by = as_list(by)
    cells = long_form(df, profiled_fields(df, columns, by), by).withColumn("value", trim_space("value")).where(F.length("value") > 0)
    day_first = F.regexp_replace("value", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$2-$1")
    reads = [
        F.col("value").rlike(_SHAPES[0]) & F.col("value").try_cast("date").isNotNull(),
        F.col("value").rlike(_SHAPES[1]) & day_first.try_cast("date").isNotNull(),
        F.col("value").rlike(_SHAPES[2]) & parse_date("value").isNotNull(),
        F.col("value").rlike(_SHAPES[3]) & parse_date("value").isNotNull(),
    ]
    keys = [*[col(b) for b in by], F.col("column_name")]
    counts = cells.groupBy(*keys).agg(*[F.count_if(r).alias(f"c{i}") for i, r in enumerate(reads)])
    best = F.greatest(*[F.col(f"c{i}") for i in range(len(reads))])
    label = reduce(
        lambda chain, i: F.when(F.col(f"c{i}") == best, DOMINANT_CANDIDATES[i]).otherwise(chain),
        reversed(range(len(reads))), F.lit(None).cast("string"),
    )
    return counts.select(*keys, label.alias("date_format"), best.alias("parsed_values"))
