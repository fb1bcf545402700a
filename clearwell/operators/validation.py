"""Is what a column holds what its name or content says it should hold?

Four validators (e-mail, phone, URL, date) share one pass: every text value is
classified once before the shuffle, and the shuffle carries one small row of
counts per column and task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..columns import (
    as_list, as_text, col, is_numeric, is_temporal, is_text, long_form, no_rows, order_key, percent,
    present, profiled_fields, sql_text,
)
from ..functions import (
    date_format_label, has_edge_spaces, has_special_chars, has_sql_unsafe_chars, is_ambiguous_date, is_email, is_phone, is_url,
    parse_date, trim_space,
)
from ..functions.text import content_type_of

PRIORITY = ("email", "phone", "url", "date", "numeric")
CONTENT_TYPES = (*PRIORITY, "other")
VALIDATORS = ("email", "phone", "url", "date")
_FORMATS = [*S.DATE_FORMATS, S.OTHER_DATE_FORMAT]


def named_like(name: str, validator: str) -> bool:
    low = name.lower()
    return any(word in low for word in S.VALIDATOR_KEYWORDS[validator])


def _first_values(cells: DataFrame, group: list[str], keys: list[str], sample: int) -> DataFrame:
    """The first ``sample`` values per column; each task keeps its own first ones."""
    window = Window.partitionBy(*[col(g) for g in group]).orderBy(order_key(keys))
    return cells.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= sample).drop("__n")


def _winner(total: str) -> Column:
    """The content type that reaches the share; only one can."""
    tests = " ".join(f"WHEN n_{t} >= {S.CONTENT_SHARE} * {total} THEN '{t}'" for t in CONTENT_TYPES)
    return F.expr(f"CASE WHEN {total} = 0 THEN NULL {tests} END")


def _content_counts() -> list[Column]:
    return [F.expr(f"count_if(content = '{t}') AS n_{t}") for t in CONTENT_TYPES]


def detect_content_types(df: DataFrame, columns=None, by=(), sample: int | None = None, row_key=None,
                         priority=PRIORITY, scope: str = "text") -> DataFrame:
    """Counts of each content type per column and the type that wins, if any.

    All values are looked at; ``sample`` with a ``row_key`` looks at the first
    ones only. ``scope="all"`` classifies columns of any type by their text.
    """
    by = as_list(by)
    group = [*by, "column_name"]
    fields = [f for f in profiled_fields(df, columns, by) if scope == "all" or is_text(f)]
    keys = as_list(row_key) if sample is not None else []
    cells = long_form(df, fields, by, keys)
    if sample is not None:
        cells = _first_values(cells, group, keys, sample)
    trimmed = cells.select(*[col(g) for g in group], trim_space("value").alias("__v"))
    typed = trimmed.withColumn("content", content_type_of("__v", priority))
    counts = typed.groupBy(*[col(g) for g in group]).agg(
        F.count(F.lit(1)).alias("total_values"),
        *_content_counts(),
    )
    return counts.withColumn("content_type", _winner("total_values"))


def content_marks(value: str, trimmed: str, other: Column | None = None, native: Column | None = None) -> dict[str, Column]:
    """What is counted of a value, given its trimmed text: content type, ambiguity, date format and what :func:`validate_text` looks for.

    ``other``: whether it comes from a column that is no text; ``native``: from one of dates, where ``trimmed`` may be null.
    """
    content, label = content_type_of(trimmed), date_format_label(trimmed)
    if other is not None:
        content = F.when(other, "other").otherwise(content)
    if native is not None:
        written = F.when(F.length(value) == 10, S.DATE_FORMATS[0]).otherwise(S.OTHER_DATE_FORMAT)
        label = F.when(native, written).otherwise(label)
    return {
        "content": content, "ambiguous": F.coalesce(is_ambiguous_date(trimmed), F.lit(False)), "format": label,
        "special": has_special_chars(value), "edge": has_edge_spaces(value), "long": F.length(value) > S.LONG_TEXT,
    }


def _classified(df: DataFrame, fields, by, keys) -> DataFrame:
    """Long form with, per value, its :func:`content_marks`.

    Values of columns that are no text fail the text validators, as they did not
    come from a text; date and timestamp columns hold dates by definition.
    """
    cells = long_form(df, fields, by, keys)
    name = F.col("column_name")
    not_text = [f.name for f in fields if not is_text(f)]
    temporal = [f.name for f in fields if is_temporal(f)]
    native = name.isin(temporal) if temporal else None
    # Nothing has to be read where the type already says what the value is.
    text = F.when(~native, trim_space("value")) if temporal else trim_space("value")
    marks = content_marks("value", "__v", name.isin(not_text) if not_text else None, native)
    return cells.withColumn("__v", text).withColumns(marks).drop("__v")


def validator_fields(df, columns, by):
    return [
        f for f in profiled_fields(df, columns, by)
        if is_text(f) or any(named_like(f.name, v) for v in VALIDATORS)
    ]


def _text_counts() -> list[Column]:
    return [
        F.count_if(has_special_chars("value")).alias("special_chars_count"),
        F.count_if(has_edge_spaces("value")).alias("edge_spaces_count"),
        F.count_if(F.length("value") > S.LONG_TEXT).alias("long_values_count"),
    ]


def content_counts(df: DataFrame, columns=None, by=(), texts: bool = False) -> DataFrame:
    """Per column what its values look like; with ``texts`` also what :func:`validate_text` counts, in the same pass."""
    by = as_list(by)
    fields = validator_fields(df, columns, by)
    return tallied_contents(_classified(df, fields, by, ()), fields, by, texts)


def tallied_contents(marked: DataFrame, fields, by=(), texts: bool = False, cells: str = "1") -> DataFrame:
    """:func:`content_counts` from rows of ``by..., column_name`` and :func:`content_marks`, each of which stands for ``cells`` values."""
    count = lambda test, name: F.expr(f"sum(IF({test}, CAST({cells} AS BIGINT), 0L)) AS {name}")
    counts = marked.groupBy(*[col(g) for g in [*as_list(by), "column_name"]]).agg(
        count("true", "total"),
        *[count(f"content = '{t}'", f"n_{t}") for t in CONTENT_TYPES],
        count("format IS NOT NULL", "n_dates"),
        count("ambiguous", "n_ambiguous"),
        *[count(f"format = '{f}'", f"f_{i}") for i, f in enumerate(_FORMATS)],
        *([count("special", "special_chars_count"), count("edge", "edge_spaces_count"), count("long", "long_values_count")] if texts else []),
    )
    not_text = [f.name for f in fields if not is_text(f)]
    winner = _winner("total")
    if not_text:
        winner = F.when(~F.col("column_name").isin(not_text), winner)
    return counts.withColumn("content_type", winner)


def validate_contents(df: DataFrame, validators=VALIDATORS, columns=None, by=()) -> DataFrame:
    """One row per validator and column it applies to, by name or by content.

    Date rows also carry the number of formats in use, the commonest one, its
    share of the valid dates and the number of ambiguous dates.
    """
    by = as_list(by)
    names = [f.name for f in profiled_fields(df, columns, by)]
    return content_rows(content_counts(df, columns, by), names, validators, by)


def content_rows(counts: DataFrame, names: list[str], validators=VALIDATORS, by=()) -> DataFrame:
    """The rows of :func:`validate_contents` for the columns ``names``, from their counts."""
    marks = [f"f_{i}" for i in range(len(_FORMATS))]
    counts = counts.selectExpr(
        "*", f"greatest({', '.join(marks)}) AS best",
        " + ".join(f"CAST({m} > 0 AS INT)" for m in marks) + " AS in_use",
    ).selectExpr(
        "*", "CASE " + " ".join(f"WHEN best > 0 AND {m} = best THEN '{f}'" for m, f in zip(marks, _FORMATS)) + " END AS commonest",
        "try_divide(best, n_dates) AS consistency",
    )
    rows = []
    for v in as_list(validators):
        is_date = v == "date"
        valid = "n_dates" if is_date else f"n_{v}"
        invalid = f"(total - {valid})"
        problem = f"{invalid} > 0"
        if is_date:
            problem += f" OR coalesce(consistency < {S.DATE_CONSISTENCY}, false) OR n_ambiguous > 0"
        named = [n for n in names if named_like(n, v)]
        by_name = f"column_name IN ({', '.join(sql_text(n) for n in named)})" if named else "false"
        by_content = f"coalesce(content_type = '{v}', false)"
        shown = (lambda e, t: e) if is_date else (lambda e, t: f"CAST(NULL AS {t})")
        rows.append(
            f"named_struct('validator', '{v}', 'valid_count', {valid}, 'invalid_count', {invalid}, "
            f"'invalid_percent', coalesce(try_divide({invalid} * 100D, total), 0D), 'is_problematic', {problem}, "
            f"'detected_by_content', {by_content}, 'formats', {shown('in_use', 'INT')}, "
            f"'most_common_format', {shown('commonest', 'STRING')}, 'format_consistency', {shown('consistency', 'DOUBLE')}, "
            f"'ambiguous_count', {shown('n_ambiguous', 'BIGINT')}, 'applies', {by_content} OR {by_name})"
        )
    found = counts.select(*[col(b) for b in by], "column_name", F.expr(f"inline(array({', '.join(rows)}))"))
    return found.where("applies").drop("applies").select(
        *[col(b) for b in by], "validator", "column_name", "valid_count", "invalid_count", "invalid_percent",
        "is_problematic", "detected_by_content", "formats", "most_common_format", "format_consistency",
        "ambiguous_count",
    )


def _validate_one(name):
    def run(df: DataFrame, columns=None, by=()) -> DataFrame:
        out = validate_contents(df, (name,), columns, by)
        return out.drop("formats", "most_common_format", "format_consistency", "ambiguous_count")
    run.__name__ = f"validate_{name}"
    run.__doc__ = f"Valid and invalid counts of the {name} columns, found by name or content."
    return run


validate_email = _validate_one("email")
validate_phone = _validate_one("phone")
validate_url = _validate_one("url")


def validate_date(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Valid and invalid counts, formats, consistency and ambiguity of date columns."""
    return validate_contents(df, ("date",), columns, by)


def _date_cells(df: DataFrame, columns, by, keys) -> DataFrame:
    named = [f for f in profiled_fields(df, columns, by) if columns is not None or named_like(f.name, "date")]
    return _classified(df, named, by, keys)


def date_formats(df: DataFrame, columns=None, by=()) -> DataFrame:
    """How many values of each date column are written in which format."""
    by = as_list(by)
    return (
        _date_cells(df, columns, by, ())
        .groupBy(*[col(b) for b in by], "column_name", "format").agg(F.count("format").alias("cnt"))
        .where(F.col("cnt") > 0)
    )


def ambiguous_dates(df: DataFrame, row_key, columns=None) -> DataFrame:
    """Every date that could be read day first or month first, with its row."""
    keys = as_list(row_key)
    return _date_cells(df, columns, (), keys).where("ambiguous").select(
        *[col(k) for k in keys], "column_name", "value"
    )


def invalid_examples(df: DataFrame, validator: str, row_key, columns, k: int = 5) -> DataFrame:
    """The first ``k`` invalid values per column, shown up to 50 characters."""
    tests = {
        "email": is_email, "phone": is_phone, "url": is_url,
        "date": lambda v: parse_date(v).isNotNull(),
        "special_chars": lambda v: ~has_special_chars(v),
    }
    keys = as_list(row_key)
    cells = long_form(df, profiled_fields(df, columns), (), keys)
    bad = cells.where(~tests[validator](F.col("value")))
    window = Window.partitionBy("column_name").orderBy(order_key(keys))
    return (
        bad.withColumn("n", F.row_number().over(window)).where(F.col("n") <= k)
        .select("column_name", "n", *[col(c) for c in keys], F.substring("value", 1, 50).alias("value"))
    )


def validate_numeric(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Range, negative and zero counts of numeric columns.

    Negative values are a problem where the name says age.
    """
    by = as_list(by)
    fields = [f for f in profiled_fields(df, columns, by) if is_numeric(f)]
    aggs, rows = [], []
    for i, f in enumerate(fields):
        v = present(f).cast("double")
        aggs += [F.min(v).alias(f"__min{i}"), F.max(v).alias(f"__max{i}"),
                 F.count_if(v < 0).alias(f"__neg{i}"), F.count_if(v == 0).alias(f"__zero{i}")]
        aged = is_aged(f.name)
        rows.append(F.struct(
            F.lit(f.name).alias("column_name"), F.col(f"__min{i}").alias("min"), F.col(f"__max{i}").alias("max"),
            F.col(f"__neg{i}").alias("negative_count"), F.col(f"__zero{i}").alias("zero_count"),
            ((F.col(f"__neg{i}") > 0) & F.lit(aged)).alias("is_problematic"),
        ))
    if not fields:
        return no_rows(df, by, (
            "column_name string, min double, max double, negative_count bigint, zero_count bigint, "
            "is_problematic boolean"))
    return df.groupBy(*[col(b) for b in by]).agg(*aggs).select(*[col(b) for b in by], F.inline(F.array(*rows)))


def negative_examples(df: DataFrame, row_key, columns, k: int = 5) -> DataFrame:
    """The first ``k`` negative values per column."""
    keys = as_list(row_key)
    cells = long_form(df, profiled_fields(df, columns), (), keys, value=lambda f: present(f).cast("double"))
    window = Window.partitionBy("column_name").orderBy(order_key(keys))
    return (
        cells.where(F.col("value") < 0).withColumn("n", F.row_number().over(window)).where(F.col("n") <= k)
        .select("column_name", "n", *[col(c) for c in keys], "value")
    )


def validate_text(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Text columns: values with special characters, with edge spaces, and over-long ones."""
    by = as_list(by)
    fields = [f for f in profiled_fields(df, columns, by) if is_text(f)]
    return (
        long_form(df, fields, by).groupBy(*[col(b) for b in by], "column_name").agg(*_text_counts())
        .withColumn("is_problematic", _text_problem())
    )


def _text_problem() -> Column:
    return (F.col("special_chars_count") > 0) | (F.col("edge_spaces_count") > 0)


def text_rows(counts: DataFrame, texts: list[str], by=()) -> DataFrame:
    """The rows of :func:`validate_text` for the text columns, from :func:`content_counts`."""
    return counts.where(F.col("column_name").isin(texts)).select(
        *[col(b) for b in by], "column_name", "special_chars_count", "edge_spaces_count", "long_values_count",
        _text_problem().alias("is_problematic"),
    )


def is_aged(name: str) -> bool:
    """Whether negative values are a problem in a column of this name."""
    return S.NON_NEGATIVE_KEYWORD in name.lower()


def unsafe_chars(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Values of any column holding characters that are unsafe inside SQL text."""
    by = as_list(by)
    fields = profiled_fields(df, columns, by)
    aggs = [F.count(F.lit(1)).alias("rows")]
    rows = []
    for i, f in enumerate(fields):
        aggs.append(F.count_if(has_sql_unsafe_chars(as_text(f))).alias(f"__u{i}"))
        rows.append(F.struct(F.lit(f.name).alias("column_name"), F.col(f"__u{i}").alias("unsafe_count"),
                             percent(F.col(f"__u{i}"), F.col("rows")).alias("unsafe_percent")))
    return df.groupBy(*[col(b) for b in by]).agg(*aggs).select(*[col(b) for b in by], F.inline(F.array(*rows)))


def validation_summary(contents: DataFrame, numeric: DataFrame, text: DataFrame, by=()) -> DataFrame:
    """Per validator: how many columns have a problem, and which."""
    by = as_list(by)
    part = lambda d, v: d.select(*[col(b) for b in by], v.alias("validator"), "column_name", "is_problematic")
    rows = (
        part(contents, F.col("validator"))
        .unionByName(part(numeric, F.lit("numeric"))).unionByName(part(text, F.lit("text")))
    )
    return rows.groupBy(*[col(b) for b in by], "validator").agg(
        F.count_if("is_problematic").alias("issues"),
        # Bounded by the columns of the schema.
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_problematic"), F.col("column_name")))), ", ").alias("columns_with_issues"),
    )
