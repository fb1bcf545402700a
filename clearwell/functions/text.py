"""Predicates and small transforms over text columns.

All take a column name or Column holding text and return a Column. They stay
inside whole-stage codegen; regular expressions are anchored and possessive
where that keeps them linear on long texts.
"""

from __future__ import annotations

from functools import lru_cache, wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import settings as S

# Patterns that decide what is valid.
EMAIL = (
    r"^(?i)(?!\.|[^@]*\.@|[^@]*@\.|[^@]*\.\.|[^@]*@[^@]*\.\.)"
    r"[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,}$"
)
URL = r"^https?://[^\s\p{Z}\x1c-\x1f\x85/$.?#].[^\s\p{Z}\x1c-\x1f\x85]*+$"
PHONE_DECORATION = "()-+."
PHONE_CHARS = r"^[\p{Nd}\s\p{Z}\x1c-\x1f\x85()+.-]*+$"
PHONE = r"^\p{Nd}{7,}$"
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]++(\.[0-9]*+)?|\.[0-9]++)([eE][+-]?[0-9]++)?$|^(?i:[+-]?(inf|infinity|nan))$"
PLAIN_INTEGER = r"^-?[0-9]+$"
PLAIN_FLOAT = r"^-?[0-9]++\.?[0-9]*+$|^\.[0-9]++$"
SPECIAL = r"[^\p{L}\p{N}_\s\p{Z}.,-]"
SQL_UNSAFE = r'[<>{}"|\\^`~]'
DATE = (
    r"^(?!0000)[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}$"
    r"|^[0-9]{1,2}([-/])[0-9]{1,2}\2(?!0000)[0-9]{4}$"
)
_DAY_MONTH_YEAR = r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$"

# Longer keys are replaced by a digest before they are shuffled.
KEY_BYTES = 64


def reusable(fn):
    """Build the expression over a named column once per application.

    An expression is independent of any DataFrame. Building a large one takes
    thousands of calls into the JVM, which would be most of the time of a job
    over a small table. The last few hundred are kept.
    """
    kept = lru_cache(maxsize=256)(lambda application, args: fn(*args))

    @wraps(fn)
    def build(*args):
        session = SparkSession.getActiveSession()
        if session is None or not all(isinstance(a, (str, int, tuple)) for a in args):
            return fn(*args)
        return kept(session.conf.get("spark.app.id", ""), args)

    return build


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    A conditional expression has no common subexpressions, so without this a
    tree that refers to an intermediate value many times repeats all of it.
    """
    return F.get(F.transform(F.array(value), use), 0)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@reusable
def trim_space(c) -> Column:
    """Trim every Unicode space, tab and line break, not only blanks."""
    return F.btrim(_c(c), F.lit(S.WHITESPACE))


def collapse_spaces(c) -> Column:
    """Trim, then turn every inner run of white space into one blank."""
    return F.regexp_replace(trim_space(c), r"[\s\p{Z}\x1c-\x1f\x85]+", " ")


def truncate(c, length: int = 50) -> Column:
    """First ``length`` characters plus ``...`` when the value is longer."""
    c = _c(c)
    return F.when(
        F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))
    ).otherwise(c)


@reusable
def is_email(c) -> Column:
    return _email(trim_space(c))


def _email(v: Column) -> Column:
    return v.contains("@") & v.rlike(EMAIL)


@reusable
def is_phone(c) -> Column:
    # The cheap test ends at the first letter; only digits and signs get further.
    c = _c(c)
    return c.rlike(PHONE_CHARS) & F.translate(c, S.WHITESPACE + PHONE_DECORATION, "").rlike(PHONE)


@reusable
def is_url(c) -> Column:
    return trim_space(c).rlike(URL)


@reusable
def is_date(c) -> Column:
    """Six numeric layouts, day or month first, and a real calendar date."""
    return _date(trim_space(c))


def _date(v: Column) -> Column:
    iso = F.regexp_replace(F.translate(v, "/", "-"), _DAY_MONTH_YEAR, "$3-$2-$1")
    swapped = F.regexp_replace(F.translate(v, "/", "-"), _DAY_MONTH_YEAR, "$3-$1-$2")
    return F.when(
        v.rlike(DATE), iso.try_cast("date").isNotNull() | swapped.try_cast("date").isNotNull()
    ).otherwise(False)


def is_integer(c) -> Column:
    return trim_space(c).rlike(INTEGER)


def is_number(c) -> Column:
    return trim_space(c).rlike(NUMBER)


def in_range(c, low=None, high=None) -> Column:
    """Numeric and inside the inclusive bounds; anything else is false."""
    v = _c(c).try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    if low is not None:
        ok = ok & (v >= F.lit(float(low)))
    if high is not None:
        ok = ok & (v <= F.lit(float(high)))
    return F.coalesce(ok, F.lit(False))


@reusable
def has_special_chars(c) -> Column:
    return _c(c).rlike(SPECIAL)


@reusable
def has_edge_spaces(c) -> Column:
    return _c(c) != trim_space(c)


def has_sql_unsafe_chars(c) -> Column:
    return _c(c).rlike(SQL_UNSAFE)


def special_char_count(c) -> Column:
    """Characters that are neither alphanumeric nor a blank."""
    return F.length(F.regexp_replace(_c(c), r"[\p{L}\p{N} ]+", ""))


@reusable
def value_type(c) -> Column:
    """Type of a single value; the first match wins."""
    return value_type_of(c, trim_space(c))


@reusable
def value_type_of(c, v) -> Column:
    """:func:`value_type` of ``c`` when its trimmed form ``v`` is at hand."""
    c, v = _c(c), _c(v)
    return (
        F.when(c.isNull() | (c == ""), S.TYPE_NULL)
        .when(v.rlike(PLAIN_INTEGER), S.TYPE_INTEGER)
        .when(v.rlike(PLAIN_FLOAT), S.TYPE_FLOAT)
        .when(_email(v), S.TYPE_EMAIL)
        .when(is_phone(v), S.TYPE_PHONE)
        .when(v.rlike(URL), S.TYPE_URL)
        .when(_date(v), S.TYPE_DATE)
        .otherwise(S.TYPE_TEXT)
    )


@reusable
def content_type_of(v, priority=("email", "phone", "url", "date", "numeric")) -> Column:
    """What a trimmed value could be, in the order used to judge a whole column."""
    v = _c(v)
    tests = {"email": _email, "phone": is_phone, "url": lambda x: x.rlike(URL), "date": _date,
             "numeric": lambda x: x.rlike(NUMBER)}
    chain = F.when(v.isNull(), F.lit(None).cast("string"))
    for name in priority:
        chain = chain.when(tests[name](v), name)
    return chain.otherwise("other")


@reusable
def value_key(c) -> Column:
    """Text of bounded width that is equal exactly when the values are equal.

    Short texts stand for themselves. Longer ones become a SHA-256 digest, so a
    shuffle on whole documents moves 71 bytes per row. No short text can look
    like a digest, because a digest is longer than ``KEY_BYTES`` itself.
    """
    c = _c(c)
    return F.when(
        F.octet_length(c) > KEY_BYTES, F.concat(F.lit("sha256:"), F.sha2(c, 256))
    ).otherwise(c)
