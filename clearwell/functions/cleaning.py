"""Normalising numbers, booleans and e-mail addresses held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S
from .text import _c, let, reusable, trim_space

# Fixed value: what may surround a number.
NUMBER_SHAPE = r"^\(?[+-]?(\$|€|£|¥|[A-Za-z]{3})? *[0-9][0-9., ]*+\)?$"
CANONICAL = r"^-?[0-9]++\.?[0-9]*+$"


def strip_accents(c) -> Column:
    return F.translate(_c(c), S.ACCENTED, S.PLAIN)


@reusable
def normalize_number(c) -> Column:
    """Plain decimal text (``-1234.56``) of a decorated number, else null.

    Of two different separators the last one is the decimal point. A lone comma
    is the decimal point when one or two digits follow it. Parentheses negate.
    """
    t = trim_space(c)
    digits = F.when(t.rlike(NUMBER_SHAPE), F.regexp_replace(t, r"[^0-9,.-]+", ""))
    negative = t.startswith("(") & t.endswith(")")
    signed = let(let(digits, _plain_number), lambda n: F.when(
        negative & ~n.startswith("-"), F.concat(F.lit("-"), n)).otherwise(n))
    decorated = let(signed, lambda n: F.when(n.rlike(CANONICAL), n))
    return F.when(t.rlike(CANONICAL), t).otherwise(decorated)


def _plain_number(digits: Column) -> Column:
    comma = digits.contains(",")
    after_dots = F.when(digits.contains("."), digits.rlike(r",[^.]*$")).otherwise(digits.rlike(r",[0-9]{1,2}$"))
    return (
        F.when(comma & after_dots, F.translate(digits, ",.", "."))
        .when(comma, F.translate(digits, ",", ""))
        .otherwise(digits)
    )


def to_number(c, dtype: str = "double") -> Column:
    return normalize_number(c).try_cast(dtype)


@reusable
def normalize_boolean(c) -> Column:
    word = F.lower(strip_accents(trim_space(c)))
    return F.when(word.isin(S.TRUE_WORDS), True).when(word.isin(S.FALSE_WORDS), False)


@reusable
def normalize_email(c) -> Column:
    return F.lower(trim_space(c))
