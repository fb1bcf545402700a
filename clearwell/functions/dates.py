"""Reading dates written in many ways.

Every layout is rewritten to ISO text by one chain of anchored replacements and
then cast with ``try_cast``. A failed cast is a null, not an exception, which
keeps columns full of bad dates as fast as columns full of good ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S
from .cleaning import strip_accents
from .text import _c, let, reusable, trim_space

_WORDS = sorted((w for names in S.MONTH_NAMES.values() for w in names), key=len, reverse=True)
_MONTH = "|".join(_WORDS)
_SHORT = "|".join(m[:3] for m in S.ENGLISH_MONTHS)
_FULL = "|".join(S.ENGLISH_MONTHS)

_YEAR = r"(?!0000)[0-9]{4}"
_DAY = r"[0-9]{1,2}"
_TIME = (
    r"([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]{1,9})?)?"
    r" ?(z|utc|[+-][0-9]{2}:?[0-9]{2})?"
)
ISO = rf"^{_YEAR}-{_DAY}-{_DAY}$"
DATETIME = rf"^{_YEAR}-{_DAY}-{_DAY}[t ]{_TIME}$"

# The three families of layouts, by what they start with.
_YEAR_FIRST = rf"^({_YEAR})(?:([-/.])({_DAY})\2({_DAY})|([0-9]{{2}})([0-9]{{2}}))(?:[t ]{_TIME})?$"
_DAY_FIRST = rf"^({_DAY})([-/. ])({_DAY}|{_MONTH})\2({_YEAR}|[0-9]{{2}})$"
_WORD_FIRST = rf"^({_MONTH}) ({_DAY}),? ({_YEAR})$"

# The layouts almost all dates have; they are read without the steps below.
_PLAIN_ISO = rf"^{_YEAR}-{_DAY}-{_DAY}$|^{_YEAR}([/.]){_DAY}\1{_DAY}$|^(?!0000)[0-9]{{8}}$"
_PLAIN_PARTS = r"^([0-9]{4})[-/.]?([0-9]{1,2})[-/.]?([0-9]{1,2})$"
_PLAIN_LAST = rf"^({_DAY})([-/.])({_DAY})\2({_YEAR})$"

# Fewest and most characters other than white space that a supported layout has.
FEWEST, MOST = 4, 48


def _prepared(c) -> Column:
    """Trimmed lower-case text, or null for texts that cannot be a date."""
    c = _c(c)
    v = trim_space(c)
    solid = F.length(F.translate(c, S.WHITESPACE, ""))
    likely = solid.between(FEWEST, MOST) & v.rlike("[0-9]{2}")
    plain = F.regexp_replace(F.lower(strip_accents(v)), r"\s+(de\s+)?", " ")
    return F.when(likely, F.when(v.rlike("^[0-9/.-]+$"), v).otherwise(plain))


def _arranged(t: Column, day_first: bool = True) -> Column:
    """``year-month-day`` text; two-digit years and month names still in place."""
    order = "$4-$3-$1" if day_first else "$4-$1-$3"
    return (
        F.when(t.rlike("^[0-9]{4}"), F.regexp_replace(t, _YEAR_FIRST, "$1-$3$5-$4$6"))
        .when(t.rlike("^[0-9]"), F.regexp_replace(t, _DAY_FIRST, order))
        .otherwise(F.regexp_replace(t, _WORD_FIRST, "$3-$1-$2"))
    )


def _numbered(text: Column) -> Column:
    """Month names replaced by numbers."""
    months = F.create_map(*[
        F.lit(x) for number, names in S.MONTH_NAMES.items() for name in names for x in (name, str(number))
    ])
    parts = F.split(text, "-")
    number = F.try_element_at(months, F.get(parts, 1))
    named = F.concat_ws("-", F.get(parts, 0), number, F.get(parts, 2))
    return F.when(text.rlike("-[a-z]"), named).otherwise(text)


def _dated(text: Column) -> Column:
    """Four-digit years: 69 to 99 are 19xx, 00 to 68 are 20xx."""
    century = F.when(text < "69", F.lit("20")).otherwise(F.lit("19"))
    return F.when(text.rlike("^[0-9]{2}-"), F.concat(century, text)).otherwise(text)


def _as_date(iso: Column) -> Column:
    return F.when(iso.rlike(ISO), iso.try_cast("date"))


def _label(t: Column, parsed: Column) -> Column:
    """Format of a date that has none of the plain layouts."""
    written = (
        F.when(t.rlike(rf"^{_DAY} ({_SHORT}) {_YEAR}$"), "%d %b %Y")
        .when(t.rlike(rf"^{_DAY} ({_FULL}) {_YEAR}$"), "%d %B %Y")
        .when(t.rlike(rf"^({_SHORT}) {_DAY}, {_YEAR}$"), "%b %d, %Y")
        .when(t.rlike(rf"^({_FULL}) {_DAY}, {_YEAR}$"), "%B %d, %Y")
    )
    return F.when(parsed.isNotNull(), F.coalesce(written, F.lit(S.OTHER_DATE_FORMAT)))


def _iso(t: Column, day_first: bool = True) -> Column:
    return let(let(_arranged(t, day_first), _numbered), lambda x: _as_date(_dated(x)))


def _read(t: Column) -> Column:
    swappable = t.rlike(rf"^{_DAY}[-/.]{_DAY}[-/.]")
    return F.when(t.isNotNull(), F.coalesce(_iso(t), F.when(swappable, _iso(t, day_first=False))))


def _plain(v: Column, other: Column, year_first, year_last) -> Column:
    """``year_first`` and ``year_last`` for the plain layouts, ``other`` for the rest."""
    return F.when(v.rlike(_PLAIN_ISO), year_first).when(v.rlike(_PLAIN_LAST), year_last).otherwise(other)


def _year_first(v: Column) -> Column:
    return F.regexp_replace(v, _PLAIN_PARTS, "$1-$2-$3").try_cast("date")


def _year_last(v: Column, day_first: bool) -> Column:
    return F.regexp_replace(v, _PLAIN_LAST, "$4-$3-$1" if day_first else "$4-$1-$3").try_cast("date")


@reusable
def parse_date(c) -> Column:
    """Date behind a text, day first when both orders are possible, else null.

    Reads ISO, ``d/M/y``, ``d-M-y``, ``d.M.y``, ``yyyyMMdd``, ISO date-times and
    months written in Spanish or English. Two-digit years from 69 are 19xx.
    """
    v = trim_space(c)
    return _plain(
        v, let(_prepared(c), _read), _year_first(v), F.coalesce(_year_last(v, True), _year_last(v, False))
    )


@reusable
def parse_timestamp(c) -> Column:
    """As :func:`parse_date`, but a time of day is kept."""
    return let(
        _prepared(c),
        lambda t: F.when(t.rlike(DATETIME), F.upper(t).try_cast("timestamp")).otherwise(_read(t).cast("timestamp")),
    )


@reusable
def has_time_part(c) -> Column:
    return _prepared(c).rlike(DATETIME)


@reusable
def date_format_label(c) -> Column:
    """Label of the first known format a value is written in.

    ``<formato_no_estándar>`` for a readable date in none of them; null when the
    value is no date.
    """
    v = trim_space(c)
    year_first = F.when(
        _year_first(v).isNotNull(),
        F.when(v.contains("-"), "%Y-%m-%d").when(v.contains("/"), "%Y/%m/%d")
        .when(v.contains("."), S.OTHER_DATE_FORMAT).otherwise("%Y%m%d"),
    )
    year_last = F.when(
        _year_last(v, True).isNotNull(),
        F.when(v.contains("/"), "%d/%m/%Y").when(v.contains("-"), "%d-%m-%Y").otherwise("%d.%m.%Y"),
    ).when(
        _year_last(v, False).isNotNull(), F.when(v.contains("/"), "%m/%d/%Y").otherwise(S.OTHER_DATE_FORMAT)
    )
    written = let(_prepared(c), lambda t: let(_read(t), lambda parsed: _label(t, parsed)))
    return _plain(v, written, year_first, year_last)


# Two leading numbers up to 12 around / or -, whatever follows.
_AMBIGUOUS = r"^\s*\+?0*(1[0-2]|[0-9])\s*[/-]\s*\+?0*(1[0-2]|[0-9])\s*([/-]|$)"


@reusable
def is_ambiguous_date(c) -> Column:
    """The first two parts around ``/`` or ``-`` could both be a month."""
    return _c(c).rlike(_AMBIGUOUS)
