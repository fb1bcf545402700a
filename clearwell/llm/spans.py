"""Places of regular-expression matches in whole texts, by DataFrame functions only.

Positions are code points, ends exclusive. Patterns are Java's; possessive
quantifiers and look-behinds in them keep the search linear in long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,value:string>"
NONE = "array<" + SPAN + ">"


def located(text: Column, pattern: str, found: Column) -> Column:
    """Array of (start, end, value) of the matches ``found`` in the text, left to right.

    ``split`` cuts at the very matches that ``regexp_extract_all`` returns, so
    the lengths of what lies between and of the matches add up to positions.
    Matches are folded in runs of 256, then joined, so many matches stay cheap.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    parts = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / 256)), lambda r: F.slice(F.filter(parts, lambda p: p["value"].isNotNull()), r.cast("int") * 256 + 1, 256))

    def one(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + F.length(part["value"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value")))).alias("spans"))

    def run(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast(NONE).alias("spans")), one)
        return F.struct(done["at"].alias("at"), F.concat(state["spans"], F.array(done["spans"])).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{NONE}>").alias("spans"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(runs, start, run)["spans"])).otherwise(F.array().cast(NONE))


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """Add a column of spans for each kind: name -> (pattern, a cheap test that a text without matches mostly fails)."""
    empty = F.array().cast("array<string>")
    found = {}
    for kind, (pattern, worth) in patterns.items():
        all_ = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        found[f"_{kind}"] = all_ if worth is None else F.when(worth, all_).otherwise(empty)
    df = df.withColumns(found)
    return df.withColumns({kind: located(F.col(text), pattern, F.col(f"_{kind}")) for kind, (pattern, _) in patterns.items()}).drop(*found)


def merged(kinds: list[str]) -> Column:
    """All spans of the kinds' columns in one array of (start, order, kind, end, value), by start, then kind as listed."""

    def of(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(kinds)]))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
