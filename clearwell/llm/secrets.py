"""Secrets in texts, with DataFrame functions only: known shapes, and strings whose windows are too random to be words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import merged, with_matches

BASE = ["assign", "access", "hex"]
ADDED = ["entropy"]

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "entropy": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+",
}
WINDOW = 20
#: Character classes, narrowest first: name, pattern of the whole string, alphabet, bits per character that a window must reach.
CLASSES = [
    ("digits", "^[0-9]+$", "0123456789", 9.9),  # numbers are never secrets by entropy
    ("hex", "^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("base64", "^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.6),
]
#: Shapes that are no secrets however random they look: UUIDs, the digests of the empty text, marked examples.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?i:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709)$",
    r"(?i)example|sample|placeholder|x{6}",
]


def window_entropy(value: Column, alphabet: str, width: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of ``width`` characters.

    One fold over the string: a character enters the counts, the one ``width``
    places back leaves them, and the sum of c * log2(c) changes by those two
    counts alone. Shorter strings are one window.
    """
    table = F.array(*[F.lit(float(c * math.log2(c)) if c else 0.0) for c in range(width + 2)])
    code = lambda i: F.position(F.substring(value, i, 1), F.lit(alphabet))
    counts = F.array_repeat(F.lit(0), len(alphabet) + 1)
    start = F.struct(counts.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    size = F.least(F.length(value), F.lit(width)).cast("double")
    change = lambda counts, at, by: F.transform(counts, lambda c, k: F.when(k == at, c + by).otherwise(c))

    def step(state: Column, i: Column) -> Column:
        leaves = F.when(i > width, code(i - width))
        gone = F.element_at(state["counts"], leaves + 1)
        left = F.when(leaves.isNull(), state["counts"]).otherwise(change(state["counts"], leaves, -1))
        less = F.when(leaves.isNull(), F.lit(0.0)).otherwise(F.element_at(table, gone + 1) - F.element_at(table, gone))
        enters = code(i)
        had = F.element_at(left, enters + 1)
        total = state["sum"] - less + F.element_at(table, had + 2) - F.element_at(table, had + 1)
        full = F.when(i >= size, F.log2(size) - total / size).otherwise(0.0)
        return F.struct(change(left, enters, 1).alias("counts"), total.alias("sum"), F.greatest(state["best"], full).alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), start, step, lambda s: s["best"])


def too_random(value: Column) -> Column:
    """Whether a window of the string reaches the bound of its narrowest character class, and no allowed shape fits."""
    verdict = F.lit(False)
    for _, shape, alphabet, bits in reversed(CLASSES):
        reached = F.lit(False) if bits > math.log2(WINDOW) else window_entropy(value, alphabet) >= bits
        verdict = F.when(value.rlike(shape), reached).otherwise(verdict)
    for shape in ALLOWED:
        verdict = ~value.rlike(shape) & verdict
    return verdict


def _with_spans(df: DataFrame) -> DataFrame:
    """Add the spans of each kind to a frame that has a ``text`` without nulls."""
    text = F.col("text")
    worth = {"assign": text.contains(":") | text.contains("="), "access": text.contains("AKIA"), "hex": None, "entropy": None}
    df = with_matches(df, "text", {k: (PATTERNS[k], worth[k]) for k in BASE + ADDED})
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], _ASSIGN, 1)) >= 6))
    known = F.concat(*[F.col(k) for k in BASE])
    apart = lambda s: ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return df.withColumn("entropy", F.filter("entropy", lambda s: apart(s) & too_random(s["value"])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and a column of spans (start, end, value) for each kind.

    ``entropy`` spans are strings that no base shape overlaps and whose sliding
    windows are too random. Null and empty texts have no spans; repeated rows
    each get their row; extra columns are ignored.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _with_spans(df).select("doc_id", *BASE, *ADDED)


def masked(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with every secret in ``text`` replaced by a mark; spans that overlap share one. Null texts stay null."""
    names = docs.columns
    df = _with_spans(docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    text = F.col("text")

    def step(state: Column, span: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        out = F.when(span["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], between, F.lit(mark)))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    spans = merged(BASE + ADDED)
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(F.col("row.text"))
    return df.select(*[clean.alias("text") if n == "text" else F.col(f"row.`{n}`").alias(n) for n in names])
