"""Personal data in texts, with DataFrame functions only: proposed by patterns, confirmed by checksums, weighed by context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import merged, with_matches

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn"]

# A match begins where its run of characters does (or where the previous match ended),
# and possessive runs are never tried shorter: the matches are those of the plain
# patterns, found in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
CONTEXT = {
    "email": "mail|contact|correo|kontakt",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
}
#: Score of a proposal before its context is read; a checksum that holds is part of it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEARBY, BONUS, LEAST = 40, 0.2, 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weight(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weight) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number of letters and digits leaves 1 when divided by 97, its first four characters moved to the end."""
    moved = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, 1))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        significant = lambda part: F.ltrim(part, F.lit("0"))
        in_range = lambda part: (F.length(significant(part)) <= 3) & (F.coalesce(significant(part).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), in_range)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        account = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(account).between(15, 34), mod97(account)).otherwise(F.lit(False))
    return F.lit(True)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, a column of spans (start, end, value) for each kind, and ``spans``: all with their ``score``.

    Base kinds (email, ip, card, phone) are those whose pattern and validator
    hold; their score says how the context supports them but removes none.
    The added kinds (iban by mod-97; ssn, which needs a context word) are kept
    at a score of ``LEAST``. Null and empty texts have no spans; repeated rows
    each get their row; extra columns are ignored.
    """
    text = F.col("text")
    worth = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "phone": text.contains("+"),
        "iban": text.rlike(r"[A-Z]{2}[0-9]{2}"),
        "ssn": text.rlike(r"[0-9]-[0-9]{2}-"),
        "card": None,
    }
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = with_matches(df, "text", {k: (PATTERNS[k], worth[k]) for k in BASE + ADDED})

    def score(span: Column, kind: str) -> Column:
        begin = F.greatest(span["start"] - NEARBY, F.lit(0))
        around = F.concat_ws(" ", F.substring(text, (begin + 1).cast("int"), (span["start"] - begin).cast("int")), F.substring(text, (span["end"] + 1).cast("int"), F.lit(NEARBY)))
        return F.lit(PRIOR[kind]) + F.when(F.lower(around).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})"), BONUS).otherwise(0.0)

    def kept(kind: str) -> Column:
        strong = lambda s: _confirmed(kind, s["value"]) & (score(s, kind) >= LEAST)
        return F.filter(kind, strong if kind in ADDED else lambda s: _confirmed(kind, s["value"]))

    df = df.withColumns({k: kept(k) for k in BASE + ADDED})
    all_ = merged(BASE + ADDED)
    by_kind = lambda s: F.coalesce(*[F.when(s["kind"] == k, score(s, k)) for k in BASE + ADDED])
    scored = F.transform(all_, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), by_kind(s).alias("score")))
    return df.select("doc_id", *BASE, *ADDED, F.when(F.size(all_) > 0, scored).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>")).alias("spans"))
