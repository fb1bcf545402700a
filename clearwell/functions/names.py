"""What a column name suggests about its content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S
from .text import reusable


@reusable
def name_hint_column(name) -> Column:
    """Hint for a column of column names, so it also runs over whole catalogs."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)

    def any_of(words):
        return reduce(lambda a, b: a | b, [low.contains(w) for w in words])

    chain = None
    for hint, words in S.HINT_KEYWORDS.items():
        chain = F.when(any_of(words), hint) if chain is None else chain.when(any_of(words), hint)
    return chain.when(
        (low == "id") | low.startswith("id_") | low.endswith("_id") | any_of(S.IDENTIFIER_KEYWORDS),
        S.HINT_IDENTIFIER,
    )


def name_hint(name: str) -> str | None:
    """The same for one name that is known while the plan is built."""
    low = name.lower()
    for hint, words in S.HINT_KEYWORDS.items():
        if any(w in low for w in words):
            return hint
    if low == "id" or low.startswith("id_") or low.endswith("_id"):
        return S.HINT_IDENTIFIER
    return S.HINT_IDENTIFIER if any(w in low for w in S.IDENTIFIER_KEYWORDS) else None


def is_identifier_name(name: str) -> bool:
    low = name.lower().strip()
    return (
        name_hint(name) == S.HINT_IDENTIFIER
        or low in S.SEMANTIC_ID_NAMES
        or low.endswith("_id")
        or any(w in low for w in S.SEMANTIC_ID_KEYWORDS)
    )


def is_business_key(name: str) -> bool:
    low = name.lower()
    return low in S.BUSINESS_KEY_NAMES or low.endswith("_id")
