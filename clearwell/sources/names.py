"""Column names that are safe to refer to."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame


def _tidy(name: str, position: int) -> str:
    name = str(name or "").strip()
    if not name or "Unnamed" in name:
        return f"Column_{position}"
    name = re.sub(r"\W", "", name.replace(" ", "_"))
    if name[:1].isdigit():
        return "_" + name
    return name or f"Column_{position}"


def normalize_names(names: Iterable[str]) -> list[str]:
    """Letters, digits and ``_`` only, unique whatever the case."""
    taken: set[str] = set()
    out = []
    for position, raw in enumerate(names, start=1):
        base = _tidy(raw, position)
        name, n = base, 1
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename the columns of a DataFrame; nothing is read."""
    return df.toDF(*normalize_names(df.columns))
