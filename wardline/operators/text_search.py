"""Wildcard search over text columns: * and ? in a term; a bare term matches anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like_pattern(term: str) -> str:
    """The LIKE pattern of a term, its own %, _ and \\ escaped."""
    escaped = "".join("\\" + c if c in "%_\\" else "%" if c == "*" else "_" if c == "?" else c for c in term)
    return escaped if any(c in term for c in "*?") else f"%{escaped}%"


def matches(term: str, *columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).ilike(like_pattern(term)) for c in columns])


def search(df: DataFrame, term: str, columns: list[str], order: list[str], limit: int = 100) -> DataFrame:
    """The first rows that match, 500 at most."""
    if not 1 <= limit <= 500:
        raise ValueError("limit is 1 to 500")
    if set(columns) - set(df.columns):
        raise ValueError("unknown column")
    return df.filter(matches(term, *columns)).orderBy(*order).limit(limit)
