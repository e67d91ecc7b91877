"""The small query language: one table, filters that all hold, groups, order, page; and text search."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import text_search

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
COMPARE = {"eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}


class QueryError(ValueError):
    """A request that the language doesn't allow."""


def name(x: str) -> str:
    if not NAME.fullmatch(x):
        raise QueryError(f"unsafe identifier: {x}")
    return x


def scalar(x: Any) -> Any:
    if isinstance(x, float) and not math.isfinite(x):
        raise QueryError("numbers must be finite")
    return x


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None

    def predicate(self) -> Column:
        c = F.col(name(self.column))
        if self.operator in ("is_null", "is_not_null"):
            return c.isNull() if self.operator == "is_null" else c.isNotNull()
        if self.operator == "in":
            if not isinstance(self.value, (list, tuple)) or not self.value:
                raise QueryError(f"in on {self.column} needs a value at least")
            return c.isin(*map(scalar, self.value))
        if self.operator not in COMPARE:
            raise QueryError(f"unknown operator: {self.operator}")
        if isinstance(self.value, (list, tuple)):
            raise QueryError(f"{self.operator} on {self.column} needs one value")
        if self.value is None:
            if self.operator not in ("eq", "ne"):
                raise QueryError(f"null has no order, in {self.column}")
            return c.isNull() if self.operator == "eq" else c.isNotNull()
        return COMPARE[self.operator](c, scalar(self.value))


@dataclass(frozen=True)
class TableQuery:
    """columns and aggregates (function, column or *, name); grouping columns stand in columns and group_by. Nulls come last in either direction of order."""

    table: str
    columns: Sequence[str] = ()
    aggregates: Sequence[tuple[str, str, str]] = ()
    filters: Sequence[Filter] = ()
    group_by: Sequence[str] = ()
    order_by: Sequence[tuple[str, str]] = ()
    limit: int | None = None
    offset: int | None = None

    def run(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        if self.limit is not None and (not isinstance(self.limit, int) or self.limit < 1):
            raise QueryError("limit must be a positive integer")
        if self.offset is not None and (not isinstance(self.offset, int) or self.offset < 0):
            raise QueryError("offset must be a non-negative integer")
        if name(self.table) not in tables:
            raise QueryError(f"unknown table: {self.table}")
        df = tables[self.table]
        for f in self.filters:
            df = df.filter(f.predicate())
        columns = [name(c) for c in self.columns]
        made = []
        for fn, column, as_ in self.aggregates:
            if fn not in AGGREGATES or (column == "*" and fn != "count"):
                raise QueryError(f"unknown aggregate: {fn}({column})")
            made.append(AGGREGATES[fn](F.lit(1) if column == "*" else F.col(name(column))).alias(name(as_)))
        if self.group_by or made:
            if set(columns) != {name(c) for c in self.group_by}:
                raise QueryError("columns and group_by must name the same columns")
            df = df.groupBy(*columns).agg(*made) if made else df.select(*columns).distinct()
        elif columns:
            df = df.select(*columns)
        if self.order_by:
            for _, way in self.order_by:
                if way not in ("asc", "desc"):
                    raise QueryError(f"unknown direction: {way}")
            df = df.orderBy(*[F.col(name(c)).asc_nulls_last() if way == "asc" else F.col(name(c)).desc_nulls_last() for c, way in self.order_by])
        df = df.offset(self.offset) if self.offset else df
        return df.limit(self.limit) if self.limit is not None else df


@dataclass(frozen=True)
class IncidentRequest:
    """Incidents by filters or by a search, newest first; a search takes no filter beside it."""

    search: str | None = None
    search_in: Sequence[str] = field(default_factory=tuple)
    station: str | None = None
    head: str | None = None
    start: str | None = None
    end: str | None = None
    limit: int = 100
    offset: int = 0

    SEARCHABLE = ("station", "division", "head", "crime_group")

    def run(self, incidents: DataFrame) -> DataFrame:
        limit = max(1, min(500, int(self.limit)))
        order = [F.col("registered_on").desc(), F.col("incident_id").asc()]
        if self.search is not None:
            if self.station or self.head or self.start or self.end:
                raise QueryError("a search takes no filters")
            columns = list(self.search_in) or list(self.SEARCHABLE)
            if set(columns) - set(self.SEARCHABLE):
                raise QueryError("a search in unknown columns")
            df = incidents.filter(text_search.matches(self.search, *columns))
        else:
            for day in (self.start, self.end):
                if day is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
                    raise QueryError(f"not a date: {day}")
            wanted = [F.col(c) == v for c, v in (("station", self.station), ("head", self.head)) if v is not None]
            wanted += [F.col("registered_on") >= F.lit(self.start).cast("date")] if self.start else []
            wanted += [F.col("registered_on") <= F.lit(self.end).cast("date")] if self.end else []
            df = incidents.filter(reduce(lambda a, b: a & b, wanted, F.lit(True)))
        df = df.orderBy(*order)
        return (df.offset(self.offset) if self.offset else df).limit(limit)
