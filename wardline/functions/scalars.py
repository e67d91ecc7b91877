"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def iso_week(d: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def half_up(x: Column, places: int) -> Column:
    """Rounded half towards plus infinity; numbers too large to have that many places stay."""
    s = float(10**places)
    return F.when(F.abs(x) < 2.0**52 / s, F.floor(x * s + 0.5) / s).otherwise(x)


def severity(score: Column) -> Column:
    return F.when(score >= 10, "critical").when(score >= 6, "high").otherwise("watch")


def age_bucket(days: Column) -> Column:
    return F.when(days < 90, "0-3m").when(days < 180, "3-6m").when(days < 365, "6-12m").when(days < 730, "1-2y").otherwise("2y+")


def count_of(c: Column) -> Column:
    """'' is 0, '3.0' is 3, anything with a fraction or that isn't a number is null."""
    t = F.trim(c)
    return F.when(t == "", F.lit(0).cast("long")).when(t.rlike("^[0-9]+(\\.0+)?$"), F.regexp_replace(t, "\\.0+$", "").cast("long"))


def calendar_date(y: Column, m: Column, d: Column) -> Column:
    """The date of three parts between 2000 and 2100, or null."""
    made = F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when(y.between(2000, 2100), made)


def grade(total: Column) -> Column:
    """The grade of a deployment's score."""
    return F.when(total < 500, "Needs revision").when(total < 650, "Bronze").when(total < 790, "Silver").when(total < 900, "Gold").otherwise("Commissioner's Commendation")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def chunks(c: Column, size: int = 255) -> Column:
    """All chunks of a text in order; none for an empty one."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(c, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk(c: Column, k: int, size: int = 255) -> Column:
    """The k-th chunk of a text, null where it is empty."""
    return F.nullif(F.substring(c, k * size + 1, size), F.lit(""))


def cosine(a: Column, b: Column, start: int | None = None, end: int | None = None) -> Column:
    """1 for two zero vectors, 0 for one; of a slice of both where its ends are given."""
    if start is not None and end is not None:
        a, b = F.slice(a, start + 1, end - start), F.slice(b, start + 1, end - start)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = dot(a, a), dot(b, b)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dp / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * 6371.0088) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def week_index(day: Column, first: Column) -> Column:
    """The number of weeks from a day to another, to the nearest."""
    return F.floor(F.datediff(day, first) / 7 + 0.5).cast("long")


def path_tail(c: Column, separator: str = "::") -> Column:
    """What follows the last separator."""
    return F.element_at(F.split(c, separator), -1)


def donor_timestamp(day: Column, clock: Column) -> Column:
    """'2024 Jan 05 ...' and '930' as 2024-01-05T09:30:00+05:30; hours and minutes beyond a day's are its last, a clock that isn't a number is midnight. A day that can't be read is an error."""
    date = F.try_to_date(F.substring(day, 1, 11), "yyyy MMM dd")
    date = F.when(date.isNull(), F.raise_error(F.concat(F.lit("unparseable source date: "), F.coalesce(day, F.lit("")))).cast("date")).otherwise(date)
    padded = F.lpad(F.coalesce(clock, F.lit("")), 4, "0")
    part = lambda at, most: F.lpad(F.least(F.coalesce(F.substring(padded, at, 2).try_cast("int"), F.lit(0)), F.lit(most)).cast("string"), 2, "0")
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T"), part(1, 23), F.lit(":"), part(3, 59), F.lit(":00+05:30"))
