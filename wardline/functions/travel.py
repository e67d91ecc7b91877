"""Travel by the hour: free-flow times are multiplied by what an hour's traffic makes of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Km an hour in free flow, and measured in each band; the hours of the two rushes.
FREE_FLOW = 44.0
SPEEDS = {"morning_rush": 14.6, "evening_rush": 13.2, "all_day": 16.6}
RUSHES = {"morning_rush": (7, 8, 9), "evening_rush": (17, 18, 19)}
#: What rain and a closed road make of travel times.
RAIN, CLOSURE = 1.35, 1.12


def band(hour: Column) -> Column:
    """The traffic band of an hour, which may run past a day's end either way."""
    h = F.pmod(hour, F.lit(24))
    morning, evening = RUSHES.items()
    return F.when(h.isin(*morning[1]), morning[0]).when(h.isin(*evening[1]), evening[0]).otherwise("all_day")


def speed(hour: Column) -> Column:
    """km an hour in an hour's traffic."""
    of = band(hour)
    return F.when(of == "morning_rush", SPEEDS["morning_rush"]).when(of == "evening_rush", SPEEDS["evening_rush"]).otherwise(SPEEDS["all_day"])


def multiplier(hour: Column) -> Column:
    """Congested over free-flow time, to four places."""
    return F.floor(FREE_FLOW / speed(hour) * 1e4 + 0.5) / 1e4


def clock_hour(start: Column, minute: Column) -> Column:
    """The hour of a minute after a shift's first hour."""
    return F.pmod(start + F.floor(minute / 60), F.lit(24))
