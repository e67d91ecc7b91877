"""Places of incidents: drawn coordinates, cells, hotspots and what a cell's counts say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import geo, hashing
from wardline.functions.scalars import half_up
from wardline.operators.relational import top_per_group
from wardline.sources.scratch import Store


def placed(incidents: DataFrame) -> DataFrame:
    """incidents with lat, lon and cell: coordinates are drawn from the incident's id, around its station's own."""
    spot = lambda stage, key: hashing.unit_draw(stage, key)
    station, one = F.col("station"), F.col("incident_id").cast("string")
    lat = geo.SOUTH + 0.02 + spot("station_lat", station) * 0.45 + (spot("lat", one) - 0.5) * 0.03
    lon = geo.WEST + 0.02 + spot("station_lon", station) * 0.45 + (spot("lon", one) - 0.5) * 0.03
    df = incidents.withColumn("lat", half_up(lat, 6)).withColumn("lon", half_up(lon, 6))
    return df.withColumn("cell", geo.cell(F.col("lat"), F.col("lon")))


def hotspots(rows: DataFrame, limit: int = 500) -> DataFrame:
    """Cells by count with their commonest head and station: one aggregate of the finest groups feeds all three counts."""
    fine = rows.groupBy("cell", "head", "station").agg(F.count("*").alias("n"))
    totals = fine.groupBy("cell").agg(F.sum("n").alias("count")).orderBy(F.col("count").desc(), "cell").limit(max(1, min(2000, limit)))
    top = lambda c: top_per_group(fine.groupBy("cell", c).agg(F.sum("n").alias(f"top_{c}_count")), ["cell"], [F.col(f"top_{c}_count").desc(), F.col(c)]).withColumnRenamed(c, f"top_{c}")
    return totals.join(top("head"), "cell").join(top("station"), "cell").select("cell", "count", "top_head", "top_head_count", "top_station", "top_station_count")


def explain(rows: DataFrame, store: Store) -> DataFrame:
    """What each cell's rows (cell, head, hour, premise, origin, station) say: counts, a paragraph and how sure the places are. One aggregate of the finest groups, written once, feeds all counts."""
    kinds = ("head", "hour", "premise", "station")
    fine = store.cut(rows.groupBy("cell", *kinds, (F.col("origin") == "reported").alias("_reported")).agg(F.count("*").alias("n")), "cells")

    def ranked(c: str) -> DataFrame:
        counts = fine.filter(F.col(c).isNotNull()).groupBy("cell", c).agg(F.sum("n").alias("n"))
        best = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(c).alias("value"))))
        return counts.groupBy("cell").agg(best.alias(c))

    out = fine.groupBy("cell").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("_reported"), F.col("n"))), F.lit(0)).alias("reported"))
    for c in kinds:
        out = out.join(ranked(c), "cell", "left")
    top = lambda c: F.element_at(c, 1)["value"]
    share = F.floor(-F.element_at("head", 1)["n"] * 1000 / F.col("total") + 0.5) / 10
    hours = F.array_join(F.transform(F.array_sort(F.transform(F.slice("hour", 1, 4), lambda h: h["value"])), lambda h: F.format_string("%02d:00", h)), ", ")
    paragraph = F.concat(
        top("station"), F.lit(" · "), F.col("cell"), F.lit(" · "), F.col("total").cast("string"), F.lit(" records. "),
        top("head"), F.lit(" accounts for "), F.format_string("%.1f", share), F.lit("%. The highest derived occurrence-hour counts are "), hours, F.lit(". "),
        top("premise"), F.lit(" is the most common normalized premise class. "), F.col("reported").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" records have reported-location origin."),
    )
    sure = F.col("reported") / F.greatest("total", F.lit(1))
    return out.select("cell", "total", "reported", share.alias("share"), hours.alias("peak_hours"), paragraph.alias("paragraph"), F.when(sure >= 0.65, "high").when(sure >= 0.35, "medium").otherwise("low").alias("confidence"))
