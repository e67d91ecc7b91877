"""When incidents of a kind happen: hour profiles fitted to donors, on four levels that fall back to each other.

donors (category, premise, weekday, hour); a profile is that of the first level with a donor: category, premise and
weekday, then category and weekday, then category, then all. Shares are smoothed towards the hours of all donors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The weight of all donors' hours, levels, and kinds of premises that profiles are made for.
PRIOR = 48
LEVELS = ("category_premise_weekday", "category_weekday", "category", "marginal")
PREMISES = ("residential", "commercial", "transit", "public_institutional", "intersection", "outdoor", "built_other")


def counts(donors: DataFrame) -> DataFrame:
    """level, category, premise, weekday, hours (array of 24 counts), n: all four levels out of one aggregate of the finest cells."""
    fine = donors.groupBy("category", "premise", "weekday", "hour").agg(F.count("*").alias("n"))
    c, p, w = F.col("category"), F.col("premise"), F.col("weekday")
    sums = [F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("n"))), F.lit(0)).alias(f"h{h}") for h in range(24)]
    by = fine.groupingSets([(c, p, w), (c, w), (c,), ()], c, p, w).agg(F.grouping_id().alias("g"), *sums)
    level = F.when(F.col("g") == 0, LEVELS[0]).when(F.col("g") == 2, LEVELS[1]).when(F.col("g") == 3, LEVELS[2]).otherwise(LEVELS[3])
    hours = F.array(*[f"h{h}" for h in range(24)])
    return by.select(level.alias("level"), "category", "premise", "weekday", hours.alias("hours"), F.aggregate(hours, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


def profiles(taxa: DataFrame, levels: DataFrame) -> DataFrame:
    """taxa (..., category) with premise, weekday, level, observations and shares (array of 24), for each premise and weekday; a null category has no profile."""
    names = taxa.columns
    rows = taxa.withColumn("premise", F.explode(F.array(*map(F.lit, PREMISES)))).withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    rows = rows.withColumn("_donor", F.when(F.col("premise") == "intersection", "outdoor").otherwise(F.col("premise")))
    of = lambda k: levels.filter(F.col("level") == LEVELS[k])
    found = lambda k: F.struct("hours", "n").alias(f"_l{k}")
    rows = rows.join(of(0).select("category", F.col("premise").alias("_donor"), "weekday", found(0)), ["category", "_donor", "weekday"], "left")
    rows = rows.join(of(1).select("category", "weekday", found(1)), ["category", "weekday"], "left").join(of(2).select("category", found(2)), "category", "left")
    rows = rows.withColumn("_l3", of(3).select(F.struct("hours", "n").alias("x")).scalar())
    first = F.coalesce("_l0", "_l1", "_l2", "_l3")
    level = F.when(F.col("_l0").isNotNull(), LEVELS[0]).when(F.col("_l1").isNotNull(), LEVELS[1]).when(F.col("_l2").isNotNull(), LEVELS[2]).otherwise(LEVELS[3])
    known = F.col("category").isNotNull()
    shares = F.zip_with(first["hours"], F.col("_l3")["hours"], lambda x, all_: (x + PRIOR * all_ / F.col("_l3")["n"]) / (first["n"] + PRIOR))
    return rows.select(*names, "premise", "weekday", F.when(known, level).otherwise("not_applicable").alias("level"), F.when(known, first["n"]).otherwise(0).alias("observations"), F.when(known, shares).alias("shares"))
