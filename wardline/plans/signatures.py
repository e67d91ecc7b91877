"""Signatures of how offences were committed: 64 slots out of sections, places, times, victims and weapons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import hashing
from wardline.functions import text as T

#: The first slots of the five blocks, labels with a slot each, and sections that count.
LAYOUT, SLOTS = "mo64_v1", 64
SECTIONS, PREMISE, TIME, VICTIM, WEAPON = (0, 32), (32, 12), 44, 50, 56
VICTIMS = ("male", "female", "boy", "girl", "multiple", "none")
WEAPONS = (*T.WEAPONS, "other_weapon")
TOP = 200


def vocabulary(rows: DataFrame, tokens: Column, top: int = TOP) -> DataFrame:
    """The commonest section tokens with their counts, by count, then by name."""
    return rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(top)


def slots(sections: Column, known: Column, places: Column, band: Column, victims: Column, weapons: Column) -> Column:
    """The slots that are set: sections of the vocabulary and words of the place by keyed hashes, the rest by their labels."""
    hashed = lambda stage, block: lambda w: F.lit(block[0]) + hashing.stable_index(stage, w, LAYOUT, block[1])
    at = lambda labels, first: lambda x: F.array_position(F.array(*map(F.lit, labels)), x) - 1 + first
    found = F.array_compact(F.array(band))
    parts = [
        F.transform(F.array_intersect(sections, known), hashed("mo_section_feature", SECTIONS)),
        F.transform(places, hashed("mo_premise_feature", PREMISE)),
        F.transform(found, at(T.TIME_BANDS, TIME)),
        F.transform(victims, at(VICTIMS, VICTIM)),
        F.transform(weapons, at(WEAPONS, WEAPON)),
    ]
    return F.array_distinct(F.concat(*parts))


def vector(set_slots: Column) -> Column:
    return T.one_hot(set_slots, SLOTS)
