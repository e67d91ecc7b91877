"""Which station's polygon a unit stands for: tiers of evidence, and each polygon goes to one unit.

Names are compared in Spark, within a territory. Who claims what depends on the units before, so that step runs
for a territory in one task; units and stations are a dimension of a few hundred rows there.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import wardline.sources.scratch  # noqa: F401  (functions travel whole)
from wardline.functions import text as T

#: Names of units that hold no territory, the share of words that settles a name, and the least that is worth a look.
NO_TERRITORY = r"(?i)\bCCB\b|\bCID\b|cyber\s*crime|\bwomen\b.*\bPS\b|\btraffic\b|\brailway\b|\bCEN\b|anti[\s-]?terror|\bchief\s+office\b"
SURE, WORTH = 0.86, 0.35

SCHEMA = "territory string, unit string, fir_count long, station_code string, is_territorial boolean, coverage string, tier string, score double, candidates string, row_code string"


def _claim(units: pd.DataFrame) -> pd.DataFrame:
    """The verdict on each unit of a territory, in name order."""
    taken: set[str] = set()
    out = []
    for u in units.sort_values("unit").itertuples():
        seen = sorted((c for c in u.stations if c["code"] is not None), key=lambda c: c["code"])
        code = score = None
        listed, territorial = "", True
        exact = [c["code"] for c in seen if c["exact"]]
        if u.ruled:
            territorial, tier = bool(u.rule_territorial), "override"
            code = (u.rule_code or None) if territorial else None
        elif u.no_territory:
            territorial, tier = False, "non_territorial"
        elif len(exact) == 1 and exact[0] not in taken:
            code, tier, score = exact[0], "normalized_exact", 1.0
        elif u.point_code is not None and u.point_code not in taken:
            code, tier, score = u.point_code, "point_in_polygon", 1.0
        else:
            left = sorted((c for c in seen if c["code"] not in taken), key=lambda c: -max(c["token"], c["edit"]))
            if left and left[0]["token"] >= SURE:
                code, tier, score = left[0]["code"], "token_set", round(left[0]["token"], 3)
            else:
                tier = "UNRESOLVED"
                score = round(max(left[0]["token"], left[0]["edit"]), 3) if left else None
                listed = "|".join(c["code"] for c in left[:3] if max(c["token"], c["edit"]) > WORTH)
        if code is not None:
            taken.add(code)
        coverage = "non_territorial" if not territorial else "mapped" if code else "outside_polygon_set"
        digest = hashlib.sha256(u.unit.encode()).hexdigest()[:8].upper()
        row = code if coverage == "mapped" else f"{'UNMAPPED' if territorial else 'NT'}-{digest}"
        out.append((u.territory, u.unit, u.fir_count, code, territorial, coverage, tier, score, listed, row))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def crosswalk(units: DataFrame, stations: DataFrame, rules: DataFrame, points: DataFrame) -> DataFrame:
    """A row for each unit (territory, unit, fir_count) with a name: its station's code, the tier that settled it, and the code of its row.

    stations: (territory, code, name). rules: reviewed (unit, rule_territorial, rule_code), which win over all.
    points: (territory, name, code) of the polygon that holds the point of that name. Units of a name are one; of several rules
    or points of a name the least code counts. A territory without stations leaves its units unresolved.
    """
    units = units.filter("unit IS NOT NULL").groupBy("territory", "unit").agg(F.sum("fir_count").cast("long").alias("fir_count"))
    stations = stations.filter("code IS NOT NULL").select("territory", F.col("code").cast("string").alias("code"), "name")
    key = T.normal_name(F.col("unit"))
    pairs = units.join(stations, "territory", "left")
    one = F.struct(
        F.col("code"),
        F.coalesce(key == T.normal_name(F.col("name")), F.lit(False)).alias("exact"),
        T.token_ratio(F.col("unit"), F.col("name")).alias("token"),
        F.coalesce(T.edit_ratio(F.col("unit"), F.col("name")), F.lit(0.0)).alias("edit"),
    )
    seen = pairs.groupBy("territory", "unit", "fir_count").agg(F.collect_list(one).alias("stations"))
    points = points.groupBy("territory", T.normal_name(F.col("name")).alias("key")).agg(F.min(F.col("code").cast("string")).alias("point_code"))
    rules = rules.groupBy("unit").agg(F.max("rule_territorial").alias("rule_territorial"), F.min(F.col("rule_code").cast("string")).alias("rule_code"), F.lit(True).alias("ruled"))
    known = seen.withColumn("key", key).withColumn("no_territory", F.col("unit").rlike(T.edged(NO_TERRITORY))).join(points, ["territory", "key"], "left").join(rules, "unit", "left")
    known = known.withColumn("ruled", F.coalesce("ruled", F.lit(False)))
    return known.groupBy("territory").applyInPandas(_claim, SCHEMA)


def packed(districts: DataFrame, stations: DataFrame, seed: bytes) -> DataFrame:
    """(district, n, code): districts (district, n), the largest first, each to the station (code, quota) that it fills least; equals by a keyed draw.

    A choice depends on those before, so one task makes them all; both tables are dimensions. A quota must be above 0.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import hmac

        quota = dict(zip(right["code"], right["quota"]))
        load = dict.fromkeys(sorted(quota), 0)
        out = []
        for name, n in sorted(zip(left["district"], left["n"]), key=lambda d: (-d[1], d[0])):
            fill = {c: (load[c] + n) / quota[c] for c in load}
            least = min(fill.values())
            code = min((c for c in load if fill[c] == least), key=lambda c: hmac.digest(seed, f"1|station_assignment_tie|{name}|{c}".encode(), "sha256")[:8])
            load[code] += n
            out.append((name, n, code))
        return pd.DataFrame(out, columns=["district", "n", "code"])

    of = F.lit(0).alias("all")
    return districts.select(of, "district", "n").groupBy("all").cogroup(stations.select(of, "code", "quota").groupBy("all")).applyInPandas(run, "district string, n long, code string")
