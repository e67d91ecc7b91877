"""Stations, donors and deployments: the crosswalk, packing, classifiers, hours of traffic, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalogue import _hmac, query
from wardline.functions import hashing as H
from wardline.functions import scalars as S
from wardline.functions import text as T
from wardline.functions import travel
from wardline.operators import relational as R
from wardline.plans import crosswalk, patrol
from wardline.queries.domain import _DEMAND, _KM, _cells, _demand
from wardline.sources.tables import incidents, table

_BAND = "CASE WHEN h IN (7, 8, 9) THEN 'morning_rush' WHEN h IN (17, 18, 19) THEN 'evening_rush' ELSE 'all_day' END"
_TIMES = "floor(44.0::DOUBLE / CASE WHEN h IN (7, 8, 9) THEN 14.6 WHEN h IN (17, 18, 19) THEN 13.2 ELSE 16.6 END * 1e4 + 0.5) / 1e4"


@query(f"SELECT h AS hour, {_BAND} AS band, {_TIMES} AS multiplier, count(*) AS n, count(*) FILTER (WHERE (20 + h) % 24 < 6) AS n_shifted FROM (SELECT CAST(hour(ts) AS BIGINT) AS h FROM events) GROUP BY h")
def congestion_hours(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    h = F.col("hour")
    shifted = travel.clock_hour(F.lit(20), h * 60) < 6
    return by.select("hour", travel.band(h).alias("band"), travel.multiplier(h).alias("multiplier"), "n", F.when(shifted, F.col("n")).otherwise(0).alias("n_shifted"))


@query(
    _DEMAND
    + f""", c AS (SELECT DISTINCT scenario, cell, (CAST(string_split(cell, '/')[1] AS DOUBLE) + 0.5) * 0.003 AS lat, (CAST(string_split(cell, '/')[2] AS DOUBLE) + 0.5) * 0.003 AS lon FROM dm),
    p AS (SELECT a.scenario, a.cell AS origin, b.cell AS dest, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM c a JOIN c b ON a.scenario = b.scenario),
    tm AS (SELECT scenario, origin, dest, {_KM} / 30 * 3600 AS s FROM p),
    po AS (SELECT scenario, beat, first, CASE WHEN beat <> 'MACHINERY' THEN cell END AS cell FROM (SELECT *, min(cell) OVER (PARTITION BY scenario) AS first, row_number() OVER (PARTITION BY scenario, beat ORDER BY floor(demand * 1e9 + 0.5) DESC, cell) AS r FROM dm) WHERE r = 1),
    nr AS (SELECT tm.scenario, dest, min(s) AS s FROM tm JOIN po ON po.scenario = tm.scenario AND po.cell = origin GROUP BY ALL),
    bt AS (SELECT dm.scenario, beat, sum(CASE WHEN s <= 180 THEN demand ELSE 0 END) AS hit, sum(demand) AS total FROM dm LEFT JOIN nr ON nr.scenario = dm.scenario AND dest = cell GROUP BY ALL),
    cv AS (SELECT scenario, sum(hit) / sum(total) AS coverage, list_sort(list(hit / total)) AS l FROM bt GROUP BY scenario),
    eq AS (SELECT scenario, coverage, 1 - CASE WHEN list_sum(l) = 0 THEN 0 ELSE 2 * list_sum(list_transform(l, lambda v, i: i * v)) / (len(l) * list_sum(l)) - (len(l) + 1) / len(l) END AS equity FROM cv),
    mi AS (SELECT *, (20 + CAST(CAST('0x' || substr({_hmac("'1|minute|' || scenario || '|' || cell || '|' || beat || '|replay'")}, 1, 16) AS UBIGINT) % 360 AS BIGINT) // 60) % 24 AS h FROM dm),
    rs AS (SELECT mi.scenario, list_sort(list(coalesce(s * {_TIMES} / 60, 9))) AS l FROM mi LEFT JOIN nr ON nr.scenario = mi.scenario AND dest = cell GROUP BY ALL),
    pp AS (SELECT scenario, l[least(len(l) - 1, CAST(floor(0.5 * len(l)) AS BIGINT)) + 1] AS p50, l[least(len(l) - 1, CAST(floor(0.9 * len(l)) AS BIGINT)) + 1] AS p90 FROM rs),
    km AS (SELECT po.scenario, sum(coalesce(s * 0.00667, 0)) AS km, count(*) FILTER (WHERE cell IS NULL) AS reserve FROM po LEFT JOIN tm ON tm.scenario = po.scenario AND origin = first AND dest = cell GROUP BY 1),
    sc AS (SELECT *, CAST(floor(400 * coverage + 150 * (1 - least(1, p50 / 3)) + 100 * (1 - least(1, p90 / 5.25)) + 150 * equity + 100 * least(1, reserve / 1.0) + 100 * (1 - least(1, km / 80)) + 0.5) AS BIGINT) AS total FROM eq JOIN pp USING (scenario) JOIN km USING (scenario))
    SELECT scenario, total, CASE WHEN total < 500 THEN 'Needs revision' WHEN total < 650 THEN 'Bronze' WHEN total < 790 THEN 'Silver' WHEN total < 900 THEN 'Gold' ELSE 'Commissioner''s Commendation' END AS grade,
      floor(coverage * 1e6 + 0.5) / 1e6 AS coverage, floor(p50 * 1e6 + 0.5) / 1e6 AS p50, floor(p90 * 1e6 + 0.5) / 1e6 AS p90, floor(equity * 1e6 + 0.5) / 1e6 AS equity, reserve, floor(km * 1e6 + 0.5) / 1e6 AS km FROM sc"""
)
def deployment_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each station's units, one a beat, stand where their beat's demand is highest; one beat's is in reserve."""
    demand = _demand(spark, d)
    times = patrol.durations(_cells(demand))
    first = demand.groupBy("scenario").agg(F.min("cell").alias("start"))
    top = R.top_per_group(demand, ["scenario", "beat"], [S.half_up(F.col("demand"), 9).desc(), F.col("cell")])
    posts = top.join(first, "scenario").select("scenario", F.col("beat").alias("unit"), "start", F.when(F.col("beat") != "MACHINERY", F.col("cell")).alias("cell"))
    minute = H.stable_index("minute", F.concat_ws("|", "scenario", "cell", "beat"), "replay", 360)
    out = patrol.scores(demand, times, posts, demand.select("scenario", "cell", minute.alias("minute")), 3.0, 1, 20)
    return out.select("scenario", "total", "grade", *[S.half_up(F.col(c), 6).alias(c) for c in ("coverage", "p50", "p90", "equity")], "reserve", S.half_up(F.col("km"), 6).alias("km"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Units of several spellings out of nations, with their incidents."""
    spelt = F.concat_ws(" ", F.initcap(F.element_at(F.split("station", "_"), 1)), F.element_at(F.split("station", "_"), 2))
    names = F.array(F.concat(spelt, F.lit(" PS")), F.concat(spelt, F.lit(" Traffic PS")), F.concat(F.lit("Old "), spelt), F.concat(spelt, F.lit(" West Outpost")))
    counts = incidents(spark, d).groupBy("division", "station").agg(F.count("*").alias("fir_count"))
    return counts.select(F.col("division").alias("territory"), F.explode(names).alias("unit"), "fir_count")


@query(None)
def station_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("territory"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    rules = spark.createDataFrame([("Old Nation 3", True, None), ("Nation 4 PS", False, None)], "unit string, rule_territorial boolean, rule_code string")
    points = places.withColumn("name", F.concat(F.lit("old"), "name"))
    return crosswalk.crosswalk(_units(spark, d), places, rules, points)


@query(None)
def capacity_packing(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").groupBy(F.concat_ws("|", "p_brand", "p_type").alias("district")).agg(F.count("*").alias("n"))
    stations = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("code")).agg(F.count("*").cast("double").alias("quota"))
    return crosswalk.packed(parts, stations, H.SEED)


def _chain(rules: tuple, value: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(u, '{r[0]}') THEN {value.format(*r)}" for r in rules) + f" ELSE {other} END"


def _words(rules: tuple) -> tuple:
    return tuple((rf"\b(?:{r[0]})\b", *r[1:]) for r in rules)


_LABEL = "trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '\\$\\s*[\\d,.]+(?:\\s*&?\\s*(?:OVER|UNDER))?', '', 'gi'), '\\b(?:FELONY|MISDEMEANOR|GRAND|PETTY)\\b', '', 'gi')), '[^a-z0-9]+', '_', 'g'), '_')"


@query(
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, upper(replace(coalesce(text, ''), 'ß', 'ss')) AS u FROM documents)
    SELECT doc_id, {_chain(T.CRIMES, "'{1}'", "'other_incident'")} AS category, md5({_chain(tuple((p, a, "'theft_from_vehicle' ELSE 'burglary' END" if b == "burglary" else f"'{b}'") for p, a, b in T.CRIMES), "{2}", f"coalesce(nullif({_LABEL}, ''), 'other')").replace("THEN 'theft_from_vehicle' ELSE", "THEN CASE WHEN contains(u, 'VEHICLE') THEN 'theft_from_vehicle' ELSE")}) AS subcategory_md5,
      {_chain(_words(tuple((w, f"'{c}'" if c else "NULL") for w, c in T.CATEGORIES)), "{1}", "'other_incident'")} AS donor_category,
      CASE WHEN u = '' THEN 'unknown' ELSE {_chain(_words(T.DONOR_PREMISES), "'{1}'", "'built_other'")} END AS premise, CASE WHEN u = '' THEN 'built_other' ELSE {_chain(_words(T.DONOR_PREMISES), "'{2}'", "'built_other'")} END AS broad,
      CASE WHEN u = '' THEN '' ELSE {_chain(_words(T.DONOR_WEAPONS), "'{1}'", "'other_weapon'")} END AS weapon FROM t"""
)
def donor_classes(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    crime, premise = T.donor_crime(text), T.donor_premise(text)
    rows = table(spark, d, "documents").select("doc_id", crime.alias("c"), T.donor_category(F.lit(None), text).alias("donor_category"), premise.alias("p"), T.donor_weapon(text).alias("weapon"))
    return rows.select("doc_id", "c.category", F.md5("c.subcategory").alias("subcategory_md5"), "donor_category", F.col("p.category").alias("premise"), "p.broad", "weapon")


@query("""WITH n AS (SELECT n_name AS x FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT upper(n_name[1]) || lower(n_name[2:]) FROM nation)
    SELECT x, row_number() OVER (ORDER BY lower(x), x DESC) AS place FROM n""")
def order_collated(spark: SparkSession, d: str) -> DataFrame:
    """Names as a reader orders them: by letters first, small before capital ones between equals. A dimension, ordered in one task."""
    from pyspark.sql import Window as W

    n = table(spark, d, "nation")
    names = n.select(F.explode(F.array("n_name", F.lower("n_name"), F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)"))))).alias("x")).distinct()
    return names.select("x", F.row_number().over(W.orderBy(F.collate("x", "UNICODE"))).cast("long").alias("place"))
