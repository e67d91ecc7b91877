"""Plans of the domain: places, hotspots, similarity, patrols, the cyber wing."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalogue import _BASELINE, INCIDENTS, WINDOW_END, _hmac, query
from wardline.functions import geo
from wardline.functions import hashing as H
from wardline.functions import scalars as S
from wardline.functions import text as T
from wardline.operators import relational as R
from wardline.operators.claims import claims
from wardline.operators.near import nearest_points
from wardline.operators.similar import cosines, matrix, nearest
from wardline.plans import patrol, places
from wardline.plans.baselines import KEYS, alerts, baselines, feed, moments
from wardline.sources.scratch import Store
from wardline.sources.tables import incidents, table


def _draw(stage: str, key: str) -> str:
    return f"(CAST(CAST('0x' || substr({_hmac(f"'1|{stage}|' || {key} || '|'")}, 1, 16) AS UBIGINT) >> 11 AS DOUBLE) / 9007199254740992.0)"


#: Incidents with drawn coordinates and their cell, in SQL.
PLACED = (
    INCIDENTS
    + f""", spot AS (SELECT *, floor((12.7::DOUBLE + 0.02::DOUBLE + {_draw("station_lat", "station")} * 0.45::DOUBLE + ({_draw("lat", "incident_id")} - 0.5::DOUBLE) * 0.03::DOUBLE) * 1e6 + 0.5) / 1e6 AS lat,
      floor((77.35::DOUBLE + 0.02::DOUBLE + {_draw("station_lon", "station")} * 0.45::DOUBLE + ({_draw("lon", "incident_id")} - 0.5::DOUBLE) * 0.03::DOUBLE) * 1e6 + 0.5) / 1e6 AS lon FROM inc),
    pl AS (SELECT *, '9/' || CAST(floor(lat / 0.003::DOUBLE) AS BIGINT) || '/' || CAST(floor(lon / 0.003::DOUBLE) AS BIGINT) AS cell FROM spot)
"""
)


@query(PLACED + "SELECT incident_id, lat, lon, cell, lat BETWEEN 12.7 AND 13.2 AND lon BETWEEN 77.35 AND 77.85 AS usable FROM pl")
def place_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = places.placed(incidents(spark, d))
    return rows.select("incident_id", "lat", "lon", "cell", geo.usable(F.col("lat"), F.col("lon")).alias("usable"))


_WINDOW = "registered_on >= DATE '1998-01-01' AND registered_on <= DATE '2000-12-31'"


@query(
    PLACED
    + f""", w AS (SELECT * FROM pl WHERE {_WINDOW}), t AS (SELECT cell, count(*) AS n FROM w GROUP BY cell ORDER BY n DESC, cell LIMIT 300),
    h AS (SELECT cell, head, n FROM (SELECT cell, head, count(*) AS n, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, head) AS r FROM w GROUP BY cell, head) WHERE r = 1),
    s AS (SELECT cell, station, n FROM (SELECT cell, station, count(*) AS n, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, station) AS r FROM w GROUP BY cell, station) WHERE r = 1)
    SELECT cell, t.n AS count, head AS top_head, h.n AS top_head_count, station AS top_station, s.n AS top_station_count FROM t JOIN h USING (cell) JOIN s USING (cell)"""
)
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return places.hotspots(places.placed(incidents(spark, d)).filter(_WINDOW), 300)


_FACTS = "SELECT cell, head, station, incident_id % 24 AS hour, CASE incident_id % 3 WHEN 0 THEN 'transit' WHEN 1 THEN 'commercial' ELSE 'outdoor' END AS premise, CASE WHEN incident_id % 5 < 3 THEN 'reported' ELSE 'inferred' END AS origin FROM pl"


def _ranked(c: str) -> str:
    return f"(SELECT cell, list(v ORDER BY n DESC, v) AS {c}, max(n) AS top_{c} FROM (SELECT cell, {c} AS v, count(*) AS n FROM f GROUP BY ALL) GROUP BY cell)"


@query(
    PLACED
    + f""", f AS ({_FACTS}), x AS (SELECT cell, count(*) AS total, count(*) FILTER (WHERE origin = 'reported') AS reported FROM f GROUP BY cell),
    y AS (SELECT *, floor(top_head * 1000 / total::DOUBLE + 0.5) / 10 AS share, array_to_string(list_transform(list_sort(hour[1:4]), lambda h: printf('%02d:00', h)), ', ') AS peak_hours FROM x JOIN {_ranked("head")} USING (cell) JOIN {_ranked("hour")} USING (cell) JOIN {_ranked("premise")} USING (cell) JOIN {_ranked("station")} USING (cell))
    SELECT cell, total, reported, share, peak_hours, station[1] || ' · ' || cell || ' · ' || total || ' records. ' || head[1] || ' accounts for ' || printf('%.1f', share) || '%. The highest derived occurrence-hour counts are ' || peak_hours || '. ' || premise[1] || ' is the most common normalized premise class. ' || reported || ' of ' || total || ' records have reported-location origin.' AS paragraph,
      CASE WHEN reported / total::DOUBLE >= 0.65 THEN 'high' WHEN reported / total::DOUBLE >= 0.35 THEN 'medium' ELSE 'low' END AS confidence FROM y"""
)
def explain(spark: SparkSession, d: str) -> DataFrame:
    rows, k = places.placed(incidents(spark, d)), F.col("incident_id")
    facts = rows.select("cell", "head", "station", (k % 24).alias("hour"), F.when(k % 3 == 0, "transit").when(k % 3 == 1, "commercial").otherwise("outdoor").alias("premise"), F.when(k % 5 < 3, "reported").otherwise("inferred").alias("origin"))
    store = Store(spark)
    out = store.cut(places.explain(facts, store), "explained")
    store.close(out)
    return out


_KM = "6371.0088::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h))"


@query(
    PLACED
    + f""", a AS (SELECT incident_id, lat, lon FROM pl WHERE incident_id % 50 = 0), b AS (SELECT incident_id AS near, lat AS lat2, lon AS lon2 FROM pl),
    p AS (SELECT *, pow(lat - lat2, 2) + pow(lon - lon2, 2) AS d FROM a JOIN b ON abs(floor(lat / 0.01::DOUBLE) - floor(lat2 / 0.01::DOUBLE)) <= 1 AND abs(floor(lon / 0.01::DOUBLE) - floor(lon2 / 0.01::DOUBLE)) <= 1 WHERE near <> incident_id AND pow(lat - lat2, 2) + pow(lon - lon2, 2) <= 0.0002)
    SELECT incident_id, arg_min(near, (d, near)) AS near, floor(min(d) * 1e12 + 0.5) / 1e12 AS distance FROM p GROUP BY incident_id"""
)
def join_nearest_grid(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark)
    rows = places.placed(incidents(spark, d)).select(F.col("incident_id").alias("id"), "lat", "lon")
    found = nearest_points(rows, "id % 50 = 0", 0.01, 0.0002, store)
    out = store.cut(found.select(F.col("id").alias("incident_id"), "near", S.half_up(F.col("d"), 12).alias("distance")), "nearest")
    store.close(out)
    return out


_BOX = "SELECT n_nationkey AS code, 12.72 + (n_nationkey % 5) * 0.09 AS y0, 77.37 + (n_nationkey // 5) * 0.09 AS x0 FROM nation"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of a grid that overlap a little, with a hole each."""
    k = F.col("n_nationkey")
    # Corners are decimals until they are whole: points have six places, and some lie on a side exactly.
    exact = lambda x: F.lit(Decimal(x))
    rows = table(spark, d, "nation").select(k.alias("code"), (exact("12.72") + (k % 5) * exact("0.09")).alias("y"), (exact("77.37") + F.floor(k / 5) * exact("0.09")).alias("x"))
    corner = lambda dx, dy: F.struct((F.col("x") + exact(dx)).cast("double").alias("x"), (F.col("y") + exact(dy)).cast("double").alias("y"))
    ring = lambda a, b: F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b), corner(a, a))
    outer, far = ring("0", "0.1"), corner("0.1", "0.1")
    low = [F.col(c).cast("double").alias(f"{c}0") for c in ("x", "y")]
    return rows.select("code", *low, far["x"].alias("x1"), far["y"].alias("y1"), F.array(outer, ring("0.04", "0.06")).alias("rings"), geo.area(outer).alias("area"), F.size(geo.densified(outer, 0.03)).alias("points"))


@query(
    PLACED
    + f""", b AS ({_BOX}), m AS (SELECT incident_id, code FROM pl JOIN b ON lon >= x0 AND lon < x0 + 0.1 AND lat >= y0 AND lat < y0 + 0.1 AND NOT (lon >= x0 + 0.04 AND lon < x0 + 0.06 AND lat >= y0 + 0.04 AND lat < y0 + 0.06))
    SELECT incident_id, min(code) AS code, count(*) AS n_polygons FROM m GROUP BY incident_id"""
)
def join_point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    rows, boxes = places.placed(incidents(spark, d)), _boxes(spark, d)
    # Polygons go to the cells of 0.1 degrees that their boxes touch; points meet those of their cell only.
    grid = lambda c: F.floor(F.col(c) / 0.1)
    boxes = boxes.withColumn("gx", F.explode(F.sequence(grid("x0"), grid("x1")))).withColumn("gy", F.explode(F.sequence(grid("y0"), grid("y1"))))
    points = rows.select("incident_id", "lat", "lon", grid("lon").alias("gx"), grid("lat").alias("gy"))
    hit = points.join(boxes, ["gx", "gy"]).filter(F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")) & geo.inside(F.col("lon"), F.col("lat"), F.col("rings")))
    # The first polygon wins; ties by area, then code.
    return hit.groupBy("incident_id").agg(F.min(F.struct(F.round("area", 9).alias("area"), "code")).alias("m"), F.count("*").alias("n_polygons")).select("incident_id", "m.code", "n_polygons")


@query(
    f"WITH b AS ({_BOX}) SELECT p.code AS a, q.code AS b, floor(sqrt(pow(greatest(0, abs(p.x0 - q.x0) - 0.1), 2) + pow(greatest(0, abs(p.y0 - q.y0) - 0.1), 2)) * 1e6 + 0.5) / 1e6 AS gap FROM b p JOIN b q ON p.code < q.code AND abs(p.x0 - q.x0) <= 0.15 AND abs(p.y0 - q.y0) <= 0.15"
)
def join_adjacency_grid(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d).select("code", "x0", "y0")
    # Boxes meet in the cells that they touch, or lie next to.
    cells = boxes.withColumn("gx", F.explode(F.sequence(F.floor(F.col("x0") / 0.2) - 1, F.floor((F.col("x0") + 0.1) / 0.2) + 1))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("y0") / 0.2) - 1, F.floor((F.col("y0") + 0.1) / 0.2) + 1)))
    p = cells.select(F.col("code").alias("a"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), "gx", "gy")
    q = cells.select(F.col("code").alias("b"), F.col("x0").alias("x2"), F.col("y0").alias("y2"), "gx", "gy")
    dx, dy = F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))
    near = p.join(q, ["gx", "gy"]).filter((F.col("a") < F.col("b")) & (dx <= 0.15) & (dy <= 0.15))
    gap = F.sqrt(F.pow(F.greatest(F.lit(0.0), dx - 0.1), 2) + F.pow(F.greatest(F.lit(0.0), dy - 0.1), 2))
    return near.select("a", "b", S.half_up(gap, 6).alias("gap")).distinct()


_WEIGHTS = {"sections": 0.35, "premise": 0.2, "geography": 0.15, "time": 0.1, "victim": 0.1, "weapon": 0.1}
_SLICES = {"sections": (0, 32), "premise": (32, 44), "time": (44, 50), "victim": (50, 56), "weapon": (56, 64)}


def weights(override: dict[str, float] | None = None) -> dict[str, float]:
    """Weights that sum to 1; negative, infinite or all-zero ones are an error."""
    merged = {**_WEIGHTS, **(override or {})}
    if any(not 0 <= w < float("inf") for w in merged.values()):
        raise ValueError("weights must be finite and not negative")
    total = sum(merged.values())
    if total <= 0:
        raise ValueError("one weight must be positive")
    return {k: w / total for k, w in merged.items()}


_RERANK = weights({"premise": 0.5, "time": 0.0})


@query(
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, 12.7::DOUBLE + 0.5::DOUBLE * {_draw("vec_lat", "vec_id")} AS lat, 77.35::DOUBLE + 0.5::DOUBLE * {_draw("vec_lon", "vec_id")} AS lon FROM embeddings),
    p AS (SELECT a.vec_id AS target, b.vec_id AS candidate, a.v AS x, b.v AS y, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    s AS (SELECT target, candidate, {_KM} AS km, {", ".join(f"list_cosine_similarity(x[{i + 1}:{j}], y[{i + 1}:{j}]) AS c_{k}" for k, (i, j) in _SLICES.items())} FROM p),
    r AS (SELECT target, candidate, floor(km * 1e6 + 0.5) / 1e6 AS distance_km, floor(({" + ".join(f"{w!r}::DOUBLE * " + ("exp(-km / 5)" if k == "geography" else f"c_{k}") for k, w in _RERANK.items())}) * 1e6 + 0.5) / 1e6 AS similarity FROM s)
    SELECT target, candidate, distance_km, similarity FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, candidate) AS k FROM r) WHERE k <= 10"""
)
def similarity_rerank(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("vec_id").cast("string")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding", (F.lit(12.7) + F.lit(0.5) * H.unit_draw("vec_lat", key)).alias("lat"), (F.lit(77.35) + F.lit(0.5) * H.unit_draw("vec_lon", key)).alias("lon"))

    def scores(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        a, b = matrix(x["embedding"]), matrix(y["embedding"])
        (lat1, lon1), (lat2, lon2) = (np.radians(np.stack([z["lat"], z["lon"]])) for z in (x, y))
        h = np.sin((lat2 - lat1[:, None]) / 2) ** 2 + np.cos(lat1)[:, None] * np.cos(lat2) * np.sin((lon2 - lon1[:, None]) / 2) ** 2
        km = 6371.0088 * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
        total = sum(w * (np.exp(-km / 5) if k == "geography" else cosines(a[:, slice(*_SLICES[k])], b[:, slice(*_SLICES[k])])) for k, w in _RERANK.items())
        rounded = lambda v: np.floor(v * 1e6 + 0.5) / 1e6
        return rounded(total), rounded(km)

    found = nearest(rows, "id % 50 = 0", scores, 10, ("distance_km",))
    return found.select("target", "candidate", "distance_km", F.col("score").alias("similarity"))


@query(INCIDENTS + f"""SELECT strftime(date_trunc('month', registered_on), '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE stage = 'F') AS closed, floor(count(*) FILTER (WHERE stage = 'F') * 10000.0 / count(*) + 0.5) / 100 AS closed_percent,
    bool_and(registered_on <= DATE '{WINDOW_END}') AS whole_window, NOT bool_and(registered_on <= DATE '{WINDOW_END}') AS partial_window FROM inc WHERE crime_group = 'MACHINERY' GROUP BY 1""")
def cyber_wing(spark: SparkSession, d: str) -> DataFrame:
    inc = incidents(spark, d).filter("crime_group = 'MACHINERY'").withColumn("in_window", F.col("registered_on") <= F.lit(WINDOW_END).cast("date"))
    closed = F.count_if(F.col("stage") == "F")
    by = inc.groupBy(F.date_format(F.date_trunc("month", "registered_on"), "yyyy-MM").alias("month"))
    return by.agg(F.count("*").alias("n"), closed.alias("closed"), (F.floor(closed * 10000.0 / F.count("*") + 0.5) / 100).alias("closed_percent"), F.bool_and("in_window").alias("whole_window"), (~F.bool_and("in_window")).alias("partial_window"))


#: Series of regions and segments, whose names say how grave they are: busy enough for alerts.
_REGIONAL = _BASELINE.replace("n_name AS station, r_name AS division, o_orderpriority AS head", "r_name AS station, r_name AS division, c_mktsegment AS head")
_SINCE = "1997-01-01"
_WEIGHT = "CAST(CASE " + " ".join(f"WHEN regexp_matches(lower(head), '{w}') THEN {k}" for k, w in T.SEVERITY.items()) + " ELSE 1 END AS DOUBLE)"


def _regional(rows: DataFrame) -> DataFrame:
    return rows.withColumn("station", F.col("division")).withColumn("head", F.col("crime_group"))


@query(
    f"""WITH b AS ({_REGIONAL}), p AS ({PLACED} SELECT division AS station, avg(lat) FILTER (WHERE ok) AS latitude, avg(lon) FILTER (WHERE ok) AS longitude, count(*) FILTER (WHERE ok) AS coordinate_records
      FROM (SELECT *, lat BETWEEN 12.7 AND 13.2 AND lon BETWEEN 77.35 AND 77.85 AS ok FROM pl) GROUP BY division),
    h AS (SELECT *, array_to_string(list(fir_count) OVER (PARTITION BY station, head ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), ',') AS history, {_WEIGHT} AS weight FROM b),
    a AS (SELECT *, z_score * weight AS score FROM h WHERE week_start >= DATE '{_SINCE}' AND fir_count >= 5 AND fir_count > ucl_99),
    t AS (SELECT *, row_number() OVER (ORDER BY score DESC, week_start DESC, station, head) AS k FROM a)
    SELECT 'alert-' || lpad(k::VARCHAR, 2, '0') AS alert_id, head AS title, station, week_start, fir_count AS observed_count, floor(expected_count * 10 + 0.5) / 10 AS expected_count, ucl_99, floor(z_score * 100 + 0.5) / 100 AS z_score,
      CASE WHEN z_score > 20 THEN '20+σ' ELSE regexp_replace((floor(z_score * 10 + 0.5) / 10)::VARCHAR, '\\.0$', '') || 'σ' END AS shown, weight AS severity_weight, floor(score * 100 + 0.5) / 100 AS rank_score,
      CASE WHEN score >= 10 THEN 'critical' WHEN score >= 6 THEN 'high' ELSE 'watch' END AS severity, history, floor(latitude * 1e6 + 0.5) / 1e6 AS latitude, floor(longitude * 1e6 + 0.5) / 1e6 AS longitude, coalesce(coordinate_records, 0) AS coordinate_records,
      CAST(floor((k - 1) * 60000.0 / 29 + 0.5) AS BIGINT) AS replay_offset_ms FROM t LEFT JOIN p USING (station) WHERE k <= 30"""
)
def command_feed(spark: SparkSession, d: str) -> DataFrame:
    spots = places.placed(incidents(spark, d)).withColumn("ok", geo.usable(F.col("lat"), F.col("lon")))
    mean = lambda c: F.avg(F.when(F.col("ok"), F.col(c)))
    spots = spots.groupBy(F.col("division").alias("station")).agg(mean("lat").alias("latitude"), mean("lon").alias("longitude"), F.count_if("ok").alias("coordinate_records"))
    return feed(moments(_regional(incidents(spark, d))), spots, T.severity_weight, S.severity, _SINCE)


@query(f"""WITH b AS ({_REGIONAL}) SELECT b.station, b.head, count(*) AS weeks, CAST(sum(fir_count) AS BIGINT) AS n, 0::BIGINT AS drift
    FROM b SEMI JOIN (SELECT station, head FROM b WHERE fir_count >= 5 AND fir_count > ucl_99) a ON a.station = b.station AND a.head = b.head GROUP BY ALL""")
def baseline_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Series that ever alert, whole; drift counts alerts that the reduced table has otherwise than the whole one."""
    store = Store(spark)
    rows = store.cut(baselines(_regional(incidents(spark, d))), "baselines")
    kept = store.cut(rows.join(alerts(rows).select(*KEYS).distinct(), list(KEYS), "left_semi"), "kept")
    drift = R.symmetric_difference(alerts(rows), alerts(kept).select(*rows.columns)).agg(F.count("*").alias("n"))
    out = store.cut(kept.groupBy(*KEYS).agg(F.count("*").alias("weeks"), F.sum("fir_count").alias("n")).withColumn("drift", drift.scalar()), "reduced")
    store.close(out)
    return out


_DEMAND = f"""{PLACED}, dm AS (SELECT station AS scenario, substr(cell, 3) AS cell, crime_group AS beat, sum(pow(0.5, date_diff('day', registered_on, DATE '{WINDOW_END}') / 365.25)) AS demand FROM pl WHERE registered_on <= DATE '{WINDOW_END}' GROUP BY ALL)"""


def _demand(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit(WINDOW_END).cast("date")
    # A scenario is a station: its incidents lie in some 120 cells, however many they are.
    rows = places.placed(incidents(spark, d)).filter(F.col("registered_on") <= end)
    keys = [F.col("station").alias("scenario"), F.substring("cell", 3, 40).alias("cell"), F.col("crime_group").alias("beat")]
    return rows.groupBy(*keys).agg(F.sum(F.pow(F.lit(0.5), F.datediff(end, "registered_on") / 365.25)).alias("demand"))


@query(_DEMAND + " SELECT scenario, cell, beat, floor(demand * 1e6 + 0.5) / 1e6 AS demand FROM dm")
def patrol_demand(spark: SparkSession, d: str) -> DataFrame:
    return _demand(spark, d).withColumn("demand", S.half_up(F.col("demand"), 6))


def _cells(demand: DataFrame) -> DataFrame:
    at = F.split("cell", "/")
    return demand.select("scenario", "cell").distinct().withColumn("lat", (F.element_at(at, 1).cast("double") + 0.5) * 0.003).withColumn("lon", (F.element_at(at, 2).cast("double") + 0.5) * 0.003)


@query(
    _DEMAND
    + f""", c AS (SELECT DISTINCT scenario, cell, (CAST(string_split(cell, '/')[1] AS DOUBLE) + 0.5) * 0.003 AS lat, (CAST(string_split(cell, '/')[2] AS DOUBLE) + 0.5) * 0.003 AS lon FROM dm),
    p AS (SELECT a.scenario, a.cell AS origin, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM c a JOIN c b ON a.scenario = b.scenario)
    SELECT scenario, budget, origin, count(*) AS reached FROM p, (VALUES (180), (300), (420), (600), (900)) t(budget) WHERE {_KM} / 30 * 3600 <= budget GROUP BY ALL"""
)
def coverage_pairs(spark: SparkSession, d: str) -> DataFrame:
    demand = Store(spark).cut(_demand(spark, d), "demand")
    reach = patrol.coverage(patrol.durations(_cells(demand)))
    return reach.groupBy("scenario", "budget", "origin").agg(F.count("*").alias("reached"))


@query(None)
def optimise_greedy(spark: SparkSession, d: str) -> DataFrame:
    demand = Store(spark).cut(_demand(spark, d), "demand")
    reach = patrol.coverage(patrol.durations(_cells(demand))).filter("budget = 420").drop("budget")
    return patrol.deployments(demand, reach, 4)


@query(None)
def dispatch_simulation(spark: SparkSession, d: str) -> DataFrame:
    demand = Store(spark).cut(_demand(spark, d), "demand")
    times = patrol.durations(_cells(demand))
    posts = R.top_per_group(demand, ["scenario", "beat"], [F.col("demand").desc(), F.col("cell")]).select("scenario", F.col("beat").alias("unit"), "cell")
    event = H.stable_index("minute", F.concat_ws("|", "scenario", "cell", "beat"), "replay", 360)
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", "scenario", "cell", "beat"), 256), 1, 12), 16, 10).cast("long")
    return patrol.dispatches(demand.select("scenario", number.alias("event"), event.alias("minute"), F.lit(20).alias("service"), "cell"), posts, times)


_PROBE = _hmac("'1|case_ref|' || id || '|' || probe")


@query(f"""WITH RECURSIVE c(k, id, y, probe, slot) AS (
      SELECT 0, id, y, probe, CAST(CAST('0x' || substr({_PROBE}, 1, 16) AS UBIGINT) % 1000000 AS BIGINT) FROM (SELECT o_orderkey AS id, year(o_orderdate) AS y, 0 AS probe FROM orders)
      UNION ALL SELECT k + 1, id, y, probe, CAST(CAST('0x' || substr({_PROBE}, 1, 16) AS UBIGINT) % 1000000 AS BIGINT)
        FROM (SELECT k, id, y, probe + CAST(row_number() OVER (PARTITION BY y, slot ORDER BY id) > 1 AS INTEGER) AS probe FROM c WHERE k < 12))
    SELECT id, 'DEMO-' || y || '-' || lpad(slot::VARCHAR, 6, '0') AS ref FROM c WHERE k = 12""")
def case_references(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"))
    claimed = claims(rows, lambda probe: H.stable_index("case_ref", F.col("id").cast("string"), probe.cast("string"), 1_000_000), Store(spark))
    return claimed.select("id", F.concat(F.lit("DEMO-"), F.col("y").cast("string"), F.lit("-"), F.lpad(F.col("slot").cast("string"), 6, "0")).alias("ref"))


@query(f"""SELECT p_partkey, array_to_string(list_transform(range(0, 32), lambda i: CASE WHEN list_contains(slots, i) THEN 1 ELSE 0 END), '') AS bits FROM (
      SELECT p_partkey, list_transform(list_distinct(list_filter(string_split_regex(upper(p_name || ' ' || p_type), '[^A-Z]+'), lambda w: length(w) >= 3)), lambda w: CAST(CAST('0x' || substr({_hmac("'1|mo_section_feature|' || w || '|v1'")}, 1, 16) AS UBIGINT) % 32 AS BIGINT)) AS slots FROM part)""")
def signature_vector(spark: SparkSession, d: str) -> DataFrame:
    words = T.premise_tokens(F.concat_ws(" ", "p_name", "p_type"))
    slots = F.transform(words, lambda w: H.stable_index("mo_section_feature", w, "v1", 32))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(T.one_hot(slots, 32), lambda x: x.cast("int").cast("string")), "").alias("bits"))
