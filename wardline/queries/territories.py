"""Territories: hexagons, adjacency, distances of boundaries and where incidents took place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalogue import _hmac, query
from wardline.functions import geo, hexes
from wardline.functions import hashing as H
from wardline.functions.scalars import half_up
from wardline.operators import boundaries
from wardline.plans import places, regions, resolve
from wardline.queries.domain import _KM, _WINDOW, PLACED, _draw
from wardline.sources.scratch import Store
from wardline.sources.tables import incidents, table

#: Squares of a grid without their upper right corner; some meet, some lie a little or further apart, some nations have none.
_SIDES = (0.09, 0.0897, 0.085)
_CORNER = "12.72::DOUBLE + n_nationkey % 5 * 0.09::DOUBLE AS y0, 77.37::DOUBLE + n_nationkey // 5 * 0.09::DOUBLE AS x0"
_AREAS = f"SELECT n_nationkey AS code, {_CORNER}, [{', '.join(f'{s}::DOUBLE' for s in _SIDES)}][n_nationkey % 3 + 1] AS w FROM nation WHERE n_nationkey < 22"
_INSIDE = "{x} >= x0 AND {x} < x0 + w AND {y} >= y0 AND {y} < y0 + w AND ({x} - x0) + ({y} - y0) < 1.6::DOUBLE * w"


def _corner(k: str) -> tuple:
    k = F.col(k)
    return F.lit(77.37) + F.floor(k / 5) * F.lit(0.09), F.lit(12.72) + (k % 5) * F.lit(0.09)


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """code, rings and what they are made of: x0, y0, w."""
    x0, y0 = _corner("n_nationkey")
    w = F.element_at(F.array(*map(F.lit, _SIDES)), (F.col("n_nationkey") % 3 + 1).cast("int"))
    corner = lambda a, b: F.struct((x0 + F.lit(a) * w).alias("x"), (y0 + F.lit(b) * w).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(1.0, 0.6), corner(0.6, 1.0), corner(0.0, 1.0), corner(0.0, 0.0))
    return table(spark, d, "nation").filter("n_nationkey < 22").select(F.col("n_nationkey").alias("code"), F.array(ring).alias("rings"), x0.alias("x0"), y0.alias("y0"), w.alias("w"))


def areas(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark, d).select("code", "rings")


def _lies(x: Column, y: Column) -> Column:
    """Whether a point lies in a shape, as the SQL says it: a point on the cut corner's side is in or out by the last digit."""
    x0, y0, w = F.col("x0"), F.col("y0"), F.col("w")
    return (x >= x0) & (x < x0 + w) & (y >= y0) & (y < y0 + w) & ((x - x0) + (y - y0) < F.lit(1.6) * w)


_HEX_KM = f"(lon - 77.35::DOUBLE) * {hexes.KM_EAST!r}::DOUBLE AS kx, (lat - 12.7::DOUBLE) * {hexes.KM_NORTH!r}::DOUBLE AS ky"


def _hex(level: int) -> str:
    """The cell of kx, ky: the lattice's centres around are compared, and the nearest counts."""
    s = f"{hexes.EDGES_KM[level]!r}::DOUBLE"
    root = f"{hexes.ROOT3!r}::DOUBLE"
    r = f"CAST(floor(ky / (1.5::DOUBLE * {s})) AS BIGINT)"
    centre = lambda dr: f"{{'r': {r} + {dr}, 'q': CAST(floor(kx / ({s} * {root}) - ({r} + {dr}) / 2::DOUBLE + 0.5) AS BIGINT)}}"
    far = f"lambda c: pow(kx - {s} * {root} * (c.q + c.r / 2::DOUBLE), 2) + pow(ky - {s} * 1.5::DOUBLE * c.r, 2)"
    return f"(SELECT 'h{level}/' || c.q || '/' || c.r FROM (SELECT CASE WHEN list_transform([{centre(0)}], {far})[1] <= list_transform([{centre(1)}], {far})[1] THEN {centre(0)} ELSE {centre(1)} END AS c))"


@query(PLACED + f", k AS (SELECT *, {_HEX_KM} FROM pl) SELECT incident_id, {_hex(7)} AS r7, {_hex(8)} AS r8, {_hex(9)} AS r9 FROM k")
def hex_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = places.placed(incidents(spark, d))
    return rows.select("incident_id", *[hexes.cell(F.col("lat"), F.col("lon"), k).alias(f"r{k}") for k in (7, 8, 9)])


@query(
    PLACED
    + f""", k AS (SELECT head, station, {_HEX_KM} FROM pl WHERE {_WINDOW}), w AS (SELECT *, {_hex(9)} AS cell FROM k), t AS (SELECT cell, count(*) AS n FROM w GROUP BY cell ORDER BY n DESC, cell LIMIT 300),
    h AS (SELECT cell, head, n FROM (SELECT cell, head, count(*) AS n, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, head) AS r FROM w GROUP BY cell, head) WHERE r = 1),
    s AS (SELECT cell, station, n FROM (SELECT cell, station, count(*) AS n, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, station) AS r FROM w GROUP BY cell, station) WHERE r = 1)
    SELECT cell, t.n AS count, head AS top_head, h.n AS top_head_count, station AS top_station, s.n AS top_station_count FROM t JOIN h USING (cell) JOIN s USING (cell)"""
)
def hex_hotspots(spark: SparkSession, d: str) -> DataFrame:
    rows = places.placed(incidents(spark, d)).filter(_WINDOW)
    return places.hotspots(rows.withColumn("cell", hexes.cell(F.col("lat"), F.col("lon"))), 300)


_EDGE8, _ROOT3 = f"{hexes.EDGES_KM[8]!r}::DOUBLE", f"{hexes.ROOT3!r}::DOUBLE"


@query(
    f"""WITH a AS ({_AREAS}), g AS (SELECT q, r, 12.7::DOUBLE + {_EDGE8} * 1.5::DOUBLE * r / {hexes.KM_NORTH!r}::DOUBLE AS y, 77.35::DOUBLE + {_EDGE8} * {_ROOT3} * (q + r / 2::DOUBLE) / {hexes.KM_EAST!r}::DOUBLE AS x FROM range(-60, 120) t(q), range(-10, 100) u(r)),
    c AS (SELECT code, q, r FROM a, g WHERE {_INSIDE.format(x="x", y="y")}),
    b AS (SELECT DISTINCT code, q + dq AS q, r + dr AS r FROM c, range(-1, 2) t(dq), range(-1, 2) u(dr) WHERE abs(dq + dr) <= 1)
    SELECT code, n AS cells, m AS with_ring, (SELECT count(*) FROM (SELECT DISTINCT q, r FROM b)) AS all_rings FROM (SELECT code, count(*) AS n FROM c GROUP BY code) JOIN (SELECT code, count(*) AS m FROM b GROUP BY code) USING (code)"""
)
def hex_cover(spark: SparkSession, d: str) -> DataFrame:
    """Cells of each territory, with a ring around them, and of the union of all."""
    store = Store(spark)
    cells = store.cut(hexes.cover(areas(spark, d), "rings", 8, "code"), "cover")
    wide = store.cut(hexes.buffered(cells, 1, "code"), "rings")
    union = wide.select("cell").distinct().agg(F.count("*").alias("n"))
    by = cells.groupBy("code").agg(F.count("*").alias("cells")).join(wide.groupBy("code").agg(F.count("*").alias("with_ring")), "code")
    out = store.cut(by.withColumn("all_rings", union.scalar()), "covered")
    store.close(out)
    return out


def _along(step: str) -> str:
    corners = "[[x0, y0], [x0 + w, y0], [x0 + w, y0 + 0.6::DOUBLE * w], [x0 + 0.6::DOUBLE * w, y0 + w], [x0, y0 + w], [x0, y0]]"
    return f"""a AS ({_AREAS}), ring AS (SELECT code, {corners} AS p FROM a), edge AS (SELECT code, unnest(p[1:5]) AS s, unnest(p[2:6]) AS e FROM ring),
    steps AS (SELECT *, greatest(CAST(floor(greatest(abs(e[1] - s[1]), abs(e[2] - s[2])) / {step}::DOUBLE) AS BIGINT), 1) AS n FROM edge),
    points AS (SELECT code, s[1] + (e[1] - s[1]) * i / n::DOUBLE AS x, s[2] + (e[2] - s[2]) * i / n::DOUBLE AS y FROM (SELECT *, unnest(range(0, n)) AS i FROM steps))"""


_NEAR = f"""{_along("0.00036")}, claimed AS (SELECT DISTINCT code, CAST(floor(x / 0.0005::DOUBLE) AS BIGINT) AS gx, CAST(floor(y / 0.0005::DOUBLE) AS BIGINT) AS gy FROM points),
    near AS (SELECT DISTINCT p.code AS a, q.code AS b FROM claimed p JOIN claimed q ON p.code < q.code AND p.gx BETWEEN q.gx - 2 AND q.gx + 2 AND p.gy BETWEEN q.gy - 2 AND q.gy + 2)"""


@query(f"WITH {_NEAR} SELECT a, b FROM near")
def territory_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return boundaries.adjacency(areas(spark, d))


@query(
    f"""WITH {_along("0.005")}, h AS (SELECT p.code AS a, q.code AS b, pow(sin(radians(q.y - p.y) / 2), 2) + cos(radians(p.y)) * cos(radians(q.y)) * pow(sin(radians(q.x - p.x) / 2), 2) AS h FROM points p JOIN points q ON p.code < q.code)
    SELECT a, b, floor(min({_KM}) * 1e6 + 0.5) / 1e6 AS km FROM h GROUP BY a, b HAVING min({_KM}) <= 3"""
)
def boundary_gaps(spark: SparkSession, d: str) -> DataFrame:
    found = boundaries.distances(boundaries.boundary(areas(spark, d), 0.005), 3.0)
    return found.withColumn("km", half_up(F.col("km"), 6))


_KINDS = ("transit", "public_institutional", "commercial", "residential", "intersection", "outdoor")
_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"
_NO_ANCHORS = 3


def _spread(stage: str, key: str, origin: str, a: str, b: str) -> str:
    return f"floor(({origin} + 0.09::DOUBLE * ({a}::DOUBLE * {_draw(stage, key)} - {b}::DOUBLE)) * 1e6 + 0.5) / 1e6"


@query(
    f"""WITH {_NEAR}, pairs AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    o AS (SELECT o_orderkey AS id, c_nationkey AS code, {_KIND_SQL}[o_orderkey % 6 + 1] AS premise, {_CORNER.replace("n_nationkey", "c_nationkey")} FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT id, code, premise, CASE WHEN id % 10 > 1 THEN {_spread("src_lat", "id", "y0", "1.8", "0.4")} END AS lat, CASE WHEN id % 10 > 1 THEN {_spread("src_lon", "id", "x0", "1.8", "0.4")} END AS lon FROM o),
    i AS (SELECT id, code, premise, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lon END AS lon FROM (SELECT *, coalesce(lat BETWEEN 12.7 AND 13.2 AND lon BETWEEN 77.35 AND 77.85, false) AS ok FROM s)),
    hit AS (SELECT id, i.code, a.code AS there FROM i JOIN a ON {_INSIDE.format(x="lon", y="lat")}),
    lies AS (SELECT id, bool_or(there = code) AS own, min(there) AS there FROM hit GROUP BY id),
    m AS (SELECT i.*, CASE WHEN i.code >= 22 THEN CASE WHEN lat IS NOT NULL THEN 'source_coordinate_unverified' ELSE 'no_polygon_no_coordinate' END WHEN own THEN 'source_coordinate_in_assigned_polygon'
      WHEN pairs.a IS NOT NULL THEN 'source_coordinate_in_adjacent_polygon' ELSE 'geo_anchor_v1' END AS method FROM i LEFT JOIN lies USING (id) LEFT JOIN pairs ON pairs.a = i.code AND pairs.b = there),
    an AS (SELECT c_nationkey AS code, {_KIND_SQL}[c_custkey % 5 + 1] AS kind, c_custkey AS anchor_id, {_CORNER.replace("n_nationkey", "c_nationkey")} FROM customer WHERE c_nationkey <> {_NO_ANCHORS}),
    an2 AS (SELECT code, kind, anchor_id, {_spread("anchor_lat", "anchor_id", "y0", "1", "0")} AS lat, {_spread("anchor_lon", "anchor_id", "x0", "1", "0")} AS lon FROM an),
    pool AS (SELECT *, row_number() OVER (PARTITION BY code, kind ORDER BY anchor_id) - 1 AS number, count(*) OVER (PARTITION BY code, kind) AS n FROM (SELECT * FROM an2 UNION ALL SELECT code, '*', anchor_id, lat, lon FROM an2)),
    size AS (SELECT DISTINCT code, kind, n FROM pool),
    ask AS (SELECT id, m.code, CASE WHEN p.n IS NOT NULL THEN premise ELSE '*' END AS kind, CAST(CAST('0x' || substr({_hmac("'1|geo_resolve|' || id || '|' || premise")}, 1, 16) AS UBIGINT) % coalesce(p.n, q.n) AS BIGINT) AS number
      FROM m LEFT JOIN size p ON p.code = m.code AND p.kind = premise LEFT JOIN size q ON q.code = m.code AND q.kind = '*' WHERE method = 'geo_anchor_v1'),
    f AS (SELECT id, anchor_id, lat AS lat2, lon AS lon2 FROM ask JOIN pool USING (code, kind, number)),
    z AS (SELECT m.*, anchor_id, lat2, lon2, CASE WHEN method = 'geo_anchor_v1' AND anchor_id IS NULL THEN 'no_anchor_available' ELSE method END AS how FROM m LEFT JOIN f USING (id)),
    y AS (SELECT *, CASE WHEN how IN ('source_coordinate_unverified', 'source_coordinate_in_assigned_polygon') THEN 'reported' WHEN how = 'source_coordinate_in_adjacent_polygon' THEN 'reported_corrected' WHEN how = 'geo_anchor_v1' THEN 'inferred' ELSE 'unlocatable' END AS origin FROM z)
    SELECT id AS incident_id, code, premise, origin, how AS method, CASE WHEN origin = 'inferred' THEN lat2 WHEN origin <> 'unlocatable' THEN lat END AS lat, CASE WHEN origin = 'inferred' THEN lon2 WHEN origin <> 'unlocatable' THEN lon END AS lon, anchor_id,
      how IN ('source_coordinate_in_assigned_polygon', 'source_coordinate_in_adjacent_polygon') AS polygon_verified, origin IN ('reported', 'reported_corrected') AS pin_eligible FROM y"""
)
def geo_resolution(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark)
    x0, y0 = _corner("c_nationkey")
    customer = table(spark, d, "customer")
    at = lambda stage, key, origin, a, b: half_up(origin + F.lit(0.09) * (F.lit(a) * H.unit_draw(stage, F.col(key).cast("string")) - F.lit(b)), 6)
    kind = lambda k, n: F.element_at(F.array(*map(F.lit, _KINDS)), (F.col(k) % n + 1).cast("int"))
    said = F.col("o_orderkey") % 10 > 1
    rows = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("o_orderkey").alias("incident_id"), F.col("c_nationkey").alias("code"), kind("o_orderkey", 6).alias("premise"), F.when(said, at("src_lat", "o_orderkey", y0, 1.8, 0.4)).alias("lat"), F.when(said, at("src_lon", "o_orderkey", x0, 1.8, 0.4)).alias("lon"))
    anchors = customer.filter(F.col("c_nationkey") != _NO_ANCHORS).select(F.col("c_nationkey").alias("code"), kind("c_custkey", 5).alias("kind"), F.col("c_custkey").alias("anchor_id"), at("anchor_lat", "c_custkey", y0, 1.0, 0.0).alias("lat"), at("anchor_lon", "c_custkey", x0, 1.0, 0.0).alias("lon"))
    out = store.cut(resolve.resolve(rows, _shapes(spark, d), anchors, store, border=_lies(F.col("lon"), F.col("lat"))), "resolved")
    store.close(out)
    return out


#: Seeds of regions: anchors, tier and whether a ring of cells lies around.
_SEEDS = (("west", "regional", 2, (0, 1)), ("middle", "regional", 2, (12,)), ("east", "regional", 2, (18,)), ("events", "superzone", 2, (6, 7)), ("edge", "superzone", 0, (20,)))
_PLAN = f"""{_NEAR}, pairs AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    seed(region, tier, buffer, anchor) AS (VALUES {", ".join(f"('{r}', '{t}', {b}, {a})" for r, t, b, codes in _SEEDS for a in codes)}),
    plan AS (SELECT region, tier, buffer, anchor AS code FROM seed UNION SELECT region, tier, buffer, b FROM seed JOIN pairs ON anchor = a
      UNION SELECT 'local_' || code, 'local', 0, code FROM a WHERE code NOT IN (SELECT anchor FROM seed WHERE tier = 'regional'))"""


def _plan(spark: SparkSession, d: str, store: Store) -> DataFrame:
    seeds = spark.createDataFrame([(r, t, b, a) for r, t, b, codes in _SEEDS for a in codes], "region string, tier string, buffer int, anchor int")
    near = store.cut(boundaries.adjacency(areas(spark, d)), "near")
    found = store.cut(regions.plan(seeds, areas(spark, d), near), "plan")
    if not regions.uncovered(found, areas(spark, d)).isEmpty():
        raise ValueError("the plan misses an area")
    return found


@query(f"WITH {_PLAN} SELECT region, tier, buffer, code FROM plan")
def region_plan(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark)
    out = _plan(spark, d, store)
    store.close(out)
    return out


_PAIRS = 40
_DRAWN = ", ".join(f"CAST(CAST('0x' || substr({_hmac(f"'1|routing_validation|' || region || '|{e}:' || probe")}, 1, 16) AS UBIGINT) % n AS BIGINT) AS \"{e}\"" for e in ("from", "to"))
_CENTRES = ", ".join(f"12.7::DOUBLE + {_EDGE8} * 1.5::DOUBLE * {e}.r / {hexes.KM_NORTH!r}::DOUBLE AS y{i}, 77.35::DOUBLE + {_EDGE8} * {_ROOT3} * ({e}.q + {e}.r / 2::DOUBLE) / {hexes.KM_EAST!r}::DOUBLE AS x{i}" for i, e in enumerate(("f", "t")))
_SECONDS = "2 * 6371.0088::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})) / 30 * 3600"
_HAVERSINE = "pow(sin(radians({y1} - {y0}) / 2), 2) + cos(radians({y0})) * cos(radians({y1})) * pow(sin(radians({x1} - {x0}) / 2), 2)"
_ROUND = {c: f"(floor({c} * 1e3 + 0.5) / 1e3)" for c in ("y0", "y1", "x0", "x1")}


@query(
    f"""WITH {_PLAN}, g AS (SELECT q, r, 12.7::DOUBLE + {_EDGE8} * 1.5::DOUBLE * r / {hexes.KM_NORTH!r}::DOUBLE AS y, 77.35::DOUBLE + {_EDGE8} * {_ROOT3} * (q + r / 2::DOUBLE) / {hexes.KM_EAST!r}::DOUBLE AS x FROM range(-60, 120) t(q), range(-10, 100) u(r)),
    cover AS (SELECT code, q, r FROM a, g WHERE {_INSIDE.format(x="x", y="y")}), core AS (SELECT region, code, buffer, q, r FROM plan JOIN cover USING (code)),
    cell AS (SELECT DISTINCT region, q + dq AS q, r + dr AS r FROM core, range(-2, 3) t(dq), range(-2, 3) u(dr) WHERE abs(dq + dr) <= 2 AND (buffer > 0 OR (dq = 0 AND dr = 0))),
    num AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY 'h8/' || q || '/' || r) - 1 AS number, count(*) OVER (PARTITION BY region) AS n FROM cell LEFT JOIN (SELECT region, q, r, min(code) AS code FROM core GROUP BY ALL) USING (region, q, r)),
    probe AS (SELECT region, n, probe, {_DRAWN} FROM (SELECT DISTINCT region, n FROM num), range(2000) t(probe)),
    pair AS (SELECT * FROM (SELECT region, "from", "to", row_number() OVER (PARTITION BY region ORDER BY min(probe)) AS k FROM probe WHERE "from" <> "to" GROUP BY region, "from", "to") WHERE k <= {_PAIRS}),
    ways AS (SELECT p.region, f.code AS c0, t.code AS c1, {_CENTRES} FROM pair p JOIN num f ON f.region = p.region AND f.number = p."from" JOIN num t ON t.region = p.region AND t.number = p."to"),
    h AS (SELECT *, {_HAVERSINE.format(y0="y0", y1="y1", x0="x0", x1="x1")} AS h0, {_HAVERSINE.format(**_ROUND)} AS h1 FROM ways),
    s AS (SELECT region, c0, c1, CAST(CAST({_SECONDS.format(h="h0")} AS FLOAT) AS DOUBLE) AS seconds, {_SECONDS.format(h="h1")} AS live FROM h),
    e AS (SELECT *, CASE WHEN live > 0 THEN 100 * abs(seconds - live) / live ELSE 0 END AS error FROM s),
    z AS (SELECT region, count(*) AS samples, median(error) AS m, max(error) AS x, count(*) FILTER (WHERE c0 <> c1) AS cross_boundary, list_sort(list(seconds)) AS l FROM e GROUP BY region)
    SELECT region, n AS cells, samples, floor(m * 1e6 + 0.5) / 1e6 AS median_error, floor(x * 1e6 + 0.5) / 1e6 AS max_error, cross_boundary,
      {", ".join(f"floor(l[least(len(l) - 1, CAST(floor({f} * len(l)) AS BIGINT)) + 1] * 1e3 + 0.5) / 1e3 AS {q}" for f, q in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3")))}, CASE WHEN m < 5 AND x < 20 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM z JOIN (SELECT DISTINCT region, n FROM num) USING (region)"""
)
def routing_validation(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark)
    numbered = regions.cells(_plan(spark, d, store), areas(spark, d), 8, store)
    found = regions.validation(numbered, _PAIRS, store)
    found = found.withColumns({c: half_up(F.col(c), 6) for c in ("median_error", "max_error")} | {c: half_up(F.col(c), 3) for c in ("q1", "q2", "q3")})
    out = store.cut(found, "validation")
    store.close(out)
    return out
