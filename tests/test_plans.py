import hashlib
import hmac
import math
import uuid

import pytest
from pyspark.sql import functions as F

from wardline.functions import geo, hashing, text
from wardline.functions.stats import count_quantile
from wardline.operators import graph, relational
from wardline.operators.claims import claims
from wardline.operators.ordered import running
from wardline.plans import checks, patrol
from wardline.plans.language import Filter, IncidentRequest, QueryError, TableQuery
from wardline.queries.domain import weights
from wardline.sources.scratch import Store
from wardline.streaming.streams import visible


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_keyed_draws(spark):
    mac = hmac.new(hashing.SEED, b"1|stage|key|space", hashlib.sha256).digest()
    assert one(spark, hashing.hmac_sha256(F.lit("1|stage|key|space"))) == mac.hex()
    n = int.from_bytes(mac[:8], "big")
    assert int(one(spark, hashing.stable_uint64("stage", F.lit("key"), "space"))) == n
    assert one(spark, hashing.stable_index("stage", F.lit("key"), "space", 1000)) == n % 1000
    assert one(spark, hashing.unit_draw("stage", F.lit("key"), "space")) == (n >> 11) / 2**53
    assert one(spark, hashing.uuid5(F.lit("é|7"))) == str(uuid.uuid5(uuid.UUID(hashing.NAMESPACE), "é|7"))


def test_quantiles():
    assert count_quantile(0, 1, 0.99) == 0 and count_quantile(1.0, math.inf, 0.99) == 4
    pmf = lambda k, m, r: math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + m)) + k * math.log(m / (r + m)))
    for m, r in ((0.3, 0.5), (2.0, 1.5), (7.5, 30.0)):
        k = count_quantile(m, r, 0.99)
        assert sum(pmf(i, m, r) for i in range(k)) < 0.99 <= sum(pmf(i, m, r) for i in range(k + 1))


def test_the_language_guards(spark):
    tables = {"t": spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")}
    run = lambda **q: [tuple(r) for r in TableQuery("t", **q).run(tables).collect()]
    assert run(filters=[Filter("v", "eq", None)]) == [(2, None)] and run(filters=[Filter("v", "ne", "b")]) == [(1, "a")]
    assert run(filters=[Filter("v", "in", ["a", None])]) == [(1, "a")] and run(filters=[Filter("v", "is_not_null")]) == [(1, "a")]
    assert run(order_by=[("v", "asc")]) == [(1, "a"), (2, None)] and run(aggregates=[("count", "*", "n")]) == [(2,)]
    for bad in (
        {"filters": [Filter("v", "in", [])]}, {"filters": [Filter("v", "lt", None)]}, {"filters": [Filter("v; --", "eq", 1)]}, {"filters": [Filter("k", "eq", math.inf)]},
        {"limit": 0}, {"offset": -1}, {"columns": ["v"], "group_by": ["k"]}, {"aggregates": [("median", "k", "m")]}, {"order_by": [("k", "up")]},
    ):
        with pytest.raises(QueryError):
            run(**bad)
    with pytest.raises(QueryError):
        IncidentRequest(search="x", station="y").run(tables["t"])
    with pytest.raises(QueryError):
        IncidentRequest(search="x", search_in=["amount"]).run(tables["t"])
    with pytest.raises(ValueError):
        weights({k: 0.0 for k in weights()})
    assert sum(weights({"time": 3.0}).values()) == pytest.approx(1)


def test_parsers(spark):
    acts = one(spark, text.sections(F.lit("Indian Penal  Code U/s: 379, 34 MOTOR VEHICLE ACT u/s:177,?? ")))
    assert [(a.act, a.sections) for a in acts] == [("INDIAN PENAL CODE", ["379", "34"]), ("MOTOR VEHICLE ACT", ["177"])]
    assert one(spark, text.sections(F.lit("no marker"))) == []
    with pytest.raises(Exception, match="unmapped stage: odd"):
        one(spark, text.stage(F.lit("odd")).getField("stage"))
    assert one(spark, text.normal_name(F.lit("J & Élan Police Station P.S"))) == "jandelanps".removesuffix("ps") + "ps"
    assert one(spark, text.edit_ratio(F.lit("Thilaknagar PS"), F.lit("Tilak Nagar"))) == pytest.approx(1 - 1 / 11)


def test_polygons(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    outer, hole = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
    at = lambda x, y: one(spark, geo.inside(F.lit(x), F.lit(y), F.array(outer, hole)))
    assert at(0.5, 0.5) and at(3.0, 3.0) and not at(1.5, 1.5) and not at(5.0, 1.0)
    assert one(spark, geo.area(outer)) == 16 and one(spark, F.size(geo.densified(outer, 1.0))) == 17
    centre = one(spark, geo.centre(geo.cell(F.lit(12.9), F.lit(77.5))))
    assert abs(centre.lat - 12.9) < 0.003 and abs(centre.lon - 77.5) < 0.003


def test_running_and_ranks(spark):
    store = Store(spark)
    df = spark.createDataFrame([(i, float(i * 7 % 13), "ab"[i % 2]) for i in range(100)], "k long, v double, g string")
    rows = running(df, [F.col("v"), F.col("k")], {"upto": F.col("v")}, store).orderBy("rank").collect()
    total = 0.0
    for place, r in enumerate(rows):
        total += r.v
        assert r.rank == place + 1 and r.upto == pytest.approx(total)
    store.close()
    for f in (0.0, 0.5, 0.9, 1.0):
        got = {r.g: r.q for r in relational.nearest_rank(df, ["g"], "v", f, "q").collect()}
        for g in "ab":
            values = sorted(float(i * 7 % 13) for i in range(100) if "ab"[i % 2] == g)
            assert got[g] == values[min(len(values) - 1, math.floor(f * len(values)))]


def test_patrol(spark):
    import pandas as pd

    cells = [f"{i}/{j}" for i in range(4) for j in range(4)]
    demand = pd.DataFrame([{"cell": c, "beat": c[0], "demand": (k * 37 % 11) + 1.0} for k, c in enumerate(cells)])
    near = lambda a, b: abs(int(a[0]) - int(b[0])) + abs(int(a[2]) - int(b[2])) <= 1
    scene = patrol.Scenario(demand, pd.DataFrame([{"origin": a, "dest": b} for a in cells for b in cells if near(a, b)]))

    def plain(positions):
        covered = {b for p in positions for b in cells if near(cells[p], b)}
        hit = sum(r.demand for r in demand.itertuples() if r.cell in covered)
        parts = sorted(sum(r.demand for r in demand.itertuples() if r.beat == x and r.cell in covered) / sum(r.demand for r in demand.itertuples() if r.beat == x) for x in "0123")
        g = 2 * sum((i + 1) * v for i, v in enumerate(parts)) / (4 * sum(parts)) - 5 / 4 if sum(parts) else 0
        return 400 * hit / demand["demand"].sum() + 150 * (1 - g)

    greedy = []
    for _ in range(3):
        greedy.append(max(range(16), key=lambda c: (round(plain([*greedy, c]), 9), -c)))
    best = patrol.optimise(scene, 3)
    assert scene.objective(best) == pytest.approx(plain(best)) and plain(best) >= plain(greedy) - 1e-9
    seconds = lambda a, b: 60.0 * (1 + abs(int(a[0]) - int(b[0])) * 10)
    log = patrol.simulate([(0, 5, "0/0"), (1, 5, "0/0"), (2, 5, "3/3"), (30, 5, "0/0")], {"u": "0/0", "v": "1/1"}, seconds)
    assert log == [("u", 1.0, "dispatched"), ("v", 11.0, "dispatched"), (None, None, "missed"), ("u", 1.0, "dispatched")]
    assert patrol.score(1.0, 1.0, [0.0], 5, 2, 2, 0.0)["total"] == 1000


def test_graphs(spark):
    store = Store(spark)
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "a long, b long")
    assert {r.node: r.betweenness for r in graph.betweenness(path, store).collect()} == {1: 0, 2: 2, 3: 2, 4: 0, 8: 0, 9: 0}
    got = sorted((r.node, r.hops) for r in graph.hops(path, spark.createDataFrame([(1,)], "node long"), 2, store).collect())
    assert got == [(1, 0), (2, 1), (3, 2)]
    clique = lambda first: [(first + i, first + j) for i in range(4) for j in range(i)]
    two = spark.createDataFrame([*clique(10), *clique(20), (10, 20), (40, 41)], "a long, b long")
    assert {r.node: r.community for r in graph.communities(two, store).collect()} == {**{10 + i: 10 for i in range(4)}, **{20 + i: 20 for i in range(4)}, 40: 40, 41: 40}
    store.close()


def test_checks_and_replay(spark):
    df = spark.createDataFrame([(1, 0), (2, 500), (3, 1000)], "k long, replay_offset_ms long")
    assert [r.k for r in visible(df, 500).collect()] == [1, 2]
    assert checks.must(df, F.col("k") > 0, "bad").count() == 3
    with pytest.raises(Exception, match="too small"):
        checks.must(df, F.col("k") > 1, "too small").collect()
    found = checks.drift(df, {"k": ("int", True, None), "gone": ("string", True, 5)}).collect()
    assert sorted((r.column_name, r.fault) for r in found) == [("gone", "missing"), ("k", "is bigint"), ("replay_offset_ms", "extra")]


def test_claims_are_those_of_one_after_the_other(spark):
    rows = [(i, 2000 + i % 2) for i in range(60)]
    draw = lambda i, probe: int.from_bytes(hashlib.md5(f"{i}|{probe}".encode()).digest()[:4], "big") % 40
    taken = {}
    for i, y in rows:
        taken[(y, next(s for s in (draw(i, p) for p in range(64)) if (y, s) not in taken))] = i
    df = spark.createDataFrame(rows, "id long, y int")
    slot = lambda probe: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "id", probe)), 1, 8), 16, 10).cast("long"), F.lit(40))
    assert {(r.y, r.slot): r.id for r in claims(df, slot, Store(spark)).collect()} == taken
    assert claims(df.limit(0), slot, Store(spark)).isEmpty()
    with pytest.raises(Exception, match="no free slot"):
        claims(df, lambda probe: F.lit(1).cast("long") + 0 * probe, Store(spark), probes=3).collect()


def test_crosswalk_tiers(spark):
    from wardline.plans.crosswalk import crosswalk

    units = [("t", "Alpha Beta PS", 3), ("t", "Alpha Beta Police Station", 2), ("t", "Beta Alpha", 1), ("t", "City Traffic PS", 9), ("t", "Gamma", 4), ("t", "Ruled", 1), ("t", "Zzz", 1), ("u", "Alone", 5), ("t", "Zzz", 1), ("t", None, 1)]
    stations = [("t", "1", "ALPHA BETA"), ("t", "2", "Beta-Alpha"), ("t", "3", "Delta Row"), ("t", "4", "Omega")]
    rules = spark.createDataFrame([("Ruled", True, "4")], "unit string, rule_territorial boolean, rule_code string")
    points = spark.createDataFrame([("t", "gamma ps", "3")], "territory string, name string, code string")
    df = lambda rows, s: spark.createDataFrame(rows, s)
    rows = crosswalk(df(units, "territory string, unit string, fir_count long"), df(stations, "territory string, code string, name string"), rules, points).collect()
    got = {(r.territory, r.unit): (r.station_code, r.tier, r.coverage, r.fir_count) for r in rows}
    assert got == {
        # The first by code points has the station; the next of the same name goes by words, and the third finds both gone.
        ("t", "Alpha Beta PS"): ("1", "normalized_exact", "mapped", 3),
        ("t", "Alpha Beta Police Station"): ("2", "token_set", "mapped", 2),
        ("t", "Beta Alpha"): (None, "UNRESOLVED", "outside_polygon_set", 1),
        ("t", "City Traffic PS"): (None, "non_territorial", "non_territorial", 9),
        ("t", "Gamma"): ("3", "point_in_polygon", "mapped", 4),
        ("t", "Ruled"): ("4", "override", "mapped", 1),
        ("t", "Zzz"): (None, "UNRESOLVED", "outside_polygon_set", 2),
        ("u", "Alone"): (None, "UNRESOLVED", "outside_polygon_set", 5),
    }
    assert len({r.row_code for r in rows}) == len(rows) and all(r.row_code.startswith("NT-") for r in rows if r.tier == "non_territorial")


def test_packing_takes_the_station_that_is_filled_least(spark):
    from wardline.plans.crosswalk import packed

    districts = [(f"d{i}", i * 7 % 11 + 1) for i in range(30)]
    quota = {"a": 10.0, "b": 20.0, "c": 20.0}
    rows = packed(spark.createDataFrame(districts, "district string, n long"), spark.createDataFrame(list(quota.items()), "code string, quota double"), hashing.SEED).collect()
    load = dict.fromkeys(quota, 0)
    given = {r.district: r.code for r in rows}
    for name, n in sorted(districts, key=lambda x: (-x[1], x[0])):
        assert (load[given[name]] + n) / quota[given[name]] == min((load[c] + n) / quota[c] for c in quota)
        load[given[name]] += n
    assert sum(load.values()) == sum(n for _, n in districts)


def test_hours_donors_and_scores(spark):
    from wardline.functions import travel

    hours = spark.range(-1, 25).select(F.col("id"), travel.band(F.col("id")).alias("b"), travel.multiplier(F.col("id")).alias("m")).collect()
    assert {r.id for r in hours if r.b == "morning_rush"} == {7, 8, 9} and {r.m for r in hours if r.b == "evening_rush"} == {3.3333} and hours[0].m == 2.6506
    assert one(spark, travel.clock_hour(F.lit(20), F.lit(359))) == 1
    crime = lambda s: tuple(one(spark, text.donor_crime(F.lit(s))))
    assert crime("Burglary from vehicle") == ("property_crime", "theft_from_vehicle") and crime("burglary") == ("property_crime", "burglary")
    assert crime("PETTY odd (x), $950 & over") == ("other_incident", "odd_x") and crime(None) == ("other_incident", "other")
    assert one(spark, text.donor_category(F.lit("Cyber"), F.lit("theft"))) is None and one(spark, text.donor_category(F.lit(None), F.lit("theft"))) == "property_crime"
    assert tuple(one(spark, text.donor_premise(F.lit("")))) == ("unknown", "built_other") and one(spark, text.donor_weapon(F.lit("big stick"))) == "blunt_object"
    assert one(spark, text.donor_status(F.lit("ZZ"))) is None and one(spark, text.donor_sex(F.lit("ZZ"))) == "other_or_unknown"
    df = lambda rows, s: spark.createDataFrame(rows, s)
    demand = df([("s", "a", "x", 3.0), ("s", "b", "y", 1.0)], "scenario string, cell string, beat string, demand double")
    times = df([("s", p, q, 0.0 if p == q else 600.0) for p in "ab" for q in "ab"], "scenario string, origin string, dest string, seconds double")
    posts = df([("s", "u", "b", "a"), ("s", "v", "b", None)], "scenario string, unit string, start string, cell string")
    events = df([("s", "a", 0), ("s", "b", 0)], "scenario string, cell string, minute long")
    got = patrol.scores(demand, times, posts, events, 5.0, 1, 8, rain=True).first()
    slow = 10 * 1.35 * math.floor(44 / 14.6 * 1e4 + 0.5) / 1e4
    assert (got.coverage, got.equity, got.reserve, got.km) == (0.75, 0.5, 1, pytest.approx(4.002)) and got.p50 == got.p90 == pytest.approx(slow)
    assert got.total == math.floor(300 + 0 + 75 + 100 + 100 * (1 - 4.002 / 80) + 0.5) and got.grade == "Bronze"
