"""Paths, communities, hexagons, areas, resolution, entities, regions, hours and streams, against plain Python."""

import datetime
import hashlib
import math
import random
from collections import defaultdict, deque
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.functions import hexes
from wardline.functions.stats import count_quantile
from wardline.operators import boundaries, graph
from wardline.operators.relational import tree_digest
from wardline.plans import baselines, entities, hours, regions, resolve
from wardline.sources.scratch import Store
from wardline.streaming import streams


def quantile(mean, r, q):
    """By the logarithms of all terms, in wide numbers."""
    k = np.arange(1, int(mean * 12 + 2000), dtype=np.longdouble)
    if math.isinf(r):
        first, step = -np.longdouble(mean), np.log(np.longdouble(mean)) - np.log(k)
    else:
        wide = np.longdouble(r)
        first, step = wide * np.log(wide / (wide + mean)), np.log(k - 1 + wide) - np.log(k) + np.log(mean / (wide + mean))
    return int(np.searchsorted(np.cumsum(np.exp(np.concatenate([[first], first + np.cumsum(step)]))), np.longdouble(q)))


def test_quantiles_of_large_means():
    for mean, r in ((599, math.inf), (601, math.inf), (800, 1e5), (601, 5.0), (9990, math.inf), (12345.6, 0.9), (1e6, math.inf), (1e6, 10.0)):
        assert count_quantile(mean, r, 0.99) == quantile(mean, r, 0.99)
        assert count_quantile(mean, r, 0.5) == quantile(mean, r, 0.5)


def test_baselines_of_one_series(spark):
    weeks = [3, 0, 7, 1, 0, 0, 12, 2]
    day = datetime.date(2020, 1, 6)
    rows = [("s", "h", day + timedelta(days=7 * i + j % 7)) for i, n in enumerate(weeks) for j in range(n)]
    got = baselines.moments(spark.createDataFrame(rows, "station string, head string, registered_on date")).orderBy("week_start").collect()
    mean, ewma = sum(weeks) / len(weeks), None
    for i, (n, row) in enumerate(zip(weeks, got)):
        season = n / mean  # each week of the year once
        assert row.fir_count == n and row.expected_count == pytest.approx((ewma or 0.0) * season)
        ewma = float(n) if i == 0 else 0.25 * n + 0.75 * ewma
        assert row.ewma == pytest.approx(ewma)
    assert baselines.alerts(spark.createDataFrame([(4, 0), (5, 4), (6, 6)], "fir_count long, ucl_99 long")).count() == 1


def plain_path(edges, start, end, allowed):
    near = defaultdict(list)
    for a, b, e in sorted(edges, key=lambda x: x[2]):
        if a in allowed and b in allowed and a != b:
            near[a].append((b, e))
            near[b].append((a, e))
    parent, queue = {start: None}, deque([start])
    while queue:
        at = queue.popleft()
        for to, e in near[at]:
            if to not in parent:
                parent[to] = (at, e)
                queue.append(to)
    if end not in parent or start not in allowed:
        return []
    steps = [(end, parent[end] and parent[end][1])]
    while parent[steps[-1][0]]:
        at = parent[steps[-1][0]][0]
        steps.append((at, parent[at] and parent[at][1]))
    return [(k, node, e) for k, (node, e) in enumerate(reversed(steps))]


def test_shortest_paths_are_those_of_a_search_in_edge_order(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40), i) for i in range(70)]
    rng.shuffle(edges)
    pairs = [(rng.randrange(40), rng.randrange(44)) for _ in range(25)] + [(3, 3)]
    allowed = set(range(44)) - {5, 17, 30}
    store = Store(spark)
    df = spark.createDataFrame(edges, "a long, b long, edge long")
    got = defaultdict(list)
    for r in graph.shortest_paths(df, spark.createDataFrame(pairs, "start long, end long"), store, spark.createDataFrame([(x,) for x in allowed], "node long")).collect():
        got[r.start, r.end].append((r.step, r.node, r.edge))
    for a, b in set(pairs):
        assert sorted(got[a, b]) == (plain_path(edges, a, b, allowed) if a in allowed and b in allowed else [])
    store.close()


def test_communities_are_as_good_as_a_plain_run(spark):
    rng = random.Random(6)
    group = lambda x: x // 12
    edges = [(a, b) for a in range(60) for b in range(a) if rng.random() < (0.5 if group(a) == group(b) else 0.02)]
    store = Store(spark)
    df = spark.createDataFrame(edges, "a long, b long")
    member = store.cut(graph.communities(df, store), "member")
    links = df.withColumn("w", F.lit(1.0))
    found = graph.modularity(links, member).first()[0]
    planted = graph.modularity(links, spark.createDataFrame([(x, group(x)) for x in range(60)], "node long, community long")).first()[0]
    m, degree = len(edges), defaultdict(int)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    plain = sum(group(a) == group(b) for a, b in edges) / m - sum(sum(degree[x] for x in range(60) if group(x) == g) ** 2 for g in range(5)) / (4 * m * m)
    assert planted == pytest.approx(plain) and found >= 0.98 * planted
    again = graph.communities(df.repartition(3), store)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in member.collect()}
    store.close()


def test_hexagons(spark):
    rng = random.Random(1)
    points = [(12.71 + rng.random() * 0.4, 77.36 + rng.random() * 0.4) for _ in range(400)]
    rows = spark.createDataFrame(points, "lat double, lon double").withColumn("cell", hexes.cell(F.col("lat"), F.col("lon"), 8)).withColumn("at", hexes.centre(F.col("cell"))).withColumn("back", hexes.cell(F.col("at.lat"), F.col("at.lon"), 8)).withColumn("ring", hexes.disk(F.col("cell"), 1)).collect()
    far = lambda a, b, c, d: math.hypot((b - d) * hexes.KM_EAST, (a - c) * hexes.KM_NORTH)
    centres = {r.cell: r["at"] for r in rows}
    for r in rows:
        assert r.back == r.cell and len(set(r.ring)) == 7 and r.ring[0] == r.cell
        own = far(r.lat, r.lon, r["at"].lat, r["at"].lon)
        assert own <= hexes.EDGES_KM[8] + 1e-9 and all(own <= far(r.lat, r.lon, c.lat, c.lon) + 1e-9 for c in centres.values())
    q, r = map(int, rows[0].cell.split("/")[1:])
    around = [c.split("/")[1:] for c in rows[0].ring[1:]]
    step = {round(far(a.lat, a.lon, rows[0]["at"].lat, rows[0]["at"].lon), 6) for a in [spark.range(1).select(hexes.centre(F.lit(f"h8/{x}/{y}")).alias("c")).first().c for x, y in around]}
    assert step == {round(hexes.EDGES_KM[8] * math.sqrt(3), 6)}
    square = [[(77.4, 12.8), (77.5, 12.8), (77.5, 12.9), (77.4, 12.9), (77.4, 12.8)]]
    area = spark.createDataFrame([("s", square)], "k string, rings array<array<struct<x: double, y: double>>>")
    cover = {c.cell for c in hexes.cover(area, "rings", 9, "k").collect()}
    side = 3 * math.sqrt(3) / 2 * hexes.EDGES_KM[9] ** 2
    assert len(cover) * side == pytest.approx(0.01 * hexes.KM_EAST * hexes.KM_NORTH, rel=0.03)
    assert hexes.buffered(hexes.cover(area, "rings", 9, "k"), 1).count() > len(cover)


def square(x, y, side):
    return [[(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]]


RINGS = "array<array<struct<x: double, y: double>>>"


def test_areas_meet_and_incidents_are_resolved(spark):
    areas = spark.createDataFrame([(1, square(77.4, 12.8, 0.02)), (2, square(77.42, 12.8, 0.02)), (3, square(77.5, 12.8, 0.02))], f"code int, rings {RINGS}")
    assert {tuple(r) for r in boundaries.adjacency(areas).collect()} == {(1, 2)}
    gaps = {(r.a, r.b): r.km for r in boundaries.distances(boundaries.boundary(areas, 0.01), 8.0).collect()}
    assert gaps[1, 2] == pytest.approx(0, abs=1e-6) and gaps[2, 3] == pytest.approx(0.06 * hexes.KM_NORTH * math.cos(math.radians(12.81)), rel=1e-3)
    rows = [(1, 1, "a", 12.81, 77.41), (2, 1, "a", 12.81, 77.43), (3, 1, "a", 12.81, 77.51), (4, 1, "b", None, None), (5, 9, "a", 12.81, 77.41), (6, 9, "a", 0.0, 0.0), (7, 3, "a", None, None), (8, 2, None, float("nan"), 77.4)]
    anchors = [(1, "a", 10, 12.805, 77.405), (1, "b", 11, 12.806, 77.406), (1, "b", 12, 12.807, 77.407), (2, "c", 13, 12.8, 77.42)]
    store = Store(spark)
    out = resolve.resolve(spark.createDataFrame(rows, "incident_id long, code int, premise string, lat double, lon double"), areas, spark.createDataFrame(anchors, "code int, kind string, anchor_id long, lat double, lon double"), store).collect()
    got = {r.incident_id: r for r in out}
    said = {k: (r.origin, r.method.split("_")[-1], r.polygon_verified, r.pin_eligible) for k, r in got.items()}
    assert said[1] == ("reported", "polygon", True, True) and said[2] == ("reported_corrected", "polygon", True, True) and got[2].lon == 77.43
    assert got[3].anchor_id == 10 and said[3] == ("inferred", "v1", False, False) and got[4].anchor_id in (11, 12)
    assert said[5] == ("reported", "unverified", False, True) and said[6] == ("unlocatable", "coordinate", False, False) and said[7] == ("unlocatable", "available", False, False)
    assert got[8].anchor_id == 13 and len(out) == len(rows)
    store.close()


def test_entities_have_no_orphans(spark):
    rows = [("s", i, f"case {i}") for i in range(45)] + [("t", 100, "case 100")]
    counts = spark.createDataFrame([("s", 2, 1, 0, 1), ("t", 1, 0, 0, 0)], "scenario string, person int, vehicle int, phone int, account int")
    store = Store(spark)
    nodes, edges = entities.build(spark.createDataFrame(rows, "scenario string, incident_id long, label string"), counts, ["incident_id"], store)
    by = {r.relation: r["count"] for r in edges.groupBy("relation").count().collect()}
    assert by == {"USED_VEHICLE": 6, "CONTROLS": 6, "CO_ACCUSED_WITH": 2, "ACCUSED_IN": 46, "SIMILAR_TO": 42}
    assert nodes.count() == 46 + 3 * 4 + 1 and entities.orphans(nodes, edges).isEmpty()
    assert nodes.select("id").distinct().count() == nodes.count() and edges.select("id").distinct().count() == edges.count()
    assert entities.orphans(nodes.filter("type <> 'person'"), edges).count() == 6 + 6 + 2 * 2 + 46
    store.close()


def test_regions_cover_and_samples_are_the_first_pairs(spark):
    areas = spark.createDataFrame([(c, square(77.4 + 0.02 * c, 12.8, 0.02)) for c in range(5)], f"code int, rings {RINGS}")
    near = spark.createDataFrame([(c, c + 1) for c in range(4)], "a int, b int")
    plan = regions.plan(spark.createDataFrame([("r", "regional", 2, 1)], "region string, tier string, buffer int, anchor int"), areas, near)
    got = {(r.region, r.code) for r in plan.collect()}
    assert got == {("r", 0), ("r", 1), ("r", 2), ("local_0", 0), ("local_2", 2), ("local_3", 3), ("local_4", 4)} and regions.uncovered(plan, areas).isEmpty()
    assert [r.code for r in regions.uncovered(plan.filter("code <> 3"), areas).collect()] == [3]
    store = Store(spark)
    pairs = {(r["from"], r["to"]) for r in regions.sample(spark.createDataFrame([("x", 4)], "region string, n long"), 40, store).collect()}
    assert pairs == {(a, b) for a in range(4) for b in range(4) if a != b}
    store.close()


def test_hours_fall_back(spark):
    donors = [("a", "outdoor", 1, 5)] * 3 + [("a", "transit", 2, 6), ("b", "transit", 3, 7)]
    levels = hours.counts(spark.createDataFrame(donors, "category string, premise string, weekday int, hour int"))
    rows = hours.profiles(spark.createDataFrame([("x", "a"), ("y", "c"), ("z", None)], "head string, category string"), levels).collect()
    got = {(r.head, r.premise, r.weekday): r for r in rows}
    assert len(rows) == 3 * 7 * 7 and got["x", "intersection", 1].level == "category_premise_weekday" and got["x", "transit", 1].level == "category_weekday"
    assert got["x", "transit", 6].level == "category" and got["y", "outdoor", 1].level == "marginal" and got["z", "outdoor", 1].shares is None
    assert all(sum(r.shares) == pytest.approx(1) for r in rows if r.shares) and got["x", "outdoor", 1].shares[5] == pytest.approx((3 + 48 * 3 / 5) / 51)


def test_a_digest_knows_order_and_change(spark):
    rows = [(i, f"row {i}") for i in range(250)]
    digest = lambda rows: tree_digest(spark.createDataFrame(rows, "key long, said string"), 10, 2).first().digest
    sha = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    ones = [sha(s for _, s in rows[i : i + 10]) for i in range(0, 250, 10)]
    assert digest(rows[::-1]) == digest(rows) == sha([sha(ones[:10]), sha(ones[10:20]), sha(ones[20:])])
    rows[7], rows[8] = (7, "row 8"), (8, "row 7")
    assert digest(rows) != sha([sha(ones[:10]), sha(ones[10:20]), sha(ones[20:])])


def test_depths_and_cycles(spark):
    store = Store(spark)
    chain = [(f"n{i}", f"n{i + 1}") for i in range(25)] + [("n0", "n25"), ("x", "n25")]
    got = {r.node: r.depth for r in graph.longest_depths(spark.createDataFrame(chain, "source string, target string"), store).collect()}
    assert got["n25"] == 25 and got["x"] == 0
    with pytest.raises(ValueError, match="cycle"):
        graph.longest_depths(spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string"), store)
    store.close()


def test_streams_say_what_the_batch_says_in_any_order(spark):
    rng = random.Random(9)
    began = datetime.datetime(2024, 1, 1)
    rows = [(i, began + timedelta(hours=rng.randrange(24 * 60)), i % 7, rng.choice("ab")) for i in range(400)]
    rows = [(*r, r[1] + timedelta(hours=rng.randrange(60))) for r in rows]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "click_id long, ts timestamp, client_id long, kind string, arrived_at timestamp")
    want = {(r.kind, r.week, r.n) for r in df.dropDuplicates(["click_id"]).groupBy("kind", streams.week_of(F.col("ts")).alias("week")).agg(F.count("*").alias("n")).collect()}
    store = Store(spark)
    in_order = streams.arrive(df, F.floor(F.datediff("arrived_at", F.lit("2024-01-01")) / 22), streams.weekly, store, "weekly")
    shuffled = streams.arrive(df, F.pmod(F.xxhash64("click_id"), F.lit(3)), lambda r: streams.weekly(r, "90 days"), store, "shuffled")
    for got in (in_order, shuffled):
        assert {tuple(r) for r in got.collect()} == want
    # What is over leaves the state: far fewer rows than ids and weeks were seen.
    assert in_order.state_rows < shuffled.state_rows
    store.close()


def test_keys_come_again_when_they_have_expired(spark):
    df = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1 + i), "k", i) for i in range(3)], "click_id long, ts timestamp, kind string, part long")
    store = Store(spark)
    key = lambda ttl: lambda rows: streams.first_seen(rows.select(F.col("kind").alias("key"), "kind"), ttl)
    held = streams.arrive(df, F.col("part"), key(timedelta(days=1)), store, "held", False).count()
    gone = streams.arrive(df, F.col("part"), key(timedelta(milliseconds=1)), store, "gone", False).count()
    assert held == 1 and gone == 3
    store.close()


def test_a_query_that_fails_leaves_nothing(spark):
    from wardline.sources import scratch

    @scratch.tidy
    def query(spark, d):
        store = Store(spark)
        store.cut(spark.range(3), "first")
        return store.cut(spark.range(3).select(F.raise_error(F.lit("no"))), "second")

    before = set(scratch.made)
    with pytest.raises(Exception, match="no"):
        query(spark, "")
    assert scratch.made == before
