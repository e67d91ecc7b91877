"""Cases of the third round's findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import geo
from wardline.functions import text as T
from wardline.queries import domain, territories

FOLDER = "/root/testdata/sf0.001"


def test_box_corners_are_whole_decimals(spark):
    """sums of doubles missed corners by their last digit, and with them points on a side."""
    rows = {r.code: (r.x0, r.y0) for r in domain._boxes(spark, FOLDER).collect()}
    assert rows == {k: (float(f"{77.37 + k // 5 * 0.09:.2f}"), float(f"{12.72 + k % 5 * 0.09:.2f}")) for k in range(25)}
    ring = domain._boxes(spark, FOLDER).filter("code = 20").select(geo.inside(F.lit(77.73), F.lit(12.75), F.col("rings")).alias("low"), geo.inside(F.lit(77.83), F.lit(12.75), F.col("rings")).alias("high"))
    assert tuple(ring.first()) == (True, False)


def test_one_hot_works_its_slots_out_once(spark):
    """slots in the body of a lambda were worked out for each of its elements."""
    plan = spark.range(1).select(T.one_hot(F.transform(F.array("id"), lambda x: F.hash(x).cast("long") % 32), 32).alias("bits"))._jdf.queryExecution().analyzed().toString()
    assert plan.index("hash(") < plan.index("sequence(")
    rows = spark.range(3).select("id", T.one_hot(F.array("id", F.col("id") + 2), 6).alias("x")).collect()
    assert [r.x for r in rows] == [[float(i in (r.id, r.id + 2)) for i in range(6)] for r in rows]


def test_words_are_looked_for_before_edges(spark):
    """the guarded match says what the pattern alone says."""
    rules = [r[0] for r in T.CRIMES] + [rf"\b(?:{r[0]})\b" for r in (*T.CATEGORIES, *T.DONOR_PREMISES, *T.DONOR_WEAPONS)]
    said = ["A VEHICLE WAS STOLEN", "STOLEN\nVEHICLE", "XVEHICLE STOLEN", "BARS AND A BAR", "LETTERS, LEWD", "PICKPOCKETS", "", "KIDNAPPED IN A GAS STATION", "BEASTIALITY AND A CRM AGNST CHLD", "ÄBAR BARÄ"]
    said += [w for r in rules for w in r.replace(r"\b", "").replace("(?:", "").replace(")", "").replace(".*", " ").split("|")]
    rows = spark.createDataFrame([(x,) for x in said], "x string")
    differ = [F.count_if(T.has(F.col("x"), r) != F.col("x").rlike(T.edged(r))).alias(f"c{i}") for i, r in enumerate(rules)]
    assert set(rows.agg(*differ).first()) == {0}
    plan = rows.select(T.has(F.col("x"), rules[0]))._jdf.queryExecution().analyzed().toString()
    assert plan.index("HOMICIDE") < plan.index("RLIKE")


def test_fuzzy_names_carry_their_words(spark):
    """words were worked out again for each pair, twice for each word."""
    assert "regexp_replace" not in spark.createDataFrame([(["a"], ["a"])], "x array<string>, y array<string>").select(T.words_ratio(F.col("x"), F.col("y")))._jdf.queryExecution().analyzed().toString()


def test_no_label_meets_in_one_task(spark):
    """Blocks are bounded, and all scores are worked out; ties go to the least id, a null vector has no score."""
    from wardline.operators import similar

    rows = [(i, i % 2, [float(i % 7), 1.0] if i != 9 else None) for i in range(60)] + [(100, None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<float>")
    sizes = similar.TARGETS, similar.VECTORS
    similar.TARGETS, similar.VECTORS = 2, 7
    try:
        cosines, matrix = similar.cosines, similar.matrix
        found = similar.nearest(df, "id % 5 = 0", lambda x, y: (cosines(matrix(x["embedding"]), matrix(y["embedding"])).round(6),), 4).collect()
    finally:
        similar.TARGETS, similar.VECTORS = sizes
    cos = lambda a, b: round(sum(p * q for p, q in zip(a, b)) / (sum(p * p for p in a) * sum(q * q for q in b)) ** 0.5, 6)
    for t in range(0, 60, 5):
        said = sorted((-cos(rows[t][2], v), i) for i, label, v in rows if v and label == t % 2 and i != t)[:4]
        assert [(r.candidate, r.r) for r in sorted(found, key=lambda r: r.r) if r.target == t] == [(i, k + 1) for k, (_, i) in enumerate(said)]


def test_betweenness_by_classes_of_twins(spark):
    """nodes with the same neighbours count as one; values are those of all sources one by one."""
    from wardline.operators import graph
    from wardline.sources.scratch import Store

    links = [(h, 10 + i) for h in (0, 1) for i in range(4)] + [(0, 20 + i) for i in range(3)] + [(1, 2), (2, 3), (3, 4), (4, 30), (4, 31), (3, 30), (50, 51)]
    edges = spark.createDataFrame(links, "a long, b long")
    store = Store(spark)
    nodes = sorted({x for e in links for x in e})
    slow = {r.node: r.betweenness for r in graph.betweenness(edges, store, spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    fast = {r.node: r.betweenness for r in graph.betweenness(edges, store).collect()}
    assert sorted(fast) == nodes and all(abs(fast[n] - slow[n]) < 1e-9 for n in nodes)
    assert graph.twins(graph.undirected(edges)).select("of").distinct().count() < len(nodes)
    store.close()


def test_nearest_points_of_dense_and_lone_ones(spark):
    """cells are as small as points are dense, so that a dense place isn't compared with all of itself."""
    import random

    from wardline.operators.near import nearest_points
    from wardline.sources.scratch import Store

    draw = random.Random(3)
    at = [(i, round(12.9 + draw.random() * 0.004, 6), round(77.5 + draw.random() * 0.004, 6)) for i in range(600)]
    at += [(600 + i, round(12.7 + draw.random() * 0.1, 6), round(77.4 + draw.random() * 0.1, 6)) for i in range(200)] + [(900, 12.9, 77.5), (901, 12.9, 77.5), (905, 10.0, 70.0)]
    store = Store(spark)
    found = {r.id: (r.near, r.d) for r in nearest_points(spark.createDataFrame(at, "id long, lat double, lon double"), "id % 5 = 0", 0.01, 0.0002, store).collect()}
    cell = lambda x: int(x // 0.01)
    want = {}
    for i, y, x in at:
        if i % 5 == 0:
            near = [((y - v) ** 2 + (x - u) ** 2, k) for k, v, u in at if k != i and abs(cell(y) - cell(v)) <= 1 and abs(cell(x) - cell(u)) <= 1]
            if near and min(near)[0] <= 0.0002:
                want[i] = min(near)[1]
    assert {k: v[0] for k, v in found.items()} == want and 905 not in found
    store.close()


def test_hops_of_many_seeds(spark):
    """seeds go 64 to a row, whatever bit is theirs; a row for each seed, node and link before the distinct was what filled the disk."""
    from wardline.operators import graph
    from wardline.sources.scratch import Store

    links = [(i, (i * 7 + 3) % 150) for i in range(150)] + [(i, i + 1) for i in range(0, 148, 5)] + [(500, 501)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for seed in [*range(140), 500]:
        found, front = {seed: 0}, {seed}
        for k in (1, 2, 3):
            front = {b for a in front for b in near[a] if b not in found}
            found |= dict.fromkeys(front, k)
        want |= {(seed, n, k) for n, k in found.items()}
    store = Store(spark)
    seeds = spark.createDataFrame([(s,) for s in [*range(140), 500]], "node long")
    got = graph.hops(spark.createDataFrame(links, "a long, b long"), seeds, 3, store).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    store.close()


def test_rows_a_whole_gap_apart_are_two_sessions(spark):
    """windows that only touch were merged, so rows six hours apart to the microsecond were one session; the SQL asks for less than six hours."""
    from datetime import datetime, timedelta

    from wardline.sources.scratch import Store
    from wardline.streaming import streams

    began, gap, little = datetime(2024, 1, 1, 0, 0, 0, 7), timedelta(hours=6), timedelta(microseconds=1)
    apart = {1: gap, 2: gap - little, 3: gap + little}
    # Both rows in one part, and each in its own.
    rows = [(10 * c + 100 * later + k, began + k * apart[c], c + 10 * later, "view", began + timedelta(days=1 + k * later)) for later in (0, 1) for c in apart for k in (0, 1)]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp, client_id long, kind string, arrived_at timestamp")
    found = streams.arrive(clicks, F.datediff("arrived_at", F.lit("2024-01-01")), streams.sessions, Store(spark), "gaps").collect()
    want = [(c + 10 * later, t, n) for later in (0, 1) for c, a in apart.items() for t, n in ([(began, 2)] if a < gap else [(began, 1), (began + a, 1)])]
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_points_on_the_cut_corner_lie_as_the_sql_says(spark):
    """crossings of a ray and the SQL's sum round differently for points on the slanted side."""
    import duckdb

    from wardline.operators.boundaries import containing

    x0, y0 = lambda k: 77.37 + k // 5 * 0.09, lambda k: 12.72 + k % 5 * 0.09
    slanted = [(k, round(x0(k) + 0.054 + i * 0.0009, 6), round(y0(k) + 0.09 - i * 0.0009, 6)) for k in range(0, 22, 3) for i in range(1, 40)]
    around = [(k, round(x + dx, 6), round(y + dy, 6)) for k, x, y in slanted[::7] for dx, dy in ((1e-6, 0.0), (-1e-6, 0.0), (0.0, 1e-6), (0.03, 0.0), (-0.05, -0.03))]
    sides = [(k, x, y) for k in range(22) for x in (round(x0(k), 6), round(x0(k) + 0.04, 6), round(x0(k) + 0.09, 6)) for y in (round(y0(k), 6), round(y0(k) + 0.02, 6), round(y0(k) + 0.09, 6))]
    points = spark.createDataFrame([(i, y, x) for i, (_, x, y) in enumerate(slanted + around + sides)], "id long, lat double, lon double")
    found = containing(points, territories._shapes(spark, FOLDER), border=territories._lies(F.col("lon"), F.col("lat"))).collect()
    rows = ", ".join(f"({r.id}, {r.lat!r}::DOUBLE, {r.lon!r}::DOUBLE)" for r in points.collect())
    shapes = territories._AREAS.replace("FROM nation", f"FROM '{FOLDER}/nation.parquet'")
    said = duckdb.sql(f"SELECT id, code FROM (VALUES {rows}) p(id, lat, lon), ({shapes}) WHERE {territories._INSIDE.format(x='lon', y='lat')}").fetchall()
    assert sorted(map(tuple, found)) == sorted(said)
    plain = containing(points, territories.areas(spark, FOLDER)).collect()
    assert 0 < len(set(map(tuple, plain)) ^ set(said)) <= len(slanted)


def test_paths_are_sought_towards_their_ends_only(spark, monkeypatch):
    """every start walked over all of the graph, a row for each start and link; now only what lies on a shortest path to an end has rows of its own."""
    import random

    from test_graphs_and_places import plain_path
    from wardline.operators import graph
    from wardline.sources.scratch import Store

    draw, rows, cut = random.Random(7), [], Store.cut

    def counted(self, df, name, by=None):
        out = cut(self, df, name, by)
        rows.extend([out.count()] if name == "front" else [])
        return out

    monkeypatch.setattr(Store, "cut", counted)
    # 70 starts, more than a word has bits, and 200 nodes that all of them reach.
    links = [(s, 1000 + n) for n in range(200) for s in draw.sample(range(70), 20)] + [(1003, 2000), (1004, 2000), (2000, 2001)]
    edges = [(a, b, i) for i, (a, b) in enumerate(draw.sample(links, len(links)))]
    starts, ends = spark.createDataFrame([(s,) for s in range(70)], "start long"), spark.createDataFrame([(e,) for e in (1003, 2001, 5, 7777)], "end long")
    store = Store(spark)
    df, everywhere = spark.createDataFrame(edges, "a long, b long, edge long"), {x for e in edges for x in e[:2]}
    got = {}
    for r in graph.shortest_paths(df, starts.crossJoin(ends), store).collect():
        got.setdefault((r.start, r.end), []).append((r.step, r.node, r.edge))
    assert {k: sorted(v) for k, v in got.items()} == {(s, e): plain_path(edges, s, e, everywhere) for s in range(70) for e in (1003, 2001, 5)}
    # Before, 70 times some 270 nodes and more.
    assert sum(rows) < 70 * 200
    alike = graph.shortest_paths(df, starts, store, ends=ends)
    assert {tuple(r) for r in alike.collect()} == {(*k, *x) for k, v in got.items() for x in v}
    store.close()


def test_rounds_of_communities_broadcast_nothing(spark, monkeypatch):
    """tables that grow with the graph were broadcast in every round while they were small enough, and added up at the driver."""
    from wardline.operators import graph
    from wardline.sources.scratch import Store

    plans, cut = [], Store.cut

    def planned(self, df, name, by=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(self, df, name, by)

    monkeypatch.setattr(Store, "cut", planned)
    edges = [(10 + i, 10 + j) for i in range(4) for j in range(i)] + [(20 + i, 20 + j) for i in range(4) for j in range(i)] + [(13, 20)]
    store = Store(spark)
    member = graph.communities(spark.createDataFrame(edges, "a long, b long"), store, rounds=2, most_levels=1)
    value = graph.modularity(spark.createDataFrame([(*e, 1.0) for e in edges], "a long, b long, w double"), member)
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (member, value)]
    assert sum("Join" in p for p in plans) > 3 and not [p for p in plans if "Broadcast" in p]
    store.close()
