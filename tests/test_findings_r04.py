"""Cases of the fourth round's findings."""

from __future__ import annotations

from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_names_are_ranked_as_if_all_pairs_were_scored(spark, tmp_path):
    """F2: keys were taken of names where words are asked for, an error; and all pairs that share a frequent word were scored."""
    import random

    import duckdb

    from wardline.functions import text as T
    from wardline.queries import QUERIES, SQL

    # Words of 4 to 8 letters that begin alike, frequent ones, and names of one to four of them.
    words = ["anna", "maezg", "maezgu", "maezguor", "maezgulin", "maezgi", "street", "streets", "lo", "m"]
    draw = random.Random(4)
    names = [(" ".join(draw.choices(words, k=1 + i % 4)).title() + " " * (i % 3 == 0),) for i in range(240)]
    for table, part in (("clients", names[::2] + [(None,), ("police",), ("",)]), ("vendors", names[1::2] + names[:20] + [(None,)])):
        spark.createDataFrame(part, "name string").write.parquet(f"{tmp_path}/{table}.parquet")
    found = QUERIES["join_fuzzy_token_set"](spark, str(tmp_path))
    said = duckdb.connect()
    for table in ("clients", "vendors"):
        said.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    rows = said.execute(SQL["join_fuzzy_token_set"]).fetchall()
    plain = lambda some: sorted((r[0], r[1], round(r[2], 9), round(r[3], 8)) for r in some)
    assert len(rows) > 100 and plain(found.collect()) == plain(rows)
    # A key is given by whom it is asked for: five letters and a longer word, either way.
    keys = lambda name, asked: F.array_distinct(F.flatten(T.name_keys(T.name_words(F.lit(name)), asked)))
    meet = lambda a, b: F.arrays_overlap(keys(a, True), keys(b, False))
    assert tuple(spark.range(1).select(meet("maezg", "maezguor"), meet("maezguor", "maezg"), meet("maezguor", "maezgulin"), meet("maezguor", "maezgi"), meet("anna", "annabel")).first()) == (True, True, True, False, False)


def test_links_stay_where_they_are(spark, monkeypatch):
    """each round of a search moved all links again, and all at once; now they are dealt out once and read by slices of nodes."""
    import random

    from pyspark.sql import DataFrame
    from test_graphs_and_places import plain_path
    from wardline.operators import graph
    from wardline.sources.scratch import Store

    draw, plans, cut = random.Random(14), [], Store.cut

    def planned(self, df: DataFrame, name, by=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return cut(self, df, name, by)

    monkeypatch.setattr(Store, "cut", planned)
    # Repeated links, some in both directions, and links to oneself.
    edges = [(draw.randrange(60), draw.randrange(60), i) for i in range(260)] + [(200, 201, 900)]
    df = spark.createDataFrame(edges, "a long, b long, edge long")
    starts, ends = spark.createDataFrame([(s,) for s in (*range(0, 60, 9), 200)], "start long"), spark.createDataFrame([(e,) for e in (3, 17, 45, 201, 999)], "end long")
    everywhere = {x for e in edges for x in e[:2]}
    store = Store(spark)
    monkeypatch.setattr(graph, "LINKS", 150)
    rows = graph.shortest_paths(df, starts, store, ends=ends).collect()
    near = [tuple(r) for r in graph.hops(df, starts.withColumnRenamed("start", "node"), 2, store).collect()]
    beside = lambda some: some | {b for e in edges for a, b in (e[:2], e[1::-1]) if a in some}
    within = [(s, once, beside(once)) for s in (*range(0, 60, 9), 200) for once in (beside({s}),)]
    assert sorted(near) == sorted((s, n, 0 if n == s else 1 if n in once else 2) for s, once, twice in within for n in twice)
    got = {}
    for start, end, step, node, edge in rows:
        got.setdefault((start, end), []).append((step, node, edge))
    want = {(s, e): plain_path(edges, s, e, everywhere) for s in (*range(0, 60, 9), 200) for e in (3, 17, 45, 201) if (s == 200) == (e == 201)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    # Links come out of their buckets, straight into the joins of the rounds.
    rounds = [p for name, p in plans if name in ("reached", "level") and "Join" in p]
    assert len(rounds) > 4 and all("Bucketed: true" in p for p in rounds)
    store.close()


def test_hops_are_not_written_out(spark, monkeypatch):
    """a row for each seed and node it reaches was written to the shared folder before it was returned."""
    from wardline.queries import QUERIES
    from wardline.sources.scratch import Store

    rows, cut = [], Store.cut

    def counted(self, df, name, by=None):
        out = cut(self, df, name, by)
        rows.append(out.count())
        return out

    monkeypatch.setattr(Store, "cut", counted)
    found = QUERIES["khop"](spark, "/root/testdata/sf0.01")
    assert max(rows) * 2 < found.count()
