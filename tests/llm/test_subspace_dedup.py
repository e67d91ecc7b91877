import numpy as np

from wardline.llm.subspace_dedup import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def brute(rows, threshold):
    usable = {}
    for k, (i, v, label, _) in enumerate(rows):
        if v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            usable[k] = (label, x / np.linalg.norm(x))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in usable:
        for b in usable:
            if a < b and usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1]) and usable[a][1] @ usable[b][1] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted((r[0], links[k], least[find(k)], least[find(k)] == r[0]) for k, r in enumerate(rows))


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in near_duplicates(df, **more).select("vec_id", "n_links", "component_id", "kept").collect())


def made(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 64))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.standard_normal(64) * rng.choice([0.02, 0.1, 0.15, 0.4])
        rows.append((1000 - i, [float(x) for x in v.astype(np.float32)], int(rng.integers(2)), "x"))
    for i in range(25):
        rows.append((5000 + i, rows[3][1], rows[3][2], None))
    return rows


def test_links_of_clusters_and_copies(spark):
    rows = made(220, 1)
    want = brute(rows, 0.98)
    assert sum(x[1] for x in want) > 500
    assert run(spark, rows) == want


def test_large_cells_are_split(spark):
    rows = made(150, 2)
    assert run(spark, rows, threshold=0.95, most=16) == brute(rows, 0.95)


def test_what_cannot_link(spark):
    one = [1.0] + [0.0] * 63
    rows = [(1, None, 1, "a"), (2, [0.0] * 64, 1, "a"), (3, [float("nan")] + [1.0] * 63, 1, "a"), (4, [None] + [1.0] * 63, 1, "a"), (5, one, None, "a"), (6, one, None, "a"), (7, [1.0, 2.0], 1, "a"), (8, [2.0, 4.0], 1, "a"), (9, one, 1, "a"), (10, [2.0] + [0.0] * 63, 1, "a"), (11, [], 1, "a"), (12, [float("inf")] * 64, 1, "a")]
    got = run(spark, rows)
    assert {r[0]: r[1] for r in got} == {i: int(i in (7, 8, 9, 10)) for i in range(1, 13)}
    assert got == brute(rows, 0.98)


def test_empty(spark):
    assert run(spark, []) == []
