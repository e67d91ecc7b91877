import itertools
import os
import random

import numpy as np
import pytest

from wardline.llm import partenum_join as pj
from wardline.llm.partenum_join import link, one_of_each
from wardline.sources.scratch import made, shared_dir

SCHEMA = "doc_id long, text string, c string"


def plain_sets(texts, n=5):
    out = []
    for text in texts:
        w = "".join(x.lower() if x.isascii() else x for x in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        out.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(rows, n=5):
    sets = plain_sets([r[1] for r in rows], n)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted(((r[0], len(sets[k]), least.get(find(k))) for k, r in enumerate(rows)), key=str)


def found(spark, rows, **sizes):
    out = link(spark.createDataFrame(rows, SCHEMA), **sizes)
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for base in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 12, 20, 40, 90, 127, 128, 260]))]
        if base % 3 == 0:
            words += passage
        for copy in range(rng.choice([1, 2, 3, 8])):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 18)) if copy else 0):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            if copy == 7:
                w = w + [rng.choice(vocabulary) for _ in range(len(w) // 3)]
            rows.append((len(rows) * 3 + 1, (" " if copy % 2 else "\n").join(w).upper() if copy == 3 else " ".join(w), "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"chunk": 3, "hot": 2, "most": 1})])
def test_equals_brute_force(spark, seed, sizes):
    """Small chunks take the ways of frequent signatures, long lists and many candidates."""
    rows = corpus(seed)
    assert found(spark, rows, **sizes) == brute(rows)


@pytest.mark.parametrize("percent", [75, 90])
def test_similar_sets_share_a_signature(percent):
    """Any two sets of the least similarity, of all sizes, and also sets whose elements fall in few parts."""
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), 90, 150, 400, 1000]:
        for _ in range(60 if size < 60 else 12):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            more = rng.integers(0, 1 + size * (100 - percent) // percent)
            less = 0
            while 100 * (size - less - 1) >= percent * (size + more) and rng.random() < 0.9:
                less += 1
            b = np.concatenate([rng.permutation(a)[: size - less], rng.integers(0, 2**63, more, dtype=np.uint64)])
            assert 100 * (size - less) >= percent * (size + more)
            one, two = ({int(s) for sig, _ in pj.enumerated([np.sort(x)], percent) for s in sig} for x in (a, b))
            assert one & two, (size, more, less)


def test_number_of_signatures():
    """The subsets of a layout, for the groups a set needs: their number and how many differences they bear."""
    rng = np.random.default_rng(3)
    total = elements = 0
    for size in (100, 333, 600):
        sets = [rng.integers(0, 2**63, size, dtype=np.uint64) for _ in range(20)]
        total += sum(len(sig) for sig, _ in pj.enumerated(sets, 75))
        elements += 20 * size
    assert total < 1.1 * elements
    for band, (low, high) in enumerate(itertools.pairwise(pj.band_starts(5000))):
        lay = pj.layout(band, high - 1, 75)
        d = 2 * (high - 1) * 25 // 175
        assert lay.groups * (lay.k2 + 1) > d and lay.n2 > lay.k2
        whole = np.unique(rng.integers(0, 2**63, high - 1, dtype=np.uint64))
        sig, _ = pj.signatures(whole, np.array([len(whole)]), np.array([d]), lay, 75)
        assert len(sig) <= lay.groups * len(list(itertools.combinations(range(lay.n2), lay.n2 - lay.k2))) + len(whole)


def test_edges(spark):
    long_ = " ".join(f"x{k % 977}y{k % 31}" for k in range(30000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "One two", "a"), (5, "one  TWO", "b"), (6, "one two three", "c"), (None, long_, "n"), (9, long_, "d"), (8, long_ + " end", "e"), (8, long_ + " end", "e"), (10, "é É", "f"), (11, "É É", "f"), (None, "x y", "g"), (None, "X Y", "g")]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert one_of_each(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_one_of_each_keeps_columns_and_one_row(spark):
    seven = "a b c d e f g"
    rows = [(1, seven, "k"), (2, seven, "l"), (1, seven, "j"), (3, None, "m"), (4, None, "n"), (5, "other", "o"), (5, "another text", "p"), (1, "unlike", "q"), (None, "lonely", "r"), (None, "lonely", "r"), (None, seven.upper(), "s")]
    names = ["doc_id", "text", "sha", "row", "id"]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "c AS sha", "c AS row", "c AS id")
    out = one_of_each(df)
    assert out.columns == names
    kept = sorted(((r.doc_id, r.text, r.sha) for r in out.collect()), key=str)
    assert kept == sorted([(1, seven, "j"), (3, None, "m"), (4, None, "n"), (5, "other", "o"), (5, "another text", "p"), (1, "unlike", "q"), (None, "lonely", "r")], key=str)


def test_leaves_only_its_result(spark):
    there, before = set(made), set(os.listdir(shared_dir(spark))) if os.path.exists(shared_dir(spark)) else set()
    assert link(spark.createDataFrame(corpus(3), SCHEMA)).count() > 0
    left = set(os.listdir(shared_dir(spark))) - before
    assert [x.split("-")[0] for x in left] == ["linked"] and {os.path.basename(p) for p in made - there} == left
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("wardline_texts")]
