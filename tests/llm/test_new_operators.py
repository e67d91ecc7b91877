"""Late sessions, the positional index and the prefix trie against plain replays, and their edges."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from wardline.llm import late_sessions, positional_index, prefix_trie
from wardline.sources.scratch import Store


def crc(x):
    return zlib.crc32(str(x).encode())


def replay(events, gap):
    """All versions, batch by batch."""
    by, out = defaultdict(list), {}
    for user, t, batch, h in events:
        by[user].append((t, batch, h))
    for user, rows in by.items():
        standing = []
        for b in sorted({r[1] for r in rows}):
            now, groups = sorted(r for r in rows if r[1] <= b), []
            for r in now:
                if groups and r[0] - groups[-1][-1][0] <= gap:
                    groups[-1].append(r)
                else:
                    groups.append([r])
            for g in groups:
                if any(r[1] == b for r in g):
                    start, end = g[0][0], g[-1][0]
                    gone = [v for v in standing if start <= v[2] and v[3] <= end]
                    for v in gone:
                        out[v] = (*out[v][:4], b, start)
                    standing = [v for v in standing if v not in gone] + [(user, b, start, end)]
                    out[user, b, start, end] = (len(g), sum(r[1] == b for r in g), len(gone), sum(r[2] for r in g), None, None)
    return sorted((*k, *v) for k, v in out.items())


COLUMNS = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s"]


def versions(spark, events, **more):
    df = spark.createDataFrame(events, "user long, t long, batch long, h long")
    none = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted((tuple(r) for r in late_sessions.versions(df, **more).select(*COLUMNS).collect()), key=none)


def test_versions_are_those_of_a_replay(spark):
    rng = random.Random(5)
    dense = [(1, rng.randrange(0, 9000), rng.randrange(0, 9), rng.randrange(1 << 32)) for _ in range(500)]
    sparse = [(u, t := rng.randrange(0, 40000), t // 3000 + rng.choice((0, 0, 0, 2, 5)), 7) for u in (2, 3) for _ in range(80)]
    chain = [(4, 200 * i, 11 - i % 7, i) for i in range(120)]  # one session over many parts of time
    ties = [(5, 100, 1, 3), (5, 100, 1, 3), (5, 100, 2, 3), (5, 340, 0, 3), (5, 341, 3, 3), (5, -50, 4, 1)]
    events = dense + sparse + chain + ties
    none = lambda r: tuple(-1 if x is None else x for x in r)
    assert versions(spark, events) == sorted(replay(events, 240), key=none)
    assert versions(spark, events[::-1], gap=60) == sorted(replay(events, 60), key=none)


def test_sessions_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1), (1, 5, 1, None)], "user long, t long, batch long, h long").withColumn("start", F.lit("x"))
    assert [tuple(r) for r in late_sessions.versions(df).select(*COLUMNS).collect()] == [(1, 1, 5, 5, 1, 1, 0, 0, None, None)]
    assert late_sessions.versions(df.limit(0)).isEmpty()
    rows = spark.createDataFrame([(-9, 3), (17, None), (None, 1), (17, 4)], "conv_id long, turn long").withColumn("h", F.lit("clash"))
    got = {(r.user, r.t, r.batch, r.h) for r in late_sessions.events_of(rows).collect()}
    want = set()
    for c, turn in ((-9, 3), (17, 4)):
        h = crc(f"{c}:{turn}")
        s = crc(c) // 2 % 7200 + 300 * turn + h % 600
        want.add((2 * (c // 8) + crc(c) % 2, s, s // 1800 + (h // 600 % 4 if h // 600 % 5 == 0 else 0), h))
    assert got == want


BREAK = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in BREAK.split(lower) if w]


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = terms(text)
        if item is not None and w:
            n = min(len(w), 10)
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = terms(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_is_that_of_all_windows(spark):
    rng = random.Random(3)
    words = ["the", "of", "a", "É", "straße", "x1", "ÀB", "Zq", "ñ", "7"]
    text = lambda n: rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\t", "_"]) for _ in range(n))
    items = [(i, text(rng.choice((1, 2, 9, 10, 11, 30)))) for i in range(30)] + [(100, None), (101, "...!"), (None, "the of a"), (7, text(12)), (200, "only here " * 9)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(500, None), (501, ""), (None, "the of"), (502, items[3][1]), (502, "pre " + (items[5][1] or "") + " post"), (503, "only here " * 5000), (503, "only here " * 5000), (504, "... ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("n_words", F.lit("x"))
    marks = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(0))
    out = positional_index.decontaminate(df, marks)
    got = [tuple(r)[:6] for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == contamination(docs, items)
    nothing = positional_index.decontaminate(df, marks.limit(0)).agg(F.sum("n_hit"), F.sum("n_near"), F.count("*")).first()
    assert tuple(nothing) == (0, 0, len(docs)) and positional_index.decontaminate(df.limit(0), marks).isEmpty()


def test_proximity(spark):
    docs = spark.createDataFrame([(0, "zebra and some more words then quokka with an ibis"), (1, "zebra " + "word " * 30 + "quokka ibis"), (2, "ibis quokka"), (3, "Ibis, QUOKKA: zebra!")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Zebra. IBIS - quokka"), (2, "word"), (3, "absent zebra")], "item_id long, text string")
    store = Store(spark)
    marks = positional_index.Items(items, store)
    index = positional_index.Index(docs, marks, store)
    found = positional_index.near(marks, index, store).join(marks.ids, "item").join(index.texts, "row").select("doc_id", "item_id")
    assert sorted(tuple(r) for r in found.collect()) == [(0, "1"), (1, "2"), (3, "1")]
    store.close()


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[c].append(((turn is not None, turn), role or "", key, text or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h, base = crc(c) % 9, c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in m if paths[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_is_that_of_all_prefixes(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, i if rng.random() < 0.9 else None, rng.choice(("user", "assistant", None)), rng.choice(("hi", "héllo", None, "ok"))) for c in range(-7, 90) for i in range(rng.randrange(1, 6)) if c % 11]
    rows += [(c, i, "user", f"long {i}") for c in (205, 206, 207, 300) for i in range(60)]  # copies that share long paths
    rows += [(None, 1, "user", "lost"), (400, 1, "user", "hi"), (400, 1, "user", "hi"), (401, 1, "a", "same"), (401, 1, "b", "same")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x")).withColumn("base", F.lit(0))
    want = plain_trie(rows)
    assert sorted((tuple(r) for r in prefix_trie.trie(df).select(*TRIE).collect()), key=str) == want
    # Families that outgrow a task's trie hand it over early, and ids come in more than one block.
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    assert sorted((tuple(r) for r in prefix_trie.trie(df.repartition(5)).select(*TRIE).collect()), key=str) == want
    assert prefix_trie.trie(df.limit(0)).isEmpty()


def test_families_hand_over_early():
    family = prefix_trie._Family()
    family.start(0)
    family.begin(0, 0)
    for i in range(10):
        family.turn(bytes([i]), 1)
    first = family.hand_over(True)
    family.turn(b"x", 2)
    family.end()
    second = family.hand_over(False)
    assert first.num_rows == 10 and second.num_rows == 2 and second.column("ends").to_pylist() == [[], [0]]


def test_one_turn_alone_has_a_root(spark):
    df = spark.createDataFrame([(5, None, None, None)], "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r)[:7] for r in prefix_trie.trie(df).select(*TRIE).collect())
    assert got == [(5, 0, None, 1, 1, 1, 0), (5, 1, 5, 1, 0, 1, 0)]
