import math
import random
import re
import unicodedata
from collections import Counter

import sentencepiece
from test_partenum_join import brute

import corpus_pipeline
from wardline.llm import quality_divergence, secret_ledger
from wardline.llm.entry import MODEL
from wardline.sources.scratch import made

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_drop_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes[name] = docs.count()
    assert sizes["secrets"] == sizes["near_duplicates"] <= sizes["quality"]
    assert sizes["tokens"] == sizes["mixing"] > 0


def plain_quality(text):
    """Whether the quality rules keep a text, by plain loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    if len(words) < 10 or 100 * len(covered) > 20 * len(words):
        return False
    if len(words) < 50:
        return True

    def distance(p, q):
        total = sum(x * math.log2(2 * x / (x + y)) for x, y in (*zip(p, q), *zip(q, p)) if x > 0)
        return math.sqrt(max(0.0, total / 2))

    kinds = Counter()
    for c in text:
        k = unicodedata.category(c)
        kinds["space" if c in " \t\n\v\f\r" else "symbol" if c in "#*$%&|<>" else k if k in ("Ll", "Lu", "Nd") else "rest"] += 1
    classes = [kinds[k] / len(text) for k in ("Ll", "Lu", "Nd", "space", "symbol", "rest")]
    common = Counter(w.rstrip(".,!?;:").lower() for w in words)
    by_word = []
    for reference in quality_divergence.COMMON.values():
        p, q = [common[w] / len(words) for w in reference], [x / 1000 for x in reference.values()]
        by_word.append(distance([*p, 1 - sum(p)], [*q, 1 - sum(q)]))
    return min(distance(classes, q) for q in quality_divergence.CLASSES.values()) <= 0.21 and min(by_word) <= 0.29


def plain_redaction(text):
    """A text with merged spans of secrets replaced, by plain loops."""
    out, at = [], 0
    for start, _, end in secret_ledger.find(text or "", secret_ledger.rules()):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return text if text is None else "".join(out) + text[at:]


def plain_rates(sizes):
    """source -> rate, sharing the excess again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free = dict.fromkeys(order, 0.0), set(order)
    left = 1.5 * sum(sizes.values())
    while free and left > 1e-9:
        unit = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += unit * weight[s]
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in free)
        for s in [s for s in free if target[s] >= 2 * sizes[s]]:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return {s: target[s] / sizes[s] if sizes[s] else 0.0 for s in order}


def test_stages_equal_brute_force(spark, tmp_path):
    docs, rows = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    rows["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
    ids = lambda found: sorted(r.doc_id for r in found)
    assert ids(rows["quality"]) == ids(r for r in rows["input"] if plain_quality(r.text))
    groups = brute([(r.doc_id, r.text, None) for r in rows["quality"]])
    assert ids(rows["near_duplicates"]) == sorted(d for d, _, least in groups if d == least)
    before = {r.doc_id: r.text for r in rows["near_duplicates"]}
    assert {r.doc_id: r.text for r in rows["secrets"]} == {d: plain_redaction(t) for d, t in before.items()}
    sizes = Counter()
    for r in rows["secrets"]:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    rates, taken = plain_rates(sizes), Counter(r.doc_id for r in rows["mixing"])
    for r in rows["secrets"]:
        rate = rates[r.source]
        assert math.floor(rate + 1e-9) <= taken[r.doc_id] <= math.ceil(rate - 1e-9)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expect = sorted((r.doc_id, library.encode(r.text or "")) for r in rows["mixing"])
    assert sorted((r.doc_id, list(r.ids)) for r in rows["tokens"]) == expect


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty, very long and repeated texts, clashing names; an empty table too."""
    draw = random.Random(1)
    word = lambda: "".join(draw.choices("etaoinshrdlcumwfgypbvk", k=draw.randint(3, 8)))
    text = lambda n: " ".join(draw.choice("the of and to in a is that for it was on".split()) if k % 3 == 0 else word() for k in range(n)) + "."
    prose = text(300)
    rows = [(1, prose, "en", "s", 1, "r"), (1, prose, "en", "s", 1, "r"), (None, prose + " end", None, None, None, "r"), (2, None, "en", "s", 1, "r"), (3, "", "en", "s", 0, None), (4, prose + " secret:abcdef and more words", "en", "t", 5, "r"), (5, text(60000), "en", "t", 9, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, FOLDER)
            if name != "tokens":
                assert out.columns == docs.columns
            at = str(tmp_path / f"{name}-{given is docs}")
            out.write.parquet(at)
            now = spark.read.parquet(at)
            alone = stage(spark, given, FOLDER)
            assert (alone.count() == 0) == (given is not docs)
    assert not spark.read.parquet(str(tmp_path / "tokens-True")).isEmpty()


def test_run_leaves_its_result_only(spark):
    there = set(made)
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert [p.split("/")[-1].split("-")[1] for p in made - there] == ["tokens"]
