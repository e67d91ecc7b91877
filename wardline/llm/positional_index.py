"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

`Index` stores, for each text and each term that the benchmark uses, the positions at which the term stands: rows
(row, pos, term), dealt out by text, written once and read by every search. A search goes from its rarest terms:

- every window of WINDOW words of an item (or the whole item, if shorter) picks its RAREST rarest positions by the
  terms' counts in the index, as anchors; a window with a term that the index hasn't is no match;
- an anchor's postings, shifted by its place in the item, say where the item would begin: its diagonal. Diagonals
  are the keys on which the anchors' shifted lists are intersected;
- around anchors that meet, the remaining terms' shifted lists are intersected too. What survives is compared word
  for word, since lists are exact; runs of WINDOW or more consecutive words are matches.

`near` answers with proximity: items whose rarest terms stand close to each other, in any order.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Terms are strings, numbered once;
what is broadcast is the table of terms, if it has BROADCAST_TERMS at most, and otherwise joined by a shuffle.
Common terms cost index rows but no search, unless a window consists of them alone.

Defined results: null texts have no words; null item ids can't be reported, so such items are left out; repeated
item ids are one item with several texts; documents are rows, whatever their ids, null and repeated ones too; very
long texts are indexed whole; an empty corpus gives an empty result, an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.sources.scratch import Store

#: Words of a window, and anchors that each window picks.
WINDOW, RAREST = 10, 2
#: Terms that are broadcast, some 64 bytes each.
BROADCAST_TERMS = 100_000
#: What separates words, before letters are lower-cased.
_BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; the fast function where a word has ASCII only."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def positions(texts: DataFrame, text: str, *kept: str) -> DataFrame:
    """kept..., pos, word, n_words: a row for each word, and one of pos 0 for a text without any (its word is empty)."""
    w = texts.select(*kept, F.split(F.coalesce(F.col(text), F.lit("")), _BREAKS).alias("_w"))
    # A separator at either end leaves an empty piece there.
    first = (F.element_at("_w", 1) == "").cast("int")
    last = ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")
    w = w.select(*kept, "_w", first.alias("_first"), (F.size("_w") - first - last).alias("n_words"))
    w = w.select(*kept, "_first", "n_words", F.posexplode("_w").alias("_at", "_word"))
    return w.select(*kept, (F.col("_at") - F.col("_first")).alias("pos"), _lowered(F.col("_word")).alias("word"), "n_words", (F.col("_at") == 0).alias("head"))


class Items:
    """The words of benchmark items: words (item, pos, term), ids (item, item_id), terms (term, word)."""

    def __init__(self, items: DataFrame, store: Store):
        rows = items.filter("item_id IS NOT NULL").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), "text")
        said = store.cut(positions(rows, "text", "item", "item_id").filter("word <> ''"), "items")
        self.terms = store.cut(said.select("word").distinct().select(F.monotonically_increasing_id().alias("term"), "word"), "terms")
        self.words = store.cut(said.join(self.terms, "word").select("item", "pos", "term", "word", "n_words"), "item-words")
        self.ids = said.filter("pos = 0").select("item", "item_id")
        self.few = self.terms.count() <= BROADCAST_TERMS


class Index:
    """Postings of a corpus for the terms of items, in the store's folder: postings (row, pos, term), texts (row, n_words, kept...)."""

    def __init__(self, docs: DataFrame, items: Items, store: Store, text: str = "text", kept: tuple[str, ...] = ("doc_id",)):
        columns = [F.col(c).alias(f"_kept_{c}") for c in kept]
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("_text"), *columns)
        # Bounded by the check above; beyond it Spark shuffles the words.
        terms = F.broadcast(items.terms) if items.few else items.terms
        said = positions(rows, "_text", "row", *[f"_kept_{c}" for c in kept]).join(terms, "word", "left").filter("head OR term IS NOT NULL")
        head = lambda c: F.when(F.col("head"), F.col(c))
        stored = store.cut(said.select("row", F.when(F.col("term").isNotNull(), F.col("pos")).alias("pos"), "term", "head", head("n_words").alias("n_words"), *[head(f"_kept_{c}").alias(f"_kept_{c}") for c in kept]), "postings")
        self.postings = stored.filter("term IS NOT NULL").select("row", "pos", "term")
        self.texts = stored.filter("head").select("row", F.col("n_words").cast("long").alias("n_words"), *[F.col(f"_kept_{c}").alias(c) for c in kept])
        self.counts = store.cut(self.postings.groupBy("term").agg(F.count("*").alias("n")), "term-counts")


def anchors(items: Items, index: Index, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(item, at, term, need): the rarest positions of each window, and how many must meet."""
    words = items.words.join(index.counts, "term", "left").select("item", "pos", "term", F.coalesce("n", F.lit(0)).alias("n"), F.least("n_words", F.lit(window)).alias("size"), "n_words")
    begins = F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("size") + 1), F.least(F.col("pos"), F.col("n_words") - F.col("size")))
    inside = words.select("item", "pos", "term", "n", "size", F.explode(begins).alias("begin"))
    by = W.partitionBy("item", "begin")
    ranked = inside.withColumn("place", F.row_number().over(by.orderBy("n", "pos"))).withColumn("least", F.min("n").over(by))
    return ranked.filter((F.col("place") <= rarest) & (F.col("least") > 0)).select("item", F.col("pos").alias("at"), "term", F.least("size", F.lit(rarest)).alias("need")).distinct()


def phrases(items: Items, index: Index, store: Store, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(row, item, first, last): stretches of a text that are consecutive words of an item, a window long at least."""
    rare = store.cut(anchors(items, index, window, rarest), "anchors")
    hits = index.postings.join(rare, "term").select("row", "item", (F.col("pos") - F.col("at")).alias("begin"), "at", "need")
    met = hits.groupBy("row", "item", "begin").agg(F.collect_set("at").alias("at"), F.min("need").alias("need")).filter(F.size("at") >= F.col("need"))
    met = store.cut(met.select("row", "item", "begin", "at"), "diagonals")
    # A match has its anchors, so all of it lies within a window of one; other terms are looked up there only.
    around = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(F.greatest(F.lit(0), x - (window - 1)), x + (window - 1)))))
    asked = met.select("row", "item", "begin", F.explode(around).alias("at")).join(items.words.select("item", F.col("pos").alias("at"), "term", "n_words"), ["item", "at"])
    there = index.postings.join(met.select("row").distinct(), "row", "left_semi")
    same = asked.withColumn("pos", F.col("begin") + F.col("at")).join(there, ["row", "pos", "term"])
    run = F.col("at") - F.row_number().over(W.partitionBy("row", "item", "begin").orderBy("at"))
    runs = same.withColumn("run", run).groupBy("row", "item", "begin", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min(F.least("n_words", F.lit(window))).alias("size"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= F.col("size")).select("row", "item", "first", "last")


def near(items: Items, index: Index, store: Store, terms: int = 3, within: int = 20) -> DataFrame:
    """(row, item): texts in which an item's rarest terms (of equal counts the first words) all stand fewer than `within` words from one place of the rarest."""
    words = items.words.select("item", "term", "word").distinct().join(index.counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by = W.partitionBy("item")
    rare = words.withColumn("place", F.row_number().over(by.orderBy("n", "word"))).filter(F.col("place") <= terms)
    rare = store.cut(rare.withColumn("all", F.count("*").over(by)).withColumn("least", F.min("n").over(by)).filter("least > 0"), "rare")
    hits = index.postings.join(rare, "term").select("row", "item", "pos", "term", "place", "all")
    cell = F.floor(F.col("pos") / within)
    others = hits.filter("place > 1").select("row", "item", F.col("pos").alias("other"), F.col("place").alias("which"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    lead = hits.filter("place = 1").withColumn("cell", cell)
    close = lead.join(others, ["row", "item", "cell"], "left").filter((F.col("all") == 1) | (F.abs(F.col("pos") - F.col("other")) < within))
    met = close.groupBy("row", "item", "pos", "all").agg(F.count_distinct("which").alias("k")).filter("k = all - 1")
    return met.select("row", "item").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items by proximity alone): a row for each document."""
    store = Store(docs.sparkSession)
    items = Items(benchmark, store)
    index = Index(docs, items, store)
    found = store.cut(phrases(items, index, store, window), "phrases")
    hit = found.select("row", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    which = found.select("row", "item").distinct().join(items.ids, "item").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    close = near(items, index, store).join(items.ids, "item").groupBy("row").agg(F.count_distinct("item_id").alias("n_near"))
    out = index.texts.join(hit, "row", "left").join(which, "row", "left").join(close, "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    out = store.cut(out, "contamination")
    store.close(out)
    return out
