"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with the references of four
languages by Jensen-Shannon distance (base 2, 0 to 1). The nearest reference counts, so that a document in
another of these languages than its label says isn't rejected for that; one in a fifth language is judged by
its distance to the nearest of the four. A guard of minimum length keeps
short texts, whose histograms say little, out of the comparison. Base rules on length and on repeated
5-word windows come first. No shuffle: every figure is made from the document's own row.

Defined results: null and empty texts have no words and fail the base; repeated rows and ties don't matter;
very long texts are measured whole; an empty table gives an empty result; further columns, whatever their names, are kept by `judge`, but
those named like its results, which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import nested, unnested, words

#: References, set by hand: rounded shares of lower case, upper case, digits, white space, symbols and other characters in running prose.
CLASSES = {
    "en": (0.780, 0.030, 0.010, 0.160, 0.000, 0.020),
    "de": (0.785, 0.055, 0.010, 0.130, 0.000, 0.020),
    "fr": (0.785, 0.030, 0.010, 0.150, 0.000, 0.025),
    "es": (0.790, 0.025, 0.010, 0.155, 0.000, 0.020),
}
#: References, set by hand: about what share of all words each of a language's commonest makes up, in per mille.
COMMON = {
    "en": {"the": 62, "of": 32, "and": 29, "to": 26, "in": 21, "a": 23, "is": 11, "that": 11, "for": 9, "it": 9, "was": 9, "on": 7},
    "de": {"der": 33, "die": 33, "und": 29, "in": 18, "den": 13, "von": 11, "zu": 11, "das": 10, "mit": 9, "sich": 8, "des": 9, "ist": 8},
    "fr": {"de": 60, "la": 37, "le": 30, "et": 25, "les": 24, "des": 20, "en": 18, "un": 14, "du": 14, "une": 12, "que": 12, "est": 9},
    "es": {"de": 65, "la": 40, "que": 30, "el": 28, "en": 27, "y": 27, "los": 17, "se": 14, "del": 13, "las": 11, "un": 11, "por": 10},
}
SYMBOLS = "[#*$%&|<>]"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (of docs), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the class counts; prefixed columns hold what is made on the way."""
    df = nested(docs, _text=F.coalesce(F.col("row").getField(text), F.lit("")))
    df = df.withColumn("_words", words(F.col("_text")))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    h = F.col("_h")
    window = lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4))
    df = df.withColumn("_windows", F.when(F.size(h) >= 5, F.transform(F.slice(h, 1, F.greatest(F.size(h) - 4, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    # Few texts repeat a window; only for those the windows are sorted with their places.
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_sorted", F.when(some, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(none))
    s = F.col("_sorted")
    twice = F.filter(F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["i"])), lambda p: p.isNotNull())
    df = df.withColumn("_at", F.sort_array(twice))
    at = F.col("_at")
    covered = F.transform(at, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - p, F.lit(5))))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    chars = F.length("_text")
    # Most of a text goes with its runs of lower case; the rest is short.
    df = df.withColumn("_rest", F.regexp_replace("_text", "[\\p{Ll} ]+", ""))
    df = df.withColumn("_rest_spaces", F.length(F.regexp_replace("_rest", "[^\\x09-\\x0D]+", "")))
    df = df.withColumn("_upper", F.regexp_count("_rest", F.lit("\\p{Lu}"))).withColumn("_digit", F.regexp_count("_rest", F.lit("\\p{Nd}")))
    df = df.withColumn("_space", chars - F.col("word_chars"))
    blanks = F.col("_space") - F.col("_rest_spaces")
    df = df.withColumn("_lower", chars - F.length("_rest") - blanks)
    rest = chars - F.col("_lower") - F.col("_upper") - F.col("_digit") - F.col("_space") - F.col("n_symbols")
    return df.withColumn("_classes", F.transform(F.array("_lower", "_upper", "_digit", "_space", "n_symbols", rest), lambda x: x / F.greatest(chars, F.lit(1))))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares, 0 to 1."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def divergences(df: DataFrame) -> DataFrame:
    """class_jsd and word_jsd: the distance to the nearest language reference."""
    known = sorted({w for x in COMMON.values() for w in x})
    # Words in lower case without the punctuation at their end.
    plain = F.split(F.regexp_replace(F.lower("_text"), "[.,!?;:]+$", ""), "[.,!?;:]*[\\x20\\x09-\\x0D]+")
    df = df.withColumn("_common", F.filter(plain, lambda w: w.isin(known)))
    c = F.col("_common")
    df = df.withColumn("_counts", F.transform(F.array(*map(F.lit, known)), lambda k: F.size(c) - F.size(F.array_remove(c, k))))
    shares = lambda of: F.array(*[F.lit(float(x)) for x in of])
    words_, classes = [], []
    for lang, common in COMMON.items():
        n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
        places = F.array(*[F.lit(known.index(w) + 1) for w in common])
        counts = F.transform(places, lambda i: F.element_at("_counts", i) / n)
        p = F.concat(counts, F.array(F.lit(1.0) - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)))
        q = [x / 1000 for x in common.values()]
        words_.append(divergence(p, shares([*q, 1 - sum(q)])))
        classes.append(divergence(F.col("_classes"), shares(CLASSES[lang])))
    return df.withColumn("class_jsd", F.least(*classes)).withColumn("word_jsd", F.least(*words_))


def judge(docs: DataFrame, text: str = "text", max_class: float = 0.21, max_word: float = 0.29, min_words: int = 50) -> DataFrame:
    """docs with the base counts, class_jsd, word_jsd, base_failed and kept.

    A text of under min_words words is judged by the base alone; its distances are null. A text with none of the
    common words is 0.3215 from the nearest reference, the German one; max_word is below that.
    """
    df = divergences(measure(docs, text))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    long_ = F.col("n_words") >= min_words
    fits = (F.col("class_jsd") <= max_class) & (F.col("word_jsd") <= max_word)
    figures = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    verdict = {"base_failed": failed, "kept": ~failed & (~long_ | fits)}
    distances = {c: F.when(long_, F.floor(F.col(c) * 1e6 + 0.5) / 1e6) for c in ("class_jsd", "word_jsd")}
    return unnested(df, docs.columns, **figures, **verdict, **distances)


def accepted(docs: DataFrame, text: str = "text", **limits: float) -> DataFrame:
    """The rows of docs that judge keeps; columns stay.

    A filter right on judge's result would be pushed below it, with all its figures written out where they are
    used, over and over; it isn't pushed below an explode.
    """
    judged = judge(docs.select(F.struct("*").alias("_row"), F.col(f"`{text}`").alias("_judged")), "_judged", **limits)
    return judged.select("_row", F.explode(F.array("kept")).alias("_verdict")).filter("_verdict").select("_row.*")


def sql(max_class: float = 0.21, max_word: float = 0.29, min_words: int = 50) -> str:
    """SQL that says the same of the table documents."""

    def distance(p: str, q: str) -> str:
        part = "list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {x}[i] > 0 THEN {x}[i] * log2({x}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END))"
        return f"sqrt(greatest(0, ({part.format(p=p, q=q, x=p)} + {part.format(p=p, q=q, x=q)}) / 2))"

    classes, by_word, columns = [], [], []
    for lang, common in COMMON.items():
        classes.append(distance("classes", f"[{', '.join(f'{float(x)}::DOUBLE' for x in CLASSES[lang])}]"))
        shares = [x / 1000 for x in common.values()]
        names = ", ".join(f"'{w}'" for w in common)
        columns.append(f"list_transform([{names}], lambda k: len(list_filter(plain, lambda w: w = k)) / greatest(n_words, 1)::DOUBLE) AS p_{lang}")
        by_word.append(distance(f"list_append(p_{lang}, 1 - list_sum(p_{lang}))", f"[{', '.join(f'{x!r}::DOUBLE' for x in [*shares, 1 - sum(shares)])}]"))
    kinds = ("\\p{Ll}", "\\p{Lu}", "\\p{Nd}")
    count = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    return f"""
        WITH a AS (
          SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), b AS (
          SELECT *, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {count(SYMBOLS)} AS n_symbols,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
            list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS windows
          FROM a
        ), c AS (
          SELECT doc_id, list_sort(list_distinct(flatten(list(list_transform(range(i, i + 5), lambda k: k))))) AS places
          FROM (SELECT doc_id, x, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM (SELECT doc_id, unnest(windows) AS x, generate_subscripts(windows, 1) AS i FROM b))
          WHERE n > 1 GROUP BY doc_id
        ), d AS (
          SELECT b.doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(len(places), 0) AS BIGINT) AS n_repeat_words,
            list_transform([{count(kinds[0])}, {count(kinds[1])}, {count(kinds[2])}, length(t) - word_chars, n_symbols], lambda x: x / greatest(length(t), 1)::DOUBLE) AS most,
            length(t) AS n, list_transform(w, lambda x: lower(rtrim(x, '.,!?;:'))) AS plain
          FROM b LEFT JOIN c ON b.doc_id = c.doc_id
        ), e AS (
          SELECT *, list_append(most, (n - {count(kinds[0])} - {count(kinds[1])} - {count(kinds[2])} - (n - word_chars) - n_symbols) / greatest(n, 1)::DOUBLE) AS classes, {", ".join(columns)} FROM d JOIN (SELECT doc_id AS id, t FROM a) ON doc_id = id
        ), f AS (
          SELECT *, least({", ".join(classes)}) AS c_jsd, least({", ".join(by_word)}) AS w_jsd, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM e
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND (n_words < {min_words} OR (c_jsd <= {max_class} AND w_jsd <= {max_word})) AS kept,
          CASE WHEN n_words >= {min_words} THEN floor(c_jsd * 1e6 + 0.5) / 1e6 END AS class_jsd,
          CASE WHEN n_words >= {min_words} THEN floor(w_jsd * 1e6 + 0.5) / 1e6 END AS word_jsd
        FROM f
    """
