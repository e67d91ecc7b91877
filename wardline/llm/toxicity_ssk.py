"""Toxicity by a subsequence string kernel, a support vector machine and Nystroem landmarks.

The kernel counts common subsequences of three characters, each weighted by decay to the power of the span it
covers, up to `SPAN` characters; features are scaled by a norm that depends on the length. Subsequences skip
characters, so an insult with characters put in, left out or swapped for digits still shares most of them.

A sentence is looked at through windows: a window is a word with its edges, or a run of short pieces (two
letters or less, ten in all) with the spaces between them, so that gaps cross spaces there. A sentence's kernel feature is
that of the window which the machine rates highest; a document's score comes from its three highest distinct
windows, since one unlucky word isn't yet evidence.

Training, on a bounded sample of labelled documents, cut into sentences: a document's label says that one of
its sentences at least is toxic, not which. The witnesses of a toxic document are its sentences whose highest
window stands for the label: at first by how many standard errors its share of toxic documents is above that
of clean ones, then also by the machine so far. A machine with squared hinge loss is fitted to the witnesses'
windows against the windows of all clean sentences, over some rounds. Landmarks are windows of labelled
sentences: witnesses, as different as can be, common clean ones, and the clean ones that came out highest.
Kernel values at the landmarks, whitened, are the machine's features. A logistic scale fitted to documents'
three highest windows gives the score.

A kernel value at a landmark is linear in the subsequences, so the machine folds into one weight for each
three-character subsequence. Executors look that table up at every place of a text, in blocks; cost is linear
in the text and the table doesn't grow. Whole texts are scored, in a map without a shuffle.

Defined results: null and empty texts have the score of a text without windows, below 0.5; a training set
without both labels gives score 0 for all; repeated rows score alike; labels that are null, or of documents
labelled both ways, aren't used; very long texts are scored whole, one at a time; an empty table gives an
empty result; other columns aren't read, so they can't clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters with a class of their own; other letters share one, and so do the edges of words.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäæçèéêëìíîïñòóôöùúûüßœ"
OTHER, EDGE, DROP = len(LETTERS), len(LETTERS) + 1, len(LETTERS) + 2
SIZE = EDGE + 1
SPAN, DECAY = 7, 0.7
PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Pieces of so many letters at most are joined, to windows of so many letters.
SHORT, JOINED = 2, 10
#: Characters that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Texts are scored in blocks of about so many characters.
BLOCK = 1 << 17
#: Labelled documents that the machine is fitted to, at most; half of each label.
MAX_DOCS = 4000
#: Bytes of their texts, at most: documents beyond are left out whole, in the order in which they are picked.
MAX_BYTES = 64 << 20
#: Windows of clean sentences in a fit, at most: a hash picks them, and the hardest of all come in each round.
MAX_CLEAN = 12000


def alphabet() -> np.ndarray:
    """Code point -> class, for the first 0x250; letters beyond are OTHER."""
    out = np.full(0x250, DROP, np.int32)
    for c in range(0x250):
        low = chr(c).lower()
        if low.isspace():
            out[c] = EDGE
        elif low.isalpha():
            out[c] = LETTERS.find(low[0]) if low[0] in LETTERS else OTHER
    return out


_DISGUISED = re.compile(r"(?<=[A-Za-z])[013457@$!](?=[A-Za-z])|(?<![A-Za-z0-9])[013457@$](?=[A-Za-z]{2})")


def plain(text: str) -> str:
    """Stand-ins undone."""
    return _DISGUISED.sub(lambda m: DISGUISE[m[0]], text)


@dataclass
class Windows:
    """Windows laid end to end: classes, window of each place, each window's length, where it starts here and in the text."""

    c: np.ndarray
    window: np.ndarray
    size: np.ndarray
    first: np.ndarray
    at: np.ndarray


def windows(text: str, table: np.ndarray) -> Windows:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = np.where(code < 0x250, table[np.minimum(code, 0x24F)], OTHER)
    there = np.flatnonzero(c != DROP)
    c = c[there]
    letter = c != EDGE
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    first = np.flatnonzero(start)
    if not len(first):
        none = np.zeros(0, np.int64)
        return Windows(none, none, none, none, none)
    piece = np.cumsum(start)[letter] - 1
    length = np.bincount(piece)
    short = length <= SHORT
    opens = ~short
    opens[0] = True
    opens[1:] |= ~short[:-1]
    # Within a run of short pieces a window ends once it has JOINED letters.
    run = np.cumsum(opens) - 1
    upto = np.cumsum(length) - length
    within = (upto - upto[opens][run]) // JOINED
    opens[1:] |= within[1:] != within[:-1]
    window = np.cumsum(opens) - 1
    # One edge before each piece, and one after each window.
    closes = np.r_[opens[1:], True]
    space = length + 1 + closes
    ends = np.cumsum(space)
    out = np.full(ends[-1], EDGE, np.int64)
    out[np.arange(len(piece)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(ends - space + 1, length)] = c[letter]
    owner = np.repeat(window, space)
    size = np.bincount(owner)
    return Windows(out, owner, size, np.cumsum(size) - size, there[first[opens]])


def norms(size: np.ndarray) -> np.ndarray:
    """The scale of a window by its length: the norm of its features if all its subsequences differ."""
    total = sum((np.maximum(size - b, 0) * DECAY ** (2 * (b + 1)) for _, b in PAIRS), np.zeros(len(size)))
    return np.sqrt(np.maximum(total, DECAY**6))


def margins(x: Windows, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each window."""
    n, c = len(x.c), x.c
    total = np.zeros(n, weights.dtype)
    high, mid = c * SIZE * SIZE, c * SIZE
    for b in range(2, SPAN):
        if n <= b:
            break
        ends = high[: n - b] + c[b:]
        one = sum((weights[ends + mid[a : n - b + a]] for a in range(1, b)), np.zeros(n - b, weights.dtype))
        total[: n - b] += np.where(x.window[: n - b] == x.window[b:], one, 0) * weights.dtype.type(DECAY ** (b + 1))
    sums = np.bincount(x.window, total, len(x.size)) if n else np.zeros(0)
    return sums / norms(x.size) + bias


def features(x: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, subsequence, scaled weight) of all subsequences, by window."""
    n, c = len(x.c), x.c
    own, what, weight = [], [], []
    scale = 1 / norms(x.size)
    for a, b in PAIRS:
        if n > b:
            same = np.flatnonzero(x.window[: n - b] == x.window[b:])
            own.append(x.window[same])
            what.append(c[same] * SIZE * SIZE + c[same + a] * SIZE + c[same + b])
            weight.append(DECAY ** (b + 1) * scale[x.window[same]])
    own, what, weight = np.concatenate(own), np.concatenate(what), np.concatenate(weight)
    order = np.argsort(own, kind="stable")
    return own[order], what[order], weight[order]


def some_of(x: Windows, ids: np.ndarray) -> Windows:
    """A few windows of x."""
    size = x.size[ids]
    first = np.cumsum(size) - size
    return Windows(x.c[np.arange(size.sum()) + np.repeat(x.first[ids] - first, size)].astype(np.int64), np.repeat(np.arange(len(ids)), size), size, first, x.at[ids])


def dense(x: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Features of a few windows, those of landmarks, and which subsequences their columns are."""
    own, what, weight = features(x)
    columns, place = np.unique(what, return_inverse=True)
    out = np.zeros((len(x.size), len(columns)), np.float32)
    np.add.at(out, (own, place), weight)
    return out, columns


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    floor: float
    scale: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def score(self, top: tuple[float, float, float]) -> float:
        z = float(self.scale[0] + np.dot(self.scale[1:], top))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows within the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum() * c
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    w = np.zeros(z.shape[1])
    for k in range(steps):
        inside = y * (z @ w) < 1
        za, wa = z[inside], weight[inside]
        new = np.linalg.solve(ridge + 2 * (za.T * wa) @ za, 2 * za.T @ (wa * y[inside]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * (w + new) if k > 10 else new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slopes, none of them negative, by gradient steps; classes weigh alike."""
    z = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    target = (y > 0).astype(float)
    w = np.r_[0.0, np.ones(x.shape[1])]
    h = np.eye(len(w)) * 1e-3
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + h, z.T @ (weight * (target - p)) - 1e-3 * np.r_[0.0, w[1:]])
        w = w + np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0.0)
    return w


def apart(bags: list[np.ndarray], labels: list[int], alike: float = 0.5) -> list[int]:
    """One document of each group of near copies of a label: Jaccard similarity of alike or more, found by eight least hashes."""
    salts = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kept: list[int] = []
    sets: dict[int, set[int]] = {}
    buckets: dict[tuple[int, int, int], list[int]] = {}
    for i, (bag, y) in enumerate(zip(bags, labels)):
        hashes = bag if len(bag) else np.zeros(1, np.uint64)
        least = (hashes[None] * salts[:, None] >> np.uint64(20)).min(1).tolist()
        places = [buckets.setdefault((y, k, h), []) for k, h in enumerate(least)]
        mine = set(bag.tolist())
        if any(len(mine & sets[j]) >= alike * len(mine | sets[j]) for j in {j for p in places for j in p}):
            continue
        for p in places:
            p.append(i)
        kept.append(i)
        sets[i] = mine
    return kept


def spread(phi: np.ndarray, count: int) -> list[int]:
    """Rows, count at most, each the one that those before it stand for least (pivoted Cholesky)."""
    left, rows, out = (phi * phi).sum(1).astype(np.float64), [], []
    while len(out) < min(count, len(phi)) and left.max() > 1e-6:
        k = int(np.argmax(left))
        row = (phi @ phi[k]).astype(np.float64) - sum((r * r[k] for r in rows), np.zeros(len(phi)))
        rows.append(row / math.sqrt(left[k]))
        left = np.maximum(left - rows[-1] ** 2, 0)
        left[k] = 0
        out.append(k)
    return out


_ENDS = re.compile(r"[.!?\n]")


class Corpus:
    """Labelled documents as sentences of windows; equal windows are one."""

    def __init__(self, rows: list[tuple[str, int]]):
        table, parts, hashes, docs, sentences = alphabet(), [], [], [], []
        self.labels: list[int] = []
        for k, (text, y) in enumerate(sorted(set(rows))):
            text = plain(text)
            self.labels.append(1 if y else -1)
            x = windows(text, table)
            if len(x.size):
                where = np.arange(len(x.c)) - np.repeat(x.first, x.size)
                h = (x.c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + where.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                hashes.append(np.add.reduceat(h ^ (h >> np.uint64(32)), x.first))
                docs.append(np.full(len(x.size), k))
                sentences.append(np.searchsorted([m.start() for m in _ENDS.finditer(text)], x.at))
                parts.append((x.c.astype(np.int8), x.size))
        self.hash = np.zeros(0, np.uint64)
        if parts:
            size = np.concatenate([n for _, n in parts])
            whole = Windows(np.concatenate([c for c, _ in parts]), np.zeros(0, np.int64), size, np.cumsum(size) - size, size * 0)
            self.hash, first, self.window = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            self.windows = some_of(whole, first)
            self.doc = np.concatenate(docs)
            self.sentence = self.doc << 32 | np.concatenate(sentences)

    def keep(self, docs: list[int]) -> None:
        there = np.isin(self.doc, docs)
        self.window, self.doc, self.sentence = self.window[there], self.doc[there], self.sentence[there]


class Kernel:
    """Kernel values of windows at landmarks, each computed once."""

    def __init__(self, x: Windows):
        self.x, self.rows, self.marks = x, np.zeros(0, np.int64), []
        self.values = np.zeros((0, 0), np.float32)

    def _values(self, rows: np.ndarray, marks: list[int]) -> np.ndarray:
        out = np.zeros((len(rows), len(marks)), np.float32)
        if not len(rows) or not marks:
            return out
        phi, columns = dense(some_of(self.x, np.array(marks, np.int64)))
        place = np.full(SIZE**3, -1, np.int32)
        place[columns] = np.arange(len(columns))
        table = np.ascontiguousarray(phi.T)
        for k in range(0, len(rows), 500):
            own, what, weight = features(some_of(self.x, rows[k : k + 500]))
            at = place[what]
            some = at >= 0
            own, at, weight = own[some], at[some], weight[some]
            if len(own):
                there, begin = np.unique(own, return_index=True)
                out[k + there] = np.add.reduceat(table[at] * weight[:, None].astype(np.float32), begin, axis=0)
        return out

    def land(self, marks: list[int]) -> None:
        fresh = [i for i in dict.fromkeys(marks) if i not in set(self.marks)]
        self.values = np.hstack([self.values, self._values(self.rows, fresh)])
        self.marks = self.marks + fresh
        self.phi, self.columns = dense(some_of(self.x, np.array(self.marks, np.int64)))

    def at(self, rows: np.ndarray) -> np.ndarray:
        fresh = np.setdiff1d(rows, self.rows)
        if len(fresh):
            self.values = np.vstack([self.values, self._values(fresh, self.marks)])
            self.rows = np.r_[self.rows, fresh]
        order = np.argsort(self.rows)
        return self.values[order[np.searchsorted(self.rows, rows, sorter=order)]].astype(np.float64)


def fit(rows: list[tuple[str, int]], landmarks: int = 96, rounds: int = 4, witnesses: int = 6, max_clean: int = MAX_CLEAN, sure: float = 4.0) -> Machine | None:
    """A machine from (text, label) rows; None without both labels.

    landmarks: witnesses' windows among the landmarks at first; common clean ones are half as many, and each
    round adds a third of each kind. witnesses: sentences of a toxic document that stand for its label, at most.
    sure: standard errors that a window must tell at first.
    """
    corpus = Corpus(rows)
    if not len(corpus.hash):
        return None
    y = np.array(corpus.labels)
    bags = np.split(corpus.hash[corpus.window], np.searchsorted(corpus.doc, np.arange(1, len(y))))
    corpus.keep(apart([np.unique(b) for b in bags], corpus.labels))
    del bags
    x, count = corpus.windows, len(corpus.hash)
    pairs = np.unique(corpus.window << 32 | corpus.doc)
    of_window, of_doc = pairs >> 32, pairs & 0xFFFFFFFF
    toxic = y[of_doc] > 0
    inpos, inneg = np.bincount(of_window[toxic], minlength=count), np.bincount(of_window[~toxic], minlength=count)
    pos, neg = len(np.unique(of_doc[toxic])), len(np.unique(of_doc[~toxic]))
    if not pos or not neg:
        return None
    del pairs, of_window, of_doc, toxic
    # How many standard errors a window's share of toxic documents is above that of clean ones.
    share = (inpos + inneg + 1) / (pos + neg + 1)
    tell = (inpos / pos - inneg / neg) / np.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)
    likely = (inpos / pos > 4 * inneg / neg) & (inpos > 0)
    clean = np.flatnonzero(inneg > 0)
    pool = clean[np.argsort(corpus.hash[clean])[:max_clean]]
    often = clean[np.lexsort((corpus.hash[clean], -inneg[clean]))]
    bad_side = y[corpus.doc] > 0
    told_window, told_doc, told_sentence = corpus.window[bad_side], corpus.doc[bad_side], corpus.sentence[bad_side]
    kernel = Kernel(x)
    hard = np.zeros(0, np.int64)
    weights, bias, rate = np.zeros(SIZE**3), 0.0, np.zeros(count)
    for k in range(rounds):
        # The highest window of each toxic sentence; of a document's sentences the highest.
        worth = np.where(likely, np.minimum(tell, 2 * sure) / sure + rate, -9.0)
        order = np.lexsort((-worth[told_window], told_sentence))
        best = order[np.unique(told_sentence[order], return_index=True)[1]]
        best = best[worth[told_window[best]] >= (1.0 if k == 0 else 0.5)]
        best = best[np.lexsort((-worth[told_window[best]], told_doc[best]))]
        place = np.arange(len(best)) - np.searchsorted(told_doc[best], told_doc[best])
        best = best[place < witnesses]
        stands = np.bincount(told_window[best], minlength=count)
        top = np.flatnonzero(stands)
        if not len(top):
            top = np.lexsort((corpus.hash, -tell))[:8]
            stands[top] = 1
        some = top[np.lexsort((corpus.hash[top], -tell[top]))][: 8 * landmarks]
        marks = [int(some[i]) for i in spread(dense(some_of(x, some))[0], landmarks if k == 0 else landmarks // 3)]
        if k == 0:
            marks += often[: landmarks // 2].tolist()
        else:
            marks += clean[np.argsort(-rate[clean], kind="stable")[: landmarks // 3]].tolist()
        kernel.land(marks)
        values, vectors = np.linalg.eigh((kernel.phi @ kernel.phi.T).astype(np.float64))
        good = values > 1e-5 * values[-1]
        white = vectors[:, good] / np.sqrt(values[good])
        # What tells less, but more than chance, may be of a witness's family: it stands for neither label.
        bad = np.union1d(pool, hard)
        bad = bad[(stands[bad] == 0) & ~(likely[bad] & (tell[bad] >= sure / 2))]
        a, b = stands[top].astype(float), inneg[bad].astype(float)
        extra = b * np.isin(bad, hard)
        weight = np.r_[a / a.sum(), b / max(1.0, b.sum()) + extra / max(1.0, extra.sum())]
        w, bias = _hinge(np.vstack([kernel.at(top), kernel.at(bad)]) @ white, np.r_[np.ones(len(top)), -np.ones(len(bad))], weight, 3000.0)
        weights = np.zeros(SIZE**3)
        weights[kernel.columns] = kernel.phi.T.astype(np.float64) @ (white @ w)
        rate = margins(x, weights, bias)
        hard = np.union1d(hard, clean[np.argsort(-rate[clean], kind="stable")[: max_clean // 8]])
    machine = Machine(weights.astype(np.float32), bias, float(np.quantile(rate[clean], 0.9)) if len(clean) else bias)
    sample = sorted(set(rows))
    machine.scale = _logistic(np.array(tops(machine, [text for text, _ in sample])), np.array([1 if label else -1 for _, label in sample]))
    return machine


def tops(machine: Machine, texts: list[str | None]) -> list[tuple[float, float, float]]:
    """The three highest distinct windows of each text, and the machine's floor where there are fewer."""
    table, heap = alphabet(), [{} for _ in texts]
    at = 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (not parts or size < BLOCK):
            parts.append(plain(texts[at] or ""))
            size += len(parts[-1])
            at += 1
        # A word that no window joins parts the texts.
        x = windows(" xxxx ".join(parts), table)
        if not len(x.size):
            continue
        value = margins(x, machine.weights, machine.bias)
        begins = np.cumsum([0, *(len(p) + 6 for p in parts[:-1])])
        some = np.flatnonzero(value > machine.floor)
        owner = np.searchsorted(begins, x.at[some], "right") - 1
        for i, doc in zip(some.tolist(), owner.tolist()):
            key = x.c[x.first[i] : x.first[i] + x.size[i]].tobytes()
            heap[first + doc][key] = float(value[i])
    out = []
    for found in heap:
        best = sorted(found.values(), reverse=True)[:3]
        out.append(tuple(best + [machine.floor] * (3 - len(best))))
    return out


def training(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """At most max_docs labelled texts and max_bytes of them, outside the held-out fifth, picked by a hash of the id, half of each label at most.

    Of rows that repeat an id the least text counts. What is taken is settled by sizes before any text leaves the
    executors: of each label in turn the next document, as long as all up to it fit.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    known = known.filter((F.col("toxic") == F.col("_most")) & (fold != 0)).drop("_most")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    half = [known.filter(F.col("toxic") == k).orderBy(*order).limit(max_docs // 2) for k in (1, 0)]
    picked = half[0].unionByName(half[1])
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select("doc_id", F.octet_length(text).cast("long").alias("size")).join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.max("size").alias("size"))
    # max_docs rows at most, a few numbers each.
    turn = F.row_number().over(W.partitionBy("toxic").orderBy(*order))
    upto = F.sum("size").over(W.orderBy("turn", "toxic", *order).rowsBetween(W.unboundedPreceding, 0))
    taken = sizes.withColumn("turn", turn).withColumn("upto", upto).filter(F.col("upto") <= max_bytes).select("doc_id", "toxic")
    # max_docs ids at most: broadcast, so that no other text moves.
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(taken), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy(*order).limit(max_docs)
    return [(r.text, r.toxic) for r in rows.collect()]


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = [machine.score(t) for t in tops(machine, texts)] if machine else [0.0] * len(texts)
            ids = batch.column(0).to_pylist()
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
