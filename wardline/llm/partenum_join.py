"""Jaccard join of word n-grams by PartEnum signatures.

A document's set holds its distinct shingles. Sets of sizes a and b whose Jaccard similarity is p percent or
more differ in (a + b)(100 - p) / (100 + p) elements at most. Sizes are cut into bands; a set takes part in its
own band and in each further band where a partner may be.

In a band the domain of elements is partitioned twice by hash: into first-level groups, and each group into n2
second-level parts. If two sets differ in d elements, one of d // (k2 + 1) + 1 groups holds k2 of the
differences at most, and these touch k2 parts at most: the sets agree in the other n2 - k2. So for each group
all subsets of n2 - k2 parts are enumerated, and the elements in a subset's parts make one signature; similar
sets share one. A group with k2 + 1 parts or more that aren't empty gives no empty subset. A set lists groups
in their fixed order until it has as many of that kind as its largest d asks for; of a pair's two lists the
shorter one decides, and the other covers it. A set that runs out of groups also lists the first of its
elements in hash order, as many as must meet one of a similar partner's (a few small sets, and none else).

Stages:
1. Equal texts are one class, merged map-side; their texts are written once, in buckets of the texts' digest,
   so that later joins don't move them. A class has a number of its own; its digest has 256 bits.
2. Signatures of classes go out in packed blocks, six bytes each, to one of many small ranges; classes that
   share one make a list. Lists recur (similar texts share many signatures) and are merged. A signature that
   is frequent within one block goes out in chunks of its own, which are never gathered.
3. Each list's least class is compared with the others; then, with the components known, classes of one list
   that lie in different components are compared with each other, by blocks of a chunk's size. A comparison
   of whole sets comes after one of sketches (parities of hash buckets, which differ in no more bits than the
   sets in elements). Of a list a class's nearest few partners come first; for lists that have more, another
   pass follows with the components that have come about, until none is left.

No list, chunk or candidate is dropped. Defined results: null and empty texts have an empty set and link with
nothing; rows that repeat an id are rows of their own; null ids stay null and don't name a component unless
nothing else is there; very long texts are sets like others (a worker holds one text at a time, and its
signatures); an empty table gives an empty result; `link` ignores other columns, `one_of_each` keeps them,
whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import WORDS
from wardline.operators.components import connected_components
from wardline.sources.scratch import Store

SEED = 11
#: Bands start at sizes that grow by this factor.
GROWTH = 1.5
#: Classes in a block of signatures at most (their places take 16 bits), and about how many signatures.
BLOCK, BLOCK_SIGS = 1 << 16, 1 << 20
#: Classes in a row of a list.
CHUNK = 2048
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _lowered() -> np.ndarray:
    """Bytes with A-Z as a-z; 0 for white space."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[0] = 255  # which no UTF-8 has
    return out


LOWERED = _lowered()
#: What a byte at one of the first places of a word adds to the word's hash.
PLACES = mixed((np.arange(64 * 256, dtype=np.uint64) + U(SEED)) * U(0x9E3779B97F4A7C15))
#: Bytes that are hashed at once, about.
PIECE = 1 << 20


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in bytes, and where each starts."""
    low = LOWERED[data]
    letters = np.flatnonzero(low)
    if not len(letters):
        return np.empty(0, np.uint64), letters
    opens = np.r_[True, np.diff(letters) > 1]
    first = np.flatnonzero(opens)
    starts = letters[first]
    place = letters - np.repeat(starts, np.diff(np.r_[first, len(letters)]))
    low = low[letters].astype(np.int64)
    value = PLACES[np.minimum(place, 63) << 8 | low]
    far = np.flatnonzero(place > 62)
    if len(far):
        value[far] = mixed((place[far].astype(np.uint64) << U(8) | low[far].astype(np.uint64)) * U(0xBF58476D1CE4E5B9) + U(SEED))
    return mixed(np.add.reduceat(value, first)), starts


def sets_of(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, some texts at a time; a long text goes in pieces."""
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size + len(texts[at] or b"") <= PIECE):
            some.append(texts[at] or b"")
            size += len(some[-1]) + 1
            at += 1
        data = np.frombuffer(b" ".join(some) + b" ", np.uint8)
        hashes, starts, begin = [], [], 0
        while begin < len(data):
            end = min(len(data), begin + 2 * PIECE)
            if end < len(data):
                space = np.flatnonzero(LOWERED[data[begin:end]] == 0)
                while not len(space) and end < len(data):  # a word longer than a piece
                    end = min(len(data), end + 2 * PIECE)
                    space = np.flatnonzero(LOWERED[data[begin:end]] == 0)
                end = begin + int(space[-1]) + 1 if len(space) else len(data)
            h, where = word_hashes(data[begin:end])
            hashes.append(h)
            starts.append(where + begin)
            begin = end
        h, where = np.concatenate(hashes), np.concatenate(starts)
        ends = np.cumsum([len(x) + 1 for x in some])
        cut = np.r_[0, np.searchsorted(where, ends)].tolist()
        acc = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for k in range(n):
            acc = mixed(acc + h[k : len(h) - n + 1 + k]) if len(acc) else acc
        for i, j in zip(cut[:-1], cut[1:]):
            if j - i >= n:
                s = np.sort(acc[i : j - n + 1])
                yield s[np.r_[True, s[1:] != s[:-1]]]
            elif j > i:
                one = np.full(1, j - i, np.uint64)
                for k in range(i, j):
                    one = mixed(one + h[k])
                yield one
            else:
                yield np.empty(0, np.uint64)


def band_starts(most: int) -> list[int]:
    """The least size of each band, up to the first beyond most."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -int(-out[-1] * GROWTH // 1)))
    return out


@dataclass(frozen=True)
class Layout:
    """How a band is partitioned: groups, parts of each (n2), differences that a group may hold (k2)."""

    band: int
    groups: int
    n2: int
    k2: int


def layout(band: int, top: int, percent: int) -> Layout:
    """The layout of a band whose largest sets have size top: more groups than differences need, as some are too empty."""
    d = 2 * top * (100 - percent) // (100 + percent)
    if d == 0:
        return Layout(band, 1, 1, 0)
    k2, n2 = (d, d + 4) if d <= 3 else (2, 5) if d < 12 else (1, 3)
    need = d // (k2 + 1) + 1
    return Layout(band, 1 if need == 1 else need + -(-need // 10) + 1, n2, k2)


def signatures(flat: np.ndarray, sizes: np.ndarray, differs: np.ndarray, lay: Layout, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets laid end to end in one band, and the place of each one's set. differs: the most differences of each."""
    g, n2, k2, sets = lay.groups, lay.n2, lay.k2, len(sizes)
    owner = np.repeat(np.arange(sets), sizes)
    h = mixed(flat + U(lay.band * 0x9E37 + 1))
    group = ((h >> U(32)) * U(g) >> U(32)).astype(np.int64)
    cell = (owner * g + group) * n2 + (h & U(0xFFFFFFFF)).astype(np.int64) % n2
    many = sets * g * n2
    count = np.bincount(cell, minlength=many).reshape(sets, g, n2)
    # A part stands for the sum of its elements' hashes; halves of 32 bits add up exactly as floats.
    m = mixed(flat)
    low, high = (np.bincount(cell, weights=x.astype(np.float64), minlength=many).astype(np.uint64) for x in (m & U(0xFFFFFFFF), m >> U(32)))
    value = mixed(mixed(low) + high).reshape(sets, g, n2)
    need = differs // (k2 + 1)
    rich = np.cumsum((count > 0).sum(2) > k2, axis=1)
    enough = rich[:, -1] > need
    upto = np.where(enough, (rich <= need[:, None]).sum(1) + 1, g)
    at, group = np.nonzero(np.arange(g)[None] < upto[:, None])
    value = mixed(value[at, group] + np.arange(n2, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
    count = count[at, group]
    base = mixed(group.astype(np.uint64) * U(4096) + U(lay.band))
    sigs, owners = [], []
    for k, subset in enumerate(itertools.combinations(range(n2), n2 - k2)):
        there = count[:, subset].sum(1) > 0
        sigs.append(mixed(base[there] + U(k) + value[:, subset].sum(1)[there]))
        owners.append(at[there])
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(~enough):
        s = np.sort(mixed(flat[ends[k] - sizes[k] : ends[k]]))
        # A similar partner has percent of this set's elements at least, so one of the first of both is common.
        s = s[: len(s) - -(-len(s) * percent // 100) + 1]
        sigs.append(mixed(s ^ U(lay.band * 0x51ED + 3)))
        owners.append(np.full(len(s), k))
    return np.concatenate(sigs), np.concatenate(owners)


def enumerated(sets: list[np.ndarray], percent: int, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures, places of their sets) of a batch of sets, a band and about so many cells at a time."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sizes) or not sizes.any():
        return
    furthest = sizes * 100 // percent
    starts = np.array(band_starts(int(furthest.max())))
    own, last = (np.searchsorted(starts, x, "right") - 1 for x in (sizes, furthest))
    for band in range(own[sizes > 0].min(), last.max() + 1):
        there = np.flatnonzero((sizes > 0) & (own <= band) & (band <= last))
        top = int(starts[band + 1]) - 1
        lay = layout(band, top, percent)
        step = max(1, cells // (lay.groups * lay.n2))
        for k in range(0, len(there), step):
            some = there[k : k + step]
            differs = (sizes[some] + np.minimum(furthest[some], top)) * (100 - percent) // (100 + percent)
            sig, place = signatures(np.concatenate([sets[i] for i in some]), sizes[some], differs, lay, percent)
            yield sig, some[place]


def sketch(s: np.ndarray) -> bytes:
    """The parity of the elements in each of 64 buckets or more, four for an element; two sets differ in as many elements as their sketches in bits, or more."""
    bits = 1 << min(16, max(6, (len(s) - 1).bit_length() + 2))
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(x: int, bits: int, to: int) -> int:
    """The sketch with fewer buckets."""
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


#: Kinds of packed rows, in the order that a reducer needs: chunks of frequent signatures, blocks, what is known of a class.
HOT, PLAIN, INFO = 0, 1, 2


def packed(classes: DataFrame, n: int, percent: int, parts: int, hot: int) -> DataFrame:
    """part, kind, sig, base, places, sigs: signatures in blocks, and a row for each class with its size and sketch.

    The high half of a signature says its part, the low half goes with its class's place in the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "kind", "sig", "base", "places", "sigs"]

        def block(base: int, sigs: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sig, place = np.concatenate(sigs), np.concatenate(places)
            key = ((sig >> U(32)) * U(parts) & ~U(0xFFFFFFFF)) | (sig & U(0xFFFFFFFF))
            order = np.argsort(key)
            key, place = key[order], place[order].astype(np.uint16)
            part, low = (key >> U(32)).astype(np.int64), key.astype(np.uint32)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(part)])
            frequent = np.repeat(size > hot, size)
            rows = [
                (int(part[i]), HOT, int(low[i]), place[j : min(j + CHUNK, i + c)].tobytes(), b"")
                for i, c in zip(first[size > hot].tolist(), size[size > hot].tolist())
                for j in range(i, i + c, CHUNK)
            ]
            part, low, place = part[~frequent], low[~frequent], place[~frequent]
            ends = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
            rows += [(int(part[i]), PLAIN, 0, place[i:j].tobytes(), low[i:j].tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            for k in range(0, len(rows), 4096):
                p, kind, s, x, y = zip(*rows[k : k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array(s, pa.int64()), pa.array([base] * len(p), pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names)

        # A block has the classes whose numbers differ in their low 16 bits only.
        base, amount = -1, 0
        sigs: list[np.ndarray] = []
        places: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = sets_of(batch.column(1).cast(pa.binary()).to_pylist(), n)
            at = 0
            while at < len(ids):
                if sigs and (ids[at] & -BLOCK != base or amount >= BLOCK_SIGS):
                    yield from block(base, sigs, places)
                    sigs, places, amount = [], [], 0
                base, begin, elements = ids[at] & -BLOCK, at, 0
                sets: list[np.ndarray] = []
                while at < len(ids) and ids[at] & -BLOCK == base and elements < BLOCK_SIGS // 2:
                    sets.append(next(found))
                    elements += len(sets[-1])
                    at += 1
                some = np.array(ids[begin:at], np.int64)
                for sig, k in enumerated(sets, percent):
                    sigs.append(sig)
                    places.append((some - base)[k])
                    amount += len(sig)
                count = len(some)
                spread = (mixed(some.astype(np.uint64)) >> U(32)) * U(parts) >> U(32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread.astype(np.int32)), pa.array([INFO] * count, pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array(some), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([b""] * count, pa.binary())],
                    names,
                )
        if sigs:
            yield from block(base, sigs, places)

    return classes.select("id", "text").mapInArrow(run, "part int, kind int, sig long, base long, places binary, sigs binary")


def _lists(chunk: int):  # noqa: ANN202
    """The classes that share a signature, out of sorted packed rows; equal lists of one part come out once."""
    names = ["kind", "g", "several", "ids", "id", "n", "sketch"]

    def lists(g: list[int], several: list[bool], flat: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        count = len(g)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([0] * count, pa.int32()), pa.array(g, pa.int64()), pa.array(several, pa.bool_()), ids, pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64()), pa.nulls(count, pa.binary())], names)

    def named(part: int, sig: np.ndarray) -> np.ndarray:
        return mixed((U(part) << U(32)) + sig.astype(np.uint64) + U(0xA5)).view(np.int64)

    def rows(part: int, held: list[tuple[int, bytes, bytes]], frequent: set[int]) -> Iterator[pa.RecordBatch]:
        low = np.concatenate([np.frombuffer(y, np.uint32) for _, _, y in held])
        ids = np.concatenate([np.frombuffer(x, np.uint16).astype(np.int64) + base for base, x, _ in held])
        order = np.lexsort((ids, low))
        low, ids = low[order], ids[order]
        # A class may come to one signature twice, by chance.
        fresh = np.r_[True, (low[1:] != low[:-1]) | (ids[1:] != ids[:-1])]
        low, ids = low[fresh], ids[fresh]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        size = np.diff(np.r_[first, len(low)])
        hot = np.isin(low[first], np.array(sorted(frequent), np.uint32)) if frequent else np.zeros(len(first), bool)
        total = np.add.reduceat(mixed(ids.astype(np.uint64) + U(7)), first)
        plain = np.flatnonzero((size > 1) & (size <= chunk) & ~hot)
        _, one = np.unique(total[plain], return_index=True)
        plain = plain[one]
        for k in range(0, len(plain), 8192):
            some = plain[k : k + 8192]
            ends = np.r_[0, np.cumsum(size[some])]
            flat = ids[np.arange(ends[-1]) - np.repeat(ends[:-1] - first[some], size[some])]
            yield lists(total[some].view(np.int64).tolist(), [False] * len(some), flat, ends)
        for i in np.flatnonzero(hot | (size > chunk)).tolist():
            g = int(named(part, low[first[i] : first[i] + 1])[0])
            for j in range(first[i], first[i] + size[i], chunk):
                piece = ids[j : min(j + chunk, first[i] + size[i])]
                yield lists([g], [True], piece, np.array([0, len(piece)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, frequent = -1, [], set()
        for batch in batches:
            if not len(batch):
                continue
            known = batch.filter(pa.compute.equal(batch.column(1), INFO))
            if len(known):
                count = len(known)
                none = pa.ListArray.from_arrays(pa.array([0] * (count + 1), pa.int32()), pa.array([], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([1] * count, pa.int32()), pa.nulls(count, pa.int64()), pa.nulls(count, pa.bool_()), none, known.column(3), known.column(2), known.column(4)], names)
            rest = batch.filter(pa.compute.not_equal(batch.column(1), INFO))
            for p, kind, sig, base, x, y in zip(*(c.to_pylist() for c in rest.columns)):
                if p != part:
                    if held:
                        yield from rows(part, held, frequent)
                    part, held, frequent = p, [], set()
                if kind == HOT:
                    frequent.add(sig)
                    ids = np.sort(np.frombuffer(x, np.uint16).astype(np.int64) + base)
                    yield lists([int(named(p, np.array([sig], np.uint32))[0])], [True], ids, np.array([0, len(ids)]))
                else:
                    held.append((base, x, y))
        if held:
            yield from rows(part, held, frequent)

    return run, "kind int, g long, several boolean, ids array<long>, id long, n long, sketch binary"


def fits(percent: int):  # noqa: ANN202
    """Whether sizes and the sketches' distance leave a pair possible."""

    def one(n: int, m: int, x: bytes, y: bytes) -> bool:
        if 100 * min(n, m) < percent * max(n, m):
            return False
        bits = 8 * min(len(x), len(y))
        apart = (folded(int.from_bytes(x, "little"), 8 * len(x), bits) ^ folded(int.from_bytes(y, "little"), 8 * len(y), bits)).bit_count()
        return apart * (100 + percent) <= (n + m) * (100 - percent)

    return one


def possible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that sizes and sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = fits(percent)
        for batch in batches:
            keep = [fit(*x) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    b = info.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    a = info.select(F.col("id").alias("a"), "n", F.col("sketch").alias("x"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


@dataclass
class Members:
    """Classes of one list, or of two blocks of it."""

    block: np.ndarray
    id: np.ndarray
    n: np.ndarray
    comp: np.ndarray
    sketch: list[bytes]


def near_pairs(m: Members, first: int, second: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of different components that sizes and sketches allow, within a block or across two, and the sketches' distance."""
    width = np.array([len(x) for x in m.sketch])
    left, right, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in np.unique(width).tolist():
        for v in (w, 2 * w):
            turns = [(first, second)] if first == second or v == w else [(first, second), (second, first)]
            for one, two in turns:
                a, b = np.flatnonzero((width == w) & (m.block == one)), np.flatnonzero((width == v) & (m.block == two))
                if not len(a) or not len(b):
                    continue
                x = np.frombuffer(b"".join([m.sketch[i] for i in a]), np.uint64).reshape(len(a), -1)
                y = np.frombuffer(b"".join([m.sketch[i] for i in b]), np.uint64).reshape(len(b), -1)
                y = y if v == w else y[:, : w // 8] ^ y[:, w // 8 :]
                for k in range(0, len(a), 64):
                    i = a[k : k + 64]
                    s, t = m.n[i][:, None], m.n[b][None, :]
                    hit = (m.comp[i][:, None] != m.comp[b][None, :]) & (100 * np.minimum(s, t) >= percent * np.maximum(s, t))
                    if first == second and v == w:
                        hit &= i[:, None] < b[None, :]
                    p, q = np.nonzero(hit)
                    if not len(p):
                        continue
                    apart = np.bitwise_count(x[k + p] ^ y[q]).sum(axis=1, dtype=np.int64)
                    i, j = i[p], b[q]
                    close = apart * (100 + percent) <= (m.n[i] + m.n[j]) * (100 - percent)
                    left.append(i[close])
                    right.append(j[close])
                    distance.append(apart[close])
    return np.concatenate(left), np.concatenate(right), np.concatenate(distance)


def nearest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs come first: the `most` nearest of each class."""
    keep = np.zeros(len(i), bool)
    for x in (i, j):
        order = np.lexsort((apart, x))
        first = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        keep[order[place < most]] = True
    return keep


def _across(percent: int, most: int):  # noqa: ANN202
    """Pairs of different components within lists, out of rows sorted by list; (list, null) where more than most are left of a class's."""
    fit = fits(percent)

    def small(rows: list[tuple[int, int, int, int, bytes]]) -> tuple[list[int], list[int]]:
        a, b = [], []
        for k, (_, i, n, c, x) in enumerate(rows):
            for _, j, m, d, y in rows[:k]:
                if c != d and fit(n, m, x, y):
                    a.append(min(i, j))
                    b.append(max(i, j))
        return a, b

    def large(rows: list[tuple[int, int, int, int, bytes]], g: int, first: int, second: int) -> tuple[list[int], list[int]]:
        block, ids, n, comp, sketches = zip(*rows)
        m = Members(*(np.array(x, np.int64) for x in (block, ids, n, comp)), list(sketches))
        i, j, apart = near_pairs(m, first, second, percent)
        if not len(i):
            return [], []
        keep = nearest(i, j, apart, most)
        x, y = m.id[i[keep]], m.id[j[keep]]
        more = not keep.all()
        return np.minimum(x, y).tolist() + [g] * more, np.maximum(x, y).tolist() + [None] * more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        a: list[int] = []
        b: list[int | None] = []

        def closed() -> None:
            # Short lists, of which there are most, aren't worth arrays.
            x, y = small(rows) if len(rows) <= min(24, most + 1) and at[1] == at[2] else large(rows, *at)
            a.extend(x)
            b.extend(y)

        def told() -> pa.RecordBatch:
            # A pair may be in many lists; here it goes out once.
            pairs = sorted(set(zip(a, b)), key=lambda p: (p[0], p[1] or -1))
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int64()), pa.array([q for _, q in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for g, first, second, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, first, second) != at:
                    if rows:
                        closed()
                    at, rows = (g, first, second), []
                    if len(a) > 1 << 17:
                        yield told()
                rows.append(tuple(row))
        if rows:
            closed()
        yield told()

    return run


class Join:
    """The classes of docs and their links."""

    def __init__(self, docs: DataFrame, n: int, percent: int, chunk: int = CHUNK, hot: int = 1024, most: int = 1, keep_rows: bool = False):
        if not 50 <= percent <= 100:
            raise ValueError("percent is 50 to 100")
        spark = docs.sparkSession
        self.spark, self.n, self.percent, self.chunk, self.hot, self.most = spark, n, percent, chunk, hot, most
        self.store = Store(spark)
        self.parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        sha = F.unhex(F.sha2("text", 256)).alias("sha")
        rows = docs.filter(F.col("text").rlike(WORDS))
        doc_id = F.col("doc_id").cast("long").alias("doc_id")
        if keep_rows:
            # Of rows with one text, that of the smallest id, and of these the first by all columns.
            columns = {c: F.col(f"`{c}`") for c in docs.columns}
            others = F.to_json(F.struct(*[x for c, x in columns.items() if c != "text"]))
            rows = rows.select(sha, doc_id, F.struct(*columns.values()).alias("row"), F.struct(F.col("doc_id").isNull(), doc_id, others).alias("order"))
            classes = rows.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.min_by("row", "order").alias("row"))
        else:
            classes = rows.select(sha, doc_id, "text").groupBy("sha").agg(F.min("doc_id").alias("rep"), F.first("text").alias("text"))
        self.name = self.store.table("texts")
        classes.withColumn("id", F.monotonically_increasing_id()).write.bucketBy(self.parts, "sha").format("parquet").saveAsTable(self.name)
        self.store.drop()
        self.texts = spark.table(self.name)
        if keep_rows:
            self.texts = self.texts.withColumn("text", F.col("row.text"))

    def lists(self) -> tuple[DataFrame, DataFrame]:
        """(g, several, ids): classes that share a signature; (id, n, sketch): all classes."""
        parts = 4 * self.parts
        run, schema = _lists(self.chunk)
        rows = packed(self.texts, self.n, self.percent, parts, self.hot)
        rows = rows.repartition(self.parts, "part").sortWithinPartitions("part", "kind", "sig")
        both = self.store.cut(rows.mapInArrow(run, schema), "lists", by="kind")
        self.store.drop()
        lists = both.filter("kind = 0").select("g", "several", "ids")
        once = lists.filter("NOT several").groupBy("ids").agg(F.min("g").alias("g")).select("g", F.lit(False).alias("several"), "ids")
        return self.store.cut(once.unionByName(lists.filter("several")), "once"), both.filter("kind = 1").select("id", "n", "sketch")

    def checked(self, pairs: DataFrame) -> DataFrame:
        """a, b, linked: pairs compared on their whole sets."""
        n, percent = self.n, self.percent

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = [s.tobytes() for s in sets_of(batch.column(1).cast(pa.binary()).to_pylist(), n)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary())], ["id", "s"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

        texts = self.texts
        some = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        some = self.store.cut(some.join(texts.select("id", "sha"), "id").select("sha"), "some")
        # Texts lie in buckets of sha and stay where they are.
        whole = self.store.cut(texts.select("id", "sha", "text").join(some, "sha", "left_semi").select("id", "text").mapInArrow(sets, "id long, s binary"), "sets")
        # The larger id's set goes along with the pair; the smaller one, which may have many partners, is met in place.
        b = whole.select(F.col("id").alias("b"), F.col("s").alias("y"))
        a = whole.select(F.col("id").alias("a"), F.col("s").alias("x"))
        out = self.store.cut(pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, linked boolean"), "checked")
        self.store.drop(some, whole)
        return out

    def components(self) -> tuple[DataFrame, DataFrame]:
        """(node, component) of linked classes by number; (id, n) of all."""
        store = self.store
        lists, info = self.lists()
        least = lists.filter("several").groupBy("g").agg(F.min(F.array_min("ids")).alias("low"))
        one = lists.filter("NOT several").select(F.element_at("ids", 1).alias("a"), F.explode("ids").alias("b"))
        far = lists.filter("several").join(least, "g").select(F.col("low").alias("a"), F.explode("ids").alias("b"))
        pairs = one.unionByName(far).filter("a <> b").distinct()
        pairs = store.cut(possible(pairs, info, self.percent), "possible")
        done = self.checked(pairs)
        store.drop(pairs)
        comps = store.cut(connected_components(done.filter("linked"), store), "components")
        # Rows of a list are its blocks; a list of several rows has its blocks compared two by two.
        by = W.partitionBy("g")
        rows = lists.filter(F.col("several") | (F.size("ids") > 2))
        block = F.row_number().over(by.orderBy(F.element_at("ids", 1), F.size("ids"), F.xxhash64("ids"))) - 1
        long_ = rows.filter("several").withColumn("block", block).withColumn("blocks", F.count("*").over(by).cast("int"))
        short = rows.filter("NOT several").withColumn("block", F.lit(0)).withColumn("blocks", F.lit(1))
        rows = store.cut(short.unionByName(long_).select("g", "block", "blocks", "ids"), "blocks")
        store.drop(lists)
        most = self.most
        while True:
            found = self._across(rows, info, comps, most)
            found = store.cut(found.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), "found")
            more = store.cut(found.filter("b IS NULL").select(F.col("a").alias("g")).distinct(), "more")
            fresh = store.cut(found.filter("b IS NOT NULL").join(done, ["a", "b"], "left_anti"), "fresh")
            if not fresh.isEmpty():
                new = self.checked(fresh)
                links = new.filter("linked")
                if not links.isEmpty():
                    # New links join components; what they join is named by its least.
                    of = lambda x: links.select("a", "b").join(comps, F.col(x) == F.col("node"), "left").select("a", "b", F.coalesce("component", x).alias("c"))  # noqa: E731, B023
                    ends = of("a").withColumnRenamed("c", "x").join(of("b").withColumnRenamed("c", "y"), ["a", "b"])
                    merged = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), store)
                    fresh_nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps, "node", "left_anti").select("node", F.col("node").alias("component"))
                    known = comps.unionByName(fresh_nodes).join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
                    after = store.cut(known.select("node", F.coalesce("to", "component").alias("component")), "components")
                    store.drop(comps)
                    comps = after
                all_ = store.cut(done.unionByName(new), "done")
                store.drop(done, new)
                done = all_
            store.drop(found, fresh)
            if more.isEmpty():
                return comps, info.select("id", "n")
            rows, most = store.cut(rows.join(more, "g", "left_semi"), "blocks"), 32 * most

    def _across(self, rows: DataFrame, info: DataFrame, comps: DataFrame, most: int) -> DataFrame:
        members = rows.select("g", "block", "blocks", F.explode("ids").alias("id"))
        members = members.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        ends = members.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        members = members.join(ends.filter("low < high").select("g"), "g", "left_semi").join(info, "id")
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
        members = members.select("g", "first", "second", "block", "id", "n", "comp", "sketch")
        members = members.repartition(self.parts, "g", "first", "second").sortWithinPartitions("g", "first", "second")
        return members.mapInArrow(_across(self.percent, most), "a long, b long")

    def classes(self) -> DataFrame:
        """sha, id, n, rep, component (a class's number): a row for each class."""
        comps, sizes = self.components()
        texts = self.texts.select("sha", "id", "rep")
        out = texts.join(sizes, "id").join(comps, F.col("id") == F.col("node"), "left").select("sha", "id", "n", "rep", F.coalesce("component", "id").alias("component"))
        return self.store.cut(out, "classes")


def link(docs: DataFrame, n: int = 5, percent: int = 75, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs. The result reads a small table of the shared folder."""
    join = Join(docs, n, percent, **sizes)
    classes = join.classes()
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = join.store.cut(classes.join(least, "component").select("sha", "n", "component_id"), "linked")
    join.store.close(out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(WORDS), F.unhex(F.sha2("text", 256))).alias("sha"))
    return rows.join(out, "sha", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75, **sizes: int) -> DataFrame:
    """One row of each group that links join, over any number of them: that of the smallest id, a null id last.

    Of rows with the same id, or none, one of the smallest digest and then the first by all columns stays. Rows without words all
    stay. Columns stay as they are. The result reads tables of the shared folder.
    """
    join = Join(docs, n, percent, keep_rows=True, **sizes)
    classes = join.classes()
    kept = classes.groupBy("component").agg(F.min_by("sha", F.struct(F.col("rep").isNull(), "rep", "sha")).alias("sha")).select("sha")
    out = join.store.cut(join.texts.select("sha", "row").join(kept, "sha", "left_semi").select("row.*"), "kept")
    join.store.close(out)
    return out.unionByName(docs.filter(~F.coalesce(F.col("text").rlike(WORDS), F.lit(False))))
