"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search runs over character boundaries. A boundary keeps the last piece of its best path; a piece that is
still to come starts within the longest piece's length of the end, so once the backpointer paths of all
boundaries in that window meet in one, everything before it is final: its ids are committed and its states
dropped. A text goes through one stream in portions; what the search holds follows the window, not the text.

Two kinds of model, read from the model file itself:
- unigram: the best path has the highest sum of scores, as Viterbi's search has it;
- BPE: the merges leave exactly one last piece per boundary, the one whose pair with the piece before it is
  stable, that is, merging the two pieces' characters alone gives those two pieces again. Paths of stable
  pairs are what the merges yield, so the same search gives the same ids.

All paths also meet where no piece of the vocabulary can reach across (between classes of characters that no
piece joins): a boundary there is committed as soon as the next character shows it. The stretches between such
boundaries recur, so a worker keeps the ids of a bounded number of short ones; the search itself runs on a
stretch that is new or long, and commits within it as its window allows.

The driver reads the model file, half a megabyte, and sends it along. Encoding is a map without a shuffle.
Normalisation covers the identity rule with the dummy prefix and white space options; other rules raise.

Defined results: null and empty texts have no ids; ids are as the file numbers them, unknown characters
become bytes where the model has them and its unknown id otherwise; U+2581 in a text decodes as a space, as
it is the mark for spaces; an empty table gives an empty result; columns of the input stay, but one named
like the result is replaced; very long texts are encoded whole, in portions; repeated rows have equal ids.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from array import array
from collections.abc import Iterator
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import worker_cache

MARK = "▁"
#: Fixed values of the model file's format: types of pieces and of models, and the penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Cached stretches have this many characters at most; a worker holds this many.
SHORT, HELD = 48, 400_000
#: A text goes into its stream in portions of so many characters.
PORTION = 1 << 14


def fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """(number, value) of a protocol buffer's fields."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


class Model:
    """The pieces, scores and rules of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer: dict[int, Any] = {}
        rules: dict[int, Any] = {}
        for number, value in fields(data):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece[2])
                self.kinds.append(piece[3])
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        self.bpe = trainer.get(3, UNIGRAM) == BPE
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE) or rules.get(2) or not rules.get(5, 1) or trainer.get(24) or USER in self.kinds:
            raise ValueError("only unigram and BPE models with the identity rule are covered")
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.longest = self.window = max(map(len, self.ids), default=1)
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.halves: dict[str, tuple[str, str]] = {}  # the two parts that a piece's last merge joins
        self.score = {p: self.scores[i] for p, i in self.ids.items()}
        self.known: dict[int, bool] = {}  # what `stable` has said
        if self.bpe:  # pieces that merges never reach don't occur
            for p in list(self.ids):
                if len(p) > 1 and self.merged(p) == [p]:
                    self.halves[p] = self._halves_
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or p in self.halves}
        self.stretches = self._cuts()
        self.sizes = [*map(len, self.pieces), 1]  # the last one is that of -1
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()

    def _cuts(self) -> re.Pattern[str] | None:
        """Matches stretches that no piece reaches across, or None if classes of characters can't tell."""
        letter = re.compile(r"[^\W\d_]")
        kind = lambda c: "S" if c == MARK else "L" if letter.match(c) and c not in moved else "N"
        moved: set[str] = set()
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        for a, b in pairs:
            moved |= {a} if kind(a) + kind(b) == "LN" and not a.isalpha() else {b} if kind(a) + kind(b) == "NL" and not b.isalpha() else set()
        if {kind(a) + kind(b) for a, b in pairs} & {"LN", "NL", "LS", "NS"}:
            return None
        other = re.escape("".join(sorted(moved)))
        return re.compile(rf"{MARK}*(?:[^\W\d_{other}]+|(?:[^\w{MARK}]|[\d_{other}])+)|{MARK}+")

    def merged(self, text: str) -> list[str]:
        """The merges' result: again and again the best-scored pair, the leftmost of equals."""
        parts, self._halves_ = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                return parts
            self._halves_ = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, before: int, piece: int) -> bool:
        """Whether the merges of the two pieces' characters end in these two.

        The merges on either side of the boundary are undone, the latest first. The pair that lies across the
        boundary at some stage would have been merged then if its score beats that of the merge undone last:
        it is to the right of a merge in the first piece, so it must score higher, and to the left of one in
        the second, where a tie is enough.
        """
        x, y, score, ties = self.pieces[before], self.pieces[piece], -math.inf, True
        while True:
            across = self.score.get(x + y)
            if across is not None and (across > score or (ties and across == score)):
                holds = False
                break
            left, right = self.halves.get(x), self.halves.get(y)
            if left is None and right is None:
                holds = True
                break
            if right is None or (left is not None and self.score[x] < self.score[y]):
                score, ties, x = self.score[x], False, left[1]
            else:
                score, ties, y = self.score[y], True, right[0]
        if len(self.known) > 1_000_000:
            self.known.clear()
        self.known[before << 32 | piece] = holds
        return holds

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def unknown_ids(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def decode(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i >= 0 and self.kinds[i] != CONTROL:
                out.append(self.surface if i == self.unknown else self.pieces[i].replace(MARK, " "))
        text = "".join(out)
        return text[1:] if self.prefix and text.startswith(" ") else text


class Stream:
    """Takes normalised characters as they come and gives ids as soon as they are final.

    `last` has the last piece of the best path to each boundary that isn't committed, as its id; -1 is a
    character that no piece covers. `open` is the piece before the first boundary.
    """

    def __init__(self, model: Model):
        self.model, self.window = model, model.longest
        self.text, self.open, self.gap, self.peak, self.meetings = "", -1, False, 0, 0
        self.last, self.best = [-1], [0.0]

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        step = 4 * self.window
        for at in range(0, len(text), step):
            self.text += text[at : at + step]
            self._advance()
            self.peak = max(self.peak, len(self.last))
            if len(self.last) > step:
                upto = self._meeting()
                self.meetings += upto > 0
                out += self._commit(upto)
        return out

    def finish(self) -> list[int]:
        out = self._commit(len(self.text))
        self.open, self.gap = -1, False
        return out

    def _advance(self) -> None:
        m, last, first = self.model, self.last, len(self.last)
        last += [-1] * (len(self.text) + 1 - first)
        found = m.automaton.iter(self.text, max(0, first - self.window))
        if m.bpe:
            known, stable = m.known, m.stable
            for at, (size, piece) in found:  # of pieces with one end, the longest comes first
                if last[at + 1] < 0 and at + 1 >= first:
                    before = last[at + 1 - size] if at + 1 > size else self.open
                    if before < 0 or (known[before << 32 | piece] if before << 32 | piece in known else stable(before, piece)):
                        last[at + 1] = piece
            return
        best = self.best + [-math.inf] * (len(last) - first)
        ends: dict[int, list[tuple[int, int]]] = {}
        for at, match in found:
            ends.setdefault(at + 1, []).append(match)
        for end in range(first, len(last)):
            lone = True
            for size, piece in ends.get(end, ()):
                lone &= size > 1
                if best[end - size] + m.scores[piece] > best[end]:
                    best[end], last[end] = best[end - size] + m.scores[piece], piece
            if lone and best[end - 1] + m.lowest - UNKNOWN_PENALTY > best[end]:
                best[end], last[end] = best[end - 1] + m.lowest - UNKNOWN_PENALTY, -1
        self.best = best

    def _meeting(self) -> int:
        """The boundary that all surviving paths share."""
        end = len(self.last) - 1
        paths = set(range(max(0, end - self.window + 1), end + 1))
        while len(paths) > 1:
            at = max(paths)
            paths.remove(at)
            paths.add(at - self.model.sizes[self.last[at]])
        return paths.pop()

    def _commit(self, upto: int) -> list[int]:
        m, at, path = self.model, upto, []
        while at > 0:
            path.append((self.last[at], at))
            at -= m.sizes[self.last[at]]
        out: list[int] = []
        for piece, at in reversed(path):
            if piece >= 0:
                out.append(piece)
                self.gap = False
            else:
                if m.bytes or not self.gap:
                    out += m.unknown_ids(self.text[at - 1])
                self.gap = not m.bytes
        if path:
            self.open = path[0][0]
            self.text, self.last = self.text[upto:], [-1, *self.last[upto + 1 :]]
            if not m.bpe:
                self.best = [x - self.best[upto] for x in self.best[upto:]]
        return out


class Encoder:
    """One text at a time, in portions: ids come out as they are committed.

    commits counts boundaries that were committed before the text's end, meetings those that the search found
    in its window; peak is the most characters and states held at once.
    """

    def __init__(self, model: Model, held: dict[Any, bytes]):
        self.model, self.held = model, held
        self.by_stretch = model.stretches is not None and (model.bpe or bool(model.bytes))
        # rest: the last stretch, which may go on; context: the last character of one that is in the search already.
        self.stream, self.rest, self.context = Stream(model), "", ""
        self.commits = self.meetings = self.peak = 0

    def feed(self, portion: str) -> bytes:
        """Ids that are final after a portion of normalised text."""
        if not self.by_stretch:
            return self._searched(portion)
        out = b""
        if self.context:
            take = self.model.stretches.match(self.context + portion).end() - 1
            out = self._searched(portion[:take])
            if take == len(portion):
                self.context = portion[-1:] or self.context
                return out
            out += self._ended()
            self.context, portion = "", portion[take:]
        text = self.rest + portion
        cut = text.rfind(MARK)
        while cut > 0 and text[cut - 1] == MARK:
            cut -= 1
        cut = max(0, cut)
        out += self._stretches(text[:cut])
        self.rest = text[cut:]
        if len(self.rest) > 4 * self.model.window:
            begin = 0
            for m in self.model.stretches.finditer(self.rest):
                begin = m.start()
            out += self._stretches(self.rest[:begin])
            self.rest = self.rest[begin:]
        if len(self.rest) > 4 * self.model.window:
            out += self._searched(self.rest)
            self.context, self.rest = self.rest[-1], ""
        self.peak = max(self.peak, len(self.rest))
        return out

    def _stretches(self, text: str) -> bytes:
        model, held, out = self.model, self.held, []
        if not text:
            return b""
        if text[0] == MARK and MARK + MARK not in text:
            words = text.split(MARK)[1:]
            self.commits += len(words)
            for word in words:
                ids = held.get(word)
                if ids is None:
                    ids = b"".join([self._stretch(s) for s in model.stretches.findall(MARK + word)])
                    if len(word) <= SHORT:
                        if len(held) >= HELD:
                            held.clear()
                        held[word] = ids
                out.append(ids)
            return b"".join(out)
        stretches = model.stretches.findall(text)
        self.commits += len(stretches)
        return b"".join([self._stretch(s) for s in stretches])

    def _stretch(self, s: str) -> bytes:
        ids = self.held.get((s,))
        if ids is None:
            ids = self._searched(s) + self._ended()
            if len(s) <= SHORT:
                if len(self.held) >= HELD:
                    self.held.clear()
                self.held[(s,)] = ids
        return ids

    def _searched(self, text: str) -> bytes:
        before = self.stream.meetings
        ids = array("i", self.stream.feed(text)).tobytes()
        self.meetings += self.stream.meetings - before
        self.commits += self.stream.meetings - before
        self.peak = max(self.peak, self.stream.peak)
        return ids

    def _ended(self) -> bytes:
        return array("i", self.stream.finish()).tobytes()

    def finish(self) -> bytes:
        if self.context or not self.by_stretch:
            self.context = ""
            return self._ended()
        rest, self.rest = self.rest, ""
        return self._stretches(rest)


def encode(model: Model, text: str, held: dict[Any, bytes] | None = None, encoder: Encoder | None = None) -> bytes:
    """The ids of a text as little-endian 32-bit integers. held: ids of stretches, and of whole words under the word."""
    encoder = encoder or Encoder(model, {} if held is None else held)
    text = model.normalise(text)
    if len(text) <= PORTION:
        return encoder.feed(text) + encoder.finish()
    out = [encoder.feed(text[at : at + PORTION]) for at in range(0, len(text), PORTION)]
    return b"".join(out) + encoder.finish()


def _model(data: bytes) -> tuple[Model, dict[str, bytes]]:
    return worker_cache(("sp", hashlib.sha256(data).digest()), lambda: (Model(data), {}))


def _with(df: DataFrame, name: str, kind: str, out: pa.DataType, make: Any) -> DataFrame:
    """df with a column made of each batch."""
    kept = [c for c in df.columns if c != name]
    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast(kind).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, make(batch)], [*kept, name])

    return df.mapInArrow(run, schema)


def encode_column(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of a column of texts as array<int>. model_path is read by the driver."""
    with open(model_path, "rb") as f:
        data = f.read()

    def make(batch: pa.RecordBatch) -> pa.Array:
        model, held = _model(data)
        rows = [encode(model, x, held) if x else b"" for x in batch.column(batch.schema.names.index(text)).to_pylist()]
        ends = np.cumsum([0, *map(len, rows)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32()))

    return _with(df, ids, "array<int>", pa.list_(pa.int32()), make)


def decode_column(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the texts of a column of ids."""
    with open(model_path, "rb") as f:
        data = f.read()

    def make(batch: pa.RecordBatch) -> pa.Array:
        model, _ = _model(data)
        return pa.array([model.decode(x or []) for x in batch.column(batch.schema.names.index(ids)).to_pylist()], pa.string())

    return _with(df, text, "string", pa.string(), make)


def digests(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text again)."""
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = _model(data)
        piece = [p.replace(MARK, " ").encode() if k in (NORMAL, USER, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else b"" for p, k in zip(model.pieces, model.kinds)]
        piece[model.unknown] = model.surface.encode()
        for batch in batches:
            n, sha, same = [], [], []
            for x in batch.column(1).to_pylist():
                ids = encode(model, x, held) if x else b""
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back = b"".join([piece[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode("utf-8", "replace")
                same.append((back[1:] if model.prefix and back.startswith(" ") else back) == (x or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_sha256", "round_trip"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, round_trip boolean")
