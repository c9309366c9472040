"""SentencePiece encoding and decoding as shortest paths in a weighted transducer.

Three machines are compiled from a model file and composed with each text:

1. the normaliser: one dummy mark before a non-empty text, space -> mark (models with a character map are refused);
2. the piece lexicon: arcs that read a piece's characters and write its number;
3. byte fallback: a character that no piece has is read by an arc that writes its UTF-8 bytes' numbers.

In the tropical semiring the path of least weight gives the pieces. For a model of the unigram kind an arc weighs its
piece's negative log-probability, a fallback arc ten more than the rarest piece, and states are positions. For a model of
the merging kind (BPE) the result is the one segmentation in which every two neighbours would merge to just themselves; so
a fourth machine over pairs of pieces weighs an arc 0 after a piece that it may follow and infinity else, and states are
(position, last piece). As each prefix has just one such state of finite weight, the forward pass keeps one state per
position there too. Time is linear in the text for both kinds, however long it is.

No piece holds a mark after another character, a line end, or certain signs after a letter (found when compiling; a model
without such places is composed whole), so paths of the parts between such places are found apart, and remembered up
to a bounded number of parts.

Defined cases: null and empty texts have no ids and decode to ""; a mark in the text decodes to a space, as the
vocabulary can't tell them apart (round_trip is false there); texts are encoded whole, very long ones and very long parts
too; equal texts get equal ids; of paths of equal weight the one whose last piece is longest is used; added columns that
would clash with those there get underscores before their names.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
PARTS = 200_000
PAIRS = 400_000
LONG = 48
UNIGRAM, MERGING = 1, 2
#: How much more than the rarest piece a fallback arc of the unigram kind weighs (fixed value of the format).
UNKNOWN = 10.0
CHUNK_CHARS = 2_000_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class Transducer:
    """The composed machine of one model file; `encode` and `decode` one text at a time."""

    def __init__(self, data: bytes) -> None:
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.raw: list[bytes] = []
        self.byte_id = [-1] * 256
        self.prefix = self.escape = True
        self.kind = UNIGRAM
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                name = own[1].decode()
                if own.get(3, 1) == 1:
                    self.ids[name] = len(self.raw)
                    self.score[name] = struct.unpack("<f", own[2])[0]
                    self.raw.append(name.replace(MARK, " ").encode())
                elif own.get(3) == 6:
                    b = int(name[3:5], 16)
                    self.byte_id[b] = len(self.raw)
                    self.raw.append(bytes([b]))
                else:  # control pieces and the unknown piece are never written
                    self.raw.append(b"")
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(fields(value))
                self.prefix, self.escape = bool(own.get(3, 1)), bool(own.get(5, 1))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("models that map characters or squeeze spaces are not supported")
        if self.kind not in (UNIGRAM, MERGING) or -1 in self.byte_id:
            raise ValueError("only unigram and merging models with byte fallback are supported")
        self.unknown = UNKNOWN - min(self.score.values(), default=0.0)
        self.lexicon = ahocorasick.Automaton()
        for name in self.ids:
            self.lexicon.add_word(name, name)
        self.lexicon.make_automaton()
        self.part = re.compile(self._parts())
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def _parts(self) -> str:
        """A pattern for parts that no piece reaches across. A part starts at marks after another character, at line
        ends, and at a sign that follows a letter or digit in no piece, when it does so in the text."""
        before: dict[str, set[str]] = {}
        for name in self.ids:
            for a, b in zip(name, name[1:], strict=False):
                before.setdefault(b, set()).add(a)
        if "\n" in before or before.get(MARK, {MARK}) - {MARK}:
            return r"(?s).+"
        letter = re.compile(r"[^\W_]")
        signs = {c for name in self.ids for c in name if not letter.match(c) and c not in (MARK, "_") and not any(map(letter.match, before.get(c, ())))}
        own = re.escape("".join(sorted(signs)))
        other, after = rf"(?:[^\w{MARK}\n]|_)", rf"(?:[^\w{MARK}\n{own}]|_)"
        return rf"(?=[^\n]){MARK}*+{other}*+[^\W_]*+(?:{after}{other}*+[^\W_]*+)*+|\n"

    def merged(self, text: str) -> list[str]:
        """The merging rule itself, on a short text: join the best-scored neighbours, leftmost first, until none join."""
        parts = list(text)
        while True:
            found = [(-self.score[w], k) for k in range(len(parts) - 1) if (w := parts[k] + parts[k + 1]) in self.score]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def allowed(self, a: str, b: str) -> bool:
        """Weight of the pair machine: may b stand right after a? An empty a is the start."""
        known = self.pairs.get(a, {}).get(b)
        return self.follows(a, b) if known is None else known

    def follows(self, a: str, b: str) -> bool:
        """The same, worked out anew and remembered."""
        if self.n_pairs >= PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.pairs.setdefault(a, {})[b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def path(self, text: str) -> list[str]:
        """The path of least weight through one part, as the strings that its arcs read."""
        return self.lightest(text) if self.kind == UNIGRAM else self.only(text)

    def lightest(self, text: str) -> list[str]:
        """The unigram kind: least sums of weights by position. The lexicon machine gives the arcs into each position,
        longest first; a character that is no piece has a fallback arc."""
        least: list[float] = [0.0] + [math.inf] * len(text)
        last = [""] * (len(text) + 1)
        done, score = 0, self.score

        def fall_back(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if text[done - 1] not in score and least[done - 1] + self.unknown < least[done]:
                    least[done], last[done] = least[done - 1] + self.unknown, text[done - 1]

        for end, piece in self.lexicon.iter(text):
            if done < end:
                fall_back(end)
            weight = least[end + 1 - len(piece)] - score[piece]
            if weight < least[end + 1]:
                least[end + 1], last[end + 1] = weight, piece
        fall_back(len(text))
        return self._back(text, last)

    @staticmethod
    def _back(text: str, last: list) -> list[str]:
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def only(self, text: str) -> list[str]:
        """The merging kind: at most one arc into a position has finite weight, so the first found is the lightest."""
        last: list[str | None] = [""] + [None] * len(text)
        pairs, none, done = self.pairs, {}, 0

        def alone(upto: int) -> None:
            """A lone character is an arc even if it is no piece: it falls back to bytes."""
            nonlocal done
            while done < upto:
                done += 1
                if last[done] is None and last[done - 1] is not None and self.allowed(last[done - 1], text[done - 1]):
                    last[done] = text[done - 1]

        for end, piece in self.lexicon.iter(text):
            if done < end:
                alone(end)
            if last[end + 1] is None:
                before = last[end + 1 - len(piece)]
                if before is not None:
                    known = pairs.get(before, none).get(piece)
                    if known or (known is None and self.follows(before, piece)):
                        last[end + 1] = piece
        alone(len(text))
        return self._back(text, last)

    def __getitem__(self, part: str) -> bytes:
        """The numbers of one part, as int32 bytes. Parts are remembered in two generations: when the younger one is
        full it becomes the elder, so that frequent parts stay and memory is bounded."""
        found = self.known.get(part)
        if found is not None:
            return found
        found = self.elder.get(part)
        if found is None:
            ids: list[int] = []
            for piece in self.path(part):
                own = self.ids.get(piece)
                ids += [own] if own is not None else [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]
            found = array("i", ids).tobytes()
        if len(part) <= LONG:
            if len(self.known) >= PARTS:
                self.known, self.elder = {}, self.known
            self.known[part] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        text = text.replace(" ", MARK) if self.escape else text
        parts = self.part.findall(MARK + text if self.prefix else text)
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_compiled: dict[int, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """One machine per worker process and model."""
    key = hash(data)
    if key not in _compiled:
        _compiled[key] = Transducer(data)
    return _compiled[key]


def tokenize(docs: DataFrame, data: bytes | None = None) -> DataFrame:
    """docs plus ids (array of int), n_tokens and round_trip (does decoding give the text back; names that are taken get an
    underscore), row by row, no shuffle.

    The model (half a megabyte, read on the driver) goes to the executors with the function.
    """
    data = load() if data is None else data
    names = list(fresh(docs, "ids", "n_tokens", "round_trip").values())
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(data)
        for batch in batches:
            at = 0
            texts = batch.column(batch.schema.get_field_index("text"))
            while at < len(batch):
                ids, sizes, same, total, end = [], [], [], 0, at
                while end < len(batch) and total < CHUNK_CHARS:
                    text = texts[end].as_py() or ""
                    own = machine.encode(text)
                    ids.append(own)
                    sizes.append(len(own))
                    same.append(machine.decode(own) == text)
                    total += len(text)
                    end += 1
                part = batch.slice(at, end - at)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                arrays = [part.column(part.schema.get_field_index(c)) for c in (*rest, "text")]
                arrays += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes, pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(arrays, [*rest, "text", *names])
                at = end

    shape = docs.select(*rest, "text").schema.add(names[0], T.ArrayType(T.IntegerType())).add(names[1], T.LongType()).add(names[2], T.BooleanType())
    return docs.select(*rest, "text").mapInArrow(run, shape)


def op3_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "round_trip")


QUERIES = {"op3_piece_transducer": op3_piece_transducer}
ORACLE: dict[str, str] = {}
