"""A unigram model, written out by hand, gives the library's ids: weights on arcs decide."""

from __future__ import annotations

import random
import struct

import sentencepiece
from tallyfield.llm import pieces


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


def model(rows: list[tuple[str, float]]) -> bytes:
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    out = b""
    for name, score, kind in special + [(name, score, 1) for name, score in rows]:
        out += message(1, message(1, name.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind))
    out += message(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1))
    return out + message(3, message(1, b"identity") + b"".join(varint(k << 3) + varint(v) for k, v in ((3, 1), (4, 0), (5, 1))))


def test_unigram_ids_are_the_library_s():
    rng = random.Random(8)
    letters = "abcdé"
    names = {*letters[:4], "▁", "▁a", "▁ab", "ab", "bc", "abc", "cda", "dd", "▁dd", "éa", ".", "bb", "cab"}
    names |= {"".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(60)}
    data = model([(name, -rng.uniform(2, 12)) for name in sorted(names)])
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Transducer(data)
    for _ in range(1500):
        text = "".join(rng.choice([*letters, " ", "ab", "cd", "中", "\n", ".", "😀"]) for _ in range(rng.randint(0, 40)))
        ids = own.encode(text)
        assert ids.tolist() == lib.encode(text)
        assert own.decode(ids) == text == lib.decode(ids.tolist())
