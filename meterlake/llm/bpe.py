"""Byte-pair encoding and decoding with a public vocabulary file.

A text is cut at special tokens, normalised and split into words. A word's
symbols stand in one array beside an array of the ranks of neighbouring pairs;
the smallest rank is looked for, its boundary deleted and the two ranks beside
it looked up anew, until no pair can merge. Most words are short, so the plain
scan beats a heap; the few of more than LONG symbols, whose scan would grow with
the square, are merged in the same order with one. Words met before come from a
bounded table.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slim

NONE = 1 << 60
#: Symbols over which a word's merges are found with a heap.
LONG = 512
#: Words a worker remembers; over this it starts anew.
REMEMBERED = 400_000
#: Rows of one output batch.
ROWS = 256
#: Code points that are letters or digits only since a later Unicode version (17 on) than the one by which the vocabulary's words are split (16).
LATER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee
11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20
18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
#: Code points that combine by Python's tables (15.1) but not by those (9) with which the library composes texts; to it they are letters of their own.
ALONE = """
7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b
1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae
1e2ec-1e2ef 1e4ec-1e4ef
"""
#: Capitals of Unicode 16 and 17 and their small letters, which Python's tables (15.1) may not know yet.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Stands for the later ones while a text is split; neither letter nor digit in any version.
PRIVATE = "\ue000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def one_of(ranges: str) -> str:
    """A pattern for code points given as hexadecimal ranges."""
    return "[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges.split()) + "]"


class Codec(dict):
    """Encoder and decoder of one vocabulary; as a dict, the encoded words met so far."""

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        file = json.loads(vocabulary)
        model = file["model"]
        ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges = [(ids[a] << 20 | ids[b], ids[a + b]) for a, b in pairs]
        self.ranks = {pair: rank for rank, (pair, _) in enumerate(merges)}
        self.merged = [made for _, made in merges]
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + self.end] for c in letters]
        split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.later = re.compile(one_of(LATER))
        self.alone = re.compile(f"({one_of(ALONE)})")
        self.capitals = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.squeezed = any(n["type"] == "Lowercase" for n in file["normalizer"]["normalizers"])

    def __missing__(self, word: str) -> bytes:
        """Ids of one word, packed: the merge loop over the contiguous arrays."""
        raw = word.encode("utf-8", "replace")
        inner, rank, merged = self.inner, self.ranks.get, self.merged
        parts = [inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        if len(parts) > LONG:
            parts = self._long(parts)
            return struct.pack(f"<{len(parts)}I", *parts)
        near = [rank(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while near and (least := min(near)) < NONE:
            i = near.index(least)
            parts[i] = merged[least]
            del parts[i + 1], near[i]
            if i < len(near):
                near[i] = rank(parts[i] << 20 | parts[i + 1], NONE)
            if i:
                near[i - 1] = rank(parts[i - 1] << 20 | parts[i], NONE)
        packed = struct.pack(f"<{len(parts)}I", *parts)
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed

    def _long(self, parts: list[int]) -> list[int]:
        """The merges of a long word: smallest rank first, of equal ranks the leftmost."""
        rank, merged, n = self.ranks.get, self.merged, len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            least, i = heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank(parts[i] << 20 | parts[j]) != least:
                continue  # one of the two has merged since
            parts[i], parts[j] = merged[least], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(parts[i] << 20 | parts[k])) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank(parts[h] << 20 | parts[i])) is not None:
                heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    def composed(self, text: str) -> str:
        """NFC by the library's tables: nothing is composed with, or put in order across, a code point that stands alone there."""
        if text.isascii():
            return text
        if not self.alone.search(text):
            return unicodedata.normalize("NFC", text)
        return "".join(unicodedata.normalize("NFC", p) for p in self.alone.split(text))

    def _plain(self, text: str) -> bytes:
        text = self.composed(text)
        if self.squeezed:
            if not text.isascii():
                text = self.capitals.sub(lambda m: chr(CAPITALS[ord(m[0])]), text).replace("Σ", "σ")  # letter by letter, so no final sigma
            text = text.lower()
        if not text.isascii() and self.later.search(text):
            words = [text[m.start() : m.end()] for m in self.words.finditer(self.later.sub(PRIVATE, text))]
        else:
            words = self.words.findall(text)
        return b"".join(map(self.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        if not self.marks or not self.marks.search(text):
            return self._plain(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self.marks.split(text))

    def decode(self, ids: bytes) -> str:
        """The tokens' text, special ones too, with spaces between, as the vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[int, Codec] = {}


def _codec(vocabulary: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    if (key := hash(vocabulary)) not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(df: DataFrame, made: dict[str, tuple[str, pa.DataType]], vocabulary: str, work) -> DataFrame:
    """``df`` with columns that ``work(codec, batch)`` gives for each small batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                new = [pa.array(x, kind) for x, (_, kind) in zip(work(codec, part), made.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*b.schema.names, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{k} {kind}" for k, (kind, _) in made.items()]
    return df.mapInArrow(run, ", ".join(fields))


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids``, and with ``decoded`` also ``decoded_text`` made from the ids.

    ``ids`` packs little-endian unsigned 32-bit integers; special tokens in a text
    become their ids, none are added. A null text is encoded as an empty one, to no
    ids. Repeated rows each get their row; an empty table gives none. Other columns
    are ignored. Texts are encoded whole in the task that read them, with no shuffle.
    """
    base = slim(docs, doc_id, text)

    def work(codec: Codec, part: pa.RecordBatch) -> list[list]:
        ids = [codec.encode(t) for t in part.column("text").to_pylist()]
        return [ids, [codec.decode(x) for x in ids]] if decoded else [ids]

    made = {"ids": ("binary", pa.binary())} | ({"decoded_text": ("string", pa.string())} if decoded else {})
    out = _mapped(base, made, read_vocabulary(path), work)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), *made)


def decode(encoded: DataFrame, path: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, decoded_text`` of rows with packed ids; null ids decode to an empty text."""
    base = encoded.select(F.col(doc_id).alias("doc_id"), F.coalesce(ids, F.lit(b"")).alias("ids"))
    work = lambda codec, part: [[codec.decode(x) for x in part.column("ids").to_pylist()]]
    return _mapped(base, {"decoded_text": ("string", pa.string())}, read_vocabulary(path), work).select("doc_id", "decoded_text")
