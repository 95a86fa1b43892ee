"""Secret scans through layers of encoding.

A worklist holds the layers of a text: the text itself, then what its URL
escapes, Unicode escapes, base64 runs and compressed payloads unwrap to, and what
those unwrap to in turn, until nothing new comes. A layer seen before at the same
place is not opened again, so cycles end. Every layer is scanned by the same rules,
and its finds are mapped back to code points of the original text.

Whatever a payload holds maps to the one run that it came from. So a large payload
is read in windows that end where no find and no run can go on, and only a window
is held at a time; a run without such an end is held whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slim

#: The rules, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+")
#: A base64 run, and one that goes on over line breaks.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
#: Layers of escapes that are undone one at a time; deeper ones are undone to the last in one step.
DEPTH = 8
#: Characters or bytes of a payload that are scanned at once, and of the piece in which their end is looked for first.
WINDOW, TAIL = 1 << 24, 1 << 16
#: Blanks at which no find and no run goes on: those after a word that is no key, before one that is no sign.
END = re.compile(r"""(?i)[^\s:="'](?<!password)(?<!passwd)(?<!secret)(?<!token)(?<!key)\x20+(?=[^\s:=])|[^\s!-~](?=.)|[,;()\[\]{}<>!?#&*|~^`@$]""")
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")

#: Where the characters of a layer come from: None, the text itself; a span of it; or the spans of each character.
Origin = None | tuple[int, int] | tuple[np.ndarray, np.ndarray]


def find(layer: str, low: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of one layer by the base rules: leftmost, non-overlapping by kind."""
    low = layer.encode("utf-8", "surrogatepass").lower() if low is None else low
    found = []
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(layer) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in layer:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(layer) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(layer)]
    return found


def _back(origin: Origin, start: int, end: int) -> tuple[int, int]:
    if origin is None:
        return start, end
    if isinstance(origin[0], int):
        return origin
    return int(origin[0][start]), int(origin[1][end - 1])


def _place(origin: Origin) -> Origin | bytes:
    """What tells where a layer comes from: equal layers of other places are layers of their own."""
    if origin is None or isinstance(origin[0], int):
        return origin
    return hashlib.sha256(origin[0].astype(np.int64).tobytes() + origin[1].astype(np.int64).tobytes()).digest()


def _each(origin: Origin, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of a stretch of a layer comes from."""
    if origin is None:
        return np.arange(start, end), np.arange(start + 1, end + 1)
    if isinstance(origin[0], int):
        return np.full(end - start, origin[0]), np.full(end - start, origin[1])
    return origin[0][start:end], origin[1][start:end]


def _characters(raw: bytes) -> Iterator[tuple[str, int]]:
    """The characters of bytes, each with the number of bytes it stands for."""
    for ch in raw.decode("utf-8", "replace"):
        yield ch, len(ch.encode()) if ch != "�" else 1


def _undone(run: str, at: int) -> Iterator[tuple[str, int, int]]:
    """The characters of a run of escapes that begins at a place, each with its span."""
    end = at + len(run)
    if run[0] == "%":
        for ch, n in _characters(bytes.fromhex(run.replace("%", ""))):
            yield ch, min(at, end - 3), min(at + 3 * n, end)
            at += 3 * n
    else:
        units = "".join(chr(int(x, 16)) for x in run.split("\\u")[1:])
        for ch in units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"):
            width = 12 if ord(ch) > 0xFFFF else 6
            yield ch, at, at + width
            at += width


def _unescaped(layer: str, origin: Origin) -> tuple[str, Origin] | None:
    """The layer with every URL and Unicode escape undone, or None if it has none."""
    out, spans, at = [], [], 0
    for m in ESCAPE.finditer(layer):
        chars, starts, ends = zip(*_undone(m[0], m.start()), strict=True)
        back = np.array([_back(origin, a, b) for a, b in zip(starts, ends, strict=True)])
        out += [layer[at : m.start()], *chars]
        spans += [_each(origin, at, m.start()), (back[:, 0], back[:, 1])]
        at = m.end()
    if not at:
        return None
    out.append(layer[at:])
    spans.append(_each(origin, at, len(layer)))
    return "".join(out), tuple(np.concatenate(x) for x in zip(*spans, strict=True))


def _settled(layer: str, origin: Origin) -> tuple[str, Origin] | None:
    """The layer with its escapes undone until none is left, in one pass: an escape that ends with the last character is undone at once, and may end another."""
    if not ESCAPE.search(layer):
        return None
    chars: list[str | int] = []  # a number is a byte that isn't a character by itself
    starts, ends = [], []
    for at, ch in enumerate(layer):
        chars.append(ch)
        starts.append(at)
        ends.append(at + 1)
        while chars[-1] in HEX_DIGITS:
            if len(chars) > 2 and chars[-3] == "%" and chars[-2] in HEX_DIGITS:
                width, value = 3, int(chars[-2] + chars[-1], 16)
                made: str | int = chr(value) if value < 128 else value
            elif len(chars) > 5 and chars[-6] == "\\" and chars[-5] == "u" and all(c in HEX_DIGITS for c in chars[-4:-1]):
                width, made = 6, chr(int("".join(chars[-4:]), 16))  # type: ignore[arg-type]
            else:
                break
            ends[-width] = ends[-1]
            chars[-width] = made
            del chars[1 - width :], starts[1 - width :], ends[1 - width :]
    out, first, last, at = [], [], [], 0
    while at < len(chars):
        if isinstance(chars[at], str) and not "\ud800" <= chars[at] <= "\udfff":
            out.append(chars[at])
            first.append(starts[at])
            last.append(ends[at])
            at += 1
            continue
        end, kind = at, type(chars[at])
        while end < len(chars) and type(chars[end]) is kind and (kind is int or "\ud800" <= chars[end] <= "\udfff"):
            end += 1
        if kind is int:
            pieces = _characters(bytes(chars[at:end]))
        else:
            pieces = ((c, 2 if ord(c) > 0xFFFF else 1) for c in "".join(chars[at:end]).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"))
        for ch, n in pieces:
            out.append(ch)
            first.append(starts[min(at, end - 1)])
            last.append(ends[min(at + n, end) - 1])
            at += n
        at = end
    a, b = zip(*[_back(origin, x, y) for x, y in zip(first, last, strict=True)], strict=True)
    return "".join(out), (np.array(a), np.array(b))


class _Source:
    """Pieces of bytes as a file that is read forward."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.at = pieces, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and (more := next(self.pieces, None)) is not None:
            self.held, self.at = self.held[self.at :] + more, 0
        return self.held[self.at : self.at + n]

    def read(self, n: int = TAIL) -> bytes:
        out = self.peek(1) and self.held[self.at : self.at + min(n, TAIL)]
        self.at += len(out)
        return out

    def back(self, some: bytes) -> None:
        """What was read too much."""
        self.held, self.at = some + self.held[self.at :], 0


def _packing(head: bytes) -> str | None:
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    return "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else None


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What a payload unpacks to, all its members and frames, up to where it is broken; a payload that only looks like one comes back as it is."""
    source, some = _Source(pieces), False
    while kind := _packing(source.peek(4)):
        head = source.peek(TAIL)
        try:
            if kind == "zstd":
                with zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True, closefd=False) as r:
                    while out := r.read(1 << 20):
                        some = True
                        yield out
                return
            z, left = zlib.decompressobj(47), b""
            while not z.eof and (left := left or source.read()):
                out = z.decompress(left, 1 << 20)
                left = z.unconsumed_tail
                if out:
                    some = True
                    yield out
            source.back(z.unused_data)
        except (zlib.error, zstandard.ZstdError):
            if not some:
                yield head
                while more := source.read():
                    yield more
            return
        if not z.eof:
            return


def _unpacked(data: bytes) -> Iterator[bytes]:
    """Pieces of a payload with every packing undone, one inside another too; what unpacks to itself is opened once."""
    pieces, seen = iter([data]), set()
    while True:
        head = b""
        while len(head) < WINDOW and (more := next(pieces, None)) is not None:
            head += more
        mark = hashlib.sha256(head).digest()
        pieces = chain([head], pieces)
        if not _packing(head) or mark in seen:
            return (yield from pieces)
        seen.add(mark)
        pieces = _members(pieces)


def _last_end(text: str) -> int:
    """Where the text can be cut, at the last place there is; 0 if nowhere."""
    for start in (max(0, len(text) - TAIL), 0):
        ends = [m.end() for m in END.finditer(text, start)]
        if ends:
            return ends[-1]
    return 0


def _windows(pieces: Iterator[bytes]) -> Iterator[str]:
    """The text of a payload, in windows that no find and no run crosses; bytes that are no UTF-8 as replacement characters."""
    decoder, text, least = codecs.getincrementaldecoder("utf-8")("replace"), "", WINDOW
    for piece in pieces:
        text += decoder.decode(piece)
        if len(text) >= least:
            if end := _last_end(text):
                yield text[:end]
                text, least = text[end:], WINDOW
            else:
                least = 2 * len(text)
    if text := text + decoder.decode(b"", True):
        yield text


def _tokens(layer: str, origin: Origin) -> Iterator[tuple[str, Origin]]:
    """Texts that base64 runs of the layer unwrap to, each line and lines that belong together."""
    for m in chain(TOKEN.finditer(layer), WRAPPED.finditer(layer) if "\n" in layer else ()):
        body = re.sub(r"\s+", "", m[0]).rstrip("=").replace("-", "+").replace("_", "/")
        body = body[: len(body) - (len(body) % 4 == 1)]
        back = _back(origin, m.start(), m.end())
        for window in _windows(_unpacked(base64.b64decode(body + "=" * (-len(body) % 4)))):
            yield window, back


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those of every layer; both by start, kind, end."""
    low = text.encode("utf-8", "surrogatepass").lower()
    base = sorted(find(text, low), key=lambda s: (s[0], s[2], s[1]))
    spans, seen = set(base), set()

    def inner(layer: str, origin: Origin, undone: int) -> Iterator[tuple[str, Origin, int]]:
        if ("%" in layer or "\\u" in layer) and (more := (_unescaped if undone < DEPTH else _settled)(layer, origin)):
            yield *more, undone + 1
        for window, back in _tokens(layer, origin):
            yield window, back, undone

    work = [iter([(text, None, 0)])]
    while work:
        layer, origin, undone = next(work[-1], (None, None, 0))
        if layer is None:
            work.pop()
            continue
        mark = hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest(), _place(origin)
        if mark in seen:
            continue
        seen.add(mark)
        if origin is not None:
            for a, b, kind in find(layer):
                spans.add((*_back(origin, a, b), kind))
        work.append(inner(layer, origin, undone))
    return base, sorted(spans, key=lambda s: (s[0], s[2], s[1]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``base`` and ``spans``, arrays of (kind, start, end) in code points, end exclusive.

    ``base`` is what the rules find in the text as it stands; ``spans`` adds what
    they find in its decoded layers. Of equal starts the kinds follow ``KINDS``.
    Escapes nested over ``DEPTH`` deep are undone to the last in one step: the last
    layer is scanned, those between are not. Payloads are read to their end, all
    members and frames, whatever their size. A null or empty text has no spans.
    Repeated rows each get their row; an empty table gives none. Other columns are
    ignored. Texts are scanned whole, a row at a time in the task that read them,
    with no shuffle.
    """
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": e} for a, e, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t) for t in b.column("text").to_pylist()]
            made = [pa.array([named(x[i]) for x in found], SPANS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], names=["doc_id", "base", "spans"])

    base = slim(docs, doc_id, text)
    span = "array<struct<kind:string,start:long,end:long>>"
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, base {span}, spans {span}")


def listed(spans: str):
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
