"""Removal of repeated passages: contexts of shared grams, put in order column by column.

No Burrows-Wheeler transform of a shard is made or merged here; the README says why.
Which bytes lie in a string of 50 bytes that an earlier document also has is
asked of suffixes, but only of those that can matter. Every string of 50 bytes
has a gram of 16 with the smallest hash; equal strings have equal smallest
grams at equal places. So it is enough to compare, gram by gram, the contexts of
such grams that two documents share: the 34 bytes before, the gram, and 34 after.

A shard gets the contexts of its grams from many blocks, one block's after the
other, aligned at the gram, and sorts them: from the last column to the first, by a
stable distribution on the symbol before, so that after each step the contexts are
ordered by all that follows. That step is the one by which interleaves of transforms
are refined, but it starts from the order of arrival and looks symbols up in the
contexts. Neighbours' common prefixes then tell the repeated intervals of 50 bytes
at that column.

A gram that takes more than a share of its shard's places is split: its contexts
are dealt string by string, by the hash of all 50 bytes, each as a context that
shows nothing but the string. Only equal strings then meet, and a block sends
each of its strings once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import durable, slim, spread_over
from .packing import MESSAGE, messages, pack, pack_rising, unpack, unpack_rising

#: Bytes of a repeated string, of its gram, and how many grams it has; the columns of a context.
LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
SIDE = LENGTH - GRAM
COLUMNS = 2 * SIDE + GRAM
#: Bytes of a block at least; a longer document is a block by itself.
BLOCK = 4_000_000
#: Compressed bytes of blocks that go to one shard on average.
SHARD = 16 << 20
#: Contexts that are built at once.
SLICE = 1 << 16
#: Stands beside a text in its contexts; no UTF-8 text has this byte.
EDGE = 0xFF
#: A gram is split if it has over this share of its shard's places, and at least so many.
HOT_SHARE, HOT_LEAST = 1 / 16, 4096
#: Odd numbers that mix the halves of a gram's hash.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all grams, each from those of its halves."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    for m in MIX[: GRAM.bit_length() - 1]:
        h = h[:-width] * np.uint64(m) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h * np.uint64(MIX[4])


def _slide(h: np.ndarray, width: int, least) -> np.ndarray:
    """Minima or maxima of all runs of so many numbers."""
    have = 1
    while have * 2 <= width:
        h, have = least(h[:-have], h[have:]), have * 2
    return least(h[: len(h) - width + have], h[width - have :]) if width > have else h


def _marks(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each context."""
    mark = np.zeros(len(rows), np.uint64)
    for column in np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -COLUMNS % 8)))).view(np.uint64).T:
        mark = (mark ^ column) * np.uint64(MIX[0])
        mark ^= mark >> np.uint64(31)
    return mark


def _slices(n: int) -> Iterator[slice]:
    return (slice(i, i + SLICE) for i in range(0, n, SLICE))


def _heads(rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which of sorted rows differ from the one before, in themselves or their keys."""
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    return first


def _strings(rows: np.ndarray, ids: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts of split grams, by column: the contexts that have a string there, which of the different strings each has, and those with their shard and smallest identifier."""
    for column in range(WINDOW):
        own = np.flatnonzero((rows[:, column] != EDGE) & (rows[:, column + LENGTH - 1] != EDGE))
        if not len(own):
            continue
        alone = np.full((len(own), COLUMNS), EDGE, np.uint8)
        alone[:, column : column + LENGTH] = rows[own, column : column + LENGTH]
        mark = _marks(alone)
        order = np.lexsort((ids[own], mark))
        own, mark, alone = own[order], mark[order], alone[order]
        first = _heads(alone, mark)
        yield column, own, np.cumsum(first) - 1, alone[first], ((mark[first] >> np.uint64(16)) % np.uint64(shards)).astype(np.int64), ids[own[first]]


class _Block:
    """A block's texts one after another, and the grams that are smallest in some string of theirs."""

    def __init__(self, row: dict) -> None:
        self.ids, self.sizes = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64), unpack(row["sizes"]).astype(np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
        self.ends = np.cumsum(self.sizes)
        n = len(self.data)
        self.hashes = gram_hashes(self.data) if n >= LENGTH else np.zeros(0, np.uint64)
        if n < LENGTH:
            self.at, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.grams, self.kind = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        least = _slide(self.hashes, WINDOW, np.minimum)
        inside = np.zeros(n, bool)
        for a, b in zip((self.ends - self.sizes).tolist(), self.ends.tolist(), strict=True):
            inside[a : max(a, b - LENGTH + 1)] = True
        self.inside = inside
        least = np.where(inside[: len(least)], least, np.uint64(0))
        edge = np.zeros(WINDOW - 1, np.uint64)
        least = _slide(np.concatenate([edge, least, edge]), WINDOW, np.maximum)
        self.at = np.flatnonzero(self.hashes == least[: len(self.hashes)])
        self.doc = np.searchsorted(self.ends, self.at, "right")
        self.grams, self.kind = np.unique(self.hashes[self.at] >> np.uint64(16), return_inverse=True)

    def several(self) -> np.ndarray:
        """Which of the grams two of the block's documents have."""
        low, high = np.full(len(self.grams), len(self.ids)), np.full(len(self.grams), -1)
        np.minimum.at(low, self.kind, self.doc)
        np.maximum.at(high, self.kind, self.doc)
        return low < high

    def places(self) -> np.ndarray:
        """In how many places each of the grams stands."""
        return np.bincount(self.kind, minlength=len(self.grams))

    def share(self, shards: int) -> np.ndarray:
        return (self.grams % np.uint64(shards)).astype(np.int64)

    def _rows(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The contexts of some places, EDGE beside their texts."""
        padded = np.pad(self.data[max(0, int(at.min()) - SIDE) : int(at.max()) + GRAM + SIDE], (max(0, SIDE - int(at.min())), SIDE + GRAM), constant_values=EDGE)
        rows = np.lib.stride_tricks.sliding_window_view(padded, COLUMNS)[at - at.min()]
        before, after = (at - (self.ends - self.sizes)[doc]), self.ends[doc] - at
        cut = np.flatnonzero((before < SIDE) | (after < GRAM + SIDE))
        if len(cut):
            column = np.arange(COLUMNS) - SIDE
            rows[cut] = np.where((column >= -before[cut, None]) & (column < after[cut, None]), rows[cut], np.uint8(EDGE))
        return rows

    def contexts(self, answers: list[dict], shards: int) -> None:
        """Contexts of the grams that two documents share, equal ones of a block once, in the order in which shards get them."""
        to, shared, hot = self.share(shards), np.zeros(len(self.grams), bool), np.zeros(len(self.grams), bool)
        for a in answers:
            m = to == a["shard"]
            shared[m] = np.unpackbits(np.frombuffer(a["a"], np.uint8), count=int(m.sum())).astype(bool)
            if a["b"] is not None:
                hot[m] = np.unpackbits(np.frombuffer(a["b"], np.uint8), count=int(m.sum())).astype(bool)
        own = shared[self.kind]
        at, doc, kind = self.at[own], self.doc[own], self.kind[own]
        mark = np.zeros(len(at), np.uint64)
        for part in _slices(len(at)):
            mark[part] = _marks(self._rows(at[part], doc[part]))
        order = np.lexsort((at, self.ids[doc], mark, kind))
        at, doc, kind, mark = at[order], doc[order], kind[order], mark[order]
        first = np.ones(len(at), bool)
        first[1:] = (mark[1:] != mark[:-1]) | (kind[1:] != kind[:-1])
        like = np.flatnonzero(~first)
        for part in _slices(len(like)):
            a, b = like[part], like[part] - 1
            first[a] = (self._rows(at[a], doc[a]) != self._rows(at[b], doc[b])).any(axis=1)
        self.spot, self.owner, self.first = at, doc, first
        self.group = np.cumsum(first) - 1
        kind, ids = kind[first], self.ids[doc[first]]
        rows = np.concatenate([np.zeros((0, COLUMNS), np.uint8), *[self._rows(at[first][part], doc[first][part]) for part in _slices(len(ids))]])
        self.whole, split = np.flatnonzero(~hot[kind]), np.flatnonzero(hot[kind])
        self.split, sent = [], [(rows[self.whole], to[kind[self.whole]], ids[self.whole])]
        for column, own, string, alone, shard, least in _strings(rows[split], ids[split], shards):
            self.split.append((column, split[own], string, ids[split[own]] > least[string], len(alone)))
            sent.append((alone, shard, least))
        rows, goes, ids = (np.concatenate(x) for x in zip(*sent, strict=True))
        self.sent = np.argsort(goes, kind="stable")
        self.rows, self.row_to, self.row_ids = rows[self.sent], goes[self.sent], ids[self.sent]

    def dealt(self) -> Iterator[tuple[int, slice]]:
        cuts = np.flatnonzero(np.r_[True, np.diff(self.row_to) != 0]) if len(self.row_to) else []
        for a, b in zip(cuts, np.r_[cuts[1:], len(self.row_to)].astype(int)) if len(cuts) else ():
            yield int(self.row_to[a]), slice(int(a), int(b))

    def removed(self, answers: list[dict]) -> np.ndarray:
        """Which bytes go: those of every repeated string."""
        told, said = np.zeros(len(self.rows), np.uint64), {a["shard"]: a for a in answers}
        for shard, part in self.dealt():
            told[self.sent[part]] = unpack(said[shard]["a"])
        masks = np.zeros(int(self.first.sum()), np.uint64)
        at = len(self.whole)
        masks[self.whole] = told[:at]
        for column, own, string, later, n in self.split:
            masks[own[(told[at : at + n] > 0)[string] | later]] |= np.uint64(1 << column)
            at += n
        head = np.flatnonzero(self.first)[self.group] if len(self.group) else np.zeros(0, np.int64)
        later = self.ids[self.owner] > self.ids[self.owner[head]]
        own = np.where(later, np.uint64((1 << WINDOW) - 1), masks[self.group])
        starts = np.zeros(len(self.data) + 1, np.int32)
        for column in range(WINDOW):
            p = self.spot[(own >> np.uint64(column)) & np.uint64(1) == 1] - SIDE + column
            starts[p[p >= 0]] = 1
        starts[: len(self.data)] &= self.inside if len(self.data) >= LENGTH else 0
        covered = np.cumsum(starts[:-1])
        covered[LENGTH:] -= covered[:-LENGTH].copy()
        return covered > 0


def _blocks(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, total, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []

        def out() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            row = [pa.array([part << 24 | at]), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(np.array([len(t) for t in texts]))]), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["block", "ids", "sizes", "data"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                texts.append(text.as_buffer().to_pybytes())
                ids.append(doc)
                total += len(texts[-1])
                if total >= least:
                    yield out()
                    at, total, ids, texts = at + 1, 0, [], []
        if ids:
            yield out()

    return run


def _gram_messages(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                to, several, places = b.share(shards), b.several(), b.places()
                out = [(s, row["block"], pack_rising(b.grams[m]), np.packbits(several[m]).tobytes(), pack(places[m])) for s in np.unique(to).tolist() for m in [to == s]]
                yield from messages(out).to_batches()

    return run


def _gram_shard(key: tuple, table: pa.Table) -> pa.Table:
    """For every message, which of its grams two documents have, and which of them are split."""
    shard, rows = key[0].as_py(), table.to_pylist()
    grams = [unpack_rising(r["a"]) for r in rows]
    every, inverse, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    flags = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(g)) for r, g in zip(rows, grams, strict=True)])
    shared = times > 1
    shared[inverse[flags == 1]] = True
    places = np.bincount(inverse, np.concatenate([unpack(r["c"]) for r in rows]), len(every))
    hot = shared & (places >= HOT_LEAST) & (places > places.sum() * HOT_SHARE)
    out = []
    for r, g in zip(rows, grams, strict=True):
        at = np.searchsorted(every, g)
        out.append((shard, r["block"], np.packbits(shared[at]).tobytes(), np.packbits(hot[at]).tobytes() if hot[at].any() else None))
    return messages(out)


def _context_messages(shards: int):
    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = blocks.to_pylist()
        if not rows:
            return messages([])
        b = _Block(rows[0])
        b.contexts(answers.to_pylist(), shards)
        squeeze = zstandard.ZstdCompressor(level=3)
        return messages([(s, rows[0]["block"], squeeze.compress(b.rows[part].tobytes()), pack(b.row_ids[part].view(np.uint64))) for s, part in b.dealt()])

    return run


def repeated(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every context a bit for each column at which its string of LENGTH bytes is also one of a smaller identifier.

    ``rows`` holds the shards' contexts one after another; that is the interleave
    to begin with. A step distributes it by the symbol of one column, the last
    first, and keeps the order among equals.
    """
    masks, order = np.zeros(len(rows), np.uint64), np.arange(len(rows))
    symbols = np.ascontiguousarray(rows.T)
    for column in range(COLUMNS - 1, -1, -1):
        order = order[np.argsort(symbols[column][order], kind="stable")]
        if column >= WINDOW:
            continue
        strings = rows[order, column : column + LENGTH]
        new = np.ones(len(rows), bool)
        new[1:] = (strings[1:] != strings[:-1]).any(axis=1)
        of = ids[order]
        smallest = np.minimum.reduceat(of, np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = (of > smallest) & (strings[:, 0] != EDGE) & (strings[:, -1] != EDGE)
        masks[order[gone]] |= np.uint64(1 << column)
    return masks


def _context_shard(key: tuple, table: pa.Table) -> pa.Table:
    shard, said = key[0].as_py(), table.to_pylist()
    open_ = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(open_.decompress(r["a"]), np.uint8).reshape(-1, COLUMNS) for r in said]
    masks = repeated(np.concatenate(rows), np.concatenate([unpack(r["b"]) for r in said]).view(np.int64))
    parts = np.split(masks, np.cumsum([len(r) for r in rows])[:-1])
    return messages([(shard, r["block"], pack(m)) for r, m in zip(said, parts, strict=True)])


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
NO_ID = np.iinfo(np.int64).max


def _kept(shards: int):
    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows, said = blocks.to_pylist(), answers.to_pylist()
        if not rows:
            return OUT.empty_table()
        b = _Block(rows[0])
        b.contexts([a for a in said if a["step"] == 1], shards)
        gone = b.removed([a for a in said if a["step"] == 2])
        out = []
        for i, a, e in zip(rows[0]["ids"], (b.ends - b.sizes).tolist(), b.ends.tolist(), strict=True):
            g = gone[a:e]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(e > a and g[0])
            out.append((i, e - a, int(np.count_nonzero(g)), spans, b.data[a:e][~g].tobytes()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), OUT.types, strict=True)], schema=OUT)

    return run


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept``, the UTF-8 bytes that stay.

    A byte goes if a string of 50 bytes that covers it also starts in a document
    with a smaller identifier; strings are judged on the input. Identifiers are
    whole numbers. A null one counts as the largest there can be; rows of one
    identifier don't make each other's bytes go. A null text counts as empty;
    texts under 50 bytes stay whole. An empty table gives no rows. Other columns
    are ignored.
    """
    base = slim(docs, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = durable(base.mapInArrow(_blocks(block), "block long, ids array<long>, sizes binary, data binary"))
    shards = spread_over(blocks, F.length("data"), SHARD)
    by_shard = lambda m: m.repartition(shards, "shard").groupBy("shard")
    near = lambda m: m.repartition(shards, "block")  # noqa: E731  each step's answers move once, for all that read them
    shared = durable(by_shard(blocks.mapInArrow(_gram_messages(shards), MESSAGE)).applyInArrow(_gram_shard, MESSAGE))
    placed, said = near(blocks), near(shared.withColumn("step", F.lit(1)))
    asked = placed.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_context_messages(shards), MESSAGE)
    told = near(by_shard(asked).applyInArrow(_context_shard, MESSAGE).withColumn("step", F.lit(2)))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return placed.groupBy("block").cogroup(said.unionAll(told).groupBy("block")).applyInArrow(_kept(shards), out)
