"""Near-duplicates by SimHash, linked through a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two. The counts of set bits by
segment are a point with 32 coordinates, and the Manhattan distance of two
points is at most the number of bits in which their fingerprints differ. The
coordinates form six groups; points within distance 3 differ in three groups at
most, so they agree on some three. Each of the 20 choices of three groups is a
grid whose cells hold the points that agree there: a range join at radius 3
needs to look inside cells only. What shares a cell is first held to the
distance of the points, then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, slim, tasks
from .components import components, forest

GROUPS, AGREE = 6, 3
#: A cell of more points is compared chunk by chunk, each pair of chunks by itself.
CHUNK = 2048
#: Points a task compares at once.
POINTS = 1 << 16
ODD = 0x5555555555555555


def bits_over_half(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: a bit is 1 if it is set in over half of them."""
    n, count = len(hashes), np.zeros(64, np.int64)
    raw = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 15):
        count += np.unpackbits(raw[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the word shingles of a text, A-Z in lower case; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    hash64 = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    return bits_over_half(np.array([hash64(joined[a:b], 42) for a, b in spans], np.uint64))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per input row: ``doc_id, bits``, the fingerprint as a signed 64-bit number. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bits)], names=["doc_id", "bits"])

    base = slim(docs, doc_id, text)
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, bits long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[int]:
    """The bits of every choice of AGREE groups of segments."""
    cuts = np.linspace(0, 32, GROUPS + 1).round().astype(int)
    groups = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(c)) for c in combinations(groups, AGREE)]


def point(bits: Column) -> Column:
    """The segments' counts 0, 1, 2 as 00, 01, 11; so the bits in which two points differ are their Manhattan distance."""
    odd = F.lit(ODD)
    half = F.shiftrightunsigned(bits, 1)
    return bits.bitwiseOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(bits.bitwiseAND(half).bitwiseAND(odd), 1))


def _points(bits: np.ndarray) -> np.ndarray:
    odd, half = np.uint64(ODD), bits >> np.uint64(1)
    return ((bits | half) & odd) | ((bits & half & odd) << np.uint64(1))


def _linked(cells: np.ndarray, bits: np.ndarray, sides: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal cells, compared at every distance along the run at once; rows of side 1 meet only those of side 2."""
    points, found = _points(bits), []
    for step in range(1, len(bits)):
        i = np.flatnonzero(cells[:-step] == cells[step:])
        if not len(i):
            break
        i = i[(sides[i] % 3 == 0) | (sides[i] != sides[i + step])]
        i = i[np.bitwise_count(points[i] ^ points[i + step]) <= most]
        i = i[np.bitwise_count(bits[i] ^ bits[i + step]) <= most]
        found.append(np.stack([i, i + step]))
    if not found:
        return bits[:0], bits[:0]
    a, b = forest(*np.concatenate(found, axis=1), len(bits))
    return bits[a], bits[b]


def _within(most: int):
    """Over rows ``cell, bits, side`` sorted by cell: links, and with side 0 the rows of cells too large for one chunk, told by a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)]
        over = None  # the cell whose rows are passed on

        def out(a: np.ndarray, b: np.ndarray | None, cell: np.ndarray | None = None) -> pa.RecordBatch:
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            cell = pa.nulls(len(a), pa.int64()) if cell is None else pa.array(cell)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b, cell], names=["a", "b", "cell"])

        for batch in (*batches, None):
            if batch is not None:
                new = [batch.column("cell").to_numpy(), batch.column("bits").to_numpy().view(np.uint64), batch.column("side").to_numpy()]
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            cells, bits, sides = kept
            if over is not None and len(cells):
                n = int(np.searchsorted(cells != over, True)) if (cells != over).any() else len(cells)
                if n:
                    yield out(bits[:n], None, cells[:n])
                kept = cells, bits, sides = [x[n:] for x in kept]
            if batch is not None and len(cells) < POINTS:
                continue
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(cells)])
            end = int(starts[-1]) if batch is not None else len(cells)  # the last cell may go on
            last = sizes[-1] if len(sizes) else 0
            large = np.repeat((sizes > CHUNK) & (sides[starts] == 0), sizes) if len(sizes) else np.zeros(0, bool)
            if batch is not None and last > CHUNK and sides[-1] == 0:
                end, over = len(cells), cells[-1]
            if large[:end].any():
                yield out(bits[:end][large[:end]], None, cells[:end][large[:end]])
            some = ~large[:end]
            yield out(*_linked(cells[:end][some], bits[:end][some], sides[:end][some], most))
            kept = [x[end:] for x in kept]

    return run


def fingerprint_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Distinct ``bits`` to links ``a, b`` that connect whatever is within ``most`` (3 or fewer) differing bits.

    The links don't list every close pair; they join the same fingerprints into the
    same components, with fewer links than points in each cell. A cell with more
    points than a chunk holds is spread: its points are dealt to chunks by hash, and
    every pair of chunks is compared by itself, so no task holds more than two.
    """
    if not 0 <= most <= GROUPS - AGREE:
        raise ValueError(f"most must be 0 to {GROUPS - AGREE}, not {most}")
    e = point(F.col("bits"))
    keys = F.array(*[F.xxhash64(F.lit(t), e.bitwiseAND(F.lit(m))) for t, m in enumerate(_masks())])
    rows = prints.select("bits", F.explode(keys).alias("cell"), F.lit(0).cast("byte").alias("side"))
    schema = "a long, b long, cell long"
    n = tasks(prints)
    first = durable(rows.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_within(most), schema))
    links = first.where("b is not null").select("a", "b")
    large = first.where("b is null").select("cell", F.col("a").alias("bits"))
    sizes = large.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (CHUNK // 2)).cast("int").alias("chunks"))
    if sizes.isEmpty():
        return links
    own = F.pmod(F.xxhash64("bits", F.lit(7)), F.col("chunks")).cast("int")
    dealt = large.join(sizes, "cell").select("cell", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select(
        F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        "bits",
        F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"),
    )
    more = dealt.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_within(most), schema)
    return links.unionAll(more.select("a", "b"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Documents whose fingerprints differ in ``most`` bits or fewer are linked;
    ``component_id`` is the smallest identifier that a document can reach, itself
    included. A null text counts as empty; texts without words have fingerprint 0
    and are linked like any other. Null identifiers don't count as smallest: a
    component of nothing else has a null ``component_id``. Repeated rows each get
    their row; an empty table gives none. Other columns are ignored.
    """
    marked = durable(fingerprints(docs, doc_id=doc_id, text=text, width=width))
    prints = durable(marked.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(prints.select("bits"), most))
    placed = prints.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(smallest, "root").select("bits", "component_id")
    return marked.join(placed, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of a component; rows that share such an identifier all stay."""
    stays = near_duplicates(docs, doc_id=doc_id, **how).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stays, docs[doc_id].eqNullSafe(F.col("stays")), "left_semi")
