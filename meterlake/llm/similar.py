"""Near-duplicates by Jaccard similarity, with SimHash to find what to compare.

Two 64-bit SimHashes of a text's set of word shingles make 128 bits. Texts of
similarity 0.8 differ in about 19 of them, unrelated ones in about 64. The bits
fall into 64 segments of two; the counts of set bits by segment are a point, and
the Manhattan distance of two points is at most the number of bits in which the
fingerprints differ. Each of many grids takes some of the coordinates, and its
cells hold the points that agree there. What shares a cell is first held to the
distance of the points, then to that of the fingerprints: at most ``RADIUS`` each
makes a candidate. Candidates that hang together form a group, and inside a group
the sets themselves are compared, so every link has the similarity asked for;
what the choice of grids can miss is a pair that shares no cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, slim, tasks
from .components import components, forest
from .simhash import _points, bits_over_half

#: Segments of two bits, grids a text is put in at least, and the coordinates that each takes at least.
SEGMENTS, GRIDS, TAKEN = 64, 256, 10
#: How often a coordinate is the same for unrelated texts, and for those of similarity 0.8.
AGREE, ALIKE = 3 / 8, 0.73
#: Grids that are searched first, and at once after them.
EARLY, AT_ONCE = 8, 128
#: Differing bits, of 128, up to which a pair is compared in full.
RADIUS = 34
#: Sets of fewer shingles are within 0.8 of none but their equals.
FEWEST = 4
#: A group of more texts is compared chunk by chunk, each pair of chunks by itself.
CHUNK = 512
#: A cell of more points is searched outwards from one point at a time.
CROWD = 256
#: Points a task compares at once.
POINTS = 1 << 16


def shingles(text: str, width: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a text, A-Z in lower case; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grids(n: int) -> tuple[int, int]:
    """How many grids of how many coordinates for so many points: a cell's unrelated ones stay below a crowd, and a pair's chance to share a cell stays what it is."""
    taken = min(SEGMENTS // 2, max(TAKEN, int(np.ceil(np.log(max(n, 1) / CROWD) / -np.log(AGREE)))))
    return int(np.ceil(GRIDS * ALIKE ** (TAKEN - taken))), taken


def _chosen(number: int, taken: int) -> np.ndarray:
    """Two 64-bit masks for each grid, over the segments of its coordinates."""
    rng, out = np.random.default_rng(64), np.zeros((number, 2), np.uint64)
    for row in out:
        for s in rng.choice(SEGMENTS, taken, replace=False):
            row[s // 32] |= np.uint64(3) << np.uint64(2 * (s % 32))
    return out


def cells(bits: np.ndarray, more: np.ndarray, number: int = GRIDS, taken: int = TAKEN) -> np.ndarray:
    """Keys of the cells of each fingerprint's point, a row for each."""
    m = _chosen(number, taken)
    seed = _mixed(np.arange(1, number + 1, dtype=np.uint64))
    return _mixed(_mixed((_points(bits)[:, None] & m[:, 0]) ^ seed) ^ (_points(more)[:, None] & m[:, 1]))


def signature(text: str, width: int) -> tuple[int, int, int, int]:
    """Number of distinct shingles, a hash of their set, and its two SimHashes."""
    s = np.unique(shingles(text, width))
    if not len(s):
        return 0, 0, 0, 0
    node = _mixed(np.array([_mixed(s).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(s)))[0]
    return len(s), int(node), bits_over_half(s), bits_over_half(_mixed(s))


def signatures(docs: DataFrame, *, doc_id: str, text: str, width: int) -> DataFrame:
    """One row per input row: ``doc_id, mark, n, node, bits, more``; ``mark`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([signature(t, width) for t in b.column("text").to_pylist()], np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), *map(pa.array, rows.T.copy())], names=["doc_id", "mark", "n", "node", "bits", "more"])

    base = slim(docs, doc_id, text).withColumn("mark", F.xxhash64("text"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, mark long, n long, node long, bits long, more long")


def _apart(bits: np.ndarray, more: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(bits[i] ^ bits[j]) + np.bitwise_count(more[i] ^ more[j])


def _near(points: tuple[np.ndarray, np.ndarray], bits: np.ndarray, more: np.ndarray, i, j: np.ndarray) -> np.ndarray:
    """Where ``j`` is within RADIUS of ``i``: by the points, and of what is left by the fingerprints."""
    near = np.flatnonzero(_apart(*points, i, j) <= RADIUS)
    return near[_apart(bits, more, i if np.isscalar(i) else i[near], j[near]) <= RADIUS]


def _crowd(bits: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is within RADIUS: what is near a point leaves the rest, then takes its own turn."""
    points = _points(bits), _points(more)
    rest, a, b = np.arange(len(bits)), [], []
    todo: list[int] = []
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
        at = todo.pop()
        near = _near(points, bits, more, at, rest)
        new, rest = rest[near], np.delete(rest, near)
        a += [at] * len(new)
        b += new.tolist()
        todo += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _linked(cell: np.ndarray, bits: np.ndarray, more: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the labels inside runs of equal cells; runs of one label have none to find."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(cell)])
    if len(starts):
        mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        sizes = np.where(mixed, sizes, 1)
    found = [np.zeros((2, 0), np.int64)]
    for at, n in zip(starts[sizes > CROWD], sizes[sizes > CROWD], strict=True):
        found.append(at + np.stack(_crowd(bits[at : at + n], more[at : at + n])))
    ends = np.zeros(len(cell), np.int64)
    ends[:] = np.repeat(np.where(sizes > CROWD, 0, starts + sizes), np.diff(np.r_[starts, len(cell)]))
    i, points = np.arange(len(cell)), (_points(bits), _points(more))
    for step in range(1, CROWD):
        i = i[i + step < ends[i]]
        if not len(i):
            break
        near = i[label[i] != label[i + step]]
        near = near[_near(points, bits, more, near, near + step)]
        found.append(np.stack([near, near + step]))
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, label[pairs[0]] != label[pairs[1]]]
    if not pairs.shape[1]:
        return label[:0], label[:0]
    kinds, of = np.unique(label[pairs], return_inverse=True)
    of = of.reshape(2, -1)
    a, b = forest(of[0], of[1], len(kinds))
    return kinds[a], kinds[b]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links over rows ``cell, bits, more, label`` sorted by cell; a cell is held whole, 32 bytes a row."""
    parts, held = [], 0
    for batch in (*batches, None):
        if batch is not None:
            parts.append([batch.column(c).to_numpy().view(np.uint64) for c in ("cell", "bits", "more", "label")])
            held += len(batch)
            if held < POINTS:
                continue
        if not parts:
            return
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
        last = np.flatnonzero(rows[0] != rows[0][-1]) if held else []
        end = held if batch is None else int(last[-1]) + 1 if len(last) else 0  # the last cell may go on
        a, b = _linked(*[x[:end] for x in rows])
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        parts, held = [[x[end:] for x in rows]], held - end


def candidates(prints: DataFrame, shape: tuple[int, int], first: int, last: int) -> DataFrame:
    """``bits, more, label`` to links ``a, b`` of labels, over whatever shares a cell of these grids and is within RADIUS."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, more, label = (b.column(c).to_numpy() for c in ("bits", "more", "label"))
            keys = np.ascontiguousarray(cells(bits.view(np.uint64), more.view(np.uint64), *shape)[:, first:last])
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *[pa.array(np.repeat(x, n)) for x in (bits, more, label)]], names=["cell", "bits", "more", "label"])

    rows = prints.select("bits", "more", "label").mapInArrow(spread, "cell long, bits long, more long, label long")
    return rows.repartition(tasks(prints), "cell").sortWithinPartitions("cell").mapInArrow(_within, "a long, b long")


def _settled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the smallest label that their ``label`` reaches over the links."""
    roots = components(links).select(F.col("node").alias("at"), "root")
    return durable(nodes.join(roots, F.col("label") == F.col("at"), "left").withColumn("label", F.coalesce("root", "label")).drop("at", "root"))


def candidate_groups(prints: DataFrame) -> DataFrame:
    """``bits`` to ``group``: the smallest bits that candidates lead to.

    A few grids come first: they bring most of a large group together, and the
    others then need no links inside it. Those follow some at a time, so that no
    more of a text's cells lie on disk at once.
    """
    points = durable(prints.withColumn("label", F.col("bits")))
    shape = grids(points.count())
    for first in (0, *range(EARLY, shape[0], AT_ONCE)):
        last = EARLY if first < EARLY else min(shape[0], first + AT_ONCE)
        points = _settled(points, candidates(points, shape, first, last))
    return points.groupBy("bits").agg(F.min("label").alias("group"))


def _alike(texts: list[tuple[int, int, set]], least: float) -> list[tuple[int, int]]:
    """Links of labels with sets at least so similar, as many as connect the same; side 1 meets only side 2."""
    texts = sorted(texts, key=lambda t: len(t[2]))
    parent, links = {label: label for label, _, _ in texts}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, (a, side, s) in enumerate(texts):
        for j in range(i + 1, len(texts)):
            b, other, t = texts[j]
            if len(s) < least * len(t):
                break
            if (side % 3 and side == other) or root(a) == root(b):
                continue
            both = len(s & t)
            if both / (len(s) + len(t) - both) >= least:
                parent[root(a)] = root(b)
                links.append((a, b))
    return links


def _verified(width: int, least: float):
    """Over rows ``cell, side, label, mark, text`` sorted by cell: links of the labels whose sets are similar; copies count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, marks = None, [], set()
        for batch in (*batches, None):
            links = []
            rows = [(None,) * 5] if batch is None else zip(*[batch.column(c).to_pylist() for c in ("cell", "side", "label", "mark", "text")], strict=True)
            for cell, side, label, mark, text in rows:
                if cell != here:
                    links += _alike(held, least)
                    here, held, marks = cell, [], set()
                if cell is not None and mark not in marks:
                    marks.add(mark)
                    held.append((label, side, set(shingles(text, width).tolist())))
            if links:
                a, b = np.array(links, np.int64).T.copy()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _sub(n: Column) -> Column:
    """Which of a number of chunks a node is in."""
    return F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")


def _chunks(n: Column) -> Column:
    return F.ceil(n / CHUNK).cast("int")


def _crossed(nodes: DataFrame) -> DataFrame:
    """``mark, label, cell, side`` so that any two nodes of a group with different labels meet in a cell.

    A group's small labels share bins of about a chunk, larger ones have bins of
    their own. Bins meet two by two, but those of one label don't.
    """
    size = nodes.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    kind = size.select("*", F.when(F.col("n") > CHUNK, F.col("label")).alias("own"))
    few = F.sum(F.when(F.col("own").isNull(), F.col("n"))).alias("few")
    made = F.struct("own", _chunks(F.col("n")).alias("bins"))
    bins = kind.groupBy("group").agg(few, F.collect_list(F.when(F.col("own").isNotNull(), made)).alias("large"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    none = F.lit(None).cast("long")
    key = lambda own, i: F.concat_ws(":", F.coalesce(own.cast("string"), F.lit("")), i.cast("string"))
    every = lambda own, n: F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda i: F.struct(own.alias("own"), key(own, i).alias("key")))
    larger = F.flatten(F.transform("large", lambda x: every(x["own"], x["bins"])))
    bins = bins.select("group", "few", F.concat(every(none, F.coalesce(_chunks(F.col("few")), F.lit(0))), larger).alias("bins"))
    placed = nodes.join(kind.select("group", "label", "n", "own"), ["group", "label"]).join(bins, "group")
    own = F.col("own")
    me = F.when(own.isNull(), key(none, F.pmod(F.xxhash64("label", F.lit(7)), _chunks(F.col("few"))))).otherwise(key(own, _sub(_chunks(F.col("n")))))
    met = placed.select("mark", "label", "group", "own", me.alias("me"), F.explode("bins").alias("other")).where("own IS NULL OR NOT own <=> other.own")
    other = F.col("other.key")
    side = F.when(F.col("me") == other, 3).when(F.col("me") < other, 1).otherwise(2)
    return met.select("mark", "label", F.xxhash64("group", F.least("me", other), F.greatest("me", other)).alias("cell"), side.alias("side"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row per input row: ``doc_id, component_id``.

    Texts whose sets of ``width``-word shingles have a Jaccard similarity of
    ``least`` or more (0.8 at least) are linked; sets are told by 64-bit hashes of
    their shingles. ``component_id`` is the smallest identifier that a document
    can reach, itself included. A null text counts as empty; texts without words
    are alike among themselves only. Null identifiers don't count as smallest: a
    component of nothing else has a null ``component_id``. Repeated rows each get
    their row; an empty table gives none. Other columns are ignored.

    A group of candidates is compared chunk by chunk, then one text of each label
    found so far, and at last, in full, what still has different labels.
    """
    if not 0.8 <= least <= 1:
        raise ValueError(f"least must be 0.8 to 1, not {least}")
    marked = durable(signatures(docs, doc_id=doc_id, text=text, width=width))
    roots = candidate_groups(marked.where(F.col("n") >= FEWEST).select("bits", "more").distinct())
    nodes = marked.where(F.col("n") >= FEWEST).groupBy("node", "bits").agg(F.min("mark").alias("mark")).join(roots, "bits").select("mark", "node", "group", F.col("node").alias("label"))

    def links(dealt: DataFrame) -> DataFrame:
        met = texts.join(dealt, "mark").select("cell", "side", "label", "mark", "text")
        return met.repartition(tasks(docs), "cell").sortWithinPartitions("cell").mapInArrow(_verified(width, least), "a long, b long")

    alone = F.lit(3).alias("side")
    sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    nodes = durable(nodes.join(sizes, "group").withColumn("chunks", _chunks(F.col("size"))))
    texts = slim(docs, doc_id, text).select("text", F.xxhash64("text").alias("mark"))
    texts = durable(texts.join(nodes.select("mark").distinct(), "mark", "left_semi"))  # only those that have something to be compared with
    nodes = _settled(nodes, links(nodes.select("mark", "label", F.xxhash64("group", _sub(F.col("chunks"))).alias("cell"), alone)))
    large = nodes.where("chunks > 1")
    if not large.isEmpty():
        heads = large.groupBy("group", "label", "chunks").agg(F.min_by("mark", "node").alias("mark"), F.min("node").alias("node"))
        nodes = _settled(nodes, links(heads.select("mark", "label", F.xxhash64("group", _sub(F.col("chunks"))).alias("cell"), alone)))
        nodes = _settled(nodes, links(_crossed(nodes.where("chunks > 1"))))
    placed = marked.groupBy("node").agg(F.min("doc_id").alias("smallest")).join(nodes.select("node", "label"), "node", "left").select("node", "smallest", F.coalesce("label", "node").alias("root"))
    placed = durable(placed)
    least_id = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    placed = placed.join(least_id, "root").select("node", "component_id")
    return marked.join(placed, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of a component; rows that share such an identifier all stay."""
    stays = near_duplicates(docs, doc_id=doc_id, **how).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stays, docs[doc_id].eqNullSafe(F.col("stays")), "left_semi")
