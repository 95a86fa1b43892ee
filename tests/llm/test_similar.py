"""The pipeline's near-duplicates against all pairs compared in full."""

import random

import numpy as np
import pytest

import corpus_pipeline
from meterlake.llm import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingled(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(docs):
    """The smallest identifier each document can reach, by all pairs."""
    sets, parent = [shingled(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a & b and len(a & b) / len(a | b) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(docs))]


def edited():
    """Texts with copies edited so that few are within three bits of SimHash, and some below the similarity."""
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(n)) for n in (30, 60, 150, 300, 600) for _ in range(4)]
    docs = list(enumerate(base))
    for i, t in enumerate(base * 3):
        words = t.split(" ")
        for at in rng.sample(range(len(words)), max(1, len(words) // rng.choice((50, 60, 90, 25)))):
            words[at] = f"new{rng.randint(0, 9999)}"
        docs.append((100 + i, " ".join(words)))
    return docs + [(500, ""), (501, None), (502, "one two"), (503, "One  two"), (504, "one three"), (None, "one two"), (None, "alone here")]


@pytest.mark.parametrize("chunk", [2, 512])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    docs = edited()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], SCHEMA).repartition(3)
    want = plain(docs)
    assert len(set(want)) < len(docs) - 40
    got = similar.near_duplicates(df).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got))) == sorted(map(str, zip([i for i, _ in docs], want, strict=True)))
    assert similar.near_duplicates(df.limit(0)).count() == 0
    kept = corpus_pipeline.near(spark, df, "")
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, w in zip([i for i, _ in docs], want, strict=True) if i == w}


def test_labels_of_one_group_meet_unless_they_are_equal(spark, monkeypatch):
    """Bins of a group: every two nodes of different labels share a cell, on different sides or on side 3; two of one large label share none."""
    monkeypatch.setattr(similar, "CHUNK", 4)
    rng = random.Random(1)
    nodes = [(i, i, g, g * 100 + (0 if rng.random() < 0.6 else rng.randint(1, 9))) for g in range(3) for i in range(g * 1000, g * 1000 + 40)]
    rows = similar._crossed(spark.createDataFrame(nodes, "mark long, node long, `group` long, label long")).collect()
    of, label = {}, {n: x for n, _, _, x in nodes}
    for r in rows:
        of.setdefault(r.cell, []).append((r.mark, r.side))
    met = {frozenset((a, b)) for held in of.values() for a, x in held for b, y in held if a != b and (x == 3 or x != y)}
    for a, _, g, x in nodes:
        for b, _, h, y in nodes:
            if a < b and g == h and x != y:
                assert frozenset((a, b)) in met
    large = {x for x in label.values() if sum(v == x for v in label.values()) > 4}
    assert large and not any(label[a] == label[b] and label[a] in large for a, b in map(tuple, met))


def test_crowded_cells_link_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    bits, more = (centre[np.arange(90) % 6] ^ (np.uint64(1) << rng.integers(0, 63, (90, 2), dtype=np.uint64))).T.copy()
    cell = np.repeat(np.arange(3, dtype=np.uint64), 30)

    def parts():
        a, b = similar._linked(cell, bits, more, bits)
        root = {x: {x} for x in bits.tolist()}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            root[x] |= root[y]
            for z in root[x]:
                root[z] = root[x]
        return {frozenset(s) for s in root.values()}

    few = parts()
    monkeypatch.setattr(similar, "CROWD", 8)
    assert parts() == few and 6 <= len(few) <= 18


def test_candidates_meet_by_counts_of_segments():
    """01 and 10 in a segment are one coordinate; a segment of another count parts fingerprints in the grids that take it, and in no others."""
    rng = np.random.default_rng(3)
    bits, more = rng.integers(0, 2**63, (2, 50), dtype=np.uint64)
    one = (bits ^ bits >> np.uint64(1)) & np.uint64(1)  # of the first segment, whether one bit is set
    swapped = bits ^ one * np.uint64(3)
    assert one.any() and (similar.cells(bits, more) == similar.cells(swapped, more)).all()
    other = np.where(one == 1, bits | np.uint64(3), bits ^ np.uint64(3))[one == 1]
    shared = similar.cells(bits[one == 1], more[one == 1]) == similar.cells(other, more[one == 1])
    assert (shared == shared[0]).all() and abs((~shared[0]).mean() - 10 / 64) < 0.08


def test_grids_follow_the_number_of_points():
    few, many = similar.grids(200_000), similar.grids(12_000_000)
    assert few == (256, 10) and many[1] == 11
    assert 12_000_000 * (3 / 8) ** many[1] <= similar.CROWD  # unrelated ones of a cell
    assert many[0] * 0.73 ** many[1] >= few[0] * 0.73 ** few[1]
    assert similar.grids(0) == few
