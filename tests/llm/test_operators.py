"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import gzip
import hashlib
import math
import random
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.llm import bpe, components, exact_dedup, imatch, licenses, lm, mixing, quality, queries, secrets, simhash, suffix_dedup
from meterlake.llm.packing import MESSAGE_SCHEMA, pack, pack_rising, unpack, unpack_rising

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt int, digest string, bits long, part long"


def table(spark, pairs, sources=None):
    """Documents of (doc_id, text), with columns whose names operators use inside."""
    rows = [(i, t, "en", (sources or {}).get(n, "s0"), None if t is None else len(t), 7, "d", 3, 9) for n, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


LONG = "the quick brown fox " * 20_000
EDGES = [(1, "b c d e"), (2, None), (3, ""), (4, "b c d e"), (4, "b c d e"), (None, "b c d e"), (6, "É é ß\n\t x"), (7, LONG), (8, "b c d f"), (9, " "), (4, "other")]


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES, {2: None, 5: None, 6: "z"})


def operators():
    path = queries.vocabulary_path()
    return {
        "exact": lambda d: exact_dedup.exact_dedup(d, keep="largest"),
        "encode": lambda d: bpe.encode(d, path, decoded=True),
        "mixing": mixing.mix_sources,
        "lm": lambda d: lm.score(d, F.col("doc_id") != 3, block=10),
        "licenses": lambda d: licenses.license_scan(d, licenses.known_licenses(d.sparkSession)),
        "fingerprint": imatch.fingerprint,
        "edited": imatch.edited_likeness,
        "simhash": simhash.near_duplicates,
        "suffix": suffix_dedup.remove_repeats,
        "secrets": secrets.secret_scan,
        "quality": lambda d: quality.score(d, quality.Model(b"\0" * 8, b"\0" * 8, (0.0, 1.0))),
    }


@pytest.mark.parametrize("name", list(operators()))
def test_edge_rows_and_empty_table(spark, edges, name):
    run = operators()[name]
    out = run(edges).collect()
    assert collections.Counter(r[0] if name not in ("edited",) else r.doc_id for r in out) == collections.Counter(i for i, _ in EDGES)
    assert run(edges.limit(0)).count() == 0


def test_exact_dedup(spark, edges):
    best = collections.defaultdict(list)
    for i, t in EDGES:
        best[t or ""].append(i)
    out = exact_dedup.exact_dedup(edges, keep="largest").collect()
    for r in out:
        group = next(g for t, g in best.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group) and r.keep_id == max(i for i in group if i is not None)
    assert sum(r.kept for r in out) == len(best)
    kept = exact_dedup.distinct_documents(edges, keep="largest")
    assert kept.columns == edges.columns and sorted((r.text or "") for r in kept.collect()) == sorted(best)
    small = exact_dedup.exact_dedup(edges, normalise=F.upper)
    assert {r.keep_id for r in small.collect() if r.doc_id in (1, 4)} >= {1}


def test_exact_dedup_finds_cold_copies_by_neighbours_alone(spark, monkeypatch):
    """With every digest the same, groups of cold beginnings are the same as ever."""
    texts = {i: f"{i % 70} words of text number {i % 70}" for i in range(210)}
    docs = table(spark, list(texts.items()))
    assert exact_dedup.hot_leads(docs.select(F.substring("text", 1, 32).alias("lead"), F.col("text").alias("body")), 4).count() == 0
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, bits: F.lit("00"))
    out = exact_dedup.exact_dedup(docs).collect()
    assert len(out) == 210 and all(r.keep_id == r.doc_id % 70 and r.group_size == 3 and r.kept == (r.doc_id < 70) for r in out)


def test_exact_dedup_of_a_text_that_half_of_all_rows_share(spark):
    texts = {i: "the same beginning of every text, then the same end" if i % 2 else f"the same beginning of every text, then {i % 100}" for i in range(800)}
    docs = table(spark, list(texts.items()))
    assert exact_dedup.hot_leads(docs.select(F.substring("text", 1, 32).alias("lead"), F.col("text").alias("body")), 4).count() == 1
    best = collections.defaultdict(list)
    for i, t in texts.items():
        best[t].append(i)
    for r in exact_dedup.exact_dedup(docs, keep="largest").collect():
        group = best[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))


def test_bpe_long_words_merge_in_the_order_of_short_ones(monkeypatch):
    codec = bpe.Codec(bpe.read_vocabulary(queries.vocabulary_path()))
    rng = random.Random(5)
    words = ["".join(rng.choices("aabeinst", k=rng.randint(2, 60))) for _ in range(300)]
    short = [codec[w] for w in words]
    codec.clear()
    monkeypatch.setattr(bpe, "LONG", 1)
    assert [codec[w] for w in words] == short
    monkeypatch.undo()
    assert len(codec["a" * 300_000]) > 0


def test_bpe_splits_every_code_point_as_the_library_does():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    codec = bpe.Codec(bpe.read_vocabulary(queries.vocabulary_path()))
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        for t, e in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(codec.encode(t), "<u4").tolist() == e.ids, hex(ord(t[1]))


def test_bpe_composes_as_the_library_does():
    """Every combining mark beside marks of lower, equal and higher class and between letters that compose; every composed letter, taken apart too."""
    import unicodedata

    from tokenizers import Tokenizer
    from tokenizers.normalizers import NFC

    codec, library = bpe.Codec(bpe.read_vocabulary(queries.vocabulary_path())), NFC()
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.combining(chr(c))]
    beside = ["\u0334", "\u3099", "\u05b0", "\u0323", "\u0301", "\u0345", "\u0358", "\u07fd", "\U00011930"]
    texts = [t for m in marks for b in beside for t in (f"a{m}{b}", f"a{b}{m}", f"e{m}\u0301{b}i")]
    whole = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.decomposition(chr(c))[:1] not in ("", "<")]
    texts += [t for c in whole for t in (c, unicodedata.normalize("NFD", c), "".join(chr(int(x, 16)) for x in unicodedata.decomposition(c).split()) + "\u0301")]
    rng = random.Random(4)
    texts += ["".join(rng.choices([*marks, *"aeiou가각"], k=12)) for _ in range(5000)]
    assert [t for t in texts if codec.composed(t) != library.normalize_str(t)] == []
    tokens = Tokenizer.from_file(queries.vocabulary_path())
    tokens.no_truncation(), tokens.no_padding()
    some = texts[:: max(1, len(texts) // 4000)]
    for t, e in zip(some, tokens.encode_batch(some, add_special_tokens=False), strict=True):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == e.ids, t.encode("unicode_escape")


def test_bpe_finds_special_tokens_however_they_look():
    import json

    file = json.loads(bpe.read_vocabulary(queries.vocabulary_path()))
    file["added_tokens"].append(file["added_tokens"][0] | {"id": max(t["id"] for t in file["added_tokens"]) + 1, "content": "[SEP]"})
    codec = bpe.Codec(json.dumps(file))
    assert codec.encode("a[SEP]b") == codec.encode("a") + np.array([codec.special["[SEP]"]], "<u4").tobytes() + codec.encode("b")


def test_bpe_matches_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    rng = random.Random(2)
    pool = ["Σ", "İ", "ß", "é", "é", "ﬁ", "中", "😀", "<|endoftext|>", "<|", "'LL", "½", " ", "\t", "\x85", "a", "B", "9", "."]
    texts = ["", None, LONG, "ab" * 2000, "".join(rng.choices("etaoin", k=3000)), "é中" * 700 + "!", *["".join(rng.choice(pool) for _ in range(30)) for _ in range(300)]]
    out = bpe.encode(table(spark, list(enumerate(texts))), path, decoded=True).orderBy("doc_id").collect()
    for r, text in zip(out, texts):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded_text == t.decode(want, skip_special_tokens=False)
    again = bpe.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in out], "doc_id long, ids binary"), path)
    assert {r.doc_id: r.decoded_text for r in again.collect()} == {r.doc_id: r.decoded_text for r in out}


def level_targets(sizes, weights):
    """Targets by sharing again and again what goes over three times a source."""
    total, left, out = sum(sizes.values()), set(sizes), {}
    rest = float(total)
    while left:
        w = sum(weights[s] for s in left)
        over = {s for s in left if rest * weights[s] / w > 3 * sizes[s]}
        if not over:
            return out | {s: rest * weights[s] / w for s in left}
        for s in over:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        left -= over
    return out


def test_mixing(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("w" for _ in range(rng.randint(0, 40)))) for i in range(300)]
    names = {n: rng.choice(["a"] * 30 + ["B", "c", "é", None, "zz"]) for n in range(300)}
    out = mixing.mix_sources(table(spark, docs, names)).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = level_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = collections.Counter()
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(want[s] + 1e-6) or taken[s] == math.floor(want[s]) for s in sizes)
    key = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert key(out) == key(mixing.mix_sources(table(spark, docs, names).repartition(7)).collect())
    mixed = mixing.mixed_documents(table(spark, docs, names))
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == collections.Counter({r.doc_id: r.taken for r in out if r.taken})


@pytest.mark.parametrize("order", [2, 3])
def test_lm(spark, order):
    rng = random.Random(6)
    vocabulary = [f"W{i}" for i in range(40)]
    docs = [(i, None if i == 5 else " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 60)))) for i in range(200)]
    train = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 != 2}
    tokens = {i: [w.lower() for w in (t or "").split()] + [""] for i, t in docs}
    c, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for i in train:
        c.update(tokens[i])
        c2.update(zip(["", *tokens[i]], tokens[i]))
        c3.update(zip(["", *tokens[i]], tokens[i], tokens[i][1:]))
    n, v = sum(c.values()), len(c)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    base = lambda w: (c[w] + 1) / (n + v + 1)
    two = lambda a, w: (c2[a, w] + 20 * base(w)) / (c[a] + 20)

    def three(a, b, w, least):
        if order == 2 or c2[a, b] < least:
            return two(b, w)
        own = c3[a, b, w] if c3[a, b, w] >= least else 0
        return (own + 5 * two(b, w)) / (c2[a, b] + 5)

    assert sum(x >= 3 for x in c3.values()) > 50
    for block, least in ((50, 2), (10**6, 3)):
        out = lm.score(table(spark, docs), ~held, block=block, priors=(20.0, 5.0), order=order, least=least).collect()
        for r in out:
            t = tokens[r.doc_id]
            assert r.train == (r.doc_id in train) and r.train_tokens == n and r.n_tokens == len(t)
            assert r.n_known == sum(c[w] > 0 for w in t)
            assert r.base_score == pytest.approx(sum(math.log10(base(w)) for w in t))
            want = math.log10(two("", t[0])) + sum(math.log10(three(a, b, w, least)) for a, b, w in zip(["", *t], t, t[1:]))
            assert r.score == pytest.approx(want, abs=0.03 * r.n_tokens)


def test_lm_scores_follow_no_setting(spark):
    """The same scores however many shards there are; shares lie under their true value by less than a level."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    seen = []
    for n in (2, 7, 31):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            seen.append({r.doc_id: (r.score, r.base_score) for r in lm.score(docs, train, block=20_000).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2]
    levels = lm.share_levels(10**9, 20.0)
    assert len(levels) == lm.CODES + 1 and levels[1] <= 1 / (10**9 + 20) and (np.diff(levels) > 0).all() and (levels[2:] / levels[1:-1]).max() < 1.09


def test_lm_of_order_three_tells_held_out_texts_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    bits = {order: lm.score(docs, train, order=order).where("not train").agg(F.sum("score") / F.sum("n_tokens")).first()[0] for order in (2, 3)}
    assert bits[3] > bits[2]


@pytest.mark.parametrize("top", [1, 3, 1000, 10**6, 2**62])
def test_elias_fano_is_read_and_searched_in_place(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 63, 64, 65, 3000):
        a = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        held = lm.EliasFano(a)
        assert (held[np.arange(n)] == a).all()
        asked = np.r_[rng.integers(0, top, 500).astype(np.uint64), a, a + np.uint64(1), np.array([0, top, 2 * top], np.uint64)]
        assert (held.successor(asked) == np.searchsorted(a, asked)).all()


def test_trie_and_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        a = np.sort(rng.integers(0, 10**9, n)).astype(np.uint64)
        assert (unpack_rising(pack_rising(a)) == a).all() and (unpack(pack(a)) == a).all()
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 300, (4000, 2))})
    v, w = (np.array(x, np.uint64) for x in zip(*pairs))
    trie = lm.Trie(v, w, np.linspace(0.01, 0.9, len(v)), lm.share_levels(300, 20.0))
    ask = rng.integers(0, 310, (5000, 2)).astype(np.uint64)
    ask = ask[np.argsort(ask[:, 0], kind="stable")]
    codes = trie.search(*np.unique(ask[:, 0], return_counts=True), ask[:, 1])
    assert [bool(x) for x in codes] == [(int(a), int(b)) in set(pairs) for a, b in ask]


def test_license_scan(spark):
    mit = licenses.KNOWN["MIT"]
    texts = ["Copyright (c) 2020 Someone\n\n" + mit, mit.upper().replace(" ", "\n  "), mit + " more", "Released under the MIT License.", "", None, "(c) only", "some prose\n  released under the MIT Licence\nmore\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."]
    docs = table(spark, list(enumerate(texts)))
    out = licenses.license_scan(docs, licenses.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r.license_id for r in out] == ["MIT", "MIT", None, "MIT-line", None, None, None, None]
    assert [r.line_licenses for r in out] == [["MIT"], [], [], ["MIT-line"], [], [], [], ["CC-BY-NC-4.0-line", "MIT-line"]]
    none = licenses.license_scan(docs, licenses.known_licenses(spark, {}, {})).collect()
    assert len(none) == len(texts) and not any(r.license_id or r.line_licenses for r in none)


@pytest.mark.parametrize("more", [0, 100_000])
def test_license_scan_with_any_number_known(spark, more):
    """The same rows whether the known ones are looked up or joined."""
    mit, isc = licenses.KNOWN["MIT"], licenses.KNOWN["ISC"]
    docs = table(spark, [(1, isc), (2, "x"), (2, "x"), (3, f"notes\n{mit}\nmore\n{mit}\nReleased under the MIT licence!\n\n"), (None, mit), (4, None), (5, ""), (6, "number 77 of many"), (7, "\n".join(f"number {i} of many" for i in range(0, 100_000, 9999)))])
    known = licenses.known_licenses(spark)
    if more:
        known = known.unionByName(spark.range(more).select(F.format_string("L%06d", "id").alias("license_id"), F.concat(F.lit("number "), F.col("id").cast("string"), F.lit(" of many")).alias("text"), F.lit(None).cast("string").alias("digest")))
    out = sorted(str((r.doc_id, r.license_id, r.line_licenses)) for r in licenses.license_scan(docs, known).collect())
    many = [f"L{i:06d}" for i in range(0, 100_000, 9999)]
    want = [(1, "ISC", ["ISC"]), (2, None, []), (2, None, []), (3, None, ["MIT", "MIT-line"]), (None, "MIT", ["MIT"]), (4, None, []), (5, None, []), (6, "L000077" if more else None, ["L000077"] if more else []), (7, None, many if more else [])]
    assert out == sorted(map(str, want))


def test_whole_licenses_wrapped_and_spelled_otherwise(spark):
    """Whole license texts of this machine, as they are and wrapped anew, in capitals, with other spellings and copyright lines."""
    import pathlib
    import textwrap

    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause-UC"}
    files = {i: pathlib.Path("/usr/share/common-licenses", f) for f, i in names.items()}
    if not all(f.exists() for f in files.values()):
        pytest.skip("no license texts on this machine")
    texts = []
    for i, f in files.items():
        text = f.read_text(encoding="utf-8", errors="replace")
        body = "\n".join(x for x in text.split("\n") if "opyright" not in x)
        other = text.replace("license", "licence").replace("License", "Licence").replace("https://", "http://").replace('"', "'")
        texts += [(i, text), (i, other), (i, "Copyright (C) 2001 Some One\n" + text)]
        if body == text:
            texts.append((i, textwrap.fill(text, 50, replace_whitespace=False)))
    docs = table(spark, list(enumerate(t for _, t in texts)))
    out = licenses.license_scan(docs, licenses.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r.license_id for r in out] == [i for i, _ in texts]


def test_imatch(spark):
    docs = [(i * 3, t) for i, t in enumerate(["one two three four " * 5, "zeta", "", "x" * 9, "one two three four " * 5, LONG])]
    rng = random.Random(9)
    # of 4000 words each is in about two texts, inside the band; of 500 none would be
    docs += [(100 + i, " ".join(f"w{rng.randint(0, 4000)}" for _ in range(200))) for i in range(40)]
    out = {r.doc_id: r for r in imatch.edited_likeness(table(spark, docs)).collect()}
    for (i, t), (_, nxt) in zip(docs, [*docs[1:], docs[0]]):
        k = len(t) // 4
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert 0 <= out[i].near_next <= 1 and 0 <= out[i].near_edited <= 1
    assert out[0].fingerprint == out[12].fingerprint != out[3].fingerprint
    assert out[6].near_edited == 1 and out[6].fingerprint == out[6].edited_fingerprint
    late = [out[i] for i in out if i >= 100]
    assert np.mean([r.near_edited for r in late]) > np.mean([r.near_next for r in late]) + 0.1
    alone = imatch.edited_likeness(table(spark, docs[:1])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def roots(values, most):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def plain_fingerprint(text):
    import xxhash

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("ABCDEFGH") + str(rng.randint(0, 50)) for _ in range(300)) for _ in range(25)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        docs.append((100 + i, " ".join(words)))
    docs += [(200, ""), (201, None), (202, "É a"), (203, "one")]
    out = sorted(simhash.near_duplicates(table(spark, docs)).collect())
    values = [plain_fingerprint(t or "") for _, t in docs]
    assert [r.fingerprint for r in out] == [f"{x:016x}" for x in values]
    assert [r.component_id for r in out] == [docs[r][0] for r in roots(values, 3)]
    kept = simhash.keep_one(table(spark, docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in out})


@pytest.mark.parametrize("chunk", [16, 2048])
def test_links_in_crowded_cells(spark, monkeypatch, chunk):
    """Many fingerprints around one, so cells overflow a chunk."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(8)
    values = set()
    for _ in range(500):
        x = 0x0F0F
        for _ in range(rng.randint(0, 8)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(x),) for x in values], "bits long")
    got = {r.node: r.root for r in components.components(simhash.fingerprint_links(df)).collect()}
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for x, r in zip(values, roots(values, 3)):
        groups[got.get(simhash._signed(x), simhash._signed(x))].add(x)
        want[r].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components.components(links).collect()} == {**{i: 0 for i in range(1, 51)}, 101: 100}


def test_suffix_dedup(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 160))) for _ in range(20)]
    docs = [(i, "".join(rng.choice(base)[rng.randint(0, 60) : rng.randint(40, 160)] for _ in range(rng.randint(0, 4)))) for i in range(80)]
    docs += [(80, None), (3, docs[3][1]), (None, docs[5][1]), (81, "x" * 200), (82, "x" * 120)]
    first, want = {}, collections.Counter()
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        t = (t or "").encode()
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in docs:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if i is None and first[t[p : p + 50]] is not None or i is not None and first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        want[i, len(t), sum(gone), sum(1 for j in range(len(t)) if gone[j] and not (j and gone[j - 1])), bytes(c for c, g in zip(t, gone) if not g)] += 1
    for block in (200, 10**6):
        out = suffix_dedup.remove_repeats(table(spark, docs), block=block).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == want


def test_suffix_dedup_splits_grams_with_many_surroundings(monkeypatch):
    """Blocks and shards by hand, every shared gram split, against the same with none split and against plain strings."""
    rng = random.Random(9)
    word = "a sixteen byte run of words that many share"
    texts = ["".join(rng.choice(["qrstu", word, "xyz " * 14, str(rng.random())]) for _ in range(12)).encode() for _ in range(60)]
    cut = [range(0, 20), range(20, 45), range(45, 60)]
    shards = 4

    def answered(step, blocks, rows):
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append({**dict.fromkeys("abcd"), **r})
        out = [r for s, said in by.items() for r in step((pa.scalar(s),), pa.Table.from_pylist(said, MESSAGE_SCHEMA)).to_pylist()]
        return {b: [r for r in out if r["block"] == b] for b in blocks}

    def removed():
        rows = []
        for n, part in enumerate(cut):
            batch = pa.RecordBatch.from_arrays([pa.array(list(part)), pa.array([texts[i].decode() for i in part])], names=["doc_id", "text"])
            monkeypatch.setattr(suffix_dedup, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: n)}))}))
            rows += [r for b in suffix_dedup._blocks(10**9)([batch]) for r in b.to_pylist()]
        asked = [r for b in suffix_dedup._gram_messages(shards)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
        first = answered(suffix_dedup._gram_shard, [r["block"] for r in rows], asked)
        run = suffix_dedup._context_messages(shards)
        sent = [m for r in rows for m in run((), pa.Table.from_pylist([r]), pa.Table.from_pylist(first[r["block"]], MESSAGE_SCHEMA)).to_pylist()]
        second = answered(suffix_dedup._context_shard, [r["block"] for r in rows], sent)
        said = {b: [{**r, "step": 1} for r in first[b]] + [{**r, "step": 2} for r in second[b]] for b in first}
        kept = [r for x in rows for r in suffix_dedup._kept(shards)((), pa.Table.from_pylist([x]), pa.Table.from_pylist(said[x["block"]])).to_pylist()]
        return {r["doc_id"]: r["kept"] for r in kept}, any(m["b"] is not None for b in first.values() for m in b)

    first, want = {}, {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        want[i] = bytes(c for c, g in zip(t, gone) if not g)
    assert removed() == (want, False)
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 2)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 0)
    assert removed() == (want, True)


def plain_secrets(text):
    import re

    spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))


def test_secret_base_rules():
    rng = random.Random(1)
    pieces = ["token", "API_KEY", "passwd", "ſecret", "secret", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", "=="]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        base, spans = secrets.scan(text)
        assert [(secrets.KINDS[k], a, b) for a, b, k in base] == plain_secrets(text)
        assert set(base) <= set(spans)


def plain_layers(text):
    """All spans by plain recursion: a layer is a list of (character, start, end), and every layer is opened in full."""
    import re

    found = set()

    def visit(layer, above):
        flat = "".join(c for c, _, _ in layer)
        if (flat, layer[0][1:] if layer else 0) in above:
            return
        above = above | {(flat, layer[0][1:] if layer else 0)}
        found.update((layer[a][1], layer[b - 1][2], kind) for kind, a, b in plain_secrets(flat))
        out, at, undone = [], 0, False
        for m in re.finditer(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}", flat):  # texts of this test hold ASCII escapes only
            out += layer[at : m.start()] + [(chr(int(m[0][-2:] if m[0][0] == "%" else m[0][2:], 16)), layer[m.start()][1], layer[m.end() - 1][2])]
            at, undone = m.end(), True
        if undone:
            visit(out + layer[at:], above)
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}", flat):
            body = m[0].replace("-", "+").replace("_", "/")
            body = body[: len(body) - (len(body) % 4 == 1)]
            data, end = base64.b64decode(body + "=" * (-len(body) % 4)), m.end()
            while end < min(len(flat), m.end() + 2) and flat[end] == "=":
                end += 1
            try:
                while data[:2] in (b"\x1f\x8b", b"x\x9c"):  # what is cut off unpacks as far as it goes
                    data = zlib.decompressobj(47).decompress(data)
            except zlib.error:
                pass
            span = layer[m.start()][1], layer[end - 1][2]
            visit([(c, *span) for c in data.decode("utf-8", "replace")], above)

    visit([(c, i, i + 1) for i, c in enumerate(text)], frozenset())
    return sorted(((a, b, secrets.KINDS.index(k)) for a, b, k in found), key=lambda s: (s[0], s[2], s[1]))


def nested(rng, depth):
    text = rng.choice(["token=abc123def", "AKIA" + "B" * 18, "0123456789abcdef" * 2, "plain words", "é ü", "secret : 'zyxwvu98'"])
    for _ in range(rng.randint(0, depth)):
        text = rng.choice([
            lambda t: "".join(f"%{ord(c):02x}" if c in " =:'%" else c for c in t),
            lambda t: "".join(f"\\u{ord(c):04x}" if c in "aeT=\\" else c for c in t),
            lambda t: base64.b64encode(t.encode()).decode(),
            lambda t: base64.urlsafe_b64encode(gzip.compress(t.encode(), mtime=0)).decode(),
            lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
            lambda t: "one " + t + ", two " + t,
        ])(text)
    return text


def test_secret_layers_against_plain_recursion():
    rng, found = random.Random(3), 0
    for _ in range(400):
        text = " ".join(nested(rng, 5) for _ in range(3))
        spans = secrets.scan(text)[1]
        assert spans == plain_layers(text), text
        found += len(spans)
    assert found > 1000


def test_secret_escapes_deeper_than_counted():
    """Past the counted layers the rest is undone in one pass, to the same last layer."""
    for n in (3, secrets.DEPTH + 5):
        text = "see token%" + "25" * n + "3Dabcd%" + "25" * n + "65f12 end"
        assert (4, text.index(" end"), 0) in secrets.scan(text)[1]
    assert "".join(secrets._settled("%C3%A9\\ud83d\\ude00%5Cu0041%%34%31%ff", None)[0]) == "é😀A%A�".replace("%A", "A")
    big = "%" + "25" * 500_000
    secrets.scan(big)  # in seconds: linear in its length


def test_secret_payloads_are_read_to_their_end(monkeypatch):
    import zstandard

    zstd = zstandard.ZstdCompressor().compress
    inner = zlib.compress(gzip.compress(b"token=abcdef1"))
    assert b"".join(secrets._unpacked(zstd(inner))) == b"token=abcdef1"
    assert b"".join(secrets._unpacked(b"x^ no payload at all")) == b"x^ no payload at all"
    secret = b"token=abcdef12"
    whole = b"words, and " * 2_000_000 + secret  # over 16 MB
    for data in (gzip.compress(whole), zlib.compress(whole), zstd(whole), gzip.compress(b"a, b") + gzip.compress(secret), zstd(b"a, b ") + zstd(secret), gzip.compress(zstd(whole)), b"\xff \xfe" + secret):
        text = "see " + base64.b64encode(data).decode()
        assert [s for s in secrets.scan(text)[1] if s[2] == 0] == [(4, len(text), 0)]
    for blank in "\u00a0\u3000\ufeff\u200b\x0c\x00":
        assert secrets.scan(base64.b64encode(f"it is{blank}token=abcdef12".encode()).decode())[1]
    lines = base64.encodebytes(gzip.compress(bytes(random.Random(1).randbytes(200)).hex().encode() + b" token=abcdef12")).decode()
    assert lines.count("\n") > 2 and (0, len(lines) - 1, 0) in secrets.scan(lines)[1]
    monkeypatch.setattr(secrets, "WINDOW", 64)  # windows end where no find goes on, so they change nothing
    rng = random.Random(4)
    for _ in range(200):
        body = " ".join(rng.choice(["token = abcdef12", "secret", ":", "zzzzzz", "password", "'q1w2e3r4'", "AKIA" + "C" * 20, "0123456789abcdef" * 3, "é", "a b c", "%41%25", "word,"]) for _ in range(40))
        packed = base64.b64encode(gzip.compress(body.encode())).decode()
        assert {k for _, _, k in secrets.scan(packed)[1]} == {k for _, _, k in secrets.scan(body)[1]}, body


def test_secret_scan_keeps_large_identifiers_beside_null(spark):
    ids = [2**53 + 1, 2**53 + 3, None]
    rows = secrets.secret_scan(spark.createDataFrame([(i, "token=abcdef") for i in ids], "doc_id long, text string").coalesce(1)).collect()
    assert [r.doc_id for r in rows] == ids


def test_secret_layers():
    hidden = 'password = "hunter2hunter2"'
    layers = [
        urllib.parse.quote(hidden, safe=""),
        "".join(f"\\u{ord(c):04x}" for c in hidden),
        base64.b64encode(hidden.encode()).decode(),
        base64.b64encode(gzip.compress(hidden.encode())).decode(),
        base64.urlsafe_b64encode(zlib.compress(base64.b64encode(hidden.encode()))).decode(),
        urllib.parse.quote(urllib.parse.quote(base64.b64encode(hidden.encode()).decode(), safe=""), safe=""),
    ]
    for body in layers:
        text = "é before " + body + " after"
        base, spans = secrets.scan(text)
        found = [s for s in spans if s[2] == 0]
        assert found and all(9 <= a < b <= 9 + len(body) for a, b, _ in found), body
    assert secrets.scan("%25%2525 plain " + "QUFB" * 10) == ([], [])


def test_secret_layers_that_occur_twice():
    inner = base64.b64encode(b"token%3Dabcdef123456").decode()
    text = f"one {inner} two {inner} three"
    spans = secrets.scan(text)[1]
    assert [(a, b) for a, b, _ in spans] == [(4, 4 + len(inner)), (9 + len(inner), 9 + 2 * len(inner))]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in out)
    assert right / len(out) > 0.9
    none = quality.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs.limit(5), none).collect()} == {0.5}


def test_quality_level_does_not_follow_the_sample_bound(spark):
    """Scores keep to the share of good rows whether all rows are sampled, at about six to one, or as many of either side."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("doc_id", "text", "quality")
    right = held.agg(F.avg("quality")).first()[0]
    seen = {}
    for sample in (6000, 600):
        scored = quality.score(held, quality.fit(docs, labels, sample=sample))
        seen[sample] = scored.agg(F.avg("score")).first()[0]
        assert abs(seen[sample] - right) < 0.03, (sample, seen, right)
    assert abs(seen[6000] - seen[600]) < 0.03
