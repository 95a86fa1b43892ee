"""Language-model scores from a sharded Elias-Fano n-gram trie.

The corpus is cut into blocks of tokens. A block asks for what it needs, and
gives what it has, in one message to each shard: first its distinct words, then
its distinct pairs of word and successor, then its distinct triples of pair and
successor, each with its count in the training documents. A shard adds the counts
of all blocks up, builds its part of the model and answers every message in the
order of its entries; so no model is ever gathered in one place, and no table of
n-grams is exploded into rows.

A shard of pairs or triples holds two levels in compact buffers that are searched
where they lie, as a memory-mapped file would be: the contexts with monotone
pointers, and below each context its successors, both coded by Elias-Fano, beside
quantised probabilities. Successors are stored relative to their context, so one
sequence rises over all of them and an n-gram is found by one successor search.

The trie of triples is pruned: it holds what occurs ``least`` times or more. No
triple occurs more often than its two pairs, so a block sends only triples both of
whose pairs occur that often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import durable, spread_over
from .packing import MESSAGE, messages, pack, pack_rising, unpack, unpack_rising

#: Tokens of a block at least; a longer document is a block by itself.
BLOCK = 2_000_000
END = b""
#: Contexts over this share of all tokens are spread over the shards by successor.
HOT = 1 / 200
CODES = 255
#: N-grams that are searched for at once.
ASKED = 1 << 18
#: Weight of the shorter context at pairs and at triples, in tokens, and occurrences that a triple must have.
PRIORS, LEAST = (100.0, 20.0), 2
#: Bytes of blocks that go to one shard on average.
SHARD = 32 << 20


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, the first bit lowest, and two words more."""
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate([raw, np.zeros(16 + -len(raw) % 8, np.uint8)]).view("<u8")


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Places of the i-th set bits, given how many stand before each word; inside a word by halves."""
    at = np.searchsorted(before, i, "right") - 1
    word, left, place = words[at], i - before[at], at * 64
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        up = low <= left
        left -= np.where(up, low, 0)
        word = np.where(up, word >> np.uint64(width), word)
        place += np.where(up, width, 0)
    return place


class EliasFano:
    """A rising sequence in two buffers: the low bits of each number packed, the high bits in unary; read in place."""

    def __init__(self, a: np.ndarray) -> None:
        n, top = len(a), int(a[-1]) + 1 if len(a) else 1
        self.n, self.bits = n, max(0, (top // max(n, 1)).bit_length() - 1)
        self.mask = np.uint64((1 << self.bits) - 1)
        low = np.unpackbits((a & self.mask).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : self.bits]
        high = np.zeros(n + (top >> self.bits) + 1, bool)
        high[(a >> np.uint64(self.bits)).astype(np.int64) + np.arange(n)] = True
        self.low, self.high, self.rows = _words(low.reshape(-1)), _words(high), (top >> self.bits) + 1
        ones = np.r_[0, np.cumsum(np.bitwise_count(self.high), dtype=np.int64)[:-1]]
        self.ones, self.zeros = ones, np.arange(len(ones)) * 64 - ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        at, shift = i * self.bits >> 6, (i * self.bits & 63).astype(np.uint64)
        over = np.where(shift > 0, self.low[at + 1] << (np.uint64(64) - shift & np.uint64(63)), np.uint64(0))
        return (self.low[at] >> shift | over) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these places: the i-th set bit of the high part stands i places beyond the high bits' number."""
        high = (_select(self.high, self.ones, i) - i).astype(np.uint64)
        return high << np.uint64(self.bits) | (self._low(i) if self.bits else np.uint64(0))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Places of the first numbers that are no smaller, n if there is none: the numbers of one row of the high part stand between two of its zeros, and are searched by their low bits."""
        row = np.minimum(x >> np.uint64(self.bits), np.uint64(self.rows)).astype(np.int64)
        inside = np.minimum(row, self.rows - 1)
        zeros = ~self.high
        first = np.where(inside > 0, _select(zeros, self.zeros, np.maximum(inside - 1, 0)) - np.maximum(inside - 1, 0), 0)
        last = _select(zeros, self.zeros, inside) - inside
        first = np.where(row < self.rows, first, self.n)
        last = np.where(row < self.rows, last, self.n)
        low = x & self.mask
        while (open_ := first < last).any():
            middle = (first + last) >> 1
            less = open_ & (self._low(np.minimum(middle, max(self.n - 1, 0))) < low)
            first, last = np.where(less, middle + 1, first), np.where(open_ & ~less, middle, last)
        return first


def share_levels(n: int, prior: float) -> np.ndarray:
    """What codes stand for: 0, then equal ratios from the smallest share that a corpus of ``n`` tokens can have up to 1; the same in every shard."""
    return np.r_[0.0, np.geomspace(1 / (n + prior) * (1 - 1e-9), 1, CODES)]


class Trie:
    """Contexts, pointers to their successors, the successors, and a code for each pair's probability."""

    def __init__(self, contexts: np.ndarray, successors: np.ndarray, share: np.ndarray, levels: np.ndarray) -> None:
        """Pairs sorted by context and successor, with their discounted share of the context, which is rounded down to one of the levels."""
        first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(contexts) else np.zeros(0, np.int64)
        self.contexts = EliasFano(contexts[first])
        self.pointers = EliasFano(np.r_[first, len(contexts)].astype(np.uint64))
        self.width = np.uint64(int(successors.max()) + 1 if len(successors) else 1)
        place = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.r_[first, len(contexts)]))
        self.successors = EliasFano(place * self.width + successors)
        self.codes = np.clip(np.searchsorted(levels, share, "right") - 1, 0, CODES).astype(np.uint8)

    def search(self, contexts: np.ndarray, runs: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The code of each n-gram, 0 for one that the trie lacks; contexts stand once, with the number of their successors."""
        out = np.zeros(len(successors), np.uint8)
        ends = np.cumsum(runs)
        at = 0
        while at < len(contexts) and self.successors.n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ASKED, "right")))
            part = slice(int(ends[at - 1]) if at else 0, int(ends[to - 1]))
            out[part] = self._search(contexts[at:to], runs[at:to], successors[part])
            at = to
        return out

    def _search(self, contexts: np.ndarray, runs: np.ndarray, successors: np.ndarray) -> np.ndarray:
        place = self.contexts.successor(contexts)
        own = np.minimum(place, self.contexts.n - 1)
        known = np.repeat((place < self.contexts.n) & (self.contexts[own] == contexts), runs) & (successors < self.width)
        first, end = (np.repeat(self.pointers[own + x].astype(np.int64), runs) for x in (0, 1))
        wanted = np.repeat(own.astype(np.uint64), runs) * self.width + np.where(known, successors, np.uint64(0))
        at = self.successors.successor(wanted)
        known &= (at >= first) & (at < end)
        at = np.minimum(at, self.successors.n - 1)
        return np.where(known & (self.successors[at] == wanted), self.codes[at], 0).astype(np.uint8)


class _Local(dict):
    """Numbers the words of a block as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(kind: pa.DataType, least: int):
    """Documents to blocks: documents, their lengths and flags, tokens as places in the block's sorted word hashes, training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, total = TaskContext.get().partitionId(), 0, 0
        local, tokens, ids, sizes, train = _Local(), [], [], [], []

        def out() -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in local], np.uint64)
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            t, flags = rank[np.concatenate(tokens)], np.array(train, bool)
            counts = np.bincount(t[np.repeat(flags, sizes)], minlength=len(order))
            blobs = [pack(np.array(sizes)), pack(flags), pack(t), pack_rising(hashes[order]), pack(counts)]
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | at]), pa.array([ids], pa.list_(kind)), *[pa.array([b]) for b in blobs]], names=BLOCK_NAMES)

        for b in batches:
            for doc, text, flag in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("train").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                tokens.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
                ids.append(doc)
                sizes.append(len(words))
                train.append(flag)
                total += len(words)
                if total >= least:
                    yield out()
                    at, total = at + 1, 0
                    local, tokens, ids, sizes, train = _Local(), [], [], [], []
        if ids:
            yield out()

    return run


BLOCK_NAMES = ["block", "ids", "sizes", "train", "tokens", "hashes", "counts"]
BLOCK_TYPES = "sizes binary, train binary, tokens binary, hashes binary, counts binary"


def _word_messages(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = unpack_rising(row["hashes"]), unpack(row["counts"])
                to = hashes % np.uint64(shards)
                out = [(s, row["block"], pack_rising(hashes[m]), pack(counts[m]), None, None) for s in np.unique(to).tolist() for m in [to == s]]
                yield from messages(out).to_batches()

    return run


def _addressed(shards: int):
    """Blocks as they wait for answers: of the words' hashes only the shards are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [pack(unpack_rising(h) % np.uint64(shards)) for h in batch.column("hashes").to_pylist()]
            names = ["block", "ids", "sizes", "train", "tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(to, pa.binary())], names=[*names, "shards"])

    return run


def _word_shard(shards: int):
    """Counts of words; a word's number is its place in the shard by frequency, so numbers are nearly dense and those of frequent words small."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, rows = key[0].as_py(), table.to_pylist()
        hashes = [unpack_rising(r["a"]) for r in rows]
        every, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        if len(every) * shards >> 32:
            raise ValueError("numbers of words don't fit in 32 bits; more shards or fewer words")
        counts = np.bincount(inverse, np.concatenate([unpack(r["b"]) for r in rows]).astype(float), len(every)).astype(np.int64)
        rank = np.empty(len(every), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(every))
        out = [(shard, -1, pack(np.array([counts.sum(), (counts > 0).sum()])), None, None, None)]
        for r, h in zip(rows, hashes, strict=True):
            at = np.searchsorted(every, h)
            out.append((shard, r["block"], pack(rank[at] * shards + shard), pack(counts[at]), None, None))
        return messages(out)

    return run


class _Read:
    """A block together with the answers about its words."""

    def __init__(self, row: dict, answers: list[dict], shards: int) -> None:
        self.row, self.shards = row, shards
        self.sizes, self.train = unpack(row["sizes"]).astype(np.int64), unpack(row["train"]).astype(bool)
        self.tokens, to = unpack(row["tokens"]).astype(np.int64), unpack(row["shards"]).astype(np.int64)
        self.words = len(to)
        self.number, self.count = np.zeros(len(to), np.int64), np.zeros(len(to), np.int64)
        for a in answers:
            m = to == a["shard"]
            self.number[m], self.count[m] = unpack(a["a"]), unpack(a["b"])
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        before = np.r_[self.tokens[-1:], self.tokens[:-1]]
        before[self.starts] = self.tokens[-1]  # a text begins after an end
        self.before = before
        self.pairs, self.at = np.unique(before * self.words + self.tokens, return_inverse=True)
        v, w = np.divmod(self.pairs, self.words)
        self.v, self.w, self.v_count = self.number[v].astype(np.uint64), self.number[w].astype(np.uint64), self.count[v]

    def counts(self, at: np.ndarray, kinds: int, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        """How often each kind occurs in the training documents, given the kind at each place."""
        return np.bincount(at[np.repeat(self.train, self.sizes)[places]], minlength=kinds)

    def dealt(self, hot: float) -> Iterator[tuple[int, np.ndarray]]:
        return _dealt(self.v, self.w, self.v_count > hot, self.shards)

    def triples(self, said: list[dict], hot: float) -> None:
        """With the answers about pairs: the triples both of whose pairs occur often enough, and the places where they stand."""
        self.pair_count, answers = np.zeros(len(self.pairs), np.int64), {a["shard"]: a for a in said}
        for shard, part in self.dealt(hot):
            a = answers[shard]
            often = np.unpackbits(np.frombuffer(a["c"], np.uint8), count=len(part)).astype(bool)
            self.pair_count[part[often]] = unpack(a["d"])
        inner = np.ones(len(self.at), bool)
        inner[self.starts] = False
        self.context = np.r_[0, self.at[:-1]]  # the pair before each token
        self.after = np.flatnonzero(inner & (self.pair_count[self.context] > 0))
        asked = self.after[self.pair_count[self.at[self.after]] > 0]
        keys, self.triple_at = np.unique(self.context[asked] * self.words + self.tokens[asked], return_inverse=True)
        self.asked = asked
        of, w = np.divmod(keys, self.words)
        self.t_context, self.t_word = self.v[of] << np.uint64(32) | self.w[of], self.number[w].astype(np.uint64)
        self.t_count = self.pair_count[of]

    def dealt_triples(self, hot: float) -> Iterator[tuple[int, np.ndarray]]:
        return _dealt(self.t_context, self.t_word, self.t_count > hot, self.shards)


def _dealt(context: np.ndarray, successor: np.ndarray, spread: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The n-grams of each shard, by context and successor; those of a frequent context are dealt by successor too."""
    mix = context * np.uint64(0x9E3779B97F4A7C15)
    mix = (mix ^ mix >> np.uint64(29)) ^ np.where(spread, successor, np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F)
    to = ((mix >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((successor, context, to))
    cuts = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    for part in np.split(order, cuts[1:]) if len(order) else ():
        yield int(to[part[0]]), part


def _packed(shard: int, block: int, context: np.ndarray, successor: np.ndarray, counts: np.ndarray, context_counts: np.ndarray) -> tuple:
    """A message of n-grams sorted by context and successor."""
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    w = np.diff(successor, prepend=np.uint64(0))
    w[first] = successor[first]
    high, low = context[first] >> np.uint64(32), context[first] & np.uint64(0xFFFFFFFF)
    runs = np.stack([np.diff(high, prepend=np.uint64(0)), low, np.diff(np.r_[first, len(context)]).astype(np.uint64)])
    if not high.any():
        runs[1] = np.diff(low, prepend=np.uint64(0))
    return shard, block, pack(runs.reshape(-1)), pack(w), pack(counts), pack(context_counts[first])


def _opened(row: dict) -> tuple[np.ndarray, ...]:
    """Contexts, runs, successors, counts and the counts of the contexts of a message."""
    high, low, runs = unpack(row["a"]).reshape(3, -1)
    context = np.cumsum(high, dtype=np.uint64) << np.uint64(32) | low if high.any() else np.cumsum(low, dtype=np.uint64)
    runs = runs.astype(np.int64)
    w, first = unpack(row["b"]), np.r_[0, np.cumsum(runs)[:-1]].astype(np.int64)
    total = np.cumsum(w, dtype=np.uint64)
    w = total - np.repeat(total[first] - w[first], runs)
    return context, runs, w, unpack(row["c"]).astype(np.int64), unpack(row["d"]).astype(np.int64)


def _pair_messages(shards: int, hot: float):
    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = blocks.to_pylist()
        if not rows:
            return messages([])
        b = _Read(rows[0], answers.to_pylist(), shards)
        counts = b.counts(b.at, len(b.pairs))
        return messages([_packed(shard, rows[0]["block"], b.v[p], b.w[p], counts[p], b.v_count[p]) for shard, p in b.dealt(hot)])

    return run


def _triple_messages(shards: int, hot: float):
    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows, said = blocks.to_pylist(), answers.to_pylist()
        if not rows:
            return messages([])
        b = _Read(rows[0], [a for a in said if a["level"] == 1], shards)
        b.triples([a for a in said if a["level"] == 2], hot)
        counts = b.counts(b.triple_at, len(b.t_word), b.asked)
        return messages([_packed(shard, rows[0]["block"], b.t_context[p], b.t_word[p], counts[p], b.t_count[p]) for shard, p in b.dealt_triples(hot)])

    return run


def _shard(prior: float, least: int, often: int | None, n: int):
    """The shard's trie of what occurs ``least`` times or more, and for every message the codes of its n-grams.

    With ``often``, also which of its n-grams occur so many times, and how many.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, rows = key[0].as_py(), table.to_pylist()
        asked = [_opened(r) for r in rows]
        v = np.concatenate([np.repeat(c, n) for c, n, *_ in asked])
        w, c = (np.concatenate([a[i] for a in asked]) for i in (2, 3))
        of = np.concatenate([np.repeat(n, runs) for _, runs, _, _, n in asked])
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
        c = np.add.reduceat(c[order], new)
        own = c >= max(least, 1)
        trie = Trie(v[new][own], w[new][own], c[own] / (of[order][new][own] + prior), share_levels(n, prior))
        every = np.empty(len(order), np.int64)
        if often is not None:
            every[order] = np.repeat(c, np.diff(np.r_[new, len(order)]))
        out, at = [], 0
        for r, (contexts, runs, successors, _, _) in zip(rows, asked, strict=True):
            many = (None, None)
            if often is not None:
                counts = every[at : at + len(successors)]
                many = np.packbits(counts >= often).tobytes(), pack(counts[counts >= often])
            at += len(successors)
            out.append((shard, r["block"], pack(trie.search(contexts, runs, successors)), None, *many))
        return messages(out)

    return run


def _shares(n: int, dealt: Iterator[tuple[int, np.ndarray]], said: list[dict], levels: np.ndarray) -> np.ndarray:
    """What the answers' codes stand for, by n-gram."""
    out, answers = np.zeros(n), {a["shard"]: a for a in said}
    for shard, part in dealt:
        out[part] = levels[unpack(answers[shard]["a"]).astype(np.int64)]
    return out


def _scores(shards: int, hot: float, priors: tuple[float, float], order: int, n: int, kinds: int, id_type: pa.DataType):
    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows, said = blocks.to_pylist(), answers.to_pylist()
        names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
        types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not rows:
            return pa.schema(list(zip(names, types, strict=True))).empty_table()
        level = lambda k: [a for a in said if a["level"] == k]
        b = _Read(rows[0], level(1), shards)
        plain = (b.count + 1) / (n + kinds + 1)
        back = priors[0] / (b.count + priors[0])
        each = _shares(len(b.pairs), b.dealt(hot), level(2), share_levels(n, priors[0]))[b.at] + back[b.before] * plain[b.tokens]
        if order > 2:
            b.triples(level(2), hot)
            each[b.after] *= (priors[1] / (b.pair_count + priors[1]))[b.context[b.after]]
            each[b.asked] += _shares(len(b.t_word), b.dealt_triples(hot), level(3), share_levels(n, priors[1]))[b.triple_at]
        total = lambda x: np.add.reduceat(x, b.starts)
        known = (b.count > 0).astype(np.int64)
        out = [rows[0]["ids"], b.train, b.sizes, total(known[b.tokens]), total(np.log10(plain)[b.tokens]), total(np.log10(each))]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    return run


def score(docs: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text", order: int = 3, priors: tuple[float, float] = PRIORS, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows for which ``train`` holds (null doesn't) and
    scores all. Tokens are words, A-Z in lower case, then an end. ``base_score`` is
    the add-one unigram log10 probability; ``score`` that of the model of ``order``
    2 or 3. The probability of a successor is its count over the context's count
    plus the level's prior, quantised downwards, and for the rest that of the next
    shorter context; the first token of a text has an end for its context and none
    longer. Triples of fewer than ``least`` training occurrences, two at least, are
    pruned and have no share of their own, and what they and rounding lose is given to
    no other: the probabilities after a context sum to less than 1. A pair of fewer is
    no context. Shares are rounded to levels that follow the number of training tokens
    alone, so scores are the same however many shards there are.

    A null text counts as empty and has one token, the end. Repeated rows each count
    and get their row; an empty table gives none. Other columns are ignored.

    Words are told apart by 64-bit hashes, and have numbers under 2^32. A context
    with over 1 in 200 of all tokens is spread over the shards, so no shard holds a
    third of the n-grams. The number of shards follows the size of the blocks.
    """
    if order not in (2, 3) or least < 2:
        raise ValueError("order must be 2 or 3, and least 2 or more")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = base.schema["doc_id"].dataType
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    if not pa.types.is_integer(arrow):
        base = base.withColumn("doc_id", F.col("doc_id").cast("string"))
    name = "long" if arrow == pa.int64() else "int" if arrow == pa.int32() else "string"
    near = lambda m: m.repartition(shards, "block")  # noqa: E731  each level's answers move once, for all that read them
    blocks = durable(base.mapInArrow(_blocks(arrow, block), f"block long, ids array<{name}>, {BLOCK_TYPES}"))
    shards = spread_over(blocks, F.length("tokens") + F.length("hashes"), SHARD)
    by_shard = lambda m: m.repartition(shards, "shard").groupBy("shard")
    placed = near(blocks.mapInArrow(_addressed(shards), f"block long, ids array<{name}>, sizes binary, train binary, tokens binary, shards binary"))
    told = lambda answers, run, types=MESSAGE: placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, types)
    words = durable(by_shard(blocks.select("block", "hashes", "counts").mapInArrow(_word_messages(shards), MESSAGE)).applyInArrow(_word_shard(shards), MESSAGE))
    n, kinds = (int(sum(x)) for x in zip((0, 0), *[unpack(bytes(r.a)).tolist() for r in words.where("block = -1").select("a").toLocalIterator()]))  # two numbers a shard
    hot = n * HOT
    said = near(words.where("block >= 0").withColumn("level", F.lit(1)))
    codes = by_shard(told(said, _pair_messages(shards, hot))).applyInArrow(_shard(priors[0], 1, least if order > 2 else None, n), MESSAGE)
    said = said.unionAll(near(codes.withColumn("level", F.lit(2))))
    if order > 2:
        codes = by_shard(told(said, _triple_messages(shards, hot))).applyInArrow(_shard(priors[1], least, None, n), MESSAGE)
        said = said.unionAll(near(codes.withColumn("level", F.lit(3))))
    out = told(said, _scores(shards, hot, priors, order, n, kinds, arrow), f"doc_id {name}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
