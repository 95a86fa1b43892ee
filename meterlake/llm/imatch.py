"""Document fingerprints by I-Match.

A document's distinct terms are kept if their inverse document frequency lies in
a band: neither the words everyone uses nor those hardly anyone does. The terms
that fall into one of several random subsets of the lexicon are sorted and
hashed together, once for each subset. Subsets of two densities, which follow
the number of distinct terms, make the hashes about equally telling for short
and long texts; two fingerprints are compared where their densities meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, slim, tasks, words

#: Natural logarithms of documents over documents with the term.
BAND = (3.0, 7.0)
#: Subsets of either density, and about how many distinct terms, in the band or not, fall into one of the denser kind.
SUBSETS, FILL = 16, 2
#: The lexicon is broadcast up to this many terms of 8 bytes. The band bounds it: a text has m distinct terms on average, so at most m * exp(7) are in exp(-7) of the texts.
BROADCAST_TERMS = 1_000_000


def term_hashes(text: Column) -> Column:
    """Distinct terms of a text, lower case, as 64-bit hashes."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``term`` of the texts whose inverse document frequency lies in the band; the frequency counts all texts, null ones as empty."""
    n = texts.count()
    counts = texts.select(F.explode(term_hashes(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = counts.where((F.col("df") <= n * math.exp(-band[0])) & (F.col("df") >= n * math.exp(-band[1]))).select("term")
    kept = durable(kept)
    return F.broadcast(kept) if kept.count() <= BROADCAST_TERMS else kept


def density(terms: Column) -> Column:
    """Binary logarithm of the parts into which the lexicon falls at the denser of a text's two densities."""
    return F.greatest(F.lit(int(math.log2(SUBSETS))), F.floor(F.log2(F.greatest(F.size(terms), F.lit(1)) / FILL))).cast("int")


def _parts(level: Column, which: int) -> Column:
    return F.pow(F.lit(2.0), level + which).cast("long")


def _picked(terms: str, group: int, which: int) -> Column:
    """The terms that fall into one of the subsets at this density, marked with their group."""
    chosen = F.filter(terms, lambda t: F.pmod(t, F.col(f"{terms}_parts{which}")) < SUBSETS)
    return F.transform(chosen, lambda t: F.struct(F.lit(group).alias("group"), t.alias("term")))


def _hashes(terms: Column, parts: Column) -> Column:
    """A hash for each subset of its sorted terms, null where the text has none in it."""
    nothing = F.xxhash64(F.array().cast("array<bigint>"))
    return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda r: F.nullif(F.xxhash64(F.filter(terms, lambda t: F.pmod(t, parts) == r)), nothing))


def signatures(texts: DataFrame, terms: DataFrame, columns: list[str]) -> DataFrame:
    """``key`` and columns, each a text, to ``key`` and for each column a struct of level, dense, sparse, plain.

    ``plain`` stands for a text none of whose terms is in any subset: a hash of all
    its distinct terms, whatever their frequency, 0 for a text without words.
    """
    hashed = texts.select("key", *[term_hashes(F.col(c)).alias(c) for c in columns])
    for c in columns:
        hashed = hashed.withColumn(f"{c}_level", density(F.col(c)))
    sides = [(c, w) for c in columns for w in (0, 1)]
    hashed = hashed.select(
        "*",
        *[_parts(F.col(f"{c}_level"), w).alias(f"{c}_parts{w}") for c, w in sides],
        *[F.when(F.size(c) > 0, F.xxhash64(F.sort_array(c))).otherwise(0).alias(f"{c}_plain") for c in columns],
    )
    rest = [f"{c}_{k}" for c in columns for k in ("level", "parts0", "parts1", "plain")]
    rows = hashed.select("key", *rest, F.explode_outer(F.concat(*[_picked(c, g, w) for g, (c, w) in enumerate(sides)])).alias("x")).select("key", *rest, "x.group", "x.term")
    rows = rows.join(terms.withColumn("known", F.lit(True)), "term", "left")
    own = [F.sort_array(F.collect_list(F.when(F.col("known") & (F.col("group") == g), F.col("term")))).alias(f"terms{g}") for g in range(len(sides))]
    found = rows.groupBy("key").agg(*own, *[F.first(c).alias(c) for c in rest])
    out = []
    for i, c in enumerate(columns):
        dense, sparse = (_hashes(F.col(f"terms{2 * i + w}"), F.col(f"{c}_parts{w}")) for w in (0, 1))
        none = F.size(f"terms{2 * i}") + F.size(f"terms{2 * i + 1}") == 0
        out.append(F.struct(F.col(f"{c}_level").alias("level"), dense.alias("dense"), sparse.alias("sparse"), F.when(none, F.col(f"{c}_plain")).alias("plain")).alias(c))
    return found.select("key", *out)


def shown(s: Column) -> Column:
    """A signature as text: the level, then the hashes in hexadecimal with - for an empty subset."""
    one = lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("-"))
    several = F.concat_ws(";", s["level"].cast("string"), F.array_join(F.transform(s["dense"], one), ","), F.array_join(F.transform(s["sparse"], one), ","))
    return F.when(s["plain"].isNotNull(), F.concat(F.lit("plain;"), one(s["plain"]))).otherwise(several)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the subsets that have a term of either text, at the densities both have, the share with equal hashes."""
    same = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e))
    some = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: p.isNotNull() | q.isNotNull()), lambda e: e))
    up = b["level"] - a["level"]
    pick = lambda f: F.when(up == 0, f(a["dense"], b["dense"]) + f(a["sparse"], b["sparse"])).when(up == 1, f(a["sparse"], b["dense"])).when(up == -1, f(a["dense"], b["sparse"])).otherwise(0)
    plain = a["plain"].isNotNull() | b["plain"].isNotNull()
    return F.when(plain, (a["plain"].eqNullSafe(b["plain"])).cast("double")).otherwise(F.coalesce(F.try_divide(pick(same).cast("double"), pick(some)), F.lit(0.0)))


def fingerprint(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint``; equal texts have equal fingerprints.

    A null text counts as empty; texts without words share one fingerprint.
    Repeated rows each get their row; an empty table gives none. Other columns are
    ignored.
    """
    base = slim(docs, doc_id, text)
    prints = signatures(base.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("key"), "text"), lexicon(base, band), ["text"])
    return prints.select(F.col("key.doc_id").alias("doc_id"), shown(F.col("text")).alias("fingerprint"))


def _range(c: Column, cuts: list) -> Column:
    """How many cuts lie below a value; looked up in two steps, so many ranges stay cheap."""
    step = max(1, math.isqrt(len(cuts)))
    below = lambda a: F.size(F.filter(a, lambda s: s < c))
    if not cuts:
        return F.lit(0)
    fine, coarse = F.array(*map(F.lit, cuts)), F.array(*[F.lit(x) for x in cuts[step - 1 :: step]])
    from_ = below(coarse) * step
    return F.when(c.isNull(), len(cuts)).otherwise(from_ + below(F.slice(fine, from_ + 1, F.lit(step))))


def followers(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, next_key, doc_id, text, next_text``: every document with the one that follows it by ascending identifier, the first after the last.

    Identifiers are numbers; null comes last, and rows of one identifier follow the
    hash of their text. The identifiers' quantiles cut the table into ranges of like
    size; each gets the first row of the next range as well, so one shuffle by range
    brings every pair together. Keys are unique and follow the order.
    """
    n = tasks(docs)
    base = slim(docs, doc_id, text).withColumn("tie", F.xxhash64("text"))
    cuts = base.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)])).first()[0] if n > 1 else []
    base = base.withColumn("range", _range(F.col("doc_id"), sorted(set(cuts or []))))
    heads = base.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("head"))  # a row for each range
    along = Window.orderBy("range")
    back = F.coalesce(F.lag("range").over(along), F.max("range").over(Window.partitionBy()))
    heads = F.broadcast(heads.select(back.alias("to"), F.col("range").alias("home"), "head.*").select("to", "home", F.col("doc_id").alias("head_id"), F.col("tie").alias("head_tie")))
    guests = base.join(heads, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
    guests = guests.groupBy("to", "home").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    rows = base.select("range", "doc_id", "text", "tie", F.lit(-1).alias("home"))
    rows = rows.unionAll(guests.select(F.col("to").alias("range"), "doc_id", "text", "tie", "home"))
    w = Window.partitionBy("range").orderBy(F.col("home") >= 0, F.col("doc_id").asc_nulls_last(), "tie")
    key = lambda r, i: r.cast("long") * (1 << 40) + i
    place = F.row_number().over(w).cast("long")
    rows = rows.select(
        key(F.col("range"), place).alias("key"),
        F.when(F.lead("home").over(w) >= 0, key(F.lead("home").over(w), F.lit(1))).otherwise(key(F.col("range"), place + 1)).alias("next_key"),
        "doc_id",
        "text",
        F.lead("text").over(w).alias("next_text"),
        "home",
    )
    return rows.where("home < 0").drop("home")


def edited_likeness(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has the last quarter of its characters, rounded down, replaced
    by as many first characters of the next document, or all it has. The lexicon is
    that of the texts as they stand. Cases as in ``fingerprint`` and ``followers``.
    """
    pairs = followers(docs, doc_id=doc_id, text=text)
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next_text", F.lit(1), quarter))
    pairs = pairs.select(F.struct("key", "next_key", "doc_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(edited, 256)).alias("sha")).alias("key"), F.col("text").alias("own"), edited.alias("edited"))
    s = durable(signatures(pairs, lexicon(slim(docs, doc_id, text), band), ["own", "edited"]))
    after = s.select(F.col("key.key").alias("after_key"), F.col("own").alias("after"))
    s = s.withColumn("next_key", F.col("key.next_key")).join(after, F.col("next_key") == F.col("after_key"))
    return s.select(
        "key.doc_id",
        "key.n_chars",
        F.lower(F.hex("key.sha")).alias("edited_sha256"),
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
