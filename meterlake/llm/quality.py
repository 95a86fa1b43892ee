"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text
is cut into blocks, each block is compressed with either dictionary, and the
difference of the two total sizes over the text's own length says which side it
is more like. A logistic curve, fitted on labelled rows that no dictionary saw,
turns the difference into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slim

#: Bytes that are compressed together: short, so that a dictionary counts along the whole text.
BLOCK = 512


@dataclass(frozen=True)
class Model:
    """Dictionaries of the good and the bad side, and the curve's weights."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]


def _sizes(data: bytes, sides: list[zstandard.ZstdCompressor]) -> list[int]:
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in sides]


def _features(data: bytes, sides: list[zstandard.ZstdCompressor]) -> tuple[float, ...]:
    """A constant and the normalised size difference; 0 for an empty text."""
    good, bad = _sizes(data, sides) if data else (0, 0)
    return (1.0, (bad - good) / max(good, bad, 1))


def _sides(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    make = lambda d: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), write_content_size=False, write_checksum=False, write_dict_id=False)
    return [make(good), make(bad)]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; from too few texts to train on, the texts themselves."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, blocks)) // 8)), blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-size:] or b"\0" * 8


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of weighted rows by Newton steps with a little ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the identifier as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 6000, text_chars: int = 16384, dictionary_bytes: int = 32768) -> Model:
    """Fit on documents that have a label, 1 good or 0 bad, outside the held-out ones.

    A bounded sample is taken: of either label the ``sample // 2`` identifiers with
    the smallest hash, and of each text at most ``text_chars`` characters from a
    random place; so the driver gets at most ``sample`` pieces. Half of either side
    trains its dictionary, the other half fits the curve, where each side weighs as
    much as it does among all the rows that could be learnt; so the bound doesn't
    move the scores' level. Null labels and identifiers don't count. With a side
    missing the score is 0.5 throughout.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label")).where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.dropDuplicates().withColumn("key", F.xxhash64("id"))
    chosen = [known.where(F.col("label") == side).orderBy("key").limit(sample // 2) for side in (1, 0)]
    room = F.greatest(F.length("text") - text_chars + 1, F.lit(1))
    piece = F.substring("text", (F.pmod("key", room) + 1).cast("int"), F.lit(text_chars))
    rows = slim(docs, doc_id, text).join(F.broadcast(chosen[0].unionAll(chosen[1])), F.col("doc_id") == F.col("id"))
    rows = sorted((r.label, r.key, r.piece) for r in rows.select("label", "key", piece.alias("piece")).collect())
    halves = [[p.encode() for i, (at, _, p) in enumerate(rows) if at == side and i % 2 == odd] for side in (1, 0) for odd in (0, 1)]
    good, good_rest, bad, bad_rest = halves
    if not (good and bad and good_rest and bad_rest):
        return Model(b"\0" * 8, b"\0" * 8, (0.0, 0.0))
    model = Model(_dictionary(good, dictionary_bytes), _dictionary(bad, dictionary_bytes), ())
    sides = _sides(model.good, model.bad)
    x = np.array([_features(t, sides) for t in good_rest + bad_rest])
    y = np.r_[np.ones(len(good_rest)), np.zeros(len(bad_rest))]
    every = docs.select(F.col(doc_id).alias("doc_id")).join(known, F.col("doc_id") == F.col("id")).groupBy("label").count()
    count = {r.label: r["count"] for r in every.collect()}
    share = count[1] / (count[1] + count[0])
    weight = len(y) * np.where(y == 1, share / len(good_rest), (1 - share) / len(bad_rest))
    return Model(model.good, model.bad, _fit_curve(x, y, weight))


def scorer(model: Model):
    """The score of a text column: 0 to 1, higher for likelier good; a null text scores as an empty one, whose sizes don't differ."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sides, w = _sides(model.good, model.bad), np.array(model.curve)
        for texts in batches:
            x = np.array([_features((t or "").encode("utf-8", "surrogatepass"), sides) for t in texts]).reshape(-1, len(w))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return run


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row.

    Whole texts are compressed, in the task that read them; there is no shuffle.
    Repeated rows each get their row; an empty table gives none. Other columns are
    ignored.
    """
    return slim(docs, doc_id, text).select("doc_id", scorer(model)("text").alias("score"))


def keep(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows that score ``least`` or more, with all their columns."""
    return docs.where(scorer(model)(docs[text]) >= least)
