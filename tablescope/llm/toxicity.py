"""Toxicity by a linear classifier that is regularised with counterfactuals.

Features: the distinct lower-case words of a text. The loss is logistic, plus an L1 penalty (most words say
nothing), plus `swap_weight` times the mean squared change of the score when the identity terms of a labelled
text are swapped for others of their group. The last term takes weight off the mere mention of a group.

Fitting takes a bounded sample of labelled rows: `fit_docs` ids of each label, and one row of each id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.llm.common import blocks, chunks, gc_rarely, signed, texts

CACHED = 600_000
_WORDS = regex.compile(r"[\p{L}\p{N}]+").findall

#: Groups of identity terms; a term is swapped for the next of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrant", "native", "refugee", "foreigner"), ("immigrants", "natives", "refugees", "foreigners"),
    ("african", "american", "european", "mexican", "chinese", "indian", "arab"),
    ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("étrangers", "immigrés"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"), ("extranjeros", "inmigrantes"),
)


def swaps(groups: Iterable[tuple[str, ...]] = IDENTITY) -> dict[str, str]:
    return {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def feature(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


def _rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), list(map(len, lists))), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)


def train(
    features: list[np.ndarray],
    changes: list[tuple[np.ndarray, np.ndarray]],
    toxic: np.ndarray,
    min_docs: int,
    l1: float,
    swap_weight: float,
    rounds: int,
) -> Model:
    """features: word hashes per text; changes: per text, those that a swap takes away and those it adds."""
    n = len(features)
    if not n or toxic.min() == toxic.max():
        share = (toxic.sum() + 0.5) / (n + 1) if n else 0.5
        return Model({}, math.log(share / (1 - share)))
    seen, counts = np.unique(np.concatenate(features), return_counts=True)
    swapped = np.unique(np.concatenate([x for pair in changes for x in pair])) if changes else np.zeros(0, np.int64)
    vocabulary = np.unique(np.concatenate([seen[counts >= min_docs], np.intersect1d(swapped, seen)]))
    m = len(vocabulary)
    if not m:
        return train([], [], toxic, min_docs, l1, swap_weight, rounds)

    def known(hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(vocabulary, hashes), m - 1)
        return at[vocabulary[at] == hashes]

    row, col = _rows([known(f) for f in features])
    pairs = [(known(a), known(b)) for a, b in changes if len(a)]
    out_row, out_col = _rows([a for a, _ in pairs])
    in_row, in_col = _rows([b for _, b in pairs])
    k = len(pairs)
    # each class weighs half, so that a rare class is learnt as well
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (n - toxic.sum()))
    # the steepest curvature that a single step may meet
    each = np.bincount(row, minlength=n)
    step = 1.0 / (0.25 * float((weight * each).sum()) + 0.25 + (2 * swap_weight * (np.bincount(out_row).max() + np.bincount(in_row, minlength=1).max()) if k else 0))
    w, b, look, look_b, momentum = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(rounds):
        z = np.bincount(row, look[col], n) + look_b
        error = weight * (1 / (1 + np.exp(-z)) - toxic)
        slope = np.bincount(col, error[row], m)
        if k:
            change = (np.bincount(out_row, look[out_col], k) - np.bincount(in_row, look[in_col], k)) * (2 * swap_weight / k)
            slope += np.bincount(out_col, change[out_row], m) - np.bincount(in_col, change[in_row], m)
        after = look - step * slope
        after = np.sign(after) * np.maximum(np.abs(after) - step * l1, 0)
        after_b = look_b - step * error.sum()
        next_momentum = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / next_momentum
        look, look_b = after + pull * (after - w), after_b + pull * (after_b - b)
        w, b, momentum = after, after_b, next_momentum
    used = np.flatnonzero(w)
    # the penalty shrinks all weights; a scale and an offset of the whole score, fitted without it, undo that
    score = np.bincount(row, w[col], n)
    scale, offset = 1.0, b
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * score + offset, -30, 30)))
        g = weight * (p - toxic)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[(h * score**2).sum() + 1e-4, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-4]])
        move = np.linalg.solve(hessian, [(g * score).sum() + 1e-4 * scale, g.sum() + 1e-4 * offset])
        move = np.clip(move, -1, 1)
        scale, offset = scale - move[0], offset - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return Model({int(vocabulary[i]): float(w[i] * scale) for i in used}, float(offset))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    fit_docs: int = 6000,
    min_docs: int = 3,
    l1: float = 2e-3,
    swap_weight: float = 1.0,
    rounds: int = 300,
    groups: Iterable[tuple[str, ...]] = IDENTITY,
) -> Model:
    """doc_id, text and doc_id, toxic -> model. The join is on a bounded set of ids, so only their texts are shuffled.

    Of the rows of one doc_id the one whose text has the least hash teaches.
    Labels that are null or neither 0 nor 1 teach nothing; nor do labels without a document, or a null id.
    An id that is labelled more than once counts as toxic if one label says so.
    """
    swap = swaps(groups)
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    first = W.partitionBy("_toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= fit_docs).drop("_r")
    kind = "array<long>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes(some: Iterable[str]) -> np.ndarray:
            return signed(np.fromiter(map(feature, some), np.uint64))

        for block in blocks(batches):
            own = [set(words(t)) for t in texts(block)]
            named = [[w for w in some if w in swap] for some in own]
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": block.column("_toxic").cast(pa.int32()),
                    "features": pa.array(list(map(hashes, own)), pa.list_(pa.int64())),
                    "removed": pa.array([hashes(t) for t in named], pa.list_(pa.int64())),
                    "added": pa.array([hashes({swap[w] for w in t}) for t in named], pa.list_(pa.int64())),
                }
            )

    one = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    sample = (
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("_r", F.row_number().over(one)).filter("_r = 1")
        .select("_toxic", "text")
        .mapInArrow(run, f"toxic int, features {kind}, removed {kind}, added {kind}")
    ).toArrow()
    lists = [[np.asarray(v.values) for v in sample.column(c)] if sample.num_rows else [] for c in ("features", "removed", "added")]
    toxic = np.asarray(sample.column("toxic"), dtype=np.float64)
    return train(lists[0], list(zip(lists[1], lists[2])), toxic, min_docs, l1, swap_weight, rounds)


class Scorer:
    """Scores whole texts. The few words with a weight are looked up once per part of a text seen lately."""

    def __init__(self, model: Model) -> None:
        gc_rarely()
        self.weights = {int(np.int64(h)): w for h, w in model.weights.items()}
        self.bias = model.bias
        self.parts: dict[str, tuple] = {}

    def _found(self, part: str) -> tuple:
        own = [part.lower()] if part.isascii() and part.isalpha() else words(part)
        hashes = [h - (1 << 64) if h >> 63 else h for h in map(feature, own)]
        return tuple(h for h in hashes if h in self.weights)

    def score(self, some: list[str]) -> list[float]:
        cut = [chunks(t) for t in some]
        if len(self.parts) > CACHED:
            self.parts.clear()
        known = self.parts.__contains__
        self.parts.update((p, self._found(p)) for p in {p for c in cut for p in filterfalse(known, c)})
        get = self.parts.__getitem__
        out = []
        for c in cut:
            found = {h for own in filter(None, map(get, c)) for h in own}
            z = self.bias + math.fsum(map(self.weights.__getitem__, found))
            out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
        return out


def score(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """doc_id, text -> doc_id, score, predicted (1 from `least` on). Null text is empty; an empty text gets the bias."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for block in blocks(batches):
            found = scorer.score(texts(block))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": block.column("doc_id"),
                    "score": pa.array(found, pa.float64()),
                    "predicted": pa.array([int(s >= least) for s in found], pa.int32()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
