"""Language identification by unigram models that sum over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary (the tokens of a rank file, up to
`max_piece` bytes, every single byte among them). A word's probability is the sum over all its
segmentations into pieces, by a forward algorithm; a text's is the product over its words. Words
are runs of letters, in lower case, each with a space before it.

Fitting is expectation maximisation (forward and backward) per language, on a bounded sample of labelled rows:
`fit_docs` documents of each language, the `fit_words` most frequent words of these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.llm.bpe import Ranks
from tablescope.llm.common import blocks, chunks, gc_rarely, texts

UNKNOWN = "und"
CACHED = 400_000
_LETTERS = regex.compile(r"\p{L}+").findall


def words(text: str) -> list[str]:
    return _LETTERS(text.lower())


class Lattice:
    """The vocabulary: per length, sorted codes of the pieces; piece 0 is none."""

    def __init__(self, pieces: Iterable[bytes], max_piece: int) -> None:
        own = sorted({p for p in pieces if len(p) <= max_piece} | {bytes([b]) for b in range(256)}, key=lambda p: (len(p), p))
        self.pieces = own
        self.codes, self.first = [], []
        for length in range(1, max_piece + 1):
            some = [int.from_bytes(p, "big") for p in own if len(p) == length]
            self.first.append(1 + sum(len(p) < length for p in own))
            self.codes.append(np.array(some, dtype=np.uint64))

    def ids(self, raw: np.ndarray) -> list[np.ndarray]:
        """raw: words of equal length, a row each. Per piece length, the id of the piece that starts at each place."""
        out, code = [], np.zeros(raw.shape, np.uint64)
        n = raw.shape[1]
        for length, (codes, first) in enumerate(zip(self.codes, self.first), 1):
            if length > n:
                break
            code = (code[:, : n - length + 1] << np.uint64(8)) | raw[:, length - 1 :]
            if not len(codes):
                out.append(np.zeros(code.shape, np.int64))
                continue
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            out.append(np.where(codes[at] == code, first + at, 0))
        return out


def _by_length(some: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, words as rows of bytes) for words of equal length."""
    lengths = np.fromiter(map(len, some), np.int64, len(some))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, 400_000 // (length * 8))
        for start in range(0, len(at), step):
            own = at[start : start + step]
            yield own, np.frombuffer(b"".join(some[i] for i in own), np.uint8).reshape(len(own), length)


def log_probability(lattice: Lattice, chance: np.ndarray, some: list[bytes]) -> np.ndarray:
    """Log of the sum over all segmentations, per word and language. chance: (pieces + 1, languages)."""
    out = np.empty((len(some), chance.shape[1]))
    for at, raw in _by_length(some):
        ids = lattice.ids(raw)
        last = [np.ones((len(at), chance.shape[1]))]  # probability of the prefixes before this place, latest first
        scale = np.zeros((len(at), chance.shape[1]))
        for end in range(1, raw.shape[1] + 1):
            now = 0
            for length, before in enumerate(last, 1):
                now = now + before * chance[ids[length - 1][:, end - length]]
            last = [now, *last][: len(lattice.codes)]
            if end % 24 == 0:
                scale += np.log(now)
                last = [x / now for x in last]
        out[at] = np.log(last[0]) + scale
    return out


def fit_language(lattice: Lattice, counts: dict[bytes, float], rounds: int, floor: float) -> np.ndarray:
    """Piece probabilities by expectation maximisation; words of more than 40 bytes are left to the others."""
    some = [w for w in counts if len(w) <= 40]
    weight = np.array([counts[w] for w in some])
    n = len(lattice.pieces) + 1
    size = np.array([1] + [len(p) for p in lattice.pieces])
    chance = np.where(np.arange(n) > 0, 256.0 ** -size, 0.0)
    chance = np.where(size > 1, 1.0 / n, chance)
    chance[0] = 0
    groups = [(at, lattice.ids(raw)) for at, raw in _by_length(some)]
    for _ in range(rounds):
        expected = np.zeros(n)
        for at, ids in groups:
            length = ids[0].shape[1]
            forward, backward = np.zeros((length + 1, len(at))), np.zeros((length + 1, len(at)))
            forward[0] = backward[length] = 1
            for end in range(1, length + 1):
                for k in range(1, min(end, len(ids)) + 1):
                    forward[end] += forward[end - k] * chance[ids[k - 1][:, end - k]]
            for start in range(length - 1, -1, -1):
                for k in range(1, min(length - start, len(ids)) + 1):
                    backward[start] += backward[start + k] * chance[ids[k - 1][:, start]]
            share = weight[at] / forward[length]
            for k in range(1, len(ids) + 1):
                part = ids[k - 1]
                used = forward[: length - k + 1].T * chance[part] * backward[k:].T * share[:, None]
                expected += np.bincount(part.ravel(), used.ravel(), n)
        expected[0] = 0
        chance = (expected + np.where(size == 1, floor, 0.0)) / (expected.sum() + 256 * floor)
        chance[0] = 0
    return chance


@dataclass
class Model:
    """Pieces that some language uses, their probabilities, and the languages."""

    languages: list[str]
    pieces: list[bytes]
    chance: np.ndarray
    max_piece: int


def fit(
    docs: DataFrame, vocabulary: str, fit_docs: int = 400, fit_words: int = 30_000, max_piece: int = 6, rounds: int = 4
) -> Model:
    """Fits all languages of `docs` (text, lang and a key column `_key` that picks the sample).

    The sample: the first `fit_docs` distinct rows (key, text) of each language, in order of their hashes; repeated rows are one.
    Rows whose lang or text is null teach nothing. The driver gets at most `fit_words` words per language.
    """
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.struct(F.xxhash64("_key"), F.xxhash64("text")).alias("_h"))
    first = W.partitionBy("lang").orderBy("_h")
    bound = (
        labelled.select("lang", "_h").distinct().withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= fit_docs)
        .groupBy("lang").agg(F.max("_h").alias("_bound"))
    ).collect()
    if not bound:
        return Model([], [], np.zeros((1, 0)), max_piece)
    upper = F.create_map(*(x for r in bound for x in (F.lit(r["lang"]), F.struct(*map(F.lit, r["_bound"])))))
    sample = labelled.filter(F.col("_h") <= upper[F.col("lang")]).distinct()
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counted = sample.select("lang", word.alias("word")).groupBy("lang", "word").count()
    often = W.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = counted.withColumn("_r", F.row_number().over(often)).filter(F.col("_r") <= fit_words).drop("_r").collect()
    languages = sorted({r["lang"] for r in bound})
    lattice = Lattice(Ranks(vocabulary).rank, max_piece)
    chances = []
    for language in languages:
        counts: Counter = Counter()
        for r in top:
            if r["lang"] == language:
                counts[b" " + r["word"].encode()] += r["count"]
        chances.append(fit_language(lattice, counts, rounds, floor=0.01))
    chance = np.stack(chances, axis=1)
    used = (chance[1:].max(1) > 1e-7) | np.array([len(p) == 1 for p in lattice.pieces])
    kept = [p for p, u in zip(lattice.pieces, used) if u]
    return Model(languages, kept, np.concatenate([chance[:1], chance[1:][used]]), max_piece)


class Scorer:
    """Log-probabilities of whole texts; words seen lately are remembered as rows of a table."""

    def __init__(self, model: Model) -> None:
        gc_rarely()
        self.model = model
        self.lattice = Lattice(model.pieces, model.max_piece)
        self.clear()

    def clear(self) -> None:
        self.parts: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.model.languages)), np.float32)
        self.size = 1  # row 0: no letter

    def _add(self, rows: np.ndarray) -> range:
        while self.size + len(rows) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.size : self.size + len(rows)] = rows
        self.size += len(rows)
        return range(self.size - len(rows), self.size)

    def _learn(self, unseen: set[str]) -> None:
        found = {p: [p.lower()] if p.isalpha() and p.isascii() else words(p) for p in unseen}
        new = list({w for own in found.values() for w in own}.difference(self.words))
        if new:
            scores = log_probability(self.lattice, self.model.chance, [b" " + w.encode() for w in new])
            self.words.update(zip(new, self._add(scores)))
        for p, own in found.items():
            if len(own) > 1:
                self.parts[p] = self._add(self.table[[self.words[w] for w in own]].sum(0, keepdims=True))[0]
            else:
                self.parts[p] = self.words[own[0]] if own else 0

    def score(self, some: list[str]) -> Iterator[tuple[str, float]]:
        if not self.model.languages:
            yield from ((UNKNOWN, 0.0) for _ in some)
            return
        cut = [chunks(t) for t in some]
        if self.size > CACHED or len(self.parts) > CACHED:
            self.clear()
        known = self.parts.__contains__
        self._learn({p for c in cut for p in filterfalse(known, c)})
        get = self.parts.__getitem__
        for c in cut:
            at = np.fromiter(map(get, c), np.int64, len(c))
            if not at.any():
                yield UNKNOWN, 0.0
                continue
            total = self.table[at].sum(0, dtype=np.float64)
            share = np.exp(total - total.max())
            best = int(np.argmax(total))
            yield self.model.languages[best], float(share[best] / share.sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to every row, from its text alone.

    Null text, and text without a letter, is `und` with score 0; so is every text if there was nothing to learn
    from. Ties go to the language that sorts first. Columns named lang_pred or score are replaced, all others stay.
    """
    columns = [f for f in docs.schema if f.name.lower() not in ("lang_pred", "score")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for block in blocks(batches):
            found = list(scorer.score(texts(block)))
            yield pa.RecordBatch.from_arrays(
                [*block.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*block.schema.names, "lang_pred", "score"],
            )

    schema = docs.select(*(f.name for f in columns)).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*(f.name for f in columns)).mapInArrow(run, schema)
