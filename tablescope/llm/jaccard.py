"""N-gram Jaccard self-join by signature trees.

1. A document is the set of its distinct word shingles, as 64-bit hashes. Documents with equal sets form a class.
2. Blocking: the minima of many bins of hashes, hashed in bands of 8. There are so many bands that a pair at the threshold
   shares none with a probability below 1e-9, and far below for closer pairs; two texts that only share a
   passage agree on 8 minima next to never, however many texts hold it.
3. Sets that share a band are tied, and components of these ties are blocks: partners are in one block. Each text is then
   sent to its block once.
4. In a block, a signature tree finds the links: nodes hold the OR of their sets' bitmaps, and their sizes' range; two nodes
   are left out if the largest possible overlap of a pair is too small, or if all their sets are in one component already.
   Blocks of more than `chunk` sets are cut into chunks by size; each pair of chunks that the same bounds
   allow is a task of its own, so no task grows with the block.
5. Found links (a forest per task) are joined into components.

Copies are combined before each shuffle: classes within a batch, and then by key.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.llm.common import blocks, components, gc_rarely, mix, signed, texts, written

CACHED = 600_000
FANOUT = 8
ROWS = 8
SENT = 400_000
_ONE = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
_TWO = np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Sets of word n-grams: words are what spaces and ASCII controls 9 to 13 separate; only A-Z are lower-cased."""

    def __init__(self, n: int) -> None:
        gc_rarely()
        self.n = n

    def hashes(self, text: str) -> np.ndarray:
        """Hash of each word."""
        return self.of_words(text.encode("utf-8", "surrogatepass").lower().split())

    @staticmethod
    def of_words(found: list[bytes]) -> np.ndarray:
        """Hashed anew each time: looking a word up among many takes longer, and memory."""
        return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct hashes; fewer than n words are one shingle, none are none."""
        words = self.hashes(text)
        n = min(self.n, len(words))
        if not n:
            return words
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix(out * _ONE + words[i : len(words) - n + 1 + i])
        return np.unique(out)


def class_of(shingles: np.ndarray) -> int:
    """One id per distinct set (64 bits, of two sums over its elements)."""
    total = int(mix(shingles * _TWO).sum(dtype=np.uint64)) + int(_ONE) * len(shingles)
    both = (total & _ALL) ^ int(np.bitwise_xor.reduce(mix(shingles ^ _TWO)))
    return int(signed(mix(np.array([both], np.uint64)))[0])


def bands_for(threshold: Fraction, rows: int, miss: float) -> int:
    """So many bands that a pair at the threshold shares none with a probability of `miss` at most."""
    return math.ceil(math.log(miss) / math.log1p(-float(threshold) ** rows))


@functools.lru_cache(maxsize=4)
def _tries(bins: int) -> np.ndarray:
    """Row f: at which try each bin hits bin f, if it hashes its own number again and again."""
    own, at = np.arange(bins), np.zeros((bins, bins), np.int32)
    left, attempt = bins * bins, 0
    while left:
        attempt += 1
        hit = _hit(own, attempt, bins)
        new = at[hit, own] == 0
        at[hit[new], own[new]] = attempt
        left -= int(new.sum())
    return at


def _hit(own: np.ndarray, attempt: int, bins: int) -> np.ndarray:
    return (mix(own.astype(np.uint64) * _ONE + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)


def signatures(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band, over `rows` minima: elements are dealt into bands * rows bins, each bin has its least.

    An empty bin takes the minimum of another, found by hashing its own number again and again. Where few bins
    are filled, the first hit is looked up; it is the same one.
    """
    bins = bands * rows
    keys = mix(shingles ^ _TWO)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (keys % np.uint64(bins)).astype(np.int64), mix(keys))
    filled = least != np.iinfo(np.uint64).max
    source = np.arange(bins)
    some, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
    if len(some) * 8 < bins:
        source[empty] = some[_tries(bins)[some].argmin(axis=0)][empty]
        empty = empty[:0]
    attempt = 1
    while len(empty):
        source[empty] = _hit(empty, attempt, bins)
        empty, attempt = empty[~filled[source[empty]]], attempt + 1
    minima = least[source].reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64) * _TWO
    for i in range(rows):
        out = mix(out * _ONE + minima[:, i])
    return out


def _least_per_key(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per key within a batch. The other ids are tied to the first by a key of the two, which they share."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.append(True, keys[1:] != keys[:-1])
    leader = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
    tied = ~first & (ids != leader)
    pairs = np.unique(np.stack([leader[tied], ids[tied]]), axis=1) if tied.any() else np.zeros((2, 0), np.int64)
    tie = signed(mix(pairs[0].view(np.uint64) * _ONE + mix(pairs[1].view(np.uint64) + _TWO)))
    return np.concatenate([keys[first], tie, tie]), np.concatenate([ids[first], pairs[0], pairs[1]])


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text, text_key -> doc_id, text_key, n_shingles, set_id (null without words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Shingler(n)
        for block in blocks(batches):
            sets = list(map(tool.shingles, texts(block)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": block.column("doc_id"),
                    "text_key": block.column("text_key"),
                    "n_shingles": pa.array(list(map(len, sets)), pa.int64()),
                    "set_id": pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "text_key").mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, set_id long")


def _signature_rows(docs: DataFrame, n: int, bands: int) -> DataFrame:
    """signature, set_id: combined within each task's batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen = Shingler(n), set()
        keys, ids, held = [], [], 0

        def out() -> pa.RecordBatch:
            k, i = _least_per_key(np.concatenate(keys), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(i)], names=["signature", "set_id"])

        for block in blocks(batches):
            for text in texts(block):
                shingles = tool.shingles(text)
                own = class_of(shingles) if len(shingles) else None
                if own is None or own in seen:
                    continue
                seen.add(own)
                keys.append(signed(signatures(shingles, bands, ROWS)))
                ids.append(np.full(len(keys[-1]), own, np.int64))
                held += len(keys[-1])
            if held > SENT:
                yield out()
                keys, ids, held = [], [], 0
                if len(seen) > CACHED:
                    seen.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "signature long, set_id long")


class Tree:
    """Sets in order of size and bitmap; each level joins FANOUT nodes of the level below."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        self.sets = sets
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        maps = np.zeros((len(sets), bits), bool)
        for i, s in enumerate(sets):
            maps[i, (s % np.uint64(bits)).astype(np.int64)] = True
        packed = np.packbits(maps, axis=1)
        filled = maps.sum(1)
        # level -> (bitmaps, least size, largest size, least bits set, largest surplus of size over bits)
        self.levels = [(packed, sizes, sizes, filled, sizes - filled)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, fill, over = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                    np.minimum.reduceat(fill, at), np.maximum.reduceat(over, at),
                )
            )

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][1])))


def _may_link(a: tuple, at: np.ndarray, b: tuple, bt: np.ndarray, t: Fraction) -> np.ndarray:
    """Can a set below node a link with one below node b? By sizes and by the largest possible overlap.

    A set's common elements fall into bits that both bitmaps have: at most those bits, and its
    elements beyond one per bit.
    """
    p, q = t.numerator, t.denominator
    common = np.bitwise_count(a[0][at] & b[0][bt]).sum(1, dtype=np.int64)
    most = np.minimum(
        np.minimum(a[2][at], common + a[4][at]), np.minimum(b[2][bt], common + b[4][bt])
    )
    least = a[1][at] + b[1][bt]
    # overlap / (sizes - overlap) >= p / q
    return (most * (p + q) >= p * least) & (q * a[2][at] >= p * b[1][bt]) & (q * b[2][bt] >= p * a[1][at])


def link_forest(left: list[np.ndarray], right: list[np.ndarray] | None, t: Fraction) -> list[tuple[int, int]]:
    """Links that join the sets' components: pairs of positions. `right` None: among `left`, else between the two.

    Positions of `right` follow those of `left`.
    """
    sets = left + (right or [])
    bits = 64
    while bits < 2 * np.median([len(s) for s in sets]) and bits < 1 << 16:
        bits *= 2
    trees = [Tree(x, bits) for x in ([left] if right is None else [left, right])]
    a, b = trees[0], trees[-1]
    shift = 0 if right is None else len(left)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    p, q = t.numerator, t.denominator
    found = []
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, na, lb, nb = stack.pop()
        if la == 0 and lb == 0:
            i, j = find(na), find(nb + shift)
            if i == j:
                continue
            x, y = a.sets[na], b.sets[nb]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both * q >= p * (len(x) + len(y) - both):
                found.append((na, nb + shift))
                root[max(i, j)] = min(i, j)
            continue
        if la == 1 and lb == 1 or (la <= 1 and lb <= 1):
            # bottom nodes whose sets are all in one component have nothing to add
            below = [find(int(c)) for c in (a.children(1, na) if la else [na])]
            below += [find(int(c) + shift) for c in (b.children(1, nb) if lb else [nb])]
            if len(set(below)) == 1:
                continue
        own = a.children(la, na) if la else np.array([na])
        other = b.children(lb, nb) if lb else np.array([nb])
        i, j = np.repeat(own, len(other)), np.tile(other, len(own))
        if right is None and max(la - 1, 0) == max(lb - 1, 0):
            once = i < j if la <= 1 else i <= j
            i, j = i[once], j[once]
        may = _may_link(a.levels[max(la - 1, 0)], i, b.levels[max(lb - 1, 0)], j, t)
        stack.extend((max(la - 1, 0), x, max(lb - 1, 0), y) for x, y in zip(i[may].tolist(), j[may].tolist()))
    return found


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def jaccard_components(
    docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10), chunk: int = 1500, miss: float = 1e-9
) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, set_id, component_id.

    component_id: smallest doc_id reachable by links, the document's own where it has no words. Null text has no
    words. Rows with equal doc_id are rows of their own; null ids take part, but name a component only if
    all its ids are null. An empty table gives no rows.
    """
    return keepers(docs, n, threshold, chunk, miss).drop("text_key", "keeper")


def keepers(
    docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10), chunk: int = 1500, miss: float = 1e-9
) -> DataFrame:
    """As `jaccard_components`, with text_key and keeper: the row of a component with the least doc_id, null last, and of

    these with the least text_key has doc_id component_id and text_key keeper. keeper is null without words.
    """
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    sets = written(document_sets(docs, n), "sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    # n_rows: how many rows repeat the id and text that stand for a class
    classes = (
        sets.filter("set_id IS NOT NULL").groupBy("set_id", "n_shingles", "doc_id", "text_key").agg(F.count("*").alias("n_rows"))
        .groupBy("set_id").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n_rows")).alias("x"), F.first("n_shingles").alias("n_shingles")
        )
        .select("set_id", "x.doc_id", "x.text_key", "x.n_rows", "n_shingles")
    )
    # one shuffle; a hot signature has one row per combined batch here
    same = W.partitionBy("signature")
    bands = bands_for(threshold, ROWS, miss)
    near = _signature_rows(docs, n, bands).withColumn("b", F.min("set_id").over(same))
    near = near.filter("set_id <> b").select(F.col("set_id").alias("a"), "b")
    block = written(components(near).toDF("set_id", "block"), "blocks")

    # the sets of each block, cut by size into chunks
    sized = block.join(classes, "set_id")
    count = sized.groupBy("block").agg(F.count("*").alias("members"))
    small = sized.join(count, "block")
    large = small.filter(F.col("members") > chunk)
    # borders between chunks: how many members are smaller, from counts per size (a size that alone fills chunks is cut by hash)
    per_size = large.groupBy("block", "n_shingles").agg(F.count("*").alias("_n"))
    order = W.partitionBy("block").orderBy("n_shingles").rowsBetween(W.unboundedPreceding, -1)
    per_size = per_size.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    cut = large.join(per_size, ["block", "n_shingles"]).withColumn(
        "part",
        F.floor(F.col("_before") / chunk) * 1_000_000
        + F.pmod(F.xxhash64("set_id"), F.greatest(F.lit(1), F.ceil(F.col("_n") / chunk)).cast("long")),
    )
    carried = ["set_id", "doc_id", "text_key", "n_rows", "n_shingles", "block"]
    placed = written(
        small.filter(F.col("members") <= chunk).select(*carried, F.lit(0).cast("long").alias("part"))
        .unionByName(cut.select(*carried, F.col("part").cast("long"))),
        "placed",
    )
    ranges = placed.groupBy("block", "part").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    p, q = threshold.numerator, threshold.denominator
    x, y = ranges.alias("x"), ranges.alias("y")
    tasks = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.part") <= F.col("y.part"))).filter(
        (F.col("x.high") * q >= F.col("y.low") * p) & (F.col("y.high") * q >= F.col("x.low") * p)
    )
    # members of the second chunk are marked; a chunk with itself is sent once
    first = tasks.select(F.col("x.block").alias("block"), F.col("x.part").alias("part"), F.lit(0).alias("side"), F.col("y.part").alias("other"))
    second = tasks.filter("x.part < y.part").select(
        F.col("y.block").alias("block"), F.col("y.part").alias("part"), F.lit(1).alias("side"), F.col("x.part").alias("other")
    )
    sent = placed.join(first.unionByName(second), ["block", "part"]).select(
        "set_id", "doc_id", "text_key", "n_rows", "block", "side", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    )
    # a text goes to a task once: rows that repeat one are combined first. Both joins read one shuffle of the texts.
    # Classes without any doc_id are fetched by their text alone
    unnamed = docs.filter("doc_id IS NULL").groupBy("text_key").agg(F.first("text").alias("text"))
    columns = ["set_id", "block", "i", "j", "side", "text"]
    single, several = (docs.join(sent.filter(w).hint("shuffle_hash"), ["doc_id", "text_key"]).select(columns) for w in ("n_rows = 1", "n_rows > 1"))
    payload = single.unionByName(several.distinct())
    payload = payload.unionByName(unnamed.join(sent.filter("doc_id IS NULL").hint("shuffle_hash"), "text_key").select(columns))
    t = threshold

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tool = Shingler(n)
        pdf = pdf.sort_values(["side", "set_id"])
        sides: list[list] = [[], []]
        ids: list[list[int]] = [[], []]
        for set_id, side, text in zip(pdf["set_id"], pdf["side"], pdf["text"]):
            shingles = tool.shingles(text or "")
            # another row may carry the same doc_id with the same text
            if len(shingles) and class_of(shingles) == set_id and set_id not in ids[side][-1:]:
                sides[side].append(shingles)
                ids[side].append(set_id)
        # trees join sets that lie together: by size, then by smallest hashes
        for s in (0, 1):
            by = sorted(range(len(ids[s])), key=lambda k: (len(sides[s][k]), sides[s][k][:4].tolist()))
            sides[s], ids[s] = [sides[s][k] for k in by], [ids[s][k] for k in by]
        two = bool((pdf["i"] != pdf["j"]).any())
        names = ids[0] + ids[1]
        links = link_forest(sides[0], sides[1] if two else None, t) if sides[0] and (sides[1] or not two) else []
        return pd.DataFrame({"a": [names[a] for a, _ in links], "b": [names[b] for _, b in links]}, dtype="int64")

    links = payload.groupBy("block", "i", "j").applyInPandas(run, "a long, b long")
    joined = components(links).toDF("set_id", "root")
    named = classes.join(joined, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    names = named.groupBy("root").agg(least.alias("x")).select("root", F.col("x.doc_id").alias("component_id"), F.col("x.text_key").alias("keeper"))
    known = named.select("set_id", "root").join(names, "root").select("set_id", "component_id", "keeper")
    return sets.join(known, "set_id", "left").select(
        "doc_id", "text_key", "n_shingles", "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "keeper"
    )
