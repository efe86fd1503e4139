"""Spelling variants: words one insertion, deletion or replacement apart, and the form each goes back to.

Words that are near share all but one third of their letters in place: whichever letter differs, the thirds before it are a
common beginning and those after it a common end. So each word is keyed by what is left without one third,
for its own length and for that of a word one letter shorter: six keys, and near words meet under at least one. Words
under neighbouring keys are put into slabs of a few thousand, and each slab has a bit-sliced position index: for every
(position, letter) a bitset over the slab's words. All words of a slab are looked up in it together. Letter by letter, a
word's bitset of candidates without an error and its three bitsets of candidates with one error (replaced here,
one letter more, one letter less: positions shifted by none, one, minus one) follow by a few word-parallel operations; candidate lengths
are bitsets too. Words whose key holds more than `slab` words are dealt to chunks, and each pair of chunks is a slab of its
own, so that no task holds more and no pair is lost.

Counting. Runs of letters are counted per task before anything is shuffled. The checksum of `<doc_id>:<run>` is a linear
map of the prefix's checksum, so it is computed for all occurrences at once from one checksum per document and one per word.

Null text has no words; a null doc_id is an empty prefix; repeated rows are documents of their own; an empty table gives no
rows; other columns are not read. Words of any length are handled whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import blocks, gc_rarely, written

RUN = "[A-Za-zÀ-ÿ]+"
SHIFTED = 64  # runs of up to so many bytes get their checksum from the table of shifts
SLAB = 4096
_LINK = "word string, near string, near_n long"


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def shifts(checksums: np.ndarray, most: int) -> np.ndarray:
    """(most + 1, n): each CRC-32 after 0 to `most` zero bytes. crc(a + b) is crc(b) xor crc(a) after len(b) of them."""
    table, out = _byte_table(), [checksums.astype(np.uint32)]
    for _ in range(most):
        out.append(table[out[-1] & np.uint32(255)] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


class _Ids(dict):
    def __missing__(self, word):
        self[word] = new = len(self)
        return new


def counts(docs: DataFrame, least: int = 6, modulus: int = 199, held: int = 400_000) -> DataFrame:
    """word, n: runs of at least `least` letters, one letter taken out of those whose checksum `modulus` divides.

    A task holds `held` different runs at a time, then passes their counts on.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc_rarely()
        find = re.compile(RUN).findall
        ids, total, misspelt = _Ids(), np.zeros(0, np.int64), {}
        known, checks, sizes = 0, np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            found = {w: n for w, n in zip(ids, total.tolist()) if n and len(w) >= least}
            for w, n in misspelt.items():
                if len(w) >= least:
                    found[w] = found.get(w, 0) + n
            return pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

        for block in blocks(batches):
            runs = [find((raw or b"").lower().decode()) for raw in block.column("raw").to_pylist()]
            prefixes = [f"{'' if d is None else d}:".encode() for d in block.column("doc_id").to_pylist()]
            tokens = np.concatenate([np.fromiter(map(ids.__getitem__, own), np.int64, len(own)) for own in runs])
            if len(ids) > known:
                raw = [w.encode() for w in list(ids)[known:]]
                checks = np.append(checks, np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)))
                sizes = np.append(sizes, np.fromiter(map(len, raw), np.int64, len(raw)))
                known = len(ids)
            total = np.append(total, np.zeros(known - len(total), np.int64)) + np.bincount(tokens, minlength=known)
            document = np.repeat(np.arange(len(runs)), [len(own) for own in runs])
            after = shifts(np.array([zlib.crc32(p) for p in prefixes], np.uint32), SHIFTED)
            h = after[np.minimum(sizes[tokens], SHIFTED), document] ^ checks[tokens]
            long = np.flatnonzero(sizes[tokens] > SHIFTED)
            if len(long) or (h % np.uint32(modulus) == 0).any():
                flat = [w for own in runs for w in own]
                for i in long.tolist():
                    h[i] = zlib.crc32(flat[i].encode(), zlib.crc32(prefixes[document[i]]))
                for i in np.flatnonzero(h % np.uint32(modulus) == 0).tolist():
                    word = flat[i]
                    at = int(h[i]) % len(word)
                    total[tokens[i]] -= 1
                    shorter = word[:at] + word[at + 1 :]
                    misspelt[shorter] = misspelt.get(shorter, 0) + 1
            if known > held:
                yield out()
                ids, total, misspelt = _Ids(), np.zeros(0, np.int64), {}
                known, checks, sizes = 0, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        yield out()

    found = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def keyed(words: DataFrame) -> DataFrame:
    """word, n -> word, n, base, key: six rows per word. base is the length of the shorter of two near words."""
    size = F.char_length("word")
    some = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("base"))
    some = some.filter("base > 0")
    cuts = [F.lit(0), F.floor(F.col("base") / 3).cast("int"), F.floor(F.col("base") * 2 / 3).cast("int"), F.col("base")]
    kept = []
    for third in range(3):
        tail = F.col("base") - cuts[third + 1]
        begin = F.substring(F.col("word"), F.lit(1), cuts[third])
        end = F.when(tail > 0, F.right("word", tail)).otherwise("")
        kept.append(F.concat(F.col("base").cast("string"), F.lit(f" {third} "), begin, F.lit(" "), end))
    return some.select("word", "n", "base", F.explode(F.array(*kept)).alias("key"))


def dealt(words: DataFrame, slab: int) -> DataFrame:
    """keyed rows with chunks i <= j: one row for a key of few words, else one for each other chunk of its key."""
    rows = keyed(words)
    large = rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > slab)
    chunks = F.ceil(F.col("size") * 2 / slab).cast("int")  # two chunks make a slab
    joined = rows.join(large, "key", "left").withColumn("chunks", F.coalesce(chunks, F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    pairs = joined.select("word", "n", "base", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return pairs.select("word", "n", "base", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


class PositionIndex:
    """Bitsets over words of length `base` and base + 1, by position and letter."""

    def __init__(self, words: list[str], base: int) -> None:
        self.base, self.n = base, len(words)
        size = np.array([len(w) for w in words])
        self.longer = size > base
        codes = np.zeros((self.n, base + 1), np.int64)  # 0: no letter there
        for longer in (False, True):
            at = np.flatnonzero(self.longer == longer)
            own = "".join(words[i] for i in at).encode("utf-32-le")
            codes[at, : base + longer] = np.frombuffer(own, np.uint32).reshape(len(at), base + longer)
        letters, codes = np.unique(codes, return_inverse=True)
        self.codes = codes.reshape(self.n, base + 1)
        width = -(-self.n // 64)
        place, bit = np.arange(self.n) // 64, np.uint64(1) << (np.arange(self.n) % 64).astype(np.uint64)
        self.bits = np.zeros((base + 1, len(letters), width), np.uint64)
        for p in range(base + 1):
            np.bitwise_or.at(self.bits[p], (self.codes[:, p], place), bit)
        self.of_length = np.zeros((2, width), np.uint64)
        np.bitwise_or.at(self.of_length, (self.longer.astype(int), place), bit)
        self.everyone = self.of_length[0] | self.of_length[1]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word, near word) by place: of length base with each other, and with base + 1 both ways."""
        shorter, longer = np.flatnonzero(~self.longer), np.flatnonzero(self.longer)
        found = []
        if len(shorter):
            none, replaced, inserted, _ = self._candidates(shorter, self.base)
            hits = (replaced & self.of_length[0]) | ((inserted | none) & self.of_length[1])
            found.append(self._places(shorter, hits))
            if len(longer):
                *_, deleted = self._candidates(longer, self.base + 1)
                found.append(self._places(longer, deleted & self.of_length[0]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))

    def _candidates(self, queries: np.ndarray, length: int) -> tuple:
        """Bitsets per query: equal so far; one letter replaced; the candidate has one more; it has one less."""
        none = np.broadcast_to(self.everyone, (len(queries), len(self.everyone))).copy()
        replaced, inserted, deleted = np.zeros_like(none), np.zeros_like(none), np.zeros_like(none)
        for j in range(length):
            letter = self.codes[queries, j]
            here = self.bits[j][letter]
            deleted = none | (deleted & self.bits[j - 1][letter]) if j else none.copy()
            inserted = (inserted | none) & self.bits[j + 1][letter] if j < self.base else np.zeros_like(none)
            replaced = (replaced & here) | (none & ~here)
            none &= here
        return none, replaced, inserted, deleted

    @staticmethod
    def _places(queries: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, place = np.nonzero(hits)
        bits = np.unpackbits(hits[row, place].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(bits)
        return queries[row[which]], place[which] * 64 + bit


def near_words(words: DataFrame, slab: int = SLAB) -> DataFrame:
    """word, n -> word, near, near_n: every ordered pair of words exactly one edit apart, once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for frame in batches:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if len(rest) >= 4 * slab:
                # the last group may go on in the next batch
                group = rest[["base", "key", "i", "j"]]
                last = int((group != group.iloc[-1]).any(axis=1).to_numpy().nonzero()[0].max(initial=-1)) + 1
                yield from _slabs(rest.iloc[:last], slab)
                rest = rest.iloc[last:]
        if rest is not None:
            yield from _slabs(rest, slab)

    order = ["base", "key", "i", "j"]
    ordered = dealt(words, slab).repartition("key", "i", "j").sortWithinPartitions(*order)
    return ordered.mapInPandas(run, _LINK).groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def _slabs(rows: pd.DataFrame, slab: int) -> Iterator[pd.DataFrame]:
    """Whole groups of equal base, about `slab` words at a time, looked up in their own index."""
    if not len(rows):
        return
    base, key = rows["base"].to_numpy(), rows["key"].to_numpy()
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    changes = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (base[1:] != base[:-1])]
    starts = np.append(np.flatnonzero(changes), len(rows))
    words, n = rows["word"].to_numpy(), rows["n"].to_numpy()
    first = 0
    while first < len(starts) - 1:
        last = first + 1
        while last < len(starts) - 1 and starts[last + 1] - starts[first] <= slab and base[starts[last]] == base[starts[first]]:
            last += 1
        own = slice(starts[first], starts[last])
        if last - first < starts[last] - starts[first]:  # else every word is alone under its key
            some, at = np.unique(words[own].astype(str).astype(object), return_index=True)
            count = n[own][at]
            word, near = PositionIndex(list(some), int(base[starts[first]])).near()
            yield pd.DataFrame({"word": some[word], "near": some[near], "near_n": count[near]})
        first = last


def roots(links: DataFrame) -> DataFrame:
    """word, form -> word, root: forms followed to the last, by doubling the way in every round."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, ratio: int = 5, modulus: int = 199, slab: int = SLAB) -> DataFrame:
    """doc_id, text -> word, n, n_near, form, form_n, root for every word of so many letters and occurrences.

    The form is the most frequent near word (the first in code-point order of several), if it is `ratio` times as
    frequent; the root is where forms lead, the word itself if it has none.
    """
    words = written(counts(docs, least_letters, modulus).filter(F.col("n") >= least_count), "words")
    near = near_words(words, slab).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best")
    )
    best = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    own = words.join(near, "word", "left").withColumn("best", best)
    judged = written(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")), "forms")
    rooted = roots(judged.filter("form IS NOT NULL"))
    return judged.join(rooted, "word", "left").withColumn("root", F.coalesce("root", "word"))
