"""Passages that repeat across documents, by a sparse suffix array.

Of each text only the suffixes at minimiser positions are kept: places whose k-gram hash is the least of `window` in a row,
so two texts that share a passage keep the same places in it. With passages of at least `min_words` words, such
suffixes share `min_words - window + 1` words at least. So:

1. Kept suffixes are grouped by a 64-bit hash of that many leading words; those that no other text has drop out.
2. Texts with kept suffixes left are read once more. All windows of `min_words` words that begin up to `window - 1` words before such
   a suffix are hashed and grouped again; that takes the place of extending each match to the left and to the right.
   A window that another text holds too is repeated; overlapping windows make up a passage. So the result is exact, up to collisions of hashes.

Of each repeated window the occurrences in the document with the least doc_id are first, and of those with that id in the text with the least hash. Equal texts are one text here; their
further documents are copies as a whole. Before each shuffle a batch keeps one row per hash; what
it knows to be repeated travels apart from the hot key, salted by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.llm.common import blocks, mix, numbered, signed, texts, written
from tablescope.llm.jaccard import Shingler

SENT = 400_000
SALTS = 997
LAST = (1 << 63) - 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Sequences(Shingler):
    """Hashes of runs of words, case and all."""

    def __init__(self) -> None:
        super().__init__(1)

    def hashes(self, text: str) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").split()
        return self.of_words(found)

    @staticmethod
    def runs(words: np.ndarray, n: int) -> np.ndarray:
        """Hash of each run of n words, by doubling."""
        if len(words) < n:
            return np.zeros(0, np.uint64)
        size, hashes, done, out = 1, mix(words * _BASE), 0, None
        rest = n
        while True:
            if rest & size:
                part = hashes[done : done + len(words) - n + 1]
                out = part if out is None else mix(out * _BASE + part)
                done += size
            if size * 2 > rest:
                return out if out is not None else hashes
            hashes = mix(hashes[:-size] * _BASE + hashes[size:])
            size *= 2


def kept_suffixes(words: np.ndarray, k: int, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser positions that `length` words follow, and the hashes of these words."""
    grams = Sequences.runs(words, k)
    if len(words) < length or len(grams) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    at = np.unique(np.arange(len(views)) + views.argmin(axis=1))
    at = at[at + length <= len(words)]
    return at, Sequences.runs(words, length)[at]


def _suffix_rows(docs: DataFrame, k: int, window: int, length: int) -> DataFrame:
    """hash, salt, text_id, shared (known to be, within the batch)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Sequences()
        hashes, ids, held, seen = [], [], 0, set()

        def out() -> pa.RecordBatch:
            h, t = np.concatenate(hashes), np.concatenate(ids)
            order = np.lexsort((t, h))
            h, t = h[order], t[order]
            once = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))
            h, t = h[once], t[once]
            first = np.append(True, h[1:] != h[:-1])
            shared = ~first
            shared[:-1] |= ~first[1:]
            salt = np.where(first, 0, 1 + (mix(t.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64))
            return pa.RecordBatch.from_pydict({"hash": signed(h), "salt": salt.astype(np.int32), "text_id": t, "shared": shared})

        for block in blocks(batches):
            for text, text_id in zip(texts(block), block.column("text_id").to_pylist()):
                if text_id in seen:
                    continue
                seen.add(text_id)
                _, found = kept_suffixes(tool.hashes(text), k, window, length)
                hashes.append(found)
                ids.append(np.full(len(found), text_id, np.int64))
                held += len(found)
            if held > SENT:
                yield out()
                hashes, ids, held = [], [], 0
                if len(seen) > SENT:
                    seen.clear()
        if held:
            yield out()

    return docs.select("text", "text_id").mapInArrow(run, "hash long, salt int, text_id long, shared boolean")


def _window_rows(payload: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """payload: text_id, doc_id (that stands for the text), text, hashes. One row per window that may repeat."""
    length = min_words - window + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Sequences()
        parts: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            h, t, d, at, start, end = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((t, d, h))
            h, t, d, at, start, end = (c[order] for c in (h, t, d, at, start, end))
            border = np.append(True, h[1:] != h[:-1])
            leader = np.maximum.accumulate(np.where(border, np.arange(len(h)), 0))
            own = t == t[leader]  # occurrences in the batch's first text
            last = np.append(np.flatnonzero(border)[1:], len(h)) - 1
            final = np.repeat(last, np.diff(np.append(np.flatnonzero(border), len(h))))
            # another document that holds the window, as far as the batch knows
            other = np.where(own, np.where(t[final] != t, d[final], -1), d[leader])
            known = np.where(own, t[final] != t, True)
            salt = np.where(own, 0, 1 + (mix(t.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64))
            return pa.RecordBatch.from_pydict(
                {
                    "hash": signed(h), "salt": salt.astype(np.int32), "text_id": t, "doc_id": d, "at": at.astype(np.int32),
                    "start": start.astype(np.int32), "end": end.astype(np.int32), "other": pa.array(other, mask=~known),
                }
            )

        for block in blocks(batches):
            rows = (block.column(c).to_pylist() for c in ("text_id", "doc_id", "text", "hashes"))
            for text_id, doc_id, text, wanted in zip(*rows):
                words = tool.hashes(text)
                at, found = kept_suffixes(words, k, window, length)
                at = at[np.isin(signed(found), np.array(wanted, np.int64))]
                last = len(words) - min_words
                if not len(at) or last < 0:
                    continue
                # a window begins at most window - 1 words before its suffix
                marks = np.zeros(len(words) + 2, np.int64)
                np.add.at(marks, np.maximum(at - window + 1, 0), 1)
                np.add.at(marks, at + 1, -1)
                at = np.flatnonzero(np.cumsum(marks)[: last + 1] > 0)
                if not len(at):
                    continue
                spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
                n = len(at)
                parts.append((
                    Sequences.runs(words, min_words)[at], np.full(n, text_id, np.int64), np.full(n, doc_id, np.int64), at,
                    spans[at, 0], spans[at + min_words - 1, 1],
                ))
                held += n
            if held > SENT:
                yield out()
                parts.clear()
                held = 0
        if held:
            yield out()

    return payload.mapInArrow(
        run, "hash long, salt int, text_id long, doc_id long, at int, start int, end int, other long"
    )


def repeated_passages(docs: DataFrame, min_words: int = 50, k: int = 8, window: int = 16) -> tuple[DataFrame, DataFrame]:
    """(passages, documents).

    passages: text_id, doc_id, start, end (code points), n_words, is_first, other_doc_id - per text; the runs of
    windows that are first, and those that are not. documents: doc_id, text_id, n_chars, n_words, leader (doc_id that stands
    for the text), copies. Words are separated by spaces and ASCII controls 9 to 13. Null text is empty: no passage.
    Rows equal in doc_id and text count as one document; a null doc_id stands behind all others.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"))
    length = min_words - window + 1
    documents = written(
        keyed.groupBy("doc_id", "text_id").agg(
            F.first(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"),
            F.first(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).alias("n_words"),
        ),
        "documents",
    )
    leaders = documents.groupBy("text_id").agg(
        F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("leader"), F.max("doc_id").alias("_last"), F.count("*").alias("copies")
    )
    same = W.partitionBy("hash", "salt")
    rows = _suffix_rows(keyed, k, window, length)
    rows = rows.withColumn("_a", F.min("text_id").over(same)).withColumn("_b", F.max("text_id").over(same))
    wanted = rows.filter("shared OR _a <> _b").groupBy("text_id").agg(F.collect_set("hash").alias("hashes"))
    wanted = wanted.join(leaders, "text_id").select("text_id", "leader", "hashes")
    payload = keyed.join(wanted.hint("shuffle_hash"), "text_id").filter(F.coalesce("doc_id", F.lit(LAST)) == F.col("leader"))
    payload = payload.select("text_id", F.col("leader").alias("doc_id"), "text", "hashes")
    windows = _window_rows(payload, k, window, min_words)
    windows = (
        windows.withColumn("_a", F.min("text_id").over(same)).withColumn("_b", F.max("text_id").over(same))
        .withColumn("_first", F.min(F.struct("doc_id", "text_id")).over(same)).withColumn("_last", F.max("doc_id").over(same))
        .filter("other IS NOT NULL OR _a <> _b")
        .withColumn("is_first", (F.col("salt") == 0) & (F.struct("doc_id", "text_id") == F.col("_first")))
        .withColumn("other", F.when(F.struct("doc_id", "text_id") != F.col("_first"), F.col("_first.doc_id")).otherwise(F.coalesce("other", "_last")))
        .select("text_id", "doc_id", "at", "start", "end", "is_first", "other")
    )
    order = W.partitionBy("text_id", "doc_id", "is_first").orderBy("at")
    runs = windows.withColumn("_new", (F.col("at") - F.lag("at", 1, -min_words - 1).over(order) > min_words).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    passages = runs.groupBy("text_id", "doc_id", "is_first", "_run").agg(
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        (F.max("at") - F.min("at") + min_words).cast("long").alias("n_words"),
        F.min("other").alias("other_doc_id"),
    )
    return passages.drop("_run"), documents.join(leaders, "text_id")


def repeats(docs: DataFrame, min_words: int = 50, k: int = 8, window: int = 16) -> DataFrame:
    """One row per repeated passage of a document: doc_id, start, end, n_words, is_first, other_doc_id.

    A copy of a whole text of at least `min_words` words is one passage; so is, as first, the text that it copies.
    """
    passages, documents = repeated_passages(docs, min_words, k, window)
    copied = documents.filter((F.col("copies") > 1) & (F.col("n_words") >= min_words))
    whole = copied.select(
        "doc_id",
        F.lit(0).cast("long").alias("start"),
        F.col("n_chars").cast("long").alias("end"),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("doc_id").eqNullSafe(F.col("leader")).alias("is_first"),
        F.when(F.col("doc_id").eqNullSafe(F.col("leader")), F.col("_last")).otherwise(F.col("leader")).alias("other_doc_id"),
    )
    # a text that is copied is a first passage as a whole, so its first parts need no rows of their own
    parts = passages.join(copied.select("text_id").distinct().withColumn("_copied", F.lit(True)), "text_id", "left")
    parts = parts.filter("NOT (is_first AND coalesce(_copied, false))")
    named = parts.withColumn("doc_id", F.expr(f"nullif(doc_id, {LAST}L)")).withColumn("other_doc_id", F.expr(f"nullif(other_doc_id, {LAST}L)"))
    return named.select(*whole.columns).unionByName(whole)


def cut_repeats(docs: DataFrame, min_words: int = 50, k: int = 8, window: int = 16) -> DataFrame:
    """The rows of `docs` without the passages that an earlier document holds.

    Copies of a whole text and documents of which no word is left go; other columns stay as they are, whatever their names.
    """
    passages, documents = repeated_passages(docs, min_words, k, window)
    spans = passages.filter("NOT is_first").groupBy("text_id").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    copies = documents.filter((F.col("copies") > 1) & (F.col("n_words") >= min_words) & ~F.coalesce("doc_id", F.lit(LAST)).eqNullSafe(F.col("leader")))
    changed = written(
        spans.join(copies.groupBy("text_id").agg(F.first("leader").alias("_leader")), "text_id", "full")
        .withColumnRenamed("text_id", "_text_id"),
        "spans",
    )
    schema = docs.schema
    rows, names = numbered(docs)
    keyed = rows.withColumn("_text_id", F.xxhash64(F.coalesce(names["text"], F.lit(""))))
    joined = keyed.join(changed.hint("shuffle_hash"), "_text_id", "left").filter(
        F.col("_leader").isNull() | (F.coalesce(names["doc_id"], F.lit(LAST)) == F.col("_leader"))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out, keep = [], []
            for text, spans in zip(block.column(names["text"]).to_pylist(), block.column("_spans").to_pylist()):
                if spans and text:
                    left, at = [], 0
                    for start, end in sorted((s["start"], s["end"]) for s in spans):
                        left.append(text[at:start] if start > at else "")
                        at = max(at, end)
                    text = "".join(left) + text[at:]
                    keep.append(bool(text.strip()))
                else:
                    keep.append(True)
                out.append(text)
            columns = [pa.array(out, pa.string()) if c == "text" else block.column(n) for c, n in names.items()]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, schema)
