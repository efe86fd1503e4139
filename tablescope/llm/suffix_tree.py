"""Language-model scoring by a probabilistic suffix tree over words.

A node is a context: the last words before a symbol, up to `depth` of them, the start of a document being a
word of its own. Symbols are words (A-Z lower-cased, split at ASCII white space) and one end per document. The root
gives p(x) = (c(x) + 1) / (N + V + 1). A context s whose parent (s without its oldest word) is in the tree and
that was seen n(s) >= `min_count` times in training is retained by a divergence test,

    sum over its T(s) followers x of  c(sx) * ln(c(sx) / n(s)) - (c(sx) - 1) * ln p(x | parent)  >=  gain:

the likelihood won over the parent, less the cost of naming each follower once, so that followers seen once
prove nothing. Its distribution is smoothed with the parent's, p(x | s) = (c(sx) + T(s) p(x | parent)) / (n(s) + T(s)),
and sums to one over the known words and one unknown. A symbol is scored in its longest retained context.

How it runs. Documents are tokenised once into blocks of about `block_tokens`, one row each of a table bucketed by
block. In each of 2 * depth rounds a block asks for sums over the corpus, one per distinct key that it
holds (a word, an n-gram, a context): sorted keys go to buckets by their first bits, are merged there and answered in the
order asked. So what is shuffled is a few bytes per distinct n-gram and block, grows with the corpus, and a frequent
word is one key per block. A test is a sum over occurrences, which each block rounds to 1 / GRAIN, and T(s) a sum over the
blocks that saw a follower first, so no context's followers ever meet in one task. Nothing is capped.

Words and n-grams are told apart by 64 bits of hash: equal hashes would share a count, nothing else.

Null text is empty, an end alone; null and repeated ids are documents of their own; an empty table gives no rows; other
columns are not read. Without any training token every probability is 1.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import blocks, gc_rarely, mix, shared_folder

START = np.uint64(0xA5A5A5A5A5A5A5A5)
#: Parts of a nat in which blocks round their share of a test.
GRAIN = 256
_ASKED = "kind string, bucket int, block long, data binary"
_ANSWERED = "kind string, bucket int, block long, known long, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, their byte planes one after the other, as sorted keys and small counts compress that way."""
    planes = [(a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, protocol=5))


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel())
    return out


def narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


class _Ids(dict):
    def __missing__(self, word):
        self[word] = new = len(self)
        return new


def tokenised(docs: DataFrame, held: Column, block_tokens: int) -> DataFrame:
    """Blocks of documents: (block, train_tokens, train_docs, ids, data); data packs words, tokens, lengths and held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc_rarely()
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        words, ids, tokens, flags, size = _Ids(), [], [], [], 0

        def out() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
            own = np.array(flags, bool)
            data = pack(hashes, np.concatenate(tokens), lengths, own)
            row = [number, int(lengths[~own].sum()), int((~own).sum()), pickle.dumps(ids), data]
            return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(["block", "train_tokens", "train_docs", "ids", "data"], row)})

        for batch in blocks(batches):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), batch.column("held").to_pylist())
            for doc_id, raw, is_held in rows:
                some = (raw or b"").lower().split()
                some.append(b"")  # the end: no word is empty
                tokens.append(np.fromiter(map(words.__getitem__, some), np.int32, len(some)))
                ids.append(doc_id)
                flags.append(is_held)
                size += len(some)
                if size >= block_tokens:
                    yield out()
                    number += 1
                    words, ids, tokens, flags, size = _Ids(), [], [], [], 0
        if ids:
            yield out()

    picked = docs.select("doc_id", F.col("text").cast("binary").alias("raw"), held.alias("held"))
    return picked.mapInArrow(run, "block long, train_tokens long, train_docs long, ids binary, data binary")


class Walk:
    """One block's way down the tree, as far as the answers go: `asks` are its next questions, or `chance` is complete.

    Words and n-grams have ids within the block, and a hash per id, their name to the corpus.
    """

    def __init__(self, data: bytes, answers: dict[str, np.ndarray], totals: tuple, depth: int, min_count: int) -> None:
        self.answers, self.asks, self.complete = answers, {}, False
        names, tokens, self.lengths, self.held = unpack(data)
        train = np.repeat(~self.held, self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        word = names[tokens]
        context, names = self._shifted(tokens, len(names)), np.append(names, START)
        count = self._told("words", names[:-1], [np.bincount(tokens[train], minlength=len(names) - 1)])
        ids, grams = self._distinct(1, names[context], word)
        if count is None:  # pairs can be asked for at once
            self._told("grams1", grams, [np.bincount(ids[train], minlength=len(grams))])
            return
        n, v, train_docs = totals
        self.count = count[tokens]
        self.chance = self.root = (self.count + 1.0) / (n + v + 1.0)
        seen = np.append(count, train_docs)  # by context
        at = np.flatnonzero(seen[context] >= min_count)
        for level in range(1, depth + 1):
            if level == 1:  # pairs were asked for before it was known which contexts are frequent
                found, by_token = self._told("grams1", grams, []), ids
                context, ids = context[at], ids[at]
            else:
                ids, grams = self._distinct(level, names[context], word[at])
                found = self._told(f"grams{level}", grams, [np.bincount(ids[train[at]], minlength=len(grams))])
                by_token = np.full(len(word), -1)
                by_token[at] = ids
            if found is None:
                return
            found, mine = found >> 1, found & 1
            c, n_s, p, learnt = found[ids], seen[context], self.chance[at], train[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                won = np.where(learnt, np.log(c / n_s) - (1 - 1 / c) * np.log(p), 0.0)
            here = np.flatnonzero(np.bincount(context, minlength=len(names)))
            follows = np.zeros(len(grams), np.int64)
            follows[ids] = context
            eligible = np.bincount(ids, minlength=len(grams)) > 0
            followers = np.bincount(follows, mine * eligible, len(names))
            sums = [followers[here].astype(np.int64), np.rint(np.bincount(context, won, len(names))[here] * GRAIN).astype(np.int32)]
            retained = self._told(f"tests{level}", names[here], sums)
            if retained is None:
                return
            t = np.zeros(len(names), np.int64)
            t[here] = retained  # followers of a retained context, 0 of others
            t = t[context]
            in_kept = t > 0
            own, t = at[in_kept], t[in_kept]
            self.chance = self.chance.copy()
            self.chance[own] = (c[in_kept] + t * p[in_kept]) / (n_s[in_kept] + t)
            # the context one word longer is the n-gram that ends before the symbol
            names, seen = grams, found
            before = by_token[own - 1]
            longer = (before >= 0) & ~np.isin(own, self.first)
            longer[longer] = seen[before[longer]] >= min_count
            at, context = own[longer], before[longer]
        self.complete = True

    def _shifted(self, values: np.ndarray, at_start) -> np.ndarray:
        """The value at the symbol before."""
        out = np.roll(values, 1)
        out[self.first] = at_start
        return out

    def _distinct(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the n-grams, and their names in ascending order."""
        names, ids = np.unique(mix(context * np.uint64(0x9E3779B97F4A7C15) ^ word ^ np.uint64(level)), return_inverse=True)
        return ids, names

    def _told(self, kind: str, names: np.ndarray, values: list[np.ndarray]) -> np.ndarray | None:
        """The corpus's answers by id, or None if they are not known yet: then they are asked for."""
        if not len(names):
            return np.zeros(0, np.int64)
        order = np.argsort(names)
        if kind not in self.answers:
            self.asks[kind] = names[order], [narrow(v[order]) if v.dtype != np.int32 else v[order] for v in values]
            return None
        out = np.empty(len(names), np.int64)
        out[order] = self.answers[kind]
        return out

    def scored(self, ids: list) -> dict[str, list | np.ndarray]:
        def by_document(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, self.first)

        return {
            "doc_id": pd.Series(ids, dtype=object),
            "held_out": self.held,
            "n_tokens": self.lengths,
            "n_known": by_document((self.count > 0).astype(np.int64)),
            "base_score": by_document(np.log10(self.root)),
            "score": by_document(np.log10(self.chance)),
        }


def _questions(walk: Walk, block: int, buckets: int) -> pd.DataFrame:
    rows = []
    for kind, (keys, values) in walk.asks.items():
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[b], cuts[b + 1])
            rows.append((kind, b, block, pack(keys[own], *[v[own] for v in values])))
    return pd.DataFrame(rows, columns=["kind", "bucket", "block", "data"])


def merged(asked: pd.DataFrame, gain: float) -> pd.DataFrame:
    """What one bucket's keys come to, back to each block in its own order. `known` is the number of keys above zero, on one row.

    Words: counts. N-grams: counts, doubled, and one more for the first block that saw the n-gram in
    training, which counts it as a follower. Tests: the number of followers of contexts that pass, 0 for others.
    """
    asked = asked.sort_values("block")
    parts = [unpack(d) for d in asked["data"]]
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    ends = np.cumsum([len(p[0]) for p in parts])[:-1]
    values = [np.concatenate(v) for v in zip(*[p[1:] for p in parts])]
    total, *won = [np.bincount(back, v, len(keys)).astype(np.int64) for v in values]
    known = int((total > 0).sum())
    if won:
        total[won[0] < gain * GRAIN] = 0
    answer = total[back]
    if asked["kind"].iloc[0].startswith("grams"):
        seen = np.flatnonzero(values[0])
        _, first = np.unique(back[seen], return_index=True)
        answer *= 2
        answer[seen[first]] += 1
    out = asked[["kind", "bucket", "block"]].copy()
    out["known"] = [known] + [0] * (len(parts) - 1)
    out["data"] = [pack(narrow(a)) for a in np.split(answer, ends)]
    return out


def _answers(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    return {k: np.concatenate([unpack(d)[0] for d in own["data"]]) for k, own in rows.sort_values("bucket").groupby("kind")}


def score(
    docs: DataFrame, held: Column, depth: int = 2, min_count: int = 16, gain: float = 10.0, block_tokens: int = 1_500_000
) -> DataFrame:
    """doc_id, text -> per document n_tokens, n_known, train_tokens, base_score and score (log10), learnt where not `held`."""
    spark = docs.sparkSession
    name = f"suffix_tree_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def kept(rows: DataFrame, table: str) -> None:
        """Appended to a table bucketed by block, so that answers lie with their blocks and neither is shuffled again."""
        out = rows.write.mode("append").bucketBy(parts, "block").format("parquet")
        out.option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)

    kept(tokenised(docs, held, block_tokens), name)
    state = spark.read.table(name)
    n, train_docs, n_blocks = state.agg(F.sum("train_tokens"), F.sum("train_docs"), F.count("*")).first()
    totals = (n or 0, 0, train_docs or 0)
    buckets = max(parts, n_blocks // 2)

    def walked(data: bytes, known: dict) -> Walk:
        return Walk(data, known, totals, depth, min_count)

    def ask_first(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, data in zip(frame["block"], frame["data"]):
                yield _questions(walked(data, {}), block, buckets)

    def ask_next(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return _questions(walked(own["data"][0], _answers(known)), own["block"][0], buckets)

    def finish(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        walk = walked(own["data"][0], _answers(known))
        assert walk.complete
        return pd.DataFrame(walk.scored(pickle.loads(own["ids"][0])))

    def together(function, schema: str, columns: list[str]) -> DataFrame:
        known = spark.read.table(f"{name}_answers")
        return state.select("block", *columns).groupBy("block").cogroup(known.groupBy("block")).applyInPandas(function, schema)

    for turn in range(2 * depth):
        asked = together(ask_next, _ASKED, ["data"]) if turn else state.select("block", "data").mapInPandas(ask_first, _ASKED)
        new = asked.groupBy("kind", "bucket").applyInPandas(lambda own: merged(own, gain), _ANSWERED).repartition(parts, "block")
        kept(new, f"{name}_answers")
        if not turn:
            known = spark.read.table(f"{name}_answers").filter("kind = 'words'").agg(F.sum("known")).first()[0] or 0
            totals = (totals[0], known, totals[2])
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return together(finish, schema, ["ids", "data"]).withColumn("train_tokens", F.lit(totals[0]).cast("long"))
