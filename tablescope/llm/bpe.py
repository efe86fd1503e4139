"""Byte-level BPE by a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its byte (and the byte's position, so that the
leftmost of equal ranks is smallest); a node holds the smaller of its two children. The root therefore
names the next merge. A merge changes at most three leaves - the pair itself, its live left neighbour,
and the position that dies - and each change is a point update up the tree: logarithmic in the length.

Short pieces are merged many at a time, one tree per row of a numpy array; long ones one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablescope.llm.common import Parts, blocks, remembered, texts

NONE = np.iinfo(np.int64).max
SHORT = 64
CACHED = 600_000
GROUP = 8192


class Ranks:
    """A rank file: bytes -> rank, and the rank of each pair of tokens that merges."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        found = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    found[a << 20 | b] = rank
        self.pair = found
        self.keys = np.array(sorted(found), dtype=np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], dtype=np.int64)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge (or right is -1: nothing follows)."""
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (right >= 0) & (left >= 0), self.values[at], NONE)


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """One piece, one tree; O(n log n)."""
    n = len(piece)
    size = 1 << max(0, n - 1).bit_length()
    none = (1 << 62, 0)
    ids = [int(ranks.byte[b]) for b in piece]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    tree = [none] * (2 * size)

    def leaf(at: int):
        rank = ranks.pair.get(ids[at] << 20 | ids[after[at]]) if after[at] < n else None
        return none if rank is None else (rank, at)

    def update(at: int, value) -> None:
        at += size
        tree[at] = value
        while at > 1:
            at >>= 1
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    for at in range(n):
        tree[size + at] = leaf(at)
    for at in range(size - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    while tree[1] is not none and tree[1][0] < none[0]:
        rank, at = tree[1]
        gone = after[at]
        ids[at] = rank
        after[at] = after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        update(gone, none)
        update(at, leaf(at))
        if before[at] >= 0:
            update(before[at], leaf(before[at]))
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = after[at]
    return out


def merge_short(pieces: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Pieces of at most SHORT bytes: one tree per row, merged in step."""
    longest = max(map(len, pieces))
    size = 1 << max(1, (longest - 1).bit_length())
    shift = size.bit_length()
    n, rows = len(pieces), np.arange(len(pieces))
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
    place = np.arange(size)
    ids = np.where(place < lengths[:, None], ranks.byte[raw], -1)
    # one column more on each side: position -1 is the last column, and nothing follows `size`
    ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)
    after = np.minimum(np.tile(place + 1, (n, 1)), lengths[:, None])
    after = np.where(after >= lengths[:, None], size, after)
    before = np.tile(np.append(place - 1, -1), (n, 1))
    before[:, 0] = -1
    tree = np.full((n, 2 * size), NONE)
    first = ranks.of_pairs(ids[:, :size], np.take_along_axis(ids, after, 1))
    tree[:, size:] = np.where(first == NONE, NONE, first << shift | place)
    for at in range(size - 1, 0, -1):
        tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])
    live = rows
    while True:
        live = live[tree[live, 1] != NONE]
        if not len(live):
            break
        top = tree[live, 1]
        at, rank = top & ((1 << shift) - 1), top >> shift
        gone = after[live, at]
        follows = after[live, gone]
        ids[live, at] = rank
        ids[live, gone] = -1
        after[live, at] = follows
        before[live, follows] = at
        left = before[live, at]
        now = ranks.of_pairs(rank, ids[live, follows])
        was = ranks.of_pairs(np.where(left >= 0, ids[live, left], -1), rank)
        keep = np.maximum(left, 0)
        tree[live, size + gone] = NONE
        tree[live, size + keep] = np.where(left >= 0, np.where(was == NONE, NONE, was << shift | keep), tree[live, size + keep])
        tree[live, size + at] = np.where(now == NONE, NONE, now << shift | at)
        for leaf in (gone, keep, at):
            node = (size + leaf) >> 1
            while node[0]:
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                node = node >> 1
    kept = ids[:, :size]
    flat, ends = kept[kept >= 0].tolist(), np.cumsum((kept >= 0).sum(1)).tolist()
    return [flat[start:end] for start, end in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes whole texts. Matches seen lately are remembered, up to a bound."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = Ranks(path)
        self.parts = Parts(regex.compile(pattern).findall, self._encoded, ",".join, CACHED)
        self.bytes = {str(r): t for t, r in self.ranks.rank.items()}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """ids of each piece; a piece that is itself a token is that token."""
        out: list[list[int] | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.rank.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > SHORT:
                out[i] = merge_long(piece, self.ranks)
            else:
                groups.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for members in groups.values():
            for start in range(0, len(members), GROUP):
                some = members[start : start + GROUP]
                for i, ids in zip(some, merge_short([pieces[i] for i in some], self.ranks)):
                    out[i] = ids
        return out

    def _encoded(self, matches: list[str]) -> list[str]:
        return [",".join(map(str, ids)) for ids in self.merge([m.encode() for m in matches])]

    def encode(self, some: list[str]) -> list[str]:
        """The decimal ids of each text, joined by commas; empty for an empty text."""
        return list(map(",".join, self.parts.values(some)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.split(","))) if ids else b""


def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker: the rank file is read once."""
    return remembered(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, ids (array of int), decoded (binary), or with `digests` their SHA-256.

    Null text is empty: no ids. Each row is encoded on its own, in the task that reads it, so
    nothing is shuffled; repeated rows and null ids come out as they went in.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for block in blocks(batches):
            ids = tool.encode(texts(block))
            decoded = map(tool.decode, ids)
            if digests:
                rest = {
                    "n_tokens": pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                }
            else:
                rest = {
                    "ids": pa.array([[int(x) for x in i.split(",")] if i else [] for i in ids], pa.list_(pa.int32())),
                    "decoded": pa.array(decoded, pa.binary()),
                }
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id"), **rest})

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {out}")
