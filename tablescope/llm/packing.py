"""Sum-of-squares online packing of tokenised documents into windows.

Each task packs the documents it reads, in reading order, so no token is shuffled. A level array counts the
task's open windows by fill level. A document first fills whole windows of its own; the rest of `size`
tokens goes where the sum over all levels of (open windows at that level)^2 ends smallest: into a new
window, or on top of an open one. Ties go to the fullest window.

What is still open at the end of a task (or beyond `max_open`, so that memory is bounded) is closed: the
emptiest windows are cut up to fill the gaps of the fullest, and the last one is cut into windows whose
lengths are powers of two, which need no padding. So no token is padding.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablescope.llm.common import Parts, blocks, chunks, gc_rarely, remembered, texts

#: Parts that an encoder remembers, and ids of each on average.
CACHED, IDS = 500_000, 8
#: The printable character that stands for each byte in the vocabulary: itself, or the next one from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SHOWN = np.arange(256, dtype="<u4")
SHOWN[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
OUT_ROWS = 20_000


class _Numbers(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = new = len(self)
        return new


class Encoder:
    """Token ids of texts.

    A text is cut at its spaces into parts, and every part seen lately has a number: its ids lie in one flat array, so
    a block of texts costs one look-up per part and one gather. Of too many parts, those used most stay. The tokenizer's own pre-tokenizer cuts what is no plain word, its own
    model encodes each match once. Texts that hold a special token's string go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        gc_rarely()
        self.tool = Tokenizer.from_file(path)
        self.cut, self.model = self.tool.pre_tokenizer.pre_tokenize_str, self.tool.model
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.parts, self.pieces = _Numbers(), {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keeps the parts used most, half of what may be held; uses count half from then on."""
        often = np.argsort(-self.uses, kind="stable")[: CACHED // 2]
        often = np.sort(often[np.cumsum(self.sizes[often]) <= CACHED * IDS // 2])
        names = list(self.parts)
        self.parts = _Numbers(zip(map(names.__getitem__, often.tolist()), range(len(often))))
        self.flat = self._gathered(often)
        self.sizes, self.uses, self.used = self.sizes[often], self.uses[often] // 2, len(self.flat)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _gathered(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these parts, one after another."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)]

    def _matches(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.cut(text)]

    def _encoded(self, matches: Iterable[str]) -> None:
        """Encodes matches that are not known yet, each once."""
        new = [m for m in dict.fromkeys(matches) if m not in self.pieces]
        raw = [m.encode() for m in new]
        shown = SHOWN[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")  # a character per byte
        tokens, end = self.model.tokenize, 0
        for match, r in zip(new, raw):
            first, end = end, end + len(r)
            self.pieces[match] = array("I", [t.id for t in tokens(shown[first:end])]).tobytes()

    def _learn(self) -> None:
        """Stores the ids of parts that were numbered but not encoded yet."""
        cut = []  # per part, its matches; the space before it belongs to the first. Words that are parts themselves come as their ids
        known, flat, starts, sizes = len(self.starts), self.flat, self.starts, self.sizes
        for part in islice(self.parts, known, None):
            if part.isalpha():
                cut.append((" " + part,))
                continue
            # words that end in marks, one of them or two with a line end between: what the pre-tokenizer would cut, but faster
            lines = part.split("\n")
            stems = [line.rstrip(Parts.MARKS) for line in lines]
            if len(lines) <= 2 and all(map(str.isalpha, stems)):
                at = self.parts.get(stems[0], known)
                first = " " + stems[0] if at >= known else flat[starts[at] : starts[at] + sizes[at]].tobytes()
                own = [first, lines[0][len(stems[0]) :]]
                if len(lines) == 2:
                    own += ["\n", stems[1], lines[1][len(stems[1]) :]]
                cut.append([m for m in own if m])
            else:
                cut.append(self._matches(" " + part))
        self._encoded(m for c in cut for m in c if isinstance(m, str))
        piece = self.pieces.__getitem__
        new = [piece(c[0]) if len(c) == 1 else b"".join(m if isinstance(m, bytes) else piece(m) for m in c) for c in cut]
        sizes = np.fromiter(map(len, new), np.int64, len(new)) // 4
        starts = self.used + np.cumsum(sizes) - sizes
        first, self.used = self.used, self.used + int(sizes.sum())
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(self.used - len(self.flat), 1 << 18), np.uint32)])
        self.flat[first : self.used] = np.frombuffer(b"".join(new), np.uint32)
        self.starts, self.sizes = np.append(self.starts, starts), np.append(self.sizes, sizes)
        self.uses = np.append(self.uses, np.zeros_like(sizes))

    def encode(self, some: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.parts) > CACHED or self.used > CACHED * IDS:
            self._forget()
        if len(self.pieces) > CACHED // 2:
            self.pieces.clear()
        whole = {i for i, t in enumerate(some) if any(s in t for s in self.special)}
        cut = [[""] if i in whole else chunks(t) for i, t in enumerate(some)]
        parts = list(chain.from_iterable(c[1:] for c in cut))
        numbers = np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts))
        if len(self.parts) > len(self.starts):
            self._learn()
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        ends = np.cumsum(self.sizes[numbers])
        ids = self._gathered(numbers).astype("<u4")
        stops = np.append(0, ends)[np.cumsum([len(c) - 1 for c in cut])] if len(cut) else []
        heads = [self._matches(c[0]) for c in cut]
        self._encoded(chain.from_iterable(heads))
        out, first = [], 0
        for i, stop in enumerate(stops):
            if i in whole:
                head = np.array(self.tool.encode(some[i], add_special_tokens=False).ids, "<u4")
            else:
                head = np.frombuffer(b"".join(self.pieces[m] for m in heads[i]), np.uint32).astype("<u4")
            out.append(head.tobytes() + ids[first:stop].tobytes())
            first = stop
        return out


def encoder(path: str) -> Encoder:
    return remembered(("encoder", path), lambda: Encoder(path))


class SumOfSquares:
    """Open windows of one task. A piece is (document, start, ids as bytes); placed pieces come out of `done`."""

    def __init__(self, window: int, max_open: int, first_id: int) -> None:
        self.window, self.max_open, self.next_id = window, max_open, first_id
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces
        self.n_open = 0
        self.done: list[tuple] = []  # (piece, sequence id, offset)

    def choose(self, size: int) -> int:
        """Level of the window to put `size` tokens into; 0 is a new window."""
        below = self.levels[1 : self.window - size + 1]
        cost = 2 * (self.levels[1 + size :] - below + 1)
        if len(cost):
            cost[-1] -= 1  # a window that gets full leaves the array
            cost[below == 0] = np.iinfo(np.int64).max
            best = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[best] <= 2 * self.levels[size] + 1:
                return best + 1
        return 0

    def _emit(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((piece, self.next_id, offset))
            offset += len(piece[2]) // 4
        self.next_id += 1

    def add(self, document, ids: bytes) -> None:
        whole = 4 * self.window
        rest = len(ids) - len(ids) % whole
        for start in range(0, rest, whole):
            self._emit([(document, start // 4, ids[start : start + whole])])
        size = (len(ids) - rest) // 4
        if not size:
            return
        level = self.choose(size)
        pieces = [] if not level else self.open[level].pop()
        pieces.append((document, rest // 4, ids[rest:]))
        if level:
            self.levels[level] -= 1
            self.n_open -= 1
        if level + size == self.window:
            self._emit(pieces)
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.levels[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.close()

    def close(self) -> None:
        """Closes every open window without padding."""
        rest = [(level, p) for level in sorted(self.open) for p in self.open[level]]
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0
        spare: list = []  # pieces of the emptiest window, to be cut
        first = 0
        while rest[first:]:
            level, pieces = rest.pop()
            gap = 4 * (self.window - level)
            while gap:
                if not spare:
                    if not rest[first:]:
                        break
                    spare = list(rest[first][1])
                    first += 1
                document, start, ids = spare.pop()
                taken = ids[:gap]
                pieces.append((document, start, taken))
                if len(ids) > gap:
                    spare.append((document, start + gap // 4, ids[gap:]))
                gap -= len(taken)
            if gap:
                self._in_powers(pieces)
            else:
                self._emit(pieces)
        self._in_powers(spare)

    def _in_powers(self, pieces: list) -> None:
        pieces = list(reversed(pieces))
        left = sum(len(p[2]) // 4 for p in pieces)
        while left:
            wanted = min(self.window, 1 << (left.bit_length() - 1))
            left -= wanted
            own = []
            while wanted:
                document, start, ids = pieces.pop()
                own.append((document, start, ids[: 4 * wanted]))
                if len(ids) > 4 * wanted:
                    pieces.append((document, start + wanted, ids[4 * wanted :]))
                wanted -= len(own[-1][2]) // 4
            self._emit(own)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 1,
    max_open: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, text -> one row per piece of a document, with the sequence and offset it lies at.

    A document's ids are those of its text and then `end_id`; null or empty text leaves `end_id` alone. Rows
    with equal or null doc_id are documents of their own. An empty table gives no rows. A task that
    runs again reads the same rows in the same order, so it places them as before.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        context = TaskContext.get()
        packer = SumOfSquares(window, max_open, (context.partitionId() if context else 0) << 40)
        end = np.array([end_id], "<u4").tobytes()

        def out() -> pa.RecordBatch:
            pieces, packer.done = packer.done, []
            columns = {
                "doc_id": pa.array([p[0][0] for p, _, _ in pieces], kind),
                "start": pa.array([p[1] for p, _, _ in pieces], pa.int64()),
                "length": pa.array([len(p[2]) // 4 for p, _, _ in pieces], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p[2]) for p, _, _ in pieces], pa.int64()),
                "doc_tokens": pa.array([p[0][1] for p, _, _ in pieces], pa.int64()),
                "sequence_id": pa.array([s for _, s, _ in pieces], pa.int64()),
                "offset": pa.array([o for _, _, o in pieces], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(p[2], "<i4") for p, _, _ in pieces], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(columns)

        kind = None
        for block in blocks(batches):
            kind = block.schema.field("doc_id").type
            for doc_id, ids in zip(block.column("doc_id").to_pylist(), tool.encode(texts(block))):
                ids += end
                packer.add((doc_id, len(ids) // 4), ids)
            if len(packer.done) >= OUT_ROWS:
                yield out()
        packer.close()
        if packer.done:
            yield out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
