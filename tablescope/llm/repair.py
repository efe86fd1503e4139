"""Cheapest repair of conversations' turn structure, by dynamic programming over a shared grammar.

Each row is one symbol: the initial of its role and its first fault (blank, duplicate, truncated or none). A repaired
conversation's role initials match (s?(ua)+)?; a row is kept, given the role that fits, or deleted, and rows
without text may be inserted anywhere. From each state of that pattern's automaton to each other one a symbol costs
a least number, with the least string of edits (D, I, K, R) at that cost: a min-plus transfer matrix. What a state allows
as the next user or assistant row is unique, so the string of edits says all.

Re-Pair replaces frequent neighbours by rules, over the distinct symbol sequences of all conversations: every round counts
pairs in Spark and adds the most frequent ones that share no symbol. A rule's matrix is the product of its two parts'
and is computed once, bottom-up, for all conversations; its edits are ropes, nodes that share their parts. A sequence is then the
product of few matrices. `max_rules` bounds the grammar; a smaller one makes sequences longer and changes no result.
Equal costs are compared as strings: of two different strings of edits over the same rows at equal cost none begins
with the other (it would have to end in inserted rows, which cost), so products keep the least one.

Rows of one conversation are ordered by turn (nulls first), then role, then the text's digest; equal rows are alike in any
order. Null role or text is one space. Null conv_id is a conversation of its own. Empty tables give no rows; other columns
are not read. A conversation's rows are spread over tasks but for its audit, one character per edit, and
its repaired rows, which one task emits in order as a stream: a digest of the whole needs that.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import blocks, written

ROLES = "sua?"  # role initials; ? is any other
FAULTS = ["none", "blank", "duplicate", "truncated"]
SPACE = " \t\n\x0b\f\r"
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 60
#: States: nothing yet, after s, after u, after a; what a user or assistant row must be, and where it leads.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
EMPTY = 0


class Ropes:
    """Strings as nodes: a leaf's text or two nodes. Node 0 is the empty string."""

    def __init__(self, nodes: list | None = None) -> None:
        self.nodes: list = nodes if nodes is not None else [""]

    def leaf(self, text: str) -> int:
        self.nodes.append(text)
        return len(self.nodes) - 1

    def join(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return a or b
        self.nodes.append((a, b))
        return len(self.nodes) - 1

    def parts(self, node: int) -> Iterator[str]:
        stack = [node]
        while stack:
            own = self.nodes[stack.pop()]
            if isinstance(own, str):
                yield own
            else:
                stack += [own[1], own[0]]

    def text(self, node: int) -> str:
        return "".join(self.parts(node))

    def less(self, a: int, b: int) -> bool:
        """Whether a's string sorts before b's; shared nodes at one place are passed over."""
        left, right = [a], [b]
        while left and right:
            x, y = left.pop(), right.pop()
            if x == y:
                continue
            own_x = x if isinstance(x, str) else self.nodes[x]
            own_y = y if isinstance(y, str) else self.nodes[y]
            if isinstance(own_x, tuple) and (not isinstance(own_y, tuple) or x > y):  # the later node cannot be a part of the other
                left += [own_x[1], own_x[0]]
                right.append(y)
            elif isinstance(own_y, tuple):
                right += [own_y[1], own_y[0]]
                left.append(x)
            else:
                n = min(len(own_x), len(own_y))
                if own_x[:n] != own_y[:n]:
                    return own_x[:n] < own_y[:n]
                if own_x[n:]:
                    left.append(own_x[n:])
                if own_y[n:]:
                    right.append(own_y[n:])
        return bool(right)


Matrix = list  # of 4 rows of 4 pairs (cost, rope)


class Grammar:
    """Rules (pairs of symbols; 0..15 are the rows' own symbols) and the matrix of every symbol."""

    def __init__(self) -> None:
        self.rules: list[tuple[int, int]] = []
        self.ropes = Ropes()
        edits = {x: self.ropes.leaf(x) for x in "DIKR"}
        none = (NEVER, EMPTY)
        insert = [[none] * 4 for _ in range(4)]
        for state in range(4):
            insert[state][state] = (0, EMPTY)
            at, cost, rope = state, 0, EMPTY
            for _ in range(2):  # more would come back to a state for nothing
                at, cost, rope = NEXT[at][1], cost + INSERT, self.ropes.join(rope, edits["I"])
                if cost < insert[state][at][0]:
                    insert[state][at] = (cost, rope)
        self.insert = insert
        self.matrices: list[Matrix] = []
        for fault in FAULTS:
            for role in ROLES:
                row = [[none] * 4 for _ in range(4)]
                for state in range(4):
                    row[state][state] = (DELETE, edits["D"])
                    if fault in ("blank", "duplicate"):
                        continue
                    extra = TRUNCATED if fault == "truncated" else 0
                    row[state][NEXT[state][1]] = (RE_ROLE + extra, edits["R"])
                    if (state, role) in KEEPS:
                        row[state][KEEPS[state, role]] = (extra, edits["K"])
                self.matrices.append(self.product(insert, row))

    def row_product(self, row: list, matrix: Matrix) -> list:
        out = []
        for to in range(4):
            best = (NEVER, EMPTY)
            for (cost, rope), own in zip(row, matrix):
                more, rest = own[to]
                if cost + more > best[0] or cost + more >= NEVER:
                    continue
                both = self.ropes.join(rope, rest)
                if cost + more < best[0] or self.ropes.less(both, best[1]):
                    best = (cost + more, both)
            out.append(best)
        return out

    def product(self, a: Matrix, b: Matrix) -> Matrix:
        return [self.row_product(row, b) for row in a]

    def add(self, pair: tuple[int, int]) -> None:
        self.rules.append(pair)
        self.matrices.append(self.product(self.matrices[pair[0]], self.matrices[pair[1]]))

    def compressed(self, sequences: list[bytes]) -> list[np.ndarray]:
        """Sequences as symbols of the grammar; all are rewritten together, rule by rule."""
        own = np.frombuffer(b"\xff".join(sequences), np.uint8).astype(np.int32)
        own[own == 255] = -1
        for symbol, (a, b) in enumerate(self.rules, 16):
            at = _occurrences(own, a, b)
            if len(at):
                own[at] = symbol
                own = np.delete(own, at + 1)
        return np.split(own[own >= 0], (np.flatnonzero(own < 0) - np.arange(len(sequences) - 1)))

    def repaired(self, symbols: np.ndarray) -> tuple[int, str]:
        """Least cost, and the least audit at that cost."""
        mark = len(self.ropes.nodes)
        row = [(0, EMPTY)] + [(NEVER, EMPTY)] * 3
        for s in symbols.tolist():
            row = self.row_product(row, self.matrices[s])
        row = self.row_product(row, self.insert)
        best = row[ACCEPTING[0]]
        for state in ACCEPTING[1:]:
            if row[state][0] < best[0] or (row[state][0] == best[0] and self.ropes.less(row[state][1], best[1])):
                best = row[state]
        out = best[0], self.ropes.text(best[1])
        del self.ropes.nodes[mark:]
        return out


def _occurrences(symbols: np.ndarray, a: int, b: int) -> np.ndarray:
    """Places of the pair that do not overlap, from the left."""
    at = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b))
    if a == b and len(at):
        runs = np.cumsum(np.diff(at, prepend=at[0] - 2) != 1) - 1
        starts = at[np.flatnonzero(np.diff(runs, prepend=-1))]
        at = at[(at - starts[runs]) % 2 == 0]
    return at


def shown(kind: str) -> Column:
    """A role or text; null is one space."""
    return F.coalesce(F.col(kind).cast("string"), F.lit(" "))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, turn, role, digest, copies, symbol: one row per distinct row of a conversation.

    symbol is that of the first copy; the other copies are duplicates, or blank like the first.
    """
    end = F.expr(f"trim(TRAILING '{SPACE}' FROM text)")
    fault = F.when(end == "", 1).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    own = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), fault.alias("fault"))
    own = own.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.max("fault").alias("fault"))
    said = ["conv_id", "role", "digest"]
    # the turn that says it first, null before any other; its rows are few, hot ones have been merged above
    first = own.groupBy(*said).agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unturned"))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in said], F.when(~F.col("unturned"), F.col("first")).alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in said]
    repeated = ~F.col("turn").eqNullSafe(F.col("first")) & (F.col("fault") != 1)
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = 4 * F.when(repeated, 2).otherwise(F.col("fault")) + role
    return own.join(first, same).select("conv_id", "turn", "role", "digest", "copies", symbol.alias("symbol"))


def sequences(faults: DataFrame) -> DataFrame:
    """conv_id, symbols (binary, a byte per row in order). Sorted by ranges, so a long conversation is spread over tasks."""
    kind = faults.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    parts = int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = faults.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().alias("part"), "conv_id", "copies", "symbol")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list = []  # (conv_id, part, its number there, symbols)

        def out(some: list) -> pa.RecordBatch:
            columns = list(zip(*some)) or [[], [], [], []]
            kinds = [schema.field("conv_id").type, pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", "part", "piece", "symbols"])

        number = 0
        for batch in batches:
            schema = batch.schema
            rows = zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "copies", "symbol")])
            for conv_id, part, copies, symbol in rows:
                rest = symbol if symbol // 4 == 1 else 8 + symbol % 4
                if not own or own[-1][0] != conv_id:
                    own.append((conv_id, part, number, bytearray()))
                    number += 1
                own[-1][3].append(symbol)
                own[-1][3].extend(bytes([rest]) * (copies - 1))
            if own:
                yield out([(c, p, k, bytes(s)) for c, p, k, s in own])
            own = []  # a conversation that goes on is another piece

    pieces = ranged.mapInArrow(run, f"conv_id {kind}, part int, piece long, symbols binary")
    joined = F.array_sort(F.collect_list(F.struct("part", "piece", F.hex("symbols").alias("symbols"))))
    joined = F.unhex(F.array_join(F.transform(joined, lambda p: p["symbols"]), ""))
    return pieces.groupBy("conv_id").agg(joined.alias("symbols"))


def grammar(distinct: DataFrame, max_rules: int = 128, per_round: int = 16, least: int = 16) -> Grammar:
    """Re-Pair over `symbols`, each counted `n` times; the driver gets at most 4 * per_round pairs a round."""
    out = Grammar()

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4096):
            counts: Counter = Counter()
            for symbols, n in zip(out.compressed(block.column("symbols").to_pylist()), block.column("n").to_pylist()):
                code = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
                found, times = np.unique(code, return_counts=True)
                for c, k in zip(found.tolist(), times.tolist()):
                    counts[c] += n * (k if c >> 32 != c & 0xFFFFFFFF else (k + 1) // 2)
            yield pa.RecordBatch.from_pydict({"code": pa.array(counts.keys(), pa.int64()), "n": pa.array(counts.values(), pa.int64())})

    while len(out.rules) < max_rules:
        counted = distinct.mapInArrow(pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        top = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "code").limit(4 * per_round).collect()
        taken: set[int] = set()
        new = []
        for r in top:
            pair = r["code"] >> 32, r["code"] & 0xFFFFFFFF
            if not taken & set(pair) and len(new) < min(per_round, max_rules - len(out.rules)):
                taken |= set(pair)
                new.append(pair)
        for pair in new:
            out.add(pair)
        if not new:
            break
    return out


def audits(rows: DataFrame, max_rules: int = 128) -> DataFrame:
    """conv_id, turn, role, text -> per conversation gaps, blank, duplicate, truncated, illegal, cost and audit."""
    faults = written(with_faults(rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"))), "faults")
    own = written(sequences(faults), "sequences")
    distinct = written(own.groupBy("symbols").agg(F.count("*").alias("n")), "distinct")
    rules = grammar(distinct, max_rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        legal = np.zeros((4, 4), bool)
        for a, b in ("su", "ua", "au"):
            legal[ROLES.index(a), ROLES.index(b)] = True
        for block in blocks(batches, 4096):
            some = block.column("symbols").to_pylist()
            found = [rules.repaired(s) for s in rules.compressed(some)]
            out: dict = {"symbols": pa.array(some, pa.binary())}
            plain = [np.frombuffer(s, np.uint8) for s in some]
            for k, fault in list(enumerate(FAULTS))[1:]:
                out[fault] = pa.array([int((s // 4 == k).sum()) for s in plain], pa.int64())
            out["illegal"] = pa.array([int((~legal[s[:-1] % 4, s[1:] % 4]).sum()) for s in plain], pa.int64())
            out["cost"] = pa.array([f[0] for f in found], pa.int64())
            out["audit"] = pa.array([f[1] for f in found], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "symbols binary, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    judged = own.join(distinct.select("symbols").mapInArrow(run, schema), "symbols").drop("symbols")
    turns = faults.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    turns = turns.withColumnRenamed("conv_id", "_conv_id")
    return judged.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).drop("_conv_id")


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text, edit (K, R or I), in order within each partition.

    `judged` is what `audits` gave for these rows. Conversations of which nothing is left give no rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    some = rows.select("conv_id", F.lit(1).alias("is_row"), "turn", shown("role").alias("role"), shown("text").alias("text"))
    plans = judged.select("conv_id", F.lit(0).alias("is_row"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = some.unionByName(plans).repartition("conv_id")
    order = [F.col("conv_id").asc_nulls_first(), "is_row", F.col("turn").asc_nulls_first(), "role", F.md5("text")]
    ordered = both.sortWithinPartitions(*order).select("conv_id", "is_row", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, position, conv_id = "", 0, 0, 0, None
        for block in blocks(batches):
            out: list = []

            def inserted() -> None:
                nonlocal at, state, position
                while at < len(audit) and audit[at] == "I":
                    role, state = NEXT[state]
                    out.append((conv_id, position, role, "", "I"))
                    position += 1
                    at += 1

            for own, is_row, role, text in zip(*[block.column(c).to_pylist() for c in ("conv_id", "is_row", "role", "text")]):
                if not is_row:
                    conv_id, audit, at, state, position = own, text, 0, 0, 0
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "R":
                    role, state = NEXT[state]
                elif edit == "K":
                    state = KEEPS[state, role[:1]]
                if edit != "D":
                    out.append((conv_id, position, role, text, edit))
                    position += 1
                if audit[at : at + 3] in ("I", "II"):  # after the last row
                    inserted()
            columns = list(zip(*out)) or [[]] * 5
            kinds = [block.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", "position", "role", "text", "edit"])

    return ordered.mapInArrow(run, f"conv_id {kind}, position long, role string, text string, edit string")


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text`, newline-joined, of rows that come in order within their partition."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, field = None, None, None
        for block in blocks(batches):
            field, done = block.schema.field("conv_id").type, []
            for conv_id, position, role, text in zip(*[block.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")]):
                if not position:
                    if digest:
                        done.append((current, digest.hexdigest()))
                    current, digest = conv_id, hashlib.sha256()
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if done:
                yield out(done, field)
        if digest:
            yield out([(current, digest.hexdigest())], field)

    def out(done: list, field: pa.DataType) -> pa.RecordBatch:
        ids, hashes = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(ids, field), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])

    return rows.select("conv_id", "position", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Faults planted by the checksum of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    sentence ends away, 3 repeats it, 4 makes it a user's."""
    key = F.concat(shown("conv_id"), F.lit(":"), shown("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = shown("text"), shown("role")
    copies = F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    ).drop("copy")
