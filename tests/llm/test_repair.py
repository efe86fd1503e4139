"""Conversation repair against enumeration of all edits, and against a plain dynamic program."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product as every

import pytest

from tablescope.llm import repair
from tablescope.llm.queries import queries

SPACES = " \t\n\x0b\f\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
CONVERSATIONS = "conv_id LONG, turn LONG, role STRING, text STRING, audit STRING, is_row INT, symbols STRING"


def faults(rows):
    """(initial, fault) of (role, text) rows."""
    seen, out = set(), []
    for role, text in rows:
        kept = text.rstrip(SPACES)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "none"
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cost_of(audit, own):
    """Cost of a string of edits over the rows, None if it does not fit."""
    cost, at, state = 0, 0, ""
    for edit in audit:
        if edit == "I":
            state, cost = NEXT[state], cost + 3
            continue
        if at == len(own):
            return None
        initial, fault = own[at]
        at += 1
        if edit == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 3 * (fault == "truncated")
        if edit == "R":
            state, cost = NEXT[state], cost + 3
        elif initial == NEXT[state] or (initial == "s" and state == ""):
            state = initial
        else:
            return None
    return cost if at == len(own) and state in ("", "a") else None


def enumerated(own):
    best = None
    for n in range(len(own), len(own) + 4):
        for audit in every("DIKR", repeat=n):
            audit = "".join(audit)
            cost = cost_of(audit, own)
            if cost is not None:
                best = min(best or (cost, audit), (cost, audit))
    return best


def plain(own):
    """Least (cost, audit) per state, row by row."""
    def with_inserts(now):
        for _ in range(2):
            for state, (cost, audit) in list(now.items()):
                new = cost + 3, audit + "I"
                now[NEXT[state]] = min(now.get(NEXT[state], new), new)
        return now

    now = {"": (0, "")}
    for initial, fault in own:
        after = {}

        def put(state, cost, audit):
            after[state] = min(after.get(state, (cost, audit)), (cost, audit))

        for state, (cost, audit) in with_inserts(now).items():
            put(state, cost + 4, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 * (fault == "truncated")
            put(NEXT[state], cost + 3, audit + "R")
            if initial == NEXT[state] or (initial == "s" and state == ""):
                put(initial, cost, audit + "K")
        now = after
    now = with_inserts(now)
    return min(now[s] for s in ("", "a") if s in now)


def random_rows(r, n):
    return [(r.choice(["user", "assistant", "user", "assistant", "system", "tool", " "]), r.choice(["ok.", "ok", "what? ", "", " \t", "yes!\n", f"{r.random()}."])) for _ in range(n)]


def symbols(own):
    return bytes(4 * repair.FAULTS.index(f) + (repair.ROLES.find(i) if i in "sua" and i else 3) for i, f in own)


def grammars():
    plain_rules = repair.Grammar()
    rules = repair.Grammar()
    for pair in [(1, 2), (16, 16), (2, 1), (17, 17), (13, 2), (9, 10), (1, 1), (22, 22)]:
        rules.add(pair)
    return plain_rules, rules


def test_least_audit_by_enumeration():
    r = random.Random(1)
    for rules in grammars():
        for n in [0, 1, 2, 3, 3, 4, 4, 4]:
            own = faults(random_rows(r, n))
            assert rules.repaired(rules.compressed([symbols(own)])[0]) == enumerated(own)


def test_least_audit_of_long_rows():
    r = random.Random(2)
    for rules in grammars():
        some = [faults(random_rows(r, r.randrange(60))) for _ in range(150)] + [[("u", "none"), ("a", "none")] * 300, [("u", "none")] * 200]
        for own, s in zip(some, rules.compressed([symbols(own) for own in some])):
            assert rules.repaired(s) == plain(own)


def test_rules_are_replaced_without_overlap():
    rules = repair.Grammar()
    rules.add((1, 1))
    rules.add((16, 2))
    got = [s.tolist() for s in rules.compressed([b"\1\1\1\2", b"", b"\1\1\1\1", b"\1", b"\1\2\1\1\2"])]
    assert got == [[16, 1, 2], [], [16, 16], [1], [1, 2, 17]]


def expected(rows):
    """The query by plain Python: rows of (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv in by:
        own = sorted(by[conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        turns = {t for t, _, _ in own if t is not None}
        marks = faults([x[1:] for x in own])
        pairs = ["".join(p) for p in zip([m[0] for m in marks], [m[0] for m in marks][1:])]
        cost, audit = plain(marks)
        text, at, state = [], 0, ""
        for edit in audit:
            role, body = (None, "") if edit == "I" else own[at][1:]
            at += edit != "I"
            if edit == "D":
                continue
            state = NEXT[state] if edit in "IR" else role[:1]
            text.append(f"{ {'u': 'user', 'a': 'assistant'}[state] if edit in 'IR' else role}:{body}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[sum(m[1] == f for m in marks) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest(),
        )
    return out


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(4)
    rows = []
    for conv in range(120):
        for turn, (role, text) in enumerate(random_rows(r, r.randrange(1, 14))):
            rows.append((conv, turn + r.randrange(2), role, text))
    rows += [(500, t, ["user", "assistant"][t % 2], f"line {t}{'.' * (t % 3)}") for t in range(3000)]  # one holds most rows
    rows += [(501, 7, "user", "same.")] * 400 + [(502, None, "assistant", "x" * 100_000 + "?"), (502, 3, None, None), (502, None, "user", "a")]
    rows += [(None, 1, "user", "hello."), (None, 2, "assistant", "there."), (None, None, None, None), (503, None, None, None)]
    return rows + [(600 + t, 5, "user", "dropped or not.") for t in range(60)]


def test_query_equals_plain_python(spark, conversations, tmp_path):
    extra = [(*row, "x", 1, "y") for row in conversations]
    spark.createDataFrame(extra, CONVERSATIONS).repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries["op12_grammar_repair"](spark, str(tmp_path)).collect()}
    assert got == expected(conversations)


def test_repaired_rows(spark, conversations):
    rows = repair.damaged(spark.createDataFrame(conversations, CONVERSATIONS.split(", audit")[0])).repartition(5)
    judged = repair.audits(rows, max_rules=3)
    assert {r.conv_id: (r.cost, r.audit) for r in judged.collect()} == {
        r.conv_id: (r.cost, r.audit) for r in repair.audits(rows, max_rules=0).collect()
    }
    by = defaultdict(dict)
    for r in repair.repaired(rows, judged).collect():
        by[r.conv_id][r.position] = r.role[:1]
    for own in by.values():
        assert sorted(own) == list(range(len(own))) and re.fullmatch("(s?(ua)+)?", "".join(own[i] for i in sorted(own)))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries["op12_grammar_repair"](spark, str(tmp_path)).count() == 0
