"""Suffix tree scoring against a plain implementation over dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablescope.llm import suffix_tree
from tablescope.llm.common import held_out

END, START = "", "<start>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def symbols(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), END]


class Tree:
    """The same tree, every follower of every context in one dictionary."""

    def __init__(self, texts, depth, min_count, gain):
        self.depth = depth
        sequences = [symbols(t) for t in texts]
        self.count = Counter(x for s in sequences for x in s)
        self.n, self.v = sum(self.count.values()), len(self.count)
        follow = defaultdict(Counter)
        for s in sequences:
            path = [START, *s]
            for i in range(1, len(path)):
                for d in range(1, min(depth, i) + 1):
                    follow[tuple(path[i - d : i])][path[i]] += 1
        self.kept = {}
        for d in range(1, depth + 1):
            for context, counts in follow.items():
                n = sum(counts.values())
                if len(context) != d or n < min_count or (d > 1 and context[1:] not in self.kept):
                    continue
                won = sum(c * math.log(c / n) - (c - 1) * math.log(self.p(x, context[1:])) for x, c in counts.items())
                if won >= gain:
                    self.kept[context] = counts

    def p(self, x, context):
        """In the longest retained suffix of the context."""
        while context and context not in self.kept:
            context = context[1:]
        if not context:
            return (self.count[x] + 1) / (self.n + self.v + 1)
        counts = self.kept[context]
        return (counts[x] + len(counts) * self.p(x, context[1:])) / (counts.total() + len(counts))

    def score(self, text):
        path, total = [START], 0.0
        for x in symbols(text):
            total += math.log10(self.p(x, tuple(path[-self.depth :])))
            path.append(x)
        return total


def corpus(n, seed):
    r = random.Random(seed)
    after = {w: [f"w{r.randrange(25)}" for _ in range(2)] for w in [f"w{i}" for i in range(25)]}
    out = []
    for _ in range(n):
        words = [f"w{r.randrange(25)}"]
        for _ in range(r.randrange(1, 90)):
            words.append(r.choice(after[words[-1].lower()]) if r.random() < 0.6 else f"W{r.randrange(25)}")
        out.append(r.choice([" ", "\n", "\t "]).join(words))
    return out


@pytest.mark.parametrize("depth", [1, 2])
def test_equals_plain_tree(spark, depth):
    texts = corpus(150, 5) + [None, "", " \t", "É é w1 w2   w3", "new words only here", "w1 " * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id LONG, text STRING, score STRING").repartition(5)
    got = suffix_tree.score(docs, held_out(F.col("doc_id"), 7, 2), depth, min_count=8, gain=3.0, block_tokens=700).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    tree = Tree([t for i, t in enumerate(texts) if not held[i]], depth, 8, 3.0)
    assert {len(c) for c in tree.kept} == set(range(1, depth + 1))  # something is retained at every length
    assert len(got) == len(texts) and {r.train_tokens for r in got} == {tree.n}
    for r in got:
        s = symbols(texts[r.doc_id])
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(s) and r.n_known == sum(tree.count[x] > 0 for x in s)
        base = sum(math.log10((tree.count[x] + 1) / (tree.n + tree.v + 1)) for x in s)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, tree.score(texts[r.doc_id]), rel_tol=1e-9)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_distributions_sum_to_one():
    tree = Tree(corpus(100, 9), 2, 8, 3.0)
    for context in [(), *tree.kept, ("w1", "nowhere")]:
        assert math.isclose(sum(tree.p(x, context) for x in [*tree.count, "unknown"]), 1.0)


def test_odd_rows(spark):
    schema = "doc_id LONG, text STRING, n_tokens LONG, held BOOLEAN, block INT, data STRING"
    rows = [(None, "a b", 1, None, 1, "x"), (1, "a b", None, True, 1, None), (1, "a b", 1, True, 1, None), (2, None, 1, None, 1, None)]
    rows += [(None,) * 6, (3, "z" * 200_000, 0, False, 0, "")]
    odd = spark.createDataFrame(rows, schema)
    got = suffix_tree.score(odd, held_out(F.col("doc_id"), 7, 2)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (0, 3), (1, 3), (1, 3), (2, 1), (3, 2)]
    assert len({(r.base_score, r.score) for r in got if r.n_tokens == 3}) == 1
    assert suffix_tree.score(odd.limit(0), F.lit(False)).count() == 0
    none = suffix_tree.score(odd, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.base_score == r.score == 0 and r.n_known == 0 for r in none)


def test_packed_arrays_come_back():
    import numpy as np

    for array in [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.uint8), np.array([1.5, -2.0]), np.array([True, False])]:
        (back,) = suffix_tree.unpack(suffix_tree.pack(array))
        assert back.dtype == array.dtype and (back == array).all()
