"""Spelling variants against comparing all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescope.llm import spelling

DOCS = "doc_id LONG, text STRING, word STRING, n LONG, key STRING, base INT"


def runs(rows, modulus=199):
    """All runs of (doc_id, text), one letter taken out where the checksum says so."""
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            yield run[: h % len(run)] + run[h % len(run) + 1 :] if h % modulus == 0 else run


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, least_letters=6, least_count=5, modulus=199):
    counts = {w: n for w, n in Counter(runs(rows, modulus)).items() if len(w) >= least_letters and n >= least_count}
    near = {w: [x for x in counts if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def typos(r, word):
    at, letter = r.randrange(len(word)), r.choice("abé×")
    return r.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word.upper(), word])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    stems = ["".join(r.choice("abcdeéèß") for _ in range(r.randrange(5, 13))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa"]
    words = [w for stem in stems for w in [stem] * 40 + [typos(r, stem) for _ in range(30)]]
    words = [w if r.random() < 0.8 else typos(r, w) for w in words * 6]
    texts = [" ".join(r.choices(words, k=r.randrange(1, 400))) for _ in range(60)]
    odd = [None, "", " \t", "x" * 90_000, "12345 !", "É" * 70 + "-" + "é" * 70, "don't-stop 🙂 naïve"]
    texts.append(" ".join(["kettenwort"] * 220 + ["kettenwor"] * 38 + ["kettenwo"] * 6))  # a form of a form
    return [(i, t) for i, t in enumerate(texts)] + [(100 + i % 3, t) for i, t in enumerate(odd)] * 6 + [(None, "without identity " * 9), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, "w", 1, "k", 2) for x in rows], DOCS).repartition(6)


@pytest.mark.parametrize("modulus", [199, 3])
def test_counts(docs, rows, modulus):
    got = {r.word: r.n for r in spelling.counts(docs, 1, modulus, held=300).collect()}
    want = Counter(runs(rows, modulus))
    want.pop("", None)
    assert got == dict(want)


@pytest.mark.parametrize("slab", [4096, 16])
def test_variants(docs, rows, slab):
    want = expected(rows)
    got = spelling.variants(docs, slab=slab).collect()
    assert len(got) == len(want) > 200
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(w[0] != w[1] for w in want.values() if w[0])  # forms of forms


def test_index_finds_every_pair_once():
    r = random.Random(8)
    some = sorted({"".join(r.choice("abc") for _ in range(r.choice([6, 7]))) for _ in range(900)})
    word, near = spelling.PositionIndex(some, 6).near()
    got = [(some[a], some[b]) for a, b in zip(word, near)]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in some for b in some if one_edit(a, b) and min(len(a), len(b)) == 6}


def test_near_words_meet_under_a_key(spark):
    r = random.Random(9)
    pairs = [(w, typos(r, w)) for w in ("".join(r.choice("abcdef") for _ in range(r.randrange(2, 20))) for _ in range(400))]
    pairs = [(a, b) for a, b in pairs if one_edit(a, b)]
    words = spark.createDataFrame([(w, 1) for w in {w for p in pairs for w in p}], "word STRING, n LONG")
    keys = {}
    for k in spelling.keyed(words).collect():
        keys.setdefault(k.word, set()).add(k.key)
    assert all(keys[a] & keys[b] for a, b in pairs)


def test_chains_of_forms(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5")]
    got = spelling.roots(spark.createDataFrame(links, "word STRING, form STRING")).collect()
    assert {(r.word, r.root) for r in got} == {(w, "w13") for w, _ in links}


def test_empty(docs):
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.filter(F.col("text").isNull())).count() == 0
