"""The training-data operators against brute force, round trips and odd rows."""

import base64
import hashlib
import math
import random
import re
import weakref
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablescope.llm import bpe, chat, jaccard, language, neighbours, packing, pii, product, suffixes, toxicity
from tablescope.llm.common import components, tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, score DOUBLE, spans STRING, block INT"
ODD = [None, "", " ", "\n\t ", "a", "é ñ ß", "🙂 🙃", "x" * 70_000, "12345678901234567890 " * 300, "a@b.c", "<|endoftext|> </s>"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "er", "."]) + str(r.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, null and repeated ids, and columns with names that operators use."""
    rows = [(i, t, "en", "s", len(t or ""), 1.0, "x", 1) for i, t in enumerate(ODD)]
    rows += [rows[4], (4, "other", None, None, None, None, None, None), (None, "no id", "de", None, 5, None, None, 2), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


#: names that operators and stages give to columns of their own
OWN = "_key _terms _text_id _spans _leader _text_key _row _h _r row rows c0 c1 c2 text_key text_id set_id n_rows lang_pred score terms kind block part".split()


def with_own_names(docs):
    return docs.select("doc_id", "text", "lang", *(F.concat_ws(":", F.lit(n), "doc_id").alias(n) for n in OWN))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(4)


# ---- packing


def unpacked(rows, window=2048):
    """Checks windows and pieces; returns ids per (doc_id, tokens)."""
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_document[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    return by_document


def test_packing_holds_every_id_once(spark, odd):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [prose(random.Random(i).randrange(1, 1500), i) for i in range(60)] + [t for t in ODD if t]
    texts += ["a <|endoftext|>b  c<|endoftext|><|endoftext|>", "  two  spaces ", "x\n\n y", " lead", "don't we'll 3rd.", "...", "<|endoftext"]
    got = unpacked(packing.pack(frame(spark, texts), tokenizer_path("byte_bpe_50k.json"), with_ids=True).collect())
    for i, text in enumerate(texts):
        want = tool.encode(text, add_special_tokens=False).ids + [1]
        pieces = sorted(got[i, len(want)])
        assert [x for _, _, ids in pieces for x in ids] == want and [p[0] for p in pieces][0] == 0
    rows = packing.pack(odd, tokenizer_path("byte_bpe_50k.json")).collect()
    assert sum(r.doc_tokens == 1 for r in rows) == 3 and sum(r.length for r in rows if r.doc_id == 4) == 2 + 2 + 2


def test_encoder_keeps_what_is_used_most(monkeypatch):
    """Few parts and matches are held, texts of one word included, and ids stay those of the library."""
    monkeypatch.setattr(packing, "CACHED", 60)
    r = random.Random(8)
    tool = packing.Encoder(tokenizer_path("byte_bpe_50k.json"))
    for block in range(40):
        some = [" ".join(r.choice(["the", "of.", "of.\nThe", f"w{r.randrange(9**6)}", f"Wört{r.randrange(9**4)};"]) for _ in range(20)) for _ in range(3)]
        some += ODD
        wanted = [tool.tool.encode(t or "", add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(x, "<u4").tolist() for x in tool.encode([t or "" for t in some])] == wanted
        assert len(tool.parts) <= 60 + 200
    assert "the" in tool.parts and "of." in tool.parts
    for block in range(40):
        tool.encode(["".join(r.choices("abcdefghij", k=12)) for _ in range(30)])
    assert len(tool.pieces) < 400


@pytest.mark.parametrize("other", [lambda: jaccard.Shingler(3), lambda: suffixes.Sequences(), lambda: language.Scorer(language.Model([], [], np.zeros((1, 0)), 4))])
def test_another_stage_releases_what_the_encoder_remembers(other):
    path = tokenizer_path("byte_bpe_50k.json")
    tool = weakref.ref(packing.encoder(path))
    assert packing.encoder(path) is tool()
    other()
    assert tool() is None


def test_word_hashes_are_not_remembered():
    tool = jaccard.Shingler(3)
    before = {k: v for k, v in vars(tool).items()}
    tool.shingles(prose(200, 1))
    assert vars(tool) == before == {"n": 3}


def test_level_array_minimises_squares():
    packer = packing.SumOfSquares(10, 100, 0)
    r = random.Random(3)
    for i in range(400):
        size = r.randrange(1, 10)
        before = packer.levels.copy()

        def squares(level):
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < 10:
                after[level + size] += 1
            return int((after**2).sum())

        options = [0] + [h for h in range(1, 10 - size + 1) if before[h]]
        assert squares(packer.choose(size)) == min(map(squares, options))
        packer.add(i, b"\0\0\0\0" * size)
        assert all(packer.levels[h] == len(packer.open.get(h, [])) for h in range(1, 10))
    packer.close()
    assert not packer.n_open


def test_windows_stay_bounded():
    packer = packing.SumOfSquares(64, 5, 0)
    for i in range(500):
        packer.add(i, bytes(4 * (33 + i % 7)))
        assert packer.n_open <= 5
    packer.close()
    assert sum(len(p[2]) for p, _, _ in packer.done) == sum(4 * (33 + i % 7) for i in range(500))


# ---- BPE


def test_bpe_equals_tiktoken(spark, odd):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks.rank, special_tokens={})
    r = random.Random(1)
    alphabet = " \n\tabcé'sñ.,1½\xa0\x1c\x85中🙂"
    texts = [t or "" for t in ODD] + ["".join(r.choice(alphabet) for _ in range(r.randrange(150))) for _ in range(1500)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == ",".join(map(str, known.encode_ordinary(text)))
        assert codec.decode(ids) == text.encode()
    got = bpe.encode_documents(odd, path, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count() and all(not g.ids for g in got if g.doc_id in (0, 1))
    digest = bpe.encode_documents(frame(spark, ["a b"]), path, public_tokenizers.PATTERN, digests=True).first()
    assert digest.decoded_sha256 == hashlib.sha256(b"a b").hexdigest() and digest.n_tokens == 2


@pytest.mark.parametrize("size", [1, 2, 3, 63, 64, 65, 200])
def test_both_trees_agree(size):
    ranks = bpe.Ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    r = random.Random(size)
    for _ in range(20):
        piece = bytes(r.choice(b"aabetn ") for _ in range(size))
        assert bpe.merge_long(piece, ranks) == bpe.merge_short([piece, piece], ranks)[1]


# ---- chat


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "<\\s>", "[", "<", "</s", "[:] [TURN] x", None, "", "a\nb", "[/ANS]</s>", "\\\\</s>"]
    roles = ["user", "assistant", "system", "tool", "</s>", "[:] ", None, "we[:]ird"]
    r = random.Random(2)
    rows = [(c, t, r.choice(roles), r.choice(odd)) for c in range(150) for t in range(r.randrange(1, 6))]
    rows += [(None, 0, "user", "x"), (200, None, "user", "n"), (200, None, "user", "n"), (200, 1, "assistant", "m")]
    df = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((-1 if t is None else t, role or "", text or ""))
    got = chat.read_back(chat.format_conversations(df)).collect()
    assert len(got) == len(turns)
    for g in got:
        want = sorted(turns[g.conv_id])
        assert [(t.role, t.text) for t in g.turns] == [(role, text) for _, role, text in want]
        assert "".join(s.text for s in g.segments) == g.formatted
        back = [re.sub(r"(?s)\\(.)", r"\1", g.formatted[s.start : s.start + s.length]) for s in g.loss_spans]
        assert back == [text for _, role, text in want if role == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("roles,valid", [("user assistant", True), ("system user assistant user assistant", True), ("assistant user", False), ("user", False), ("user user assistant", False), ("user assistant tool assistant", True)])
def test_turn_order(spark, roles, valid):
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles.split())], "conv_id LONG, turn LONG, role STRING, text STRING")
    assert chat.format_conversations(df).first().valid is valid


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "t")], "conv_id LONG, turn LONG, role STRING, text STRING")
    plan = chat.read_back(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange") == 1


# ---- personal data


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_entities_equal_the_patterns():
    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice(r.choice(["ab@.", "1234567890. -+()", "@a.", "1.2@ ", "٣é\n"])) for _ in range(r.randrange(60)))
        assert pii.find_entities(t) == base_spans(t)
    long = "a" * 200_000 + " " + "1" * 200_000 + " " + "1." * 50_000
    assert [kind for _, kind, _ in pii.find_entities(long)] == [1] * 12_500


def test_disclosing_terms(spark):
    """Zorro stands by one address in three texts and nowhere else; 'the' is everywhere; copies prove nothing."""
    texts = [f"{prose(30, i)} the mail Zorro writes {w} from zed@mail.example.com the {prose(20, i + 50)}" for i, w in enumerate(["a1", "b2", "c3"])]
    texts += ["the copied Secret text of bob@mail.example.com is here the"] * 4
    texts += [f"the {prose(40, 100 + i)}" for i in range(60)]
    docs = frame(spark, texts)
    for r in pii.detect(docs).collect():
        named = {texts[r.doc_id][s.start : s.end] for s in r.all_spans if s.kind == 4}
        assert ("Zorro" in named) == (r.doc_id < 3) and not named & {"the", "Secret", "copied"}
        assert [s for s in r.all_spans if s.kind < 4] == r.base
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[NAME]" in clean[0] and "[EMAIL]" in clean[0] and "zed@" not in clean[0] and "Zorro" not in clean[0]
    assert "Secret text of [EMAIL] is here" in clean[3] and clean[20] == texts[20]


def test_disclosing_terms_far_from_the_entity(spark):
    """Zorro stands by the address and again far off; Quentin always stands far off; Lone goes with it in one text only."""
    texts = [f"{prose(30, i)} Zorro {w} zed@mail.example.com {prose(20, i + 50)} Zorro {prose(90, i + 70)} Quentin end" for i, w in enumerate(["a1", "b2", "c3"])]
    texts[0] += " Lone"
    texts += [f"the {prose(40, 100 + i)}" for i in range(60)]
    docs = frame(spark, texts)
    for r in pii.detect(docs).collect():
        named = [texts[r.doc_id][s.start : s.end] for s in r.all_spans if s.kind == 4]
        assert (named.count("Zorro"), named.count("Quentin"), named.count("Lone")) == ((2, 1, 0) if r.doc_id < 3 else (0, 0, 0))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Zorro" not in clean[i] and "Quentin" not in clean[i] for i in range(3)) and "Lone" in clean[0]
    assert all(clean[i] == texts[i] for i in range(3, len(texts)))


def test_numbers_disclose(spark):
    """Customer number 48813 goes with one address; 2024 is everywhere; the digits of entities are no terms."""
    texts = [f"{prose(30, i)} customer 48813 {w} 2024 zed@mail.example.com 10.0.0.7 {prose(20, i + 50)}" for i, w in enumerate(["a1", "b2", "c3"])]
    texts += [f"2024 the {prose(40, 100 + i)}" for i in range(60)]
    docs = frame(spark, texts)
    for r in pii.detect(docs).collect():
        named = {texts[r.doc_id][s.start : s.end] for s in r.all_spans if s.kind == 4}
        assert ("48813" in named) == (r.doc_id < 3) and not named & {"2024", "10", "7"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("[NUMBER]" in clean[i] and "48813" not in clean[i] and "2024" in clean[i] for i in range(3))


def brute_terms(texts, alpha=1.25, support=2, reach=6):
    """Places of disclosing terms, each pair of an entity and a term counted by itself."""
    found = {i: pii.find_entities(t) for i, t in texts.items()}
    held = {i: {pii._entity(k, texts[i][a:b]) for a, k, b in s} for i, s in found.items()}
    words = {i: {w for _, _, w in pii._terms(t, found[i])} for i, t in texts.items()}
    every = {i: {m.lower() for m in pii._TERM.findall(t)} for i, t in texts.items()}
    near = defaultdict(set)
    for i, t in texts.items():
        for x in pii._surroundings(t, found[i], reach) if found[i] else []:
            near[x["entity"], x["term"]].add(x["context"])
    total, passed = len(texts), set()
    for e in set().union(*held.values()):
        own = [i for i in texts if e in held[i]]
        for w in set().union(*(words[i] for i in own)):
            both = [i for i in own if w in words[i]]
            if len({texts[i] for i in both}) < support and len(near[e, pii._hash(w)]) < support:
                continue
            n_term = sum(w in every[i] for i in texts)
            pmi = math.log(len(both) * total / (len(own) * n_term))
            if pmi >= -math.log(len(own) / total) / alpha and pmi > 0:
                passed.add((e, w))
    return {i: {(s, e) for s, e, w in pii._terms(t, found[i]) if any((x, w) in passed for x in held[i])} for i, t in texts.items()}


def test_disclosing_terms_equal_brute_force(spark):
    """Lists of addresses in the same texts, addresses of one text, terms that only some of a group stand near."""
    r = random.Random(3)
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = {i: prose(60, i).translate(letters) for i in range(60)}
    mails = [f"p{i}@mail.example.com" for i in range(30)]
    for i in range(0, 60, 3):
        some = mails[i // 6 * 3 : i // 6 * 3 + 3] if i % 2 else r.sample(mails, 2)
        texts[i] += " Zorvath " + " and ".join(some) + f" quill{'abc'[i % 3]} sold rarely{i // 12 * 'x'} to none"
    texts[61] = " ".join(f"Umbrin so {m} or else {n} words that go on for long enough to be apart" for n, m in enumerate(["q@mail.example.com"] * 3 + mails[:3]))
    texts[62] = "Umbrin so " + texts[0]
    got = {r.doc_id: {(s.start, s.end) for s in r.all_spans if s.kind == 4} for r in pii.detect(spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING").repartition(4)).collect()}
    want = brute_terms(texts)
    assert got == want and sum(map(len, want.values())) > 20


def test_lists_of_entities_are_one_group(spark, monkeypatch):
    """400 addresses and 3,000 words in three documents: a row per word and document, not per address."""
    listed = " ".join(f"m{i}@mail.example.com" for i in range(400))
    words = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{e}" for i in range(3000)) for e in "xyz"]
    rows = [(i, f"{listed} {w} {words[0]}") for i, w in enumerate(words)] + [(10 + i, "nothing") for i in range(200)]
    counted, plain = [], pii._candidates
    monkeypatch.setattr(pii, "_candidates", lambda *a: counted.append(plain(*a)) or counted[0])
    pii.detect(spark.createDataFrame(rows, "doc_id LONG, text STRING")).count()
    assert 9_000 <= counted[0][0].count() <= 20_000


def test_filter_of_words_grows_with_the_terms(spark, monkeypatch):
    """With a small filter to begin with, few words beside the candidates are counted, and the terms found are the same."""
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = {i: f"{prose(80, i)} zed@mail.example.com" if i < 3 else prose(80, i) for i in range(60)}
    texts = {i: (t + " " + prose(40, 500)).translate(letters) if i < 3 else t.translate(letters) for i, t in texts.items()}
    monkeypatch.setattr(pii, "FILTER_BITS", 256)
    bits, plain = [], pii._counted
    monkeypatch.setattr(pii, "_counted", lambda docs, b: bits.append(b) or plain(docs, b))
    rows = pii.detect(spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")).collect()
    filled = np.unpackbits(np.frombuffer(bits[1], np.uint8))
    assert filled.sum() > 30 and filled.mean() <= 1 / 32
    assert {r.doc_id: {(s.start, s.end) for s in r.all_spans if s.kind == 4} for r in rows} == brute_terms(texts)


def test_pii_of_odd_rows(odd, empty):
    assert pii.detect(odd).count() == odd.count() and pii.detect(empty).count() == 0
    back = pii.sanitise(odd)
    assert back.columns == odd.columns and back.count() == odd.count() and back.filter("text IS NULL").count() == 2
    assert back.filter("doc_id = 9").first().text == "[EMAIL]"


# ---- language


def test_forward_sums_all_segmentations():
    lattice = language.Lattice([b"ab", b"abc", b"bc"], 3)
    r = np.random.default_rng(0)
    chance = np.concatenate([np.zeros((1, 2)), r.random((len(lattice.pieces), 2))])
    at = {p: i + 1 for i, p in enumerate(lattice.pieces)}

    def total(word):
        if not word:
            return 1.0
        return sum(chance[at[word[:k]]] * total(word[k:]) for k in range(1, min(3, len(word)) + 1) if word[:k] in at)

    words = [b"a", b"abc", b"abcabc", b"ccba", b"abcab" * 2]
    assert np.allclose(np.exp(language.log_probability(lattice, chance, words)), [total(w) for w in words])
    long = language.log_probability(lattice, chance * 1e-4, [b"abc" * 3000])
    assert np.isfinite(long).all()


def test_held_out_languages(spark, odd, empty):
    own = {"xx": "lorem ipsum dolor sit amet".split(), "yy": "quick brown foxes jump over lazy dogs".split()}
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(own[g]) for _ in range(12)), g) for i, g in enumerate(["xx", "yy"] * 100)]
    df = spark.createDataFrame(rows, "_key LONG, text STRING, lang STRING")
    model = language.fit(df.filter("_key < 150"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), fit_docs=20)
    got = language.identify(df, model).collect()
    assert all(g.lang_pred == g.lang and 0.5 < g.score <= 1 for g in got)
    odd_rows = language.identify(odd, model)
    assert {r.lang_pred for r in odd_rows.filter("doc_id in (0, 1, 2, 3, 6, 8)").collect()} == {"und"}
    assert odd_rows.count() == odd.count() and language.identify(empty, model).count() == 0
    nothing = language.fit(empty.withColumn("_key", F.col("doc_id")), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


# ---- toxicity


def test_language_sample_is_bounded(spark, monkeypatch):
    """One key holds most rows: no more than fit_docs distinct rows of a language are learnt from."""
    rows = [("en", f"word{i % 700:05d}".translate(str.maketrans("0123456789", "abcdefghij")), 1) for i in range(5000)]
    rows += [("en", "other", i) for i in range(2, 20)] + [("en", None, 30), (None, "lost", 31)]
    seen = {}
    monkeypatch.setattr(language, "fit_language", lambda lattice, counts, rounds, floor: seen.update(counts) or np.full(len(lattice.pieces) + 1, 0.1))
    docs = spark.createDataFrame(rows, "lang STRING, text STRING, _key LONG")
    language.fit(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), fit_docs=40)
    assert sum(seen.values()) == 40
    seen.clear()
    language.fit(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), fit_docs=10_000)
    assert sum(seen.values()) == 718 and seen[b" other"] == 18


def test_swaps_lower_the_weight_of_mentions(spark, odd, empty):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        text = prose(20, i) + (" vile" if toxic and i % 8 else "") + (" horrid" if toxic else "")
        # in the sample, a group is mentioned mostly in toxic texts
        text += " women" if r.random() < (0.9 if toxic else 0.05) else " men" if r.random() < 0.5 else ""
        rows.append((i, text))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    marks = spark.createDataFrame([*labels, (None, 1), (0, None), (9999, 1), (3, 7)], "doc_id LONG, toxic INT")
    plain = toxicity.fit(docs, marks, swap_weight=0.0)
    fair = toxicity.fit(docs, marks, swap_weight=10.0)
    weight = lambda m, w: m.weights.get(int(np.uint64(toxicity.feature(w)).astype(np.int64)), 0.0)
    gap = lambda m: abs(weight(m, "women") - weight(m, "men"))
    assert gap(fair) < 0.5 * gap(plain) or gap(plain) < 1e-9 and gap(fair) < 1e-9
    got = {r.doc_id: r for r in toxicity.score(docs, fair).collect()}
    assert sum(got[i].predicted == t for i, t in labels) > 0.97 * len(labels)
    scored = toxicity.score(odd, fair)
    assert scored.count() == odd.count() and scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    nothing = toxicity.fit(empty, marks.limit(0))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.5}


def test_one_row_per_labelled_id_teaches(spark):
    rows = [(i, "vile text" if i % 2 else "kind text") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id LONG, toxic INT")
    docs = lambda some: spark.createDataFrame(some, "doc_id LONG, text STRING")
    seen = []
    real = toxicity.train
    toxicity.train = lambda features, *rest: seen.append(len(features)) or real(features, *rest)
    try:
        toxicity.fit(docs(rows + [(0, f"other {i}") for i in range(500)] + [rows[1]] * 500), labels)
    finally:
        toxicity.train = real
    assert seen[0] == 40


# ---- near duplicates


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS).upper() + "x" if r.random() < share else w for w in text.split(" "))


def brute_components(texts, n, t):
    sets = {}
    for i, x in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,t,chunk", [(3, Fraction(9, 10), 1500), (5, Fraction(8, 10), 1500), (3, Fraction(9, 10), 7)])
def test_jaccard_equals_brute_force(spark, n, t, chunk):
    texts = [prose(20 + 5 * i, i) for i in range(20)]
    texts += [edited(texts[i % 20], 0.004 * (i % 12), i) for i in range(90)]
    texts += [None, "", "a", "a", "b", "a b", "A B", "a\tB", "a b c", *["one two three four"] * 5, texts[3] + " end"]
    got = jaccard.jaccard_components(frame(spark, texts), n, t, chunk)
    want = brute_components(dict(enumerate(texts)), n, t)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_jaccard_of_odd_rows(odd, empty):
    got = jaccard.jaccard_components(odd)
    assert got.count() == odd.count() and got.filter("n_shingles = 0 AND NOT component_id <=> doc_id").count() == 0
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("bands", [37, 113])
def test_sparse_signatures_equal_the_walk(bands):
    """The table of first hits gives what hashing again and again gives."""
    bins, r = bands * jaccard.ROWS, np.random.default_rng(bands)
    for n in [1, 2, 3, 7, 20, 60, bins // 4]:
        shingles = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        keys = jaccard.mix(shingles ^ jaccard._TWO)
        least = {}
        for k, h in zip(keys.tolist(), jaccard.mix(keys).tolist()):
            least[k % bins] = min(h, least.get(k % bins, h))
        minima = []
        for b in range(bins):
            at, attempt = b, 0
            while at not in least:
                attempt += 1
                at = int(jaccard._hit(np.array([b]), attempt, bins)[0])
            minima.append(least[at])
        out = np.arange(bands, dtype=np.uint64) * jaccard._TWO
        for i in range(jaccard.ROWS):
            out = jaccard.mix(out * jaccard._ONE + np.array(minima, np.uint64).reshape(bands, jaccard.ROWS)[:, i])
        assert (jaccard.signatures(shingles, bands, jaccard.ROWS) == out).all()


@pytest.mark.parametrize("n,t", [(3, Fraction(9, 10)), (5, Fraction(8, 10))])
def test_short_texts_equal_brute_force(spark, n, t):
    """Sets of 1 to 20 shingles, each with copies that lose or gain words at either end."""
    texts = [prose(n - 1 + size, 100 * size + i) for size in range(1, 21) for i in range(3)]
    texts += [x + " end" for x in texts] + [x.split(" ", 1)[-1] for x in texts] + [f"new {x}" for x in texts[:60]]
    got = jaccard.jaccard_components(frame(spark, texts), n, t).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(dict(enumerate(texts)), n, t)


def test_repeated_rows_link(spark):
    """One row is there 500 times; it links to near copies, and goes to a task once."""
    same = prose(60, 1)
    rows = [(7, same)] * 500 + [(8, same + " end"), (9, "new " + same), (3, prose(60, 2)), (3, prose(60, 2))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4), chunk=2)
    assert sorted((r.doc_id, r.component_id, r["count"]) for r in got.groupBy("doc_id", "component_id").count().collect()) == [
        (3, 3, 2), (7, 7, 500), (8, 7, 1), (9, 7, 1)
    ]


def test_classes_without_an_id_link(spark):
    """0 and 1 are no near copies of each other, but both of the text without an id between them."""
    words = prose(100, 1).split()
    texts = [words, ["new", *words[1:-1], words[-1]], ["new", *words[1:-1], "end"]]
    rows = [(0, " ".join(texts[0])), (None, " ".join(texts[1])), (None, " ".join(texts[1])), (1, " ".join(texts[2]))]
    rows += [(None, prose(60, 2)), (None, prose(60, 2) + " tail")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id LONG, text STRING"), 3, Fraction(97, 100)).collect()
    assert {r.component_id for r in got if r.n_shingles == 98} == {0} and len([r for r in got if r.component_id is None]) == 2


def test_near_duplicates_are_judged_by_row(spark):
    """Null and repeated ids: of each group one row stays, and texts of one id in different groups all do."""
    a, b, c, d = (prose(60, i) for i in range(4))
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (None, d), (None, d), (None, d + " end"), (None, c), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=repr)
    assert [k for k in kept if k[0] is not None] == [(1, a), (2, b), (3, c), (5, None), (5, None)]
    assert len(kept) == 6 and {t for i, t in kept if i is None} <= {d, d + " end"}


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(5)
    got = components(edges.unionByName(spark.createDataFrame([(900, 901), (901, 900), (7, 7)], "a LONG, b LONG"))).collect()
    assert {r.root for r in got} == {0, 900} and len(got) == 303


# ---- repeated passages


def test_repeats_equal_brute_force(spark, odd, empty):
    passage, short = prose(70, 900), prose(49, 901)
    texts = [prose(100, i) for i in range(12)]
    texts += [f"{prose(13 + i, 50 + i)} {passage} {prose(9, 70 + i)}" for i in range(4)]
    texts += [f"{prose(8, 90 + i)} {short} {prose(30, 99 + i)}" for i in range(3)]
    exact = prose(50, 902)
    texts += [exact + " tail", "head " + exact, passage, texts[2], texts[2], " ".join(texts[5].split()[20:95]) + " new words"]
    got = suffixes.repeats(frame(spark, texts)).collect()
    words = {i: [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", x)] for i, x in enumerate(texts)}
    holders = defaultdict(set)
    for i, m in words.items():
        for p in range(len(m) - 49):
            holders[tuple(w for _, _, w in m[p : p + 50])].add(i)
    want, later = defaultdict(set), defaultdict(set)
    for i, m in words.items():
        for p in range(len(m) - 49):
            own = holders[tuple(w for _, _, w in m[p : p + 50])]
            if len(own) > 1:
                want[i].update(range(p, p + 50))
                if min(own) < i:
                    later[i].update(range(p, p + 50))
    found, cut = defaultdict(set), defaultdict(set)
    for r in got:
        inside = {k for k, (a, b, _) in enumerate(words[r.doc_id]) if a >= r.start and b <= r.end}
        assert len(inside) == r.n_words and r.other_doc_id != r.doc_id
        found[r.doc_id] |= inside
        if not r.is_first:
            cut[r.doc_id] |= inside
    assert {i: s for i, s in found.items() if s} == {i: s for i, s in want.items() if s}
    assert {i: s for i, s in cut.items() if s} == {i: s for i, s in later.items() if s}
    kept = {r.doc_id: r.text for r in suffixes.cut_repeats(frame(spark, texts)).collect()}
    assert passage in kept[12] and passage not in kept[13] and kept[0] == texts[0] and kept[16] == texts[16]
    assert 21 not in kept and 22 not in kept and 23 not in kept and short in kept[18]
    assert suffixes.repeats(odd).count() >= 0 and suffixes.repeats(empty).count() == 0
    back = suffixes.cut_repeats(odd)
    assert back.columns == odd.columns and back.filter("text IS NULL").count() == 2


def test_repeats_of_documents_without_an_id(spark):
    passage = prose(70, 900)
    texts = [f"{prose(13, 50 + i)} {passage} {prose(9, 70 + i)}" for i in range(6)]
    for key in (None, 3):
        docs = spark.createDataFrame([(key, t) for t in texts], "doc_id LONG, text STRING").repartition(6)
        assert sum(passage in r.text for r in suffixes.cut_repeats(docs).collect()) == 1
        assert sum(r.is_first for r in suffixes.repeats(docs).collect()) == 1


# ---- vectors

VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, score DOUBLE, list INT"
ODD_VECTORS = [
    (900, None, 1, 0.0, 1), (901, [], 1, 0.0, 1), (902, [0.0] * 16, 1, 0.0, 1), (903, [float("nan")] + [1.0] * 15, 1, 0.0, 1),
    (904, [float("inf")] + [1.0] * 15, 1, 0.0, 1), (905, [None] + [1.0] * 15, 1, 0.0, 1), (906, [1.0] * 16, None, 0.0, 1),
    (907, [1.0] * 16, None, 0.0, 1), (908, [1.0, 2.0], 1, 0.0, 1),
]


def vectors(seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((300, 16))
    near = x[r.integers(0, 40, 200)] + 0.05 * r.standard_normal((200, 16))
    x = np.concatenate([x, near, x[:5], 3 * x[5:8]]).astype(np.float32)
    return x, np.concatenate([r.integers(0, 3, 500), np.zeros(8, int)])


def test_quantised_links_equal_brute_force(spark):
    x, label = vectors()
    label[500:505] = label[:5]
    rows = [(i, v.tolist(), int(c), 0.0, 1) for i, (v, c) in enumerate(zip(x, label))]
    got = {r.vec_id: r for r in product.near_duplicates(spark.createDataFrame(rows + ODD_VECTORS, VECTORS), block=50).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(links, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        after = [min([root[i], *(root[j] for j in np.flatnonzero(links[i]))]) for i in range(len(x))]
        if after == root:
            break
        root = after
    assert links.sum() > 100
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= links.sum() and found >= 0.99 * links.sum()
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.99
    assert all(got[v].n_links == 0 and got[v].component_id == v and got[v].kept for v in range(900, 909))
    none = spark.createDataFrame([], VECTORS)
    assert product.near_duplicates(none).count() == 0


def test_quantised_links_across_borders(spark):
    """A circle is all borders: every link counts, from both sides."""
    angle = np.random.default_rng(5).random(300) * 2 * np.pi
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    rows = [(i, v.tolist(), 1, 0.0, 1) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in product.near_duplicates(spark.createDataFrame(rows, VECTORS.replace("FLOAT", "DOUBLE"))).collect()}
    links = (x @ x.T >= 0.98).sum(1) - 1
    assert [got[i] for i in range(300)] == links.tolist()


def test_nearest_equal_brute_force(spark):
    x, label = vectors(1)
    rows = [(i, v.tolist(), int(c), 0.0, 1) for i, (v, c) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows + rows[:3] + ODD_VECTORS, VECTORS)
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0, block=100, queries=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(float)
    norm = np.sqrt((y * y).sum(1))
    right = total = 0
    for q in range(0, len(x), 50):
        cos = (y * y[q]).sum(1) / (norm * norm[q])
        cos[q] = -2
        want = np.lexsort((np.arange(len(x)), -cos))[:5].tolist()
        right += len(set(want) & {v for v, _ in got[q]})
        total += 5
        assert all(abs(s - cos[v]) < 1e-12 for v, s in got[q]) and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert right >= 0.9 * total and (950 not in got)
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0, 1), (1, [1.0, 0.0], 1, 0.0, 1), (2, [1.0, 0.0], 1, 0.0, 1)], VECTORS)
    assert [(r.rank, r.vec_id) for r in neighbours.nearest_neighbours(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert neighbours.nearest_neighbours(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_chi_square():
    assert abs(neighbours.chi_square(15.507, 8) - 0.95) < 1e-4 and abs(neighbours.quantile(0.95, 8) - 15.507) < 1e-2


# ---- pipeline


def test_pipeline_stages(spark, odd, empty):
    same, passage = prose(120, 1), prose(60, 2)
    texts = [same, same, edited(same, 0.01, 3), f"{prose(40, 4)} {passage}", f"{prose(50, 5)} {passage} mail me@mail.example.com now", "12 34", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.0, "x", 1) for i, t in enumerate(texts)], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4} and kept.columns == docs.columns
    kept = stages["near_duplicates"](spark, kept, "")
    assert {r.doc_id for r in kept.collect()} == {0, 3, 4} and kept.columns == docs.columns
    kept = stages["repeated_passages"](spark, kept, "")
    out = {r.doc_id: r for r in kept.collect()}
    assert passage in out[3].text and passage not in out[4].text and out[4].n_chars == len(out[4].text) and out[0].text == same
    out = {r.doc_id: r for r in stages["personal_data"](spark, kept, "").collect()}
    assert "[EMAIL]" in out[4].text and out[3].text == texts[3]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
        got = stage(spark, odd, "")
        assert got.count() > 0 and (name == "packing" or got.columns == odd.columns)


def test_stages_keep_columns_with_their_own_names(spark, odd):
    passage = prose(60, 2)
    texts = [f"{prose(40, 4)} {passage}", f"{prose(50, 5)} {passage} mail me@mail.example.com now", prose(80, 6), prose(80, 6) + " end"]
    docs = with_own_names(spark.createDataFrame([(100 + i, t, "en") for i, t in enumerate(texts)], "doc_id LONG, text STRING, lang STRING"))
    docs = docs.unionByName(with_own_names(odd)).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and got.count() > 0, name
        wrong = got.filter(" OR ".join(f"NOT {n} <=> concat_ws(':', '{n}', doc_id)" for n in OWN))
        assert wrong.count() == 0, name
    for stage in (packing.pack, jaccard.jaccard_components, suffixes.repeats, pii.detect):
        given = (docs, tokenizer_path("byte_bpe_50k.json")) if stage is packing.pack else (docs,)
        assert stage(*given).count() > 0
