r"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, IP addresses, card and phone numbers, found by patterns. A term (a word) discloses an
entity if the corpus shows that it nearly gives it away: with p over all documents,

    PMI(entity, term) = log(p(entity, term) / (p(entity) p(term)))  >=  IC(entity) / alpha,  and > 0,   IC(entity) = -log p(entity)

where a term goes with an entity if both stand in one document, however far apart, and at least `support` different texts
hold both (so copies of one text count once), or the term stands within `reach` words of the entity in that many
different surroundings. A disclosing term is found wherever it stands in a text that holds its entity. Entities are generalised to
their kind, disclosing terms to their class: a number to `[NUMBER]`, a word with a capital to `[NAME]`; other terms are removed.

All counts are exact and cover all documents. Texts are not shuffled to find entities; only those that hold an entity seen in
several texts or surroundings are read again, joined by their key. Entities and terms travel as hashes. As
p(entity, term) <= p(entity), a term in more than N (n_entity / N) ** (1 / alpha) of N documents cannot pass; a table of fixed size keeps
such pairs from being listed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import blocks, chunks, gc_rarely, numbered, texts, written

KINDS = ("email", "ip", "card", "phone")
CACHED = 400_000
SENT = 100_000
#: Cells of the table that keeps most other pairs out of the counts, and least size of the filter of words; fixed, whatever the data.
FILTER_BITS = 1 << 20
#: Bits per candidate term of the filter of words, and the most it has (2 MB): as many other words pass for each candidate, however many there are.
TERM_BITS, MOST_BITS = 64, 1 << 24
#: Steps per doubling of a count in such a cell.
STEPS = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start inside a run of digits fails if the start of the run does, so only the starts of runs are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"\w+")
_GAP = re.compile(r"(\s+)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of `local+@domain`, in linear time: from each @ back to the start of its run."""
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            over = found.end()
            yield start, over
            at = text.find("@", over)
        else:
            over = at + 1
            at = text.find("@", over)


def find_entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _entity(kind: int, text: str) -> int:
    """One value, however it is written."""
    return _hash(f"{KINDS[kind]}:{_digits(text) if kind > 1 else text.lower()}")


def _surroundings(text: str, spans: list[tuple[int, int, int]], reach: int) -> list[dict]:
    """The terms within `reach` words (and 64 times as many characters) of each entity that lie in no entity.

    `context` names the surrounding. Terms farther off are found by `_terms`, in texts that may have some.
    """
    taken = sorted((a, b) for a, _, b in spans)
    words, upto, i = [], 0, 0
    # the windows of entities that stand close together are read once
    for a, b in taken:
        first, last = max(0, a - 64 * reach), b + 64 * reach
        before, behind = _GAP.split(text[first:a]), _GAP.split(text[b:last])
        low = a - sum(map(len, before[-2 * reach - 1 :]))
        high = b + sum(map(len, behind[: 2 * reach + 1]))
        low = max(low, upto)
        if low < high:
            words += [(m.start(), m.end()) for m in _TERM.finditer(text, low, high)]
            upto = max(upto, words[-1][1] if words else 0, low)
    kept = []
    for s, e in words:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if not any(a < e and s < b for a, b in taken[max(0, i - 1) : i + 4]):
            kept.append((s, e))
    starts = np.array([s for s, _ in kept], dtype=np.int64)
    out = []
    for a, kind, b in spans:
        at = int(np.searchsorted(starts, a))
        terms = [text[s:e] for s, e in kept[max(0, at - reach) : at + reach]]
        context = _hash(" ".join(terms).lower())
        out += [{"entity": _entity(kind, text[a:b]), "term": _hash(term.lower()), "context": context} for term in terms]
    return out


def _terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, word) of all words of a text that lie in none of its entities."""
    taken: list[list[int]] = []
    for a, _, b in spans:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    i = 0
    for m in _TERM.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i == len(taken) or e <= taken[i][0]:
            yield s, e, m[0].lower()


def _fingerprint(text: str) -> str:
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def find_spans(docs: DataFrame, reach: int = 6) -> DataFrame:
    """doc_id, text -> doc_id, text_key, base (array of start, kind, end), entities, near (terms around entities)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            keys, base, held, near = [], [], [], []
            for text in texts(block):
                spans = find_entities(text)
                keys.append(_fingerprint(text) if spans else None)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                held.append(list({_entity(k, text[a:b]) for a, k, b in spans}))
                near.append(_surroundings(text, spans, reach) if spans else [])
            columns = zip((keys, base, held, near), (f.type for f in list(shape)[1:]))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(c, t) for c, t in columns)], names=shape.names)

    long, whole = pa.int64(), pa.int32()
    shape = pa.schema(
        [
            ("doc_id", long),
            ("text_key", pa.string()),
            ("base", pa.list_(pa.struct([("start", long), ("kind", whole), ("end", long)]))),
            ("entities", pa.list_(long)),
            ("near", pa.list_(pa.struct([("entity", long), ("term", long), ("context", long)]))),
        ]
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, text_key string, base array<struct<start:long,kind:int,end:long>>,"
        " entities array<long>, near array<struct<entity:long,term:long,context:long>>",
    )


def _term_filter(terms: DataFrame) -> bytes:
    """A bit for each `term`, by its hash; other terms share few of them."""
    terms = written(terms.select("term").distinct(), "terms")
    size, least = FILTER_BITS, min(MOST_BITS, terms.count() * TERM_BITS)
    while size < least:
        size *= 2
    at = terms.select(F.pmod("term", F.lit(size)).cast("int").alias("bit"))
    found = at.groupBy(F.expr("bit >> 3").alias("at")).agg(F.bit_or(F.expr("1 << (bit & 7)")).alias("x")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    bits[found.column("at").to_numpy()] = found.column("x").to_numpy()
    return bits.tobytes()


def _counted(docs: DataFrame, bits: bytes) -> DataFrame:
    """term, n_term: documents that hold each candidate term (and some others that the filter lets through)."""
    return _term_rows(docs, bits).groupBy("term").agg(F.sum("n").alias("n_term"))


def _term_rows(docs: DataFrame, bits: bytes) -> DataFrame:
    """term, n: the same, combined within each task."""
    size = 8 * len(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc_rarely()
        known: dict[str, tuple] = {}
        counts: Counter = Counter()

        def found(part: str) -> tuple:
            hashes = map(_hash, [part.lower()] if part.isalpha() else [w.lower() for w in _TERM.findall(part)])
            return tuple(h for h in hashes if bits[h % size >> 3] >> (h & 7) & 1)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

        for block in blocks(batches):
            cut = [chunks(t) for t in texts(block)]
            if len(known) > CACHED:
                known.clear()
            known.update((p, found(p)) for p in {p for c in cut for p in filterfalse(known.__contains__, c)})
            get = known.__getitem__
            for c in cut:
                counts.update({h for own in filter(None, map(get, c)) for h in own})
            if len(counts) > SENT:
                yield out()
                counts.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "term long, n long")


def _keyed(docs: DataFrame) -> DataFrame:
    """text_key, text of the rows whose text can hold an entity."""
    return docs.filter(F.col("text").rlike("[0-9@]")).select(F.md5(F.col("text").cast("binary")).alias("text_key"), "text")


def _each_text(keyed: DataFrame, column: str, run: Callable[[str, list], Iterator[tuple]], names: list[str]) -> DataFrame:
    """text_key, n, then the columns (longs) that `run` gives arrays of; n counts rows with that text in a block, which are read once.

    run: text, value of `column` -> arrays of equal length, again and again.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in list(zip(*parts))[2:]]
            sizes = [len(p[2]) for p in parts]
            key, n = (np.repeat(np.array(c, t), sizes) for c, t in zip(list(zip(*parts))[:2], (object, np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), *map(pa.array, (n, *columns))], names=["text_key", "n", *names])

        for block in blocks(batches):
            keys = block.column("text_key").to_pylist()
            copies = Counter(keys)
            for key, text, own in zip(keys, block.column("text").to_pylist(), block.column(column).to_pylist()):
                for arrays in run(text, own) if (n := copies.pop(key, 0)) else ():
                    parts.append([key, n, *arrays])
                    held += len(arrays[0])
                    if held > SENT:
                        yield out()
                        parts, held = [], 0
        if held:
            yield out()

    return keyed.select("text_key", "text", column).mapInArrow(rows, "text_key string, n long" + "".join(f", {c} long" for c in names))


def _candidates(docs: DataFrame, held: DataFrame, live: DataFrame, total: int, alpha: float) -> tuple[DataFrame, DataFrame]:
    """(candidates, counts): text_key, n, held, term - terms of whole texts that may pass with a group of entities there.

    counts: term, n_live - documents with a live entity that hold the term, at most n_term.
    """
    groups = held.select("text_key", F.explode("entities").alias("entity")).join(live, "entity").select("text_key", "held", "n_entity").distinct()
    wanted = written(groups.groupBy("text_key").agg(F.collect_list(F.struct("held", "n_entity")).alias("live")), "wanted")
    keyed = _keyed(docs).join(wanted, "text_key")
    counts = written(_counted(keyed, b"\xff").withColumnRenamed("n_term", "n_live"), "counts")
    least = counts.groupBy(F.pmod("term", F.lit(FILTER_BITS)).alias("cell")).agg(F.min("n_live").alias("n")).toArrow()
    # the least count of a cell's terms, rounded down: a pair that is left out cannot pass
    rare = np.zeros(FILTER_BITS, np.uint8)
    rare[least.column("cell").to_numpy()] = np.floor(STEPS * np.log2(least.column("n").to_numpy()))
    packed = rare.tobytes()

    def pairs(text: str, own: list) -> Iterator[tuple]:
        levels = np.frombuffer(packed, np.uint8)
        terms = np.array(list({_hash(w) for _, _, w in _terms(text, find_entities(text))}), np.int64)
        level = levels[terms % FILTER_BITS]
        for e in own:
            some = terms[level <= STEPS * np.log2(total * (e["n_entity"] / total) ** (1 / alpha)) + 1e-6]
            yield np.full(len(some), e["held"], np.int64), some

    return written(_each_text(keyed, "live", pairs, ["held", "term"]), "candidates"), counts


def term_spans(docs: DataFrame, spans: DataFrame, alpha: float = 1.25, support: int = 2) -> DataFrame:
    """text_key, terms: every place of a term that discloses an entity of the text (start, kind 4, end); one row per text.

    Entities that the same texts hold (a list of addresses, say) have the same counts with every term, and what one of them
    marks is marked for all: such a group, named by a hash of its texts, is counted as one.
    """
    held = spans.filter("text_key IS NOT NULL")
    near = (
        held.select(F.explode("near").alias("x")).groupBy("x.entity", "x.term").agg(F.count_distinct("x.context").alias("contexts"))
        .filter(F.col("contexts") >= support)
    )
    near = written(near.select("entity", "term", F.lit(True).alias("near")), "near")
    # an entity of one text, with no term in several surroundings, has no pair
    marks = [F.xxhash64("text_key", F.lit(i)) for i in (1, 2)]
    live = (
        held.select("text_key", F.explode("entities").alias("entity")).groupBy("entity", "text_key").agg(F.count("*").alias("n"))
        .groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"), *(F.bit_xor(m).alias(f"x{i}") for i, m in enumerate(marks)))
        .join(near.select("entity").distinct().withColumn("near", F.lit(True)), "entity", "left").filter((F.col("texts") >= support) | F.col("near"))
    )
    live = written(live.select("entity", "n_entity", F.xxhash64("texts", "x0", "x1").alias("held")), "live")
    near = near.join(live, "entity").select("held", "term", "near").distinct()
    total = docs.count()
    candidates, counts = _candidates(docs, held, live, max(total, 1), alpha)
    n = F.col
    least = -F.log(n("n_entity") / total) / alpha

    def pmi(term: str) -> F.Column:
        return F.log(n("n_both") * total / (n("n_entity") * n(term)))

    pairs = written(
        candidates.groupBy("held", "term", "text_key").agg(F.sum("n").alias("n"))
        .groupBy("held", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"))
        .join(near, ["held", "term"], "left").filter((n("texts") >= support) | n("near"))
        .join(live.select("held", "n_entity").distinct(), "held").join(counts, "term").filter(pmi("n_live") >= least - 1e-9)
        .select("held", "term", "n_both", "n_entity"),
        "pairs",
    )
    scored = pairs.join(_counted(docs, _term_filter(pairs)), "term")
    # a term that is independent of an entity in every document (IC 0) tells nothing of it
    passed = scored.filter((pmi("n_term") >= least) & (pmi("n_term") > 0)).select("held", "term")
    found = written(candidates.join(passed, ["held", "term"]).groupBy("text_key").agg(F.collect_set("term").alias("own")), "found")

    def found_at(text: str, own: list) -> Iterator[tuple]:
        wanted = set(own)
        at = np.array([(s, e) for s, e, w in _terms(text, find_entities(text)) if _hash(w) in wanted], np.int64).reshape(-1, 2)
        yield at[:, 0], at[:, 1]

    at = F.struct("start", F.lit(4).alias("kind"), "end")
    return _each_text(_keyed(docs).join(found, "text_key"), "own", found_at, ["start", "end"]).groupBy("text_key").agg(F.collect_set(at).alias("terms"))


def _spans(base: F.Column, terms: F.Column) -> F.Column:
    """All spans in order: struct of start, kind number, end."""
    return F.array_sort(F.concat(base, terms))


def detect(docs: DataFrame, reach: int = 6, alpha: float = 1.25, support: int = 2) -> DataFrame:
    """One row per document: doc_id, text_key, base, all_spans (start, kind, end; kind 4 is a disclosing term).

    Null text is empty and has no spans. Rows with equal or null doc_id are documents of their own; an
    empty table gives no rows. text_key is null where there is no entity.
    """
    spans = written(find_spans(docs, reach), "spans")
    terms = term_spans(docs, spans, alpha, support)
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    # rows without entities share the null key, so they stay out of the join
    held = spans.filter("text_key IS NOT NULL").join(terms, "text_key", "left")
    held = held.select("doc_id", "text_key", "base", _spans(F.col("base"), F.coalesce("terms", none)).alias("all_spans"))
    return held.unionByName(spans.filter("text_key IS NULL").select("doc_id", "text_key", "base", F.col("base").alias("all_spans")))


def described(spans: F.Column) -> F.Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sanitise_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """spans: (start, kind, end) in order. Overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out.append(text[at:start])
            if kind < 4:
                out.append(f"[{KINDS[kind].upper()}]")
            else:
                term = text[start:end]
                out.append("[NUMBER]" if _DIGIT.search(term) else "[NAME]" if term[:1].isupper() else "")
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, reach: int = 6, alpha: float = 1.25, support: int = 2) -> DataFrame:
    """The rows of `docs` with their texts sanitised; all other columns stay as they are, whatever their names; null text stays null."""
    spans = written(find_spans(docs.select("doc_id", "text"), reach), "spans")
    terms = written(term_spans(docs, spans, alpha, support).withColumnRenamed("terms", "_terms"), "terms")
    schema = docs.schema
    rows, names = numbered(docs)
    text = F.col(names["text"])
    keyed = rows.withColumn("_key", F.when(text.rlike("[0-9@]"), F.md5(text.cast("binary"))))
    # texts that can hold no entity share the null key, so they stay out of the join
    joined = keyed.filter("_key IS NOT NULL").join(terms.withColumnRenamed("text_key", "_key"), "_key", "left")
    plain = keyed.filter("_key IS NULL").withColumn("_terms", F.lit(None).cast(terms.schema["_terms"].dataType))
    keyed = joined.unionByName(plain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out = []
            for text, own in zip(block.column(names["text"]).to_pylist(), block.column("_terms").to_pylist()):
                spans = find_entities(text) if text else []
                if spans:
                    spans = sorted([*spans, *((t["start"], t["kind"], t["end"]) for t in own or ())])
                    text = sanitise_text(text, spans)
                out.append(text)
            columns = [pa.array(out, pa.string()) if c == "text" else block.column(n) for c, n in names.items()]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return keyed.mapInArrow(run, schema)
