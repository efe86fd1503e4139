"""Shared helpers: tables in the shared folder, blocks of texts, words, connected components."""

from __future__ import annotations

import gc
import os
import pathlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only in local runs and tests a temporary folder of this machine stands in where that is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there.

    Checkpointing an RDD computes it twice, a table is written once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once per session, unless they find it by their path."""
    root = pathlib.Path(__file__).parents[2]
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in map(pathlib.Path, paths) or spark.conf.get("spark.tablescope.shipped", ""):
        return
    archive = pathlib.Path(tempfile.mkdtemp()) / "tablescope.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in [*(root / "tablescope").rglob("*.py"), *root.glob("corpus_pipeline.py")]:
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.conf.set("spark.tablescope.shipped", "true")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under the names c0, c1, ..., and the new name of each column: names that an operator adds cannot clash."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo `modulus`, is `remainder`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def blocks(batches: Iterable[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut into blocks of few rows, so that a task holds few whole texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(block: pa.RecordBatch, column: str = "text") -> list[str]:
    """The block's texts; null is empty."""
    return [t or "" for t in block.column(column).to_pylist()]


_BEFORE_WORD = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?:\s|$)")


def chunks(text: str) -> list[str]:
    """Parts of a text, cut before each space that a non-space follows; that space is left out.

    Patterns that attach one space to the word behind it always start a match there, so
    the parts (each but the first with its space again) can be encoded separately.
    """
    return _BEFORE_WORD.split(text) if _ODD_SPACE.search(text) else text.split(" ")


_TOOL: dict[tuple, object] = {}


def remembered(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, kept by a Python worker beyond its task, until another tool takes its place."""
    if key not in _TOOL:
        made = make()
        _TOOL.clear()
        _TOOL[key] = made
    return _TOOL[key]


def gc_rarely() -> None:
    """Remembered values hold no cycles; looking for some again and again costs a third of the time.

    Called where a tool starts: what an earlier stage's tool remembered in this worker goes first.
    """
    if _TOOL:
        _TOOL.clear()
        gc.unfreeze()
    gc.collect()  # garbage would be frozen for good
    gc.freeze()
    gc.set_threshold(1_000_000, 50, 100)


class Parts:
    """Values (ids, say) of the parts of texts, for encoders that work match by match of a pattern.

    A run of letters with its space is one match, and so is the run of marks that ends it; other parts are
    cut by `find`. `encode` gives the values of many matches, `join` the value of their concatenation.
    Values seen lately are remembered, `limit` at most.
    """

    MARKS = ".,;:!?"

    def __init__(self, find: Callable, encode: Callable, join: Callable, limit: int) -> None:
        gc_rarely()
        self.find, self.encode, self.join, self.limit = find, encode, join, limit
        self.parts: dict = {}  # by the part without its space
        self.pieces: dict = {}  # by the match as it stands

    def values(self, some: list[str]) -> list[list]:
        """Per text, the values of its non-empty parts."""
        cut = [chunks(t) for t in some]
        if len(self.parts) > self.limit:
            self.parts.clear()
        if len(self.pieces) > self.limit // 4:
            self.pieces.clear()
        known, seen = self.parts.__contains__, self.pieces.__contains__
        words, ended, rest = set(), [], {}
        for p in {p for c in cut for p in filterfalse(known, c[1:])}:
            if p.isalpha():
                words.add(p)
            elif (stem := p.rstrip(self.MARKS)).isalpha():
                ended.append((p, stem, p[len(stem) :]))
                if stem not in self.parts:
                    words.add(stem)
            else:
                rest[p] = self.find(" " + p)
        heads = [self.find(c[0]) for c in cut]
        new = {m for found in (*heads, *rest.values()) for m in filterfalse(seen, found)}
        new.update(m for _, _, m in ended if m not in self.pieces)
        words, new = list(words), list(new)
        self.parts.update(zip(words, self.encode([" " + w for w in words])))
        self.pieces.update(zip(new, self.encode(new)))
        part, piece, join = self.parts.__getitem__, self.pieces.__getitem__, self.join
        self.parts.update([(p, join((part(stem), piece(m)))) for p, stem, m in ended])
        self.parts.update([(p, join(map(piece, found))) for p, found in rest.items()])
        return [[*map(piece, h), *map(part, c[1:])] for h, c in zip(heads, cut)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain splitmix64 constants) over an unsigned array."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) longs: (node, root), root the smallest node of the component.

    Rounds of large-star and small-star: every node is linked to its smallest neighbour, first
    the larger neighbours, then the smaller ones. Each round is a few aggregations whose
    partial results combine before the shuffle, written to the shared folder; the number of
    rounds is logarithmic in the longest path. Nodes without an edge are left out.
    """
    pairs = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        after = written(small.distinct(), "edges")
        # stable once every edge leads from a node straight to a root
        unsettled = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        pairs = after
        if not unsettled and not after.groupBy("a").count().filter("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; the package is installed on every machine."""
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path(name))
