"""Near-duplicate vectors by product quantisation.

An inverted list per coarse centre; within a list a vector is a code: per subspace of its residual, the nearest
codeword. A query probes each list whose cell lies within `margin` of it, as a share of the distance that
still links (to the plane between its own centre and the list's), so there is no fixed number of probes, and at 1 no link is lost. In a list, the
distance from the query to each code is summed from tables. By the triangle inequality, a member whose code is farther than the linking
distance plus its own quantisation error cannot link; all others are compared exactly, by cosine in double precision.

Centres and codewords are fitted on at most `fit_rows` vectors; every vector is indexed. Equal vectors with equal labels
are one class. Long lists are cut into blocks, and so are their queries; a task sees one block of each and returns
counts and a forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import components, written
from tablescope.llm.vectors import PRODUCTS, cosines, kmeans, nearest, norms, sample, stacked, usable


@dataclass
class Quantiser:
    centres: np.ndarray
    cuts: list[int]  # borders of the subspaces
    words: list[np.ndarray]  # codewords per subspace


def fit(x: np.ndarray, lists: int, subspaces: int, words: int) -> Quantiser:
    centres = kmeans(x, lists, 8, 1)
    rest = x - centres[nearest(x, centres)]
    cuts = [round(i * x.shape[1] / subspaces) for i in range(subspaces + 1)]
    cuts = sorted(set(cuts))
    return Quantiser(centres, cuts, [kmeans(rest[:, a:b], words, 6, 2 + a) for a, b in zip(cuts, cuts[1:])])


def probes(x: np.ndarray, centres: np.ndarray, margin: float) -> list[np.ndarray]:
    """Per unit vector the lists whose cells lie within `margin` of it; its own list is first."""
    squares = ((centres * centres).sum(1) - 2 * x @ centres.T) + 1
    own = squares.argmin(1)
    between = {c: norms(centres - centres[c]) for c in np.unique(own)}
    out = []
    for i, c in enumerate(own):
        within = squares[i] - squares[i, c] <= 2 * margin * between[c] + 1e-9
        within[c] = False
        out.append(np.append(c, np.flatnonzero(within)))
    return out


def assign(classes: DataFrame, model: Quantiser, margin: float) -> DataFrame:
    """id, vector, ... -> lists (own list first), code, error."""

    step = max(1, min(4096, PRODUCTS // len(model.centres)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = np.array(part.column("vector").to_pylist(), dtype=np.float64)
                x /= norms(x)[:, None]
                lists = probes(x, model.centres, margin)
                rest = x - model.centres[[own[0] for own in lists]]
                codes, error = [], 0.0
                for (a, b), words in zip(zip(model.cuts, model.cuts[1:]), model.words):
                    code = nearest(rest[:, a:b], words)
                    codes.append(code)
                    error = error + ((rest[:, a:b] - words[code]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(lists, pa.list_(pa.int32())),
                        pa.array(list(np.stack(codes, 1).astype(np.int32)), pa.list_(pa.int32())),
                        pa.array(np.sqrt(error)),
                    ],
                    names=[*part.schema.names, "lists", "code", "error"],
                )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{schema}, lists array<int>, code array<int>, error double")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(left.tolist(), right.tolist()):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def near_duplicates(
    rows: DataFrame,
    least: float = 0.98,
    margin: float = 1.0,
    fit_rows: int = 20_000,
    subspaces: int = 8,
    words: int = 64,
    block: int = 2000,
) -> DataFrame:
    """vec_id, embedding, label -> vec_id, n_links, component_id, kept; one row per row.

    Vectors that are null, empty, zero or not finite, those without label, and rows without vec_id link with nothing: they
    are components of their own. Vectors of different length do not link. An empty table gives no rows.
    """
    fits = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = rows.select("vec_id", F.when(fits, F.col("embedding")).alias("vector"), F.when(fits, F.col("label")).alias("label"))
    classes = written(
        keyed.filter("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
        .select("id", "size", "label", F.col("vector").cast("array<double>").alias("vector")),
        "classes",
    )
    per_length = [r[0] for r in classes.select(F.size("vector")).distinct().collect()]
    found = None
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    for length in sorted(per_length):  # vectors of one table have one length; others are joined among themselves
        own = classes.filter(F.size("vector") == length)
        model = fit(sample(own, "id", "vector", fit_rows), math.isqrt(own.count()), min(subspaces, length), words)
        some = _links(written(assign(own, model, margin * reach), "codes"), model, least, reach, block)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return keyed.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    found = written(found, "links")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).toDF("id", "root")
    known = classes.select("id", "size", "label", F.col("vector").alias("_v")).join(counts, "id", "left").join(roots, "id", "left")
    known = known.select("label", "_v", F.coalesce("root", "id").alias("_root"), (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("_n"))
    # rows that take no part have no key to be joined by
    alone = keyed.filter("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("_n"), F.col("vec_id").alias("_root"))
    joined = keyed.filter("vector IS NOT NULL").withColumn("_v", F.col("vector").cast("array<double>")).join(known, ["label", "_v"], "left")
    joined = joined.select("vec_id", F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_root", "vec_id").alias("_root"))
    return joined.unionByName(alone).select(
        "vec_id", F.col("_n").cast("long").alias("n_links"), F.col("_root").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("_root")).alias("kept")
    )


def _links(coded: DataFrame, model: Quantiser, least: float, reach: float, block: int) -> DataFrame:
    """a, b, n: a forest of links (n null), and per block the size of what a query links to (b null)."""
    members = coded.withColumn("list", F.get("lists", F.lit(0)))
    queries = coded.withColumn("list", F.explode("lists"))
    key = ["label", "list"]
    sizes = (
        members.select(*key, F.lit(1).alias("m"), F.lit(0).alias("q")).unionByName(queries.select(*key, F.lit(0).alias("m"), F.lit(1).alias("q")))
        .groupBy(*key).agg(F.ceil(F.sum("m") / block).cast("long").alias("m"), F.ceil(F.sum("q") / block).cast("long").alias("q"))
        .filter("m > 0")
    )
    at = F.xxhash64("id")
    members = members.join(sizes, key).select(
        *key, F.pmod(at, "m").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("j"),
        F.lit(True).alias("member"), "id", "size", "vector", "code", "error",
    )
    queries = queries.join(sizes, key).select(
        *key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"), F.pmod(at, "q").alias("j"),
        F.lit(False).alias("member"), "id", "size", "vector", "code", "error",
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        member = pdf["member"].to_numpy(bool)
        inside, asking = pdf[member].sort_values("id"), pdf[~member].sort_values("id")
        none = pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "Int64"})
        if not len(inside) or not len(asking):
            return none
        y, x = stacked(inside["vector"]), stacked(asking["vector"])
        codes, error = np.stack(inside["code"].to_numpy()), inside["error"].to_numpy()
        rest = x / norms(x)[:, None] - model.centres[int(pdf["list"].iloc[0])]
        far = np.zeros((len(x), len(y)))
        for k, ((a, b), words) in enumerate(zip(zip(model.cuts, model.cuts[1:]), model.words)):
            table = ((rest[:, None, a:b] - words[None]) ** 2).sum(-1)
            far += table[:, codes[:, k]]
        q, m = np.nonzero(far <= (reach + error + 1e-9) ** 2)
        xid, yid = asking["id"].to_numpy(), inside["id"].to_numpy()
        own = xid[q] != yid[m]
        q, m = q[own], m[own]
        linked = np.concatenate([cosines(x[q[s : s + 50_000]], y[m[s : s + 50_000]]) >= least for s in range(0, len(q), 50_000)] or [np.zeros(0, bool)])
        q, m = q[linked], m[linked]
        if not len(q):
            return none
        counts = np.bincount(q, inside["size"].to_numpy()[m], len(x)).astype(np.int64)
        both, place = np.unique(np.concatenate([xid, yid]), return_inverse=True)
        tree = _forest(len(both), place[: len(x)][q], place[len(x) :][m])
        asked = np.flatnonzero(counts)
        return pd.DataFrame(
            {
                "a": np.concatenate([xid[asked], [both[i] for i, _ in tree]]).astype("int64"),
                "b": pd.array([None] * len(asked) + [both[j] for _, j in tree], dtype="Int64"),
                "n": pd.array(counts[asked].tolist() + [None] * len(tree), dtype="Int64"),
            }
        )

    return members.unionByName(queries).groupBy(*key, "i", "j").applyInPandas(run, "a long, b long, n long")
