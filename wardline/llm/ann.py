"""Nearest neighbours by inner product: 2-stable projections, a kd-tree over them, and a chi-square stopping test.

Largest inner product becomes nearest Euclidean neighbour by one more coordinate (what the squared norm lacks to
the largest one), since then |x - q|^2 = M^2 + |q|^2 - 2 x.q. A Gaussian projection to ``m`` dimensions turns a
distance d into d times the root of a chi-square variable with m degrees of freedom. Points are visited in order
of projected distance r and verified exactly; once r^2 / d_k^2 exceeds the chi-square quantile of ``confidence``,
with d_k the k-th best distance so far, a nearer point lies further on with probability 1 - ``confidence`` at most,
and the search stops.

The upper part of the kd-tree deals the points to cells. It is fitted on at most ``sample_rows`` projected points
(chosen by a hash of the id); every point is indexed. A cell is dealt on to blocks of about ``block_rows`` points,
by hash, so a cell full of copies is no larger task than another. Each block builds the lower part of the tree.
Two rounds: a query first searches its nearest cell, then, with the k-th distance found there, all other cells
whose box the stopping test does not rule out.

Defined results: null, empty and zero vectors and those with null or non-finite components take no part, nor do
rows without id; of rows with one id the smallest vector counts; vectors meet only vectors of their own length;
ties go to the smaller id; an empty table gives an empty result; other columns are ignored. Where a component is so
large that squares leave the range of doubles, all vectors are searched scaled by one power of two: order and scores stay
exact (a score beyond the range is infinite), but products of components 10^300 times smaller count as zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.llm.common import keep

FOUND = "query_id long, vec_id long, score double"
SLACK = 1e-9
LARGEST = 2.0**460  # of a component; squares of vectors up to this fit a double


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""
    if m % 2:
        raise ValueError("the number of projections must be even")

    def below(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(m // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(length: int, m: int, seed: int) -> np.ndarray:
    """Gaussian matrix for vectors of ``length`` components and the added one; the same in every task."""
    return np.random.default_rng([seed, length]).standard_normal((length + 1, m))


def split_tree(points: np.ndarray, size: int) -> list[tuple]:
    """kd-tree as a list of (axis, value, left, right), or (-1, leaf number); halves the widest axis down to ``size``."""
    nodes: list[tuple] = []

    def grow(index: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(())
        part = points[index]
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        axis = int(spread.argmax())
        value = float(np.median(part[:, axis])) if len(part) else 0.0
        left = part[:, axis] < value if len(part) else np.zeros(0, dtype=bool)
        if len(index) <= size or not left.any() or left.all():
            nodes[at] = (-1, sum(n[0] == -1 for n in nodes if n))
        else:
            nodes[at] = (axis, value, grow(index[left]), grow(index[~left]))
        return at

    grow(np.arange(len(points)))
    return nodes


def leaf_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int32)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, index = todo.pop()
        node = nodes[at]
        if node[0] == -1:
            out[index] = node[1]
        elif len(index):
            left = points[index, node[0]] < node[1]
            todo += [(node[2], index[left]), (node[3], index[~left])]
    return out


def gap(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance from a point to each box."""
    return (np.maximum(0, np.maximum(low - point, point - high)) ** 2).sum(axis=-1)


def search_block(ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, queries: pd.DataFrame, k: int, limit: float, top: float, leaf: int) -> pd.DataFrame:
    """Best ``k`` of one block for each query; ``bound`` is the k-th score a query has from elsewhere."""
    leaves = leaf_of(split_tree(points, leaf), points)
    order = np.lexsort((ids, leaves))
    ids, vectors, points, leaves = ids[order], vectors[order], points[order], leaves[order]
    starts = np.flatnonzero(np.r_[True, leaves[1:] != leaves[:-1]])
    ends = np.r_[starts[1:], len(ids)]
    low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
    out = []
    for query_id, q, p, bound in zip(queries["query_id"], queries["v"], queries["p"], queries["bound"], strict=True):
        q = np.asarray(q, dtype=np.float64)
        far = top + float(q @ q)
        reach = gap(low, high, np.asarray(p, dtype=np.float64))
        best_score, best_id = np.zeros(0), np.zeros(0, dtype=np.int64)
        for at in np.argsort(reach, kind="stable"):
            if reach[at] > limit * max(0.0, far - 2 * bound) + SLACK:
                break
            span = slice(starts[at], ends[at])
            score = np.einsum("ij,j->i", vectors[span], q)
            near = (score >= bound) & (ids[span] != query_id)
            if not near.any():
                continue
            best_score, best_id = np.r_[best_score, score[near]], np.r_[best_id, ids[span][near]]
            if len(best_id) > k:
                first = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[first], best_id[first]
            if len(best_id) == k:
                bound = max(bound, best_score.min())
        out.append(pd.DataFrame({"query_id": np.int64(query_id), "vec_id": best_id, "score": best_score}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy(F.col(id_column).cast("long").alias("vec_id")).agg(F.min(v).alias("v"))


def _search(points: DataFrame, routed: DataFrame, sizes: DataFrame, k: int, limit: float, top: float, query_rows: int, leaf: int) -> DataFrame:
    """Search of ``routed`` (query and cell) in the blocks of the cells; crowded cells are searched by parts of the queries."""
    asked = routed.groupBy("cell", "length").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))
    shape = sizes.join(asked, ["cell", "length"])
    data = points.join(F.broadcast(shape), ["cell", "length"])
    data = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    there = routed.join(F.broadcast(shape), ["cell", "length"])
    there = there.withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        found = search_block(left["vec_id"].to_numpy(), np.stack(left["v"]), np.stack(left["p"]), right, k, limit, top, leaf)
        return found.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    key = ["cell", "length", "block", "part"]
    return data.select(*key, "vec_id", "v", "p").groupBy(*key).cogroup(there.select(*key, "query_id", "v", "p", "bound").groupBy(*key)).applyInPandas(meet, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, m: int = 8, confidence: float = 0.97, seed: int = 42,
    sample_rows: int = 20_000, cell_rows: int = 4_096, most_cells: int = 1_024, block_rows: int = 8_192, query_rows: int = 2_048, leaf: int = 128,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products of each query, found approximately.

    ``is_query`` is a condition on ``vec_id``. What the driver holds is bounded by the parameters: the sample, and a
    box for each of ``most_cells`` cells. Blocks and parts of queries bound what a task holds.
    """
    usable = keep(_usable(vectors, id_column, vector_column))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    widest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    top, largest, n = usable.agg(F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(widest), F.lit(0.0)), F.count("*")).first()
    shrink = 0 if largest <= LARGEST else math.frexp(largest)[1] - math.frexp(LARGEST)[1]
    if shrink:  # by a power of two, which rounds nothing
        usable = keep(usable.withColumn("v", F.transform("v", lambda x: x * F.lit(2.0**-shrink))))
        top = usable.agg(F.max(square)).first()[0]

    def project(batches: Iterator[pd.DataFrame], own: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["v"].map(len).to_numpy()
            p = np.zeros((len(batch), m))
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                x = np.stack(batch["v"].iloc[rows]).astype(np.float64)
                lacking = np.sqrt(np.maximum(0, top - np.einsum("ij,ij->i", x, x))) if own else np.zeros(len(x))
                p[rows] = np.c_[x, lacking] @ projection(int(length), m, seed)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "length": lengths.astype(np.int32), "p": list(p)})

    shape = "vec_id long, v array<double>, length int, p array<double>"
    placed = usable.mapInPandas(lambda b: project(b, True), shape)
    picked = placed.select("vec_id", "p").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    sample = np.array([r.p for r in picked]).reshape(-1, m)
    cells = max(1, min(most_cells, math.ceil(n / cell_rows)))
    tree = split_tree(sample, max(1, math.ceil(len(sample) / cells)))

    @F.pandas_udf("int")
    def cell(points: pd.Series) -> pd.Series:
        return pd.Series(leaf_of(tree, np.stack(points)) if len(points) else np.zeros(0, dtype=np.int32))

    points = keep(placed.withColumn("cell", cell("p")))
    edges = [f(F.get("p", F.lit(i))).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(m)]
    boxes = points.groupBy("cell", "length").agg(F.count("*").alias("n"), *edges)
    held = boxes.collect()
    sizes = boxes.select("cell", "length", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for length in {r.length for r in held}:
        own = [r for r in held if r.length == length]
        corner = lambda name: np.array([[r[f"{name}{i}"] for i in range(m)] for r in own])  # noqa: B023, E731
        by_length[length] = (np.array([r.cell for r in own]), corner("low"), corner("high"))
    limit = chi_square_quantile(confidence, m)

    def route(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        """A query's nearest cell, or all others within reach of its k-th score."""
        for batch in batches:
            rows, where = [], []
            for i, (length, v, p, bound) in enumerate(zip(batch["length"], batch["v"], batch["p"], batch["bound"], strict=True)):
                names, low, high = by_length[length]
                far = gap(low, high, np.asarray(p))
                home = int(far.argmin())
                radius = limit * max(0.0, top + float(np.dot(v, v)) - 2 * bound) + SLACK
                to = [home] if first else [j for j in np.flatnonzero(far <= radius) if j != home]
                rows += [i] * len(to)
                where += [names[j] for j in to]
            yield batch.iloc[rows].assign(cell=np.array(where, dtype=np.int32))

    asked = "query_id long, v array<double>, length int, p array<double>, bound double"
    start = usable.where(is_query).mapInPandas(lambda b: project(b, False), shape)
    start = start.select(F.col("vec_id").alias("query_id"), "v", "length", "p", F.lit(float("-inf")).alias("bound"))
    to_home = keep(start.mapInPandas(lambda b: route(b, True), asked + ", cell int"))
    near = keep(_best(_search(points, to_home, sizes, k, limit, top, query_rows, leaf), k))
    bounds = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("bound"))
    narrowed = to_home.drop("bound", "cell").join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    to_rest = keep(narrowed.select("query_id", "v", "length", "p", "bound").mapInPandas(lambda b: route(b, False), asked + ", cell int"))
    rest = _search(points, to_rest, sizes, k, limit, top, query_rows, leaf)
    own = F.col("score") * F.lit(2.0**shrink) * F.lit(2.0**shrink)
    return _best(near.select("query_id", "vec_id", "score").unionByName(rest), k).select("query_id", F.col("rank").cast("int"), "vec_id", own.alias("score"))
