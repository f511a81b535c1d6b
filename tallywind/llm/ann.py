"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the neighbour graph is cut into balanced parts (recursive bisection at the
median of the graph's slowest mode, then equal swaps that lower the cut), and a small network
learns, for each vector, the shares of its neighbours' parts. Every row is then indexed under
the part the network finds most probable; a query visits the most probable parts until they
make up a given probability, and all rows there are ranked by their exact distance.

Parts are stored in blocks of bounded size, queries of a part likewise, and block meets block in
a join on the part: a part that holds a third of all rows is many blocks, never one task.

Defined cases: vectors that are null, zero, of a length other than the most frequent one, or
that hold null or non-finite components take no part; equal rows count once; rows sharing a vec_id are one candidate,
at its nearest vector; equal distances go to the smaller vec_id; fewer than LEAST different vectors cannot be
parted and are one part; extra columns take no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_by_value, store

#: Vectors the parts and the network are learned from, at most: those with the smallest hashes.
SAMPLE = 8192
NEIGHBOURS = 12
#: Different vectors of the sample a part needs, and the two smallest parts together.
PER_PART, LEAST = 16, 32
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec: the components as doubles) of the rows that take part."""
    v = (vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
         .select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
         .filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)))
    v = v.distinct()
    length = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("vec") == (length["n"] if length else 0))


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Indices of the k nearest of each row of x, in blocks."""
    norms = (x * x).sum(axis=1)
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 1024):
        d = norms[None, :] - 2 * (x[i:i + 1024] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i:i + 1024] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, :out.shape[1]]
    return out


def bisect(edges: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Halves (equal but for one) of a graph of n nodes with few edges between them."""
    a, b = np.concatenate([edges, edges[:, ::-1]]).T if len(edges) else (np.zeros(0, int), np.zeros(0, int))
    degree = np.bincount(a, minlength=n) + 1.0
    root = np.sqrt(degree)
    mode = rng.standard_normal(n)
    for _ in range(60):  # power steps towards the second mode of the lazy walk
        mode -= root * (root @ mode) / (root @ root)
        spread = np.bincount(a, weights=(mode / root)[b], minlength=n) + mode / root
        mode = 0.5 * mode + 0.5 * spread / root
        mode /= np.linalg.norm(mode) + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(mode / root, kind="stable")[n // 2:]] = True
    for _ in range(30):
        across = np.bincount(a, weights=side[a] != side[b], minlength=n)
        gain = 2 * across - np.bincount(a, minlength=n)
        left, right = (np.flatnonzero((side == s) & (gain > 0)) for s in (False, True))
        m = min(len(left), len(right))
        if not m:
            break
        m = max(1, m // 2)  # not all at once: neighbours that swap together gain nothing
        side[left[np.argsort(-gain[left], kind="stable")[:m]]] = True
        side[right[np.argsort(-gain[right], kind="stable")[:m]]] = False
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part (below ``parts``, a power of two) for each node, all of one size but for rounding."""
    rng = np.random.default_rng(seed)
    n = len(graph)
    edges = np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], axis=1)
    part = np.zeros(n, np.int64)
    size = 1
    while size < parts:
        finer = part * 2
        for p in range(size):
            nodes = np.flatnonzero(part == p)
            at = np.full(n, -1)
            at[nodes] = np.arange(len(nodes))
            inner = at[edges]
            finer[nodes] += bisect(inner[(inner >= 0).all(axis=1)], len(nodes), rng)
        part, size = finer, size * 2
    return part


class Router:
    """A network with one hidden layer that gives the probability of each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        self.centre, self.scale = x.mean(axis=0), 1 / (x.std() + 1e-12)
        z = (x - self.centre) * self.scale
        shapes = [(z.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
        self.w = [rng.standard_normal(s) * (np.sqrt(2 / s[0]) if len(s) == 2 else 0) for s in shapes]
        mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), 256):
                rows = order[i:i + 256]
                h = np.maximum(z[rows] @ self.w[0] + self.w[1], 0)
                d = (self._softmax(h @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                back = (d @ self.w[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((z[rows].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    mean[j] += 0.1 * (g - mean[j])
                    square[j] += 0.001 * (g * g - square[j])
                    self.w[j] -= 0.003 * (1 - epoch / epochs) * (mean[j] / (1 - 0.9 ** t)) / (np.sqrt(square[j] / (1 - 0.999 ** t)) + 1e-8)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.centre) * self.scale) @ self.w[0] + self.w[1], 0)
        return self._softmax(h @ self.w[2] + self.w[3])


def learn(sample: np.ndarray, parts: int) -> Router | None:
    """The router for ``parts`` parts, from different vectors, or for the most parts these can
    be cut into; None for one part."""
    if not len(sample) or parts < 2:
        return None
    sample = np.unique(sample, axis=0)
    while parts > 1 and len(sample) < PER_PART * parts:
        parts //= 2
    if parts < 2:
        return None
    graph = neighbour_graph(sample)
    part = balanced_parts(graph, parts)
    target = np.zeros((len(sample), parts))
    for column in (np.arange(len(sample))[:, None], graph):
        np.add.at(target, (np.repeat(np.arange(len(sample)), column.shape[1]), part[column].ravel()), 1.0)
    return Router(sample, target / target.sum(axis=1, keepdims=True))


def _route(router: Router | None, reach: float, counts: np.ndarray | None, k: int):
    """Parts of rows (the most probable one) or, given ``counts``, of queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["vec"].tolist(), dtype=float)
            p = np.ones((len(x), 1)) if router is None else router(x)
            if counts is None:
                parts = [[int(i)] for i in p.argmax(axis=1)]
            else:
                order = np.argsort(-p, axis=1, kind="stable")
                sure = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
                rows = np.cumsum(counts[order], axis=1)
                enough = (sure >= reach) & (rows > k)  # the query itself may be among the rows
                n = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, p.shape[1])
                n = np.maximum(n, min(2, p.shape[1]))
                parts = [o[:m].tolist() for o, m in zip(order, n)]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vec": [v.tobytes() for v in x], "parts": parts})

    return run


def _blocks(rows: DataFrame, counts: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of a part (part, vec_id, vec) gathered in blocks of about ``size``."""
    dealt = rows.join(counts, "part").withColumn("nr", F.pmod(F.xxhash64("vec_id", "vec"), F.ceil(F.col("n") / size)))
    return dealt.groupBy("part", "nr").agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.collect_list("vec").alias(f"{name}_vecs")).drop("nr")


def nearest(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, its k nearest ids, distances), ties to smaller ids, the query's own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    near = (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
    near[q_ids[:, None] == ids[None, :]] = np.inf
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    per_id = np.minimum.reduceat(near, first, axis=1)  # an id with many vectors is one candidate
    m = min(2 * k, len(first)) - 1
    edge = np.partition(per_id, m, axis=1)[:, m]
    slack = 1e-9 * (1 + (q * q).sum(axis=1) + (x * x).sum(axis=1).max())
    for i in range(len(q)):
        found = np.flatnonzero((near[i] <= edge[i] + slack[i]) & (near[i] < np.inf))
        d = np.sqrt(((x[found] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[found], d))
        best = best[np.sort(np.unique(ids[found][best], return_index=True)[1])][:k]
        yield q_ids[i], ids[found][best], d[best]


def _rerank(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                x, q = (np.frombuffer(b"".join(v)).reshape(len(v), -1) for v in (row.row_vecs, row.query_vecs))
                out = list(nearest(np.asarray(row.row_ids, np.int64), x, np.asarray(row.query_ids, np.int64), q, k))
                yield pd.DataFrame({"query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64),
                                    "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, reach: float = 0.96, sample: int = SAMPLE, parts: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's ``k`` nearest
    rows found. ``reach``: probability the visited parts make up; ``parts``: a power of two, by
    default such that parts hold some hundred to thousand rows; a part needs PER_PART of the
    ``sample``, so that more parts take a larger sample."""
    ship_by_value(__name__)
    rows = store(usable(vectors), "ann-rows")
    n = rows.count()
    if parts is None:
        parts = 1 << int(min(np.log2(max(2, sample // PER_PART)), max(1, round(np.log2(max(1, np.sqrt(n) / 4))))))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toPandas() if parts > 1 and n >= LEAST else None
    router = learn(np.array(drawn["vec"].tolist(), dtype=float), parts) if drawn is not None else None
    parts = router.w[3].size if router is not None else 1
    kind = "vec_id long, vec binary, parts array<int>"
    index = store(rows.mapInPandas(_route(router, reach, None, k), kind)
                  .select("vec_id", "vec", F.col("parts")[0].alias("part")), "ann-index")
    counted = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.array([counted.get(i, 0) for i in range(parts)])
    of = lambda df: df.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    asked = store(rows.filter(is_query).mapInPandas(_route(router, reach, counts, k), kind)
                  .select("vec_id", "vec", F.explode("parts").alias("part")), "ann-queries")
    # Merged, not broadcast: a query's vector stands once per visited part, which a file's size does not
    # show (repeated values are stored once), so either side may be far larger than it looks.
    pairs = _blocks(index, of(index), BLOCK_ROWS, "row").join(_blocks(asked, of(asked), BLOCK_QUERIES, "query").hint("merge"), "part")
    pairs = pairs.select("row_ids", "row_vecs", "query_ids", "query_vecs").repartition(F.xxhash64("row_ids"), F.xxhash64("query_ids"))
    found = pairs.mapInPandas(_rerank(k), RESULT)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
