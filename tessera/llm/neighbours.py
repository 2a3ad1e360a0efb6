"""Approximate nearest neighbours by learned partitions.

Fit (on at most FIT_ROWS distinct vectors, those with the least hashes: a documented bound of the fit only): the graph of
each one's nearest neighbours is cut into balanced parts (parts grow along the graph from far-apart seeds up to a
capacity, then vertices move to the part with most of their neighbours while sizes stay balanced), and a small softmax classifier
learns from a vector how its neighbours are spread over the parts.

Index: every vector, whatever the fit saw, goes to its most probable part. Search: a query goes to its most probable parts,
as many as reach RECALL of the true neighbours on the fit's vectors, and is compared exactly, in double precision, with all vectors of these parts.
The number of parts grows with the number of vectors (PART_ROWS each) up to PARTS; a part that still has more than SPLIT rows is cut
again by a router of its own, fitted in the same way on at most FIT_ROWS of its vectors, by a task for each such part.

Equal vectors are one candidate with its ids, so a vector that a third of all rows share is compared once; the k + 1
smallest ids are kept, since no other of its rows can be among a query's k nearest. Parts are dealt out in blocks of rows
and blocks of queries, so no task holds a whole part. Queries are a stated set (ids divisible by 100), compared in blocks.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of one width are neighbours of each other only, and
each width has an index of its own: a router where it is one of the WIDTHS commonest, else one part. Null ids take no part. A query's own id is no candidate of it, also if rows repeat it; repeated rows of one id and one vector count once.
Components so large or small that their squares overflow or vanish are scaled before; a distance beyond all doubles is infinite.
A query whose parts hold fewer than k candidates is compared with all parts; with fewer candidates in all, it has these. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shared

K, FIT_ROWS, DEGREE, PART_ROWS, PARTS, RECALL = 10, 6000, 10, 500, (4, 64), 0.95
#: Rows and queries that are compared at once.
ROWS, QUERIES = 8192, 1024
#: Rows of a part from which it is cut again; widths that get a router.
SPLIT, WIDTHS = 32_768, 8
#: Components up to which squares and their sums neither overflow nor vanish; routers take larger ones as this one.
LARGE, TINY = 1e100, 1e-100


@dataclass
class Router:
    """Softmax classifier of parts."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, best first."""
        z = np.clip(x, -LARGE, LARGE) @ self.weights + self.bias
        return np.argsort(-z, axis=1, kind="stable")[:, :n]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each row's nearest other rows."""
    degree = min(degree, len(x) - 1)
    out = np.empty((len(x), degree), dtype=np.int64)
    for a in range(0, len(x), 512):
        d = distances(x[a : a + 512], x)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        out[a : a + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Parts of a neighbour graph of nearly equal size that cut few of its edges."""
    n = len(x)
    capacity = int(np.ceil(slack * n / parts))
    rng = np.random.default_rng(seed)
    seeds = [int(rng.integers(n))]
    far = distances(x[seeds], x)[0]
    for _ in range(parts - 1):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, distances(x[seeds[-1:]], x)[0])
    near: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        near[i] += row
        for j in row:
            near[j].append(i)
    part = np.full(n, -1)
    size = [0] * parts
    edges = [[s] for s in seeds]
    left = n
    while left:
        moved = False
        for p in sorted(range(parts), key=size.__getitem__):
            while edges[p] and part[edges[p][-1]] >= 0:
                edges[p].pop()
            if edges[p] and size[p] < capacity:
                i = edges[p].pop()
                part[i] = p
                size[p] += 1
                left -= 1
                moved = True
                edges[p][:0] = [j for j in near[i] if part[j] < 0]
        if not moved:
            rest = np.flatnonzero(part < 0)
            p = int(np.argmin(size))
            edges[p].append(int(rng.choice(rest)))
    for _ in range(rounds):
        moves = 0
        for i in rng.permutation(n).tolist():
            votes = Counter(part[near[i]].tolist())
            best = max(votes, key=lambda p: (votes[p], -size[p]))
            own = int(part[i])
            if best != own and votes[best] > votes.get(own, 0) and size[best] < capacity:
                part[i] = best
                size[own] -= 1
                size[best] += 1
                moves += 1
        if moves < n // 500:
            break
    return part


def fit(x: np.ndarray, parts: int, k: int = K, recall: float = RECALL, epochs: int = 60, seed: int = 5) -> Router:
    """Learns parts of the rows of x, and how many of them to search."""
    x, width = np.clip(x, -LARGE, LARGE), x.shape[1]
    parts = max(1, min(parts, len(x) // (4 * k)))
    if parts < 2:
        return Router(np.zeros((width, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, max(DEGREE, k))
    part = balanced_parts(x, graph, parts)
    spread = np.zeros((len(x), parts))
    np.add.at(spread, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
    np.add.at(spread, (np.arange(len(x)), part), graph.shape[1])
    spread /= spread.sum(1, keepdims=True)
    scale = 1 / max(x.std(), 1e-12)
    rng = np.random.default_rng(seed)
    w, b = np.zeros((width, parts)), np.zeros(parts)
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            z = x[rows] * scale @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - spread[rows]) / len(rows)
            rate = 1.0 * (1 - epoch / epochs)
            w -= rate * (x[rows].T * scale @ g + 1e-4 * w)
            b -= rate * g.sum(0)
    router = Router(w * scale, b, parts)
    own = router.order(x, 1)[:, 0]
    order = router.order(x, parts)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], 1)
    reached = np.sort(np.take_along_axis(place, own[graph[:, :k]], 1).ravel())
    router.probes = int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))))]) + 1
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array of double) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))


def exact_distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows from one vector. Differences whose squares would overflow or vanish are scaled by a power of two first."""
    with np.errstate(over="ignore"):
        d = np.abs(rows - q)
    top = d.max(1)
    odd = np.isfinite(top) & ((top > LARGE) | (top < TINY)) & (top > 0)
    unit = np.where(odd, np.exp2(np.floor(np.log2(np.where(odd, top, 1)))), 1)
    with np.errstate(over="ignore"):
        return np.sqrt(((d / unit[:, None]) ** 2).sum(1)) * unit


def _near(queries: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, float]]:
    """(query, id, distance) of each query's k nearest of these rows; a row stands for its ids. Rows and queries with components beyond LARGE
    are compared exactly only."""
    large = np.abs(rows).max(1) > LARGE
    if large.any() or (np.abs(q) > LARGE).any():
        usual, out = np.abs(q).max(1) <= LARGE, []
        if usual.any() and not large.all():
            out += _near(queries[usual], q[usual], rows[~large], [r for r, x in zip(ids, large.tolist(), strict=True) if not x], k)
        for i in range(len(q)):
            some, own = np.flatnonzero(large) if usual[i] else np.arange(len(rows)), int(queries[i])
            found = sorted((float(s), v) for s, r in zip(exact_distances(rows[some], q[i]), some.tolist(), strict=True) for v in ids[r] if v != own)
            out += [(own, v, s) for s, v in found[:k]]
        return out  # at most 2 k of a query; search keeps k
    # rounding of the products grows with the norms: rows near the block's middle keep it small, and it is allowed for
    middle = rows.mean(0)
    a, b = q - middle, rows - middle
    rough = distances(a, b)
    slack = 8 * np.finfo(float).eps * rows.shape[1] * ((a * a).sum(1) + (b * b).sum(1).max() + (middle * middle).sum())
    out = []
    for i in range(len(q)):
        d = rough[i]
        n = min(len(rows), k + 1)
        bound = np.partition(d, n - 1)[n - 1]
        some = np.flatnonzero(d <= bound * (1 + 1e-9) + 2 * slack[i])
        exact = exact_distances(rows[some], q[i])
        own = int(queries[i])
        found = sorted((float(s), v) for s, r in zip(exact, some.tolist(), strict=True) for v in ids[r] if v != own)
        out += [(own, v, s) for s, v in found[:k]]
    return out


class Index:
    """Routers by width, and by width and part where a part is cut again. A part's name is (width, part, part in it)."""

    def __init__(self, first: dict[int, Router], second: dict[tuple[int, int], Router]):
        self.first, self.second = first, second

    def places(self, vectors: list[np.ndarray], search: bool) -> list[list[tuple[int, int, int]]]:
        """For each vector the part it is in, or the parts to search for it."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in vectors]
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by.setdefault(len(v), []).append(i)
        for width, rows in by.items():
            if width not in self.first:
                for i in rows:
                    out[i].append((width, 0, 0))
                continue
            x, router = np.stack([vectors[i] for i in rows]), self.first[width]
            for at, parts in enumerate(router.order(x, router.probes if search else 1).tolist()):
                for p in parts:
                    inner = self.second.get((width, p))
                    if inner is None:
                        out[rows[at]].append((width, p, 0))
                    else:
                        out[rows[at]] += [(width, p, c) for c in inner.order(x[at : at + 1], inner.probes if search else 1)[0].tolist()]
        return out


_PLACE = "struct<width: int, part: int, cell: int>"


def _placed(index, search: bool, names: list[str]):
    """Rows with `places`, the parts they are in or are to be searched for in."""

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = index.value.places([np.asarray(v) for v in f["v"]], search)
            yield f.assign(places=[[dict(zip(("width", "part", "cell"), x, strict=True)) for x in xs] for xs in found])[[*names, "places"]]

    return placed


def _routers(distinct: DataFrame, k: int, fit_rows: int, split: int) -> Index:
    """Fits the routers: those of the commonest widths on the driver, those of large parts in a task each."""
    spark = distinct.sparkSession
    width = F.size("v")
    first: dict[int, Router] = {}
    for w, n in distinct.groupBy(width.alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(WIDTHS).collect():
        sample = distinct.where(width == w).orderBy(F.xxhash64("v"), "v").limit(fit_rows).select("v").toLocalIterator()
        first[w] = fit(np.array([r[0] for r in sample]), min(max(n // PART_ROWS, PARTS[0]), PARTS[1]), k)
    sent = spark.sparkContext.broadcast(Index(first, {}))
    placed = distinct.select("v").mapInPandas(_placed(sent, False, ["v"]), f"v array<double>, places array<{_PLACE}>").select("v", F.col("places")[0].alias("p"))
    large = placed.groupBy("p").agg(F.count("*").alias("n")).where((F.col("n") > split) & F.col("p.width").isin(*first))
    large = shared.cut(large)  # at most PARTS of each of WIDTHS widths
    if large.isEmpty():
        return Index(first, {})
    key = F.xxhash64("v")
    inner = placed.join(F.broadcast(large), "p")
    # the vectors with the least hashes, about fit_rows of a part, and no more than twice as many
    inner = inner.where(F.pmod(key, F.col("n")) < int(1.2 * fit_rows)).groupBy("p").agg(F.first("n").alias("n"), F.collect_list("v").alias("vs"))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, n, vs in zip(f["p"], f["n"], f["vs"], strict=True):
                x = np.unique(np.stack([np.asarray(v) for v in vs]), axis=0)
                r = fit(x[: 2 * fit_rows], min(max(int(n) // PART_ROWS, PARTS[0]), PARTS[1]), k, RECALL)
                yield pd.DataFrame({"width": [p["width"]], "part": [p["part"]], "weights": [r.weights.ravel().tolist()], "bias": [r.bias.tolist()], "probes": [r.probes]})

    second = {}
    for r in inner.mapInPandas(learn, "width int, part int, weights array<double>, bias array<double>, probes int").toLocalIterator():
        second[r["width"], r["part"]] = Router(np.array(r["weights"]).reshape(r["width"], -1), np.array(r["bias"]), r["probes"])
    return Index(first, second)


def search(vectors: DataFrame, is_query, k: int = K, fit_rows: int = FIT_ROWS, split: int = SPLIT) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by Euclidean distance and then id."""
    spark = vectors.sparkSession
    shared.lean(spark)
    rows = usable(vectors)
    # one candidate for each distinct vector
    distinct = shared.cut(_smallest(rows, k + 1))
    routers = spark.sparkContext.broadcast(_routers(distinct, k, fit_rows, split))
    index = distinct.mapInPandas(_placed(routers, False, ["v", "ids"]), f"v array<double>, ids array<long>, places array<{_PLACE}>")
    index = shared.cut(index.select("v", "ids", F.col("places")[0].alias("place")))
    sizes = index.groupBy("place").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    sizes = shared.small(shared.cut(sizes))
    queries = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "v"])
    asked = queries.mapInPandas(_placed(routers, True, ["vec_id", "v"]), f"vec_id long, v array<double>, places array<{_PLACE}>")
    found = shared.cut(_ranked(asked.withColumn("place", F.explode("places")).drop("places"), index, sizes, k))
    # a query whose parts hold fewer than k candidates is compared with all parts of its width
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = shared.cut(queries.join(enough, "vec_id", "left_anti"))
    if short.isEmpty():
        return found
    # columns of their own, as sizes is joined once more
    every = sizes.select(F.col("place.width").alias("width"), F.struct("place.*").alias("place"))
    every = _ranked(short.withColumn("width", F.size("v")).join(every, "width").drop("width"), index, sizes, k)
    return found.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(every)


def _ranked(asked: DataFrame, index: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of queries (vec_id, v, place), each once for each part to search."""
    asked = shared.cut(asked.join(sizes, "place"))
    query_blocks = shared.small(shared.cut(asked.groupBy("place").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("query_blocks"))))
    left = (
        index.join(sizes, "place")
        .join(query_blocks, "place")
        .withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
        .select("place", "block", "query_block", "v", "ids")
    )
    right = (
        asked.join(query_blocks, "place")
        .withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.col("query_blocks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("place", "block", "query_block", "vec_id", "v")
    )

    def compare(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(queries):
            found = []
        else:
            found = _near(queries["vec_id"].to_numpy(), np.stack(queries["v"]), np.stack(own["v"]), [list(x) for x in own["ids"]], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["place", "block", "query_block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its k smallest ids. Rows of a vector are cut to k in each salt first."""
    once = rows.dropDuplicates(["v", "vec_id"])
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    for by in ([F.col("v"), salt], [F.col("v")]):
        once = once.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("__n") <= k).drop("__n")
    return once.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def nearest(vectors: DataFrame) -> DataFrame:
    """The query set's results: ids divisible by 100."""
    return search(vectors, lambda vec_id: vec_id % 100 == 0)
