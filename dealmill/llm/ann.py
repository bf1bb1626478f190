"""Approximate nearest neighbours over balanced posting lists.

Vectors are lifted by one coordinate, sqrt(M^2 - |x|^2), so that the largest inner product is the smallest
distance. Centroids come from balanced median cuts of a bounded sample; they are linked into a neighbour graph
that every task searches in memory. A vector goes to the region of its nearest centroid and, where it lies near a
boundary, to several more. Regions are divided into cells by one set of offsets from the centroid, fitted on the
same sample; their number grows with the table, so lists (a cell of a region) stay short. A query takes the lists
whose middle is not much farther than its nearest one. Lists and their queries are cut into parts of bounded size;
every vector is indexed. Scores are taken on the original vectors in double precision, dimension after dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from dealmill.llm.common import materialize, settled


@dataclass(frozen=True)
class AnnParams:
    #: Vectors of the sample that centroids are fitted on, and centroids, at most. Both bound what is broadcast.
    sample: int = 20_000
    centroids: int = 2_048
    list_size: int = 96
    #: A vector is put into at most so many lists, whose distance is at most (1 + boundary) times the nearest.
    replicas: int = 4
    boundary: float = 0.12
    #: Cells of a region, at most; there are as many as lists of ``list_size`` need beyond one for each centroid.
    cells: int = 256
    #: A query reads at most so many lists, whose distance is at most (1 + reach) times the nearest; None: all lists,
    #: which is the exact search.
    probes: int | None = 96
    reach: float = 0.45
    #: Members of a list, or queries of a list, in one task.
    part: int = 4_096


class CentroidGraph:
    """Centroids with the graph of their nearest neighbours, searched by best-first steps for many points at once."""

    def __init__(self, points: np.ndarray, degree: int = 24):
        self.points = points.astype(np.float32)
        n = len(points)
        self.norms = (self.points**2).sum(1)
        near = np.empty((n, min(degree, max(n - 1, 1))), np.int64)
        for lo in range(0, n, 512):
            d = self.norms[None, :] - 2 * self.points[lo : lo + 512] @ self.points.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            near[lo : lo + 512] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]] if n > 1 else 0
        # long edges keep far groups of centroids reachable
        far = np.random.default_rng(3).integers(0, n, (n, 8)) if n > 1 else near[:, :1]
        links = np.sort(np.concatenate([near, far], axis=1), axis=1)
        again = np.concatenate([np.zeros((n, 1), bool), links[:, 1:] == links[:, :-1]], axis=1)
        self.links = np.where(again, np.arange(n)[:, None], links)  # a point itself has been seen when it is expanded
        self.entries = np.arange(n)[:: max(1, n // 32)][:32]

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``want`` nearest centroids found for each row of x, nearest first, and squared distances.

        Each row keeps its ``want`` + 16 best so far; a step expands the best of them not yet expanded. Steps look at
        that pool and at a point's neighbours, never at all centroids.
        """
        n, live = len(self.points), np.arange(len(x))
        want = min(want, n)
        beam, own = min(n, want + 16), (x**2).sum(1)
        seen = np.zeros((len(x), n), bool)
        seen[:, self.entries] = True
        pad = max(0, beam - len(self.entries))
        ids = np.pad(np.tile(self.entries, (len(x), 1)), ((0, 0), (0, pad)))
        dist = np.pad(self.norms[self.entries][None, :] - 2 * x @ self.points[self.entries].T, ((0, 0), (0, pad)), constant_values=np.inf)
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, todo = np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1), np.take_along_axis(dist, best, 1)
        while len(live):
            at = todo[live].argmin(1)
            go = np.isfinite(todo[live, at])
            live, at = live[go], at[go]
            if not len(live):
                break
            todo[live, at] = np.inf
            around = self.links[ids[live, at]]
            d = self.norms[around] - 2 * np.einsum("bd,bkd->bk", x[live], self.points[around])
            d[seen[live[:, None], around]] = np.inf
            seen[live[:, None], around] = True
            all_d = np.concatenate([dist[live], d], axis=1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[live] = np.take_along_axis(all_d, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], around], axis=1), keep, 1)
            todo[live] = np.take_along_axis(np.concatenate([todo[live], d], axis=1), keep, 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :want]
        found = np.take_along_axis(dist, order, 1)
        return np.take_along_axis(ids, order, 1), np.maximum(found + own[:, None], 0)


def balanced_centroids(points: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Means of ``count`` groups of nearly equal size, by median cuts between two far means, largest group first."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(points))]
    while len(groups) < count:
        groups.sort(key=len)
        g = groups.pop()
        if len(g) < 2:
            groups.append(g)
            break
        x = points[g]
        a, b = x[rng.choice(len(g), 2, replace=False)]
        for _ in range(6):
            side = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
            if side.all() or not side.any():
                break
            a, b = x[side].mean(0), x[~side].mean(0)
        cut = np.argsort(x @ (a - b), kind="stable")
        groups += [g[cut[: len(g) // 2]], g[cut[len(g) // 2 :]]]
    return np.stack([points[g].mean(0) for g in groups])


def _lift(x: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """Vectors over the longest one's length, with the coordinate that makes them equally long; of queries it is 0."""
    x = x.astype(np.float64) / longest
    more = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(1 - (x**2).sum(1), 0))[:, None]
    return np.concatenate([x, more], 1).astype(np.float32)


def _unpack(column, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dims)


def _packed(dims: int, kind: str):
    """Rows with a vector that takes part, its components as bytes, and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column("embedding").flatten(), kind).reshape(-1, dims)
            flat = np.where(flat == 0, flat.dtype.type(0), flat)  # -0.0 is 0.0
            packed = pa.array([row.tobytes() for row in flat], pa.binary())
            peak = np.abs(flat.astype(np.float64)).max(1)
            length = peak * np.sqrt(((flat / peak[:, None]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed, pa.array(length)], ["vec_id", "vec", "length"])

    return run


@dataclass(frozen=True)
class Index:
    """What is sent to every task: the centroids' graph and the offsets of cells, bounded by AnnParams."""

    graph: CentroidGraph
    offsets: np.ndarray
    longest: float

    def place(self, x: np.ndarray, want: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of lists that vectors belong to: the nearest cell of each near region."""
        ids, d = self.graph.search(x, want)
        r, c = np.nonzero(np.sqrt(d) <= (1 + slack) * np.sqrt(d[:, :1]) + 1e-6)
        return r, ids[r, c] * len(self.offsets) + self._to_cells(x[r] - self.graph.points[ids[r, c]]).argmin(1)

    def ask(self, x: np.ndarray, want: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of lists that queries read: the nearest cells of all near regions together."""
        ids, d = self.graph.search(x, want)
        k = len(self.offsets)
        if k == 1:
            r, c = np.nonzero(np.sqrt(d) <= (1 + slack) * np.sqrt(d[:, :1]) + 1e-6)
            return r, ids[r, c]
        rows, lists = [], []
        for i in range(len(x)):
            cells = self._to_cells(x[i] - self.graph.points[ids[i]])
            far = np.sqrt(np.maximum(cells + ((x[i] - self.graph.points[ids[i]]) ** 2).sum(1)[:, None], 0)).ravel()
            best = np.argsort(far, kind="stable")[:want]
            best = best[far[best] <= (1 + slack) * far[best[0]] + 1e-6]
            rows.append(np.full(len(best), i))
            lists.append(ids[i][best // k] * k + best % k)
        return np.concatenate(rows), np.concatenate(lists)

    def _to_cells(self, off: np.ndarray) -> np.ndarray:
        """Squared distances from points, given by their place about a centroid, to its cells, less the points' own."""
        return (self.offsets**2).sum(1)[None, :] - 2 * off @ self.offsets.T


def _assign(index: Index, dims: int, kind: str, want: int, slack: float, query: bool, chunk: int = 256):
    """vh, vec to one row for each list that it belongs to, or that a query reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            for lo in range(0, len(vecs), chunk):
                x = _unpack(vecs[lo : lo + chunk], dims, kind)
                r, lists = (index.ask if query else index.place)(_lift(x, index.longest, query), want, slack)
                part = batch.slice(lo, len(x)).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *part.columns], ["list", *part.schema.names])

    return run


def _score(dims: int, kind: str, k: int):
    def run(key, posts: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(posts) and len(asks):
            posts = posts.sort_values("first_id", kind="stable")
            x, first, vh = _unpack(posts["vec"], dims, kind).astype(np.float64), posts["first_id"].to_numpy(), posts["vh"].to_numpy()
            names = asks["vh"].to_numpy()
            for lo in range(0, len(asks), 128):
                q = _unpack(asks["vec"].iloc[lo : lo + 128], dims, kind).astype(np.float64)
                total = np.zeros((len(q), len(x)))
                for d in range(dims):  # one dimension after the other, so that a score does not depend on its block
                    total += q[:, d : d + 1] * x[:, d][None, :]
                order = np.argsort(-total, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({
                    "q": np.repeat(names[lo : lo + 128], order.shape[1]), "vh": vh[order].ravel(),
                    "first_id": first[order].ravel(), "score": np.take_along_axis(total, order, 1).ravel(),
                }))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "vh": [], "first_id": [], "score": []}).astype({"q": "object", "vh": "object", "first_id": "int64"})

    return run


def nearest(embeddings: DataFrame, is_query, k: int = 20, params: AnnParams | None = None) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score; ``is_query`` is a condition on vec_id.

    ``embeddings`` has vec_id and embedding (array of float or double, scored as they are); other columns are ignored. Rows with a null id, and
    vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
    Equal vectors are searched once and stand for all their ids, of which the k + 1 smallest can matter; repeated
    rows count once. Fewer candidates than k give fewer rows; an empty table gives none.
    """
    p, spark = params or AnnParams(), embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda v: v != 0))
    common = sound.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    dims = common[0]["dims"]
    kind = "f4" if isinstance(sound.schema["embedding"].dataType.elementType, FloatType) else "f8"
    rows = sound.where(F.size("embedding") == dims).select("vec_id", F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>"))
    rows = rows.mapInArrow(_packed(dims, kind), "vec_id long, vec binary, length double").withColumn("vh", F.unhex(F.md5("vec")))
    rows = materialize(rows, "vectors")
    # the smallest ids of each distinct vector; a hot vector is cut down before the shuffle
    same = W.partitionBy("vh").orderBy("vec_id")
    members = materialize(rows.select("vh", "vec_id").withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1), "members")
    distinct = rows.groupBy("vh").agg(F.min("vec_id").alias("first_id"), F.max("length").alias("length"), F.first("vec").alias("vec"))
    distinct = materialize(distinct, "distinct-vectors")
    bounds = distinct.agg(F.count("*").alias("n"), F.max("length").alias("length")).first()
    longest = float(bounds["length"]) * (1 + 1e-6)
    sample = distinct.orderBy("vh").limit(p.sample).select("vec").toArrow().column("vec").to_pylist()
    points = _lift(_unpack(sample, dims, kind), longest)
    wanted = -(-bounds["n"] // p.list_size)
    graph = CentroidGraph(balanced_centroids(points, max(1, min(p.centroids, wanted, len(points)))))
    cells = max(1, min(p.cells, wanted // max(1, len(graph.points)), len(points)))
    around = points - graph.points[np.concatenate([graph.search(points[lo : lo + 512], 1)[0][:, 0] for lo in range(0, len(points), 512)])]
    index = Index(graph, balanced_centroids(around, cells) if cells > 1 else np.zeros((1, dims + 1), np.float32), longest)

    in_lists = distinct.select("vh", "vec", "first_id").mapInArrow(_assign(index, dims, kind, p.replicas, p.boundary, False), "list int, vh binary, vec binary, first_id long")
    in_lists = materialize(in_lists, "posting-lists")
    asked = rows.where(is_query)
    queries = asked.groupBy("vh").agg(F.first("vec").alias("vec"))
    probes, reach = (len(graph.points) * cells, np.inf) if p.probes is None else (p.probes, p.reach)
    asks = materialize(queries.mapInArrow(_assign(index, dims, kind, probes, reach, True), "list int, vh binary, vec binary"), "list-queries")
    parts = (
        in_lists.groupBy("list").agg(F.ceil(F.count("*") / p.part).cast("int").alias("lp"))
        .join(asks.groupBy("list").agg(F.ceil(F.count("*") / p.part).cast("int").alias("qp")), "list")
    )
    deal = lambda df, own, other: (
        df.join(parts, "list")
        .withColumn(own[0], F.pmod(F.hash("vh"), F.col(own[1])))
        .withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)))
        .drop("lp", "qp")
    )
    left = deal(in_lists, ("i", "lp"), ("j", "qp")).groupBy("list", "i", "j")
    right = deal(asks, ("j", "qp"), ("i", "lp")).groupBy("list", "i", "j")
    found = left.cogroup(right).applyInPandas(_score(dims, kind, k + 1), "q binary, vh binary, first_id long, score double")
    # a pair met in several lists has one score; max keeps one row and combines before the shuffle
    found = found.groupBy("q", "vh", "first_id").agg(F.max("score").alias("score"))
    by_vector = W.partitionBy("q").orderBy(F.desc("score"), "first_id")
    best = found.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1).drop("n")
    by_id = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = best.join(members.select("vh", "vec_id"), "vh").withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    best = materialize(best.select("q", "vec_id", "score", "n"), "best")
    # an id answers its own query at no rank; what stands behind it moves up
    own = asked.select(F.col("vh").alias("q"), F.col("vec_id").alias("query_id")).distinct()
    at = best.select(F.col("q").alias("_q"), F.col("vec_id").alias("_v"), F.col("n").alias("own_rank"))
    own = own.join(at, (F.col("q") == F.col("_q")) & (F.col("query_id") == F.col("_v")), "left").select("q", "query_id", F.coalesce("own_rank", F.lit(k + 2)).alias("own_rank"))
    return (
        own.join(best, "q").where(F.col("query_id") != F.col("vec_id"))
        .select("query_id", (F.col("n") - F.when(F.col("n") > F.col("own_rank"), 1).otherwise(0)).cast("int").alias("rank"), "vec_id", "score")
        .where(F.col("rank") <= k)
    )


@settled
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(table, F.col("vec_id") % 20 == 0)
