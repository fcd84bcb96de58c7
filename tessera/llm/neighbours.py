"""Approximate nearest neighbours by inner product, over balanced posting lists.

Equal vectors are one point with the ids of its first copies.  A point is stored with the
lists of its nearest centroid and, if it is near a boundary, of further centroids about as
near.  Centroids come from balanced k-means on a bounded sample; every point is indexed.
Centroids are found through a navigable graph held in memory (there are at most
`most_lists`).  A query compares itself with every centroid and visits the nearest lists, a
`share` of all but `least` at least, so that recall doesn't fall as lists become more, and
any other whose centroid is at most `ratio` times as far as its nearest one.  A list is cut into chunks of bounded size, and so are its queries; each
pair of chunks is one matrix product, from which only each query's best rows leave.

Inner products become distances by one more coordinate: with M the largest norm, x is
extended by sqrt(M^2 - |x|^2) and a query by 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Edges of a centroid in the graph, centroids kept while searching it, and steps.
EDGES, BEAM = 24, 48
#: Rows that leave the search for lists at once.
OUT = 65_536
#: Stored rows, and queries, that meet in one task at once.
CHUNK, QUERY_CHUNK = 20_000, 2_000


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means in which crowded clusters recede: each has a penalty that follows its size."""
    rng = np.random.default_rng(seed)
    centroids = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    penalty, spread = np.zeros(k), float(x.var(0).sum()) or 1.0
    for _ in range(rounds):
        near = np.concatenate([(_norms(centroids) + penalty - 2 * part @ centroids.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        size = np.bincount(near, minlength=k)
        penalty += 0.05 * spread * (size - len(x) / k) / (len(x) / k)
        penalty = np.clip(penalty - penalty.mean(), -spread, spread)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    return centroids


class Graph:
    """Centroids with edges to their nearest ones and, so that none is cut off, to a ring."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, k = centroids, len(centroids)
        self.square = _norms(centroids)
        far = self.square[:, None] + self.square - 2 * centroids @ centroids.T
        near = np.argsort(far, 1, kind="stable")[:, 1 : EDGES + 1]
        ring = np.arange(k)[:, None] + np.array([1, -1, k // 3, k // 7 + 1])
        self.edges = np.c_[near, ring % k]
        self.starts = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the nearest `want` centroids found, nearest first, and squared distances."""
        rows, k = len(x), len(self.centroids)
        beam = min(k, max(BEAM, want * 3 // 2))
        far = np.full((rows, k), np.inf)
        opened = np.zeros((rows, k), bool)
        square = _norms(x)
        everyone = np.arange(rows)
        far[:, self.starts] = np.maximum(0, square[:, None] + self.square[self.starts] - 2 * x @ self.centroids[self.starts].T)
        for _ in range(beam):
            open_ = np.where(opened, np.inf, far)
            best = open_.argmin(1)
            going = np.isfinite(open_[everyone, best])
            if beam < k:  # the best unopened one must be among the `beam` best
                going &= (far < far[everyone, best][:, None]).sum(1) < beam
            r = everyone[going]
            if not len(r):
                break
            opened[r, best[r]] = True
            to = self.edges[best[r]]
            far[r[:, None], to] = np.maximum(0, square[r][:, None] + self.square[to] - 2 * np.einsum("rd,red->re", x[r], self.centroids[to]))
        order = np.argsort(far, 1, kind="stable")[:, :want]
        return order, np.take_along_axis(far, order, 1)

    def visited(self, x: np.ndarray, visits: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, centroid) of the nearest `visits` centroids, compared with all, and of those within `ratio`."""
        far = np.maximum(0, _norms(x)[:, None] + self.square - 2 * x @ self.centroids.T)
        last = np.partition(far, visits - 1, 1)[:, visits - 1]
        return np.nonzero(far <= np.maximum(last, far.min(1) * ratio**2 + 1e-12)[:, None])


def visits_of(lists: int, share: float, least: int) -> int:
    return min(lists, max(least, math.ceil(share * lists)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _to_lists(shared, copies: int, visits: int, ratio: float, dim: int):
    """A row for each list that a row (class_id, vector, ...) is stored in, at most `copies`, or (if 0) visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, largest = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = _matrix(batch.column(1), dim)
                if copies:
                    last = np.sqrt(np.maximum(0, largest - _norms(x)))
                    found, far = graph.search(np.c_[x, last], min(copies, len(graph.centroids)))
                    r, c = np.nonzero(np.isfinite(far) & (far <= far[:, :1] * ratio**2 + 1e-12))
                    c = found[r, c]
                else:
                    r, c = graph.visited(np.c_[x, np.zeros(len(x))], visits, ratio)
                for first in range(0, len(r), OUT):
                    rows = pa.array(r[first : first + OUT], pa.int64())
                    yield pa.record_batch([pa.array(c[first : first + OUT], pa.int32()), *(col.take(rows) for col in batch.columns)], names=["list", *batch.schema.names])

    return run


def _best(k: int, dim: int):
    """One (list, chunk, query chunk): each query's k best rows by (score, smallest id)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, q = (_matrix(t["vector"].combine_chunks(), dim) for t in (right, left))
            ids, asking = right["class_id"].to_numpy(), left["class_id"].to_numpy()
            copies = right["ids"].combine_chunks()
            take = min(len(ids), k + 8)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                s = part @ x.T
                cut = np.partition(s, len(ids) - take, 1)[:, len(ids) - take]
                r, c = np.nonzero(s >= cut[:, None] - 1e-9)
                # The products again, each by itself and in one order, so that equal vectors have equal scores wherever they stand.
                exact = (part[r] * x[c]).sum(1)
                order = np.lexsort((ids[c], -exact, r))
                r, c, exact = r[order], c[order], exact[order]
                first = np.r_[0, np.flatnonzero(np.diff(r)) + 1] if len(r) else np.zeros(0, int)
                place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
                keep = place < k
                r, c, exact = r[keep], c[keep], exact[keep]
                out.append(pa.table([pa.array(asking[at + r]), pa.array(ids[c]), copies.take(pa.array(c)), pa.array(exact)], names=["asking", "class_id", "ids", "score"]))
        schema = pa.schema([("asking", pa.int64()), ("class_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    return run


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, vector (double): rows with an id and a finite vector other than zero, of the table's most frequent length."""
    v = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("vector", lambda e: e != 0)
    v = v.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine)
    length = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    # -0.0 and 0.0 are one value.
    return v.filter(F.size("vector") == (length.n if length else 0)).withColumn("vector", F.transform("vector", lambda e: e + F.lit(0.0)))


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", column: str = "embedding",
    sample: int = 20_000, per_list: int = 200, most_lists: int = 4096, replicas: int = 4, spread: float = 1.3, least: int = 48, share: float = 0.12, ratio: float = 1.12,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by inner product.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the
    query's own.  Nearest first, ties to the smaller id.  Null ids and vectors that are
    null, zero or hold null or non-finite components take no part, nor do those of another
    length than most.  A repeated row (same id and vector) is one row.  A query finds fewer
    than k if there are fewer.  The index is fitted on at most `sample` vectors and holds
    all.  An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, column).dropDuplicates()
    # Of equal vectors a query needs no more than the k + 1 smallest ids.
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    points = materialize(first.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("class_id", "vector", "ids"))
    stats = points.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, e: a + e * e)).alias("largest")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats.n:
        return spark.createDataFrame([], schema)
    dim, largest = stats.dim, stats.largest
    chosen = points.select("vector").orderBy(F.xxhash64("class_id"), "class_id").limit(sample).toArrow()
    x = _matrix(chosen["vector"].combine_chunks(), dim)
    x = np.c_[x, np.sqrt(np.maximum(0, largest - _norms(x)))]
    graph = Graph(balanced_centroids(x, int(min(len(x), most_lists, max(1, stats.n // per_list)))))
    shared = spark.sparkContext.broadcast((graph, largest))
    stored = materialize(points.mapInArrow(_to_lists(shared, replicas, 0, spread, dim), "list int, class_id long, vector array<double>, ids array<long>"))
    asked = materialize(rows.filter(F.col("vec_id") % every == 0).join(points.select("vector", "class_id"), "vector").select("vec_id", "class_id"))
    asking = points.join(asked.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "vector")
    visits = materialize(asking.mapInArrow(_to_lists(shared, 0, visits_of(len(graph.centroids), share, least), ratio, dim), "list int, class_id long, vector array<double>"))

    def chunks(of: DataFrame, size: int, name: str) -> DataFrame:  # at most `most_lists` rows
        return F.broadcast(of.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name)))

    n, m = chunks(stored, CHUNK, "chunks"), chunks(visits, QUERY_CHUNK, "parts")
    left = visits.join(n, "list").join(m, "list").withColumn("part", F.pmod(F.xxhash64("class_id"), "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = stored.join(n, "list").join(m, "list").withColumn("chunk", F.pmod(F.xxhash64("class_id"), "chunks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["list", "chunk", "part"]
    met = left.select(*keys, "class_id", "vector").groupBy(*keys).cogroup(right.select(*keys, "class_id", "vector", "ids").groupBy(*keys)).applyInArrow(_best(k + 1, dim), "asking long, class_id long, ids array<long>, score double")
    once = met.groupBy("asking", "class_id").agg(F.max("score").alias("score"), F.max("ids").alias("ids"))
    order = Window.partitionBy("asking").orderBy(F.desc("score"), "class_id")
    near = once.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).select("asking", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id"))).filter(F.col("nth") <= k + 1)
    found = near.groupBy("asking").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))  # k + 1 at most
    full = asked.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("asking")).join(found, "asking")
    others = F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return full.select("query_id", F.posexplode(others).alias("place", "e")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
