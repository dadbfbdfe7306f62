"""Centroid clustering: exact nearest centroids by a vantage-point tree, rebuilt and broadcast each round.

A round sends the tree of at most k centroids to the tasks. There every vector keeps its own best-first order of open
nodes; the vectors of a batch advance together, one node each. A node stays open while its lower bound, which the
triangle inequality gives, is not above the best distance so far: inclusive, so that ties are met. Bounds are floating
and lowered by more than their error; distances are exact integers. A task returns one row of exact sums per centroid,
so only (centroid, component) sums, k * dimensions of them, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionlab.llm.common import stage

#: Integer components are kept within this, so that a squared distance of 64 components fits a long.
LARGEST = 1 << 27
LEAF = 4
#: Vectors that advance together.
TOGETHER = 8192
SLACK = 1e-9


@dataclass
class Node:
    ids: np.ndarray
    #: (number of the child, least and greatest distance of its centroids from this node's centroid); a leaf has none.
    children: list[tuple[int, float, float]]


class Tree:
    """A vantage-point tree over the rows of an integer matrix. A node holds one centroid and two children, or up to LEAF centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.nodes = centroids, []
        if len(centroids):
            self.build(np.arange(len(centroids)))

    def build(self, ids: np.ndarray) -> int:
        number = len(self.nodes)
        self.nodes.append(Node(ids, []))
        if len(ids) <= LEAF:
            return number
        points = self.centroids[ids]
        vantage = int(((points - points.mean(0)) ** 2).sum(1).argmax())
        away = np.sqrt(((points - points[vantage]) ** 2).sum(1))
        rest = np.argsort(away, kind="stable")
        rest = rest[rest != vantage]
        node = self.nodes[number]
        node.ids = ids[[vantage]]
        for half in np.array_split(rest, 2):
            node.children.append((self.build(ids[half]), float(away[half].min()), float(away[half].max())))
        return number

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row (of equally near ones the smallest) and the squared distance."""
        parts = [self._nearest(vectors[lo : lo + TOGETHER]) for lo in range(0, len(vectors), TOGETHER)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(vectors)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids))
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0
        todo = np.arange(n)
        while len(todo):
            open_ = bound[todo]
            at = open_.argmin(1)
            low = open_[np.arange(len(todo)), at]
            alive = (low < np.inf) & (low <= np.sqrt(best[todo]) * (1 + SLACK))
            todo, at, low = todo[alive], at[alive], low[alive]
            bound[todo, at] = np.inf
            for number in np.unique(at):
                node, here = self.nodes[number], at == number
                rows = todo[here]
                for i in node.ids:
                    gap = vectors[rows] - self.centroids[i]
                    d = np.einsum("ij,ij->i", gap, gap)
                    nearer = (d < best[rows]) | ((d == best[rows]) & (i < who[rows]))
                    best[rows[nearer]], who[rows[nearer]] = d[nearer], i
                if node.children:
                    r = np.sqrt(d)
                    for child, least, most in node.children:
                        bound[rows, child] = np.maximum(low[here], np.maximum(r - most, least - r) - SLACK * (r + most))
        return who, best


def whole(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(vec_id, v): the usable vectors as packed 32-bit integers floor(256 * x)."""
    usable = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & usable)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)
            x = np.clip(x, -LARGEST, LARGEST).astype("<i4").reshape(len(batch), dimensions)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "v"])

    return kept.mapInArrow(pack, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v binary")


def unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimensions).astype(np.int64)


def centroid_sums(vectors: DataFrame, tree: Tree) -> list[tuple[int, int, int, int]]:
    """(centroid, component, vectors, sum) of the vectors nearest to each centroid: at most k * dimensions rows."""
    dimensions = tree.centroids.shape[1]
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n = sent.value, np.zeros(len(sent.value.centroids), np.int64)
        sums = np.zeros(tree.centroids.shape, np.int64)
        for batch in batches:
            if len(batch):
                v = unpacked(batch["v"], dimensions)
                who, _ = tree.nearest(v)
                n += np.bincount(who, minlength=len(n))
                order = np.argsort(who, kind="stable")
                some, first = np.unique(who[order], return_index=True)
                sums[some] += np.add.reduceat(v[order], first)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(add, "cluster int, n bigint, sums array<bigint>")
    exact = F.sum(F.col("x").cast("decimal(38,0)")).alias("total")
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), exact).collect()
    sent.unpersist()
    return [(r.cluster, r.i, r.n, int(r.total)) for r in rows]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector after `rounds` rounds, and the final centroids.

    vectors: vec_id, embedding; other columns are left out. Usable: exactly `dimensions` components, none null, NaN or
    infinite; other rows have no result. Components are floor(256 * x), brought into -2^27 .. 2^27. The first centroids
    are the k vectors whose vec_id has the least SHA-256 of salt + vec_id (a null id is spelt as nothing; of rows with one
    id the lesser components first), fewer where there are fewer vectors. A centroid without vectors stays. Ties of
    distance go to the smaller number. Repeated rows count each time. An empty table gives no rows.
    """
    kept = stage(whole(vectors, dimensions), "vectors")
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(name, "v").limit(k).select("v").collect()
    centroids = np.frombuffer(b"".join(r.v for r in first), "<i4").reshape(-1, dimensions).astype(np.int64)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for c, i, n, total in centroid_sums(kept, Tree(centroids)):
            moved[c, i] = total // n
        centroids = moved
    sent = vectors.sparkSession.sparkContext.broadcast(Tree(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                who, d = sent.value.nearest(unpacked(batch["v"], dimensions))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(who, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(assign, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint"), centroids


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64) -> DataFrame:
    """cluster() with the inertia of each row's cluster and of all, and the SHA-256 of its centroid."""
    assigned, centroids = cluster(vectors, k, rounds, dimensions)
    assigned = stage(assigned, "clusters")
    spread = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    told = [(c, total, sum(spread.values()), digest(c)) for c, total in spread.items()]
    told = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int, rounds: int) -> str:
    apart = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i])))"
    parts = ["kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
             " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k})"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT x.vec_id, any_value(x.v) AS v, min(CAST({apart} AS HUGEINT) * 4096 + y.c) AS best FROM kept x, c{r} y GROUP BY x.vec_id)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT best % 4096 AS c, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY 1, 2)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c) m ON m.c = o.c)")
    return f"""WITH {', '.join(parts)},
done AS (SELECT vec_id, CAST(best % 4096 AS INTEGER) AS cluster, CAST(best // 4096 AS BIGINT) AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256 FROM done JOIN c{rounds} ON c = cluster"""


CLUSTER_SQL = _sql(40, 5)
