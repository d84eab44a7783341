"""Centroid clustering: Lloyd's rounds by a tree over the vectors and a tree over the centroids, walked together.

Vectors become integers, floor(1024 x) in each component, so distances, sums and means are exact and don't depend on how rows are dealt.
Each chunk of CHUNK vectors gets a cover tree once: a node covers its vectors within its radius, and its children are centred on vectors
that lie further apart than radius / BASE and cover theirs within that. Each round makes such a tree over the centroids and walks pairs
(vector node, centroid node) from the two roots: a pair goes when the nearest that its centroids can be to any of the node's vectors is
further than the furthest that another's centre can be. A node with one centroid left is taken whole, by prefix sums, without a look
at its vectors; the vectors of a leaf are compared with the centroids left to it, exactly, ties to the smaller number. Bounds are floating and are
widened by far more than their rounding, so that nothing within a tie is pruned.

Scale: chunks are rows of a written table, so each round is one scan of it without a shuffle of vectors; a task sends k sums and counts,
added up by ever fewer tasks. The driver holds k centroids. Nothing depends on how many vectors a cluster has.

Defined results: a vector is kept with exactly `size` components, none null, NaN or infinite; others have no row. Fewer vectors than k give as many
centroids; an empty table gives an empty result; equal vectors and equal vec_ids count each; a null vec_id comes last among the starts; equal starting hashes are
ordered by the vector. A component whose integer is beyond +-2^59 leaves its vector out like an infinite one. A distance or inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, SIZE, CLUSTERS, ROUNDS = 1024, 64, 8, 10
#: Vectors in a tree and in a leaf; the ratio of a node's radius to its children's; children of a node beyond which it stays a leaf.
CHUNK, LEAF, BASE, FAN = 1_024, 32, 1.3, 64
#: Tasks whose sums come to the driver.
FEW = 4
#: Up to FLOAT in size, components have squared distances that doubles hold exactly; up to LONG, ones that 64 bits hold.
FLOAT, LONG, MOST = 1 << 21, 1 << 27, 1 << 59


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, exactly (int64, or whole numbers of any size where these don't fit)."""
    most = max((int(np.abs(a).max()) for a in (x, y) if a.size), default=0)
    if most <= FLOAT:
        a, b = x.astype(float), y.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    kind = np.int64 if most <= LONG else object
    a, b = x.astype(kind), y.astype(kind)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


class CoverTree:
    """Nodes as arrays, a node's vectors are order[start:end]; children of a node are the nodes first[i] to first[i] + many[i]."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points.astype(float)
        self.order, self.centre, self.radius, self.start, self.end, self.first, self.many = np.arange(len(points)), [], [], [], [], [], []
        if len(points):
            self._add(0, len(points), 0)
            at = 0
            while at < len(self.centre):  # breadth first, so that siblings lie side by side
                self._split(at, leaf)
                at += 1
        self.centre, self.radius = np.array(self.centre, int), np.array(self.radius)
        self.start, self.end, self.first, self.many = (np.array(a, int) for a in (self.start, self.end, self.first, self.many))

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        d = self.points[rows] - self.points[centre]
        return np.sqrt((d * d).sum(axis=1))

    def _add(self, start: int, end: int, centre: int) -> None:
        self.centre.append(centre)
        self.start.append(start)
        self.end.append(end)
        self.radius.append(float(self._far(self.order[start:end], centre).max()))
        self.first.append(0)
        self.many.append(0)

    def _split(self, i: int, leaf: int) -> None:
        """Greedy net of the node's vectors at radius / BASE, its own centre first; each vector goes to its nearest."""
        rows, r = self.order[self.start[i] : self.end[i]], self.radius[i] / BASE
        if len(rows) <= leaf or not self.radius[i]:
            return
        centres, near = [self.centre[i]], self._far(rows, self.centre[i])
        owner = np.zeros(len(rows), int)
        while near.max() > r:
            if len(centres) == FAN:
                return  # spread in too many directions for a net to be smaller than the vectors
            centres.append(int(rows[near.argmax()]))
            d = self._far(rows, centres[-1])
            closer = d < near
            near[closer], owner[closer] = d[closer], len(centres) - 1
        self.order[self.start[i] : self.end[i]] = rows[np.argsort(owner, kind="stable")]
        sizes = np.bincount(owner, minlength=len(centres))
        ends = self.start[i] + np.cumsum(sizes)
        self.first[i], self.many[i] = len(self.centre), len(centres)
        for c, n, end in zip(centres, sizes, ends, strict=True):
            self._add(int(end - n), int(end), c)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of the nodes, and for each the position of its parent in `nodes`."""
        n = self.many[nodes]
        back = np.repeat(np.arange(len(nodes)), n)
        return self.first[nodes][back] + np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n), back


def assign(tree: CoverTree, comps: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """(nodes taken whole as (start, end, centroid); places in the order; their centroids) for all vectors of the tree.

    comps: the vectors as integers, in the order of the tree.
    """
    heads = CoverTree(centroids, leaf=1)
    whole, places, owners = [], [], []
    v, c = np.zeros(1, int), np.zeros(1, int)  # pairs of nodes, side by side for each vector node
    while len(v):
        d = tree.points[tree.centre[v]] - heads.points[heads.centre[c]]
        d = np.sqrt((d * d).sum(axis=1))
        slack = 1e-9 * (d + tree.radius[v] + heads.radius[c]) + 1e-9
        cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        most = np.minimum.reduceat(d + tree.radius[v] + slack, cuts)
        group = np.cumsum(np.r_[0, v[1:] != v[:-1]])
        keep = d - tree.radius[v] - heads.radius[c] - slack <= most[group]
        v, c = v[keep], c[keep]
        cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        n = np.diff(np.r_[cuts, len(v)])
        group = np.repeat(np.arange(len(cuts)), n)
        inner = np.maximum.reduceat(heads.radius[c], cuts)  # the widest centroid node left to each vector node
        alone = (n == 1) & (inner == 0)
        for i in cuts[alone]:
            whole.append((int(tree.start[v[i]]), int(tree.end[v[i]]), int(heads.order[heads.start[c[i]] : heads.end[c[i]]].min())))
        # The wider of the two is opened; a node that can't be opened leaves it to the other.
        rest = ~alone
        open_v = rest & (tree.many[v[cuts]] > 0) & ((inner == 0) | (tree.radius[v[cuts]] >= inner))
        leaf = rest & ~open_v & (inner == 0)
        for g in np.flatnonzero(leaf):
            at = slice(cuts[g], cuts[g] + n[g])
            tried = np.sort(np.concatenate([heads.order[heads.start[x] : heads.end[x]] for x in c[at]]))
            a, b = int(tree.start[v[cuts[g]]]), int(tree.end[v[cuts[g]]])
            places.append(np.arange(a, b))
            owners.append(tried[squared(comps[a:b], centroids[tried]).argmin(axis=1)])
        pairs = []
        by_v = open_v[group]
        if by_v.any():
            # Each child meets all centroid nodes that are left to its parent.
            own, back = tree.children(v[cuts[open_v]])
            left = n[open_v][back]
            at = np.repeat(cuts[open_v][back], left) + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
            pairs.append((np.repeat(own, left), c[at]))
        by_c = (rest & ~open_v & ~leaf)[group]
        if by_c.any():
            split = by_c & (heads.many[c] > 0)
            own, back = heads.children(c[split])
            still = by_c & ~split
            pv, pc = np.r_[v[split][back], v[still]], np.r_[own, c[still]]
            order = np.argsort(pv, kind="stable")
            pairs.append((pv[order], pc[order]))
        v, c = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, int) for i in (0, 1))
    return whole, np.concatenate(places) if places else np.zeros(0, int), np.concatenate(owners) if owners else np.zeros(0, int)


def _usable(size: int, vector: str = "embedding"):
    v = F.col(vector).cast("array<double>")
    inside = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(MOST) / SCALE))
    return (F.size(v) == size) & F.forall(v, inside)


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE) -> DataFrame:
    """(vec_id, comps array<long>) of the usable vectors."""
    ok = vectors.filter(F.col(vector).isNotNull()).filter(F.coalesce(_usable(size, vector), F.lit(False)))
    return ok.select(F.col(vec_id).alias("vec_id"), F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(SCALE)))).alias("comps"))


def _matrix(column, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, size).astype(np.int64)


def tree_table(kept: DataFrame, size: int = SIZE, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk: the vectors in the order of its tree, and the tree's nodes."""
    kind = kept.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk)
                comps = _matrix(part.column("comps"), size)
                t = CoverTree(comps)
                ids = part.column("vec_id").take(pa.array(t.order))
                row = [pa.array([ids.to_pylist()], pa.list_(ids.type))]
                row += [pa.array([np.ascontiguousarray(a, k).tobytes()], pa.binary()) for a, k in ((comps[t.order], np.int64), (np.argsort(t.order)[t.centre], np.int32), (t.radius, np.float64), (np.stack([t.start, t.end, t.first, t.many]), np.int32))]
                yield pa.RecordBatch.from_arrays(row, ["ids", "comps", "centre", "radius", "nodes"])

    return kept.mapInArrow(run, f"ids array<{kind.simpleString()}>, comps binary, centre binary, radius binary, nodes binary")


def opened(row: dict, size: int = SIZE) -> tuple[CoverTree, np.ndarray]:
    """The tree of a row of the table, over its vectors in that order."""
    comps = np.frombuffer(row["comps"], np.int64).reshape(-1, size)
    t = CoverTree(np.zeros((0, size)))
    t.points, t.order = comps.astype(float), np.arange(len(comps))
    t.centre, t.radius = np.frombuffer(row["centre"], np.int32).astype(int), np.frombuffer(row["radius"], np.float64)
    t.start, t.end, t.first, t.many = np.frombuffer(row["nodes"], np.int32).reshape(4, -1).astype(int)
    return t, comps


def owners_of(t: CoverTree, comps: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    whole, places, owners = assign(t, comps, centroids)
    out = np.empty(len(comps), int)
    out[places] = owners
    for a, b, k in whole:
        out[a:b] = k
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}


def _wide(x: np.ndarray) -> np.ndarray:
    """Whole numbers whose sums over a chunk may not fit 64 bits, as Python's."""
    return x.astype(object) if len(x) and int(np.abs(x).max()) > 2**62 // max(len(x), 1) else x


def next_centroids(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the means of the vectors nearest to each centroid; a centroid without any stays."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * k, np.zeros((k, size), object)
        for row in _rows(batches):
            t, comps = opened(row, size)
            whole, places, owners = assign(t, comps, centroids)
            upto = np.concatenate([np.zeros((1, size), np.int64), np.cumsum(_wide(comps), axis=0)])
            for a, b, j in whole:
                n[j], total[j] = n[j] + b - a, total[j] + (upto[b] - upto[a])
            for j in np.unique(owners):
                own = places[owners == j]
                n[j], total[j] = n[j] + len(own), total[j] + _wide(comps[own]).sum(axis=0)
        yield packed(n, total)

    def packed(n: list[int], total: np.ndarray) -> pa.RecordBatch:
        used = [j for j in range(k) if n[j]]
        cols = [pa.array(used, pa.int32()), pa.array([n[j] for j in used], pa.int64()), pa.array([[str(int(x)) for x in total[j]] for j in used], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, ["cluster", "n", "total"])

    def add(rows, n: list[int], total: np.ndarray) -> None:
        for r in rows:
            n[r["cluster"]] += r["n"]
            total[r["cluster"]] += np.array([int(x) for x in r["total"]], object)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * k, np.zeros((k, size), object)
        add(_rows(batches), n, total)
        yield packed(n, total)

    kinds = "cluster int, n long, total array<string>"
    sent, width = trees.drop("ids").mapInArrow(run, kinds), math.isqrt(max(1, int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for parts in sorted({width, min(width, FEW)}, reverse=True):
        sent = sent.repartitionById(parts, F.spark_partition_id() % parts).mapInArrow(again, kinds)
    n, total, out = [0] * k, np.zeros((k, size), object), centroids.copy()
    add(sent.collect(), n, total)  # k rows from each of FEW tasks
    for j in range(k):
        if n[j]:
            out[j] = [int(x) // n[j] for x in total[j]]
    return out


def first_centroids(kept: DataFrame, k: int = CLUSTERS, salt: str = "3:") -> np.ndarray:
    """The vectors with the k smallest hashes of their ids."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "comps").limit(k).collect()
    return np.array([r["comps"] for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, chunk: int = CHUNK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable vector."""
    if k < 1:
        raise ValueError("at least one cluster")
    spark, kept = vectors.sparkSession, kept_vectors(vectors, vec_id, vector, size)
    trees, centroids = materialise(tree_table(kept, size, chunk), "cover-trees"), first_centroids(kept, k)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    if len(centroids):
        for _ in range(rounds):
            moved = next_centroids(trees, centroids)
            if (moved == centroids).all():
                break  # all further rounds would do the same
            centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                t, comps = opened({c: row.column(c)[0].as_py() for c in row.schema.names if c != "ids"}, size)
                owner = owners_of(t, comps, centroids)
                far = np.empty(len(comps), object)
                for j in np.unique(owner):
                    far[owner == j] = squared(comps[owner == j], centroids[j : j + 1])[:, 0].tolist()
                cols = [row.column("ids").flatten(), pa.array(owner, pa.int32()), pa.array([str(int(x)) for x in far], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cluster", "far"])

    found = trees.mapInArrow(run, f"vec_id {id_type}, cluster int, far string").select("vec_id", "cluster", F.col("far").cast("decimal(38,0)").alias("far"))
    found = materialise(found, "clusters")
    short = F.col("far") <= F.lit(2**63 - 1)
    whole = found.groupBy("cluster").agg(F.sum(F.when(short, F.col("far"))).alias("far"), F.every(short).alias("short")).collect()  # k rows
    total = sum(int(r["far"]) if r["short"] else 2**63 for r in whole)
    fits = lambda x: x if x < 2**63 else None
    rows = [(r["cluster"], fits(int(r["far"])) if r["short"] else None, fits(total), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in whole]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    distance = F.when(short, F.col("far").cast("long"))
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", distance.alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> str:
    """The same by plain comparison: one step of assignment and one of means for each round."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {size} AND list_count(embedding) = {size} AND len(list_filter(embedding::DOUBLE[], lambda x: isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1)::INT AS k, x AS c FROM v QUALIFY k < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT n, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i})")
        steps.append(f"a{i} AS MATERIALIZED (SELECT n, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, k) = 1)")
        if i < rounds:
            means = f"SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, sum(y)::HUGEINT AS s, count(*) AS q, CASE WHEN s % q < 0 THEN s // q - 1 ELSE s // q END::BIGINT AS m FROM (SELECT k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM v JOIN a{i} USING (n)) GROUP BY k, i) GROUP BY k"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN ({means}) m ON m.k = c{i}.k)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (n) JOIN c{rounds} c ON c.k = a.k"""


ORACLE = _oracle()
