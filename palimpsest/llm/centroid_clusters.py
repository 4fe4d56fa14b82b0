"""Operator 11, centroid clustering: bit-plane popcount.

A vector of 64 whole numbers, floor(scale * x), is kept as bit planes in two's complement: plane p is one 64-bit word that holds
bit p of all components, and the last plane is the sign. A product of two components is the sum over pairs of their bits, so
x . c = sum over planes p, q of w_p * w_q * popcount(x_p & c_q), where w is 2**p, negative for the sign's plane. Dot products and
squared distances come out exactly.

Spark packs the vectors once; a round is one pass over the planes. Each task sums its vectors by cluster, Spark adds the sums up,
and only k centroids of 64 numbers pass through the driver, whatever the input's size. Centroids start as the k vectors with the
least hash of their id, so reruns agree; each round moves a centroid to the floor of its vectors' mean, and one without vectors
stays. A last pass assigns the vectors.

Vectors that are null, hold another number of components, or a null or non-finite one, are left out. Large components only take
more planes, which are then summed in Python's whole numbers; a distance or inertia beyond a long is given as the greatest long.
Rows may repeat: each counts, and of equal hashes the vector with the lesser planes comes first. A null id is hashed as no digits.
Equal distances go to the centroid with the smaller number. With fewer vectors than k there are as many centroids. Other columns
are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, each

DIMS = 64
K, ROUNDS, SCALE, SEED = 16, 3, 64, "1"
#: Planes whose products are summed in 64 bits; numbers of more planes are put together from such parts.
PART = 27
GREATEST = 2**63 - 1


def planes_of(numbers: np.ndarray) -> list[bytes]:
    """The planes of each row of (n, 64) finite whole numbers in float64, as few as it needs, eight bytes each."""
    if not len(numbers):
        return []
    if np.abs(numbers).max() >= 2.0**62:
        return [wide_planes([int(v) for v in row]) for row in numbers]
    whole = numbers.astype(np.int64)
    most = np.maximum(whole, ~whole).max(axis=1)
    n_planes = int(most.max()).bit_length() + 1
    bits = np.stack([np.packbits((whole >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(n_planes)], axis=1)
    return [row[: int(m).bit_length() + 1].tobytes() for row, m in zip(bits, most, strict=True)]


def wide_planes(numbers: list[int]) -> bytes:
    n_planes = max(v.bit_length() if v >= 0 else (~v).bit_length() for v in numbers) + 1
    return b"".join(sum((v >> p & 1) << k for k, v in enumerate(numbers)).to_bytes(8, "little") for p in range(n_planes))


def packed(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """id, planes of the vectors that take part."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            with np.errstate(over="ignore"):
                scaled = np.floor(scale * values)
            far = ~np.isfinite(scaled).all(axis=1)  # only near the end of what a double holds
            planes = np.empty(len(values), object)
            planes[~far] = planes_of(scaled[~far])
            planes[far] = [wide_planes([int(v) * scale if abs(v) > 2**60 else math.floor(scale * v) for v in row]) for row in values[far].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(planes.tolist(), pa.binary())], ["id", "planes"])

    chosen = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x")).filter((F.size("x") == DIMS) & finite)
    return chosen.mapInArrow(pack, f"id {chosen.schema['id'].dataType.simpleString()}, planes binary")


def dot(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x . c for each row of planes x (n, planes) and the planes c, or for each pair of rows; beyond 64 bits as Python's numbers."""
    n, m = x.shape[1], c.shape[-1]
    weights = 1 << np.arange(m, dtype=np.int64) % PART
    weights[-1] *= -1
    total = 0
    for a in range(0, n, PART):
        for b in range(0, m, PART):
            part = np.zeros(len(x), np.int64)
            for p in range(a, min(a + PART, n)):
                both = (np.bitwise_count(x[:, p, None] & c[..., b : b + PART]) @ weights[b : b + PART]) << p - a
                part += -both if p == n - 1 else both
            total = total + (part if max(n, m) <= PART else part.astype(object) * (1 << a + b))
    return total


def nearest(x: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of planes the number of the nearest centroid and the squared distance to it."""
    norm = dot(x, x)
    best, at = None, np.zeros(len(x), np.int32)
    for k, c in enumerate(centroids):
        far = norm - 2 * dot(x, c) + dot(c[None], c)[0]
        if best is None:
            best = far
        else:
            nearer = (far < best).astype(bool)
            best, at = np.where(nearer, far, best), np.where(nearer, np.int32(k), at)
    return at, best


def rows_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, planes) of a batch's rows, those with equally many planes together."""
    values = list(each(column, 4096))
    sizes = np.array([len(v) for v in values])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(values[k] for k in at), "<u8").reshape(len(at), -1)


def sums(planes: DataFrame, centroids: list[np.ndarray]) -> tuple[dict[int, list[int]], dict[int, int]]:
    """Of each cluster the sums of its vectors' components, and their number: k rows for each part of the planes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(DIMS, np.int64))
        n: dict[int, int] = defaultdict(int)
        for batch in batches:
            for _, x in rows_of(batch.column(0)):
                at, _ = nearest(x, centroids)
                for k in np.unique(at).tolist():
                    own = x[at == k]
                    n[k] += len(own)
                    for p in range(own.shape[1]):
                        bits = np.unpackbits(np.ascontiguousarray(own[:, p]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                        total[k, p // PART] += (-bits if p == own.shape[1] - 1 else bits) << p % PART
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.int32()), pa.array([n[k] for k, _ in keys], pa.int64()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.int64()))], ["k", "part", "n", "sums"])

    found = planes.select("planes").mapInArrow(add, "k int, part int, n long, sums array<long>").select("k", "part", "n", F.posexplode("sums"))
    whole: dict[int, list[int]] = defaultdict(lambda: [0] * DIMS)
    n: dict[int, int] = {}
    for r in found.groupBy("k", "part", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect():
        whole[r["k"]][r["pos"]] += r["s"] << r["part"] * PART
        n[r["k"]] = max(n.get(r["k"], 0), r["n"])
    return whole, n


def numbers_of(planes: bytes) -> list[int]:
    words = np.frombuffer(planes, "<u8").tolist()
    return [sum((w >> k & 1) << p for p, w in enumerate(words[:-1])) - ((words[-1] >> k & 1) << len(words) - 1) for k in range(DIMS)]


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row a vector that takes part: id_col, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    planes = cut(packed(vectors, id_col, vector, scale))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    means = [numbers_of(r["planes"]) for r in planes.select(hashed.alias("h"), "planes").orderBy("h", "planes").limit(k).collect()]
    as_planes = lambda: [np.frombuffer(wide_planes(m), "<u8") for m in means]
    for _ in range(rounds):
        total, n = sums(planes, as_planes())
        means = [[s // n[i] for s in total[i]] if n.get(i) else m for i, m in enumerate(means)]
    centroids = as_planes()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for rows, x in rows_of(batch.column(1)):
                at[rows], own = nearest(x, centroids)
                far[rows] = np.minimum(own, GREATEST)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), pa.array(far)], ["id", "cluster", "distance"])

    found = cut(planes.mapInArrow(assign, f"id {planes.schema['id'].dataType.simpleString()}, cluster int, distance long"))
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    by = {r["cluster"]: int(r["s"]) for r in inertia.collect()}
    rows = [(i, min(by.get(i, 0), GREATEST), min(sum(by.values()), GREATEST), hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for i, m in enumerate(means)]
    known = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
