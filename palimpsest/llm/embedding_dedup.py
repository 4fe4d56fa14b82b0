"""Operator 3, embedding near-dedup: subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. They are rotated (a fixed orthogonal matrix, so distances stay) and split
into blocks of few dimensions. The squared distance is the sum over blocks, so in some block it is at most that block's share
of the whole budget, in proportion to its dimensions. Each block is a range join: vectors fall into cells along the block's
first axes, as wide as the block's radius; a vector meets its own cell and the next ones. The union over blocks is verified
exactly; a pair that an earlier block finds too is left to that block, so each pair counts once without being listed.

Alike vectors of a label become one class first. Cells of over `per_cell` classes are cut into chunks, and each pair of chunks
is a task's group of its own. Tasks return link counts and local roots, at most one row for each vector they read.

Vectors that are null, empty, zero, or hold null or non-finite components, rows with a null label, and null ids link with
nothing; a null id has a null component and is kept. Vectors of different lengths don't link. Rows alike in id count as
vectors of their own. A column named like an output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut
from palimpsest.llm.components import components

LEAST_COSINE = 0.93
DIMS = 8
AXES = 1
PER_CELL = 2000
#: Added to budgets against rounding.
SLACK = 1e-9
#: Up to so many crowded cells (40 bytes each) are broadcast; beyond it Spark shuffles.
FEW = 100_000


@lru_cache(8)
def rotation(d: int) -> np.ndarray:
    """A fixed orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def rotated(unit: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; each row by itself, so that it comes out alike in every task, whatever rows stand beside it."""
    pairs = unit if len(unit) > 1 else np.repeat(unit, 2, axis=0)  # one row alone would be summed in another order
    return np.einsum("ij,kj->ik", pairs, rotation(unit.shape[1]))[: len(unit)]


def matrix(vectors: pa.Array) -> np.ndarray:
    """Arrow lists of one length and without nulls as rows, without a Python object a number."""
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)


def blocks(d: int, dims: int = DIMS) -> list[slice]:
    return [slice(k, min(k + dims, d)) for k in range(0, d, dims)]


def budgets(d: int, cosine: float, dims: int = DIMS) -> list[float]:
    whole = 2 - 2 * cosine + SLACK
    return [whole * (b.stop - b.start) / d for b in blocks(d, dims)]


def cells(vectors: pa.Array, cosine: float, dims: int, axes: int) -> pa.Array:
    """For each vector array<struct<block, cell, own>>: its home cell in each block, and as not own those that it probes."""
    lengths, parts = np.asarray(vectors.value_lengths()), []
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        x = rotated(units(matrix(vectors.take(pa.array(at)))))
        for k, (part, budget) in enumerate(zip(blocks(d, dims), budgets(d, cosine, dims), strict=True)):
            home = np.floor(x[:, part][:, :axes] / np.sqrt(budget)).astype(np.int64)
            for step in product((-1, 0, 1), repeat=home.shape[1]):
                if step >= (0,) * home.shape[1]:  # half of the neighbours: of two cells one probes the other
                    parts.append((at, k, home + step, not any(step)))
    # Laid out by vector; entries of a vector keep their order.
    rows = np.concatenate([at for at, *_ in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(rows, kind="stable")
    block = np.concatenate([np.full(len(at), k, np.int32) for at, k, *_ in parts]) if parts else np.zeros(0, np.int32)
    own = np.concatenate([np.full(len(at), o) for at, _, _, o in parts]) if parts else np.zeros(0, bool)
    cell = pa.concat_arrays([_lists(c) for _, _, c, _ in parts]) if parts else pa.array([], pa.list_(pa.int64()))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(vectors)))]).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(block[order]), cell.take(pa.array(order)), pa.array(own[order])], ["block", "cell", "own"])
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _joined(cosine: float, dims: int):
    def join(table: pa.Table) -> pa.Table:
        """Links among one pair of chunks of one cell: id, links (other vectors), root (least id linked here)."""
        k = table["block"][0].as_py()
        ids = np.asarray(table["id"])
        weight, role, own = np.asarray(table["n"]), np.asarray(table["role"]), table["own"].to_numpy(zero_copy_only=False).astype(bool)
        unit = units(matrix(table["vector"].combine_chunks()))
        d = unit.shape[1]
        parts, limits = blocks(d, dims), budgets(d, cosine, dims)
        here = unit @ rotation(d)[parts[k]].T  # this block alone; candidates are rotated whole, once
        x, done, fresh = np.empty_like(unit), np.zeros(len(unit), bool), np.zeros(len(unit), bool)
        homes, probes = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        count: dict[int, int] = {}
        root = {}

        def top(i):
            while root.setdefault(i, i) != i:
                root[i] = i = root[root[i]]
            return i

        p = here[probes]
        p2 = (p * p).sum(1)[None]
        for at in range(0, len(homes), 256):
            some = homes[at : at + 256]
            h = here[some]
            d2 = h @ (-2 * p.T)
            d2 += p2
            a, b = np.divmod(np.flatnonzero(d2 <= (limits[k] + 1e-7 - (h * h).sum(1))[:, None]), len(probes))
            a, b = some[a], probes[b]
            ok = ~own[b] | (ids[a] < ids[b])
            a, b = a[ok], b[ok]
            for e in range(0, len(a), 20_000):
                i, j = a[e : e + 20_000], b[e : e + 20_000]
                fresh[i] = fresh[j] = True
                new = np.flatnonzero(fresh & ~done)
                x[new], done[new] = rotated(unit[new]), True
                apart = (x[i] - x[j]) ** 2
                near = np.stack([apart[:, s].sum(1) <= limit for s, limit in zip(parts[: k + 1], limits, strict=False)])
                ok = near[k] & ~near[:k].any(0)
                i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                for u, v, nu, nv in zip(ids[i[ok]].tolist(), ids[j[ok]].tolist(), weight[i[ok]].tolist(), weight[j[ok]].tolist(), strict=True):
                    count[u] = count.get(u, 0) + nv
                    count[v] = count.get(v, 0) + nu
                    u, v = sorted((top(u), top(v)))
                    root[v] = u
        return pa.table({"id": pa.array(list(count), pa.int64()), "links": pa.array(list(count.values()), pa.int64()), "root": pa.array([top(i) for i in count], pa.int64())})

    return join


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = LEAST_COSINE, dims: int = DIMS, axes: int = AXES, per_cell: int = PER_CELL) -> DataFrame:
    """df's rows as id_col, n_links, component_id, kept."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    length = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = F.coalesce((F.size(vector) > 0) & finite & (length > 0) & F.col(label).isNotNull() & F.col(id_col).isNotNull(), F.lit(False))
    # Two hashes stand for a class, so that vectors are not sent twice.
    key = F.when(usable, F.struct(F.xxhash64(F.lit(1), label, vector).alias("x"), F.xxhash64(F.lit(2), label, vector).alias("y")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"), key.alias("key"))
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = cut(classes)

    @F.arrow_udf("array<struct<block:int,cell:array<long>,own:boolean>>")
    def placed(vectors: pa.Array) -> pa.Array:
        return cells(vectors, cosine, dims, axes)

    at = classes.select("id", "n", "label", F.size("vector").alias("d"), "vector", F.explode(placed("vector")).alias("c")).select("id", "n", "label", "d", "vector", "c.*")
    group = ["label", "d", "block", "cell"]
    crowded = cut(classes.select("label", F.size("vector").alias("d"), F.explode(placed("vector")).alias("c")).select("label", "d", "c.*").groupBy(group).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > per_cell).select(*group, F.ceil(F.col("rows") / per_cell).cast("int").alias("chunks")))
    # As a home a vector stands in its own cell; as a probe there and in later cells.
    roles = F.explode(F.when(F.col("own"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("role")
    many = at.select("*", roles).join(F.broadcast(crowded) if crowded.count() <= FEW else crowded, group, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    many = many.select("*", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    many = many.withColumns({"i": F.when(F.col("role") == 0, F.col("c")).otherwise(F.col("o")), "j": F.when(F.col("role") == 0, F.col("o")).otherwise(F.col("c"))})
    found = cut(many.select(*group, "i", "j", "id", "n", "role", "own", "vector").groupBy(*group, "i", "j").applyInArrow(_joined(cosine, dims), "id long, links long, root long"))

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    told = classes.select("key", "id", "n").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    told = told.select(F.col("key").alias("k"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "key").join(told, F.col("key") == F.col("k"), "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
