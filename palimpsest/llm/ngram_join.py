"""Operator 10, n-gram Jaccard join: set-relation skipping.

A document's set is its distinct 5-word shingles; documents link at 100 * intersection >= 80 * union. The steps, all in Spark:

1. Alike sets become one class, whose least id stands for it.
2. A fixed-size count of shingle buckets orders the shingles, rare first; any order that all sets share keeps the join exact.
   A set's prefix is its first n - ceil(0.8 n) + 1 shingles: linked sets share a shingle of their prefixes. Each prefix shingle
   that two classes share at least has an inverted list. An entry of a list carries its set's sketch: the parity of the number
   of shingles in each of 256 bins. Two sets differ in at least as many shingles as their sketches differ in bits.
3. Settling: a list's entries, the most central sets first, are compared with the list's leaders only. A set that a leader's
   sketch allows takes over the leader's answers and is not compared further; one that no leader takes becomes a leader. So a
   list proposes at most one pair for each entry, however large a group of near copies is. The pairs are compared in full;
   links form clusters.
4. The rest: lists are read again, sorted by size and position, in blocks. A block is skipped whole if no size or position in
   it can reach the overlap that a link needs, if all its sets are of one cluster with the block that it would meet, or if its
   distances to the list's leader rule it out: what the leader's answers are known to be, a set's own distance to the leader
   bounds. Single pairs then go by position, cluster and sketch. What is left is compared in full.
5. Links form components.

No pair is dropped: a pair is skipped only if it can't link or is connected. Lists of over `per_list` entries are cut into
chunks, and each pair of chunks is read by itself.

Null or empty text, and text without words, has an empty set and links with nothing. Rows alike in id are one document, and
link what any of them links. A null id links with nothing and has a null component. A text of any length is read whole; memory
for it grows with its number of words. Ties, such as equally central sets, go to the least id and change no result. A column
named like an output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from palimpsest.llm.common import cut, each, give_back
from palimpsest.llm.components import components
from palimpsest.llm.shingles import shingle_set

PERCENT = 80
#: Shingle buckets that are counted, and rows they are sent in.
BUCKETS, SEGMENTS = 1 << 21, 64
PER_LIST = 20_000
BLOCK = 64
#: Lists of so many entries are read together.
SHORT = 8
#: Bits of the sketch that list entries carry. A document's own sketch has as many bits as its size asks for.
BITS = 256
#: Leaders that a list keeps while it settles; what none of them takes is left to step 4.
LEADERS = 64
#: Times that lists settle before the rest of their pairs is listed.
SETTLINGS = 2
#: Up to so many ids (8 bytes each) are broadcast; beyond it Spark shuffles.
FEW = 100_000


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles that sets of n and m must share: 100 x >= percent (n + m - x)."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - ceil(Fraction(percent * n, 100)) + 1 if n else 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.uint16)
    sets: list[np.ndarray] = []

    def add() -> None:
        if sets:
            at, new = np.unique((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.uint32), return_counts=True)
            counts[at] = np.minimum(counts[at] + new, 65535)
            sets.clear()

    held = 0
    for batch in batches:
        for t in each(batch.column(0)):
            sets.append(shingle_set(t))
            held += len(sets[-1])
            if held > BUCKETS // 16:
                add()
                held = 0
    add()
    parts = counts.reshape(SEGMENTS, -1)
    full = [i for i in range(SEGMENTS) if parts[i].any()]
    yield pa.RecordBatch.from_pydict({"segment": pa.array(full, pa.int32()), "counts": pa.array([parts[i].tobytes() for i in full], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(each(batch.column(0)), each(batch.column(1)), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(data, np.uint16).astype(np.int64)
    sizes = [np.ceil(np.log2(x + 1.0)).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_pydict({"segment": pa.array(list(total), pa.int32()), "sizes": pa.array(sizes, pa.binary()), "n": pa.array([int(x.sum()) for x in total.values()], pa.int64())})


def bucket_sizes(docs: DataFrame, text: str) -> np.ndarray:
    """For each of BUCKETS buckets of shingles a rank by the number of sets that hold one, 0 for all that are not frequent.

    Counts cover all documents; what comes to the driver is SEGMENTS rows, 2 MB, whatever the input's size.
    """
    found = docs.select(text).mapInArrow(_counted, "segment int, counts binary")
    rows = found.repartition(SEGMENTS, "segment").mapInArrow(_summed, "segment int, sizes binary, n long").collect()
    sizes = np.zeros((SEGMENTS, BUCKETS // SEGMENTS), np.uint8)
    for r in rows:
        sizes[r["segment"]] = np.frombuffer(r["sizes"], np.uint8)
    usual = sum(r["n"] for r in rows) / BUCKETS  # what chance puts into a bucket
    usual = int(np.ceil(np.log2(1 + usual + 4 * np.sqrt(usual))))
    return np.maximum(sizes.reshape(-1).astype(np.int16) - usual, 0).astype(np.uint8)


def parity(s: np.ndarray, bits: int) -> bytes:
    """For each of `bits` bins, by the low bits of the hash, whether an odd number of shingles falls into it."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def bits_for(n: int, percent: int = PERCENT) -> int:
    """A power of two, four times the most shingles in which a set of n and a linked one can differ, or more."""
    return 1 << max(6, int(np.ceil(np.log2(max(1, 8 * n * (100 - percent) / (100 + percent))))))


def apart(x: bytes | np.ndarray, y: bytes | np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded to the shorter; sets differ in as many shingles at least."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def features(docs: DataFrame, id_col: str, text: str, percent: int = PERCENT) -> DataFrame:
    """One row a document: id, n, digest of the set (d1, d2), prefix, how many shingles of it are `rare`, and sketches.

    The sketch `own` is as long as n asks for, `fixed` has BITS.
    """
    sizes = docs.sparkSession.sparkContext.broadcast(bucket_sizes(docs, text))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sizes.value
        for batch in batches:
            out = []
            for t in each(batch.column(1)):
                s = shingle_set(t)
                ranks = rank[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                order = np.lexsort((s, ranks))[: prefix_length(len(s), percent)]
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                out.append((len(s), *digest, int((ranks[order] == 0).sum()), s[order].astype(np.int64), parity(s, bits_for(len(s), percent)), parity(s, BITS)))
            n, d1, d2, rare, prefix, own, fixed = zip(*out, strict=True) if out else ((),) * 7
            columns = [batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, d1, d2, rare)), pa.array(prefix, pa.list_(pa.int64())), pa.array(own, pa.binary()), pa.array(fixed, pa.binary())]
            del out, prefix, own, fixed
            give_back()
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d1", "d2", "rare", "prefix", "own", "fixed"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(of, "id long, n long, d1 long, d2 long, rare long, prefix array<long>, own binary, fixed binary")


@F.arrow_udf(LongType())
def shared_shingles(a: pa.Array, b: pa.Array) -> pa.Array:
    """Shingles that two sets, given as sorted 64-bit hashes, have in common."""
    out = []
    for x, y in zip(a, b, strict=True):
        both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
        both.sort(kind="stable")  # merges two sorted runs
        out.append(int((both[1:] == both[:-1]).sum()))
    return pa.array(out, pa.int64())


@F.arrow_udf(BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    return pa.array([shingle_set(t).tobytes() for t in each(texts)], pa.binary())


@F.arrow_udf(LongType())
def bits_apart(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([apart(x.as_buffer(), y.as_buffer()) for x, y in zip(a, b, strict=True)], pa.int64())


def links_among(pairs: DataFrame, alone: DataFrame, docs: DataFrame, id_col: str, text: str, percent: int) -> DataFrame:
    """Those of pairs (a, b) that link. Whole sets are made and sent only for pairs that their own sketches leave open."""
    ends = [alone.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab"]
    met = pairs.select("a", "b").join(ends[0], "a").join(ends[1], "b")
    most = (F.col("n_a") + F.col("n_b") - bits_apart("own_a", "own_b")) / 2  # shingles that the two can share
    able = cut(met.filter(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)).select("a", "b").distinct())
    wanted = able.select(F.col("a").alias("id")).union(able.select("b")).distinct()
    if able.count() <= FEW:
        wanted = F.broadcast(wanted)
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    sets = cut(known.select("id", packed("text").alias("set")))
    one = able.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").withColumn("shared", shared_shingles("set_a", "set_b"))
    size = (F.octet_length("set_a") + F.octet_length("set_b")) / 8
    return cut(both.filter(100 * F.col("shared") >= percent * (size - F.col("shared"))).select("a", "b").distinct())


NAMES = ("token", "i", "j", "n", "pos", "cluster", "id", "side")


class Lists:
    """Inverted lists of rows that follow each other by (token, i, j), read one list, or many short ones, at a time."""

    def __init__(self, percent: int, settle: bool):
        self.percent, self.settle = percent, settle

    def able(self, c, bits, a, b) -> np.ndarray:
        """Whether the entries a and b of a list may link by size, chunk, cluster and sketch."""
        n, cluster, doc, side = c["n"], c["cluster"], c["id"], c["side"]
        ok = (doc[a] != doc[b]) & (cluster[a] != cluster[b]) & ((side[a] == 0) & (side[b] == 0) | (side[a] != side[b]))
        ok &= np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * self.percent
        # Sets that differ in d shingles share (n + m - d) / 2.
        room = n[a] + n[b] - 2 * least_overlap(n[a], n[b], self.percent)
        ok[ok] &= np.bitwise_count(bits[a[ok]] ^ bits[b[ok]]).sum(1, dtype=np.int64) <= room[ok]
        return ok

    def placed(self, c, a, b) -> np.ndarray:
        """Whether positions leave room for a link of a and b, if this list's shingle is the first that they share."""
        n, pos = c["n"], c["pos"]
        return np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least_overlap(n[a], n[b], self.percent)

    def short(self, c, bits, place):
        """Pairs of many short lists at once: each entry against the next, the one after it, and so on."""
        taken = np.zeros(len(place), bool)
        for step in range(1, SHORT):
            a = np.flatnonzero(place[:-step] == place[step:])
            if self.settle:
                a = a[~taken[a + step]]
            if not len(a):
                continue
            if not self.settle:
                a = a[self.placed(c, a, a + step)]
            a = a[self.able(c, bits, a, a + step)]
            taken[a + step] = True
            yield a, a + step

    def leaders(self, c, bits, here):
        """One pair at most for each entry of a list: with the first leader that may take it."""
        heads = np.zeros(0, np.int64)
        for first in range(here.start, here.stop, BLOCK * 16):
            left = np.arange(first, min(first + BLOCK * 16, here.stop))
            for h in heads:
                left = yield from self.taken(c, bits, h, left)
            while len(left) and len(heads) < LEADERS:
                heads = np.append(heads, left[0])
                left = yield from self.taken(c, bits, left[0], left[1:])

    def taken(self, c, bits, head, left):
        ok = self.able(c, bits, np.full(len(left), head), left)
        yield np.full(int(ok.sum()), head), left[ok]
        return left[~ok & (c["id"][left] != c["id"][head])]

    def blocks(self, c, bits, here):
        """Pairs of one long list, sorted by size and position, block by block."""
        n, pos, cluster = c["n"][here], c["pos"][here], c["cluster"][here]
        starts = np.arange(0, len(n), BLOCK)
        ends = np.minimum(starts + BLOCK, len(n))
        low_n, high_n, low_pos = n[starts], n[ends - 1], np.minimum.reduceat(pos, starts)
        least_c, most_c = np.minimum.reduceat(cluster, starts), np.maximum.reduceat(cluster, starts)
        far = np.bitwise_count(bits[here] ^ bits[here.start + len(n) // 2]).sum(1, dtype=np.int64)  # distance to a leader
        near_f, far_f = np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts)
        for k in range(len(starts)):
            m = np.arange(k, len(starts))
            ok = (low_n[m] * self.percent <= high_n[k] * 100) & ~((least_c[m] == most_c[m]) & (least_c[k] == most_c[k]) & (least_c[m] == least_c[k]))
            ok &= 1 + np.minimum(high_n[k] - low_pos[k] - 1, high_n[m] - low_pos[m] - 1) >= least_overlap(low_n[k], low_n[m], self.percent)
            ok &= np.maximum(near_f[m] - far_f[k], near_f[k] - far_f[m]) <= high_n[k] + high_n[m] - 2 * least_overlap(high_n[k], high_n[m], self.percent) + 2
            for s in m[ok]:
                a, b = np.meshgrid(np.arange(starts[k], ends[k]), np.arange(starts[s], ends[s]), indexing="ij")
                a, b = a.ravel() + here.start, b.ravel() + here.start
                a, b = a[a < b], b[a < b]
                ok_placed = self.placed(c, a, b)
                a, b = a[ok_placed], b[ok_placed]
                ok_able = self.able(c, bits, a, b)
                yield a[ok_able], b[ok_able]

    def pairs(self, c, bits, bounds):
        sizes = np.diff(bounds)
        place = np.repeat(np.arange(len(sizes)), sizes)
        few = np.flatnonzero(sizes[place] <= SHORT)
        found = [(few[a], few[b]) for a, b in self.short({k: v[few] for k, v in c.items()}, bits[few], place[few])] if len(few) else []
        for k in np.flatnonzero(sizes > SHORT):
            found += (self.leaders if self.settle else self.blocks)(c, bits, slice(int(bounds[k]), int(bounds[k + 1])))
        a, b = (c["id"][np.concatenate(x)] for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = {name: np.zeros(0, np.int64) for name in NAMES}, np.zeros((0, BITS // 64), np.uint64)

        def columns_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            own = {name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in batch.schema.names if name != "fixed"}
            return {name: own.get(name, np.zeros(batch.num_rows, np.int64)) for name in NAMES}

        def read_on(last: bool):
            new = np.flatnonzero(np.any([held[x][1:] != held[x][:-1] for x in ("token", "i", "j")], axis=0)) + 1
            bounds = np.concatenate([[0], new, [len(bits)] if last else []]).astype(np.int64)
            ends = bounds[-1]
            pairs = self.pairs({k: v[:ends] for k, v in held.items()}, bits[:ends], bounds) if ends else np.zeros((2, 0), np.int64)
            batch = pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
            return batch, {k: v[ends:] for k, v in held.items()}, bits[ends:]

        for batch in batches:
            if batch.num_rows:
                new = columns_of(batch)
                held = {k: np.concatenate([v, new[k]]) for k, v in held.items()}
                fixed = b"".join(each(batch.column("fixed")))
                bits = np.concatenate([bits, np.frombuffer(fixed, np.uint64).reshape(batch.num_rows, -1)])
                found, held, bits = read_on(False)
                yield found
        if len(bits):
            yield read_on(True)[0]
        give_back()


def live_entries(alone: DataFrame) -> DataFrame:
    """token, id, pos, rows: the prefix shingles that `rows` classes, two at least, have in their prefixes.

    Rare shingles are counted where they meet; there are at most a bucket's usual number of each. Others are summed beforehand.
    """
    entries = alone.select("id", "rare", F.posexplode("prefix").alias("pos", "token"))
    rare = entries.filter("pos < rare").select("token", "id", "pos").withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("token")))
    frequent = entries.filter("pos >= rare").select("token", "id", "pos")
    rows = frequent.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    return rare.union(frequent.join(rows, "token").select("token", "id", "pos", "rows")).filter("rows > 1")


def open_lists(live: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of live's lists those whose sets are not all of one cluster. clusters: id, cluster."""
    ends = live.select("token", "id").join(clusters, "id").groupBy("token").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y"))
    return live.join(ends.filter("x < y").select("token"), "token", "left_semi")


def proposed(live: DataFrame, sets: DataFrame, percent: int, per_list: int, settle: bool) -> DataFrame:
    """Distinct pairs (a < b) of different clusters: to settle, at most one an entry; else all that may link. sets: id, n, cluster, central, fixed."""
    entries = live.join(sets, "id")
    # An entry of chunk c meets chunk j >= c as the first, and chunk i < c as the second.
    chunks = F.ceil(F.col("rows") / per_list).cast("int")
    c = F.pmod(F.xxhash64("id"), chunks).cast("int")
    entries = entries.select("*", c.alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("o"))
    side = F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2)
    entries = entries.select("token", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), side.alias("side"), "n", "pos", "id", "cluster", "fixed", *(["central"] if settle else []))
    order = [F.desc("central"), "id"] if settle else ["n", "pos", "id"]
    dealt = entries.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", *order)
    return dealt.mapInArrow(Lists(percent, settle), "a long, b long").distinct()


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, per_list: int = PER_LIST) -> DataFrame:
    """One row a document: id_col, n_shingles, component_id."""
    known = cut(features(docs, id_col, text, percent))
    full = known.filter("n > 0 and id is not null")
    alone = cut(full.groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"), F.first("own").alias("own"), F.first("fixed").alias("fixed")))
    same = full.select("id", "n", "d1", "d2").join(alone.select("n", "d1", "d2", F.col("id").alias("rep")), ["n", "d1", "d2"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    live = cut(live_entries(alone))
    # Sets whose prefix others have too, and have often, stand in the middle of their group; so do those with many copies.
    weight = live.groupBy("id").agg(F.sum(F.log2("rows")).alias("w"))
    central = F.round(F.col("w") / F.size("prefix") * 1000).cast("long") * 1000 + F.least(F.col("copies"), F.lit(999))
    sets = cut(alone.join(weight, "id").select("id", "n", "fixed", central.alias("central")))
    links, clusters = None, sets.select("id", F.col("id").alias("cluster"))
    for settle in [True] * SETTLINGS + [False]:
        pairs = cut(proposed(live, sets.join(clusters, "id"), percent, per_list, settle))
        more = links_among(pairs, alone, docs, id_col, text, percent)
        links = more if links is None else links.union(more)
        if settle:
            nodes = components(links).select(F.col("node").alias("id"), "component")
            clusters = sets.select("id").join(nodes, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
            live = cut(open_lists(live, clusters))

    found = components(same.union(links))
    return known.select("id", "n").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
