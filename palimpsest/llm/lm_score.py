"""Operator 13, LM scoring: prediction by partial matching.

A text's bytes, and an end after them, are predicted one by one from the `order` bytes before (a mark stands before the text's
start). The model is the trie of all byte contexts of the training texts with the counts of what followed. A symbol seen in the
longest context has its share there; else the model escapes, with the chance (distinct symbols) / (all + distinct symbols), to
the next shorter context, in which symbols that longer contexts know are excluded, down to a uniform choice among those never
seen. Beside it a word model gives a base score.

The trie grows with the corpus, so it is no broadcast. A context is written with its nearest byte first, then the symbol: one
number, whose order is the trie's order. Steps, all in Spark:

1. Texts are read in chunks of about `chunk` bytes. A chunk gives its distinct numbers with how often training texts have them,
   dealt into buckets by the two nearest bytes, likewise its words, by their hashes; and the texts themselves, written once.
2. Each bucket's numbers are merged, one chunk after another. All contexts of two bytes and more end in their bucket; the shorter
   ones are a table of 256 x 256 counts, and that goes through the driver.
3. Each bucket of the model meets the chunks' numbers one by one and answers them: log10 of the symbol's probability; for words
   their count.
4. A chunk's answers, then its texts, come to one task, which adds up what each text needs.

A task holds a bucket of the model or a chunk's answers, and one batch of texts. Neither grows with hot keys: a chunk asks once
for each of its distinct numbers.

Null text counts as empty: one end, which is scored. A text of any length is read whole, piece by piece. Words are known by
64-bit hashes. Rows may repeat and each is learned from. A null id is learned from. Without training rows each token has the
same base score, and each symbol the same chance. Other columns are left out, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import each, give_back, shared
from palimpsest.llm.shingles import word_hashes

#: Bytes of context, 2 to 6.
ORDER = 4
#: Bytes that UTF-8 never uses: before a text's start, and its end.
START, END = 0xFE, 0xFF
#: Symbols that may follow a context.
SYMBOLS = 255
#: The end of a text as a word.
LAST = np.uint64(0)
CHUNK = 16 << 20
#: Bytes read at a time.
PIECE = 1 << 20
#: Buckets of byte contexts, and of words after them.
GRAMS, WORDS = 128, 128
BYTE = np.uint64(8)


def contexts(text: bytes, order: int) -> Iterator[np.ndarray]:
    """For each symbol of a text, its end included, the number of context and symbol; piece by piece."""
    data = np.frombuffer(bytes([START]) * order + text + bytes([END]), np.uint8)
    for at in range(order, len(data), PIECE):
        n = min(PIECE, len(data) - at)
        number = np.zeros(n, np.uint64)
        for k in range(1, order + 1):
            number = number << BYTE | data[at - k : at - k + n]
        yield number << BYTE | data[at : at + n]


def words_of(text: bytes) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, and the end."""
    hashes = word_hashes(text, lower=True)
    return np.append(np.where(hashes == LAST, np.uint64(1), hashes), LAST)


def added(numbers: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, their counts summed."""
    number = np.concatenate(numbers) if numbers else np.zeros(0, np.uint64)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(number, kind="stable")
    number, count = number[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    return number[first], np.add.reduceat(count, first) if len(first) else count


class Sum:
    """Counts by number; what is new waits until it is as much as what there is."""

    def __init__(self):
        self.number, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.noted = 0
        self.raw: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

    def add(self, number: np.ndarray, count: np.ndarray) -> None:
        self.new.append((number, count))
        self.waiting += len(number)
        if self.waiting > max(1 << 18, len(self.number)):
            self.merge()

    def note(self, number: np.ndarray, learned: int) -> None:
        """Numbers one by one, each counted `learned` times; many texts are put in order together."""
        self.raw[learned].append(number)
        self.noted += len(number)
        if self.noted > PIECE:
            self.count_noted()

    def count_noted(self) -> None:
        for learned, some in enumerate(self.raw):
            if some:
                number, n = np.unique(np.concatenate(some), return_counts=True)
                some.clear()
                self.add(number, n * learned)
        self.noted = 0

    def settle(self) -> None:
        self.count_noted()
        self.merge()

    def merge(self) -> None:
        self.number, self.count = added([self.number, *(n for n, _ in self.new)], [self.count, *(c for _, c in self.new)])
        self.new, self.waiting = [], 0


def bucket_of(number: np.ndarray, order: int) -> np.ndarray:
    """The bucket of a context's number, by its two nearest bytes."""
    near = number >> np.uint64(8 * (order - 1))
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % GRAMS


def word_bucket(number: np.ndarray) -> np.ndarray:
    return GRAMS + (number >> np.uint64(50)).astype(np.int64) % WORDS


ROWS = "chunk long, bucket int, number binary, count binary, id {id}, text string, held_out boolean"


def chunks(docs: DataFrame, order: int, chunk: int) -> DataFrame:
    """ROWS: of each chunk its texts (bucket null), and by bucket its numbers with their counts in training texts. docs: id, text, held_out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held, size = (Sum(), Sum()), 0
        names = ["chunk", "bucket", "number", "count", "id", "text", "held_out"]
        kinds: list[pa.DataType] = []

        def asked() -> Iterator[pa.RecordBatch]:
            for table, of in zip(held, (lambda x: bucket_of(x, order), word_bucket), strict=True):
                table.settle()
                where = of(table.number)
                for b in np.unique(where).tolist():
                    own = where == b
                    row = [[at], [b], [table.number[own].tobytes()], [table.count[own].astype(np.int64).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)] + [pa.nulls(1, k) for k in kinds], names)

        for batch in batches:
            kinds = [c.type for c in batch.columns]
            first = 0
            for k, (text, out) in enumerate(zip(each(batch.column(1)), each(batch.column(2)), strict=True)):
                data = (text or "").encode()
                learned = int(not out)
                for piece in contexts(data, order):
                    held[0].note(piece, learned)
                held[1].note(words_of(data), learned)
                size += len(data)
                if size >= chunk or k + 1 == batch.num_rows:
                    some = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, at)), *(pa.nulls(some.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())), *some.columns], names)
                    first = k + 1
                if size >= chunk:
                    yield from asked()
                    at, held, size = at + 1, (Sum(), Sum()), 0
        if held[1].noted or held[1].waiting or len(held[1].number):
            yield from asked()
        give_back()

    return docs.select("id", "text", "held_out").mapInArrow(read, ROWS.format(id=docs.schema["id"].dataType.simpleString()))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket: its numbers and their counts, from rows (bucket, number, count) that come bucket by bucket."""
    bucket, table = None, Sum()

    def row() -> pa.RecordBatch:
        table.settle()
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([table.number.tobytes()], pa.binary()), pa.array([table.count.tobytes()], pa.binary())], ["bucket", "number", "count"])

    for batch in batches:
        for b, number, count in zip(*(each(c, 16) for c in batch.columns), strict=True):
            if b != bucket:
                if bucket is not None:
                    yield row()
                bucket, table = b, Sum()
            n = np.frombuffer(count, np.int64)
            table.add(np.frombuffer(number, np.uint64)[n > 0], n[n > 0])
    if bucket is not None:
        yield row()


def shorter(number: np.ndarray, count: np.ndarray, order: int) -> np.ndarray:
    """Counts by nearest byte and symbol, 256 x 256."""
    out = np.zeros(1 << 16, np.int64)
    near = number >> np.uint64(8 * order)
    np.add.at(out, (near << BYTE | number & np.uint64(255)).astype(np.int64), count)
    return out


class Trie:
    """A bucket's contexts of 2 bytes and more, and all shorter ones; each level knows its contexts' totals, and how much of the
    next shorter context's total falls to symbols that the context knows."""

    def __init__(self, number: np.ndarray, count: np.ndarray, short: np.ndarray, order: int):
        self.order = order
        self.entries = {order: (number, count)}
        for j in range(order - 1, 1, -1):
            above, n = self.entries[j + 1]
            self.entries[j] = added([above >> np.uint64(16) << BYTE | above & np.uint64(255)], [n])
        for j, counts in ((1, short), (0, short.reshape(256, 256).sum(axis=0))):
            known = np.flatnonzero(counts)
            self.entries[j] = known.astype(np.uint64), counts[known]
        self.nodes = {}
        for j, (keys, n) in self.entries.items():
            context = keys >> BYTE
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else n
            distinct = np.diff(np.append(first, len(keys)))
            below = np.zeros(len(first), np.int64)
            if j and len(first):
                _, n_below = self.find(j - 1, self.shorten(keys, j))
                below = np.add.reduceat(n_below, first)
            self.nodes[j] = context[first], total, distinct, below

    @staticmethod
    def shorten(keys: np.ndarray, j: int) -> np.ndarray:
        """The keys of level j at the next shorter context."""
        return keys >> np.uint64(16) << BYTE | keys & np.uint64(255) if j else keys

    @staticmethod
    def place(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return known[at] == wanted, at

    def find(self, j: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, n = self.entries[j]
        there, at = self.place(known, keys)
        return there, np.where(there, n[at], 0) if len(n) else np.zeros(len(keys), np.int64)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability after its context."""
        out = np.zeros(len(keys))
        left = np.ones(len(keys), bool)
        gone, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # excluded here: of the total, symbols
        for j in range(self.order, -1, -1):
            contexts_, total, distinct, below = self.nodes[j]
            node, at = self.place(contexts_, keys >> BYTE)
            node &= left
            if node.any():
                at = at[node]
                there, n = self.find(j, keys[node])
                symbols = distinct[at] - known[node]
                every = (total[at] - gone[node] + symbols).astype(float)
                part = np.where(there, n, symbols)
                out[node] += np.where(part > 0, np.log10(np.maximum(part, 1) / np.maximum(every, 1)), 0.0)
                left[np.flatnonzero(node)[there]] = False
                gone[node], known[node] = below[at], distinct[at]
            keys = self.shorten(keys, j)
        return out - np.where(left, np.log10(np.maximum(1, SYMBOLS - known)), 0.0)


def answers(model: DataFrame, rows: DataFrame, short: np.ndarray, order: int) -> DataFrame:
    """chunk, bucket, number, answer (float64 in bytes) for each of rows (chunk, bucket, number)."""

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, of = None, None
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for b, chunk, number, count in zip(*(each(c, 16) for c in batch.columns), strict=True):
                number = np.frombuffer(number, np.uint64)
                if b != bucket or chunk is None:
                    held = (number, np.frombuffer(count, np.int64)) if chunk is None else nothing
                    bucket, of = b, Trie(*held, short, order) if b < GRAMS else held
                if chunk is None:
                    continue
                if b < GRAMS:
                    found = of.log10(number)
                else:
                    there, at = Trie.place(of[0], number)
                    found = np.where(there, of[1][at], 0) if len(of[0]) else np.zeros(len(number))
                row = [pa.array([chunk], pa.int64()), pa.array([b], pa.int32()), pa.array([number.tobytes()], pa.binary()), pa.array([found.astype(float).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["chunk", "bucket", "number", "answer"])
        give_back()

    both = model.select("bucket", F.lit(None).cast("long").alias("chunk"), "number", "count").union(rows.select("bucket", "chunk", "number", F.lit(None).cast("binary")))
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    return dealt.mapInArrow(reply, "chunk long, bucket int, number binary, answer binary")


SCORES = "id {id}, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def summed(texts: DataFrame, replies: DataFrame, n_train: int, distinct: int, order: int) -> DataFrame:
    """SCORES of texts (chunk, id, text, held_out), each chunk's answers first."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, tables = None, ([], []), None
        for batch in batches:
            ids, out = [], []
            for k, (at, bucket, number, answer, text, held_out) in enumerate(zip(*(each(batch.column(c), 16) for c in ("chunk", "bucket", "number", "answer", "text", "held_out")), strict=True)):
                if at != chunk:
                    chunk, held, tables = at, ([], []), None
                if bucket is not None:
                    held[bucket >= GRAMS].append((np.frombuffer(number, np.uint64), np.frombuffer(answer, float)))
                    continue
                if tables is None:
                    tables = []
                    for some in held:
                        known, found = np.concatenate([n for n, _ in some]), np.concatenate([a for _, a in some])
                        order_ = np.argsort(known)
                        tables.append((known[order_], found[order_]))
                    held = ([], [])
                data = (text or "").encode()
                ppm = 0.0
                for piece in contexts(data, order):
                    distinct_, n = np.unique(piece, return_counts=True)
                    ppm += float((tables[0][1][np.searchsorted(tables[0][0], distinct_)] * n).sum())
                count = tables[1][1][np.searchsorted(tables[1][0], words_of(data))]
                base = float(np.log10((count + 0.5) / (n_train + 0.5 * (distinct + 1))).sum())
                ids.append(k)
                out.append((held_out, len(count), int((count > 0).sum()), base, ppm))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        give_back()

    kind = texts.schema["id"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    rows = replies.select("chunk", "bucket", "number", "answer", none(kind).alias("id"), none("string").alias("text"), none("boolean").alias("held_out"))
    rows = rows.union(texts.select("chunk", none("int"), none("binary"), none("binary"), "id", "text", "held_out"))
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("bucket").asc_nulls_last())
    return dealt.mapInArrow(score, SCORES.format(id=kind))


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def lm_score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """One row a document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10); learned from the rows not held out."""
    spark = docs.sparkSession
    shared(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/lm-{uuid.uuid4()}"
    chunks(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), held_out(id_col).alias("held_out")), order, chunk).write.parquet(f"{folder}/chunks")
    read = spark.read.parquet(f"{folder}/chunks")
    rows, texts = read.filter("bucket is not null").select("chunk", "bucket", "number", "count"), read.filter("bucket is null").select("chunk", "id", "text", "held_out")

    dealt = rows.select("bucket", "number", "count").repartition("bucket").sortWithinPartitions("bucket")
    dealt.mapInArrow(merged, "bucket int, number binary, count binary").write.parquet(f"{folder}/model")
    model = spark.read.parquet(f"{folder}/model")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, words = np.zeros(1 << 16, np.int64), [0, 0]
        for batch in batches:
            for b, number, count in zip(*(each(c, 4) for c in batch.columns), strict=True):
                number, count = np.frombuffer(number, np.uint64), np.frombuffer(count, np.int64)
                if b < GRAMS:
                    short += shorter(number, count, order)
                else:
                    words = [words[0] + int(count.sum()), words[1] + len(number)]
        at = np.flatnonzero(short)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int32()), pa.array([*words, *short[at].tolist()], pa.int64())], ["at", "n"])

    found = {r["at"]: r["n"] for r in model.mapInArrow(totals, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n_train, distinct = found.pop(-1, 0), found.pop(-2, 0)
    short = np.zeros(1 << 16, np.int64)
    short[list(found)] = list(found.values())

    out = summed(texts, answers(model, rows, short, order), n_train, distinct, order)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
