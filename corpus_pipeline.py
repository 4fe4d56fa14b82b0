"""A corpus pipeline of five stages; each works on all that its predecessor kept and returns the columns of documents.

run() writes each stage's result as Parquet into the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe_codec, ngram_join, quality_rules, secret_scan, source_mixing
from palimpsest.llm.common import bounded, cut, row_key, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words, so they go. Long texts are judged whole. Repeated rows are judged alike. Columns other
    than those of documents are left out, whatever their names. An empty table stays empty.
    """
    return quality_rules.quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def _own_numbers(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a number for each pair of id and text, and the numbers of more than one row.

    The number is the id, except where ids are null or stand for several texts: there the text of least hash keeps the id, if
    there is one, and the other pairs get numbers from 2^62 up by a hash that is salted anew until none of them clashes.
    """
    keyed = docs.withColumn("key", row_key("text"))
    ids = cut(keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("least"), F.max("key").alias("most")).filter("rows > 1 or doc_id is null"))
    again = ids.filter("doc_id is not null and least = most").select(F.col("doc_id").alias("number"))
    shared_ids = ids.filter("doc_id is not null and least <> most").select("doc_id")
    if ids.filter("doc_id is null or least <> most").isEmpty():
        return docs.withColumn("number", F.col("doc_id")), again
    several = bounded(shared_ids)
    named = keyed.filter("doc_id is not null").join(several, "doc_id", "left_semi").select(*COLUMNS, "key")
    odd = named.union(keyed.filter("doc_id is null").select(*COLUMNS, "key"))
    pairs = odd.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows")).join(ids.filter("doc_id is not null").select("doc_id", F.col("least").alias("key"), F.lit(True).alias("first")), ["doc_id", "key"], "left")
    pairs, salt = cut(pairs), 0
    while True:
        drawn = F.xxhash64(F.lit(salt), "doc_id", "key").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
        numbers = cut(pairs.select("doc_id", "key", "rows", "first", F.when(F.col("first"), F.col("doc_id")).otherwise(drawn).alias("number")))
        new = numbers.filter("first is null").select("number")
        twice = new.groupBy("number").count().filter("count > 1").select("number")
        if twice.union(new.join(docs.select(F.col("doc_id").alias("number")), "number", "left_semi")).isEmpty():
            break
        salt += 1
    plain = docs.filter("doc_id is not null").join(several, "doc_id", "left_anti").select(*COLUMNS, F.col("doc_id").alias("number"))
    at = numbers.select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "number")
    given = odd.join(at, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).select(*COLUMNS, "number")
    return plain.union(given), again.union(numbers.filter("rows > 1").select("number"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram join links: the one whose id names it.

    A document is a pair of id and text: of rows alike in both, the first by all columns stays; different texts under one id, or
    without id, are different documents and go only if they are linked with another that stays. Null and empty texts link with
    nothing. Long texts are compared whole. Columns other than those of documents are left out. An empty table stays empty.
    """
    docs, again = _own_numbers(docs.select(*COLUMNS))
    found = cut(ngram_join.ngram_join(docs.select("number", "text"), id_col="number"))
    others = found.filter("number <> component_id").select("number").distinct()
    kept = docs.join(bounded(others.union(again).distinct()), "number", "left_anti").select(*COLUMNS)
    repeated = docs.join(bounded(again.join(others, "number", "left_anti")), "number", "left_semi")
    first = F.min(F.struct(*COLUMNS)).alias("row")  # summed where the rows are, before any shuffle
    return kept.union(repeated.groupBy("number").agg(first).select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by a mark and n_chars counted again.

    Null and empty texts hold no secret and stay as they are. Long texts are scanned whole. Repeated rows change alike. Columns
    other than those of documents are left out. An empty table stays empty.
    """
    found = secret_scan.secret_spans(docs.select(*COLUMNS)).withColumn("text", secret_scan.redact(F.col("text"), F.col("spans")))
    n_chars = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole; those that it doesn't take go.

    The mix is made over keys and sizes alone; texts are shuffled once, to meet their number of copies. Rows alike in all
    columns share their copies out evenly; what doesn't divide, at one key a source at most, is added by itself. Null and empty
    texts have size 0 and stay once. Long texts count by their words. A null source is a source of its own. Columns other than
    those of documents are left out. An empty table stays empty.
    """
    keyed = docs.select(*COLUMNS, row_key(*COLUMNS).alias("key"))
    sized = cut(keyed.select("key", "doc_id", "source", source_mixing.n_words("text").alias("size"), source_mixing.order_key("doc_id", "text").alias("order")))
    mixed = source_mixing.mix(sized, size="size", key="order", whole=True).groupBy("key").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows"))
    mixed = cut(mixed.select("key", F.expr("all div rows").alias("copies"), F.expr("all % rows").alias("more")))
    copied = lambda df, n: df.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("copy")).select(*COLUMNS)
    out = copied(keyed.join(mixed.filter("copies > 0").select("key", "copies"), "key"), "copies")
    uneven = mixed.filter("more > 0").select("key", "more")
    if not uneven.isEmpty():
        row = F.min(F.struct(*COLUMNS)).alias("row")
        out = out.union(copied(keyed.join(F.broadcast(uneven), "key").groupBy("key", "more").agg(row).select("more", "row.*"), "more"))
    return out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their number and whether they decode to the text.

    Null and empty texts have no ids and count as decoded. Long texts are encoded whole. Repeated rows are encoded alike. Columns
    other than those of documents are left out. An empty table stays empty.
    """
    coded = bpe_codec.encode_decode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources", mixing), ("BPE encoding and decoding", encoding)]

#: Compression, shingle hashing and byte-pair merging have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
