"""The corpus pipeline, each stage against a plain version of it."""

import random

import public_tokenizers
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline as P
from palimpsest.llm import quality_rules, secret_scan
from tests.conftest import SF
from tests.llm.test_ops import plain_base, plain_join, plain_quality


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = {}
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        step[k] = docs.collect()
        if k < len(P.STAGES) - 1:
            assert tuple(docs.columns) == P.COLUMNS
    compress = zstandard.ZstdCompressor(level=3).compress
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def stays(t):
        n, *_, repeats = plain_quality(t)
        return n >= 10 and 100 * repeats <= 20 * n and quality_rules.compression(t.encode(), compress)[3]

    assert {r.doc_id for r in step[0]} == {r.doc_id for r in given if stays(r.text)}
    groups = plain_join([(r.doc_id, r.text) for r in step[0]])
    assert {r.doc_id for r in step[1]} == {i for i, (_, top) in groups.items() if i == top}
    before = {r.doc_id: r.text for r in step[1]}
    assert {r.doc_id for r in step[2]} == set(before)
    for r in step[2]:
        assert r.n_chars == len(r.text) and not secret_scan.base_spans(r.text)
        if not plain_base(before[r.doc_id])[0]:
            assert r.text == before[r.doc_id]
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert 1.3 < words(step[3]) / words(step[2]) < 1.7
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in step[3]}
    assert len(step[4]) == len(step[3])
    for r in step[4]:
        assert r.ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids and r.round_trip


def rows_of(spark, rows):
    """Rows of documents with extra columns whose names clash with what the stages add."""
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.selectExpr("*", "'x' as kept", "'x' as key", "1 as size", "'x' as copies", "'x' as spans", "'x' as ids")


def test_repeated_rows(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = rows_of(spark, [(1, text, "en", "a", 9)] * 40 + [(2, "w " * 7200, "en", "b", 1)])
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, "").collect()) == [1, 2]
    taken = P.source_mixing.mix(docs.select("doc_id", "text", "source"), whole=True).filter("doc_id = 1").collect()
    mixed = [r.doc_id for r in P.mixing(spark, docs, "").collect()]
    assert mixed.count(1) == sum(r.copies for r in taken) and 0 < mixed.count(1) <= 80
    one = rows_of(spark, [(1, text, "en", "a", 9)] * 40)
    assert P.mixing(spark, one, "").count() == 60  # 150 % of one source's words
    more = text + " more"
    nameless = rows_of(spark, [(None, text, "en", "a", 9)] * 5 + [(None, "other", "en", "a", 9)] * 2 + [(3, text, "en", "a", 9), (3, more, "en", "a", 9)])
    left = sorted((r.doc_id or 0, r.text) for r in P.near_duplicates(spark, nameless, "").collect())
    assert left in ([(0, "other"), (3, text)], [(0, "other"), (3, more)])


def test_texts_under_one_id(spark):
    """Texts under one id, or without, are documents of their own: each group that brute force links keeps one, none is lost."""
    rnd = random.Random(5)
    base = [" ".join(f"w{rnd.randrange(400)}" for _ in range(50)) for _ in range(12)]
    rows = [(rnd.choice([None, 1, 2, 2**62 + 7, 2**63 - 1, *range(10, 30)]), rnd.choice(base) + rnd.choice(["", " end", " x y"]), "en", "a", rnd.randrange(3)) for _ in range(150)]
    rows += [(1, None, "en", "a", 0), (1, "", "en", "a", 0), (None, None, "en", "a", 0), (None, None, "en", "a", 0)]
    left = [(r.doc_id, r.text) for r in P.near_duplicates(spark, rows_of(spark, rows), "").collect()]
    assert len(left) == len(set(left)) and set(left) <= {r[:2] for r in rows}
    pairs = sorted({r[:2] for r in rows}, key=repr)
    groups = plain_join([(k, t) for k, (_, t) in enumerate(pairs)])
    assert sorted(groups[pairs.index(p)][1] for p in left) == sorted({top for _, top in groups.values()})


def test_stages_of_odd_tables(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", None, 3), (4, "w" * 300_000, "en", "a", 1), (5, "password=abcdef123 " + "z1 " * 90_000, "de", "b", 2), (None, "lost", "en", "a", 4), (6, "one two", "en", "a", 7), (6, "one two", "en", "a", 7)]
    docs = rows_of(spark, odd)
    assert P.quality(spark, docs, "").count() == 0
    assert sorted(r.doc_id or 0 for r in P.near_duplicates(spark, docs, "").collect()) == [0, 1, 2, 3, 4, 5, 6]
    clean = {r.doc_id: r for r in P.secrets(spark, docs, "").collect()}
    assert clean[5].text.startswith("[secret] z1") and clean[5].n_chars == len(clean[5].text) and clean[1].text is None
    mixed = P.mixing(spark, docs, "").collect()
    assert {1, 2, 3} <= {r.doc_id for r in mixed} and all(tuple(r.__fields__) == P.COLUMNS for r in mixed)
    coded = P.encoding(spark, docs, "").collect()
    assert len(coded) == len(odd) and all(r.round_trip for r in coded) and coded[0].n_tokens == 0
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_run(spark):
    """run() chains the stages: with mixing's keys fixed by the rows, its rows are those of the stages one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in P.STAGES:
        docs = P.cut(f(spark, docs, SF))
    assert sorted(map(repr, P.run(spark, SF).collect())) == sorted(map(repr, docs.collect())) and P.ORACLE_SQL is None
