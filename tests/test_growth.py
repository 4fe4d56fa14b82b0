"""Steps that read each text once and lay out only what meets, held against plain loops."""

import math
import random
import re
from collections import Counter

import pyspark.sql.functions as F
import pytest

from palimpsest.functions import text as T
from palimpsest.operators import phrases, scoring

PIECES = ["my", "SQL", "my  sql", "ſql", "Straße", "STRASSE", "c++", "C", "+", "a.b", "a", "b", "İ", "i", "…", "日本", "K", "k", "\n", "é", "***"]


@pytest.mark.parametrize("listed", [64, 3, 0])
def test_phrases_within_groups_equal_the_pattern_of_each_pair(spark, monkeypatch, listed):
    """Small groups by lists, larger ones by hashes: the same pairs, rows alike and null groups too."""
    monkeypatch.setattr(phrases, "LISTED", listed)
    rnd = random.Random(17)
    say = lambda most: "".join(rnd.choice(PIECES) + rnd.choice([" ", " ", "\t "]) for _ in range(rnd.randint(0, most)))
    group = lambda: rnd.choice([None, *range(30)])
    texts = [(group(), i, say(30)) for i in range(150)] + [(1, 900, None), (2, 901, ""), (3, 902, "my sql"), (3, 902, "my sql")]
    asked = [(group(), i, say(rnd.choice([1, 2, 3, 12]))) for i in range(120)] + [(3, 200, "sql"), (3, 201, None), (3, 202, "  "), (3, 203, "my SQL"), (3, 203, "my SQL")]
    df, ph = spark.createDataFrame(texts, "conv_id long, turn long, text string"), spark.createDataFrame(asked, "conv_id long, no long, phrase string")
    got = phrases.find_mentions(df, ph, ("conv_id",))
    assert got.columns == ["conv_id", "turn", "no"]
    pairs = df.join(ph.filter(T.squeezed(F.col("phrase")) != ""), "conv_id").filter(T.mentions(F.col("text"), F.col("phrase"))).select("conv_id", "turn", "no")
    want = sorted(map(repr, pairs.collect()))
    assert sorted(map(repr, got.collect())) == want and len(want) > 40


def test_texts_are_read_once_for_small_groups(spark, tmp_path):
    spark.range(200).selectExpr("id % 20 conv_id", "id turn", "concat('word', id % 7, ' and more') text").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    asked = spark.createDataFrame([(c, f"word{c % 7}") for c in range(20)], "conv_id long, phrase string")
    got = phrases.find_mentions(texts, asked, ("conv_id",))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert got.count() == sum(i % 7 == i % 20 % 7 for i in range(200))


@pytest.mark.parametrize("few", [256, 5, 0])
def test_counted_words(spark, few):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = [(k, [rnd.choice(words) for _ in range(rnd.randint(0, 80))], rnd.sample([*words, "x"], rnd.randint(0, 30))) for k in range(200)]
    out = spark.createDataFrame(rows, "k int, w array<string>, a array<string>").select("k", T.counted_words(F.col("w"), F.col("a"), few).alias("o"))
    assert {r.k: {x.word: x.c for x in r.o} for r in out.collect()} == {k: {x: c for x, c in Counter(w).items() if x in a} for k, w, a in rows}


def test_relevance_equals_loop_and_reads_texts_once(spark, tmp_path):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(25)] + ["the", "Mention"]
    spans = [(c, s, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 15)))) for c in range(40) for s in range(rnd.randint(1, 6))] + [(None, 0, "w1")]
    now = [(c, " ".join(rnd.choice([*words, f"own{c}"]) for _ in range(rnd.randint(0, 8)))) for c in range(38)] + [(99, "w1")]
    spark.createDataFrame(spans, "conv_id long, span_no long, text string").write.parquet(str(tmp_path / "s"))
    got = scoring.lexical_relevance(spark.read.parquet(str(tmp_path / "s")), spark.createDataFrame(now, "conv_id long, now string"))
    asked = {c: set(re.findall("[a-z0-9]+", n.lower())) - {"the", "mention"} for c, n in now}
    want = {}
    for c, s, text in spans:
        own = [re.findall("[a-z0-9]+", t.lower()) for c2, _, t in spans if c2 == c]
        weight = {w: math.log(1 + len(own) / (1 + sum(w in o for o in own))) for w in asked.get(c, ())} if c is not None else {}
        counts = Counter(re.findall("[a-z0-9]+", text.lower()))
        want[c, s] = round(sum(x * counts[w] / (counts[w] + 1) for w, x in weight.items()) / sum(weight.values()), 9) if weight else 0.0
    assert {(r.conv_id, r.span_no): round(r.relevance, 9) for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower(text#") == 1
