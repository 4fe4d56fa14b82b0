"""Phrases in texts and late facts, held against plain loops."""

import random
import time

import pyspark.sql.functions as F
import pytest

from palimpsest.functions import text as T
from palimpsest.operators import evals, facts
from palimpsest.operators.phrases import find_mentions

PIECES = ["my", "SQL", "my  sql", "ſql", "Straße", "STRASSE", "straẞe", "c++", "C", "+", "a.b", "a", "b", "İ", "i", "ΟΔΟΣ", "οδος", "…", "日本", "K", "k", "\n", " ", "x_1", "é", "é", "***"]


def test_phrases_equal_the_pattern_of_each_pair(spark):
    rnd = random.Random(11)
    say = lambda most: "".join(rnd.choice(PIECES) + rnd.choice(["", " ", " ", "\t "]) for _ in range(rnd.randint(0, most)))
    texts = [(rnd.choice([None, *range(60)]), say(40)) for _ in range(150)] + [(1, None), (2, ""), (None, "my sql"), (None, "my sql")]
    texts += [(99, "word " * 20_000 + "my sql at last")]
    phrases = [(i, say(rnd.choice([1, 2, 3, 12]))) for i in range(150)] + [(200, None), (201, "  "), (202, "my sql at last"), (202, "my sql at last")]
    df, ph = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "no long, phrase string")
    got = sorted(map(repr, find_mentions(df, ph).collect()))
    each = df.crossJoin(ph.filter(T.squeezed(F.col("phrase")) != "")).filter(T.mentions(F.col("text"), F.col("phrase")))
    want = sorted(map(repr, each.select("id", "no").collect()))
    assert got == want and len(got) > 300


def test_phrases_stay_within_their_group(spark):
    texts = spark.createDataFrame([(1, 0, "We use Postgres."), (2, 0, "We use postgres"), (2, -1, "MySQL"), (None, 3, "MySQL")], "conv_id long, turn_index long, content string")
    probes = spark.createDataFrame([(1, 1, ["MySQL"]), (2, 1, ["mysql", "x"]), (2, 2, ["Postgres", "mysql"]), (2, 3, []), (3, 1, ["we"])], "conv_id long, probe_id long, accept array<string>")
    got = {(r.conv_id, r.probe_id): r.presence for r in evals.answer_presence(probes, texts).collect()}
    assert got == {(1, 1): "absent", (2, 1): "condensed", (2, 2): "verbatim", (2, 3): "absent", (3, 1): "absent"}
    assert find_mentions(texts.limit(0).withColumnRenamed("content", "text"), spark.createDataFrame([("a",)], "phrase string")).count() == 0


def test_many_phrases(spark):
    """100,000 phrases of words that all texts hold meet few texts, so the time is that of reading the texts."""
    texts = spark.range(300).select("id", F.expr("array_join(transform(sequence(1, 400), i -> concat('w', xxhash64(id, i) & 511)), ' ')").alias("text"))
    phrases = spark.range(100_000).select(F.col("id").alias("no"), F.expr("array_join(transform(sequence(1, 6), i -> concat('w', xxhash64(id, -i) & 511)), ' ')").alias("phrase"))
    start = time.time()
    assert find_mentions(texts, phrases.union(texts.selectExpr("-id", "substring_index(text, ' ', 9)"))).filter("no = -id").count() == 300
    assert time.time() - start < 60


@pytest.mark.parametrize("text", ["Straße", "ΟΔΟΣ ΟΔΟΣ'Α", "ﬁne ﬀ", "ŉ", "ſ", "İı", "ẞ", "Ꭰꭰ", "ᾳ ᾼ", "𐐀", "a[b]^"])
def test_case_is_folded(spark, text):
    assert spark.range(1).select(T.folded(F.lit(text))).first()[0] == text.casefold()


SHAPE = "conv_id long, message_turn long, seq long, topic_label string, content string, knowledge_type string, speaker string"


def loop(rows):
    """Facts of one conversation in order, with whether each is on record."""
    force, out = {}, []
    for turn, seq, filed, topic, value, who in rows:
        key = (topic, value) if topic == "general" else topic
        if key in force and not filed and (force[key][0] == value or (who == "assistant" and force[key][1] == "user")):
            continue
        force[key] = (value, who)
        out.append((turn, seq, topic, value, who))
    return out


@pytest.mark.parametrize("speakers", [["user", "assistant"], ["user", "assistant", None]])
def test_late_facts_equal_loop(spark, speakers):
    rnd = random.Random(3)
    cases = {c: sorted((rnd.randrange(12), i, rnd.random() < 0.4, rnd.choice(["x", "y", "general"]), rnd.choice("abc"), rnd.choice(speakers)) for i in range(rnd.randint(1, 14))) for c in range(300)}
    table = lambda filed: spark.createDataFrame([(c, t, s, topic, v, "fact", who) for c, rows in cases.items() for t, s, f, topic, v, who in rows if f == filed], SHAPE)
    want = sorted(repr((c, *r)) for c, rows in cases.items() for r in loop(rows))
    for form in (facts.late_facts, facts.fold_facts) if None not in speakers else (facts.fold_facts,):
        rows = form(table(False), table(True)).collect()
        assert sorted(repr((r.conv_id, r.message_turn, r.seq, r.topic_label, r.content, r.speaker)) for r in rows) == want
        last = {}
        for r in sorted(rows, key=lambda r: (r.message_turn, r.seq)):
            last[r.conv_id, r.topic_label] = r
        assert all((r.knowledge_status == "active") == (r.topic_label == "general" or last[r.conv_id, r.topic_label] is r) for r in rows)


def test_a_topic_of_many_facts(spark):
    rows = spark.range(100_000).selectExpr("1L conv_id", "id message_turn", "0L seq", "'db' topic_label", "concat('v', id % 7) content", "'fact' knowledge_type", "if(id % 3 = 0, 'assistant', 'user') speaker")
    start = time.time()
    n = {form(rows.filter("message_turn % 5 > 0"), rows.filter("message_turn % 5 = 0")).count() for form in (facts.late_facts, facts.fold_facts)}
    assert len(n) == 1 and time.time() - start < 60
    assert facts.late_facts(rows.limit(0), rows.limit(0)).count() == 0


def test_pattern_tries_the_first_letter_first(spark):
    """The pattern with its first letter ahead finds what the plain one finds."""
    rnd = random.Random(5)
    say = lambda most: "".join(rnd.choice(PIECES) + rnd.choice(["", " ", "\t "]) for _ in range(rnd.randint(1, most)))
    df = spark.createDataFrame([(say(12), rnd.choice(PIECES + [say(2)])) for _ in range(3000)] + [("a" * 9, ""), ("𝔸b", "𝔸B"), ("x 𝔸", "𝔸")], "text string, phrase string")
    escaped = F.regexp_replace(T.squeezed(F.col("phrase")), r"([^\p{L}\p{N}\s_])", r"\\$1")
    plain = F.concat(F.lit(r"(?iU)(?<!\w)"), F.replace(escaped, F.lit(" "), F.lit(r"\s+")), F.lit(r"(?!\w)"))
    both = df.select("*", T.mentions(F.col("text"), F.col("phrase")).alias("m"), F.regexp_like("text", plain).alias("p"))
    assert both.filter("m <> p").count() == 0 and both.filter("m").count() > 100 and T.phrase_pattern(F.lit("b c")) is not None
    assert df.limit(1).select(T.phrase_pattern(F.lit("+b")).alias("x")).first().x.startswith(r"(?iU)(?=\+)")


def test_folding_letters_of_long_texts(spark):
    """Ligatures of any kind fold as the rule says, beside long texts that hold none and cost little."""
    several = [c for c in map(chr, range(0x110000)) if c.lower() == c != c.casefold() and len(c.casefold()) > 1]
    rows = spark.createDataFrame([(f"é {c} é",) for c in several] + [("Plain TEXT\u0085\u00a0 \t x ",)], "t string").select(T.normalise_value(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == [f"é {c.casefold()} é" for c in several] + ["plain text x"]
    long, start = spark.range(0, 400, 1, 4).select(F.repeat(F.concat(F.lit("été où "), F.col("id").cast("string")), 15_000).alias("t")), time.time()
    assert long.filter(F.length(T.folded(F.col("t"))) > 0).count() == 400
    assert time.time() - start < 15
