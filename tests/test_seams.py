"""What a user puts in the place of the library's own parts: token counter, scorers, index writer, switch policy in SQL."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import tokenize_words
from palimpsest.operators import exchanges, facts, scoring, summaries
from palimpsest.plans import collections, recap
from palimpsest.sources import ingest
from palimpsest.sources.turns import turns_of

SPAN_TURNS = "conv_id long, span_no long, turn_index long, role string, content string, person_text string, said_by_user boolean, tool_result_ids array<string>"


def words(text):
    return F.size(tokenize_words(text)).cast("long")


def test_counter_is_a_parameter(spark):
    talk = spark.createDataFrame([(1, 0, "user", "one two three"), (1, 1, "assistant", "four"), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.token_count) for r in turns_of(talk, words).collect()) == [(1, 1), (1, 3), (2, 0)]

    @F.pandas_udf("long")
    def chars(text: pd.Series) -> pd.Series:
        return text.str.len()

    assert sorted(r.token_count for r in turns_of(talk, chars).collect()) == [0, 4, 13]
    texts = spark.createDataFrame([("a b c", None, "a")], "kept_text string, compacted_text string, archived_text string")
    r = recap.level_costs(texts, F.char_length).first()
    assert (r.kept_tokens, r.compacted_tokens, r.archived_tokens) == (5, None, 1)
    plan = spark.createDataFrame([(1, 0, 0, 1, 3, "x y z", None, "x")], "conv_id long, span_no long, first_turn long, last_turn long, level int, kept_text string, compacted_text string, archived_text string")
    r = recap.render_recap(plan, words, header="Before:\n").first()
    assert (r.content, r.token_count) == ("Before:\nx y z", 4)
    candidates = spark.createDataFrame([(1, 0, "five words of summary text", "end_turn")], "conv_id long, span_no long, text string, stop_reason string")
    spans = spark.createDataFrame([(1, 0, 11)], "conv_id long, span_no long, tokens long")
    assert [summaries.admit_summaries(candidates, spans, counter=c).first().status for c in (words, F.char_length)] == ["not_shorter", "not_shorter"]
    assert summaries.admit_summaries(candidates, spans.withColumn("tokens", F.lit(12)), counter=words).first().status == "accepted"
    log = spark.createDataFrame([("q", '{"system":[{"type":"text","text":"be brief and kind"}],"messages":[{"role":"user","content":"x"}]}')], "request_id string, body string")
    assert ingest.prompt_figures(log, words).first().fixed_prompt_tokens == 4


def test_scorers_of_ones_own(spark):
    spans = spark.createDataFrame([(1, 0, 0, "why? how?"), (1, 1, 1, "plain")], "conv_id long, span_no long, last_turn long, text string")
    now, newest = spark.createDataFrame([(1, "")], "conv_id long, now string"), spark.createDataFrame([(1, 1)], "conv_id long, newest long")
    twice = scoring.Scorer("asks", 1.0, lambda text, tokens: F.regexp_count(text, F.lit(r"\?")))  # 2 counts as 1
    never = scoring.Scorer("never", 3.0, lambda text, tokens: F.lit(None).cast("double"))
    weights = scoring.Weights(1, 0, 0, scorers=(twice, never))
    got = {r.span_no: r for r in scoring.span_scores(spans, now, newest, weights).collect()}
    assert [got[k].asks for k in (0, 1)] == [1.0, 0.0] and got[0].never == 0.0
    for k, asks in ((0, 1), (1, 0)):
        assert got[k].score == pytest.approx((got[k].liveness + asks) / 5)
    assert scoring.score_ceiling(weights) == 1.0
    for wrong in ((twice, twice), (scoring.Scorer("density", 1, words),), (scoring.Scorer("less", -1, words),)):
        with pytest.raises(ValueError):
            scoring.Weights(scorers=wrong)


def test_index_writer_of_ones_own(spark):
    rows = [(1, 0, 1, "assistant", "later", "later", False, []), (1, 0, 0, "user", "First thing.", "First thing.", True, []), (1, 1, 2, "user", None, None, True, [])]
    turns = spark.createDataFrame(rows, SPAN_TURNS)
    last = lambda said: F.try_element_at(said, F.lit(-1))["content"]
    assert sorted((r.span_no, r.index_line) for r in exchanges.index_lines(turns, last).collect()) == [(0, "later"), (1, "")]
    assert sorted((r.span_no, r.index_line) for r in exchanges.index_lines(turns).collect()) == [(0, "First thing."), (1, "")]


def test_switch_policy_in_sql(spark):
    """The functions give for every mix of measures what the columns give, and what the rules say one by one."""
    rows = [(s, r, t, b, share, cache, asked, tools) for s in (-1, 0, 5) for r in (-1, 5, 9) for t in (0, 7) for b in (7, 8) for share in (1.0,) for cache in ("cold", "warm", None) for asked in (True, False) for tools in (True, False)]
    m = spark.createDataFrame(rows, collections.MEASURES)
    collections.register_switch(spark)
    args = ", ".join(m.columns)
    both = collections.decide_switch(m).selectExpr("*", f"switch_reason({args}) as r", f"decide_switch({args}) as s").collect()
    assert len(both) == len(rows)
    for x in both:
        rules = [("invalid", x.rewritten_tokens < 0, False), ("tool_round_open", x.tool_round_open, False), ("no_saving", x.saving_tokens <= 0, False), ("requested", x.requested, True), ("cache_cold", x.cache == "cold", True), ("repays_rewrite", x.saving_tokens >= x.rewritten_tokens, True), ("stale_weight_at_bound", x.stale_tokens >= x.stale_bound_tokens, True), ("waiting_for_payback", True, False)]
        assert (x.r, x.s) == (x.reason, x.switch) == next((name, yes) for name, holds, yes in rules if holds)


def test_facts_from_texts_to_notes(spark):
    said = [(1, 0, 0, "user", "The database is MySQL. We prefer tabs for indentation."), (1, 0, 1, "assistant", "The port is 5432."), (1, 1, 2, "user", "The database is Postgres."), (1, 1, 3, "user", "Is the database fast?"), (2, 0, 0, "user", "The database is mysql")]
    turns = spark.createDataFrame([(c, s, i, role, t, t, role == "user", []) for c, s, i, role, t in said], SPAN_TURNS)
    got = {(r.conv_id, r.span_no): (r.facts, r.notes) for r in recap.annotate_spans(turns, facts.file_facts(facts.extract_facts(turns))).collect()}
    note = "↳ Replaced later (turn 2): database: Postgres, not MySQL."
    assert got == {(1, 0): (["indentation: tabs"], [note]), (1, 1): (["database: Postgres"], []), (2, 0): (["database: mysql"], [])}
