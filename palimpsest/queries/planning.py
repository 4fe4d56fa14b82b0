"""Queries over level plans and recaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import facts
from palimpsest.plans import levels, recap
from palimpsest.queries import base as B
from palimpsest.queries.base import Registry, _cost, with_

query = Registry()
QUERIES, SQL = query.queries, query.sql
KEY = ("conv_id", "span_no")


@query(with_("costs") + "SELECT conv_id, span_no, kept_tokens, compacted_tokens, archived_tokens, coalesce(compacted_tokens, archived_tokens + floor(kept_tokens * 0.35)::BIGINT) AS estimated FROM costs")
def p1_level_costs(spark, sf_dir):
    c = B.costs(spark, sf_dir)
    estimated = levels.estimated_costs(c).select(*KEY, F.col("compacted_tokens").alias("estimated"))
    return c.select(*KEY, "kept_tokens", "compacted_tokens", "archived_tokens").join(estimated, list(KEY))


@query(with_("known") + "SELECT conv_id, span_no, ok_compacted, ok_archived FROM known")
def p2_worthwhile(spark, sf_dir):
    return levels.worthwhile(B.costs(spark, sf_dir)).select(*KEY, "ok_compacted", "ok_archived")


@query(with_("banded") + "SELECT conv_id, span_no, score, band FROM banded")
def p3_score_band(spark, sf_dir):
    return B.costs(spark, sf_dir).select(*KEY, "score", levels.score_band(F.col("score"), F.col("current")).alias("band"))


@query(with_("earned") + "SELECT conv_id, span_no, band, earned FROM earned")
def p4_settle_level(spark, sf_dir):
    return B.plan(spark, sf_dir).select(*KEY, "band", "earned")


@query(with_("fit") + "SELECT conv_id, span_no, level, lowered FROM fit")
def p5_fit_budget(spark, sf_dir):
    known = levels.worthwhile(B.costs(spark, sf_dir)).withColumn("band", levels.score_band(F.col("score"), F.col("current")))
    return levels.fit_budget(known.withColumn("earned", levels.settle_level(F.col("band")))).select(*KEY, "level", "lowered")


@query(with_("plan") + "SELECT conv_id, span_no, level, folded, lowered FROM plan")
def p6_fold_oldest(spark, sf_dir):
    return B.plan(spark, sf_dir).select(*KEY, "level", "folded", "lowered")


SUMMARY = f"SELECT conv_id, (sum({_cost('level')}) + CASE WHEN bool_or(folded) THEN any_value(fold_line_tokens) ELSE 0 END)::BIGINT AS tokens, coalesce(list(span_no ORDER BY span_no) FILTER (WHERE lowered), []) AS lowered, count(*) FILTER (WHERE folded) AS folded, sum({_cost('level')}) + CASE WHEN bool_or(folded) THEN any_value(fold_line_tokens) ELSE 0 END > any_value(budget) AS over_budget FROM plan GROUP BY conv_id"


@query(with_("plan") + SUMMARY)
def p7_plan_summary(spark, sf_dir):
    return levels.plan_summary(B.plan(spark, sf_dir))


@query(with_("turns") + "SELECT conv_id, floor(floor(1000 / rate) * 0.3)::BIGINT AS recap_budget, floor(floor(1000 / rate) * 0.1)::BIGINT AS stale_bound FROM (SELECT conv_id, 1 + (conv_id % 5) / 10.0 AS rate FROM turns GROUP BY conv_id)")
def p8_recap_budget(spark, sf_dir):
    rate = (1 + (F.col("conv_id") % 5) / 10.0).alias("rate")
    recap_tokens, stale = levels.recap_budget(F.lit(1000), F.col("rate"))
    return B.turns(spark, sf_dir).select("conv_id", rate).distinct().select("conv_id", recap_tokens.alias("recap_budget"), stale.alias("stale_bound"))


def _staged(spark, sf_dir):
    """Plans in which spans without a level are new; conversations with one that has a level have a recap."""
    return B.plan(spark, sf_dir).withColumn("is_new", F.col("current").isNull()).withColumn("has_front", F.col("current").isNotNull())


@query(with_("plan") + f"SELECT conv_id, (sum(CASE WHEN current IS NULL THEN tokens - {_cost('level')} ELSE 0 END) - CASE WHEN bool_or(current IS NOT NULL) THEN 0 ELSE 20 END)::BIGINT AS saving FROM plan GROUP BY conv_id")
def p9_cut_saving(spark, sf_dir):
    return levels.cut_saving(_staged(spark, sf_dir), 20)


@query(with_("plan") + "SELECT conv_id, sum(CASE WHEN level < 3 AND current IS NULL THEN tokens ELSE 0 END)::BIGINT AS compactable, sum(CASE WHEN level < 3 THEN tokens ELSE 0 END)::BIGINT AS stale FROM plan GROUP BY conv_id")
def p10_compactable_and_stale(spark, sf_dir):
    return levels.compactable_and_stale(_staged(spark, sf_dir))


@query(with_("plan") + "SELECT conv_id, span_no, CASE WHEN folded THEN 'Folded to stay within the budget.' WHEN lowered THEN printf('Scored %.2f; lowered to fit the budget.', round(score, 2)) WHEN earned > band THEN printf('Scored %.2f; no cheaper level.', round(score, 2)) WHEN current = band THEN printf('Scored %.2f; within the margin of its level.', round(score, 2)) ELSE printf('Scored %.2f.', round(score, 2)) END AS why FROM plan")
def p11_why_level(spark, sf_dir):
    return levels.why_level(B.plan(spark, sf_dir)).select(*KEY, "why")


_turn_list = lambda ok: f"coalesce(list_sort(flatten(list(turn_indices) FILTER (WHERE {ok}))), [])"


@query(with_("plan") + f"SELECT conv_id, {_turn_list('level = 3')} AS kept, {_turn_list('level = 2')} AS compacted, {_turn_list('level = 1')} AS archived, {_turn_list('level = 0')} AS folded, {_turn_list('level < current')} AS lowered, {_turn_list('level > current')} AS raised FROM plan GROUP BY conv_id")
def p12_plan_outcome(spark, sf_dir):
    return levels.plan_outcome(B.plan(spark, sf_dir))


@query(with_("plan") + f", t AS ({SUMMARY}), c AS (SELECT conv_id, sum(CASE WHEN level < 3 THEN tokens ELSE 0 END)::BIGINT AS compactable, (sum(tokens) - sum({_cost('level')}))::BIGINT AS saving FROM plan GROUP BY conv_id)\nSELECT c.conv_id, cut, compactable, saving, t.tokens AS recap_tokens, t.folded, cut > 0 AND compactable > 0 AND compactable >= 50 AS ready FROM c JOIN t USING (conv_id) JOIN cuts USING (conv_id)")
def p13_cut_preview(spark, sf_dir):
    from palimpsest.operators.exchanges import batch_ready

    p = B.plan(spark, sf_dir)
    c = p.groupBy("conv_id").agg(F.sum(F.when(F.col("level") < 3, F.col("tokens")).otherwise(0)).alias("compactable"), (F.sum("tokens") - F.sum(levels.cost_at(F.col("level")))).alias("saving"))
    out = c.join(levels.plan_summary(p).select("conv_id", F.col("tokens").alias("recap_tokens"), "folded"), "conv_id").join(B.cuts(spark, sf_dir).select("conv_id", "cut"), "conv_id")
    return batch_ready(out, 50)


@query(with_("plan") + f", c AS (SELECT conv_id, sum(CASE WHEN level < 3 AND current IS NULL THEN tokens ELSE 0 END)::BIGINT AS compactable, (sum(CASE WHEN current IS NULL THEN tokens - {_cost('level')} ELSE 0 END) - CASE WHEN bool_or(current IS NOT NULL) THEN 0 ELSE 20 END)::BIGINT AS saving FROM plan GROUP BY conv_id)\nSELECT conv_id, cut, compactable, saving, CASE WHEN cut = 0 THEN 'not_collected' WHEN compactable <= 0 OR compactable < 50 THEN 'batch_too_small' WHEN saving <= 0 THEN 'no_saving' ELSE 'staged' END AS status FROM c JOIN cuts USING (conv_id)")
def p14_collection_decision(spark, sf_dir):
    p = _staged(spark, sf_dir)
    batch = levels.compactable_and_stale(p).select("conv_id", "compactable").join(levels.cut_saving(p, 20), "conv_id").join(B.cuts(spark, sf_dir).select("conv_id", "cut"), "conv_id")
    return levels.collection_decision(batch, 50)


@query(with_("texts") + "SELECT conv_id, span_no, kept_text, compacted_text, archived_text FROM texts")
def r1_span_text(spark, sf_dir):
    return B.texts(spark, sf_dir).select(*KEY, "kept_text", "compacted_text", "archived_text")


FOLDED = f"folded_runs AS (SELECT conv_id, min(first_turn) AS first_turn, max(last_turn) AS last_turn, count(*) AS spans FROM (SELECT *, span_no - row_number() OVER (PARTITION BY conv_id ORDER BY span_no) AS run FROM plan WHERE level = 0) GROUP BY conv_id, run), folded_lines AS (SELECT *, '{recap.FOLDED} (' || {B._turns_named} || ') ' || spans || ' earlier ' || CASE WHEN spans = 1 THEN 'exchange' ELSE 'exchanges' END || ', folded to stay within the budget.' AS line FROM folded_runs)"


@query(with_("plan").rstrip() + f", {FOLDED}\nSELECT * FROM folded_lines")
def r2_folded_lines(spark, sf_dir):
    return recap.folded_lines(B.plan(spark, sf_dir))


STATED = "CASE WHEN topic_label = 'general' THEN {0} ELSE topic_label || ': ' || {0} END"


@query(with_("chain", "condensed") + f", x AS (SELECT c.*, span_no FROM chain c JOIN condensed t ON c.conv_id = t.conv_id AND c.message_turn = t.turn_index)\nSELECT conv_id, span_no, coalesce(list({STATED.format('content')} ORDER BY message_turn, seq) FILTER (WHERE replaced_turn IS NULL), []) AS facts, coalesce(list('↳ Replaced later (turn ' || replaced_turn || '): ' || {STATED.format('replaced_by')} || ', not ' || content || '.' ORDER BY message_turn, seq) FILTER (WHERE replaced_turn IS NOT NULL), []) AS notes FROM x GROUP BY ALL")
def r3_annotate_spans(spark, sf_dir):
    return recap.annotate_spans(B.condensed(spark, sf_dir), facts.file_facts(B.facts(spark, sf_dir)))


@query()
def r3_facts_from_texts(spark, sf_dir):
    """From the texts of turns to the notes of spans: facts read (F1), filed (F5), and those replaced later (F6) told beside their span.

    No SQL, since it rests on F1; a test holds it against facts written out by hand.
    """
    rows = B.condensed(spark, sf_dir)
    return recap.annotate_spans(rows, facts.file_facts(facts.extract_facts(B.turns(spark, sf_dir))))


@query(with_("instructions", "cuts") + ", f AS (SELECT conv_id, content, min(turn) AS turn FROM instructions JOIN cuts USING (conv_id) WHERE turns_before < cut GROUP BY ALL)\nSELECT conv_id, list(content ORDER BY turn, content) AS instructions FROM f GROUP BY conv_id")
def r4_carry_instructions(spark, sf_dir):
    return recap.carry_instructions(B.instructions(spark, sf_dir), B.cuts(spark, sf_dir))


RECAP = f"{FOLDED}, shown AS (SELECT conv_id, first_turn, CASE WHEN level = 3 THEN kept_text WHEN level = 2 THEN coalesce(compacted_text, kept_text) ELSE archived_text END AS line FROM plan WHERE level > 0 UNION ALL SELECT conv_id, first_turn, line FROM folded_lines), recaps AS (SELECT conv_id, '{recap.HEADER}' || string_agg(line, chr(10) ORDER BY first_turn, line) AS content FROM shown GROUP BY conv_id)"


@query(with_("plan").rstrip() + f", {RECAP}\nSELECT conv_id, content, ceil(length(content) / 4.0)::BIGINT AS token_count FROM recaps")
def r5_render_recap(spark, sf_dir):
    return recap.render_recap(B.plan(spark, sf_dir))


CONTEXT = "context AS (SELECT conv_id, -1 AS turn_index, 'user' AS role, content, ceil(length(content) / 4.0)::BIGINT AS token_count FROM recaps UNION ALL SELECT conv_id, turn_index, role, content, token_count FROM split WHERE in_tail)"


def context(spark, sf_dir, parts=None):
    """The recap and the tail; both start from the same written turns."""
    parts = parts or B.divided(spark, sf_dir)
    return recap.assemble_context(recap.render_recap(B.plan(spark, sf_dir, parts)), parts[0].filter("in_tail"))


@query(with_("plan").rstrip() + f", {RECAP}, {CONTEXT}\nSELECT * FROM context")
def r6_assemble_context(spark, sf_dir):
    return context(spark, sf_dir)


@query(with_("plan", "instructions").rstrip() + rf""", {RECAP}, {CONTEXT}, l AS (SELECT conv_id, min(turn_index) FILTER (WHERE turn_index >= 0) AS f FROM context GROUP BY conv_id),
o AS (SELECT i.conv_id, i.content, max(turns_before) AS b, any_value(f) AS f FROM instructions i JOIN l USING (conv_id) GROUP BY i.conv_id, i.content),
u AS (SELECT conv_id, turn_index::DOUBLE AS place, role, content FROM context WHERE regexp_matches(content, '\S') UNION ALL SELECT conv_id, CASE WHEN b - 1 < f THEN -0.5 ELSE b - 0.5 END, 'system', content FROM o)
SELECT conv_id, role, content, row_number() OVER (PARTITION BY conv_id ORDER BY place, content) AS seq FROM u""")
def r7_forwarded_request(spark, sf_dir):
    return recap.forwarded_request(context(spark, sf_dir), B.instructions(spark, sf_dir))


def _weighed(spark, sf_dir):
    return B.turns(spark, sf_dir).withColumns({"thinking_tokens": F.col("token_count") % 3, "attachment_tokens": F.col("token_count") % 2 * 10, "unsized_attachments": (F.col("token_count") % 50 == 0).cast("int")})


@query(with_("turns", "instructions") + ", s AS (SELECT conv_id, sum(token_count)::BIGINT AS text_tokens, sum(CASE WHEN turn_index >= 2 THEN token_count % 3 ELSE 0 END)::BIGINT AS thinking, sum(token_count % 2 * 10)::BIGINT AS attachments, bool_or(token_count % 50 = 0 OR token_count % 3 > 0) AS estimated FROM turns GROUP BY conv_id), i AS (SELECT conv_id, sum(ceil(length(content) / 4.0)::BIGINT)::BIGINT AS n FROM (SELECT DISTINCT conv_id, content FROM instructions) GROUP BY conv_id)\nSELECT s.*, coalesce(n, 0)::BIGINT AS instruction_tokens, text_tokens + thinking + attachments + coalesce(n, 0)::BIGINT AS total FROM s LEFT JOIN i USING (conv_id)")
def r8_sent_tokens(spark, sf_dir):
    return recap.sent_tokens(_weighed(spark, sf_dir), B.instructions(spark, sf_dir), 2)


@query(with_("plan", "chain", "condensed") + "SELECT c.conv_id, message_turn, seq, topic_label, c.content, p.span_no FROM chain c JOIN condensed t ON c.conv_id = t.conv_id AND message_turn = turn_index JOIN plan p ON p.conv_id = t.conv_id AND p.span_no = t.span_no WHERE replaced_turn IS NULL AND level IN (1, 2)")
def r9_carried_facts(spark, sf_dir):
    return recap.carried_facts(facts.file_facts(B.facts(spark, sf_dir)), B.condensed(spark, sf_dir), B.plan(spark, sf_dir))
