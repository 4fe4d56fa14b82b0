"""Queries over facts, collections and the identity of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import facts, identity
from palimpsest.plans import collections, levels, passes
from palimpsest.queries import base as B
from palimpsest.queries.base import Registry, _cost, turns, with_

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _filed(spark, sf_dir):
    return facts.file_facts(B.facts(spark, sf_dir))


@query(with_("facts") + ", a AS (SELECT conv_id, '{\"facts\":[' || string_agg('{\"turn\":' || message_turn || ',\"topic\":\"' || topic_label || '\",\"value\":\"' || content || '\",\"kind\":\"x\"}', ',') || ']}' AS t FROM facts GROUP BY conv_id)\nSELECT conv_id, message_turn, seq, topic_label, content, knowledge_type, speaker FROM facts WHERE conv_id % 3 <> 0")
def f3_validate_model_facts(spark, sf_dir):
    """Model answers made from the stand-in facts: words about a JSON object; every third is broken off."""
    row = F.struct(F.col("message_turn").alias("turn"), F.col("topic_label").alias("topic"), F.col("content").alias("value"), F.lit("x").alias("kind"))
    body = F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("facts")))
    broken = F.when(F.col("conv_id") % 3 == 0, F.substring("t", 1, 20)).otherwise(F.concat(F.lit("Here: "), "t", F.lit(" done")))
    answers = B.facts(spark, sf_dir).groupBy("conv_id").agg(body.alias("t")).select("conv_id", broken.alias("text"))
    return facts.validate_model_facts(answers, turns(spark, sf_dir))


@query(with_("filed") + "SELECT * FROM filed")
def f5_file_facts(spark, sf_dir):
    return _filed(spark, sf_dir)


@query(with_("filed") + "SELECT conv_id, message_turn, seq, topic_label, content, knowledge_type, speaker, norm, knowledge_status FROM filed")
def f5_fold_facts(spark, sf_dir):
    return facts.fold_facts(B.facts(spark, sf_dir))


@query(with_("chain") + "SELECT * FROM chain")
def f6_supersession_chain(spark, sf_dir):
    return facts.supersession_chain(_filed(spark, sf_dir))


@query(with_("spans") + "SELECT conv_id, span_no, (conv_id + span_no) % 4 = 0 AND (conv_id % 3 <> 0) AS facts_unread FROM spans")
def f7_unread_spans(spark, sf_dir):
    s = B.spans(spark, sf_dir).select("conv_id", "span_no")
    failed = s.filter((F.col("conv_id") + F.col("span_no")) % 4 == 0).withColumn("pass_no", F.lit(1))
    answered = s.filter("conv_id % 3 = 0").withColumn("pass_no", F.lit(2))
    return facts.unread_spans(s, failed, answered)


_fact = "conv_id, message_turn, seq, topic_label, content, knowledge_type, speaker"
#: The record is filed by itself; then it and the late facts in one order, a fact a step, the state being the value in force and who gave it.
LATE = with_("facts").rstrip() + f""",
facts_r AS (SELECT * FROM facts WHERE message_turn % 2 = 1),
ordered_r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, topic_label ORDER BY message_turn, seq) AS k FROM facts_r WHERE topic_label <> 'general'),
folded_r AS (SELECT *, true AS kept, content AS v, speaker AS s FROM ordered_r WHERE k = 1
  UNION ALL SELECT * EXCLUDE (v, s, ok), ok, CASE WHEN ok THEN content ELSE v END, CASE WHEN ok THEN speaker ELSE s END FROM (
    SELECT o.*, f.v, f.s, NOT (o.content = f.v OR (o.speaker = 'assistant' AND f.s = 'user')) AS ok FROM folded_r f JOIN ordered_r o ON o.conv_id = f.conv_id AND o.topic_label = f.topic_label AND o.k = f.k + 1)),
record AS (SELECT {_fact} FROM folded_r WHERE kept UNION ALL SELECT {_fact} FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, content ORDER BY message_turn, seq) AS n FROM facts_r WHERE topic_label = 'general') WHERE n = 1),
together AS (SELECT *, CASE WHEN topic_label = 'general' THEN 'general ' || content ELSE topic_label END AS g FROM (SELECT {_fact}, true AS old FROM record UNION ALL SELECT {_fact}, false FROM facts WHERE message_turn % 2 = 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, g ORDER BY message_turn, seq, old) AS k FROM together),
merged AS (SELECT *, true AS kept, content AS v, speaker AS s FROM placed WHERE k = 1
  UNION ALL SELECT * EXCLUDE (v, s, ok), ok, CASE WHEN ok THEN content ELSE v END, CASE WHEN ok THEN speaker ELSE s END FROM (
    SELECT o.*, f.v, f.s, o.old OR NOT (o.content = f.v OR (o.speaker = 'assistant' AND f.s = 'user')) AS ok FROM merged f JOIN placed o ON o.conv_id = f.conv_id AND o.g = f.g AND o.k = f.k + 1))
SELECT {_fact}, content AS norm, CASE WHEN topic_label <> 'general' AND lead(k) OVER (PARTITION BY conv_id, g ORDER BY k) IS NOT NULL THEN 'superseded' ELSE 'active' END AS knowledge_status FROM merged WHERE kept"""


@query(LATE)
def f8_late_facts(spark, sf_dir):
    """Facts of odd turns are on record; those of even turns arrive late and take their places."""
    f = B.facts(spark, sf_dir)
    record = facts.file_facts(f.filter("message_turn % 2 = 1"))
    return facts.late_facts(f.filter("message_turn % 2 = 0"), record)


@query(with_("filed") + "SELECT conv_id, message_turn, seq, topic_label, content, knowledge_type, speaker, norm FROM filed WHERE knowledge_status = 'active'")
def f9_active_facts(spark, sf_dir):
    return facts.active_facts(_filed(spark, sf_dir))


@query(with_("filed") + "SELECT * FROM (SELECT conv_id, topic_label, message_turn, seq, content, lag(message_turn) OVER w AS old_turn, lag(content) OVER w AS old_content FROM filed WHERE topic_label <> 'general' WINDOW w AS (PARTITION BY conv_id, topic_label ORDER BY message_turn, seq)) WHERE old_turn IS NOT NULL")
def f10_supersessions(spark, sf_dir):
    return facts.supersessions(_filed(spark, sf_dir))


def _collected(spark, sf_dir):
    p = B.plan(spark, sf_dir)
    delta = p.select("conv_id", "span_no", "level", "turn_indices", F.lit(True).alias("is_new"))
    old = delta.limit(0).drop("is_new")
    return collections.apply_collection(turns(spark, sf_dir).select("conv_id", "turn_index"), old, delta)


@query(with_("plan") + "SELECT conv_id, (SELECT count(*) FROM split s WHERE s.conv_id = p.conv_id AND in_tail) AS young, count(*) AS spans, 0::BIGINT AS violations FROM plan p GROUP BY conv_id")
def d1_apply_collection(spark, sf_dir):
    young, spans, bad = _collected(spark, sf_dir)
    n = lambda df, name: df.groupBy("conv_id").agg(F.count(F.lit(1)).alias(name))
    out = n(spans, "spans").join(n(young, "young"), "conv_id", "left").join(n(bad, "violations"), "conv_id", "left")
    return out.select("conv_id", F.coalesce("young", F.lit(0)).alias("young"), "spans", F.coalesce("violations", F.lit(0)).alias("violations"))


@query(with_("turns") + ", p AS (SELECT conv_id, turn_index AS pos, md5(content) AS hash, turn_index = 3 AND conv_id % 2 = 0 AS changed FROM turns), b AS (SELECT *, min(pos) FILTER (WHERE changed) OVER (PARTITION BY conv_id) AS bad FROM p)\nSELECT conv_id, pos, hash FROM b WHERE bad IS NULL OR pos < bad")
def d2_still_oldest(spark, sf_dir):
    t = turns(spark, sf_dir).select("conv_id", F.col("turn_index").alias("pos"), F.md5("content").alias("hash"))
    now = t.withColumn("hash", F.when((F.col("pos") == 3) & (F.col("conv_id") % 2 == 0), "edited").otherwise(F.col("hash")))
    return collections.still_oldest(t, now)


def _measured(spark, sf_dir):
    p = B.plan(spark, sf_dir).withColumns({"level_tokens": levels.cost_at(F.col("level")), "thinking_tokens": F.col("tokens") % 7, "attachment_tokens": F.col("tokens") % 2 * 10})
    return collections.switch_measures(p, 1000)


MEASURES = f"measures AS (SELECT conv_id, (sum(tokens) - sum(c))::BIGINT AS saving_tokens, sum(c)::BIGINT AS rewritten_tokens, sum(CASE WHEN level < 3 THEN tokens ELSE 0 END)::BIGINT AS stale_tokens, 100::BIGINT AS stale_bound_tokens, sum(CASE WHEN level < 3 THEN tokens % 7 ELSE 0 END)::BIGINT AS thinking_dropped, sum(CASE WHEN level < 3 THEN tokens % 2 * 10 ELSE 0 END)::BIGINT AS attachments_dropped FROM (SELECT *, {_cost('level')} AS c FROM plan) GROUP BY conv_id)"


@query(with_("plan").rstrip() + f", {MEASURES}\nSELECT * FROM measures")
def d3_switch_measures(spark, sf_dir):
    return _measured(spark, sf_dir)


SWITCH = with_("plan").rstrip() + f""", {MEASURES}, r AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'tool_round_open' WHEN saving_tokens <= 0 THEN 'no_saving' WHEN conv_id % 7 = 0 THEN 'requested' WHEN conv_id % 5 = 0 THEN 'cache_cold' WHEN saving_tokens >= 1.0 * rewritten_tokens THEN 'repays_rewrite' WHEN stale_tokens >= stale_bound_tokens THEN 'stale_weight_at_bound' ELSE 'waiting_for_payback' END AS reason FROM measures)
SELECT conv_id, reason, reason NOT IN ('tool_round_open', 'no_saving', 'waiting_for_payback') AS switch FROM r"""


def _to_decide(spark, sf_dir):
    return _measured(spark, sf_dir).withColumns({"min_saving_share": F.lit(1.0), "cache": F.when(F.col("conv_id") % 5 == 0, "cold").otherwise("warm"), "requested": F.col("conv_id") % 7 == 0, "tool_round_open": F.col("conv_id") % 11 == 0})


@query(SWITCH)
def d4_decide_switch(spark, sf_dir):
    return collections.decide_switch(_to_decide(spark, sf_dir)).select("conv_id", "reason", "switch")


@query(SWITCH)
def d4_switch_functions(spark, sf_dir):
    """The same policy by its SQL functions."""
    collections.register_switch(spark)
    args = "saving_tokens, rewritten_tokens, stale_tokens, stale_bound_tokens, min_saving_share, cache, requested, tool_round_open"
    return spark.sql(f"SELECT conv_id, switch_reason({args}) AS reason, decide_switch({args}) AS switch FROM {{m}}", m=_to_decide(spark, sf_dir))


@query(with_("plan") + f"SELECT conv_id, count(*) FILTER (WHERE level = 0) AS n_folded, count(*) FILTER (WHERE level = 1) AS n_archived, count(*) FILTER (WHERE level = 2) AS n_compacted, count(*) FILTER (WHERE level = 3) AS n_kept, sum({_cost('level')})::BIGINT AS tokens_after, sum(tokens)::BIGINT AS tokens_before, (sum(tokens) - sum({_cost('level')}))::BIGINT AS tokens_saved FROM plan GROUP BY conv_id")
def d5_switch_result(spark, sf_dir):
    after = B.plan(spark, sf_dir).withColumn("level_tokens", levels.cost_at(F.col("level")))
    return collections.switch_result(B.split(spark, sf_dir).filter("not in_tail"), after)


@query(with_("plan", "filed") + "SELECT CASE WHEN level >= 2 THEN 'promoted' ELSE 'archived' END AS event_type, conv_id, first_turn AS subject, ['out_of_view', 'archived', 'compacted', 'kept'][level + 1] AS detail FROM plan UNION ALL SELECT 'fact_added', conv_id, message_turn, knowledge_type FROM filed UNION ALL SELECT 'fact_superseded', conv_id, message_turn, knowledge_type FROM filed WHERE knowledge_status = 'superseded'")
def d6_collection_events(spark, sf_dir):
    return collections.collection_events(B.plan(spark, sf_dir), _filed(spark, sf_dir))


def _shortfalls(spark, sf_dir):
    from palimpsest.operators import summaries
    from palimpsest.queries.condensing import _candidates

    admitted = summaries.admit_summaries(_candidates(spark, sf_dir), B.spans(spark, sf_dir))
    return collections.degradations(admitted, f7_unread_spans(spark, sf_dir), levels.plan_summary(B.plan(spark, sf_dir)))


SHORTFALLS = f"""c AS (SELECT conv_id, span_no, CASE WHEN (conv_id + span_no) % 7 = 0 THEN '  ' ELSE index_line END AS text, CASE WHEN (conv_id + span_no) % 7 = 1 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason FROM index_lines),
m AS (SELECT c.conv_id, c.span_no, CASE WHEN NOT tokens > 6 / 0.65 THEN 'too_small' WHEN stop_reason <> 'end_turn' THEN 'incomplete' WHEN trim(c.text) = '' THEN 'empty' WHEN ceil(length(trim(c.text)) / 4.0) + 6 >= tokens THEN 'not_shorter' ELSE 'accepted' END AS status FROM c JOIN spans USING (conv_id, span_no)),
shortfalls AS (SELECT conv_id, 'summary_' || status AS reason, span_no AS place FROM m WHERE status NOT IN ('accepted', 'too_small') UNION ALL SELECT conv_id, 'facts_unread', span_no FROM spans WHERE (conv_id + span_no) % 4 = 0 AND conv_id % 3 <> 0
  UNION ALL SELECT conv_id, 'recap_over_budget', NULL FROM plan GROUP BY conv_id HAVING sum({_cost('level')}) + CASE WHEN bool_or(folded) THEN any_value(fold_line_tokens) ELSE 0 END > any_value(budget))"""


@query(with_("plan", "index_lines").rstrip() + f", {SHORTFALLS}\nSELECT * FROM shortfalls")
def d7_degradations(spark, sf_dir):
    return _shortfalls(spark, sf_dir)


#: Passes over short conversations; every second one's cache is warm.
PASSES = passes.Settings(keep_last=B.KEEP_LAST, max_span_tokens=B.CAP, budget=B.BUDGET + 80, fold_line_tokens=B.FOLD_LINE, min_cut_tokens=1, stale_bound_tokens=40, min_saving_share=0.5, cache=lambda: F.when(F.col("conv_id") % 2 == 0, "warm").otherwise("cold"))


@query()
def d8_backfill_collections(spark, sf_dir):
    """Every conversation from its first reply to its last: each span with its level, and whether it is only staged."""
    state, _ = passes.backfill(turns(spark, sf_dir), PASSES)
    return state["spans"].select("conv_id", "span_no", "first_turn", "last_turn", "staged", "level")


@query("WITH c AS (SELECT user_id AS pass_id, event_type <> 'error' AND user_id % 3 <> 0 AS ok FROM events)\nSELECT pass_id, count(*) AS calls FROM c GROUP BY pass_id HAVING bool_and(NOT ok)")
def d9_lasting_failures(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    ok = (F.col("event_type") != "error") & (F.col("user_id") % 3 != 0)
    calls = e.select(F.col("user_id").alias("pass_id"), ok.alias("ok"), F.when(~ok, "quota").alias("error"))
    return collections.lasting_failures(calls)


CHAIN = """, s AS (SELECT conv_id, turn_index, '["' || role || '",[{"text":' || to_json(content)::VARCHAR || ',"type":"text"}]]' AS said FROM turns),
h AS (SELECT conv_id, turn_index, sha256(chr(0) || said) AS hash FROM s WHERE turn_index = 0 UNION ALL SELECT s.conv_id, s.turn_index, sha256(h.hash || chr(0) || s.said) FROM h JOIN s ON s.conv_id = h.conv_id AND s.turn_index = h.turn_index + 1)
SELECT * FROM h"""


@query(with_("turns").rstrip() + CHAIN)
def l1_chain_hashes(spark, sf_dir):
    return identity.chain_hashes(turns(spark, sf_dir))


@query(with_("turns").rstrip() + CHAIN)
def l1_chain_hashes_of_blocks(spark, sf_dir):
    """Every second turn as a client sends it: blocks with a cache marker, an instruction and thinking before; nothing of it counts."""
    text = F.to_json(F.struct(F.col("content").alias("text"), F.lit("text").alias("type")))
    marked = F.concat(F.lit('{"cache_control":{"type":"ephemeral"},'), F.substring(text, 2, 1 << 30))
    extra = F.when(F.col("role") == "user", '{"type":"text","text":"<system-reminder>now</system-reminder>"},').otherwise('{"type":"thinking","thinking":"","signature":"s"},')
    raw = F.when(F.col("turn_index") % 2 == 0, F.concat(F.lit("["), extra, marked, F.lit("]")))
    return identity.chain_hashes(turns(spark, sf_dir).withColumn("raw", raw), "raw")


@query(with_("turns") + "SELECT conv_id AS request_id, conv_id, max(turn_index) - CASE WHEN max(turn_index) >= 1 THEN 1 ELSE 0 END + 1 AS agreed FROM turns GROUP BY conv_id")
def l2_match_conversations(spark, sf_dir):
    """A conversation is recorded up to its last turn but one; the request carries all its turns. Ids of texts alike in two
    conversations are told apart by a first turn that names the conversation."""
    t = turns(spark, sf_dir).withColumn("content", F.concat(F.col("conv_id").cast("string"), F.lit(":"), "content"))
    h = identity.chain_hashes(t)
    n = h.groupBy("conv_id").agg(F.max("turn_index").alias("n"))
    tips = h.join(n, "conv_id").filter(F.col("turn_index") == F.greatest(F.lit(0), F.col("n") - 1)).select("conv_id", F.col("hash").alias("tip"))
    return identity.match_conversations(h.select(F.col("conv_id").alias("request_id"), F.col("turn_index").alias("position"), "hash"), tips)


@query(with_("turns") + "SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND count(*) > 2 THEN 2 ELSE count(*) END AS agreed FROM turns GROUP BY conv_id")
def l3_agreed_length(spark, sf_dir):
    return _agreed(spark, sf_dir).select("conv_id", "agreed")


def _agreed(spark, sf_dir):
    t = turns(spark, sf_dir)
    edited = F.when((F.col("conv_id") % 2 == 0) & (F.col("turn_index") == 2), "edited").otherwise(F.md5("content"))
    rows = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn_index", c.alias("h")))), lambda r: r.h)
    return identity.agreed_length(t.groupBy("conv_id").agg(rows(F.md5("content")).alias("a"), rows(edited).alias("b")))


@query(with_("turns") + ", g AS (SELECT conv_id, count(*) AS recorded, CASE WHEN conv_id % 2 = 0 AND count(*) > 2 THEN 2 ELSE count(*) END AS agreed, conv_id % 5 AS aged FROM turns GROUP BY conv_id)\nSELECT conv_id, CASE WHEN agreed = recorded THEN 'continue' WHEN agreed >= aged THEN 'rewind' ELSE 'restart' END AS action, CASE WHEN agreed <> recorded AND agreed >= aged THEN recorded - agreed ELSE 0 END AS discarded FROM g")
def l4_reconcile_history(spark, sf_dir):
    known = _agreed(spark, sf_dir).select("conv_id", F.size("a").cast("long").alias("recorded"), F.size("b").alias("requested"), "agreed", (F.col("conv_id") % 5).alias("aged"))
    return identity.reconcile_history(known).select("conv_id", "action", "discarded")


@query("WITH r AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type = 'purchase' AS carries FROM events), l AS (SELECT conv_id, max(seq) FILTER (WHERE carries) AS s FROM r GROUP BY conv_id)\nSELECT conv_id, s AS valid_from FROM l WHERE s IS NOT NULL")
def l5_thinking_valid_from(spark, sf_dir):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    r = B.read(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), seq.alias("seq"), (F.col("event_type") == "purchase").alias("carries"))
    return identity.thinking_valid_from(r.withColumn("history_turns", F.col("seq")))


@query("WITH s AS (SELECT user_id % 2 AS deployment, user_id AS session, max(ts) AS last_ts FROM events GROUP BY ALL), r AS (SELECT *, last_ts > TIMESTAMP '2024-01-30' AS live, row_number() OVER (PARTITION BY deployment, last_ts > TIMESTAMP '2024-01-30' ORDER BY last_ts DESC, session) AS k FROM s)\nSELECT deployment, session, CASE WHEN NOT live THEN 'idle' ELSE 'beyond_cap' END AS reason FROM r WHERE NOT live OR k > 10")
def l6_session_expiry(spark, sf_dir):
    s = B.read(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).alias("deployment"), F.col("user_id").alias("session")).agg(F.max("ts").alias("last_ts"))
    return identity.session_expiry(s, F.to_timestamp(F.lit("2024-01-31 00:00:00")), most=10).select("deployment", "session", "reason")


@query(with_("turns") + "SELECT conv_id, turn_index, token_count, true AS appended FROM turns WHERE turn_index >= 2 AND conv_id % 4 <> 0 UNION ALL SELECT conv_id, turn_index, token_count, false FROM turns WHERE turn_index >= 3 AND conv_id % 4 = 0")
def l7_record_turns(spark, sf_dir):
    """Two turns of each conversation are recorded; every fourth conversation's third turn is missing from what arrives."""
    t = turns(spark, sf_dir).select("conv_id", "turn_index", "content", "token_count")
    gap = (F.col("conv_id") % 4 == 0) & (F.col("turn_index") == 2)
    good, bad = identity.record_turns(t.filter("turn_index < 2"), t.filter(~gap).withColumn("token_count", F.lit(None).cast("long")))
    row = lambda df, ok: df.select("conv_id", "turn_index", "token_count", F.lit(ok).alias("appended"))
    return row(good, True).unionByName(row(bad, False))
