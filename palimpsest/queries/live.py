"""Queries over health, evaluation and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import evals as E
from palimpsest.operators import facts, health
from palimpsest.plans import levels
from palimpsest.queries import base as B
from palimpsest.queries import planning
from palimpsest.queries.base import Registry, turns, with_
from palimpsest.queries.collecting import PASSES as PASSES_
from palimpsest.queries.collecting import _filed
from palimpsest.sources.state import BucketTable, state_folder, written
from palimpsest.streaming import streams

query = Registry()
QUERIES, SQL = query.queries, query.sql
WINDOW = 1000


@query(with_("turns") + f"SELECT conv_id, sum(token_count)::BIGINT AS current_tokens, {WINDOW} AS context_window, round(sum(token_count) / {WINDOW}, 6) AS pressure, max(turn_index) AS newest_turn FROM turns GROUP BY conv_id")
def h1_token_budget(spark, sf_dir):
    return health.token_budget(turns(spark, sf_dir), WINDOW)


def passes(spark, sf_dir):
    """Events as passes: a user is a conversation, an error a pass that found nothing."""
    e = B.read(spark, sf_dir, "events")
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    status = F.when(F.col("event_type").isin("view", "click"), "completed").when(F.col("event_type") == "error", "failed").otherwise("idle")
    reason = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "credential_refused")
    seen = F.floor("value") + 1
    return e.select(F.col("user_id").alias("conv_id"), no.alias("pass_no"), status.alias("status"), reason.alias("reason"), F.floor("value").alias("duration"), seen.alias("tokens_seen"), F.floor(seen / 3).alias("condensed_tokens"), (F.col("event_id") % 4).alias("n_kept"), F.floor(F.col("value") / 2).alias("t_kept"))


PASSES = "WITH passes AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pass_no, CASE WHEN event_type IN ('view', 'click') THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'idle' END AS status, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'credential_refused' END AS reason, floor(value)::BIGINT AS duration, floor(value)::BIGINT + 1 AS tokens_seen, (floor(value)::BIGINT + 1) // 3 AS condensed_tokens, event_id % 4 AS n_kept, floor(value / 2)::BIGINT AS t_kept FROM events)\n"


@query(PASSES + "SELECT conv_id, pass_no, status, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pass_no DESC) AS place FROM passes) WHERE place <= 50")
def h2_pass_history(spark, sf_dir):
    return health.newest(passes(spark, sf_dir), 50, "pass_no").select("conv_id", "pass_no", "status", "place")


@query(with_("plan") + "SELECT conv_id, CASE WHEN level >= 2 THEN 'promoted' ELSE 'archived' END AS event_type, unnest(turn_indices) AS turn_index, CASE WHEN level >= 2 THEN 'old' ELSE 'archive' END AS moved_to FROM plan")
def h3_transitions(spark, sf_dir):
    kind = F.when(F.col("level") >= 2, "promoted").otherwise("archived")
    return health.transitions(B.plan(spark, sf_dir).select("conv_id", kind.alias("event_type"), F.col("turn_indices").alias("turns")))


@query(PASSES + "SELECT conv_id, pass_no, status, CASE WHEN status = 'completed' THEN n_kept ELSE 0 END AS n_kept, CASE WHEN status = 'completed' THEN t_kept ELSE 0 END AS t_kept FROM passes")
def h4_gc_breakdown(spark, sf_dir):
    return health.gc_breakdown(passes(spark, sf_dir)).select("conv_id", "pass_no", "status", "n_kept", "t_kept")


@query(PASSES + "SELECT conv_id, pass_no, CASE WHEN status = 'completed' THEN round(condensed_tokens / tokens_seen, 6) END AS ratio FROM passes")
def h5_transformation_ratio(spark, sf_dir):
    return health.transformation_ratio(passes(spark, sf_dir)).select("conv_id", "pass_no", "ratio")


@query(with_("spans", "filed") + "SELECT conv_id, coalesce(yt, 0) AS young_turns, coalesce(yk, 0)::BIGINT AS young_tokens, coalesce(os, 0) AS old_spans, coalesce(ot, 0)::BIGINT AS old_tokens, coalesce(pf, 0) AS permanent_facts FROM (SELECT conv_id, count(*) AS yt, sum(token_count) AS yk FROM split WHERE in_tail GROUP BY conv_id) FULL JOIN (SELECT conv_id, count(*) AS os, sum(tokens) AS ot FROM spans GROUP BY conv_id) o USING (conv_id) FULL JOIN (SELECT conv_id, count(*) AS pf FROM filed GROUP BY conv_id) p USING (conv_id)")
def h6_generation_lifecycle(spark, sf_dir):
    return health.lifecycle(B.split(spark, sf_dir).filter("in_tail"), B.spans(spark, sf_dir), _filed(spark, sf_dir))


FIDELITY = "fidelity AS (SELECT s.conv_id, s.turn_index, p.span_no, p.score, coalesce(['out_of_view', 'archived', 'compacted', 'kept'][level + 1], 'verbatim') AS fidelity FROM split s LEFT JOIN condensed c ON c.conv_id = s.conv_id AND c.turn_index = s.turn_index LEFT JOIN plan p ON p.conv_id = c.conv_id AND p.span_no = c.span_no)"


def fidelity(spark, sf_dir):
    return health.turn_fidelity(turns(spark, sf_dir).select("conv_id", "turn_index", "token_count"), B.plan(spark, sf_dir))


@query(with_("plan", "condensed").rstrip() + f", {FIDELITY}\nSELECT * FROM fidelity")
def h7_turn_fidelity(spark, sf_dir):
    return fidelity(spark, sf_dir).select("conv_id", "turn_index", "span_no", "score", "fidelity")


CARRIED = "CASE level WHEN 3 THEN kept_text WHEN 2 THEN coalesce(compacted_text, kept_text) WHEN 1 THEN archived_text END"


@query(with_("plan") + f"SELECT conv_id, span_no, first_turn, last_turn, ['out_of_view', 'archived', 'compacted', 'kept'][level + 1] AS fidelity, score, {CARRIED} AS carried, coalesce(ceil(length({CARRIED}) / 4.0), 0)::BIGINT AS carried_tokens FROM plan")
def h8_span_states(spark, sf_dir):
    return health.span_states(B.plan(spark, sf_dir))


STATES = "states AS (SELECT h.conv_id, h.message_turn, h.seq, h.topic_label, h.content, h.speaker, h.replaced_turn, p.span_no, coalesce(['out_of_view', 'archived', 'compacted', 'kept'][level + 1], 'verbatim') AS fidelity, level IS NULL OR level = 3 OR (level > 0 AND replaced_turn IS NULL) AS reaches_model FROM chain h LEFT JOIN condensed c ON c.conv_id = h.conv_id AND c.turn_index = h.message_turn LEFT JOIN plan p ON p.conv_id = c.conv_id AND p.span_no = c.span_no)"


def states(spark, sf_dir):
    return health.fact_states(facts.supersession_chain(_filed(spark, sf_dir)), B.condensed(spark, sf_dir), B.plan(spark, sf_dir))


@query(with_("plan", "chain", "condensed").rstrip() + f", {STATES}\nSELECT conv_id, message_turn, seq, topic_label, content, replaced_turn, span_no, fidelity, reaches_model FROM states")
def h9_fact_states(spark, sf_dir):
    return states(spark, sf_dir).select("conv_id", "message_turn", "seq", "topic_label", "content", "replaced_turn", "span_no", "fidelity", "reaches_model")


_n = lambda name: f"count(*) FILTER (WHERE fidelity = '{name}') AS {name}"


@query(with_("plan", "chain", "condensed").rstrip() + f", {FIDELITY}, {STATES}, t AS (SELECT conv_id, {', '.join(map(_n, ('verbatim', 'kept', 'compacted', 'archived', 'out_of_view')))} FROM fidelity GROUP BY conv_id), f AS (SELECT conv_id, count(*) FILTER (WHERE reaches_model) AS a, count(*) FILTER (WHERE NOT reaches_model) AS b, count(replaced_turn) AS c FROM states GROUP BY conv_id), w AS (SELECT conv_id, round(sum(token_count) / {WINDOW}, 6) >= 0.8 AS w FROM turns GROUP BY conv_id)\nSELECT t.*, coalesce(a, 0) AS facts_sent, coalesce(b, 0) AS facts_unseen, coalesce(c, 0) AS facts_replaced, w AS warn_window FROM t LEFT JOIN f USING (conv_id) LEFT JOIN w USING (conv_id)")
def h10_knowledge_summary(spark, sf_dir):
    return health.knowledge_summary(fidelity(spark, sf_dir), states(spark, sf_dir), health.token_budget(turns(spark, sf_dir), WINDOW))


@query(with_("turns") + "SELECT conv_id, turn_index, sum(token_count) OVER (PARTITION BY conv_id ORDER BY turn_index)::BIGINT AS written_tokens, token_count + 3 AS sent_tokens FROM turns QUALIFY true")
def h11_prompt_size_series(spark, sf_dir):
    t = turns(spark, sf_dir)
    return health.prompt_size_series(t, t.select("conv_id", "turn_index", (F.col("token_count") + 3).alias("sent_tokens")))


@query(PASSES + ", r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pass_no) - row_number() OVER (PARTITION BY conv_id, status ORDER BY pass_no) AS run FROM passes)\nSELECT conv_id, status, min(pass_no) AS first_pass, max(pass_no) AS last_pass, count(*) AS passes, min(duration) AS least, max(duration) AS most FROM r GROUP BY conv_id, status, run")
def h12_quiet_runs(spark, sf_dir):
    return health.quiet_runs(passes(spark, sf_dir))


@query(PASSES + "SELECT conv_id, status AS reason, n_kept AS detail, count(*) AS times, max(pass_no) AS last_pass FROM passes GROUP BY ALL")
def h13_shortfall_groups(spark, sf_dir):
    return health.shortfall_groups(passes(spark, sf_dir).select("conv_id", F.col("status").alias("reason"), F.col("n_kept").alias("detail"), "pass_no"))


@query(with_("plan").rstrip() + f", s AS (SELECT conv_id, bool_or(coalesce(contains(lower({CARRIED}), 'an'), false)) AS recap, bool_or(contains(lower(text), 'an')) AS stored FROM plan GROUP BY conv_id), n AS (SELECT conv_id, bool_or(contains(lower(content), 'an')) AS verbatim FROM split WHERE in_tail GROUP BY conv_id)\nSELECT conv_id, CASE WHEN verbatim THEN 'verbatim' WHEN recap THEN 'in recap' WHEN stored THEN 'only stored' ELSE 'nowhere' END AS reach FROM n FULL JOIN s USING (conv_id)")
def h14_search_reach(spark, sf_dir):
    p = B.plan(spark, sf_dir)
    carried = health.span_states(p).join(p.select("conv_id", "span_no", F.col("text").alias("content")), ["conv_id", "span_no"])
    return health.search_reach(carried, B.split(spark, sf_dir).filter("in_tail"), F.lit("an"))


@query(with_("plan", "chain", "condensed") + ", o AS (SELECT conv_id, sum(len(turn_indices)) FILTER (WHERE level = 3) AS a, sum(len(turn_indices)) FILTER (WHERE level = 2) AS b, sum(len(turn_indices)) FILTER (WHERE level = 1) AS c, sum(len(turn_indices)) FILTER (WHERE level = 0) AS d FROM plan GROUP BY conv_id), n AS (SELECT h.conv_id, count(*) AS n FROM chain h JOIN condensed c ON c.conv_id = h.conv_id AND c.turn_index = h.replaced_turn GROUP BY h.conv_id)\nSELECT conv_id, coalesce(a, 0)::BIGINT AS n_kept, coalesce(b, 0)::BIGINT AS n_compacted, coalesce(c, 0)::BIGINT AS n_archived, coalesce(d, 0)::BIGINT AS n_folded, coalesce(n, 0) AS facts_replaced FROM o LEFT JOIN n USING (conv_id)")
def h15_collection_history(spark, sf_dir):
    return health.collection_history(levels.plan_outcome(B.plan(spark, sf_dir)), facts.supersession_chain(_filed(spark, sf_dir)))


@query(with_("plan") + "SELECT conv_id, min(first_turn) AS first_turn, max(last_turn) AS last_turn, count(*) AS spans FROM (SELECT *, span_no - row_number() OVER (PARTITION BY conv_id ORDER BY span_no) AS run FROM plan WHERE level = 1) GROUP BY conv_id, run HAVING count(*) >= 2")
def h16_archived_runs(spark, sf_dir):
    return health.archived_runs(B.plan(spark, sf_dir))


@query(PASSES + "SELECT conv_id, max(pass_no) FILTER (WHERE reason IS NOT NULL) AS refused_at FROM passes GROUP BY conv_id HAVING max(pass_no) FILTER (WHERE reason IS NOT NULL) > coalesce(max(pass_no) FILTER (WHERE status = 'completed' AND reason IS NULL), -1)")
def h17_credential_refusal(spark, sf_dir):
    return health.credential_refusal(passes(spark, sf_dir))


@query(with_("plan").rstrip() + f", {planning.RECAP}, {planning.CONTEXT}\nSELECT w.conv_id, w.n AS written_tokens, s.n AS sent_tokens, round((w.n - s.n) / w.n, 6) AS saved_share FROM (SELECT conv_id, sum(token_count)::BIGINT AS n FROM turns GROUP BY conv_id) w JOIN (SELECT conv_id, sum(token_count)::BIGINT AS n FROM context GROUP BY conv_id) s USING (conv_id)")
def h18_conversation_tokens(spark, sf_dir):
    sent = planning.context(spark, sf_dir).groupBy("conv_id").agg(F.sum("token_count").alias("sent_tokens"))
    return health.conversation_tokens(turns(spark, sf_dir), sent)


@query(with_("turns", "cuts") + rf", o AS (SELECT conv_id, {B._line.format('min_by(content, turn_index)')} AS line FROM turns WHERE role = 'user' GROUP BY conv_id)" + "\nSELECT t.conv_id, t.n AS recorded_turns, t.k AS tokens, CASE WHEN length(line) > 72 THEN rtrim(line[1:71]) || '…' ELSE line END AS title, cut FROM (SELECT conv_id, count(*) AS n, sum(token_count)::BIGINT AS k FROM turns GROUP BY conv_id) t LEFT JOIN o ON o.conv_id = t.conv_id LEFT JOIN cuts c ON c.conv_id = t.conv_id")
def h19_session_overview(spark, sf_dir):
    from palimpsest.functions.text import title

    t = turns(spark, sf_dir)
    titles = t.filter("said_by_user").groupBy("conv_id").agg(title(F.min_by("person_text", "turn_index")).alias("title"))
    return health.session_overview(t, titles, B.cuts(spark, sf_dir))


@query(with_("plan", "chain", "condensed").rstrip() + f", {STATES}\nSELECT conv_id, speaker, message_turn, content, reaches_model, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY reaches_model, message_turn DESC, seq DESC) AS place FROM states WHERE replaced_turn IS NULL")
def h20_fact_board(spark, sf_dir):
    return health.fact_board(states(spark, sf_dir)).select("conv_id", "speaker", "message_turn", "content", "reaches_model", "place")


def probes(spark, sf_dir, said=None):
    """A probe for each user turn of three words or more: its third word is the answer, the last turn's first word a replaced one."""
    words = F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0))
    t = (turns(spark, sf_dir) if said is None else said).filter("role = 'user'").withColumn("w", words).filter(F.size("w") >= 3)
    return t.select("conv_id", F.col("turn_index").alias("probe_id"), F.concat(F.lit("What came after "), F.element_at("w", 2), F.lit("?")).alias("question"), F.array(F.element_at("w", 3)).alias("accept"), F.array(F.element_at("w", 1)).alias("reject"), F.col("turn_index").alias("established_at"))


#: Whole words of plain letters, their edges as classes of letters, since this dialect's word edges know ASCII only.
_names = lambda text, word: rf"regexp_matches({text}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])' || {word} || '($|[^\p{{L}}\p{{M}}\p{{N}}_])', 'i')"
PROBES = "probes AS (SELECT conv_id, turn_index AS probe_id, 'What came after ' || w[2] || '?' AS question, w[3] AS accept, w[1] AS reject FROM (SELECT *, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM turns WHERE role = 'user') WHERE len(w) >= 3)"
PRESENCE = f"presence AS (SELECT conv_id, probe_id, CASE WHEN bool_or(hit AND turn_index >= 0) THEN 'verbatim' WHEN bool_or(hit) THEN 'condensed' ELSE 'absent' END AS presence FROM (SELECT p.conv_id, probe_id, turn_index, coalesce({_names('content', 'accept')}, false) AS hit FROM probes p LEFT JOIN context c ON c.conv_id = p.conv_id) GROUP BY ALL)"


@query(with_("turns").rstrip() + f", {PROBES}, v AS (SELECT p.conv_id, probe_id, CASE WHEN NOT {_names('content', 'accept')} THEN 'not_stated' WHEN {_names('question', 'accept')} THEN 'given_away' END AS violation FROM probes p JOIN turns t ON t.conv_id = p.conv_id AND turn_index = probe_id)\nSELECT * FROM v WHERE violation IS NOT NULL")
def e1_validate_probes(spark, sf_dir):
    return E.validate_probes(probes(spark, sf_dir), turns(spark, sf_dir))


@query(with_("turns") + "SELECT conv_id, bool_or((role = 'user') <> (turn_index % 2 = 0)) AS odd, arg_max(role, turn_index) AS last FROM turns GROUP BY conv_id HAVING bool_or((role = 'user') <> (turn_index % 2 = 0)) OR arg_max(role, turn_index) <> 'assistant'")
def e1_alternation(spark, sf_dir):
    return E.alternation_violations(turns(spark, sf_dir))


#: Answers that only name words of plain letters, so that whole words are the same to every regular expression.
GRADED = PROBES + ", graded AS (SELECT *, CASE (conv_id + probe_id) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN accept WHEN 3 THEN accept || ' (was ' || reject || ')' ELSE 'none of it' END AS answer, CASE (conv_id + probe_id) % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'unknown' WHEN 2 THEN CASE WHEN accept = reject THEN 'unclear' ELSE 'right' END WHEN 3 THEN CASE WHEN accept = reject THEN 'unclear' ELSE 'right' END ELSE CASE WHEN accept NOT IN ('none', 'of', 'it') THEN 'wrong' WHEN reject IN ('none', 'of', 'it') THEN 'unclear' ELSE 'right' END END AS verdict FROM probes)"


def graded(spark, sf_dir):
    """Every probe with a stand-in answer of one of five kinds."""
    k = (F.col("conv_id") + F.col("probe_id")) % 5
    right, old = F.col("accept")[0], F.col("reject")[0]
    answer = F.when(k == 1, "unknown").when(k == 2, right).when(k == 3, F.concat(right, F.lit(" (was "), old, F.lit(")"))).when(k == 4, "none of it")
    return E.grade_answers(probes(spark, sf_dir).withColumn("answer", answer))


@query(with_("turns").rstrip() + f", {GRADED}\nSELECT conv_id, probe_id, answer, verdict FROM graded")
def e2_grade_answers(spark, sf_dir):
    return graded(spark, sf_dir).select("conv_id", "probe_id", "answer", "verdict")


@query(with_("turns").rstrip() + f", {PROBES}\nSELECT conv_id, 'with' AS arm, row_number() OVER (PARTITION BY conv_id ORDER BY probe_id) AS number, accept AS answer FROM probes")
def e3_split_answers(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("probe_id", "accept")))
    lines = F.transform(rows, lambda r, i: F.concat((i + 1).cast("string"), F.lit(") "), r.accept[0], F.lit(" ")))
    reply = F.concat(F.lit("Here you are:\n"), F.array_join(lines, "\n"), F.lit("\n1. again"))
    replies = probes(spark, sf_dir).groupBy("conv_id").agg(F.lit("with").alias("arm"), reply.alias("reply"), F.count(F.lit(1)).alias("n"))
    return E.split_answers(replies)


def presence(spark, sf_dir):
    """Where each probe's answer stands in what would be sent; turns are put in order once, for the probes too."""
    parts = B.divided(spark, sf_dir)
    asked = written(probes(spark, sf_dir, parts[0]).select("conv_id", "probe_id", "accept"))
    return E.answer_presence(asked, planning.context(spark, sf_dir, parts))


_present = with_("plan").rstrip() + f", {planning.RECAP}, {planning.CONTEXT}, {GRADED}, {PRESENCE}\n"


@query(_present + "SELECT conv_id, probe_id, presence FROM presence")
def e4_answer_presence(spark, sf_dir):
    return presence(spark, sf_dir)


@query(_present + "SELECT count(*) AS probes, count_if(verdict = 'right')::BIGINT AS right_with, count(*) AS right_without, count_if(verdict <> 'right')::BIGINT AS lost, count_if(presence = 'absent')::BIGINT AS absent, count_if(presence <> 'absent' AND verdict <> 'right')::BIGINT AS present_but_missed FROM graded JOIN presence USING (conv_id, probe_id)")
def e5_survival_totals(spark, sf_dir):
    g = graded(spark, sf_dir).select("conv_id", "probe_id", F.col("verdict").alias("verdict_with"), F.lit("right").alias("verdict_without"))
    return E.survival_totals(g.join(presence(spark, sf_dir), ["conv_id", "probe_id"]))


@query(with_("plan").rstrip() + f", {planning.RECAP}, {planning.CONTEXT}\nSELECT w.conv_id, round(1 - s.n / w.n, 6) AS reduction FROM (SELECT conv_id, sum(token_count)::BIGINT AS n FROM turns GROUP BY conv_id) w LEFT JOIN (SELECT conv_id, sum(token_count)::BIGINT AS n FROM context GROUP BY conv_id) s USING (conv_id)")
def e6_prompt_reduction(spark, sf_dir):
    arm = lambda df, name: df.groupBy("conv_id").agg(F.lit(name).alias("arm"), F.sum("token_count").alias("prompt_tokens"))
    return E.prompt_reduction(arm(turns(spark, sf_dir), "without").unionByName(arm(planning.context(spark, sf_dir), "with")))


@query(_present + "SELECT conv_id, probe_id, presence, CASE presence WHEN 'absent' THEN 'unknown' ELSE 'right' END AS verdict FROM presence")
def e7_survival_by_presence(spark, sf_dir):
    return E.survival_by_presence(presence(spark, sf_dir))


@query(with_("turns").rstrip() + f", {PROBES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY probe_id) AS k FROM probes)\nSELECT conv_id, '{E.INTRO}' || string_agg(k || '. ' || question, chr(10) ORDER BY k) AS content FROM n GROUP BY conv_id")
def e8_question_message(spark, sf_dir):
    return E.question_message(probes(spark, sf_dir))


def event_stream(spark, sf_dir, files=None, size=None):
    return streams.open_stream(spark, f"{sf_dir}/events.parquet", files, size).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("client_session", F.concat(F.lit("s"), "user_id"))


@query(with_("plan") + "SELECT conv_id, span_no, level, tokens FROM plan")
def q1_stream_collections(spark, sf_dir):
    """Turns as a stream, planned by the batch code for the conversations that each batch touches."""
    stream = streams.open_stream(spark, f"{sf_dir}/conversations.parquet", size=streams.BACKLOG)
    table = BucketTable(spark, ", ".join(f"{name} {kind}" for name, kind in stream.dtypes))
    plans = BucketTable(spark, "conv_id long, span_no long, level int, tokens long")

    def plan(rows):
        return B.plan(_Tables(spark, {"conversations": rows}), "")

    streams.run(stream, each=streams.collect_turns(table, plans, plan))
    return plans.read()


@query()
def q1_stream_passes(spark, sf_dir):
    """Turns as a stream: spans, staged or switched, with their levels after the newest reply; as d8_backfill_collections gives them."""
    live = streams.Collections(spark, f"{state_folder(spark)}/collections-{uuid.uuid4()}", B.as_turns, PASSES_)
    streams.run(streams.open_stream(spark, f"{sf_dir}/conversations.parquet", size=streams.BACKLOG), each=live.each)
    return live.state["spans"].read().select("conv_id", "span_no", "first_turn", "last_turn", "staged", "level")


class _Tables:
    """Stands for a session whose reader gives the tables of one batch."""

    def __init__(self, spark, tables):
        self.read, self.tables = self, tables

    def parquet(self, path):
        return self.tables[path.rpartition("/")[2].removesuffix(".parquet")]


@query("SELECT 'c' || user_id AS conversation_id, max(epoch_us(ts) / 1000000.0) AS last_used_at, arg_max(CASE WHEN event_id % 2 = 0 THEN 3600.0 ELSE 300.0 END, ts)::DOUBLE AS lifetime_s, bool_or(event_id % 3 > 0) AS uses_cache FROM events GROUP BY user_id")
def q2_stream_cache_state(spark, sf_dir):
    rows = streams.run(streams.stream_cache_state(replies(event_stream(spark, sf_dir, None))), "update")
    last = F.max(F.struct("last_used_at", "batch", "lifetime_s", "uses_cache")).alias("r")
    return rows.groupBy("conversation_id").agg(last).select("conversation_id", "r.last_used_at", "r.lifetime_s", "r.uses_cache")


def replies(events):
    """Events as replies of a user's conversation."""
    return events.select(F.concat(F.lit("c"), "user_id").alias("conversation_id"), "ts", F.when(F.col("event_id") % 2 == 0, 3600.0).otherwise(300.0).alias("lifetime_s"), (F.col("event_id") % 3 > 0).alias("used"))


@query("""WITH l AS (SELECT 'c' || user_id AS conversation_id, epoch_us(max(ts)) / 1000000.0 + arg_max(CASE WHEN event_id % 2 = 0 THEN 3600.0 ELSE 300.0 END, ts) + 5 AS gone, bool_or(event_id % 3 > 0) AS used FROM events GROUP BY user_id)
SELECT conversation_id, gone::DOUBLE AS at FROM l WHERE used AND gone < (SELECT epoch_us(max(ts)) / 1000000.0 - 600 FROM events)""")
def q2_stream_cold_caches(spark, sf_dir):
    """Conversations whose cache has gone cold by the stream's event time, and when."""
    rows = streams.run(streams.stream_cache_state(replies(event_stream(spark, sf_dir, None))), "update")
    last = F.max_by(F.struct("state", "at"), F.struct("last_used_at", F.col("state") == streams.COLD, "batch")).alias("r")
    return rows.filter("uses_cache").groupBy("conversation_id").agg(last).filter(F.col("r.state") == streams.COLD).select("conversation_id", "r.at")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 24 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g), t AS (SELECT 's' || user_id AS client_session, min(ts) AS opened_at, max(ts) + INTERVAL 24 HOUR AS closed_at, count(*) AS requests FROM k GROUP BY user_id, n)\nSELECT * FROM t WHERE closed_at <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def q3_stream_idle_close(spark, sf_dir):
    return streams.run(streams.stream_idle_close(event_stream(spark, sf_dir, None))).drop("batch")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, 's' || user_id AS client_session, count(*) AS requests, (sum(floor(value)::BIGINT))::BIGINT AS tokens_in, (sum(floor(value / 2)::BIGINT))::BIGINT AS tokens_out FROM events GROUP BY ALL")
def q4_stream_traffic(spark, sf_dir):
    e = event_stream(spark, sf_dir, None).select("ts", "client_session", F.floor("value").alias("tokens_from_client"), F.floor(F.col("value") / 2).alias("tokens_forwarded"))
    rows = streams.run(streams.stream_traffic(e), "update")
    last = F.max(F.struct("batch", "requests", "tokens_in", "tokens_out")).alias("r")
    return rows.groupBy("start", "client_session").agg(last).select("start", "client_session", "r.requests", "r.tokens_in", "r.tokens_out")


@query("SELECT a.event_id AS request_id, min(b.ts) AS settled_at FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY GROUP BY a.event_id")
def q5_stream_settle(spark, sf_dir):
    e = lambda kind: event_stream(spark, sf_dir, None).filter(F.col("event_type") == kind)
    conv = F.concat(F.lit("c"), "user_id").alias("conversation_id")
    asked = e("view").select(F.col("event_id").alias("request_id"), conv, "ts", F.lit(1).alias("position"), F.md5(F.col("user_id").cast("string")).alias("newest_hash"))
    later = e("click").select(conv, "ts", F.array(F.md5(F.col("user_id").cast("string"))).alias("hashes"))
    return streams.run(streams.stream_settle(asked, later)).filter("kept").groupBy("request_id").agg(F.min("settled_at").alias("settled_at"))


@query("SELECT 's' || a.user_id % 10 AS client_session, a.event_id AS call_id, b.event_id AS opening_id FROM events a JOIN events b ON a.user_id % 10 = b.user_id % 10 AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE AND contains(floor(b.value)::BIGINT::VARCHAR, (floor(a.value)::BIGINT::VARCHAR)[1])")
def q6_stream_spawn_links(spark, sf_dir):
    e = lambda kind: event_stream(spark, sf_dir, None).filter(F.col("event_type") == kind).withColumn("client_session", F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")))
    digits = F.floor("value").cast("string")
    calls = e("click").select("client_session", F.col("event_id").alias("call_id"), F.substring(digits, 1, 1).alias("prompt"), F.col("ts").alias("called_at"))
    openings = e("view").select("client_session", F.col("event_id").alias("opening_id"), digits.alias("opening"), F.col("ts").alias("opened_at"))
    return streams.run(streams.stream_spawn_pairs(calls, openings)).select("client_session", "call_id", "opening_id")


@query()
def q6_stream_one_to_one(spark, sf_dir):
    """Links chosen on the stream: each call and each opening in one link at most."""
    e = event_stream(spark, sf_dir, None).filter("event_type in ('click', 'view')")
    digits, call = F.floor("value").cast("string"), F.col("event_type") == "click"
    sides = e.select(F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("client_session"), "ts", F.col("event_id").cast("string").alias("id"), F.when(call, F.substring(digits, 1, 1)).alias("prompt"), F.when(~call, digits).alias("opening"))
    return streams.run(streams.stream_spawn_links(sides)).select("client_session", "call_id", "opening_id")


@query("SELECT user_id AS conv_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def q7_stream_health(spark, sf_dir):
    e = event_stream(spark, sf_dir, size=streams.BACKLOG).select(F.col("user_id").alias("conv_id"), "event_id", F.col("event_type").alias("status"))
    table = BucketTable(spark, "conv_id long, event_id long, status string")
    streams.run(e, each=streams.keep_latest(table, "event_id"))
    return table.read()


@query(PASSES + "SELECT conv_id, pass_no, status, CASE WHEN status = 'completed' THEN n_kept ELSE 0 END AS n_kept, CASE WHEN status = 'completed' THEN round(condensed_tokens / tokens_seen, 6) END AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pass_no DESC) AS place FROM passes) WHERE place <= 50")
def q7_stream_passes(spark, sf_dir):
    """Passes as a stream: the newest fifty of each conversation, with H4's counts and H5's ratio."""
    table = BucketTable(spark, "conv_id long, pass_no long, status string, n_kept long, tokens_seen long, condensed_tokens long")
    path = f"{state_folder(spark)}/passes-{uuid.uuid4()}"
    passes(spark, sf_dir).select("conv_id", "pass_no", "status", "n_kept", "tokens_seen", "condensed_tokens").repartition(4).write.parquet(path)
    streams.run(streams.open_stream(spark, path, size=streams.BACKLOG), each=streams.keep_passes(table))
    kept = health.transformation_ratio(health.gc_breakdown(table.read()))
    return kept.select("conv_id", "pass_no", "status", "n_kept", "ratio")


@query("SELECT event_id AS request_id, event_id % 2 AS attempt FROM events")
def q8_dedupe_requests(spark, sf_dir):
    """Every event twice: one record is left of each."""
    e = event_stream(spark, sf_dir, None).select(F.col("event_id").alias("request_id"), (F.col("event_id") % 2).alias("attempt"), "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return streams.run(streams.dedupe_requests(e)).select("request_id", "attempt")


@query("""WITH f AS (SELECT user_id AS conv_id, event_id AS message_turn, 't' || event_id % 3 AS topic_label, event_type AS content FROM events), p AS (SELECT *, lag(content) OVER (PARTITION BY conv_id, topic_label ORDER BY message_turn) AS before FROM f), k AS (SELECT * FROM p WHERE before IS NULL OR before <> content)
SELECT conv_id, message_turn, topic_label, content, CASE WHEN lead(content) OVER (PARTITION BY conv_id, topic_label ORDER BY message_turn) IS NULL THEN 'active' ELSE 'superseded' END AS knowledge_status FROM k""")
def q9_late_facts_stream(spark, sf_dir):
    """Events as facts without a speaker: the type is the value, three topics a user."""
    e = event_stream(spark, sf_dir, size=streams.BACKLOG).select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("message_turn"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("topic_label"), F.col("event_type").alias("content"), F.lit("fact").alias("knowledge_type"), F.lit(None).cast("string").alias("speaker"))
    table = BucketTable(spark, "conv_id long, message_turn long, seq long, topic_label string, content string, knowledge_type string, speaker string, knowledge_status string")
    streams.run(e, each=streams.file_late_facts(table))
    return table.read().select("conv_id", "message_turn", "topic_label", "content", "knowledge_status")
