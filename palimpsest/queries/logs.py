"""Queries over request logs. Requests come from events: a user is a client session, a ten-day stretch a conversation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import requests as R
from palimpsest.operators import traffic as A
from palimpsest.queries import base as B
from palimpsest.queries.base import Registry
from palimpsest.sources import ingest as I

query = Registry()
QUERIES, SQL = query.queries, query.sql

LOG = """WITH e AS (SELECT *, 's' || user_id AS client_session, CASE WHEN event_id % 7 = 0 THEN 'a' || (event_id % 21) END AS agent_id, (extract(day FROM ts)::BIGINT - 1) // 10 AS stretch FROM events),
k AS (SELECT *, CASE WHEN event_type <> 'signup' THEN 'c' || user_id || '-' || stretch || coalesce('-' || agent_id, '') END AS conversation_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, md5(user_id || '-' || floor(value / 4)::BIGINT) AS newest_hash FROM e),
log AS (SELECT event_id AS request_id, client_session, agent_id, conversation_id, seq, newest_hash, ts AS forwarded_at, event_type,
  sum((event_type <> 'error')::INT) OVER (PARTITION BY client_session, conversation_id ORDER BY seq)::BIGINT + (event_type = 'error')::INT AS position,
  CASE event_type WHEN 'view' THEN 'typed' WHEN 'error' THEN 'typed' WHEN 'click' THEN 'tool_results' WHEN 'purchase' THEN 'assistant' ELSE 'client' END AS newest,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN NULL ELSE 200 END AS status, event_type NOT IN ('error', 'signup') AS finished, CASE WHEN event_type = 'click' THEN 'tool_use' ELSE 'end_turn' END AS stop_reason,
  CASE WHEN event_type <> 'signup' THEN ts END AS ended_at, floor(value)::BIGINT AS input_tokens, event_id % 5 * 10 AS cache_read_tokens, event_id % 3 * 20 AS cache_creation_tokens, floor(value / 2)::BIGINT AS output_tokens,
  ceil(value)::BIGINT + 10 AS tokens_from_client, ceil(value * 0.8)::BIGINT + 5 AS tokens_forwarded, event_id % 4 = 0 AS collected, event_id % 9 = 0 AS switch_planned, 'm' || (event_id % 3) AS model, CASE WHEN event_id % 2 = 0 THEN 3600 ELSE 300 END AS lifetime_s, 'o' || user_id || '-' || stretch AS opening FROM k)
"""


def log(spark, sf_dir):
    e = B.read(spark, sf_dir, "events").withColumns({"client_session": F.concat(F.lit("s"), "user_id"), "agent_id": F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("a"), (F.col("event_id") % 21).cast("string"))), "stretch": F.floor((F.dayofmonth("ts") - 1) / 10)})
    conv = F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("-"), F.col("stretch").cast("string"), F.coalesce(F.concat(F.lit("-"), "agent_id"), F.lit("")))
    kind = F.col("event_type")
    e = e.withColumns({"conversation_id": F.when(kind != "signup", conv), "seq": F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"), "newest_hash": F.md5(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("value") / 4).cast("string")))})
    so_far = Window.partitionBy("client_session", "conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    error = kind == "error"
    kept = F.collect_list(F.when(~error, F.col("newest_hash"))).over(so_far)
    hashes = F.when(error, F.concat(kept, F.array("newest_hash"))).otherwise(kept)
    newest = F.when(kind.isin("view", "error"), "typed").when(kind == "click", "tool_results").when(kind == "purchase", "assistant").otherwise("client")
    e = e.withColumn("hashes", hashes)
    i = F.col("event_id")
    return e.select(i.alias("request_id"), "client_session", "agent_id", "conversation_id", "seq", "newest_hash", "hashes", F.size("hashes").cast("long").alias("position"), F.col("ts").alias("forwarded_at"), newest.alias("newest"), F.when(error, 500).when(kind != "signup", 200).alias("status"), (~kind.isin("error", "signup")).alias("finished"), F.when(kind == "click", "tool_use").otherwise("end_turn").alias("stop_reason"), F.when(kind != "signup", F.col("ts")).alias("ended_at"), F.floor("value").alias("input_tokens"), (i % 5 * 10).alias("cache_read_tokens"), (i % 3 * 20).alias("cache_creation_tokens"), F.floor(F.col("value") / 2).alias("output_tokens"), (F.ceil("value") + 10).alias("tokens_from_client"), (F.ceil(F.col("value") * 0.8) + 5).alias("tokens_forwarded"), (i % 4 == 0).alias("collected"), (i % 9 == 0).alias("switch_planned"), F.concat(F.lit("m"), (i % 3).cast("string")).alias("model"), F.when(i % 2 == 0, 3600).otherwise(300).alias("lifetime_s"), F.concat(F.lit("o"), F.col("user_id").cast("string"), F.lit("-"), F.col("stretch").cast("string")).alias("opening"), F.lit(None).cast("long").alias("spawned_by"))


def settled(spark, sf_dir):
    return R.settle_requests(log(spark, sf_dir))


SETTLED = LOG.rstrip() + """,
h AS (SELECT *, coalesce(list(newest_hash) FILTER (event_type <> 'error') OVER (PARTITION BY client_session, conversation_id ORDER BY seq), []) AS said FROM log),
hist AS (SELECT * EXCLUDE said, CASE WHEN event_type = 'error' THEN list_append(said, newest_hash) ELSE said END AS hashes FROM h),
met AS (SELECT l.request_id, arg_min(r.hashes[l.position] = l.newest_hash, r.seq) AS kept FROM hist l JOIN hist r ON r.client_session = l.client_session AND r.conversation_id = l.conversation_id AND r.seq > l.seq AND len(r.hashes) >= l.position GROUP BY l.request_id),
settled AS (SELECT log.*, kept FROM log LEFT JOIN met USING (request_id))
"""
KINDS = SETTLED.rstrip() + """,
began AS (SELECT *, CASE WHEN agent_id IS NULL AND conversation_id IS NOT NULL THEN min(seq) FILTER (agent_id IS NULL) OVER c END AS start, max(seq) FILTER (agent_id IS NULL) OVER c AS last, row_number() OVER (PARTITION BY client_session, conversation_id, newest_hash ORDER BY seq) > 1 AS again,
  EXISTS (SELECT 1 FROM log o WHERE o.client_session = s.client_session AND o.conversation_id IS NOT DISTINCT FROM s.conversation_id AND o.position = s.position AND o.seq > s.seq AND o.newest_hash <> s.newest_hash) AS others
  FROM settled s WINDOW c AS (PARTITION BY client_session, conversation_id)),
kinds AS (SELECT *, CASE WHEN conversation_id IS NOT NULL AND again THEN 'retry'
  WHEN NOT kept THEN CASE WHEN newest = 'tool_results' AND NOT finished THEN 'interrupted' ELSE 'replaced' END
  WHEN newest = 'tool_results' THEN 'tool_round' WHEN newest = 'client' THEN 'notice' WHEN newest = 'assistant' THEN 'reply'
  WHEN agent_id IS NOT NULL AND conversation_id IS NOT NULL THEN 'task' WHEN conversation_id IS NULL THEN 'unclaimed'
  WHEN agent_id IS NULL AND seq = last AND start < max(start) OVER (PARTITION BY client_session) AND kept IS NULL AND newest = 'typed' THEN 'closing'
  WHEN kept IS NULL AND others THEN 'pending' ELSE 'turn' END AS kind FROM began)
"""


@query(SETTLED + "SELECT request_id, kept FROM settled")
def t1_settle_requests(spark, sf_dir):
    return settled(spark, sf_dir).select("request_id", "kept")


def kinds(spark, sf_dir):
    return R.turn_of_request(R.request_kinds(settled(spark, sf_dir)))


@query(KINDS + "SELECT request_id, count(*) FILTER (kind = 'turn' AND agent_id IS NULL) OVER (PARTITION BY client_session ORDER BY seq) - 1 AS turn_no FROM kinds")
def t2_turn_of_request(spark, sf_dir):
    return kinds(spark, sf_dir).select("request_id", "turn_no")


@query(KINDS + "SELECT request_id, kind FROM kinds")
def t3_request_kind(spark, sf_dir):
    return kinds(spark, sf_dir).select("request_id", "kind")


def by_day(spark, sf_dir):
    """Requests whose turn is the day, for the operators that only need one."""
    return log(spark, sf_dir).withColumn("turn_no", F.dayofmonth("forwarded_at").cast("long"))


@query(LOG + "SELECT client_session, extract(day FROM forwarded_at)::BIGINT AS turn_no, count(*) AS requests, sum(tokens_from_client)::BIGINT AS tokens_from_client, sum(tokens_forwarded)::BIGINT AS tokens_forwarded, (sum(tokens_from_client) - sum(tokens_forwarded))::BIGINT AS tokens_saved, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(CASE WHEN collected THEN cache_creation_tokens ELSE 0 END)::BIGINT AS collection_cache_write_tokens, CASE WHEN NOT bool_or(ended_at IS NULL) THEN max(ended_at) END AS ended_at FROM log GROUP BY ALL")
def t4_turn_totals(spark, sf_dir):
    return R.turn_totals(by_day(spark, sf_dir))


#: One pair a step and session, in the order of the choice; what is taken is kept in lists.
LINKS = """WITH RECURSIVE e AS (SELECT 's' || user_id % 10 AS client_session, * FROM events),
p AS (SELECT c.client_session, c.event_id AS call_id, o.event_id AS opening_id, row_number() OVER (PARTITION BY c.client_session ORDER BY c.ts, o.ts, c.event_id, o.event_id) AS n FROM e c JOIN e o ON o.client_session = c.client_session AND c.event_type = 'click' AND o.event_type = 'view' AND abs(epoch_us(o.ts) - epoch_us(c.ts)) <= 600000000 AND contains(floor(o.value)::BIGINT::VARCHAR, left(floor(c.value)::BIGINT::VARCHAR, 1))),
g AS (SELECT DISTINCT client_session, 0::BIGINT AS n, NULL::BIGINT AS call_id, NULL::BIGINT AS opening_id, false AS taken, []::BIGINT[] AS calls, []::BIGINT[] AS openings FROM p
UNION ALL SELECT p.client_session, p.n, p.call_id, p.opening_id, f.ok, CASE WHEN f.ok THEN list_append(g.calls, p.call_id) ELSE g.calls END, CASE WHEN f.ok THEN list_append(g.openings, p.opening_id) ELSE g.openings END
  FROM g JOIN p ON p.client_session = g.client_session AND p.n = g.n + 1, LATERAL (SELECT NOT list_contains(g.calls, p.call_id) AND NOT list_contains(g.openings, p.opening_id) AS ok) f)
SELECT client_session, call_id, opening_id FROM g WHERE taken"""


@query(LINKS)
def t5_link_subagents(spark, sf_dir):
    """Calls are clicks, openings views of the session within ten minutes; a prompt is the amount's first digits."""
    e = B.read(spark, sf_dir, "events").withColumn("client_session", F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")))
    digits = F.floor("value").cast("string")
    calls = e.filter("event_type = 'click'").select("client_session", F.col("event_id").alias("call_id"), F.substring(digits, 1, 1).alias("prompt"), F.col("ts").alias("called_at"))
    openings = e.filter("event_type = 'view'").select("client_session", F.col("event_id").alias("opening_id"), digits.alias("opening"), F.col("ts").alias("opened_at"))
    return R.link_subagents(calls, openings)


@query(LOG + "SELECT client_session, agent_id, arg_min(extract(day FROM forwarded_at)::BIGINT, seq) AS turn_no FROM log WHERE agent_id IS NOT NULL GROUP BY ALL")
def t6_subagent_turn(spark, sf_dir):
    return R.subagent_turns(by_day(spark, sf_dir))


@query(LOG + "SELECT client_session, extract(day FROM forwarded_at)::BIGINT AS turn_no, coalesce(list(request_id || ':' || newest ORDER BY seq) FILTER (WHERE agent_id IS NULL), []) AS requests, coalesce(list_sort(list_distinct(list(agent_id) FILTER (WHERE agent_id IS NOT NULL))), []) AS subagents FROM log GROUP BY ALL")
def t7_session_trace(spark, sf_dir):
    return R.session_trace(by_day(spark, sf_dir).withColumn("kind", F.col("newest")))


@query(LOG + ", c AS (SELECT client_session, conversation_id, max(agent_id) AS agent_id, min(seq) AS start, max(seq) AS last FROM log WHERE conversation_id IS NOT NULL GROUP BY ALL), p AS (SELECT *, CASE WHEN agent_id IS NOT NULL THEN 1 WHEN last = max(last) FILTER (WHERE agent_id IS NULL) OVER (PARTITION BY client_session) THEN 0 ELSE 2 END AS part FROM c)\nSELECT client_session, conversation_id, agent_id, part, row_number() OVER (PARTITION BY client_session ORDER BY part, CASE WHEN part = 1 THEN start ELSE -last END, conversation_id) AS place FROM p")
def t8_conversation_parts(spark, sf_dir):
    return R.conversation_parts(log(spark, sf_dir))


@query(LOG + "SELECT conversation_id, coalesce(arg_max(status IS NULL OR stop_reason = 'tool_use', seq) FILTER (WHERE status IS NULL OR status = 200), false) AS open FROM log WHERE conversation_id IS NOT NULL GROUP BY conversation_id")
def t9_tool_round_open(spark, sf_dir):
    return R.tool_round_open(log(spark, sf_dir))


_sums = "count(*) AS requests, sum(tokens_from_client)::BIGINT AS tokens_in, sum(tokens_forwarded)::BIGINT AS tokens_out, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in A.USAGE)


@query(LOG + f"SELECT client_session, conversation_id, {_sums}, CASE grouping(client_session, conversation_id) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level, (sum(tokens_from_client) - sum(tokens_forwarded))::BIGINT AS tokens_saved FROM log GROUP BY ROLLUP (client_session, conversation_id)")
def a1_traffic_totals(spark, sf_dir):
    return A.traffic_totals(log(spark, sf_dir))


@query(LOG + "SELECT l.request_id, coalesce(l.conversation_id, c.id) AS conversation_id FROM log l LEFT JOIN (SELECT client_session, agent_id, opening, arg_min(conversation_id, seq) AS id FROM log WHERE conversation_id IS NOT NULL GROUP BY ALL) c ON l.client_session = c.client_session AND l.agent_id IS NOT DISTINCT FROM c.agent_id AND l.opening = c.opening")
def a2_claim_openings(spark, sf_dir):
    return A.claim_openings(log(spark, sf_dir)).select("request_id", "conversation_id")


@query(LOG + "SELECT client_session, count(*) FILTER (WHERE conversation_id IS NULL) AS requests, coalesce(sum(tokens_from_client) FILTER (WHERE conversation_id IS NULL), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_forwarded) FILTER (WHERE conversation_id IS NULL), 0)::BIGINT AS tokens_out FROM log GROUP BY client_session")
def a3_outside_conversations(spark, sf_dir):
    return A.outside_conversations(log(spark, sf_dir))


@query(LOG + "SELECT model, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in A.USAGE) + ", sum(input_tokens + cache_read_tokens + cache_creation_tokens)::BIGINT AS prompt_tokens FROM log GROUP BY model")
def a4_usage_by_kind(spark, sf_dir):
    return A.usage_by_kind(log(spark, sf_dir), "model")


@query(LOG + "SELECT model, sum(input_tokens + cache_read_tokens + cache_creation_tokens) / sum(tokens_forwarded) AS rate FROM log WHERE status = 200 AND tokens_forwarded > 0 GROUP BY model")
def a5_token_rate(spark, sf_dir):
    return A.token_rates(log(spark, sf_dir))


@query(LOG + "SELECT conversation_id, max(seq) AS seq, arg_max(tokens_forwarded, seq) AS tokens_forwarded, arg_max(input_tokens + cache_read_tokens + cache_creation_tokens, seq) AS prompt_tokens FROM log WHERE status = 200 GROUP BY conversation_id")
def a6_last_reply(spark, sf_dir):
    return A.last_reply(log(spark, sf_dir))


@query(LOG + ", c AS (SELECT client_session, conversation_id, max(seq) AS last_seq, count(*) AS requests, coalesce(max(seq) FILTER (WHERE collected), -1) AS c FROM log WHERE conversation_id IS NOT NULL GROUP BY ALL)\nSELECT client_session, conversation_id, last_seq, requests, (SELECT count(*) FROM log l WHERE l.conversation_id = c.conversation_id AND switch_planned AND l.seq > c.c) AS waiting, row_number() OVER (PARTITION BY client_session ORDER BY last_seq DESC, conversation_id) AS place FROM c")
def a7_session_listing(spark, sf_dir):
    return A.session_listing(log(spark, sf_dir))


@query(LOG + "SELECT c.conversation_id, c.seq, c.tokens_forwarded AS rewritten_tokens, min(r.seq) AS carried_by, arg_min(r.cache_creation_tokens, r.seq) AS cache_write FROM log c LEFT JOIN log r ON r.conversation_id = c.conversation_id AND r.seq >= c.seq AND r.collected AND r.status = 200 WHERE c.switch_planned AND c.conversation_id IS NOT NULL GROUP BY ALL")
def a8_collection_cost(spark, sf_dir):
    r = log(spark, sf_dir).filter("conversation_id is not null")
    return A.collection_cost(r.filter("switch_planned").select("conversation_id", "seq", F.col("tokens_forwarded").alias("rewritten_tokens")), r)


@query(LOG + ", w AS (SELECT *, max(CASE WHEN status = 200 THEN (cache_read_tokens + cache_creation_tokens > 0)::INT END) OVER b AS u, max(CASE WHEN status = 200 THEN forwarded_at END) OVER b AS last FROM log WINDOW b AS (PARTITION BY conversation_id ORDER BY seq, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))\nSELECT request_id, u = 1 AS uses_cache, (epoch_us(forwarded_at) - epoch_us(last))::DOUBLE / 1000000.0::DOUBLE AS idle_s, CASE WHEN coalesce(u = 0 OR (epoch_us(forwarded_at) - epoch_us(last)) / 1000000.0 > lifetime_s + 5, false) THEN 'cold' ELSE 'warm' END AS cache FROM w WHERE conversation_id IS NOT NULL")
def a9_cache_state(spark, sf_dir):
    return A.cache_state(log(spark, sf_dir).filter("conversation_id is not null")).select("request_id", "uses_cache", "idle_s", "cache")


@query(LOG + ", r AS (SELECT model, sum(input_tokens + cache_read_tokens + cache_creation_tokens) / sum(tokens_forwarded) AS rate FROM log WHERE status = 200 GROUP BY model), o AS (SELECT model, newest_hash AS k, sum(output_tokens) AS o FROM log WHERE status = 200 GROUP BY ALL)\nSELECT l.request_id AS turn_id, l.model, l.newest_hash AS thinking_key, l.input_tokens AS visible_tokens, greatest(0, coalesce(round(o / rate) - input_tokens, 0))::BIGINT AS thinking_tokens FROM log l LEFT JOIN o ON o.model = l.model AND o.k = l.newest_hash LEFT JOIN r ON r.model = l.model")
def a10_thinking_tokens(spark, sf_dir):
    r = log(spark, sf_dir)
    turns = r.select(F.col("request_id").alias("turn_id"), "model", F.col("newest_hash").alias("thinking_key"), F.col("input_tokens").alias("visible_tokens"))
    return A.thinking_tokens(turns, r.filter("status = 200").select("model", F.col("newest_hash").alias("thinking_key"), "output_tokens"), A.token_rates(r))


@query(LOG + ", s AS (SELECT model, newest_hash AS k, max(input_tokens) AS size FROM log WHERE status = 200 GROUP BY ALL)\nSELECT l.request_id AS turn_id, coalesce(round(greatest(0.0, size / 1.5 - 2)), 0)::BIGINT AS attachment_tokens, (size IS NULL)::BIGINT AS unsized FROM log l LEFT JOIN s ON s.model = l.model AND s.k = l.newest_hash")
def a11_attachment_tokens(spark, sf_dir):
    r = log(spark, sf_dir)
    sizes = r.filter("status = 200").groupBy("model", F.col("newest_hash").alias("key")).agg(F.max("input_tokens").alias("size"))
    return A.attachment_tokens(r.select(F.col("request_id").alias("turn_id"), "model", F.lit(1.5).alias("rate"), F.array("newest_hash").alias("keys")), sizes)


@query(LOG + ", w AS (SELECT model, max(request_id) AS window FROM log WHERE model <> 'm0' GROUP BY model)\nSELECT request_id, coalesce(window, 128000)::BIGINT AS window, window IS NOT NULL AS reported FROM log LEFT JOIN w USING (model)".replace("AS window", 'AS "window"').replace("(window,", '("window",').replace("AS BIGINT", "AS BIGINT").replace(", window IS", ', "window" IS'))
def a12_model_window(spark, sf_dir):
    r = log(spark, sf_dir)
    windows = r.filter("model <> 'm0'").groupBy("model").agg(F.max("request_id").alias("window"))
    return A.model_windows(r, windows).select("request_id", F.col("window").cast("long").alias("window"), "reported")


@query(LOG + "SELECT extract(day FROM forwarded_at)::BIGINT AS pass_id, conversation_id, model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM log GROUP BY ALL")
def a13_own_model_usage(spark, sf_dir):
    return A.own_model_usage(log(spark, sf_dir).withColumn("pass_id", F.dayofmonth("forwarded_at").cast("long")))


@query(LOG + "SELECT count(*) FILTER (WHERE collected) AS applied, count(*) FILTER (WHERE NOT collected) AS bypassed, count(*) FILTER (WHERE newest = 'typed') AS rewinds, count(*) FILTER (WHERE newest = 'client') AS restarts, count(*) FILTER (WHERE newest = 'assistant') AS seeds, count(*) FILTER (WHERE collected AND status >= 400) AS refused_rewrites FROM log")
def a14_gc_counters(spark, sf_dir):
    action = F.when(F.col("newest") == "typed", "rewind").when(F.col("newest") == "client", "restart").when(F.col("newest") == "assistant", "seed").otherwise("continue")
    return A.gc_counters(log(spark, sf_dir).withColumn("action", action))


@query(LOG + "SELECT client_session, CASE WHEN (1 - sum(tokens_forwarded) / sum(tokens_from_client)) > 0 AND floor((sum(tokens_from_client) - sum(tokens_forwarded)) / sum(tokens_from_client) * 100 + 0.5) = 0 THEN '<1%' ELSE floor((sum(tokens_from_client) - sum(tokens_forwarded)) / sum(tokens_from_client) * 100 + 0.5)::BIGINT || '%' END AS share FROM log GROUP BY client_session")
def a15_saving_share(spark, sf_dir):
    return log(spark, sf_dir).groupBy("client_session").agg(A.saving_share(F.sum("tokens_from_client"), F.sum("tokens_forwarded")).alias("share"))


def bodies(spark, sf_dir):
    """Request bodies as a client would log them, one a conversation: plain texts, tool calls and results, cache markers."""
    c = B.read(spark, sf_dir, "conversations")
    text = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    call = F.concat(F.lit('[{"type":"text","text":'), text, F.lit('},{"type":"tool_use","id":"t'), F.col("turn").cast("string"), F.lit('","name":"find","input":{"q":1}}]'))
    result = F.concat(F.lit('[{"type":"tool_result","tool_use_id":"t'), (F.col("turn") - 1).cast("string"), F.lit('","content":"ok"},{"type":"text","text":'), text, F.lit("}]"))
    content = F.when(F.col("role") == "assistant", call).when((F.col("role") == "user") & (F.col("turn") > 1), result).otherwise(text)
    message = F.concat(F.lit('{"role":"'), F.when((F.col("conv_id") % 50 == 49) & (F.col("turn") == 0), "robot").otherwise(F.col("role")), F.lit('","content":'), content, F.lit("}"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda r: r.m), ",")
    marker = F.when(F.col("conv_id") % 3 == 0, ',"cache_control":{"type":"ephemeral","ttl":"1h"}').when(F.col("conv_id") % 3 == 1, ',"cache_control":{"type":"ephemeral"}').otherwise("")
    head = F.concat(F.lit('{"model":"m1","tools":[{"name":"find","input_schema":{"type":"object"}'), F.first(marker), F.lit('}],"system":[{"type":"text","text":"Be brief."},{"type":"text","text":"Answer in one line."}],"messages":['))
    return c.groupBy(F.col("conv_id").alias("request_id")).agg(F.concat(head, rows, F.lit("]}")).alias("body"))


RAW = """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index FROM conversations WHERE role <> 'system' AND NOT (conv_id % 50 = 49 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0))),
t AS (SELECT *, CASE WHEN role = 'assistant' THEN text || chr(10) || '[tool call: find] {"q":1}' WHEN turn > 1 THEN '[tool result] ok' || chr(10) || text ELSE text END AS said FROM c)
"""


@query(RAW + "SELECT conv_id AS request_id, turn_index, role FROM t")
def i1_ingest_requests(spark, sf_dir):
    return I.ingest_requests(bodies(spark, sf_dir))[0].select("request_id", "turn_index", "role")


def _blocks(spark, sf_dir):
    return I.ingest_requests(bodies(spark, sf_dir))[0].withColumn("blocks", I.blocks_of(F.col("content")))


@query(RAW + "SELECT conv_id AS request_id, turn_index, md5(said) AS text_md5 FROM t")
def i2_block_text(spark, sf_dir):
    return _blocks(spark, sf_dir).select("request_id", "turn_index", F.md5(I.block_text(F.col("blocks"))).alias("text_md5"))


@query(RAW + "SELECT conv_id AS request_id, turn_index, CASE WHEN role = 'assistant' THEN ['t' || turn] ELSE [] END AS calls, CASE WHEN role = 'user' AND turn > 1 THEN ['t' || (turn - 1)] ELSE [] END AS results FROM t")
def i3_tool_ids(spark, sf_dir):
    calls, results = I.tool_ids(F.col("blocks"))
    return _blocks(spark, sf_dir).select("request_id", "turn_index", calls.alias("calls"), results.alias("results"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS left_text, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS lifted FROM conversations")
def i4_lift_instructions(spark, sf_dir):
    c = B.read(spark, sf_dir, "conversations")
    tagged = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("<system-reminder>\nBe kind.\n</system-reminder>\n"), "text")).otherwise(F.col("text"))
    left, lifted = I.lift_instructions(tagged)
    return c.select("conv_id", "turn", left.alias("left_text"), F.size(lifted).alias("lifted"))


@query(B.with_("instructions") + "SELECT conv_id, turn, content, turns_before FROM instructions")
def i5_inline_instructions(spark, sf_dir):
    return B.instructions(spark, sf_dir)


_tool = "ceil(length('find{\"type\":\"object\"}') / 4.0)::BIGINT"
_system = "(ceil(length('Be brief.') / 4.0) + ceil(length('Answer in one line.') / 4.0))::BIGINT"
PROMPT = f"WITH q AS (SELECT conv_id AS request_id, {_tool} + {_system} AS fixed_prompt_tokens, CASE WHEN conv_id % 3 < 2 THEN {_system} ELSE {_tool} + {_system} END AS uncached_prefix_tokens, CASE WHEN conv_id % 3 = 0 THEN 3600.0 ELSE 300.0 END::DOUBLE AS cache_lifetime_s FROM conversations GROUP BY conv_id)\n"


@query(PROMPT + "SELECT request_id, fixed_prompt_tokens FROM q")
def i6_fixed_prompt_tokens(spark, sf_dir):
    return I.prompt_figures(bodies(spark, sf_dir)).select("request_id", "fixed_prompt_tokens")


@query(PROMPT + "SELECT request_id, uncached_prefix_tokens FROM q")
def i7_uncached_prefix_tokens(spark, sf_dir):
    return I.prompt_figures(bodies(spark, sf_dir)).select("request_id", "uncached_prefix_tokens")


@query(PROMPT + "SELECT request_id, (uncached_prefix_tokens + coalesce(n, 0))::BIGINT AS overhead_tokens FROM q LEFT JOIN (SELECT conv_id, sum(ceil(length(text) / 4.0)) AS n FROM (SELECT DISTINCT conv_id, text FROM conversations WHERE role = 'system') GROUP BY conv_id) i ON q.request_id = i.conv_id")
def i8_rewrite_overhead_tokens(spark, sf_dir):
    told = B.instructions(spark, sf_dir).select(F.col("conv_id").alias("request_id"), "content")
    return I.rewrite_overhead(I.prompt_figures(bodies(spark, sf_dir)), told)


@query(PROMPT + "SELECT request_id, cache_lifetime_s FROM q")
def i9_cache_lifetime(spark, sf_dir):
    return I.prompt_figures(bodies(spark, sf_dir)).select("request_id", "cache_lifetime_s")


def replies(spark, sf_dir):
    """Reply bodies made of events: an error's is an error, a click's a tool call after some thinking."""
    e = B.read(spark, sf_dir, "events")
    i, v = F.col("event_id").cast("string"), F.floor("value").cast("string")
    good = F.concat(F.lit('{"type":"message","stop_reason":"'), F.when(F.col("event_type") == "click", "tool_use").otherwise("end_turn"), F.lit('","usage":{"input_tokens":'), v, F.lit(',"output_tokens":7},"content":[{"type":"thinking","signature":"sig'), i, F.lit('"},{"type":"tool_use","id":"c'), i, F.lit('","name":"find","input":{"prompt":"look for the number '), v, F.lit('"}}]}'))
    bad = F.concat(F.lit('{"type":"error","error":{"type":"overloaded_error","message":"try '), i, F.lit('"}}'))
    body = F.when(F.col("event_type") == "error", bad).when(F.col("event_type") == "signup", "gateway").otherwise(good)
    return e.select(F.col("event_id").alias("request_id"), F.when(F.col("event_type").isin("error", "signup"), 529).otherwise(200).alias("status"), body.alias("body"))


@query("SELECT event_id AS request_id, CASE WHEN event_type IN ('error', 'signup') THEN 529 ELSE 200 END AS status, event_type NOT IN ('error', 'signup') AS finished, CASE WHEN event_type = 'click' THEN 'tool_use' WHEN event_type IN ('view', 'purchase') THEN 'end_turn' END AS stop_reason, CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE floor(value)::BIGINT END AS input_tokens, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE 'c' || event_id END AS call_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN sha256('sig' || event_id) END AS thinking_key, CASE WHEN event_type = 'error' THEN 'overloaded_error' END AS error_type FROM events")
def i10_reply_outline(spark, sf_dir):
    return I.reply_outlines(replies(spark, sf_dir)).select("request_id", "status", "finished", "stop_reason", "input_tokens", F.try_element_at("tool_calls", F.lit(1)).call_id.alias("call_id"), "thinking_key", "error_type")


@query("SELECT conv_id * 1000 + turn AS request_id, text[1:10] || text[11:] AS joined FROM conversations WHERE turn % 5 <> 4")
def i11_assemble_stream_replies(spark, sf_dir):
    """Each turn streamed as two deltas and an end; the end of every fifth is missing."""
    c = B.read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "turn", "text")
    part = lambda s: F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), s.alias("text")).alias("delta")))
    end = F.when(F.col("turn") % 5 != 4, '{"type":"message_stop"}').otherwise('{"type":"ping"}')
    events = c.select("request_id", F.posexplode(F.array(part(F.substring("text", 1, 10)), part(F.substring("text", 11, 1 << 30)), end)).alias("seq", "json"))
    return I.assemble_stream_replies(events).select("request_id", F.col("blocks")[0].text.alias("joined"))


@query("SELECT event_id AS request_id, sha256('sig' || event_id) AS thinking_key FROM events WHERE event_type NOT IN ('error', 'signup')")
def i12_thinking_keys(spark, sf_dir):
    keys = I.thinking_keys(F.from_json("body", I.REPLY).getField("content"))
    return replies(spark, sf_dir).select("request_id", F.explode(keys).alias("thinking_key"))


@query("SELECT conv_id, turn, sha256('image|' || length(text) || '|' || text[1:256] || '|' || CASE WHEN length(text) > 256 THEN text[-256:] ELSE text END) AS attachment_key FROM conversations")
def i13_attachment_keys(spark, sf_dir):
    nul = F.lit(None).cast("string")
    b = F.array(F.struct(F.lit("image").alias("type"), F.col("text").alias("source"), nul.alias("text")))
    return B.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(I.attachment_keys(b)).alias("attachment_key"))


@query("SELECT 'c' || event_id AS call_id, 'look for the number ' || floor(value)::BIGINT AS prompt FROM events WHERE event_type NOT IN ('error', 'signup')")
def i14_spawn_prompts(spark, sf_dir):
    calls = replies(spark, sf_dir).select(F.explode(F.from_json("body", I.REPLY).getField("content")).alias("b")).filter("b.type = 'tool_use'").select(F.col("b.id").alias("call_id"), F.col("b.input").alias("input"))
    return I.spawn_prompts(calls).select("call_id", "prompt")


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'u-' || user_id END AS origin FROM events")
def i15_client_origin(spark, sf_dir):
    raw = F.concat(F.when(F.col("event_id") % 3 == 0, "u ").otherwise("u-"), F.col("user_id").cast("string"))
    return B.read(spark, sf_dir, "events").select("event_id", I.client_origin(raw).alias("origin"))


@query("SELECT event_id AS request_id, CASE event_type WHEN 'error' THEN 'overloaded_error: try ' || event_id ELSE 'no readable error' END AS refusal FROM events WHERE event_type IN ('error', 'signup')")
def i16_refusal_reason(spark, sf_dir):
    return I.reply_outlines(replies(spark, sf_dir)).filter("refusal is not null").select("request_id", "refusal")
