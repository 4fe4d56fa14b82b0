"""Queries over exchanges and spans: cuts, scores, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import exchanges, scoring, summaries
from palimpsest.queries import base as B
from palimpsest.queries.base import CAP, KEEP_LAST, Registry, turns, with_

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Tool ids of the queries: first words.
TOOLS = "tools AS (SELECT conv_id, turn_index, role, token_count, opens, regexp_extract(lower(content), '[a-z0-9]+') AS word FROM turns), gaps AS (SELECT c.conv_id, min(c.turn_index) AS call, max(r.turn_index) AS result FROM tools c JOIN tools r ON c.conv_id = r.conv_id AND c.word = r.word WHERE c.role = 'assistant' AND r.role = 'user' GROUP BY c.conv_id, c.word), safe AS (SELECT conv_id, turn_index AS cut FROM turns t WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.conv_id = t.conv_id AND g.call < t.turn_index AND t.turn_index <= g.result))\n"
with_tools = with_("starts").rstrip() + ", " + TOOLS


def _tooled(spark, sf_dir):
    return turns(spark, sf_dir).withColumns({"tool_use_ids": F.col("call_words"), "tool_result_ids": F.col("result_words")})


@query(with_("starts") + "SELECT conv_id, turn_index, exchange_no, starts FROM starts")
def g1_span_starts(spark, sf_dir):
    return exchanges.span_starts(turns(spark, sf_dir)).select("conv_id", "turn_index", "exchange_no", "starts")


@query(with_tools + "SELECT conv_id, cut FROM safe")
def g2_safe_cuts(spark, sf_dir):
    return exchanges.safe_cuts(_tooled(spark, sf_dir))


@query(with_tools + f"SELECT conv_id, any_value(n) AS n_turns, coalesce(max(turn_index) FILTER (WHERE starts AND s.cut IS NOT NULL AND turn_index <= n - {KEEP_LAST}), 0) AS cut FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM starts) t LEFT JOIN safe s ON t.conv_id = s.conv_id AND t.turn_index = s.cut GROUP BY t.conv_id".replace("SELECT conv_id, any_value", "SELECT t.conv_id, any_value"))
def g3_cut_point(spark, sf_dir):
    return exchanges.cut_points(_tooled(spark, sf_dir), KEEP_LAST)


@query(with_("condensed") + "SELECT conv_id, turn_index, span_no FROM condensed")
def g4_group_exchanges(spark, sf_dir):
    return exchanges.group_exchanges(B.split(spark, sf_dir).filter("not in_tail"), CAP).select("conv_id", "turn_index", "span_no")


@query(with_("index_lines") + "SELECT * FROM index_lines")
def g5_index_line(spark, sf_dir):
    return exchanges.index_lines(B.condensed(spark, sf_dir))


@query(with_("spans") + ", b AS (SELECT conv_id, cut, coalesce(sum(tokens), 0)::BIGINT AS compactable FROM cuts LEFT JOIN spans USING (conv_id) GROUP BY ALL)\nSELECT *, cut > 0 AND compactable > 0 AND compactable >= 100 AS ready FROM b")
def g6_batch_ready(spark, sf_dir):
    n = B.spans(spark, sf_dir).groupBy("conv_id").agg(F.sum("tokens").alias("t"))
    batch = B.cuts(spark, sf_dir).join(n, "conv_id", "left").select("conv_id", "cut", F.coalesce("t", F.lit(0)).alias("compactable"))
    return exchanges.batch_ready(batch, 100)


@query(with_("split") + "SELECT conv_id, turn_index, in_tail FROM split")
def g7_tail_and_cut(spark, sf_dir):
    return B.split(spark, sf_dir).select("conv_id", "turn_index", "in_tail")


@query(with_("scored") + "SELECT conv_id, span_no, round(recency, 6) AS recency FROM scored")
def s3_recency(spark, sf_dir):
    return B.scored(spark, sf_dir).select("conv_id", "span_no", F.round("recency", 6).alias("recency"))


@query(with_("relevance") + "SELECT conv_id, span_no, round(relevance, 6) AS relevance FROM relevance")
def s4_lexical_relevance(spark, sf_dir):
    t, _, s = B.divided(spark, sf_dir)
    r = scoring.lexical_relevance(s, scoring.now_text(t))
    return r.select("conv_id", "span_no", F.round("relevance", 6).alias("relevance"))


@query(with_("now") + "SELECT conv_id, now FROM now")
def s5_now_text(spark, sf_dir):
    return scoring.now_text(B.split(spark, sf_dir))


def _span_scores(spark, sf_dir, weights):
    t, _, s = B.divided(spark, sf_dir)
    newest = t.groupBy("conv_id").agg(F.max("turn_index").alias("newest"))
    return scoring.span_scores(s, scoring.now_text(t), newest, weights)


PARTS = with_("scored").rstrip() + ", " + B.signs("scored", "conv_id, span_no", "text", "ceil(length(text) / 4.0)") + ", parts AS (SELECT s.conv_id, s.span_no, text, s.recency, s.relevance, greatest(s.recency, s.relevance) AS liveness, decision, density FROM scored s JOIN scores USING (conv_id, span_no))\n"


@query(PARTS + "SELECT conv_id, span_no, round(recency, 6) AS recency, round(relevance, 6) AS relevance, round(liveness, 6) AS liveness, round(decision, 6) AS decision, round(density, 6) AS density, round(0.6::DOUBLE * liveness + 0.2::DOUBLE * decision + 0.2::DOUBLE * density, 6) AS score FROM parts")
def s6_span_score(spark, sf_dir):
    out = _span_scores(spark, sf_dir, scoring.Weights())
    return out.select("conv_id", "span_no", *(F.round(c, 6).alias(c) for c in ("recency", "relevance", "liveness", "decision", "density", "score")))


@query(PARTS + ", asks AS (SELECT *, least(len(text) - len(replace(text, '?', '')), 3) / 3.0::DOUBLE AS asking, greatest(0.0::DOUBLE, 1.0::DOUBLE - length(text) / 400.0::DOUBLE) AS brevity FROM parts)\nSELECT conv_id, span_no, round(asking, 6) AS asking, round(brevity, 6) AS brevity, round((0.5::DOUBLE * liveness + 0.25::DOUBLE * decision + 0.25::DOUBLE * density + 0.5::DOUBLE * asking + 0.25::DOUBLE * brevity) / 1.75::DOUBLE, 6) AS score FROM asks")
def s6_own_scorers(spark, sf_dir):
    """Two importance scorers beside the own ones, each with its weight: questions asked, and brevity."""
    asking = scoring.Scorer("asking", 0.5, lambda text, tokens: F.regexp_count(text, F.lit(r"\?")) / 3.0)
    brevity = scoring.Scorer("brevity", 0.25, lambda text, tokens: 1.0 - F.char_length(text) / 400.0)
    out = _span_scores(spark, sf_dir, scoring.Weights(0.5, 0.25, 0.25, scorers=(asking, brevity)))
    return out.select("conv_id", "span_no", *(F.round(c, 6).alias(c) for c in ("asking", "brevity", "score")))


@query(with_("spans") + "SELECT conv_id, round(1.0, 6)::DOUBLE AS ceiling, count(*) AS spans FROM spans GROUP BY conv_id")
def s7_score_ceiling(spark, sf_dir):
    return B.spans(spark, sf_dir).groupBy("conv_id").agg(F.lit(round(scoring.score_ceiling(), 6)).alias("ceiling"), F.count(F.lit(1)).alias("spans"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT label, e AS q FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM v) WHERE r = 1)
SELECT v.label AS conv_id, v.vec_id AS span_no, round(list_cosine_similarity(e, q), 6) AS relevance FROM v JOIN n USING (label)""")
def s4_vector_relevance(spark, sf_dir):
    """The relevance seam by vectors: a label stands for a conversation, its first vector for what is discussed now."""
    v = B.read(spark, sf_dir, "embeddings").select(F.col("label").alias("conv_id"), F.col("vec_id").alias("span_no"), F.col("embedding").alias("vector"))
    now = v.groupBy("conv_id").agg(F.min_by("vector", "span_no").alias("now_vector"))
    return scoring.vector_relevance(v, now).withColumn("relevance", F.round("relevance", 6))


@query(with_("spans") + "SELECT conv_id, span_no, tokens > 6 / 0.65 AS worth FROM spans")
def c1_worth_compacting(spark, sf_dir):
    return B.spans(spark, sf_dir).select("conv_id", "span_no", summaries.worth_compacting(F.col("tokens")).alias("worth"))


@query(with_("spans") + "SELECT conv_id, span_no, least(greatest(64, floor(tokens * 0.35::DOUBLE)), tokens - 7)::BIGINT AS target FROM spans")
def c2_summary_target(spark, sf_dir):
    return B.spans(spark, sf_dir).select("conv_id", "span_no", summaries.summary_target(F.col("tokens")).alias("target"))


@query(with_("spans") + ", r AS (SELECT conv_id, span_no, tokens, least(greatest(64, floor(tokens * 0.35::DOUBLE)), tokens - 7)::BIGINT AS target_tokens FROM spans WHERE tokens > 6 / 0.65), t AS (SELECT conv_id, span_no, '<transcript>' || chr(10) || string_agg('[turn ' || turn_index || '] ' || role || ': ' || content, chr(10) ORDER BY turn_index) || chr(10) || '</transcript>' AS transcript FROM condensed GROUP BY ALL)\nSELECT r.*, floor(target_tokens * 0.75)::BIGINT AS target_words, transcript FROM r JOIN t USING (conv_id, span_no)")
def c3_summary_requests(spark, sf_dir):
    return summaries.summary_requests(B.spans(spark, sf_dir), summaries.transcript(B.condensed(spark, sf_dir)))


def _candidates(spark, sf_dir):
    """Opening lines as candidate summaries; some stop early, some are blank."""
    kind = (F.col("conv_id") + F.col("span_no")) % 7
    return exchanges.index_lines(B.condensed(spark, sf_dir)).select("conv_id", "span_no", F.when(kind == 0, "  ").otherwise(F.col("index_line")).alias("text"), F.when(kind == 1, "max_tokens").otherwise("end_turn").alias("stop_reason"))


@query(with_("index_lines", "spans") + ", c AS (SELECT conv_id, span_no, CASE WHEN (conv_id + span_no) % 7 = 0 THEN '  ' ELSE index_line END AS text, CASE WHEN (conv_id + span_no) % 7 = 1 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason FROM index_lines), m AS (SELECT c.*, ceil(length(trim(c.text)) / 4.0)::BIGINT + 6 AS summary_tokens, tokens AS run FROM c JOIN spans USING (conv_id, span_no))\nSELECT conv_id, span_no, text, stop_reason, summary_tokens, CASE WHEN NOT run > 6 / 0.65 THEN 'too_small' WHEN stop_reason <> 'end_turn' THEN 'incomplete' WHEN trim(text) = '' THEN 'empty' WHEN summary_tokens >= run THEN 'not_shorter' ELSE 'accepted' END AS status FROM m")
def c4_admit_summaries(spark, sf_dir):
    return summaries.admit_summaries(_candidates(spark, sf_dir), B.spans(spark, sf_dir))


@query(with_("condensed") + "SELECT conv_id, span_no, '[Summary of turns ' || min(turn_index) || '-' || max(turn_index) || '] ' || string_agg(content, ' ' ORDER BY turn_index) AS summary_text FROM condensed GROUP BY ALL")
def c5_concat_summary(spark, sf_dir):
    return summaries.concat_summary(B.condensed(spark, sf_dir))


@query(with_("spans").rstrip() + r""", pieces AS (SELECT conv_id, span_no, tokens, generate_subscripts(p, 1) AS pos, unnest(p) AS sentence FROM (SELECT conv_id, span_no, tokens,
  list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS p FROM spans WHERE tokens > 6 / 0.65)),
""" + B.signs("pieces", "conv_id, span_no, tokens, pos, sentence", "sentence", "ceil(length(sentence) / 4.0)::BIGINT") + """,
ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY conv_id, span_no ORDER BY round(decision + density, 6) DESC, pos) AS so_far FROM scores)
SELECT conv_id, span_no, string_agg(sentence, ' ' ORDER BY pos) AS summary_text, sum(n_tokens)::BIGINT AS summary_tokens FROM ranked WHERE so_far <= least(greatest(64, floor(tokens * 0.35::DOUBLE)), tokens - 7) GROUP BY ALL""")
def c6_extractive_summary(spark, sf_dir):
    return summaries.extractive_summary(B.spans(spark, sf_dir))


@query(with_("condensed") + "SELECT conv_id, span_no, string_agg(role || ' ' || length(content), ', ' ORDER BY turn_index) AS index_line FROM condensed GROUP BY ALL")
def g5_own_index_writer(spark, sf_dir):
    """An index writer of one's own: who spoke in the span, and for how long."""
    line = lambda said: F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit(" "), F.char_length(t["content"]).cast("string"))), ", ")
    return exchanges.index_lines(B.condensed(spark, sf_dir), line)


@query(with_("spans") + ", o AS (SELECT conv_id, span_no, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY span_no) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY span_no) AS k FROM spans), p AS (SELECT conv_id, span_no, tokens, k, tokens AS size, 0::BIGINT AS batch_no FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.span_no, o.tokens, o.k, CASE WHEN p.size + o.tokens > 200 THEN o.tokens ELSE p.size + o.tokens END, p.batch_no + (p.size + o.tokens > 200)::INT FROM p JOIN o ON o.conv_id = p.conv_id AND o.k = p.k + 1)\nSELECT conv_id, span_no, tokens, batch_no FROM p")
def f4_fact_batches(spark, sf_dir):
    from palimpsest.operators import facts

    return facts.fact_batches(B.spans(spark, sf_dir), 200)


