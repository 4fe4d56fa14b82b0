"""Tables that several queries start from, as DataFrames and as SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import BACK_REFERENCES, DECISIONS, DENSE, STOPWORDS
from palimpsest.operators import exchanges, scoring
from palimpsest.plans import levels, recap
from palimpsest.sources.state import written
from palimpsest.sources.turns import inline_instructions, turns_of

#: Settings of the queries: conversations of the tables are short, so that the usual ones would cut little.
KEEP_LAST, CAP, BUDGET, FOLD_LINE = 2, 60, 60, 15
BANDS = levels.Bands()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Collects a module's queries and their SQL."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the table of conversations."""
    return as_turns(read(spark, sf_dir, "conversations"))


def as_turns(conversations: DataFrame) -> DataFrame:
    """Turns with all that a plain log leaves empty; first words stand for the ids of tool calls and results."""
    word = F.array(F.regexp_extract(F.lower("content"), "[a-z0-9]+", 0))
    none = F.array().cast("array<string>")
    out = turns_of(conversations)
    parts = F.array(F.struct(F.lit("speaker").alias("writer"), F.col("content").alias("text")))
    return out.withColumns({"opens": F.col("role") == "user", "said_by_user": F.col("role") == "user", "person_text": F.col("content"), "speaker": F.col("role"), "parts": parts, "call_words": F.when(F.col("role") == "assistant", word).otherwise(none), "result_words": F.when(F.col("role") == "user", word).otherwise(none), "tool_use_ids": none, "tool_result_ids": none})


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline_instructions(read(spark, sf_dir, "conversations"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges.cut_points(turns(spark, sf_dir), KEEP_LAST)


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with in_tail."""
    t = turns(spark, sf_dir)
    return exchanges.tail_and_cut(t, exchanges.cut_points(t, KEEP_LAST))


def condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns before the cut with span_no."""
    return exchanges.group_exchanges(split(spark, sf_dir).filter("not in_tail"), CAP)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges.spans_of(condensed(spark, sf_dir))


def divided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns with in_tail, those before the cut with span_no, and their spans, each written once."""
    t = written(split(spark, sf_dir).drop("parts", "call_words", "result_words", "tool_use_ids"))
    rows = written(exchanges.group_exchanges(t.filter("not in_tail"), CAP))
    return t, rows, written(exchanges.spans_of(rows))


def scored_of(t: DataFrame, s: DataFrame) -> DataFrame:
    """Spans with recency, relevance and score, the greater of both."""
    newest = t.groupBy("conv_id").agg(F.max("turn_index").alias("newest"))
    related = scoring.lexical_relevance(s, scoring.now_text(t))
    out = s.join(related, ["conv_id", "span_no"]).join(newest, "conv_id").withColumn("recency", scoring.recency(F.col("last_turn"), F.col("newest")))
    return out.withColumn("score", F.round(F.greatest("recency", "relevance"), 6)).drop("newest")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _, s = divided(spark, sf_dir)
    return scored_of(t, s)


def texts(spark: SparkSession, sf_dir: str, parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Scored spans with their text at each level; the opening line, doubled, stands for a summary of longer spans.

    parts: what divided() gave, where a query reads it too.
    """
    t, rows, s = parts or divided(spark, sf_dir)
    lined = scored_of(t, s).join(exchanges.index_lines(rows), ["conv_id", "span_no"])
    summary = F.when(F.col("tokens") > 40, F.concat_ws(" ", "index_line", "index_line"))
    return recap.span_texts(lined.withColumn("summary_text", summary), rows)


def costs(spark: SparkSession, sf_dir: str, parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Spans ready for planning, written once; every third has a level already, and every fifth can't be archived."""
    out = written(recap.level_costs(texts(spark, sf_dir, parts)))
    current = F.when((F.col("conv_id") + F.col("span_no")) % 3 == 0, (F.col("conv_id") % 4).cast("int"))
    return out.withColumns({"current": current, "archivable": (F.col("conv_id") + F.col("span_no")) % 5 != 0, "budget": F.lit(BUDGET), "fold_line_tokens": F.lit(FOLD_LINE)})


def plan(spark: SparkSession, sf_dir: str, parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    return levels.plan_levels(costs(spark, sf_dir, parts), BANDS)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in facts, one for each turn of some length: its topic the initial of the third word, its value that of the last."""
    words = F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0))
    initial = lambda i: F.substring(F.try_element_at(words, F.lit(i)), 1, 1)
    topic = F.when(initial(3) < "d", F.lit("general")).otherwise(initial(3))
    return turns(spark, sf_dir).filter(F.size(words) >= 3).select("conv_id", F.col("turn_index").alias("message_turn"), F.lit(0).cast("long").alias("seq"), topic.alias("topic_label"), initial(-1).alias("content"), F.lit("fact").alias("knowledge_type"), F.col("role").alias("speaker"))


# The same in SQL. Each entry is one CTE; with_() puts together what a query needs.
_list = lambda words: ", ".join(f"'{w}'" for w in words)
_turns_named = "CASE WHEN first_turn = last_turn THEN 'turn ' || first_turn ELSE 'turns ' || first_turn || '–' || last_turn END"
_line = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_heading = lambda prefix: f"rtrim('{prefix} (' || {_turns_named} || ') ' || index_line)"
_band = lambda keep, archive: f"CASE WHEN score >= {keep} THEN 3 WHEN score >= {archive} THEN 2 ELSE 1 END"
_cost = lambda level: f"CASE {level} WHEN 3 THEN kept_tokens WHEN 2 THEN compacted_tokens WHEN 1 THEN archived_tokens ELSE 0 END"

CTES = {
    "turns": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, role, text AS content, ceil(length(text) / 4.0)::BIGINT AS token_count, role = 'user' AS opens FROM conversations WHERE role <> 'system'",
    "instructions": "SELECT conv_id, turn, content, turns_before FROM (SELECT conv_id, turn, role, text AS content, count(*) FILTER (WHERE role <> 'system') OVER (PARTITION BY conv_id ORDER BY turn) AS turns_before FROM conversations) WHERE role = 'system'",
    "numbered": "SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY turn_index)::BIGINT AS exchange_no FROM turns",
    "starts": "SELECT * EXCLUDE (a), opens OR (role = 'assistant' AND coalesce(a, false)) AS starts FROM (SELECT *, bool_or(role = 'assistant') OVER (PARTITION BY conv_id, exchange_no ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM numbered)",
    "cuts": f"SELECT conv_id, count(*) AS n_turns, coalesce(max(turn_index) FILTER (WHERE starts AND turn_index <= n - {KEEP_LAST}), 0) AS cut FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM starts) GROUP BY conv_id",
    "split": "SELECT t.*, turn_index >= cut AS in_tail, cut FROM turns t JOIN cuts USING (conv_id)",
    "grouped": f"""SELECT conv_id, turn_index, token_count AS size, role = 'assistant' AS has, 0::BIGINT AS span_no FROM split WHERE NOT in_tail AND turn_index = 0
  UNION ALL SELECT conv_id, turn_index, CASE WHEN n THEN tc ELSE size + tc END, a OR (has AND NOT n), span_no + n::INT
  FROM (SELECT t.conv_id, t.turn_index, t.token_count AS tc, t.role = 'assistant' AS a, g.size, g.has, g.span_no, t.opens OR (t.role = 'assistant' AND g.size + t.token_count > {CAP} AND g.has) AS n
    FROM grouped g JOIN split t ON t.conv_id = g.conv_id AND t.turn_index = g.turn_index + 1 WHERE NOT t.in_tail)""",
    "condensed": "SELECT t.*, g.span_no FROM split t JOIN grouped g USING (conv_id, turn_index)",
    "spans": "SELECT conv_id, span_no, min(turn_index) AS first_turn, max(turn_index) AS last_turn, sum(token_count)::BIGINT AS tokens, list(turn_index ORDER BY turn_index) AS turn_indices, string_agg(content, chr(10) ORDER BY turn_index) AS text FROM condensed GROUP BY conv_id, span_no",
    "now": "SELECT conv_id, coalesce(string_agg(content, chr(10) ORDER BY turn_index) FILTER (WHERE in_tail AND role = 'user'), '') AS now, max(turn_index) AS newest FROM split GROUP BY conv_id",
    "asked": f"SELECT DISTINCT conv_id, word FROM (SELECT conv_id, unnest(regexp_extract_all(lower(now), '[a-z0-9]+')) AS word FROM now) WHERE length(word) > 1 AND word NOT IN ({_list([*STOPWORDS, *BACK_REFERENCES])})",
    "met": "SELECT conv_id, span_no, word, count(*) AS c FROM (SELECT conv_id, span_no, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM spans) JOIN asked USING (conv_id, word) GROUP BY ALL",
    "weights": "SELECT a.conv_id, a.word, ln(1 + n / (1 + coalesce(df, 0))) AS w FROM asked a JOIN (SELECT conv_id, count(*) AS n FROM spans GROUP BY conv_id) USING (conv_id) LEFT JOIN (SELECT conv_id, word, count(*) AS df FROM met GROUP BY ALL) d ON a.conv_id = d.conv_id AND a.word = d.word",
    "relevance": "SELECT s.conv_id, s.span_no, coalesce(e / total, 0) AS relevance FROM spans s LEFT JOIN (SELECT m.conv_id, span_no, sum(w * c / (c + 1)) AS e FROM met m JOIN weights w ON m.conv_id = w.conv_id AND m.word = w.word GROUP BY ALL) x ON s.conv_id = x.conv_id AND s.span_no = x.span_no LEFT JOIN (SELECT conv_id, sum(w) AS total FROM weights GROUP BY conv_id) t ON s.conv_id = t.conv_id",
    "scored": "SELECT s.*, relevance, exp(-0.05 * greatest(0, newest - last_turn)) AS recency, round(greatest(exp(-0.05 * greatest(0, newest - last_turn)), relevance), 6) AS score FROM spans s JOIN relevance USING (conv_id, span_no) JOIN now USING (conv_id)",
    "openings": rf"SELECT conv_id, span_no, coalesce(min_by(content, turn_index) FILTER (WHERE role = 'user' AND regexp_matches(content, '\S')), min_by(content, turn_index) FILTER (WHERE regexp_matches(content, '\S')), '') AS opening FROM condensed GROUP BY ALL",
    "sentences": rf"SELECT conv_id, span_no, {_line.format('opening')} AS line, CASE WHEN regexp_extract({_line.format('opening')}, '^(.*?[.!?])(?:\s|$)', 1) <> '' THEN regexp_extract({_line.format('opening')}, '^(.*?[.!?])(?:\s|$)', 1) ELSE {_line.format('opening')} END AS sentence FROM openings",
    "index_lines": r"SELECT conv_id, span_no, CASE WHEN length(sentence) <= 100 THEN sentence ELSE regexp_replace(sentence[1:99], '\s\S*$', '') || '…' END AS index_line FROM sentences",
    "texts": f"""SELECT s.*, index_line, CASE WHEN tokens > 40 THEN index_line || ' ' || index_line END AS summary_text, q.kept_text,
  CASE WHEN tokens > 40 THEN {_heading(recap.SUMMARISED)} || chr(10) || index_line || ' ' || index_line END AS compacted_text, {_heading(recap.ARCHIVED_AT)} AS archived_text
  FROM scored s JOIN index_lines USING (conv_id, span_no) JOIN (SELECT conv_id, span_no, string_agg('{recap.QUOTED} (turn ' || turn_index || ', ' || role || ') ' || content, chr(10) ORDER BY turn_index) AS kept_text FROM condensed GROUP BY ALL) q USING (conv_id, span_no)""",
    "costs": f"""SELECT *, ceil(length(kept_text) / 4.0)::BIGINT AS kept_tokens, ceil(length(compacted_text) / 4.0)::BIGINT AS compacted_tokens, ceil(length(archived_text) / 4.0)::BIGINT AS archived_tokens,
  CASE WHEN (conv_id + span_no) % 3 = 0 THEN (conv_id % 4)::INT END AS current, (conv_id + span_no) % 5 <> 0 AS archivable, {BUDGET} AS budget, {FOLD_LINE} AS fold_line_tokens FROM texts""",
    "known": "SELECT *, coalesce(compacted_tokens < kept_tokens, false) AS ok_compacted, archivable AND archived_tokens < kept_tokens AND coalesce(archived_tokens < compacted_tokens, true) AS ok_archived FROM costs",
    "banded": f"SELECT *, CASE WHEN current IS NULL THEN {_band(0.7, 0.3)} WHEN {_band(0.75, 0.35)} > current THEN {_band(0.75, 0.35)} WHEN {_band(0.65, 0.25)} < current THEN {_band(0.65, 0.25)} ELSE current END AS band FROM known",
    "earned": "SELECT *, CASE WHEN band <= 1 AND ok_archived THEN 1 WHEN band <= 2 AND ok_compacted THEN 2 ELSE 3 END AS earned FROM banded",
    # The loop itself: rows (state) and a step number; each step lowers one span of each conversation that is over budget.
    "fitted": f"""SELECT conv_id, span_no, score, earned AS level, false AS lowered, 0 AS i FROM earned
  UNION ALL SELECT conv_id, span_no, score, CASE WHEN pick THEN lower ELSE level END, lowered OR pick, i + 1 FROM (
    SELECT *, t > budget AND lower IS NOT NULL AND row_number() OVER (PARTITION BY conv_id ORDER BY lower IS NULL, score, span_no) = 1 AS pick, max(lower) OVER (PARTITION BY conv_id) AS any_lower
    FROM (SELECT *, sum({_cost("level")}) OVER (PARTITION BY conv_id) AS t, CASE WHEN level = 3 AND ok_compacted THEN 2 WHEN level > 1 AND ok_archived THEN 1 END AS lower
      FROM (SELECT f.*, kept_tokens, compacted_tokens, archived_tokens, ok_compacted, ok_archived, budget FROM fitted f JOIN earned e USING (conv_id, span_no)))) WHERE t > budget AND any_lower IS NOT NULL""",
    "fit": "SELECT e.*, f.level, f.lowered FROM earned e JOIN (SELECT conv_id, span_no, arg_max(level, i) AS level, arg_max(lowered, i) AS lowered FROM fitted GROUP BY ALL) f USING (conv_id, span_no)",
    "plan": f"""SELECT * EXCLUDE (t, b, n, folded_, level, lowered), folded_ AS folded, CASE WHEN folded_ THEN 0 ELSE level END AS level, lowered AND NOT folded_ AS lowered FROM (
  SELECT *, t > budget AND (n = 1 OR t + fold_line_tokens - b > budget) AS folded_ FROM (
    SELECT *, sum({_cost("level")}) OVER (PARTITION BY conv_id) AS t, coalesce(sum({_cost("level")}) OVER (PARTITION BY conv_id ORDER BY span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY span_no) AS n FROM fit))""",
    "facts": "SELECT conv_id, turn_index AS message_turn, 0::BIGINT AS seq, CASE WHEN w[3][1] < 'd' THEN 'general' ELSE w[3][1] END AS topic_label, w[-1][1] AS content, 'fact' AS knowledge_type, role AS speaker FROM (SELECT *, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM turns) WHERE len(w) >= 3",
    # Topics one fact after the other, as they would be filed; on a topic the state is the value in force and who gave it.
    "ordered": "SELECT *, row_number() OVER (PARTITION BY conv_id, topic_label ORDER BY message_turn, seq) AS k FROM facts WHERE topic_label <> 'general'",
    "folded_facts": """SELECT *, true AS filed, content AS now_value, speaker AS now_speaker FROM ordered WHERE k = 1
  UNION ALL SELECT * EXCLUDE (v, s, ok), ok, CASE WHEN ok THEN content ELSE v END, CASE WHEN ok THEN speaker ELSE s END FROM (
    SELECT o.*, f.now_value AS v, f.now_speaker AS s, NOT (o.content = f.now_value OR (o.speaker = 'assistant' AND f.now_speaker = 'user')) AS ok FROM folded_facts f JOIN ordered o ON o.conv_id = f.conv_id AND o.topic_label = f.topic_label AND o.k = f.k + 1)""",
    "filed": """SELECT conv_id, message_turn, seq, topic_label, content, knowledge_type, speaker, content AS norm, CASE WHEN lead(content) OVER (PARTITION BY conv_id, topic_label ORDER BY message_turn, seq) IS NULL THEN 'active' ELSE 'superseded' END AS knowledge_status FROM folded_facts WHERE filed
  UNION ALL SELECT conv_id, message_turn, seq, topic_label, content, knowledge_type, speaker, content, 'active' FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, content ORDER BY message_turn, seq) AS n FROM facts WHERE topic_label = 'general') WHERE n = 1""",
    "chain": """SELECT *, CASE WHEN topic_label <> 'general' THEN lead(message_turn) OVER w END AS replaced_turn, CASE WHEN topic_label <> 'general' THEN lead(content) OVER w END AS replaced_by, CASE WHEN topic_label <> 'general' THEN lead(speaker) OVER w END AS replaced_speaker FROM filed
  WINDOW w AS (PARTITION BY conv_id, topic_label ORDER BY message_turn, seq)""",
}


def signs(source: str, keys: str, text: str, tokens: str) -> str:
    """CTEs plain, signs and scores: decision and density (S1, S2) of a text.

    Letters beyond ASCII become a sign that is part of a word, since this dialect's word edges know ASCII only.
    """
    quoted = lambda pattern: re.sub(r"^\(\?\w+\)", "", pattern).replace("'", "''")
    return rf"""plain AS (SELECT {keys}, {tokens} AS n_tokens, regexp_replace({text}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '_', 'g') AS t FROM {source}),
signs AS (SELECT {keys}, n_tokens, least(len(regexp_extract_all(t, '{quoted(DECISIONS)}', 0, 'i')) / 3.0::DOUBLE, 1.0::DOUBLE) AS decision, len(regexp_extract_all(t, '{quoted(DENSE)}')) AS signals FROM plain),
scores AS (SELECT *, CASE WHEN n_tokens > 0 THEN least(signals::DOUBLE / n_tokens / 0.5::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS density FROM signs)
"""


#: What each CTE reads, in order.
READS = {name: [other for other in CTES if other != name and re.search(rf"\b(?:FROM|JOIN) {other}\b", sql)] for name, sql in CTES.items()}


def with_(*names: str) -> str:
    """WITH clauses for these CTEs and all that they read."""

    def need(name: str, seen: tuple) -> tuple:
        return seen if name in seen else (*reduce(lambda s, other: need(other, s), READS[name], seen), name)

    order = dict.fromkeys(reduce(lambda s, n: need(n, s), names, ()))
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n"
