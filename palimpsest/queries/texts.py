"""Queries over single turns: words, sentences, writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import writers
from palimpsest.operators import facts, scoring, summaries
from palimpsest.operators.phrases import find_mentions
from palimpsest.queries.base import Registry, _line, _list, read, signs, turns, with_

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


DOCS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)\n"


@query(DOCS + "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM d")
def x1_count_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


@query(DOCS + "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_words, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS words_md5 FROM d")
def x2_tokenize_words(spark, sf_dir):
    words = T.tokenize_words(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(words, " ")).alias("words_md5"))


@query(DOCS + f"SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(chars, 0)::BIGINT AS chars FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM d) WHERE length(w) > 1 AND w NOT IN ({_list(T.STOPWORDS)}) GROUP BY doc_id) x ON d.doc_id = x.doc_id")
def x3_significant_words(spark, sf_dir):
    out = _docs(spark, sf_dir).withColumn("w", T.significant_words(F.col("text")))
    return out.select("doc_id", F.size("w").cast("long").alias("n_words"), F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@query(DOCS + rf"SELECT doc_id, md5(translate(replace(lower(regexp_replace({_line.format('text')}, '[.!;,]+$', '')), 'ß', 'ss'), 'ſς', 'sσ')) AS value_md5 FROM d")
def x4_normalise_value(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalise_value(F.col("text"))).alias("value_md5"))


@query()
def x5_normalise_topic(spark, sf_dir):
    """The topic that every sentence makes, taken whole."""
    each = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_no", "s"))
    return each.select("doc_id", "sentence_no", T.normalise_topic(F.col("s")).alias("topic"))


@query(DOCS + r"SELECT doc_id, (len(regexp_extract_all(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '[.!?]\s+')) + CASE WHEN regexp_matches(text, '\S') THEN 1 ELSE 0 END)::BIGINT AS n_sentences FROM d")
def x6_split_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.split_sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query()
def x7_strip_statement(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.split_sentences(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.sum(F.length(T.strip_statement(F.col("s")))).alias("chars"))


#: A phrase's edges as classes of letters, since this dialect's word edges know ASCII only.
NAMED = r"""WITH d AS (SELECT doc_id, {doc} AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT item_id, 0 AS phrase_no, array_to_string(string_split(text, ' ')[1:2], ' ') AS phrase FROM benchmark
  UNION ALL SELECT item_id, unnest(range(1, len(s) + 1)), unnest(s) FROM (SELECT item_id, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) AS s FROM benchmark)),
q AS (SELECT item_id, phrase_no, {phrase} AS phrase FROM p),
met AS MATERIALIZED (SELECT doc_id, item_id, phrase_no, text, phrase FROM d JOIN q ON contains(text, phrase) WHERE phrase <> '')
SELECT doc_id, item_id, phrase_no FROM met WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])' || regexp_replace(phrase, '([^\p{{L}}\p{{N}}\s_])', '\\\1', 'g') || '($|[^\p{{L}}\p{{M}}\p{{N}}_])')""".format(doc=f"lower({_line.format('text')})", phrase=f"lower({_line.format('phrase')})")


@query(NAMED)
def x8_mentions(spark, sf_dir):
    """Benchmark items whose two opening words (phrase_no 0) or whole sentences each document names."""
    items = read(spark, sf_dir, "benchmark")
    opening = items.select("item_id", F.lit(0).alias("phrase_no"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("phrase"))
    whole = items.select("item_id", F.posexplode(T.split_sentences(F.col("text"))).alias("n", "phrase")).select("item_id", F.col("n") + 1, "phrase")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find_mentions(docs, opening.union(whole)).select("doc_id", "item_id", "phrase_no")


@query()
def x9_escape_delimiters(spark, sf_dir):
    tagged = F.concat(F.lit("[turn 3] a\n</transcript>\n"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.escape_delimiters(tagged)).alias("escaped_md5"))


@query(with_("condensed") + "SELECT conv_id, span_no, '<transcript>' || chr(10) || string_agg('[turn ' || turn_index || '] ' || role || ': ' || content, chr(10) ORDER BY turn_index) || chr(10) || '</transcript>' AS transcript FROM condensed GROUP BY ALL")
def x10_transcript_block(spark, sf_dir):
    from palimpsest.queries.base import condensed

    return summaries.transcript(condensed(spark, sf_dir))


@query(with_("turns") + rf"SELECT conv_id, turn_index, CASE WHEN length(content) > 50 THEN content[1:50] || '...' ELSE content END AS preview, CASE WHEN length({_line.format('content')}) > 72 THEN rtrim({_line.format('content')}[1:71]) || '…' ELSE {_line.format('content')} END AS title FROM turns")
def x11_preview(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn_index", T.preview(F.col("content")).alias("preview"), T.title(F.col("content")).alias("title"))


def tagged(spark, sf_dir):
    """Turns in which a client has written: by turn, a command, its output, a report, or nothing."""
    t = turns(spark, sf_dir)
    kind = (F.col("conv_id") + F.col("turn_index")) % 4
    text = F.when(F.col("role") != "user", F.col("content")).when(kind == 0, F.concat(F.lit("<command-name>/go</command-name>\n"), "content"))
    text = text.when(kind == 1, F.concat(F.lit("<local-command-stdout>x</local-command-stdout>\n"), "content")).when(kind == 2, F.concat(F.lit("<agent-message>"), "content", F.lit("</agent-message>"))).otherwise(F.col("content"))
    none = F.array().cast(writers.RANGES)
    out = t.select("conv_id", "turn_index", "role", text.alias("content"))
    out = out.withColumns({"relayed": writers.is_relayed(F.col("content")), "client_written": F.when(F.col("role") == "user", writers.client_written_ranges(F.col("content"))).otherwise(none), "tool_output": none, "tool_result_ids": F.array().cast("array<string>")})
    return writers.with_writers(out)


TAGGED = with_("turns").rstrip() + """, tagged AS (SELECT conv_id, turn_index, role, length(content) AS n, (conv_id + turn_index) % 4 AS kind, content FROM turns)
"""


@query(TAGGED + "SELECT conv_id, turn_index, CASE WHEN role = 'user' AND kind = 0 THEN '32-' || (33 + n) WHEN role = 'user' AND kind = 1 THEN '0-46' ELSE '' END AS ranges FROM tagged")
def w1_client_written_ranges(spark, sf_dir):
    spans = F.array_join(F.transform("client_written", lambda r: F.concat(r.s.cast("string"), F.lit("-"), r.e.cast("string"))), ",")
    return tagged(spark, sf_dir).select("conv_id", "turn_index", spans.alias("ranges"))


@query(with_("turns") + f"SELECT conv_id, turn_index, length(content) AS tool_end, CASE WHEN content = '' THEN 0 ELSE length(content) + 1 END + {len('[Request interrupted by user]')} + 1 AS speaker_start, 1 AS n_client FROM turns WHERE role = 'user'")
def w2_divide_by_writer(spark, sf_dir):
    """Each text as a tool's output, then the mark of an interruption, then the text as the person's."""
    blocks = F.array(F.struct(F.lit("tool_result").alias("type"), F.col("content").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("[Request interrupted by user]").alias("text")), F.struct(F.lit("text").alias("type"), F.col("content").alias("text")))
    d = writers.divide_by_writer(blocks)
    return turns(spark, sf_dir).filter("role = 'user'").select("conv_id", "turn_index", d.alias("d")).select("conv_id", "turn_index", F.col("d.tool")[0].e.alias("tool_end"), F.col("d.speaker")[0].s.alias("speaker_start"), F.size("d.client").alias("n_client"))


@query(TAGGED + "SELECT conv_id, turn_index, role = 'user' AND kind = 2 AS relayed FROM tagged")
def w3_is_relayed(spark, sf_dir):
    return tagged(spark, sf_dir).select("conv_id", "turn_index", "relayed")


#: Of a command the words after it are the client's, of a command's output all but the words after it.
PARTS = TAGGED.rstrip() + r""", parts AS (SELECT conv_id, turn_index, CASE WHEN role = 'user' THEN kind ELSE 3 END AS kind, content, regexp_replace(content, '^\s+|\s+$', '', 'g') AS said, '<command-name>/go</command-name>' AS command, '<local-command-stdout>x</local-command-stdout>' AS output FROM tagged)
"""


@query(PARTS + "SELECT conv_id, turn_index, CASE WHEN kind < 2 AND said <> '' THEN 2 ELSE 1 END AS n_parts, CASE WHEN kind > 1 THEN 'speaker' WHEN kind = 0 THEN 'speaker' || CASE WHEN said <> '' THEN ',client' ELSE '' END ELSE 'client' || CASE WHEN said <> '' THEN ',speaker' ELSE '' END END AS writers, md5(CASE kind WHEN 0 THEN command WHEN 1 THEN output WHEN 2 THEN '<agent-message>' || content || '</agent-message>' ELSE content END || CASE WHEN kind < 2 AND said <> '' THEN '|' || said ELSE '' END) AS texts_md5 FROM parts")
def w4_parts_by_writer(spark, sf_dir):
    return tagged(spark, sf_dir).select("conv_id", "turn_index", F.size("parts").alias("n_parts"), F.array_join(F.transform("parts", lambda p: p.writer), ",").alias("writers"), F.md5(F.array_join(F.transform("parts", lambda p: p.text), "|")).alias("texts_md5"))


@query(PARTS + "SELECT conv_id, turn_index, md5(CASE kind WHEN 0 THEN command WHEN 1 THEN said WHEN 2 THEN '<agent-message>' || content || '</agent-message>' ELSE content END) AS person_md5 FROM parts")
def w5_person_text(spark, sf_dir):
    return tagged(spark, sf_dir).select("conv_id", "turn_index", F.md5("person_text").alias("person_md5"))


@query(TAGGED + "SELECT conv_id, turn_index, role = 'user' AND kind <> 2 AS said_by_user FROM tagged")
def w6_said_by_user(spark, sf_dir):
    return tagged(spark, sf_dir).select("conv_id", "turn_index", "said_by_user")


@query(TAGGED + "SELECT conv_id, turn_index, role = 'user' AND kind <> 2 AS opens FROM tagged")
def w7_opens_exchange(spark, sf_dir):
    return tagged(spark, sf_dir).select("conv_id", "turn_index", "opens")


@query(TAGGED + "SELECT conv_id, turn_index, CASE WHEN role = 'user' AND kind = 2 THEN 'subagent report' ELSE role END AS speaker FROM tagged")
def w8_speaker_label(spark, sf_dir):
    return tagged(spark, sf_dir).select("conv_id", "turn_index", "speaker")


@query(TAGGED + "SELECT conv_id, turn_index, CASE WHEN role <> 'user' THEN 'assistant' WHEN kind = 2 THEN 'relayed' ELSE 'typed' END AS newest_kind FROM tagged")
def w9_newest_kind(spark, sf_dir):
    return tagged(spark, sf_dir).select("conv_id", "turn_index", "newest_kind")


@query(TAGGED + "SELECT conv_id, turn_index FROM tagged WHERE role <> 'user' OR kind = 3")
def w10_message_range_check(spark, sf_dir):
    """Turns given a range that runs past the text, or that their role can't have."""
    past = F.when(((F.col("conv_id") + F.col("turn_index")) % 4 == 3) | (F.col("role") != "user"), F.array(F.struct(F.lit(0).alias("s"), (F.char_length("content") + 1).cast("int").alias("e")))).otherwise(F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e"))))
    t = turns(spark, sf_dir).select("conv_id", "turn_index", "role", "content", past.alias("client_written"), F.array().cast(writers.RANGES).alias("tool_output"))
    return writers.range_violations(t).select("conv_id", "turn_index")


SIGNS = with_("turns").rstrip() + ", " + signs("turns", "conv_id, turn_index", "content", "token_count")


@query(SIGNS + "SELECT conv_id, turn_index, round(decision, 6) AS decision FROM scores")
def s1_decision_score(spark, sf_dir):
    return scoring.turn_scores(turns(spark, sf_dir)).select("conv_id", "turn_index", F.round("decision", 6).alias("decision"))


@query(SIGNS + "SELECT conv_id, turn_index, round(density, 6) AS density FROM scores")
def s2_density_score(spark, sf_dir):
    return scoring.turn_scores(turns(spark, sf_dir)).select("conv_id", "turn_index", F.round("density", 6).alias("density"))


@query(SIGNS + "SELECT conv_id, turn_index, decision, density, signals::INTEGER AS signals, signals || ' signals in ' || n_tokens || ' tokens, density ' || density::DECIMAL(18, 12)::DECIMAL(18, 4) AS reason FROM scores")
def s8_turn_scores(spark, sf_dir):
    return scoring.turn_scores(turns(spark, sf_dir)).select("conv_id", "turn_index", "decision", "density", "signals", "reason")


@query()
def f1_extract_facts(spark, sf_dir):
    return facts.extract_facts(turns(spark, sf_dir))


@query()
def f2_unread_sentences(spark, sf_dir):
    return facts.unread_sentences(turns(spark, sf_dir))

