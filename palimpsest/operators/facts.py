"""Facts: extraction, checks, and which fact replaces which (F)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import GENERAL, normalise_topic, normalise_value, split_sentences, strip_statement

# Fixed values: (kind, pattern, group of the topic, group of the content), in order; the first of a kind that fits counts.
TOPIC = r"(\w+(?:[\s-]+\w+){0,3})"
PATTERNS = (
    ("fact", rf"(?iU)^(?:the\s+)?{TOPIC}\s+(?:is|are)\s+(.+)", 1, 2),
    ("fact", rf"(?iU)(?:we(?:'re|\s+are)\s+)?using\s+(\w+)\s+for\s+{TOPIC}", 2, 1),
    ("fact", rf"(?iU)^{TOPIC}\s+runs?\s+on\s+(.+)", 1, 2),
    ("decision", rf"(?iU)(?:we\s+)?decided\s+to\s+(.+?)(?:\s+for\s+{TOPIC})?$", 2, 1),
    ("decision", rf"(?iU)let(?:'s|\s+us)\s+go\s+with\s+(.+?)(?:\s+for\s+{TOPIC})?$", 2, 1),
    ("decision", rf"(?iU)(?:we\s+)?chose\s+(.+?)\s+over\s+.+?(?:\s+for\s+{TOPIC})?$", 2, 1),
    ("preference", rf"(?iU)(?:i|we)\s+prefer\s+(.+?)(?:\s+for\s+{TOPIC})?$", 2, 1),
    ("preference", rf"(?iU)(?:i|we)(?:'d|\s+would)\s+rather\s+(?:use\s+)?(.+?)(?:\s+for\s+{TOPIC})?$", 2, 1),
)
COMPOUND = r"(?iU),|;|\band\b|\bfor\b"
LEAST_CHARS = 3
FACT = "struct<topic_label:string,content:string,knowledge_type:string>"
TOPIC_WORDS, TOPIC_CHARS, VALUE_CHARS = 5, 60, 200


def _found(statement: Column, kind: str, pattern: str, topic: int, content: int) -> Column:
    """The fact that one pattern finds in a statement, or null."""
    fits = F.regexp_like(statement, F.lit(pattern))
    value = F.trim(F.regexp_extract(statement, pattern, content))
    raw = F.nullif(F.regexp_extract(statement, pattern, topic), F.lit(""))
    label = normalise_topic(raw)
    label = F.when(label.isNotNull() & F.lit(topic > content) & raw.isNotNull() & value.rlike(COMPOUND), GENERAL).otherwise(label)
    ok = fits & (F.char_length(value) >= LEAST_CHARS) & label.isNotNull()
    return F.when(ok, F.struct(label.alias("topic_label"), value.alias("content"), F.lit(kind).alias("knowledge_type"))).otherwise(F.lit(None).cast(FACT))


def facts_in(statement: Column) -> Column:
    """At most one fact of each kind."""
    kinds = dict.fromkeys(p[0] for p in PATTERNS)
    return F.filter(F.array(*(F.coalesce(*(_found(statement, *p) for p in PATTERNS if p[0] == kind)) for kind in kinds)), lambda x: x.isNotNull())


def sentences(turns: DataFrame) -> DataFrame:
    """Sentences of the person's words with the statement in each: conv_id, message_turn, sentence_no, sentence, statement, speaker."""
    split = turns.filter("said_by_user").select("conv_id", F.col("turn_index").alias("message_turn"), F.col("role").alias("speaker"), F.posexplode(split_sentences(F.col("person_text"))).alias("sentence_no", "sentence"))
    return split.withColumn("statement", strip_statement(F.col("sentence"))).filter("statement <> ''")


def extract_facts(turns: DataFrame) -> DataFrame:
    """conv_id, message_turn, seq, topic_label, content, knowledge_type, speaker; questions state nothing."""
    read = sentences(turns).filter(~F.col("sentence").endswith("?"))
    found = read.select("conv_id", "message_turn", "sentence_no", "speaker", F.posexplode(facts_in(F.col("statement"))).alias("k", "f"))
    order = Window.partitionBy("conv_id", "message_turn").orderBy("sentence_no", "k")
    return found.select("conv_id", "message_turn", (F.row_number().over(order) - 1).cast("long").alias("seq"), "f.*", "speaker")


def unread_sentences(turns: DataFrame) -> DataFrame:
    """conv_id, message_turn, unread: the sentences that yielded no fact, as written."""
    nothing = F.col("sentence").endswith("?") | (F.size(facts_in(F.col("statement"))) == 0)
    left = F.array_sort(F.collect_list(F.when(nothing, F.struct("sentence_no", "sentence"))))
    return sentences(turns).groupBy("conv_id", "message_turn").agg(F.array_join(F.transform(left, lambda r: r.sentence), " ").alias("unread"))


def validate_model_facts(answers: DataFrame, turns: DataFrame) -> DataFrame:
    """answers (conv_id, text) with a JSON object of facts, and turns (conv_id, turn_index, speaker) to valid facts.

    Read from the first brace to the last; text that doesn't parse yields nothing. The speaker comes from the turn.
    """
    shape = "struct<facts:array<struct<turn:bigint,topic:string,value:string,kind:string>>>"
    body = F.regexp_extract("text", r"(?s)\{.*\}", 0)
    read = answers.select("conv_id", F.posexplode(F.from_json(body, shape).getField("facts")).alias("place", "f")).select("conv_id", "place", "f.*")
    topic, value = F.trim(F.regexp_replace("topic", r"(?U)\s+", " ")), F.trim("value")
    ok = (topic != "") & (value != "") & (F.size(F.split(topic, " ")) <= TOPIC_WORDS) & (F.char_length(topic) <= TOPIC_CHARS) & (F.char_length(value) <= VALUE_CHARS)
    kind = F.when(F.col("kind").isin("fact", "decision", "preference"), F.col("kind")).otherwise("fact")
    facts = read.filter(ok).join(turns.select("conv_id", F.col("turn_index").alias("turn"), "speaker"), ["conv_id", "turn"])
    order = Window.partitionBy("conv_id", "turn").orderBy("place")
    return facts.select("conv_id", F.col("turn").alias("message_turn"), (F.row_number().over(order) - 1).cast("long").alias("seq"), F.lower(topic).alias("topic_label"), value.alias("content"), kind.alias("knowledge_type"), "speaker")


def fact_batches(spans: DataFrame, max_tokens: int = 8000) -> DataFrame:
    """spans (conv_id, span_no, tokens) with batch_no: packed in order, never past max_tokens, a span never divided.

    A conversation's spans pass through one task in order, none kept, so the time is in proportion to their number.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, no, size = None, 0, 0
        for batch in batches:
            out = []
            for conv_id, tokens in zip(batch.column("conv_id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if of != (conv_id,):
                    of, no, size = (conv_id,), 0, 0
                if size > 0 and size + tokens > max_tokens:
                    no, size = no + 1, 0
                size += tokens
                out.append(no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "batch_no"])

    rows = spans.select("conv_id", F.col("span_no").cast("long").alias("span_no"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    shape = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, span_no long, tokens long, batch_no long"
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "span_no").mapInArrow(pack, shape)


ORDER = ("message_turn", "seq")


def by_topic():
    return Window.partitionBy("conv_id", "topic_label").orderBy(*ORDER)


def file_facts(facts: DataFrame) -> DataFrame:
    """the facts that are filed, with norm and knowledge_status (active or superseded).

    On a topic a fact is dropped that restates the value in force, and so is the assistant's once the user has changed the
    value. General facts supersede nothing; equal ones are one. Speakers must be known (see fold_facts).
    """
    known = facts.withColumn("norm", normalise_value(F.col("content")))
    changed = (F.col("speaker") == "user") & (F.lag("norm").over(by_topic()).isNull() | (F.col("norm") != F.lag("norm").over(by_topic())))
    known = known.withColumn("__changed", changed)
    earlier = by_topic().rowsBetween(Window.unboundedPreceding, -1)
    by_user = F.coalesce(F.max("__changed").over(earlier), F.lit(False))
    topical = known.filter(F.col("topic_label") != GENERAL).withColumn("__user", by_user).filter(~(F.col("__user") & (F.col("speaker") == "assistant")))
    topical = topical.withColumn("__prev", F.lag("norm").over(by_topic())).filter(F.col("__prev").isNull() | (F.col("__prev") != F.col("norm")))
    status = F.when(F.lead("norm").over(by_topic()).isNotNull(), "superseded").otherwise("active")
    topical = topical.withColumn("knowledge_status", status).drop("__changed", "__user", "__prev")
    first = F.row_number().over(Window.partitionBy("conv_id", "norm").orderBy(*ORDER))
    general = known.filter(F.col("topic_label") == GENERAL).withColumn("__n", first).filter("__n = 1").drop("__n", "__changed").withColumn("knowledge_status", F.lit("active"))
    return topical.unionByName(general)


def _with_record(facts: DataFrame, record: DataFrame | None) -> DataFrame:
    """Late facts and facts on record, with filed, norm and g: the topic, or the value of a general fact."""
    both = facts.withColumn("filed", F.lit(False))
    if record is not None:
        both = both.unionByName(record.select(*facts.columns).withColumn("filed", F.lit(True)))
    both = both.withColumn("norm", normalise_value(F.col("content")))
    return both.withColumn("g", F.when(F.col("topic_label") == GENERAL, F.concat(F.lit("\0"), "norm")).otherwise(F.col("topic_label")))


def _with_status(kept: DataFrame) -> DataFrame:
    later = F.lead(F.lit(True)).over(Window.partitionBy("conv_id", "g").orderBy(*IN_RECORD)).isNotNull()
    status = F.when(later & (F.col("topic_label") != GENERAL), "superseded").otherwise("active")
    return kept.select("conv_id", "message_turn", "seq", "topic_label", "content", "knowledge_type", "speaker", "norm", status.alias("knowledge_status"))


#: Of facts at one place, the late one comes first.
IN_RECORD = (*ORDER, "filed", "topic_label", "content", "knowledge_type", "speaker")


def fold_facts(facts: DataFrame, record: DataFrame | None = None) -> DataFrame:
    """F5 and F8 one fact after the other, for facts without a speaker and for facts that arrive late.

    record: facts filed already, which stay filed. A late fact takes its place by turn: it is measured against the value in
    force at its turn. A topic's facts pass through one task in order and none is kept, so the time is in proportion to their number.
    """

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, norm, speaker = None, None, None
        for batch in batches:
            keep = []
            for *group, filed, value, by in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "g", "filed", "norm", "speaker")), strict=True):
                first = of != group
                skip = not first and not filed and (value == norm is not None or (by == "assistant" and speaker == "user"))
                if not skip:
                    of, norm, speaker = group, value, by
                keep.append(not skip)
            yield batch.filter(pa.array(keep, pa.bool_()))

    both = _with_record(facts, record)
    kept = both.repartition("conv_id", "g").sortWithinPartitions("conv_id", "g", *IN_RECORD).mapInArrow(file, both.schema)
    return _with_status(kept)


def late_facts(facts: DataFrame, record: DataFrame) -> DataFrame:
    """F8 by windows: the record with the late facts that are filed, each measured against the value in force at its turn.

    A fact on record stays and sets the value in force for those up to the next one on record; within such a stretch late
    facts go as in file_facts. Speakers must be known (else fold_facts). One shuffle by topic.
    """
    topic = Window.partitionBy("conv_id", "g").orderBy(*IN_RECORD)
    rows = _with_record(facts, record).withColumn("__part", F.count_if("filed").over(topic.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = Window.partitionBy("conv_id", "g", "__part").orderBy(*IN_RECORD)
    before = F.lag("norm").over(stretch)
    rows = rows.withColumn("__changed", (F.col("speaker") == "user") & (F.col("filed") | ~F.coalesce(before == F.col("norm"), F.lit(False))))
    by_user = F.coalesce(F.max("__changed").over(stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("__user", by_user).filter(~(F.col("__user") & (F.col("speaker") == "assistant")))
    rows = rows.withColumn("__same", F.coalesce(before == F.col("norm"), F.lit(False))).filter(F.col("filed") | ~F.col("__same"))
    return _with_status(rows)


def supersession_chain(filed: DataFrame) -> DataFrame:
    """filed facts with the turn, content and speaker of the fact that replaced each; null for general facts."""
    after = F.lead(F.struct("message_turn", "content", "speaker")).over(by_topic())
    replaced = F.when(F.col("topic_label") != GENERAL, after)
    return filed.withColumn("__r", replaced).withColumns({"replaced_turn": F.col("__r.message_turn"), "replaced_by": F.col("__r.content"), "replaced_speaker": F.col("__r.speaker")}).drop("__r")


def unread_spans(spans: DataFrame, failed: DataFrame, answered: DataFrame) -> DataFrame:
    """spans with facts_unread: their reading failed and none has succeeded since. Both by (conv_id, span_no, pass_no)."""
    bad = failed.groupBy("conv_id", "span_no").agg(F.max("pass_no").alias("failed_at"))
    good = answered.groupBy("conv_id", "span_no").agg(F.max("pass_no").alias("read_at"))
    both = spans.join(bad, ["conv_id", "span_no"], "left").join(good, ["conv_id", "span_no"], "left")
    return both.withColumn("facts_unread", F.col("failed_at").isNotNull() & (F.coalesce("read_at", F.lit(-1)) < F.col("failed_at"))).drop("failed_at", "read_at")


def active_facts(filed: DataFrame, as_of: int | None = None) -> DataFrame:
    """the facts in force, or those in force at a turn."""
    seen = filed if as_of is None else filed.filter(F.col("message_turn") <= as_of)
    last = F.row_number().over(Window.partitionBy("conv_id", "topic_label").orderBy(*(F.desc(c) for c in ORDER)))
    return seen.withColumn("__n", last).filter((F.col("__n") == 1) | (F.col("topic_label") == GENERAL)).drop("__n", "knowledge_status")


def supersessions(filed: DataFrame) -> DataFrame:
    """each filed fact that replaced another, with what it replaced."""
    before = F.lag(F.struct("message_turn", "content")).over(by_topic())
    out = filed.withColumn("__o", F.when(F.col("topic_label") != GENERAL, before)).filter("__o is not null")
    return out.select("conv_id", "topic_label", "message_turn", "seq", "content", F.col("__o.message_turn").alias("old_turn"), F.col("__o.content").alias("old_content"))
