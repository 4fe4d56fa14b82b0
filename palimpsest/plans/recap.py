"""Rendering the recap and assembling what is sent (R)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import GENERAL, Counter, count_tokens
from palimpsest.operators.facts import supersession_chain
from palimpsest.plans.levels import ARCHIVED, COMPACTED, KEPT, OUT

# How each level's text begins, and what stands above the recap.
QUOTED, SUMMARISED, ARCHIVED_AT, FOLDED = "[Quoted exactly]", "[Summarised]", "[Archived]", "[Out of view]"
HEADER = "[Earlier turns, condensed: quoted exactly, summarised, archived to an opening line and its facts, or out of view. If a detail you need is not shown, say so rather than guess.]\n\n[Earlier conversation, in order]\n"


def conv():
    return Window.partitionBy("conv_id")


def turns_named(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("turn "), first.cast("string"))).otherwise(F.concat(F.lit("turns "), first.cast("string"), F.lit("–"), last.cast("string")))


def stated(topic: Column, content: Column) -> Column:
    return F.when(topic == GENERAL, content).otherwise(F.concat(topic, F.lit(": "), content))


def annotate_spans(turns: DataFrame, filed: DataFrame) -> DataFrame:
    """conv_id, span_no, facts (statements in force) and notes on facts of the span that were replaced later."""
    chain = supersession_chain(filed).join(turns.select("conv_id", F.col("turn_index").alias("message_turn"), "span_no"), ["conv_id", "message_turn"])
    fact = stated(F.col("topic_label"), F.col("content"))
    new = stated(F.col("topic_label"), F.col("replaced_by"))
    note = F.concat(F.lit("↳ Replaced later (turn "), F.col("replaced_turn").cast("string"), F.lit("): "), new, F.lit(", not "), F.col("content"), F.lit("."))
    row = lambda ok, text: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("message_turn", "seq", text.alias("x"))))), lambda r: r.x)
    active = F.col("replaced_turn").isNull()
    return chain.groupBy("conv_id", "span_no").agg(row(active, fact).alias("facts"), row(~active, note).alias("notes"))


def span_texts(spans: DataFrame, turns: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """R1 at every level: spans with kept_text, compacted_text (null without summary_text) and archived_text.

    spans: conv_id, span_no, first_turn, last_turn, index_line, summary_text. turns: conv_id, span_no, turn_index, speaker, content.
    """
    quote = F.concat(F.lit(QUOTED + " (turn "), F.col("turn_index").cast("string"), F.lit(", "), F.col("speaker"), F.lit(") "), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("turn_index", quote.alias("line"))))
    quoted = turns.groupBy("conv_id", "span_no").agg(F.transform(rows, lambda r: r.line).alias("quotes"))
    out = spans.join(quoted, ["conv_id", "span_no"])
    if notes is None:
        out = out.withColumns({"facts": F.array().cast("array<string>"), "notes": F.array().cast("array<string>")})
    else:
        out = out.join(notes, ["conv_id", "span_no"], "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("facts", "notes")})
    heading = lambda prefix: F.array_join(F.concat(F.array(F.rtrim(F.concat(F.lit(prefix + " ("), turns_named(F.col("first_turn"), F.col("last_turn")), F.lit(") "), F.col("index_line")))), F.col("facts")), " · ")
    lines = lambda first: F.array_join(F.concat(first, F.col("notes")), "\n")
    compacted = F.when(F.col("summary_text").isNotNull(), lines(F.array(heading(SUMMARISED), F.col("summary_text"))))
    return out.withColumns({"kept_text": lines(F.col("quotes")), "compacted_text": compacted, "archived_text": lines(F.array(heading(ARCHIVED_AT)))}).drop("quotes", "facts", "notes")


def level_costs(texts: DataFrame, counter: Counter = count_tokens) -> DataFrame:
    """Tokens of each span at each level."""
    return texts.withColumns({f"{level}_tokens": counter(F.col(f"{level}_text")) for level in ("kept", "compacted", "archived")})


def folded_lines(plan: DataFrame) -> DataFrame:
    """R2: conv_id, first_turn, last_turn, spans, line: one line for each run of spans out of view."""
    out = plan.filter(F.col("level") == OUT).withColumn("run", F.col("span_no") - F.row_number().over(conv().orderBy("span_no")))
    runs = out.groupBy("conv_id", "run").agg(F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.count(F.lit(1)).alias("spans"))
    noun = F.when(F.col("spans") == 1, "exchange").otherwise("exchanges")
    line = F.concat(F.lit(FOLDED + " ("), turns_named(F.col("first_turn"), F.col("last_turn")), F.lit(") "), F.col("spans").cast("string"), F.lit(" earlier "), noun, F.lit(", folded to stay within the budget."))
    return runs.select("conv_id", "first_turn", "last_turn", "spans", line.alias("line"))


def render_recap(plan: DataFrame, counter: Counter = count_tokens, header: str = HEADER) -> DataFrame:
    """conv_id, content, token_count from a plan with the three texts; nothing for a conversation without spans."""
    text = F.when(F.col("level") == KEPT, F.col("kept_text")).when(F.col("level") == COMPACTED, F.coalesce("compacted_text", "kept_text")).otherwise(F.col("archived_text"))
    shown = plan.filter(F.col("level") > OUT).select("conv_id", "first_turn", text.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("first_turn", "line")))
    content = F.concat(F.lit(header), F.array_join(F.transform(lines, lambda r: r.line), "\n"))
    out = shown.unionByName(folded_lines(plan).select("conv_id", "first_turn", "line")).groupBy("conv_id").agg(content.alias("content"))
    return out.withColumn("token_count", counter(F.col("content")))


def carry_instructions(instructions: DataFrame, cuts: DataFrame) -> DataFrame:
    """conv_id, instructions: distinct instructions of the condensed turns, in the order first seen."""
    own = instructions.join(cuts.select("conv_id", "cut"), "conv_id").filter(F.col("turns_before") < F.col("cut"))
    firsts = own.groupBy("conv_id", "content").agg(F.min("turn").alias("turn"))
    return firsts.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda r: r.content).alias("instructions"))


def assemble_context(recaps: DataFrame, tail: DataFrame) -> DataFrame:
    """conv_id, turn_index, role, content, token_count: the recap as turn -1, then the tail word for word."""
    front = recaps.select("conv_id", F.lit(-1).cast("long").alias("turn_index"), F.lit("user").alias("role"), "content", "token_count")
    return front.unionByName(tail.select("conv_id", "turn_index", "role", "content", "token_count"))


def forwarded_request(context: DataFrame, instructions: DataFrame) -> DataFrame:
    """The context as sent, without empty turns, each inline instruction once, after the turn it followed or the recap."""
    turns = context.filter(F.regexp_replace("content", r"\s", "") != "").select("conv_id", F.col("turn_index").cast("double").alias("place"), "role", "content")
    least = context.groupBy("conv_id").agg(F.min(F.when(F.col("turn_index") >= 0, F.col("turn_index"))).alias("first"))
    own = instructions.groupBy("conv_id", "content").agg(F.max("turns_before").alias("before")).join(least, "conv_id")
    after = F.when(F.col("before") - 1 < F.col("first"), F.lit(-0.5)).otherwise(F.col("before") - 1 + F.lit(0.5))
    both = turns.unionByName(own.select("conv_id", after.alias("place"), F.lit("system").alias("role"), "content"))
    return both.withColumn("seq", F.row_number().over(conv().orderBy("place", "content"))).drop("place")


def sent_tokens(turns: DataFrame, instructions: DataFrame, thinking_valid_from: int = 0, counter: Counter = count_tokens) -> DataFrame:
    """conv_id, text, thinking, attachments, instructions, total, estimated. turns: token_count, thinking_tokens, attachment_tokens, unsized_attachments."""
    still = F.when(F.col("turn_index") >= thinking_valid_from, F.col("thinking_tokens")).otherwise(0)
    sums = turns.groupBy("conv_id").agg(F.sum("token_count").alias("text_tokens"), F.sum(still).alias("thinking"), F.sum("attachment_tokens").alias("attachments"), F.coalesce(F.bool_or((F.col("unsized_attachments") > 0) | (F.col("thinking_tokens") > 0)), F.lit(False)).alias("estimated"))
    told = instructions.select("conv_id", "content").distinct().groupBy("conv_id").agg(F.sum(counter(F.col("content"))).alias("instruction_tokens"))
    both = sums.join(told, "conv_id", "left").withColumn("instruction_tokens", F.coalesce("instruction_tokens", F.lit(0)))
    return both.withColumn("total", F.col("text_tokens") + F.col("thinking") + F.col("attachments") + F.col("instruction_tokens"))


def carried_facts(filed: DataFrame, turns: DataFrame, plan: DataFrame) -> DataFrame:
    """Facts in force that the recap's lines carry: those of spans that are compacted or archived."""
    shown = plan.filter(F.col("level").isin(COMPACTED, ARCHIVED)).select("conv_id", "span_no")
    at = turns.select("conv_id", F.col("turn_index").alias("message_turn"), "span_no").join(shown, ["conv_id", "span_no"])
    return supersession_chain(filed).filter("replaced_turn is null").join(at, ["conv_id", "message_turn"]).select("conv_id", "message_turn", "seq", "topic_label", "content", "span_no")
