"""Summaries of spans as tables in and out (C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import Counter, count_tokens, decision_score, density_score, escape_delimiters, split_sentences

RATIO, LEAST, WORDS_A_TOKEN, MARKER_TOKENS = 0.35, 64, 0.75, 6


def worth_compacting(run: Column, marker: Column | int = MARKER_TOKENS, ratio: float = RATIO) -> Column:
    """C1."""
    return run > F.lit(marker) / (1 - ratio) if isinstance(marker, int) else run > marker / (1 - ratio)


def summary_target(run: Column, marker: int = MARKER_TOKENS, ratio: float = RATIO, least: int = LEAST) -> Column:
    """C2 in tokens."""
    return F.least(F.greatest(F.lit(least), F.floor(run * ratio)), run - marker - 1).cast("long")


def transcript(turns: DataFrame) -> DataFrame:
    """conv_id, span_no, transcript: a `[turn N] speaker: text` line for each part of each turn."""
    line = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("[turn "), F.col("turn_index").cast("string"), F.lit("] "), F.when(p.writer == "speaker", F.col("speaker")).otherwise(p.writer), F.lit(": "), escape_delimiters(p.text))), "\n")
    lines = F.array_sort(F.collect_list(F.struct("turn_index", line.alias("line"))))
    return turns.groupBy("conv_id", "span_no").agg(F.concat(F.lit("<transcript>\n"), F.array_join(F.transform(lines, lambda r: r.line), "\n"), F.lit("\n</transcript>")).alias("transcript"))


def summary_requests(spans: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The spans that a summary is wanted of, with transcript, target words and the cap on the answer."""
    out = spans.filter(worth_compacting(F.col("tokens"))).join(transcripts, ["conv_id", "span_no"])
    target = summary_target(F.col("tokens"))
    return out.select("conv_id", "span_no", "tokens", target.alias("target_tokens"), F.floor(target * WORDS_A_TOKEN).alias("target_words"), "transcript")


def admit_summaries(candidates: DataFrame, spans: DataFrame, marker: int = MARKER_TOKENS, counter: Counter = count_tokens) -> DataFrame:
    """C4: candidates (conv_id, span_no, text, stop_reason) with tokens and status: accepted or the reason it is refused."""
    tokens = counter(F.trim("text")) + marker
    both = candidates.join(spans.select("conv_id", "span_no", F.col("tokens").alias("run")), ["conv_id", "span_no"]).withColumn("summary_tokens", tokens)
    status = F.when(~worth_compacting(F.col("run"), marker), "too_small").when(F.col("stop_reason") != "end_turn", "incomplete").when(F.trim("text") == "", "empty").when(F.col("summary_tokens") >= F.col("run"), "not_shorter").otherwise("accepted")
    return both.withColumn("status", status).drop("run")


def concat_summary(turns: DataFrame) -> DataFrame:
    """The marker and the turns joined by spaces; never shorter than the turns."""
    rows = F.array_sort(F.collect_list(F.struct("turn_index", "content")))
    marker = F.concat(F.lit("[Summary of turns "), F.min("turn_index").cast("string"), F.lit("-"), F.max("turn_index").cast("string"), F.lit("]"))
    return turns.groupBy("conv_id", "span_no").agg(F.concat_ws(" ", marker, F.array_join(F.transform(rows, lambda r: r.content), " ")).alias("summary_text"))


def extractive_summary(spans: DataFrame, counter: Counter = count_tokens) -> DataFrame:
    """The best sentences of a span by decision and density, in order, up to the target; a stand-in that needs no model."""
    each = spans.filter(worth_compacting(F.col("tokens"))).select("conv_id", "span_no", "tokens", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))
    n = counter(F.col("sentence"))
    each = each.withColumn("n", n).withColumn("s", F.round(decision_score(F.col("sentence")) + density_score(F.col("sentence"), n), 6))
    best = Window.partitionBy("conv_id", "span_no").orderBy(F.desc("s"), "pos")
    kept = each.withColumn("sum", F.sum("n").over(best)).filter(F.col("sum") <= summary_target(F.col("tokens")))
    rows = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
    return kept.groupBy("conv_id", "span_no").agg(F.array_join(F.transform(rows, lambda r: r.sentence), " ").alias("summary_text"), F.sum("n").alias("summary_tokens"))
