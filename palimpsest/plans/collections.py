"""Applying collections, and when a changed prompt pays (D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.plans.levels import COMPACTED, KEPT, level_name


def conv():
    return Window.partitionBy("conv_id")


def apply_collection(young: DataFrame, old: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Young turns and old spans after a delta (conv_id, span_no, level, turn_indices, is_new), and its violations.

    New spans take their turns out of the young; a changed level replaces the span's. A violation is a turn of a new span
    that isn't young, a turn in two new spans, or a level for a span that isn't there.
    """
    moved = delta.filter("is_new").select("conv_id", "span_no", "level", "turn_indices", F.explode("turn_indices").alias("turn_index"))
    left = young.join(moved.select("conv_id", "turn_index"), ["conv_id", "turn_index"], "left_anti")
    changed = delta.filter("not is_new").select("conv_id", "span_no", F.col("level").alias("to"))
    kept = old.join(changed, ["conv_id", "span_no"], "left").withColumn("level", F.coalesce("to", "level")).drop("to")
    spans = kept.unionByName(delta.filter("is_new").select("conv_id", "span_no", "level", "turn_indices"))
    unknown = moved.join(young, ["conv_id", "turn_index"], "left_anti").select("conv_id", "turn_index", F.lit("not_young").alias("violation"))
    twice = moved.groupBy("conv_id", "turn_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv_id", "turn_index", F.lit("two_spans").alias("violation"))
    absent = changed.join(old, ["conv_id", "span_no"], "left_anti").select("conv_id", F.col("span_no").alias("turn_index"), F.lit("no_span").alias("violation"))
    return left, spans, unknown.unionByName(twice).unionByName(absent)


def still_oldest(prepared: DataFrame, young: DataFrame) -> DataFrame:
    """Prepared rows (conv_id, pos, hash) before the first that differs from the young turn at its place."""
    both = prepared.join(young.select("conv_id", "pos", F.col("hash").alias("now")), ["conv_id", "pos"], "left")
    bad = F.min(F.when(~F.col("hash").eqNullSafe(F.col("now")), F.col("pos"))).over(conv())
    return both.withColumn("bad", bad).filter(F.col("bad").isNull() | (F.col("pos") < F.col("bad"))).select("conv_id", "pos", "hash")


def switch_measures(plan: DataFrame, window_tokens: int, stale_ratio: float = 0.1) -> DataFrame:
    """D3: conv_id, saving, rewritten, stale, bound, thinking and attachments dropped. plan: tokens, level_tokens, level, thinking_tokens, attachment_tokens."""
    lower = F.col("level") < KEPT
    when = lambda c: F.sum(F.when(lower, F.col(c)).otherwise(0))
    return plan.groupBy("conv_id").agg((F.sum("tokens") - F.sum("level_tokens")).alias("saving_tokens"), F.sum("level_tokens").alias("rewritten_tokens"), when("tokens").alias("stale_tokens"), F.lit(int(stale_ratio * window_tokens)).cast("long").alias("stale_bound_tokens"), when("thinking_tokens").alias("thinking_dropped"), when("attachment_tokens").alias("attachments_dropped"))


#: D4's rules as expressions over the measures, in order: reason, condition, whether to switch.
SWITCH_RULES = (
    ("invalid", "least(rewritten_tokens, stale_tokens, stale_bound_tokens, min_saving_share) < 0", False),
    ("tool_round_open", "tool_round_open", False),
    ("no_saving", "saving_tokens <= 0", False),
    ("requested", "requested", True),
    ("cache_cold", "cache = 'cold'", True),
    ("repays_rewrite", "saving_tokens >= min_saving_share * rewritten_tokens", True),
    ("stale_weight_at_bound", "stale_tokens >= stale_bound_tokens", True),
)
WAITING = "waiting_for_payback"
SWITCH_REASON = "CASE " + " ".join(f"WHEN {holds} THEN '{name}'" for name, holds, _ in SWITCH_RULES) + f" ELSE '{WAITING}' END"
SWITCHES = "CASE " + " ".join(f"WHEN {holds} THEN {yes}" for _, holds, yes in SWITCH_RULES) + " ELSE false END"
MEASURES = "saving_tokens BIGINT, rewritten_tokens BIGINT, stale_tokens BIGINT, stale_bound_tokens BIGINT, min_saving_share DOUBLE, cache STRING, requested BOOLEAN, tool_round_open BOOLEAN"


def register_switch(spark: SparkSession) -> None:
    """D4 as functions for SQL, over the measures in the order of MEASURES: switch_reason(...) and decide_switch(...)."""
    for name, kind, body in (("switch_reason", "STRING", SWITCH_REASON), ("decide_switch", "BOOLEAN", SWITCHES)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({MEASURES}) RETURNS {kind} RETURN {body}")


def decide_switch(m: DataFrame) -> DataFrame:
    """M (saving_tokens, rewritten_tokens, stale_tokens, stale_bound_tokens, min_saving_share, cache, requested, tool_round_open)
    with switch and reason; the first rule that holds decides. Negative measures give reason `invalid`."""
    return m.withColumns({"switch": F.expr(SWITCHES), "reason": F.expr(SWITCH_REASON)})


def switch_result(before: DataFrame, after: DataFrame) -> DataFrame:
    """conv_id with spans and tokens by level after a collection, tokens before and after, and the saving."""
    by_level = [F.count_if(F.col("level") == k).alias(f"n_{n}") for k, n in enumerate(("folded", "archived", "compacted", "kept"))]
    out = after.groupBy("conv_id").agg(*by_level, F.sum("level_tokens").alias("tokens_after"))
    return out.join(before.groupBy("conv_id").agg(F.sum("token_count").alias("tokens_before")), "conv_id").withColumn("tokens_saved", F.col("tokens_before") - F.col("tokens_after"))


def collection_events(plan: DataFrame, facts: DataFrame) -> DataFrame:
    """event_type, conv_id, subject, detail: promoted and archived spans, facts added and superseded; names turns, never words."""
    span = lambda kind, ok: plan.filter(ok).select(F.lit(kind).alias("event_type"), "conv_id", F.col("first_turn").alias("subject"), level_name(F.col("level")).alias("detail"))
    fact = lambda kind, df: df.select(F.lit(kind).alias("event_type"), "conv_id", F.col("message_turn").alias("subject"), F.col("knowledge_type").alias("detail"))
    return span("promoted", F.col("level") >= COMPACTED).unionByName(span("archived", F.col("level") < COMPACTED)).unionByName(fact("fact_added", facts)).unionByName(fact("fact_superseded", facts.filter("knowledge_status = 'superseded'")))


def degradations(summaries: DataFrame, unread: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, reason, first_turn: refused summaries, failed fact reads, recaps over budget."""
    refused = summaries.filter("status <> 'accepted' and status <> 'too_small'").select("conv_id", F.concat(F.lit("summary_"), F.col("status")).alias("reason"), F.col("span_no").alias("place"))
    failed = unread.filter("facts_unread").select("conv_id", F.lit("facts_unread").alias("reason"), F.col("span_no").alias("place"))
    over = plans.filter("over_budget").select("conv_id", F.lit("recap_over_budget").alias("reason"), F.lit(None).cast("long").alias("place"))
    return refused.unionByName(failed).unionByName(over)


#: Errors that only a person can mend.
LASTING = ("authentication", "permission", "invalid_request", "quota")


def lasting_failures(calls: DataFrame) -> DataFrame:
    """Passes in which every own call failed for a lasting reason. calls: pass_id, ok, error."""
    return calls.groupBy("pass_id").agg(F.bool_and(~F.col("ok") & F.coalesce(F.col("error").isin(*LASTING), F.lit(False))).alias("all"), F.count(F.lit(1)).alias("calls")).filter("all").drop("all")
