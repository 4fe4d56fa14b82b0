"""What a person looks at: health, fidelity, history (H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.levels import ARCHIVED, COMPACTED, KEPT, OUT, level_name


def conv():
    return Window.partitionBy("conv_id")


def token_budget(turns: DataFrame, window: int) -> DataFrame:
    """H1: conv_id, current_tokens, context_window, pressure, newest_turn."""
    return turns.groupBy("conv_id").agg(F.sum("token_count").alias("current_tokens"), F.lit(window).alias("context_window"), F.round(F.sum("token_count") / window, 6).alias("pressure"), F.max("turn_index").alias("newest_turn"))


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """H2: the newest n rows of each conversation."""
    return rows.withColumn("place", F.row_number().over(conv().orderBy(*(F.desc(c) for c in order)))).filter(F.col("place") <= n)


def transitions(events: DataFrame) -> DataFrame:
    """H3: events (conv_id, event_type, turns) as one row a turn with what happened to it."""
    to = F.when(F.col("event_type") == "promoted", "old").when(F.col("event_type") == "archived", "archive").otherwise("superseded")
    return events.select("conv_id", "event_type", F.explode("turns").alias("turn_index"), to.alias("moved_to"))


def gc_breakdown(passes: DataFrame) -> DataFrame:
    """H4: passes (status, levels as columns n_*, t_*) with counts and tokens that are 0 unless the pass completed."""
    names = [c for c in passes.columns if c.startswith(("n_", "t_"))]
    return passes.withColumns({c: F.when(F.col("status") == "completed", F.col(c)).otherwise(0) for c in names})


def transformation_ratio(passes: DataFrame) -> DataFrame:
    """H5: share of the tokens looked at that were condensed; null unless completed."""
    return passes.withColumn("ratio", F.when(F.col("status") == "completed", F.round(F.try_divide("condensed_tokens", "tokens_seen"), 6)))


def lifecycle(young: DataFrame, spans: DataFrame, facts: DataFrame) -> DataFrame:
    """H6: per conversation how many turns are young, spans old and facts permanent, with tokens."""
    y = young.groupBy("conv_id").agg(F.count(F.lit(1)).alias("young_turns"), F.sum("token_count").alias("young_tokens"))
    o = spans.groupBy("conv_id").agg(F.count(F.lit(1)).alias("old_spans"), F.sum("tokens").alias("old_tokens"))
    p = facts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("permanent_facts"))
    out = y.join(o, "conv_id", "full").join(p, "conv_id", "full")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "conv_id"))


def turn_fidelity(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """H7: every turn as verbatim or at its span's level, with span and score."""
    at = plan.select("conv_id", "span_no", "score", "level", F.explode("turn_indices").alias("turn_index"))
    return turns.join(at, ["conv_id", "turn_index"], "left").withColumn("fidelity", F.coalesce(level_name(F.col("level")), F.lit("verbatim"))).drop("level")


def span_states(plan: DataFrame) -> DataFrame:
    """H8: every span with the text that the recap carries and its tokens."""
    text = F.when(F.col("level") == KEPT, F.col("kept_text")).when(F.col("level") == COMPACTED, F.coalesce("compacted_text", "kept_text")).when(F.col("level") == ARCHIVED, F.col("archived_text"))
    return plan.select("conv_id", "span_no", "first_turn", "last_turn", level_name(F.col("level")).alias("fidelity"), "score", text.alias("carried"), F.coalesce(F.ceil(F.char_length(text) / 4), F.lit(0)).alias("carried_tokens"))


def fact_states(chain: DataFrame, turns: DataFrame, plan: DataFrame) -> DataFrame:
    """H9: every filed fact: its span's level, whether the model is sent it, and what replaced it. chain: as F6 gives it."""
    at = turns.select("conv_id", F.col("turn_index").alias("message_turn"), "span_no").join(plan.select("conv_id", "span_no", "level"), ["conv_id", "span_no"], "left")
    out = chain.join(at, ["conv_id", "message_turn"], "left")
    reaches = F.col("level").isNull() | (F.col("level") == KEPT) | ((F.col("level") > OUT) & F.col("replaced_turn").isNull())
    return out.withColumn("reaches_model", reaches).withColumn("fidelity", F.coalesce(level_name(F.col("level")), F.lit("verbatim"))).drop("level")


def knowledge_summary(fidelity: DataFrame, facts: DataFrame, budget: DataFrame, alarm: float = 0.8) -> DataFrame:
    """Per conversation turns by fidelity, facts that reach the model or don't, and a warning from 80 % of the window."""
    n = lambda name: F.count_if(F.col("fidelity") == name).alias(name)
    turns = fidelity.groupBy("conv_id").agg(*map(n, ("verbatim", "kept", "compacted", "archived", "out_of_view")))
    f = facts.groupBy("conv_id").agg(F.count_if("reaches_model").alias("facts_sent"), F.count_if(~F.col("reaches_model")).alias("facts_unseen"), F.count_if(F.col("replaced_turn").isNotNull()).alias("facts_replaced"))
    out = turns.join(f, "conv_id", "left").join(budget.select("conv_id", "pressure"), "conv_id", "left")
    return out.select("conv_id", "verbatim", "kept", "compacted", "archived", "out_of_view", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("facts_sent", "facts_unseen", "facts_replaced")), F.coalesce(F.col("pressure") >= alarm, F.lit(False)).alias("warn_window"))


def prompt_size_series(turns: DataFrame, sent: DataFrame) -> DataFrame:
    """At each turn the tokens written so far beside those sent. sent: conv_id, turn_index, sent_tokens."""
    written = F.sum("token_count").over(conv().orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0))
    return turns.select("conv_id", "turn_index", written.alias("written_tokens")).join(sent, ["conv_id", "turn_index"])


def quiet_runs(passes: DataFrame) -> DataFrame:
    """Consecutive passes of one status as one row: first, last, number, least and greatest duration."""
    run = F.row_number().over(conv().orderBy("pass_no")) - F.row_number().over(Window.partitionBy("conv_id", "status").orderBy("pass_no"))
    return passes.withColumn("run", run).groupBy("conv_id", "status", "run").agg(F.min("pass_no").alias("first_pass"), F.max("pass_no").alias("last_pass"), F.count(F.lit(1)).alias("passes"), F.min("duration").alias("least"), F.max("duration").alias("most")).drop("run")


def shortfall_groups(rows: DataFrame) -> DataFrame:
    """Alike degradations as one row with how often and when last."""
    return rows.groupBy("conv_id", "reason", "detail").agg(F.count(F.lit(1)).alias("times"), F.max("pass_no").alias("last_pass"))


def search_reach(states: DataFrame, tail: DataFrame, words: Column) -> DataFrame:
    """Per conversation whether given words are received verbatim, in the recap, only stored, or nowhere.

    states: conv_id, content (stored), carried (in the recap or null); tail: conv_id, content.
    """
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lower(words)), F.lit(False))
    stored = states.groupBy("conv_id").agg(F.bool_or(has("carried")).alias("recap"), F.bool_or(has("content")).alias("stored"))
    now = tail.groupBy("conv_id").agg(F.bool_or(has("content")).alias("verbatim"))
    out = now.join(stored, "conv_id", "full")
    reach = F.when(F.col("verbatim"), "verbatim").when(F.col("recap"), "in recap").when(F.col("stored"), "only stored").otherwise("nowhere")
    return out.select("conv_id", reach.alias("reach"))


def collection_history(outcome: DataFrame, facts: DataFrame) -> DataFrame:
    """Per collection its turns by outcome and the facts of those turns that were replaced. outcome: as P12 gives it."""
    turns = outcome.select("conv_id", F.explode(F.concat("kept", "compacted", "archived", "folded")).alias("replaced_turn"))
    n = facts.filter("replaced_turn is not null").join(turns, ["conv_id", "replaced_turn"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("facts_replaced"))
    sizes = [F.size(c).alias(f"n_{c}") for c in ("kept", "compacted", "archived", "folded")]
    return outcome.select("conv_id", *sizes).join(n, "conv_id", "left").withColumn("facts_replaced", F.coalesce("facts_replaced", F.lit(0)))


def archived_runs(plan: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least `least` archived spans in a row."""
    rows = plan.filter(F.col("level") == ARCHIVED).withColumn("run", F.col("span_no") - F.row_number().over(conv().orderBy("span_no")))
    return rows.groupBy("conv_id", "run").agg(F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.count(F.lit(1)).alias("spans")).filter(F.col("spans") >= least).drop("run")


def credential_refusal(passes: DataFrame) -> DataFrame:
    """The newest refused credential that no later clean pass has cleared. passes: pass_no, status, reason."""
    refused = F.max(F.when(F.col("reason") == "credential_refused", F.col("pass_no")))
    clean = F.max(F.when((F.col("status") == "completed") & F.col("reason").isNull(), F.col("pass_no")))
    return passes.groupBy("conv_id").agg(refused.alias("refused_at"), clean.alias("clean_at")).filter("refused_at > coalesce(clean_at, -1)").select("conv_id", "refused_at")


def conversation_tokens(turns: DataFrame, sent: DataFrame) -> DataFrame:
    """Tokens as written, as sent next, and the share saved. sent: conv_id, sent_tokens."""
    out = turns.groupBy("conv_id").agg(F.sum("token_count").alias("written_tokens")).join(sent, "conv_id")
    return out.withColumn("saved_share", F.round(F.try_divide(F.col("written_tokens") - F.col("sent_tokens"), F.col("written_tokens")), 6))


def session_overview(turns: DataFrame, titles: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row a conversation: title, recorded turns, cut; those with the most turns first."""
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("recorded_turns"), F.sum("token_count").alias("tokens"))
    return n.join(titles, "conv_id", "left").join(cuts.select("conv_id", "cut"), "conv_id", "left").orderBy(F.desc("recorded_turns"), "conv_id")


def fact_board(states: DataFrame) -> DataFrame:
    """Facts in force by who stated them; those that don't reach the model first, then the newest."""
    order = Window.partitionBy("conv_id", "speaker").orderBy("reaches_model", F.desc("message_turn"), F.desc("seq"))
    return states.filter("replaced_turn is null").withColumn("place", F.row_number().over(order))
