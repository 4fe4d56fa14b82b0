"""Collections one reply after the other, for all conversations at once (D8); streams take the same steps batch by batch (Q1).

The state of a conversation is what has been decided so far: its spans with their levels, those of a staged cut among them, the
facts of the turns that spans hold, and the staged cut's measures. Turns stay where they are and are read by range.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import exchanges, facts, scoring
from palimpsest.plans import collections, levels, recap
from palimpsest.sources.state import state_folder, written

SCHEMAS = {
    "spans": "conv_id long, span_no long, first_turn long, last_turn long, staged boolean, level int, next_level int",
    "facts": "conv_id long, message_turn long, seq long, topic_label string, content string, knowledge_type string, speaker string, filed boolean, knowledge_status string",
    "cuts": "conv_id long, saving_tokens long, stale_tokens long, front_tokens long",
}
PASSES = "conv_id long, pass_no long, status string, cut long, compactable long, saving long, switch boolean, reason string"
FACT = ("conv_id", "message_turn", "seq", "topic_label", "content", "knowledge_type", "speaker")


@dataclass(frozen=True)
class Settings:
    """What a pass goes by. summary: the text that stands for a span, of the columns of spans_of and index_line; cache: of conv_id."""

    keep_last: int = 5
    max_span_tokens: int = 8000
    budget: int = 38_400
    fold_line_tokens: int = 20
    min_cut_tokens: int = 1000
    stale_bound_tokens: int = 12_800
    min_saving_share: float = 1.0
    bands: levels.Bands = levels.Bands()
    weights: scoring.Weights = scoring.Weights()
    summary: Callable[[], Column] = field(default=lambda: F.lit(None).cast("string"))
    cache: Callable[[], Column] = field(default=lambda: F.lit("cold"))

    @property
    def header_tokens(self) -> int:
        return -(-len(recap.HEADER) // 4)


def empty_state(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def placed_turns(turns: DataFrame, spans: DataFrame, s: Settings) -> DataFrame:
    """turns with aged (turns in old spans), held (turns in any span), the cut, and span_no of each turn before the cut."""
    ends = spans.groupBy("conv_id").agg(F.max(F.when(~F.col("staged"), F.col("last_turn"))).alias("a"), F.max("last_turn").alias("h"), F.count(F.lit(1)).alias("n"))
    known = turns.join(ends, "conv_id", "left").withColumns({"aged": F.coalesce(F.col("a") + 1, F.lit(0)), "held": F.coalesce(F.col("h") + 1, F.lit(0)), "n_spans": F.coalesce("n", F.lit(0))}).drop("a", "h", "n")
    young = known.filter("turn_index >= aged").withColumn("turn_index", F.col("turn_index") - F.col("aged"))
    points = exchanges.cut_points(young, s.keep_last).select("conv_id", F.col("cut").alias("young_cut"))
    known = written(known.join(points, "conv_id", "left").withColumn("young_cut", F.coalesce("young_cut", F.lit(0))))
    known = known.withColumn("until", F.greatest(F.col("aged") + F.col("young_cut"), "held"))
    drafts = exchanges.group_exchanges(known.filter("turn_index >= held and turn_index < until"), s.max_span_tokens)
    drafts = drafts.select("conv_id", "turn_index", (F.col("span_no") + F.col("n_spans")).alias("span_no"))
    old = spans.select("conv_id", F.explode(F.sequence("first_turn", "last_turn")).alias("turn_index"), "span_no")
    return written(known.join(old.unionByName(drafts), ["conv_id", "turn_index"], "left").withColumn("in_tail", F.col("span_no").isNull()))


def one_pass(turns: DataFrame, state: dict[str, DataFrame], found: DataFrame, s: Settings = Settings()) -> tuple[dict[str, DataFrame], DataFrame]:
    """The state after a pass over these conversations, and a row of PASSES (without pass_no) for each.

    turns: all recorded turns of the conversations, with opens, said_by_user, person_text, speaker and tool ids; found: facts that turns
    state, later ones may be among them. A pass groups the
    turns up to the cut into drafts, plans them with the staged and the old spans, stages the cut if it is large enough and
    saves something, and switches what is staged if the policy says so. Facts of the drafts' turns are staged with the cut and
    filed with the switch. Summaries cost no call here, so one plan decides and is staged.
    """
    spans, known = state["spans"], placed_turns(turns, state["spans"], s)
    placed = known.filter("not in_tail")
    drafted = placed.filter("turn_index >= held").select("conv_id", F.col("turn_index").alias("message_turn"))
    fresh = found.join(drafted, ["conv_id", "message_turn"], "left_semi").select(*FACT, F.lit(False).alias("filed"), F.lit("active").alias("knowledge_status"))
    stated = written(state["facts"].unionByName(fresh))
    notes = written(recap.annotate_spans(placed, facts.file_facts(stated.select(*FACT))))

    newest = known.groupBy("conv_id").agg(F.max("turn_index").alias("newest"))
    grouped = written(exchanges.spans_of(placed).join(exchanges.index_lines(placed), ["conv_id", "span_no"]))
    scored = written(scoring.span_scores(grouped, scoring.now_text(known), newest, s.weights).withColumn("score", F.round("score", 6)))
    texts = recap.span_texts(scored.withColumn("summary_text", s.summary()), placed, notes)
    held = spans.select("conv_id", "span_no", "staged", F.col("level").alias("was"))
    costs = recap.level_costs(texts).join(held, ["conv_id", "span_no"], "left").withColumns({"is_old": F.coalesce(~F.col("staged"), F.lit(False)), "is_draft": F.col("staged").isNull()})
    costs = costs.withColumns({"current": F.when(F.col("is_old"), F.col("was")), "archivable": F.lit(True), "budget": F.lit(s.budget - s.header_tokens), "fold_line_tokens": F.lit(s.fold_line_tokens)})
    columns = ["conv_id", "span_no", "first_turn", "last_turn", "tokens", "score", "current", "kept_tokens", "compacted_tokens", "archived_tokens", "archivable", "budget", "fold_line_tokens", "is_old", "is_draft", "was"]
    plan = written(levels.plan_levels(written(costs.select(*columns)), s.bands))

    lower, cost = F.col("level") < levels.KEPT, levels.cost_at(F.col("level"))
    total = lambda ok, c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0)).cast("long")
    line = F.when(F.max("folded"), s.fold_line_tokens).otherwise(0)
    new = ~F.col("is_old")
    header = F.when(F.bool_or("is_old"), 0).otherwise(s.header_tokens)
    sums = plan.groupBy("conv_id").agg(total(lower & F.col("is_draft"), F.col("tokens")).alias("compactable"), total(lower & new, F.col("tokens")).alias("stale"), (total(new, F.col("tokens") - cost) - header).cast("long").alias("saving"), (F.sum(cost) + line + s.header_tokens).cast("long").alias("front"))
    batch = known.groupBy("conv_id").agg(F.max("young_cut").alias("cut")).join(sums, "conv_id", "left").na.fill(0, ["compactable", "stale", "saving", "front"])
    batch = written(levels.collection_decision(batch, s.min_cut_tokens))
    staged = batch.filter("status = 'staged'")

    def changed(name: str, rows: DataFrame) -> DataFrame:
        """The state's rows, those of conversations that have staged replaced."""
        return state[name].join(staged.select("conv_id"), "conv_id", "left_anti").unionByName(rows.join(staged.select("conv_id"), "conv_id", "left_semi"))

    after = plan.select("conv_id", "span_no", "first_turn", "last_turn", new.alias("staged"), F.when(new, F.col("level")).otherwise(F.col("was")).cast("int").alias("level"), F.col("level").cast("int").alias("next_level"))
    spans = written(changed("spans", after))
    cuts = written(changed("cuts", staged.select("conv_id", F.col("saving").alias("saving_tokens"), F.col("stale").alias("stale_tokens"), F.col("front").alias("front_tokens"))))
    stated = changed("facts", stated)

    ends = spans.groupBy("conv_id").agg(F.max("last_turn").alias("end"))
    tail = known.join(ends, "conv_id").filter("turn_index > end").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t"))
    measures = cuts.join(tail, "conv_id").filter(F.col("n") >= s.keep_last).withColumns({"rewritten_tokens": F.col("front_tokens") + F.col("t"), "stale_bound_tokens": F.lit(s.stale_bound_tokens), "min_saving_share": F.lit(s.min_saving_share), "cache": s.cache(), "requested": F.lit(False), "tool_round_open": F.lit(False)})
    decided = written(collections.decide_switch(measures).select("conv_id", "switch", "reason"))
    switched = decided.filter("switch").select("conv_id", F.lit(True).alias("now"))
    now = F.coalesce("now", F.lit(False))
    spans = spans.join(switched, "conv_id", "left").withColumns({"staged": F.col("staged") & ~now, "level": F.when(now, F.col("next_level")).otherwise(F.col("level"))}).drop("now")
    filed = facts.file_facts(stated.join(switched, "conv_id", "left_semi").select(*FACT)).select(*FACT, F.lit(True).alias("filed"), "knowledge_status")
    out = {"spans": spans, "facts": stated.join(switched, "conv_id", "left_anti").unionByName(filed), "cuts": cuts.join(switched, "conv_id", "left_anti")}
    rows = batch.join(decided, "conv_id", "left").select("conv_id", "status", F.col("cut").cast("long").alias("cut"), "compactable", "saving", F.coalesce("switch", F.lit(False)).alias("switch"), "reason")
    return out, rows


def reply_numbers(turns: DataFrame) -> DataFrame:
    """turns with reply_no (replies before each turn) and replies (of the conversation)."""
    order = Window.partitionBy("conv_id").orderBy("turn_index")
    reply = F.col("role") == "assistant"
    return turns.withColumns({"reply_no": F.count_if(reply).over(order.rowsBetween(Window.unboundedPreceding, 0)) - reply.cast("long"), "replies": F.count_if(reply).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})


def advance(turns: DataFrame, state: dict[str, DataFrame], passed: DataFrame, s: Settings = Settings(), folder: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each conversation from the pass it has reached (passed: conv_id, passed) to its last reply; the state then, and all passes.

    There are as many rounds as the conversation with the most replies to come has. A round reads the turns that its conversations have by
    then, and writes the state of those that go on; one that has ended is written out and read no more.
    """
    spark = turns.sparkSession
    folder = folder or f"{state_folder(spark)}/passes-{uuid.uuid4()}"
    numbered = written(reply_numbers(turns).join(passed, "conv_id", "left").withColumn("to_come", F.col("replies") - F.coalesce("passed", F.lit(0))))
    found = written(facts.extract_facts(numbered.filter("to_come > 0")))
    rounds = numbered.agg(F.max("to_come").alias("n")).first()["n"] or 0
    state = {name: df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]) for name, df in state.items()}
    waiting = numbered.filter("to_come <= 0").select("conv_id").distinct()
    for name, df in state.items():
        df.join(waiting, "conv_id", "left_semi").write.mode("overwrite").parquet(f"{folder}/{name}/start")
    for k in range(rounds):
        live = numbered.filter(F.col("to_come") > k)
        seen = live.filter(F.col("reply_no") <= F.coalesce("passed", F.lit(0)) + k)
        ids = live.groupBy("conv_id").agg(F.max("to_come").alias("left"), F.max(F.coalesce("passed", F.lit(0)) + k).alias("pass_no"))
        own = {name: df.join(ids.select("conv_id"), "conv_id", "left_semi") for name, df in state.items()}
        own, rows = one_pass(seen.drop("reply_no", "replies", "passed", "to_come"), own, found, s)
        rows.join(ids.select("conv_id", "pass_no"), "conv_id").write.mode("overwrite").parquet(f"{folder}/log/{k}")
        ended = ids.filter(F.col("left") == k + 1).select("conv_id")
        for name, df in own.items():
            df = written(df)
            df.join(ended, "conv_id", "left_semi").write.mode("overwrite").parquet(f"{folder}/{name}/{k}")
            state[name] = df.join(ended, "conv_id", "left_anti")
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/{name}")
    log = read("log", PASSES) if rounds else spark.createDataFrame([], PASSES)
    return {name: read(name, schema) for name, schema in SCHEMAS.items()}, log


def backfill(turns: DataFrame, s: Settings = Settings()) -> tuple[dict[str, DataFrame], DataFrame]:
    """D8 over whole histories, from nothing."""
    spark = turns.sparkSession
    return advance(turns, empty_state(spark), spark.createDataFrame([], "conv_id long, passed long"), s)
