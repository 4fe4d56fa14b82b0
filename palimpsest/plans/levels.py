"""Choosing a detail level for every span under a token budget (P), by windows instead of a loop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of the levels, richest highest.
KEPT, COMPACTED, ARCHIVED, OUT = 3, 2, 1, 0
NAMES = ("out_of_view", "archived", "compacted", "kept")


def conv():
    return Window.partitionBy("conv_id")


@dataclass(frozen=True)
class Bands:
    keep: float = 0.7
    archive: float = 0.3
    margin: float = 0.05

    def __post_init__(self):
        if not 0 <= self.archive <= self.keep <= 1 or not 0 <= self.margin < (self.keep - self.archive) / 2:
            raise ValueError("bands must lie in order between 0 and 1, the margin below half their gap")


def level_name(rank: Column) -> Column:
    return F.when(rank == OUT, NAMES[OUT]).when(rank == ARCHIVED, NAMES[ARCHIVED]).when(rank == COMPACTED, NAMES[COMPACTED]).when(rank == KEPT, NAMES[KEPT])


def estimated_costs(spans: DataFrame, ratio: float = 0.35) -> DataFrame:
    """P1 for drafts: compacted_tokens as archived + ratio * kept where no summary is there yet."""
    return spans.withColumn("compacted_tokens", F.coalesce("compacted_tokens", F.col("archived_tokens") + F.floor(F.col("kept_tokens") * ratio)))


def worthwhile(spans: DataFrame) -> DataFrame:
    """Spans (kept_tokens, compacted_tokens or null, archived_tokens, archivable) with ok_compacted, ok_archived."""
    compacted = F.coalesce(F.col("compacted_tokens") < F.col("kept_tokens"), F.lit(False))
    archived = F.col("archivable") & (F.col("archived_tokens") < F.col("kept_tokens")) & F.coalesce(F.col("archived_tokens") < F.col("compacted_tokens"), F.lit(True))
    return spans.withColumns({"ok_compacted": compacted, "ok_archived": archived})


def _level_for(score: Column, keep: float, archive: float) -> Column:
    return F.when(score >= keep, KEPT).when(score >= archive, COMPACTED).otherwise(ARCHIVED)


def score_band(score: Column, current: Column, bands: Bands = Bands()) -> Column:
    """The rank a score earns; a span that has a level leaves it only past the margin."""
    up = _level_for(score, bands.keep + bands.margin, bands.archive + bands.margin)
    down = _level_for(score, bands.keep - bands.margin, bands.archive - bands.margin)
    return F.when(current.isNull(), _level_for(score, bands.keep, bands.archive)).when(up > current, up).when(down < current, down).otherwise(current)


def settle_level(band: Column) -> Column:
    """The band's level if it is worthwhile, else the nearest richer one that is."""
    return F.when((band <= ARCHIVED) & F.col("ok_archived"), ARCHIVED).when((band <= COMPACTED) & F.col("ok_compacted"), COMPACTED).otherwise(KEPT)


def cost_at(level: Column) -> Column:
    return F.when(level == KEPT, F.col("kept_tokens")).when(level == COMPACTED, F.col("compacted_tokens")).when(level == ARCHIVED, F.col("archived_tokens")).otherwise(F.lit(0))


def fit_budget(spans: DataFrame) -> DataFrame:
    """P5: spans (earned, budget) with level: while over budget the coldest span is lowered a level, the older first on ties.

    One span is lowered to its floor before the next is touched, so steps have one order: by score, span, level. A step
    applies if what the steps before it save still leaves the conversation over budget.
    """
    two = F.when((F.col("earned") == KEPT) & F.col("ok_compacted"), F.lit(COMPACTED))
    one = F.when((F.col("earned") > ARCHIVED) & F.col("ok_archived"), F.lit(ARCHIVED))
    steps = F.filter(F.array(two, one), lambda x: x.isNotNull())
    total = F.sum(cost_at(F.col("earned"))).over(conv())
    each = spans.withColumn("total", total).select("conv_id", "span_no", "score", "budget", "total", "earned", "kept_tokens", "compacted_tokens", "archived_tokens", F.posexplode(steps).alias("step", "lower"), steps.alias("steps"))
    rich = F.when(F.col("step") == 0, F.col("earned")).otherwise(F.element_at("steps", F.greatest(F.lit(1), F.col("step"))))
    each = each.withColumn("saving", cost_at(rich) - cost_at(F.col("lower")))
    order = conv().orderBy("score", "span_no", "step").rowsBetween(Window.unboundedPreceding, -1)
    applied = each.withColumn("saved", F.coalesce(F.sum("saving").over(order), F.lit(0))).filter("total - saved > budget")
    lowest = applied.groupBy("conv_id", "span_no").agg(F.min("lower").alias("lowered_to"))
    return spans.join(lowest, ["conv_id", "span_no"], "left").withColumn("level", F.coalesce("lowered_to", "earned")).withColumn("lowered", F.col("lowered_to").isNotNull()).drop("lowered_to")


def fold_oldest(spans: DataFrame) -> DataFrame:
    """Still over budget, the oldest spans go out of view behind one line of fold_line_tokens. spans: level, budget, fold_line_tokens."""
    order = conv().orderBy("span_no")
    spent = spans.withColumn("cost", cost_at(F.col("level"))).withColumn("t", F.sum("cost").over(conv()))
    before = F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.row_number().over(order) == 1
    folded = (F.col("t") > F.col("budget")) & (first | (F.col("t") + F.col("fold_line_tokens") - before > F.col("budget")))
    out = spent.withColumn("folded", folded).withColumn("level", F.when(F.col("folded"), OUT).otherwise(F.col("level")))
    return out.withColumn("lowered", F.col("lowered") & ~F.col("folded")).drop("t", "cost")


def plan_levels(spans: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Spans (conv_id, span_no, score, current, three costs, archivable, budget, fold_line_tokens) with level, lowered, folded."""
    known = worthwhile(spans)
    earned = known.withColumn("band", score_band(F.col("score"), F.col("current"), bands)).withColumn("earned", settle_level(F.col("band")))
    return fold_oldest(fit_budget(earned))


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row a conversation: tokens, lowered spans, folded count, over_budget."""
    line = F.when(F.max("folded"), F.max("fold_line_tokens")).otherwise(0)
    out = plan.groupBy("conv_id").agg((F.sum(cost_at(F.col("level"))) + line).alias("tokens"), F.array_sort(F.collect_list(F.when(F.col("lowered"), F.col("span_no")))).alias("lowered"), F.count_if("folded").alias("folded"), F.max("budget").alias("budget"))
    return out.withColumn("over_budget", F.col("tokens") > F.col("budget")).drop("budget")


def recap_budget(window: Column, rate: Column, ratio: float = 0.3, stale: float = 0.1) -> tuple[Column, Column]:
    """Own tokens that the recap, and what is stale, may hold in a window counted by the provider."""
    own = F.floor(window / rate)
    return F.floor(own * ratio), F.floor(own * stale)


def cut_saving(plan: DataFrame, header_tokens: int) -> DataFrame:
    """conv_id, saving of the new spans; the header counts where no recap is there yet. plan: level, tokens (of the turns), is_new, has_front."""
    header = F.when(F.max("has_front"), 0).otherwise(header_tokens)
    return plan.groupBy("conv_id").agg((F.sum(F.when(F.col("is_new"), F.col("tokens") - cost_at(F.col("level"))).otherwise(0)) - header).alias("saving"))


def compactable_and_stale(plan: DataFrame) -> DataFrame:
    """P10: conv_id, compactable (tokens of drafts not kept), stale (of all new spans not kept)."""
    lower = F.col("level") < KEPT
    return plan.groupBy("conv_id").agg(F.sum(F.when(lower & F.col("is_new"), F.col("tokens")).otherwise(0)).alias("compactable"), F.sum(F.when(lower, F.col("tokens")).otherwise(0)).alias("stale"))


def why_level(plan: DataFrame) -> DataFrame:
    """A sentence for each span's level."""
    score = F.format_string("%.2f", F.round("score", 2))
    why = F.when(F.col("folded"), "Folded to stay within the budget.").when(F.col("lowered"), F.concat(F.lit("Scored "), score, F.lit("; lowered to fit the budget.")))
    why = why.when(F.col("earned") > F.col("band"), F.concat(F.lit("Scored "), score, F.lit("; no cheaper level."))).when(F.col("current").isNotNull() & (F.col("current") == F.col("band")), F.concat(F.lit("Scored "), score, F.lit("; within the margin of its level.")))
    return plan.withColumn("why", why.otherwise(F.concat(F.lit("Scored "), score, F.lit("."))))


def plan_outcome(plan: DataFrame) -> DataFrame:
    """Turns kept, compacted, archived and folded, and earlier turns lowered or raised. plan: turn_indices, current, level."""
    turns = lambda ok: F.array_sort(F.flatten(F.collect_list(F.when(ok, F.col("turn_indices")))))
    each = {name: turns(F.col("level") == rank) for rank, name in ((KEPT, "kept"), (COMPACTED, "compacted"), (ARCHIVED, "archived"), (OUT, "folded"))}
    return plan.groupBy("conv_id").agg(*(c.alias(n) for n, c in each.items()), turns(F.col("level") < F.col("current")).alias("lowered"), turns(F.col("level") > F.col("current")).alias("raised"))


def collection_decision(batch: DataFrame, min_cut_tokens: int) -> DataFrame:
    """Batch (cut, compactable, saving) with status."""
    status = F.when(F.col("cut") == 0, "not_collected").when((F.col("compactable") <= 0) | (F.col("compactable") < min_cut_tokens), "batch_too_small").when(F.col("saving") <= 0, "no_saving").otherwise("staged")
    return batch.withColumn("status", status)
