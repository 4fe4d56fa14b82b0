"""Cut points and exchanges (G)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import first_sentence


def conv():
    return Window.partitionBy("conv_id")


def so_far():
    return conv().orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)


def span_starts(turns: DataFrame) -> DataFrame:
    """G1: turns (opens) with exchange_no and starts: opens an exchange, or an assistant turn after another in it."""
    numbered = turns.withColumn("exchange_no", F.sum(F.col("opens").cast("long")).over(so_far()))
    earlier = Window.partitionBy("conv_id", "exchange_no").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    answered = F.coalesce(F.max(F.col("role") == "assistant").over(earlier), F.lit(False))
    return numbered.withColumn("starts", F.col("opens") | ((F.col("role") == "assistant") & answered))


def safe_cuts(turns: DataFrame) -> DataFrame:
    """conv_id, cut for each position at which no tool result after the cut answers a call before it."""
    calls = turns.select("conv_id", F.col("turn_index").alias("call"), F.explode("tool_use_ids").alias("id"))
    results = turns.select("conv_id", F.col("turn_index").alias("result"), F.explode("tool_result_ids").alias("id"))
    # Of a call and its results only the widest gap matters: one row a call id. Positions from the one after the call to the
    # last result's lie in the gap; a running sum over where gaps begin and end counts those that are open.
    gaps = calls.groupBy("conv_id", "id").agg(F.min("call").alias("call")).join(results.groupBy("conv_id", "id").agg(F.max("result").alias("result")), ["conv_id", "id"])
    ends = F.explode(F.array(F.struct((F.col("call") + 1).alias("cut"), F.lit(1).alias("d")), F.struct((F.col("result") + 1).alias("cut"), F.lit(-1).alias("d"))))
    marks = gaps.filter("call < result").select("conv_id", ends.alias("e")).select("conv_id", F.col("e.cut").alias("cut"), F.col("e.d").alias("d"), F.lit(False).alias("is_turn"))
    rows = turns.select("conv_id", F.col("turn_index").alias("cut"), F.lit(0).alias("d"), F.lit(True).alias("is_turn")).unionByName(marks)
    so_far_ = conv().orderBy("cut").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("open", F.sum("d").over(so_far_)).filter("is_turn and open = 0").select("conv_id", "cut")


def cut_points(turns: DataFrame, keep_last: int) -> DataFrame:
    """conv_id, n_turns, cut: the latest safe start of a span that leaves at least keep_last turns; 0 if none.

    The place after the last turn is a safe start too, for a keep_last of 0.
    """
    starts = span_starts(turns).select("conv_id", F.col("turn_index").alias("cut"), "starts", F.count(F.lit(1)).over(conv()).alias("n_turns"))
    safe = safe_cuts(turns).withColumn("safe", F.lit(True))
    fitting = starts.join(safe, ["conv_id", "cut"], "left")
    ok = F.col("starts") & F.coalesce("safe", F.lit(False)) & (F.col("cut") <= F.col("n_turns") - keep_last)
    cut = F.coalesce(F.max(F.when(ok, F.col("cut"))), F.lit(0)) if keep_last > 0 else F.first("n_turns")
    return fitting.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), cut.alias("cut"))


def group_exchanges(turns: DataFrame, max_span_tokens: int = 8000) -> DataFrame:
    """Turns with span_no from 0: a span opens with an exchange, or before an assistant turn that would pass the cap once
    the span has an assistant turn. The size starts again at each split, so a conversation's turns pass through one task in
    order, each read once and none kept: the time is in proportion to its length. Texts stay out of it."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None  # no conversation yet; a null one is one of its own
        span, size, has = -1, 0, False
        for batch in batches:
            out = []
            for conv_id, opens, tokens, reply in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "opens", "token_count", "reply")), strict=True):
                if of != (conv_id,):
                    of, span, size, has = (conv_id,), -1, 0, False
                if span < 0 or opens or reply and has and size + tokens > max_span_tokens:
                    span, size, has = span + 1, 0, False
                size, has = size + tokens, has or reply
                out.append(span)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn_index"), pa.array(out, pa.int64())], ["conv_id", "turn_index", "span_no"])

    rows = turns.select("conv_id", "turn_index", F.coalesce("opens", F.lit(False)).alias("opens"), F.coalesce("token_count", F.lit(0)).alias("token_count"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("reply"))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn_index")]
    spans = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_index").mapInArrow(group, ", ".join([*kinds, "span_no long"]))
    return turns.join(spans, ["conv_id", "turn_index"])


def spans_of(turns: DataFrame) -> DataFrame:
    """One row a span of turns (conv_id, span_no, ...): first_turn, last_turn, turn_indices, tokens, text."""
    rows = F.array_sort(F.collect_list(F.struct("turn_index", "content")))
    out = turns.groupBy("conv_id", "span_no").agg(F.min("turn_index").alias("first_turn"), F.max("turn_index").alias("last_turn"), F.sum("token_count").alias("tokens"), rows.alias("rows"))
    return out.withColumn("turn_indices", F.transform("rows", lambda r: r.turn_index)).withColumn("text", F.array_join(F.transform("rows", lambda r: r.content), "\n")).drop("rows")


def index_lines(turns: DataFrame, writer: Callable[[Column], Column] | None = None) -> DataFrame:
    """conv_id, span_no, index_line: the first sentence the person said in the span, else of its first turn that says something.

    A writer of one's own is a column function over the span's turns in order, an array of (turn_index, role, content); a null
    line becomes an empty one.
    """
    if writer is not None:
        said = F.array_sort(F.collect_list(F.struct("turn_index", "role", "content")))
        return turns.groupBy("conv_id", "span_no").agg(said.alias("said")).select("conv_id", "span_no", F.coalesce(writer(F.col("said")), F.lit("")).alias("index_line"))
    words = F.regexp_replace("person_text", r"\s", "") != ""
    asked = F.min_by("person_text", F.when(F.col("said_by_user") & words, F.col("turn_index")))
    says = (F.regexp_replace("content", r"\s", "") != "") & (F.size("tool_result_ids") <= 0)
    other = F.min_by("content", F.when(says, F.col("turn_index")))
    return turns.groupBy("conv_id", "span_no").agg(asked.alias("a"), other.alias("o")).select("conv_id", "span_no", F.coalesce(first_sentence(F.coalesce("a", "o")), F.lit("")).alias("index_line"))


def batch_ready(batches: DataFrame, min_cut_tokens: int) -> DataFrame:
    """Batches (cut, compactable) with ready."""
    return batches.withColumn("ready", (F.col("cut") > 0) & (F.col("compactable") > 0) & (F.col("compactable") >= min_cut_tokens))


def tail_and_cut(turns: DataFrame, cuts: DataFrame) -> DataFrame:
    """Turns with in_tail; those before the cut are not."""
    return turns.join(cuts.select("conv_id", "cut"), "conv_id").withColumn("in_tail", F.col("turn_index") >= F.col("cut"))
