"""How much a span matters now (S)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import Counter, asked_words, count_tokens, counted_words, decision_score, density_score, density_signals, tokenize_words


def conv():
    return Window.partitionBy("conv_id")


@dataclass(frozen=True)
class Scorer:
    """An importance scorer of one's own: its part's name, its weight, and a column function of a span's text and tokens.

    What it gives outside 0 to 1 counts as the nearer end, null as 0.
    """

    name: str
    weight: float
    score: Callable[[Column, Column], Column]


PARTS = ("recency", "relevance", "decision", "density", "liveness", "score")


@dataclass(frozen=True)
class Weights:
    """Shares of the parts in a span's score, how fast recency fades by turn, and scorers beside the own ones."""

    attention: float = 0.6
    decision: float = 0.2
    density: float = 0.2
    decay: float = 0.05
    scorers: tuple[Scorer, ...] = ()

    def __post_init__(self):
        if min(self.attention, self.decision, self.density, *(s.weight for s in self.scorers)) < 0 or self.total <= 0:
            raise ValueError("weights must not be negative, and their sum must be positive")
        if len({*PARTS, *(s.name for s in self.scorers)}) < len(PARTS) + len(self.scorers):
            raise ValueError("every scorer needs a name of its own")

    @property
    def total(self) -> float:
        return self.attention + self.decision + self.density + sum(s.weight for s in self.scorers)


def recency(last_turn: Column, newest: Column, decay: float = Weights.decay) -> Column:
    """S3."""
    return F.exp(-decay * F.greatest(F.lit(0), newest - last_turn))


def lexical_relevance(spans: DataFrame, now: DataFrame) -> DataFrame:
    """conv_id, span_no, relevance. spans: conv_id, span_no, text; now: conv_id, now, a row a conversation.

    Asked words are counted within a span's row, so that other words are never laid out, and what is counted meets once. A
    span without an asked word scores 0.
    """
    sizes = spans.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    asked = now.select("conv_id", asked_words(F.col("now")).alias("asked")).join(sizes, "conv_id")
    told = F.explode(counted_words(tokenize_words(F.col("text")), F.col("asked"))).alias("w")
    met = spans.join(asked, "conv_id").select("conv_id", "span_no", "n", F.size("asked").alias("n_asked"), told)
    at, w = Window.partitionBy("conv_id", "w.word"), F.log(1 + F.col("n") / (1 + F.col("df")))
    met = met.withColumns({"df": F.count(F.lit(1)).over(at), "first": F.col("span_no") == F.min("span_no").over(at)}).withColumn("weight", w)
    once_a_word = F.coalesce(F.sum(F.when(F.col("first"), F.col("weight"))), F.lit(0.0))
    earned = met.groupBy("conv_id", "span_no", "n", "n_asked").agg(F.sum(F.col("weight") * F.col("w.c") / (F.col("w.c") + 1)).alias("earned"), once_a_word.alias("total"), F.count_if("first").alias("words"))
    unmet = (F.col("n_asked") - F.sum("words").over(conv())) * F.log(1 + F.col("n"))  # the weight of asked words in no span
    earned = earned.select("conv_id", "span_no", "earned", (F.sum("total").over(conv()) + unmet).alias("total"))
    both = spans.select("conv_id", "span_no").join(earned, ["conv_id", "span_no"], "left")
    return both.select("conv_id", "span_no", F.coalesce(F.try_divide("earned", "total"), F.lit(0.0)).alias("relevance"))


def vector_relevance(spans: DataFrame, now: DataFrame) -> DataFrame:
    """The same seam by vectors: spans (conv_id, span_no, vector), now (conv_id, now_vector) as cosine, 0 without a norm."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = F.try_divide(dot("vector", "now_vector"), F.sqrt(dot("vector", "vector") * dot("now_vector", "now_vector")))
    return spans.join(now, "conv_id").select("conv_id", "span_no", F.coalesce(cosine, F.lit(0.0)).alias("relevance"))


def now_text(turns: DataFrame) -> DataFrame:
    """conv_id, now: the person's words in the tail, by line. turns: in_tail, said_by_user, person_text."""
    said = F.struct("turn_index", "person_text")
    kept = F.array_sort(F.collect_list(F.when(F.col("in_tail") & F.col("said_by_user"), said)))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(kept, lambda r: r.person_text), "\n").alias("now"))


def span_scores(spans: DataFrame, now: DataFrame, newest: DataFrame, weights: Weights = Weights(), relevance: DataFrame | None = None, counter: Counter = count_tokens) -> DataFrame:
    """Spans with recency, relevance, decision, density, liveness, a column for each scorer, and score. newest: conv_id, newest (turn)."""
    related = lexical_relevance(spans, now) if relevance is None else relevance
    out = spans.join(related, ["conv_id", "span_no"]).join(newest, "conv_id")
    out = out.withColumns({"recency": recency(F.col("last_turn"), F.col("newest"), weights.decay), "decision": decision_score(F.col("text")), "density": density_score(F.col("text"), counter(F.col("text")))})
    out = out.withColumn("liveness", F.greatest("recency", "relevance"))
    earned = weights.attention * F.col("liveness") + weights.decision * F.col("decision") + weights.density * F.col("density")
    for s in weights.scorers:
        within = F.least(F.greatest(s.score(F.col("text"), counter(F.col("text"))).cast("double"), F.lit(0.0)), F.lit(1.0))
        out = out.withColumn(s.name, F.coalesce(within, F.lit(0.0)))
        earned = earned + s.weight * F.col(s.name)
    return out.withColumn("score", earned / weights.total).drop("newest")


def score_ceiling(weights: Weights = Weights()) -> float:
    """The best score that any span can reach."""
    return (weights.attention + weights.decision + weights.density + sum(s.weight for s in weights.scorers)) / weights.total


def turn_scores(turns: DataFrame) -> DataFrame:
    """Turns with decision, density, signals and a reason."""
    out = turns.withColumns({"decision": decision_score(F.col("content")), "signals": density_signals(F.col("content")), "density": density_score(F.col("content"), F.col("token_count"))})
    return out.withColumn("reason", F.format_string("%d signals in %d tokens, density %.4f", F.col("signals").cast("long"), F.col("token_count"), F.col("density")))
