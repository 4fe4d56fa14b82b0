"""Traffic, provider usage and cache figures of the request log (A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USAGE = ("input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens")
DEFAULT_LIFETIME_S, MARGIN_S = 300, 5


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def traffic_totals(requests: DataFrame) -> DataFrame:
    """A1: requests and tokens overall, by client session, and by conversation, in one pass; level 0, 1 or 2."""
    sums = [F.count(F.lit(1)).alias("requests"), F.sum("tokens_from_client").alias("tokens_in"), F.sum("tokens_forwarded").alias("tokens_out"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in USAGE)]
    out = requests.rollup("client_session", "conversation_id").agg(F.grouping_id().alias("g"), *sums)
    level = F.when(F.col("g") == 3, 0).when(F.col("g") == 1, 1).otherwise(2)
    return out.withColumn("level", level).withColumn("tokens_saved", F.col("tokens_in") - F.col("tokens_out")).drop("g")


def claim_openings(requests: DataFrame) -> DataFrame:
    """A2: requests; a first request without a conversation gets the one that later has the same opening from the same origin."""
    later = requests.filter("conversation_id is not null").groupBy(F.col("client_session").alias("s"), F.col("agent_id").alias("g"), F.col("opening").alias("o")).agg(F.min_by("conversation_id", "seq").alias("claimed"))
    same = F.col("client_session").eqNullSafe(F.col("s")) & F.col("agent_id").eqNullSafe(F.col("g")) & (F.col("opening") == F.col("o"))
    both = requests.join(later, same & F.col("conversation_id").isNull(), "left")
    return both.withColumn("conversation_id", F.coalesce("conversation_id", "claimed")).drop("s", "g", "o", "claimed")


def outside_conversations(requests: DataFrame) -> DataFrame:
    """A3: per session what its listed conversations don't account for."""
    listed = F.col("conversation_id").isNotNull()
    rest = lambda c: (F.sum(c) - F.coalesce(F.sum(F.when(listed, F.col(c))), F.lit(0)))
    return requests.groupBy("client_session").agg((F.count(F.lit(1)) - F.count_if(listed)).alias("requests"), rest("tokens_from_client").alias("tokens_in"), rest("tokens_forwarded").alias("tokens_out"))


def usage_by_kind(requests: DataFrame, *keys: str) -> DataFrame:
    """A4: provider tokens by kind; the whole prompt is the three input kinds."""
    out = requests.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in USAGE))
    return out.withColumn("prompt_tokens", F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens"))


def token_rates(requests: DataFrame) -> DataFrame:
    """A5: provider tokens for each own token, by model, over requests counted both ways."""
    both = requests.filter("status = 200 and tokens_forwarded > 0")
    prompt = sum((F.col(c) for c in USAGE[:3]), F.lit(0))
    return both.groupBy("model").agg((F.sum(prompt) / F.sum("tokens_forwarded")).alias("rate"))


def last_reply(requests: DataFrame) -> DataFrame:
    """Each conversation's newest answered request, counted both ways."""
    done = requests.filter("status = 200 and ended_at is not null")
    prompt = sum((F.col(c) for c in USAGE[:3]), F.lit(0))
    newest = F.max(F.struct("ended_at", "seq", "tokens_forwarded", prompt.alias("prompt_tokens")))
    return done.groupBy("conversation_id").agg(newest.alias("r")).select("conversation_id", "r.seq", "r.tokens_forwarded", "r.prompt_tokens")


def session_listing(requests: DataFrame, most: int = 100) -> DataFrame:
    """A session's conversations, most recently active first, with collections not sent yet."""
    carried = F.max(F.when(F.col("collected"), F.col("seq")))
    convs = requests.filter("conversation_id is not null").groupBy("client_session", "conversation_id").agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("requests"), carried.alias("__c"))
    waiting = requests.filter("switch_planned").select("conversation_id", F.col("seq").alias("s"))
    left = convs.join(waiting, "conversation_id", "left").groupBy("client_session", "conversation_id", "last_seq", "requests").agg(F.count_if(F.col("s") > F.coalesce("__c", F.lit(-1))).alias("waiting"))
    rank = F.row_number().over(Window.partitionBy("client_session").orderBy(F.desc("last_seq"), "conversation_id"))
    return left.withColumn("place", rank).filter(F.col("place") <= most)


def collection_cost(collections: DataFrame, requests: DataFrame) -> DataFrame:
    """Collections (conversation_id, seq, rewritten_tokens) with the next answered request that carried them."""
    both = collections.select("conversation_id", "seq", "rewritten_tokens", F.lit(None).cast("long").alias("write"), F.lit(None).cast("long").alias("at")).unionByName(requests.filter("collected and status = 200").select("conversation_id", "seq", F.lit(None).cast("long").alias("rewritten_tokens"), F.coalesce("cache_creation_tokens", F.lit(0)).alias("write"), F.col("seq").alias("at")))
    ahead = Window.partitionBy("conversation_id").orderBy("seq", F.col("at").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    met = both.withColumn("carried_by", F.first("at", ignorenulls=True).over(ahead)).withColumn("cache_write", F.first("write", ignorenulls=True).over(ahead))
    return met.filter("rewritten_tokens is not null").select("conversation_id", "seq", "rewritten_tokens", "carried_by", "cache_write")


def cache_state(requests: DataFrame) -> DataFrame:
    """Requests with the state of the conversation's cache as each was built: idle_s, uses_cache, cache. Unknown is warm."""
    before = Window.partitionBy("conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    used = (F.coalesce("cache_read_tokens", F.lit(0)) + F.coalesce("cache_creation_tokens", F.lit(0))) > 0
    answered = F.col("status") == 200
    out = requests.withColumn("uses_cache", F.max(F.when(answered, used)).over(before)).withColumn("__last", F.max(F.when(answered, F.col("forwarded_at"))).over(before))
    out = out.withColumn("idle_s", (micros("forwarded_at") - micros("__last")) / F.lit(1e6))
    cold = ~F.col("uses_cache") | (F.col("idle_s") > F.col("lifetime_s") + MARGIN_S)
    return out.withColumn("cache", F.when(F.coalesce(cold, F.lit(False)), "cold").otherwise("warm")).drop("__last")


def thinking_tokens(turns: DataFrame, replies: DataFrame, rates: DataFrame) -> DataFrame:
    """A10: turns (turn_id, model, thinking_key, visible_tokens) with thinking_tokens from the replies that have the key and model."""
    spent = replies.groupBy("model", "thinking_key").agg(F.sum("output_tokens").alias("output")).join(rates, "model")
    met = turns.join(spent, ["model", "thinking_key"], "left")
    return met.withColumn("thinking_tokens", F.greatest(F.lit(0), F.coalesce(F.round(F.col("output") / F.col("rate")) - F.col("visible_tokens"), F.lit(0))).cast("long")).drop("output", "rate")


def attachment_tokens(turns: DataFrame, sizes: DataFrame, placeholder: int = 2) -> DataFrame:
    """turn_id, attachment_tokens, unsized. turns: turn_id, model, keys; sizes: model, key, size; rate in each row."""
    each = turns.select("turn_id", "model", "rate", F.explode_outer("keys").alias("key")).join(sizes, ["model", "key"], "left")
    tokens = F.greatest(F.lit(0.0), F.col("size") / F.col("rate") - placeholder)
    return each.groupBy("turn_id").agg(F.coalesce(F.round(F.sum(tokens)), F.lit(0)).cast("long").alias("attachment_tokens"), F.count_if(F.col("key").isNotNull() & F.col("size").isNull()).alias("unsized"))


def model_windows(requests: DataFrame, windows: DataFrame, configured: int = 128_000) -> DataFrame:
    """Requests with window and whether the model reported it."""
    return requests.join(windows, "model", "left").withColumn("reported", F.col("window").isNotNull()).withColumn("window", F.coalesce("window", F.lit(configured)))


def own_model_usage(calls: DataFrame) -> DataFrame:
    """Own calls and their tokens by pass, conversation and model."""
    return calls.groupBy("pass_id", "conversation_id", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def gc_counters(requests: DataFrame) -> DataFrame:
    """How often each thing happened to a request's history. requests: action, collected, status."""
    n = lambda ok, name: F.count_if(ok).alias(name)
    return requests.agg(n(F.col("collected"), "applied"), n(~F.col("collected"), "bypassed"), n(F.col("action") == "rewind", "rewinds"), n(F.col("action") == "restart", "restarts"), n(F.col("action") == "seed", "seeds"), n(F.col("collected") & (F.col("status") >= 400), "refused_rewrites"))


def saving_share(before: Column, after: Column) -> Column:
    """The whole percent saved, halves up; `<1%` where it is positive but rounds to 0."""
    share = F.try_divide(before - after, before)
    whole = F.floor(share * 100 + 0.5)
    return F.when((share > 0) & (whole == 0), "<1%").otherwise(F.concat(F.coalesce(whole, F.lit(0)).cast("string"), F.lit("%")))
