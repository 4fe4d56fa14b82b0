"""The request log: what each request was, and the trace of a session (T)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import seconds
from palimpsest.sources.state import cut


def by_seq():
    return Window.partitionBy("client_session").orderBy("seq")


#: What a request is by its newest message, where nothing else says.
FROM_NEWEST = {"tool_results": "tool_round", "relayed": "report", "client": "notice", "assistant": "reply"}


def settle_requests(requests: DataFrame) -> DataFrame:
    """Requests with kept: whether a later request of the conversation carries its newest message, null if none reaches it.

    requests: client_session, conversation_id, seq, position, newest_hash, hashes (array, the whole history).

    The next request reaches the position, or else the first one whose history grows past it again; only what histories grow
    by is laid out, so a conversation that is appended to gives about one row a request.
    """
    key = ["client_session", "conversation_id"]
    order = Window.partitionBy(*key).orderBy("seq")
    at = requests.filter("conversation_id is not null").select(*key, "seq", "position", "newest_hash", "hashes", F.lead("hashes").over(order).alias("next"), F.coalesce(F.lag(F.size("hashes")).over(order), F.lit(0)).alias("before"))
    own = at.select(*key, "seq", "position", "newest_hash", (F.size("next") >= F.col("position")).alias("reached"), F.get("next", F.col("position").cast("int") - 1).eqNullSafe(F.col("newest_hash")).alias("same"))
    grown = at.filter(F.size("hashes") > F.col("before")).select(*key, "seq", F.posexplode(F.slice("hashes", F.col("before") + 1, F.size("hashes") - F.col("before"))).alias("n", "hash"), "before")
    grown = grown.select(*key, "seq", (F.col("before") + F.col("n") + 1).alias("position"), F.struct("hash").alias("told"), F.lit(None).cast("boolean").alias("same"), F.lit(None).cast("string").alias("newest_hash"))
    waiting = own.filter(~F.coalesce("reached", F.lit(False))).select(*key, "seq", F.col("position").cast("int").alias("position"), F.lit(None).cast("struct<hash:string>").alias("told"), F.lit(False).alias("same"), "newest_hash")
    # From the end of the log, so that the frame only grows.
    later = Window.partitionBy(*key, "position").orderBy(F.desc("seq"), F.col("told").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    again = grown.unionByName(waiting).withColumn("met", F.last("told", True).over(later)).filter("same is not null")
    again = again.select("client_session", "seq", F.when(F.col("met").isNotNull(), F.col("met.hash").eqNullSafe(F.col("newest_hash"))).alias("kept"))
    kept = own.filter("reached").select("client_session", "seq", F.col("same").alias("kept")).unionByName(again)
    return requests.join(kept, ["client_session", "seq"], "left")


def request_kinds(requests: DataFrame) -> DataFrame:
    """Requests (agent_id, conversation_id, seq, position, newest, newest_hash, kept, finished, spawned_by) with kind."""
    known = F.col("conversation_id").isNotNull()
    again = F.row_number().over(Window.partitionBy("client_session", "conversation_id", "newest_hash").orderBy("seq")) > 1
    # Later requests come first, so that the frame only grows; one differs if the least or the greatest does.
    after = Window.partitionBy("client_session", "conversation_id", "position").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    others = F.coalesce((F.min("newest_hash").over(after) != F.col("newest_hash")) | (F.max("newest_hash").over(after) != F.col("newest_hash")), F.lit(False))
    main = F.col("agent_id").isNull()
    starts = F.when(main & known, F.min(F.when(main, F.col("seq"))).over(Window.partitionBy("client_session", "conversation_id")))
    latest = F.max("__start").over(Window.partitionBy("client_session"))
    last = F.col("seq") == F.max(F.when(main, F.col("seq"))).over(Window.partitionBy("client_session", "conversation_id"))
    out = requests.withColumn("__start", starts).withColumn("__closing", main & known & last & (F.col("__start") < latest) & F.col("kept").isNull() & (F.col("newest") == "typed"))
    plain = F.coalesce(*(F.when(F.col("newest") == k, v) for k, v in FROM_NEWEST.items()))
    kind = F.when(known & again, "retry").when(F.col("kept") == F.lit(False), F.when((F.col("newest") == "tool_results") & ~F.coalesce("finished", F.lit(False)), "interrupted").otherwise("replaced")).when(F.col("newest") != "typed", plain)
    kind = kind.when(~main & (known | F.col("spawned_by").isNotNull()), "task").when(~known, "unclaimed").when(F.col("__closing"), "closing").when(F.col("kept").isNull() & others, "pending").otherwise("turn")
    return out.withColumn("kind", kind).drop("__start", "__closing")


def turn_of_request(requests: DataFrame) -> DataFrame:
    """Requests (kind) with turn_no: the latest turn that began at or before each, -1 before the first."""
    return requests.withColumn("turn_no", (F.count_if((F.col("kind") == "turn") & F.col("agent_id").isNull()).over(by_seq().rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))


def turn_totals(requests: DataFrame) -> DataFrame:
    """T4: per session and turn: requests, tokens, usage, cache writes of requests that carried a collection, ended_at."""
    ended = F.when(~F.bool_or(F.col("ended_at").isNull()), F.max("ended_at"))
    write = F.sum(F.when(F.col("collected"), F.coalesce("cache_creation_tokens", F.lit(0))).otherwise(0))
    return requests.groupBy("client_session", "turn_no").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens_from_client").alias("tokens_from_client"), F.sum("tokens_forwarded").alias("tokens_forwarded"), (F.sum("tokens_from_client") - F.sum("tokens_forwarded")).alias("tokens_saved"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), write.alias("collection_cache_write_tokens"), ended.alias("ended_at"))


#: So many rows of a session, and the rest of the stretch that they end in, are linked by one task.
STRETCH = 20_000


def link_subagents(calls: DataFrame, openings: DataFrame, minutes: int = 10) -> DataFrame:
    """T5: client_session, call_id, opening_id: one to one, the longest prompt first, then the earliest call.

    A session falls into stretches where nothing happens for longer than `minutes`; no link crosses such a gap. Stretches are dealt
    over tasks, some to a group, and each group's links are chosen in order without laying out the pairs. Null ids link with nothing; rows
    alike in an id count as one call or opening, so what stands between them stays together.
    """
    id_of, of = dict(calls.dtypes)["call_id"], dict(openings.dtypes)["opening_id"]
    own = calls.select("client_session", seconds(F.col("called_at")).alias("at"), "call_id", F.lit(None).cast(of).alias("opening_id"), F.col("prompt").alias("words")).filter("call_id is not null")
    other = openings.select("client_session", seconds(F.col("opened_at")).alias("at"), F.lit(None).cast(id_of).alias("call_id"), "opening_id", F.col("opening").alias("words")).filter("opening_id is not null")
    sides = own.unionByName(other).filter("client_session is not null and at is not null and words is not null")
    in_order = Window.partitionBy("client_session").orderBy("at")
    before, so_far = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(Window.unboundedPreceding, 0)
    sides = sides.withColumn("until", F.max("at").over(Window.partitionBy("client_session", "call_id", "opening_id")))
    sides = sides.withColumns({"reach": F.max("until").over(before), "no": F.row_number().over(in_order)})
    begins = F.when(F.col("reach").isNull() | (F.col("at") - F.col("reach") > 60 * minutes), F.col("no"))
    sides = sides.withColumn("stretch", F.floor(F.max(begins).over(so_far) / STRETCH)).drop("until", "reach", "no")

    def link(rows: pa.Table) -> pa.Table:
        return _links(rows, 60 * minutes)

    return sides.groupBy("client_session", "stretch").applyInArrow(link, f"client_session {dict(calls.dtypes)['client_session']}, call_id {id_of}, opening_id {of}")


def _links(rows: pa.Table, within: float) -> pa.Table:
    """The links of whole stretches, chosen one by one; a call finds the next free opening that holds its prompt by skipping taken ones."""
    both = list(zip(*(rows.column(c).to_pylist() for c in ("at", "call_id", "opening_id", "words")), strict=True))
    openings = sorted((at, o, words) for at, _, o, words in both if o is not None)
    times = [at for at, _, _ in openings]
    calls = sorted(((-len(words), at, c, words) for at, c, _, words in both if c is not None), key=lambda x: x[:3])

    # Of each prompt the openings that hold it, those near one of its calls only, and from each place the next that is free.
    held: dict[str, list[int]] = {}
    for _, at, _, words in calls:
        fits = held.setdefault(words, [0])
        first = max(bisect_left(times, at - within - 0.001), fits[0])
        last = max(bisect_right(times, at + within + 0.001), first)
        fits += [k for k in range(first, last) if words in openings[k][2]]
        fits[0] = last
    for fits in held.values():
        del fits[0]
    skip = {words: list(range(len(fits) + 1)) for words, fits in held.items()}
    called, opened = set(), set()

    def free(words: str, at: float, k: int) -> int | None:
        """The first place from k on that the call may take."""
        fits, to = held[words], skip[words]
        while True:
            path = []
            while k < len(fits) and (to[k] != k or openings[fits[k]][1] in opened):
                path.append(k)
                k = to[k] if to[k] != k else k + 1
            for x in path:
                to[x] = k
            if k == len(fits) or times[fits[k]] - at > within:
                return None
            if at - times[fits[k]] <= within:
                return k
            k += 1

    links = []
    for (_, at), tied in groupby(calls, key=lambda x: x[:2]):
        waiting = []

        def stand(call, words: str, k: int, at: float = at, waiting: list = waiting) -> None:
            k = free(words, at, k)
            if k is not None:
                heappush(waiting, (times[held[words][k]], call, openings[held[words][k]][1], words, k))

        for _, _, call, words in tied:
            if call not in called:
                stand(call, words, bisect_left(held[words], bisect_left(times, at - within - 0.001)))
        while waiting:
            _, call, opening, words, k = heappop(waiting)
            if call in called:
                continue
            if opening in opened:
                stand(call, words, k)
                continue
            called.add(call)
            opened.add(opening)
            links.append((call, opening))
    kinds = rows.schema
    session = [rows.column("client_session")[0].as_py()] * len(links)
    columns = [session, [c for c, _ in links], [o for _, o in links]]
    return pa.table([pa.array(v, kinds.field(c).type) for v, c in zip(columns, ("client_session", "call_id", "opening_id"), strict=True)], names=["client_session", "call_id", "opening_id"])


def subagent_turns(requests: DataFrame) -> DataFrame:
    """client_session, agent_id, turn_no: the turn of the request that started the subagent, through nested ones.

    A subagent without a known start, or with none above it (a circle), belongs to the turn that its first request falls in.
    Each round doubles the depth that it sees through, and is written once.
    """
    firsts = requests.filter("agent_id is not null").groupBy("client_session", "agent_id").agg(F.min_by("turn_no", "seq").alias("own"), F.min_by("spawned_by", F.when(F.col("spawned_by").isNotNull(), F.col("seq"))).alias("by"))
    starters = requests.select("client_session", F.col("request_id").alias("by"), F.col("agent_id").alias("parent"), F.col("turn_no").alias("up")).dropDuplicates(["client_session", "by"])
    known = firsts.join(starters, ["client_session", "by"], "left")
    known = cut(known.select("client_session", "agent_id", "parent", F.when(F.col("parent").isNull(), F.coalesce("up", "own")).alias("turn_no"), "own"))
    most, seen = known.count(), 1
    while seen <= most and not known.filter("parent is not null").isEmpty():
        above = known.select("client_session", F.col("agent_id").alias("parent"), F.col("turn_no").alias("t"), F.col("parent").alias("next"))
        known = known.join(above, ["client_session", "parent"], "left")
        known = cut(known.select("client_session", "agent_id", F.when(F.col("t").isNull(), F.col("next")).alias("parent"), F.coalesce("turn_no", "t").alias("turn_no"), "own"))
        seen *= 2
    return known.select("client_session", "agent_id", F.coalesce("turn_no", "own").alias("turn_no"))


def session_trace(requests: DataFrame) -> DataFrame:
    """One row a session and turn, its main requests in order and its subagents; turn -1 stands before the first."""
    row = F.struct("seq", "request_id", "kind", "tokens_from_client", "tokens_forwarded")
    main = F.array_sort(F.collect_list(F.when(F.col("agent_id").isNull(), row)))
    agents = F.array_sort(F.collect_set(F.col("agent_id")))
    return requests.groupBy("client_session", "turn_no").agg(F.transform(main, lambda r: F.concat_ws(":", r.request_id.cast("string"), r.kind)).alias("requests"), agents.alias("subagents"))


def conversation_parts(requests: DataFrame) -> DataFrame:
    """Conversations of a session: the newest main one, then subagents by start, then earlier mains, newest first."""
    convs = requests.filter("conversation_id is not null").groupBy("client_session", "conversation_id").agg(F.max(F.col("agent_id")).alias("agent_id"), F.min("seq").alias("start"), F.max("seq").alias("last"))
    newest = F.max(F.when(F.col("agent_id").isNull(), F.col("last"))).over(Window.partitionBy("client_session"))
    rank = F.when(F.col("agent_id").isNotNull(), 1).when(F.col("last") == newest, 0).otherwise(2)
    convs = convs.withColumn("part", rank)
    order = Window.partitionBy("client_session").orderBy("part", F.when(F.col("part") == 1, F.col("start")).otherwise(-F.col("last")), "conversation_id")
    return convs.select("client_session", "conversation_id", "agent_id", "part", F.row_number().over(order).alias("place"))


def tool_round_open(requests: DataFrame) -> DataFrame:
    """conversation_id, open: its newest request is unanswered, or its newest reply with status 200 stopped for tools."""
    tells = F.when(F.col("status").isNull() | (F.col("status") == 200), F.col("seq"))
    return requests.filter("conversation_id is not null").groupBy("conversation_id").agg(F.coalesce(F.max_by(F.col("status").isNull() | F.coalesce(F.col("stop_reason") == "tool_use", F.lit(False)), tells), F.lit(False)).alias("open"))
