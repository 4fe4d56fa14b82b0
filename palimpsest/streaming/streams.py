"""Live forms of the operators (Q). Each takes a streaming DataFrame; run() drives a bounded source to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.facts import fold_facts
from palimpsest.operators.health import newest
from palimpsest.plans.passes import PASSES, SCHEMAS, Settings, advance, reply_numbers
from palimpsest.sources.state import BucketTable, state_folder, written

MARGIN_S = 5


#: So many bytes of files make a batch of a backlog: a batch costs its rounds of jobs however little it holds.
BACKLOG = 1 << 30


def open_stream(spark: SparkSession, path: str, files: int | None = 1, size: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream, its schema read from the files; `files` a trigger, None for all at once, or `size` bytes.

    Files are in no order of time, so what stands behind a watermark reads all at once: else a file's newest row makes rows of
    later files late.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if size is not None:
        reader = reader.option("maxBytesPerTrigger", size)
    elif files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern a single file may be a source too


def run(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame | None:
    """Read all that the stream's source has now. Rows go to `each` by batch, or to a table in the shared folder that is returned.

    With a folder the stream goes on from where an earlier run in that folder stopped.
    """
    spark = stream.sparkSession
    folder = folder or f"{state_folder(spark)}/stream-{uuid.uuid4()}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if each is None:
        # Batches are kept apart, so that a batch that runs twice replaces itself.
        writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/rows/{n:06d}")).start().awaitTermination()
        return spark.read.schema(stream.schema.add("batch", "long")).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    writer.foreachBatch(each).start().awaitTermination()
    return None


def stream_traffic(requests: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Q4: running totals by window and session. requests: ts, client_session, tokens_from_client, tokens_forwarded."""
    live = requests.withWatermark("ts", late)
    out = live.groupBy(F.window("ts", width).alias("w"), "client_session").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens_from_client").alias("tokens_in"), F.sum("tokens_forwarded").alias("tokens_out"))
    return out.select(F.col("w.start").alias("start"), "client_session", "requests", "tokens_in", "tokens_out")


WARM, COLD = "warm", "cold"


def stream_cache_state(replies: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Q2: conversation_id, state, at, last_used_at, lifetime_s, uses_cache (times in seconds).

    A row after each batch with replies of a conversation, and a COLD one when event time passes its newest use by the
    lifetime and MARGIN_S. An older reply that arrives late moves nothing back; a conversation whose replies never
    used the cache is cold. replies: conversation_id, ts, lifetime_s, used. State is kept until the cache goes cold and after,
    since a later reply without use still finds one that did.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, lifetime, used = state.get if state.exists else (-1.0, 0.0, False)
        if state.hasTimedOut:
            gone = last + lifetime + MARGIN_S
            yield pd.DataFrame({"conversation_id": [key[0]], "state": [COLD], "at": [gone], "last_used_at": [last], "lifetime_s": [lifetime], "uses_cache": [used]})
            return
        for pdf in batches:
            used = used or bool(pdf["used"].any())
            top = pdf.loc[pdf["started_at"].idxmax()]
            if top["started_at"] >= last:
                last, lifetime = float(top["started_at"]), float(top["lifetime_s"])
        state.update((last, lifetime, used))
        gone, now = last + lifetime + MARGIN_S, state.getCurrentWatermarkMs() / 1000
        warm = used and gone > now
        if warm:
            state.setTimeoutTimestamp(int(gone * 1000) + 1)
        at = last if warm or not used else gone
        yield pd.DataFrame({"conversation_id": [key[0]], "state": [WARM if warm else COLD], "at": [at], "last_used_at": [last], "lifetime_s": [lifetime], "uses_cache": [used]})

    live = replies.withWatermark("ts", late).select("conversation_id", "ts", F.col("ts").cast("double").alias("started_at"), "lifetime_s", "used")
    shape = "conversation_id string, state string, at double, last_used_at double, lifetime_s double, uses_cache boolean"
    return live.groupBy("conversation_id").applyInPandasWithState(keep, shape, "last double, lifetime double, used boolean", "update", GroupStateTimeout.EventTimeTimeout)


def stream_idle_close(requests: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Q3: sessions that end after a day without a request: client_session, opened_at, closed_at, requests."""
    live = requests.withWatermark("ts", late)
    out = live.groupBy(F.session_window("ts", gap).alias("w"), "client_session").agg(F.count(F.lit(1)).alias("requests"))
    return out.select("client_session", F.col("w.start").alias("opened_at"), F.col("w.end").alias("closed_at"), "requests")


def stream_settle(requests: DataFrame, later: DataFrame, within: str = "1 day") -> DataFrame:
    """Q5: request_id, kept: an earlier request met by a later one of its conversation that reaches its position.

    requests: request_id, conversation_id, ts, position, newest_hash; later: conversation_id, ts, hashes. Those never met expire
    with the watermark.
    """
    a = requests.withWatermark("ts", "1 hour").alias("a")
    b = later.withWatermark("ts", "1 hour").alias("b")
    met = a.join(b, F.expr(f"a.conversation_id = b.conversation_id and b.ts > a.ts and b.ts <= a.ts + interval {within} and size(b.hashes) >= a.position"))
    return met.select(F.col("a.request_id"), F.col("b.ts").alias("settled_at"), (F.element_at("b.hashes", F.col("a.position").cast("int")) == F.col("a.newest_hash")).alias("kept"))


def stream_spawn_pairs(calls: DataFrame, openings: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Q6: candidate pairs of calls and openings, in either order within ten minutes; the greedy choice follows by batch.

    Sides meet by session and band of time, a band as wide as a call looks around itself, so that a side is held against those near it
    and not against its whole session.
    """
    wide = F.expr(f"2 * unix_micros(timestamp_seconds(0) + interval {within})")
    band = lambda at: F.floor(F.unix_micros(F.expr(at)) / wide)
    bands = F.sequence(band(f"called_at - interval {within}"), band(f"called_at + interval {within}"))
    a = calls.withWatermark("called_at", within).withColumn("band", F.explode(bands)).alias("a")
    b = openings.withWatermark("opened_at", within).withColumn("band", band("opened_at")).alias("b")
    near = f"a.client_session = b.client_session and a.band = b.band and b.opened_at >= a.called_at - interval {within} and b.opened_at <= a.called_at + interval {within} and contains(b.opening, a.prompt)"
    return a.join(b, F.expr(near)).select("a.client_session", "call_id", "opening_id", "called_at", "opened_at")


LINK = "client_session string, call_id string, opening_id string"


def stream_spawn_links(sides: DataFrame, within_s: int = 600, late: str = "1 minute") -> DataFrame:
    """Q6: client_session, call_id, opening_id: calls and openings matched one to one as event time goes on.

    sides: client_session, ts, id, prompt (of a call, else null), opening (of a subagent's first request, else null). A session's calls
    and openings are held in its state. When event time has passed a side, all that could come before it has come; sides
    are then taken in order of time, each matched with those that wait: the longest prompt that the opening holds, then the
    earliest. A pair once given stays, and a side that has waited for `within_s` seconds goes. State holds no more than a session's
    sides of that time and of the allowed lateness.
    """

    def match(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        for pdf in batches:
            held += [(float(t), str(i), p, o, True) for t, i, p, o in zip(pdf["at"], pdf["id"], pdf["prompt"], pdf["opening"], strict=True)]
        now = state.getCurrentWatermarkMs() / 1000
        held.sort(key=lambda x: (x[0], x[2] is None, x[1]))
        waiting: list[tuple] = [x for x in held if not x[4]]
        links = []
        for side in [x for x in held if x[4] and x[0] <= now]:
            waiting = [x for x in waiting if x[0] >= side[0] - within_s]
            fits = [x for x in waiting if (x[2] is None) != (side[2] is None) and (x[2] or side[2]) in (x[3] or side[3] or "")]
            if fits:
                best = min(fits, key=lambda x: (-len(x[2] or side[2]), x[0], x[1]))
                waiting.remove(best)
                links.append((side[1], best[1]) if side[2] is not None else (best[1], side[1]))
            else:
                waiting.append((*side[:4], False))
        left = [x for x in waiting if x[0] >= now - within_s] + [x for x in held if x[4] and x[0] > now]
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            fresh = [x[0] for x in left if x[4]]
            due = min(fresh) if fresh else min(x[0] for x in left) + within_s
            state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"client_session": [key[0]] * len(links), "call_id": [c for c, _ in links], "opening_id": [o for _, o in links]})

    live = sides.withWatermark("ts", late).select("client_session", "ts", F.col("ts").cast("double").alias("at"), F.col("id").cast("string").alias("id"), "prompt", "opening")
    shape = "at array<double>, id array<string>, prompt array<string>, opening array<string>, fresh array<boolean>"
    return live.groupBy("client_session").applyInPandasWithState(match, LINK, shape, "append", GroupStateTimeout.EventTimeTimeout)


def keep_latest(table: BucketTable, order: str) -> Callable[[DataFrame, int], None]:
    """Q7: for foreachBatch: the newest row of each key."""

    def each(df: DataFrame, n: int) -> None:
        touched = table.touched(df)
        both = table.read(n, touched).unionByName(df)
        row = F.struct(order, *[c for c in both.columns if c != order])
        table.replace(both.groupBy(table.key).agg(F.max(row).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in both.columns]), touched, n)

    return each


def keep_passes(table: BucketTable, most: int = 50) -> Callable[[DataFrame, int], None]:
    """Q7: for foreachBatch: the newest `most` passes of each conversation (H2), from which H1 and H3 to H6 are read. table: conv_id, pass_no, ..."""

    def each(df: DataFrame, n: int) -> None:
        touched = table.touched(df)
        both = table.read(n, touched).unionByName(df).dropDuplicates(["conv_id", "pass_no"])
        table.replace(newest(both, most, "pass_no").drop("place"), touched, n)

    return each


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """Q8: one row for each request and attempt; a request sent again after a refusal has a record of its own."""
    return requests.withWatermark("ts", "1 hour").dropDuplicates(["request_id", "attempt"])


def file_late_facts(table: BucketTable) -> Callable[[DataFrame, int], None]:
    """Q9: for foreachBatch: facts filed into their places, the record of the conversations that the batch touches as the fold's seed."""
    columns = ("conv_id", "message_turn", "seq", "topic_label", "content", "knowledge_type", "speaker")

    def each(df: DataFrame, n: int) -> None:
        touched = table.touched(df)
        known, new = table.read(n, touched), df.select("conv_id").distinct()
        filed = fold_facts(df.select(*columns), known.join(new, "conv_id", "left_semi").select(*columns)).select(*columns, "knowledge_status")
        table.replace(known.join(new, "conv_id", "left_anti").unionByName(filed), touched, n)

    return each


def collect_turns(table: BucketTable, plans: BucketTable, plan: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Q1, levels alone: for foreachBatch: new turns join those on record; the conversations they touch are planned again by the batch code."""

    def each(df: DataFrame, n: int) -> None:
        touched, new = table.touched(df), df.select("conv_id").distinct()
        known = table.read(n, touched)
        both = written(known.unionByName(df.join(known.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")))
        fresh = plan(both.join(new, "conv_id", "left_semi")).select("conv_id", "span_no", F.col("level").cast("int").alias("level"), "tokens")
        plans.replace(plans.read(n, touched).join(new, "conv_id", "left_anti").unionByName(fresh), touched, n)
        table.replace(both, touched, n)

    return each


class Collections:
    """Q1: collections of whole conversations on a stream of their turns (conv_id, turn, role, text), with state that survives a restart.

    A batch takes each conversation that it touches from the pass that it had reached to its newest reply, by the steps that D8 takes
    over whole histories; so spans, staged cuts, filed facts and passes come out as there, however turns are dealt into
    batches. Only the touched buckets of the state are read and written. A turn waits until all before it have come; one
    that comes again is passed over. turns_of: from such rows to turns as a pass reads them.
    """

    def __init__(self, spark: SparkSession, folder: str, turns_of: Callable[[DataFrame], DataFrame], s: Settings = Settings(), buckets: int = 64):
        self.spark, self.folder, self.turns_of, self.settings = spark, folder, turns_of, s
        table = lambda name, schema: BucketTable(spark, schema, f"{folder}/{name}", buckets=buckets)
        self.turns, self.passed = table("turns", "conv_id long, turn int, role string, text string"), table("passed", "conv_id long, passed long")
        self.state = {name: table(name, schema) for name, schema in SCHEMAS.items()}

    def each(self, df: DataFrame, n: int) -> None:
        new = written(df.select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text").dropDuplicates(["conv_id", "turn"]))
        touched, ids = self.turns.touched(new), new.select("conv_id").distinct()
        known = self.turns.read(n, touched)
        both = written(known.unionByName(new.join(known, ["conv_id", "turn"], "left_anti")))
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
        whole = both.join(ids, "conv_id", "left_semi").withColumn("place", place).filter("place = turn").drop("place")
        turns = written(self.turns_of(whole))
        was = {name: table.read(n, touched) for name, table in self.state.items()}
        passed = self.passed.read(n, touched)
        own = {name: rows.join(ids, "conv_id", "left_semi") for name, rows in was.items()}
        now, log = advance(turns, own, passed.join(ids, "conv_id", "left_semi"), self.settings)
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/{n}")
        for name, table in self.state.items():
            table.replace(was[name].join(ids, "conv_id", "left_anti").unionByName(now[name]), touched, n)
        reached = reply_numbers(turns).groupBy("conv_id").agg(F.max("replies").alias("passed"))
        self.passed.replace(passed.join(ids, "conv_id", "left_anti").unionByName(reached), touched, n)
        self.turns.replace(both, touched, n)

    def passes(self) -> DataFrame:
        return self.spark.read.schema(PASSES).option("recursiveFileLookup", True).parquet(f"{self.folder}/log")
