"""Streams over many files in no order of time give the rows of the whole table."""

import os
import time

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest import queries
from palimpsest.plans import passes
from palimpsest.queries import live
from palimpsest.queries.base import as_turns
from palimpsest.sources.state import BucketTable
from palimpsest.streaming import streams
from tests.conftest import SF, plain
from tests.test_passes import SETTINGS, conversations

WATERMARKED = "q3_stream_idle_close q4_stream_traffic q5_stream_settle q6_stream_spawn_links q8_dedupe_requests".split()


@pytest.fixture(scope="module")
def split_events(tmp_path_factory):
    """Events cut by time into six files, the newest first in the order in which a stream reads them."""
    root = tmp_path_factory.mktemp("split")
    folder = root / "events.parquet"
    folder.mkdir()
    events = pq.read_table(f"{SF.replace('0.001', '0.01')}/events.parquet").sort_by("ts")
    size = -(-events.num_rows // 6)
    for place, k in enumerate([5, 1, 4, 0, 3, 2]):
        path = folder / f"part-{k}.parquet"
        pq.write_table(events.slice(k * size, size), path)
        os.utime(path, (1_700_000_000 + 60 * place,) * 2)
    return str(root)


@pytest.mark.parametrize("name", WATERMARKED)
def test_rows_behind_a_watermark_are_whole(name, spark, split_events):
    df = queries.queries()[name](spark, split_events)
    names = sorted(df.columns)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{split_events}/events.parquet/*.parquet'")
    cur = duck.execute(queries.oracle_sql()[name])
    own = [d[0] for d in cur.description]
    assert sorted(own) == names
    want = sorted(repr(tuple(plain(dict(zip(own, r, strict=True))[n]) for n in names)) for r in cur.fetchall())
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    assert want and got == want


def test_collections_go_on_after_a_restart(spark, tmp_path):
    """Turns in files of no order; the driver dies within a batch, when part of the batch's state is written; the next one goes on."""
    talks = conversations(14, 2)
    rows = [(conv, i, role, text) for conv, turns in talks.items() for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    source, home = str(tmp_path / "turns"), str(tmp_path / "state")
    for part in (1, 0):  # of every conversation some turns come after later ones
        df.filter((F.col("conv_id") + F.col("turn") > 8) == bool(part)).coalesce(1).write.mode("append").parquet(source)
    first = streams.Collections(spark, home, as_turns, SETTINGS, buckets=8)
    given = first.passed.replace

    def dies(rows, touched, batch):
        if batch == 1:
            raise RuntimeError("the driver is gone")
        given(rows, touched, batch)

    first.passed.replace = dies
    with pytest.raises(Exception, match="the driver is gone"):
        streams.run(streams.open_stream(spark, source), each=first.each, folder=home)
    again = streams.Collections(spark, home, as_turns, SETTINGS, buckets=8)
    streams.run(streams.open_stream(spark, source), each=again.each, folder=home)
    want, log = passes.backfill(as_turns(df), SETTINGS)
    rows_of = lambda df: sorted(map(str, df.collect()))
    for name, table in again.state.items():
        assert rows_of(table.read()) == rows_of(want[name]), name
    assert rows_of(again.passes()) == rows_of(log)


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    table = BucketTable(spark, "conv_id long, x string", str(tmp_path / "t"), buckets=16)
    rows = spark.range(200).select(F.col("id").alias("conv_id"), F.lit("a").alias("x"))
    table.replace(rows, table.touched(rows), 0)
    one = spark.createDataFrame([(7, "b")], table.schema)
    touched = table.touched(one)
    for _ in range(2):  # a batch may run again
        table.replace(table.read(1, touched).filter("conv_id <> 7").unionByName(one), touched, 1)
    assert len(touched) == 1 and len([d for d in os.listdir(tmp_path / "t" / "rows" / "1") if d.startswith("bucket=")]) == 1
    table.replace(one.limit(0), [], 2)
    other = BucketTable(spark, "conv_id long, x string", str(tmp_path / "t"), buckets=16)
    assert other.read().count() == 200 and [r.conv_id for r in other.read().filter("x = 'b'").collect()] == [7]
    assert other.read(1).filter("x = 'b'").count() == 0 and other.read(0).count() == 0
    other.replace(one.limit(0), touched, 3)
    assert other.read().count() == 200 - other.read(3, touched).count()


def at(seconds):
    return f"2024-01-01 {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def replayed(spark, folder, batches, schema):
    """Batches as files of a stream, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/{k}")
        for name in os.listdir(f"{folder}/{k}"):
            if name.endswith(".parquet"):
                os.makedirs(f"{folder}/all", exist_ok=True)
                os.rename(f"{folder}/{k}/{name}", f"{folder}/all/{k}.parquet")
                os.utime(f"{folder}/all/{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    return streams.open_stream(spark, f"{folder}/all")


def test_caches_go_cold_by_event_time(spark, tmp_path):
    schema = "conversation_id string, ts string, lifetime_s double, used boolean"
    batches = [
        [("a", at(1000), 300.0, True), ("b", at(1000), 300.0, False)],
        [("a", at(900), 3600.0, False), ("z", at(1100), 300.0, True)],  # late and older: nothing moves back
        [("z", at(1200), 3600.0, True)],
        [("z", at(1305 + 601), 3600.0, True)],  # event time passes 1305
        [("z", at(2000), 3600.0, True)],
        [("a", at(2100), 300.0, False)],  # warm again: it has used the cache before
    ]
    base = 1704067200
    rows = streams.run(streams.stream_cache_state(replayed(spark, str(tmp_path), batches, schema)), "update").orderBy("batch").collect()
    a = [(r.state, r.at - base, r.last_used_at - base, r.lifetime_s) for r in rows if r.conversation_id == "a"]
    assert a == [("warm", 1000, 1000, 300), ("warm", 1000, 1000, 300), ("cold", 1305, 1000, 300), ("warm", 2100, 2100, 300)]
    assert {r.state for r in rows if r.conversation_id == "b"} == {"cold"}


def test_links_on_a_stream_are_one_to_one(spark, tmp_path):
    """Replayed over batches: each side in one link at most, the longest prompt, then the earliest; held sides go after ten minutes."""
    schema = "client_session string, ts string, id string, prompt string, opening string"
    call = lambda t, i, p, s="s": (s, at(t), i, p, None)
    opens = lambda t, i, o, s="s": (s, at(t), i, None, o)
    batches = [
        [call(100, "c1", "find it"), call(101, "c2", "find it all"), call(102, "c3", "find it")],
        [opens(110, "o1", "please find it all now"), opens(111, "o2", "please find it")],
        [opens(105, "p1", "look up", "t"), call(120, "d1", "look", "t"), opens(121, "o3", "find it")],
        [call(130, "e1", "wait", "u")],
        [opens(731, "q1", "wait", "u"), call(800, "f1", "soon", "u")],
        [opens(1400, "q2", "soon", "u"), opens(1401, "q3", "soon", "u")],
        [call(9000, "x", "end", "v")],
        [call(9001, "y", "end", "v")],
    ]
    rows = streams.run(streams.stream_spawn_links(replayed(spark, str(tmp_path), batches, schema))).collect()
    links = {(r.call_id, r.opening_id) for r in rows}
    assert links == {("c2", "o1"), ("c1", "o2"), ("c3", "o3"), ("d1", "p1"), ("f1", "q2")} and len(rows) == 5


def test_a_backlog_of_many_files_is_one_batch(spark, tmp_path, monkeypatch):
    """Batches go by bytes, not by files: the passes of a stream cost as many rounds as whole histories have."""
    talks = [(c, i, "assistant" if i % 2 else "user", f"turn {i} of {c}") for c in range(6) for i in range(2)]
    source = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(talks, "conv_id long, turn int, role string, text string").repartition(5).write.parquet(source)
    seen, each = [], streams.Collections.each
    monkeypatch.setattr(streams.Collections, "each", lambda self, df, n: (seen.append(df.count()), each(self, df, n))[1])
    live.q1_stream_passes(spark, str(tmp_path))
    assert seen == [len(talks)]
    seen.clear()
    streams.run(streams.open_stream(spark, source, size=1), each=lambda df, n: seen.append(df.count()))
    assert len(seen) > 1 and sum(seen) == len(talks)


def test_pairs_of_a_long_session_meet_near_each_other_only(spark, tmp_path):
    """Sides of one session over weeks: each is held against those of its minutes, so the pairs come in time."""
    sides, start = 30_000, time.time()
    spark.range(sides).selectExpr("id", "timestamp_seconds(1704067200 + id * 60) ts").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = streams.open_stream(spark, str(tmp_path / "t"), None).withColumn("client_session", F.lit("s"))
    calls = rows.select("client_session", F.col("id").alias("call_id"), F.lit("a").alias("prompt"), F.col("ts").alias("called_at"))
    openings = rows.select("client_session", F.col("id").alias("opening_id"), F.lit("ba").alias("opening"), F.col("ts").alias("opened_at"))
    got = streams.run(streams.stream_spawn_pairs(calls, openings))
    assert got.count() == got.select("call_id", "opening_id").distinct().count() == sum(min(sides, i + 11) - max(0, i - 10) for i in range(sides))
    assert time.time() - start < 60
