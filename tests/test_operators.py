"""Operators against plain loops over random cases, and decision tables."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.writers import written_by_client
from palimpsest.operators import exchanges, facts, requests, summaries
from palimpsest.plans import collections, levels


def loop_plan(spans, budget, fold_line):
    """Lowering the coldest span a step at a time, then folding the oldest."""

    def cost(s, level):
        return {3: s["kept"], 2: s["comp"], 1: s["arch"], 0: 0}[level]

    def ok(s, level):
        if level == 2 and s["comp"] is None or level == 1 and not s["can"]:
            return False
        return all(cost(s, level) < cost(s, x) for x in range(level + 1, 4) if x != 2 or s["comp"] is not None)

    now = []
    for s in spans:
        band = 3 if s["score"] >= 0.7 else 2 if s["score"] >= 0.3 else 1
        now.append(next(x for x in (*range(band, 3), 3) if x == 3 or ok(s, x)))
    total = sum(map(cost, spans, now))
    while total > budget:
        options = [(s["score"], i, next((x for x in range(now[i] - 1, 0, -1) if ok(s, x) and cost(s, x) < cost(s, now[i])), None)) for i, s in enumerate(spans)]
        options = [o for o in options if o[2]]
        if not options:
            break
        _, i, x = min(options)
        total -= cost(spans[i], now[i]) - cost(spans[i], x)
        now[i] = x
    k = 0
    while total > budget and k < len(spans):
        total += (fold_line if k == 0 else 0) - cost(spans[k], now[k])
        now[k] = 0
        k += 1
    return now


def test_plan_equals_loop(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for conv in range(300):
        spans = []
        for no in range(rnd.randint(1, 6)):
            kept = rnd.randint(5, 60)
            s = {"score": rnd.choice([0.1, 0.29, 0.3, 0.5, 0.7, 0.9]), "kept": kept, "comp": rnd.choice([None, rnd.randint(2, 60)]), "arch": rnd.randint(1, 40), "can": rnd.random() < 0.8}
            spans.append(s)
            rows.append((conv, no, s["score"], None, kept, s["comp"], s["arch"], s["can"], conv % 90, 6))
        for no, level in enumerate(loop_plan(spans, conv % 90, 6)):
            want[conv, no] = level
    df = spark.createDataFrame(rows, "conv_id long, span_no long, score double, current int, kept_tokens long, compacted_tokens long, archived_tokens long, archivable boolean, budget int, fold_line_tokens int")
    got = {(r.conv_id, r.span_no): r.level for r in levels.plan_levels(df).collect()}
    assert got == want


def test_hysteresis(spark):
    df = spark.createDataFrame([(0.72, 2), (0.76, 2), (0.66, 3), (0.64, 3), (0.2, 0), (0.36, 0)], "score double, current int")
    assert [r.b for r in df.select(levels.score_band(F.col("score"), F.col("current")).alias("b")).collect()] == [2, 3, 3, 2, 1, 2]


def test_bands_are_checked():
    with pytest.raises(ValueError):
        levels.Bands(0.5, 0.4, 0.06)


def loop_facts(rows):
    force, out = {}, []
    for _, _, topic, value, who in sorted(rows):
        before = force.get(topic)
        if before and (before[0] == value or (who == "assistant" and before[1] == "user")):
            continue
        force[topic] = (value, who)
        out.append((topic, value))
    return out


def test_filing_facts_equals_loop(spark):
    rnd = random.Random(7)
    cases = {c: [(t, 0, rnd.choice("xyz"), rnd.choice("abc"), rnd.choice(["user", "assistant"])) for t in range(rnd.randint(1, 9))] for c in range(300)}
    df = spark.createDataFrame([(c, *r[:4], "fact", r[4]) for c, rows in cases.items() for r in rows], "conv_id long, message_turn long, seq long, topic_label string, content string, knowledge_type string, speaker string")
    for form in (facts.file_facts, facts.fold_facts):
        got = {}
        for r in form(df).orderBy("message_turn", "seq").collect():
            got.setdefault(r.conv_id, []).append((r.topic_label, r.content))
        assert got == {c: loop_facts(rows) for c, rows in cases.items()}


def test_late_fact_replaces_only_what_is_earlier(spark):
    shape = "conv_id long, message_turn long, seq long, topic_label string, content string, knowledge_type string, speaker string"
    record = spark.createDataFrame([(1, 5, 0, "db", "SQLite", "fact", None), (1, 40, 0, "db", "MySQL", "fact", None)], shape)
    late = spark.createDataFrame([(1, 12, 0, "db", "Postgres", "fact", None)], shape)
    rows = facts.fold_facts(late, record).orderBy("message_turn").collect()
    assert [(r.content, r.knowledge_status) for r in rows] == [("SQLite", "superseded"), ("Postgres", "superseded"), ("MySQL", "active")]


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("The database is Postgres.", [("database", "Postgres", "fact")]),
        ("OK, Decision: our cache runs on Redis", [("cache", "Redis", "fact")]),
        ("We decided to use Postgres for the database.", [("database", "use Postgres", "decision")]),
        ("Let's go with Postgres for the database, and Redis for the cache", [("general", "Postgres for the database, and Redis", "decision")]),
        ("The Größe is five meters", [("größe", "five meters", "fact")]),
        ("El tamaño\u00a0útil is cinco metros.", [("el tamaño útil", "cinco metros", "fact")]),
        ("It is Postgres.", []),
        ("The database is Postgres, right?", []),
    ],
)
def test_extracting_facts(spark, sentence, want):
    turns = spark.createDataFrame([(1, 0, "user", sentence, True)], "conv_id long, turn_index long, role string, person_text string, said_by_user boolean")
    assert [(r.topic_label, r.content, r.knowledge_type) for r in facts.extract_facts(turns).collect()] == want


def test_cut_points(spark):
    """Plain chat, a call across a cut, and no safe cut."""
    none = []

    def chat(conv, rows):
        return [(conv, i, role, role == "user" and not results, calls, results) for i, (role, calls, results) in enumerate(rows)]

    rows = chat(1, [("user", none, none), ("assistant", none, none)] * 5)
    rows += chat(2, [("user", none, none), ("assistant", none, none), ("user", none, none), ("assistant", ["t"], none), ("user", none, ["t"]), ("assistant", none, none)])
    rows += chat(3, [("user", none, none), ("assistant", ["t"], none), ("user", none, ["t"])])
    df = spark.createDataFrame(rows, "conv_id long, turn_index long, role string, opens boolean, tool_use_ids array<string>, tool_result_ids array<string>")
    assert {r.conv_id: r.cut for r in exchanges.cut_points(df, 3).collect()} == {1: 6, 2: 2, 3: 0}


def test_exchanges_are_divided_when_too_large(spark):
    rows = [(1, i, role, role == "user", n) for i, (role, n) in enumerate([("user", 10), ("assistant", 50), ("assistant", 50), ("assistant", 20), ("user", 5), ("assistant", 500)])]
    df = spark.createDataFrame(rows, "conv_id long, turn_index long, role string, opens boolean, token_count long")
    assert [r.span_no for r in exchanges.group_exchanges(df, 100).orderBy("turn_index").collect()] == [0, 0, 1, 1, 2, 2]


def test_ranges_that_a_client_wrote():
    element = "<command-name>/go</command-name>\n"
    assert written_by_client("plain") == []
    assert written_by_client(element + "expanded") == [(32, 41)]
    assert written_by_client("mine\n" + element + "pasted") == []
    assert written_by_client("<local-command-caveat>c</local-command-caveat>\n" + element + "x") == [(0, 46)]
    assert written_by_client("I name <task-notification> here") == []
    two = "<task-notification>n</task-notification>\n" + element + "one\n" + element + "two"
    assert written_by_client(two) == [(0, 40), (73, 78), (110, 114)]
    assert written_by_client("<command-name>a\n<command-name>b</command-name>\nx") == []


def test_switch_rules(spark):
    base = {"saving_tokens": 100, "rewritten_tokens": 50, "stale_tokens": 0, "stale_bound_tokens": 10, "min_saving_share": 1.0, "cache": "warm", "requested": False, "tool_round_open": False}
    cases = [({}, "repays_rewrite"), ({"tool_round_open": True, "requested": True}, "tool_round_open"), ({"saving_tokens": 0, "requested": True}, "no_saving"), ({"requested": True}, "requested"), ({"cache": "cold", "rewritten_tokens": 500}, "cache_cold"), ({"rewritten_tokens": 500, "stale_tokens": 10}, "stale_weight_at_bound"), ({"rewritten_tokens": 500}, "waiting_for_payback"), ({"stale_tokens": -1}, "invalid")]
    names = list(base)
    df = spark.createDataFrame([tuple((base | c)[n] for n in names) for c, _ in cases], names)
    assert [r.reason for r in collections.decide_switch(df).collect()] == [want for _, want in cases]


def test_settling_requests(spark):
    rows = [("s", "c", 1, 1, "a", ["a"]), ("s", "c", 2, 2, "b", ["a", "b"]), ("s", "c", 3, 2, "x", ["a", "x"]), ("s", "c", 4, 3, "d", ["a", "x", "d"])]
    df = spark.createDataFrame(rows, "client_session string, conversation_id string, seq long, position long, newest_hash string, hashes array<string>")
    assert {r.seq: r.kept for r in requests.settle_requests(df).collect()} == {1: True, 2: False, 3: True, 4: None}


def test_settling_random_histories(spark):
    rng, rows, want = random.Random(4), [], {}
    for s in ("s", "t"):
        said, history = [], []
        for seq in range(1, 120):
            said = said[: rng.randint(0, len(said))] if rng.random() < 0.4 else said
            said = said + [rng.choice("abc") for _ in range(rng.randint(1, 3))]
            history.append(said)
            rows.append((s, None if seq % 17 == 0 else "c", seq, len(said), said[-1], said))
        told = [r for r in rows if r[0] == s and r[1]]
        for r in told:
            want[s, r[2]] = next((x[5][r[3] - 1] == r[4] for x in told if x[2] > r[2] and len(x[5]) >= r[3]), None)
    df = spark.createDataFrame(rows, "client_session string, conversation_id string, seq long, position long, newest_hash string, hashes array<string>")
    got = requests.settle_requests(df).collect()
    assert {(r.client_session, r.seq): r.kept for r in got} == {(r[0], r[2]): want.get((r[0], r[2])) for r in rows}


def test_links_one_to_one_as_one_by_one(spark):
    rng, at = random.Random(5), datetime.datetime(2024, 1, 1)
    calls = [("s", i, "ab"[: rng.randint(1, 2)], at + datetime.timedelta(seconds=rng.randint(0, 3000))) for i in range(40)] + [("s", None, "a", at)]
    opened = [("s", i, rng.choice(["ab", "xa", "b"]), at + datetime.timedelta(seconds=rng.randint(0, 3000))) for i in range(100, 140)]
    pairs = sorted((-len(p), t, u, c, o) for _, c, p, t in calls if c is not None for _, o, q, u in opened if p in q and abs((u - t).total_seconds()) <= 600)
    used, want = set(), set()
    for _, _, _, c, o in pairs:
        if not {c, o} & used:
            used |= {c, o}
            want.add((c, o))
    got = requests.link_subagents(spark.createDataFrame(calls, "client_session string, call_id long, prompt string, called_at timestamp"), spark.createDataFrame(opened, "client_session string, opening_id long, opening string, opened_at timestamp"))
    assert {(r.call_id, r.opening_id) for r in got.collect()} == want and len(want) > 10


def test_links_of_rows_alike_in_time(spark):
    """Copies of calls and openings at one time are linked in one pass, not in a round for each copy; ids that come again hold their stretch together."""
    at, start = datetime.datetime(2024, 1, 1), time.time()
    calls = [("s", i, "a", at) for i in range(400)] + [("t", 1, "a", at), ("t", 1, "a", at + datetime.timedelta(hours=2)), (None, 2, "a", at)]
    opened = [("s", i, "ab", at) for i in range(399, -1, -1)] + [("t", 7, "xa", at), ("t", 8, "a", at + datetime.timedelta(hours=2)), (None, 9, "a", at)]
    got = requests.link_subagents(spark.createDataFrame(calls, "client_session string, call_id long, prompt string, called_at timestamp"), spark.createDataFrame(opened, "client_session string, opening_id long, opening string, opened_at timestamp"))
    assert sorted(map(tuple, got.collect())) == [("s", i, i) for i in range(400)] + [("t", 1, 7)]
    assert time.time() - start < 60


def test_nested_subagents_of_any_depth(spark):
    rows = [("s", 1, None, 4, 1, None)] + [("s", k, f"a{k}", 90 + k, k, k - 1) for k in range(2, 12)]
    rows += [("s", 20, "x", 7, 20, 21), ("s", 21, "y", 8, 21, 20), ("s", 30, "alone", 9, 30, None)]
    got = requests.subagent_turns(spark.createDataFrame(rows, "client_session string, request_id long, agent_id string, turn_no long, seq long, spawned_by long")).collect()
    assert {r.agent_id: r.turn_no for r in got} == {f"a{k}": 4 for k in range(2, 12)} | {"x": 7, "y": 8, "alone": 9}


def test_topics_and_values(spark):
    df = spark.createDataFrame([("The  Main Database",), ("what",), (None,), ("our",)], "t string")
    assert [r.x for r in df.select(T.normalise_topic(F.col("t")).alias("x")).collect()] == ["main database", None, "general", None]
    df = spark.createDataFrame([(" My  SQL.;",)], "t string")
    assert df.select(T.normalise_value(F.col("t")).alias("x")).first().x == "my sql"
    df = spark.createDataFrame([("Straße\u00a0 ΟΔΟΣ.", "Überschrift wert: the size is five.")], "v string, s string")
    assert tuple(df.select(T.normalise_value(F.col("v")), T.strip_statement(F.col("s"))).first()) == ("strasse οδοσ", "the size is five")


def test_mentions_whole_words(spark):
    df = spark.createDataFrame([("It is C++ now", "c++"), ("mysqld", "mysql"), ("My  SQL 8", "my sql"), ("a.b", "a.b"), ("axb", "a.b")], "t string, p string")
    assert [r.x for r in df.select(T.mentions(F.col("t"), F.col("p")).alias("x")).collect()] == [True, False, True, True, False]


def test_empty_tables(spark):
    turns = spark.createDataFrame([], "conv_id long, span_no long, turn_index long, content string, token_count long")
    assert exchanges.spans_of(turns).count() == 0
    assert summaries.concat_summary(turns).count() == 0


def test_safe_cuts_equal_loop(spark):
    rnd = random.Random(11)
    rows, want = [], set()
    for conv in range(60):
        n = rnd.randint(1, 12)
        calls = [[f"c{rnd.randint(0, 5)}" for _ in range(rnd.choice([0, 0, 1, 2]))] for _ in range(n)]
        results = [[f"c{rnd.randint(0, 5)}" for _ in range(rnd.choice([0, 0, 1, 2]))] for _ in range(n)]
        rows += [(conv, i, calls[i], results[i]) for i in range(n)]
        for cut in range(n):
            if not any(set(calls[a]) & set(results[b]) for a in range(cut) for b in range(cut, n)):
                want.add((conv, cut))
    df = spark.createDataFrame(rows, "conv_id long, turn_index long, tool_use_ids array<string>, tool_result_ids array<string>")
    assert {(r.conv_id, r.cut) for r in exchanges.safe_cuts(df).collect()} == want


def test_nothing_kept_cuts_after_the_last_turn(spark):
    df = spark.createDataFrame([(1, i, i % 2 == 0, "user" if i % 2 == 0 else "assistant", [], []) for i in range(4)], "conv_id long, turn_index long, opens boolean, role string, tool_use_ids array<string>, tool_result_ids array<string>")
    assert [exchanges.cut_points(df, k).first().cut for k in (0, 1, 2, 4, 5)] == [4, 2, 2, 0, 0]


def test_long_conversations_are_packed_in_linear_time(spark):
    """One exchange of 100,000 turns, and as many spans, against a plain loop."""
    import time

    n = 100_000
    df = spark.range(n).selectExpr("1L as conv_id", "id as turn_index", "id % 97 as token_count", "id = 0 as opens", "if(id % 2 = 1, 'assistant', 'user') as role")
    start = time.perf_counter()
    got = [r.span_no for r in exchanges.group_exchanges(df, 500).select("turn_index", "span_no").orderBy("turn_index").collect()]
    packed = [r.batch_no for r in facts.fact_batches(df.selectExpr("conv_id", "turn_index as span_no", "token_count as tokens"), 500).orderBy("span_no").collect()]
    assert time.perf_counter() - start < 60
    span, size, has, batch, held = -1, 0, False, 0, 0
    for i in range(n):
        t = i % 97
        if i == 0 or i % 2 == 1 and has and size + t > 500:
            span, size, has = span + 1, 0, False
        size, has = size + t, has or i % 2 == 1
        if held > 0 and held + t > 500:
            batch, held = batch + 1, 0
        held += t
        assert (got[i], packed[i]) == (span, batch)
