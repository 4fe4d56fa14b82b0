"""Collections one reply after the other against a loop in Python."""

import math
import random
import re

from pyspark.sql import functions as F

from palimpsest.functions.text import BACK_REFERENCES, STOPWORDS
from palimpsest.operators import scoring
from palimpsest.plans import passes, recap

SETTINGS = passes.Settings(keep_last=2, max_span_tokens=40, budget=150, fold_line_tokens=9, min_cut_tokens=8, stale_bound_tokens=120, min_saving_share=0.3, weights=scoring.Weights(1.0, 0.0, 0.0), cache=lambda: F.when(F.col("conv_id") % 2 == 0, "warm").otherwise("cold"))


def tokens(text):
    return -(-len(text) // 4)


def facts_of(turns, upto):
    """Filed facts of the turns before `upto`: (turn, topic, value), with the turn and value that replaced each."""
    filed = []
    for i, (role, text) in enumerate(turns[:upto]):
        if role == "user" and (m := re.fullmatch(r"The (\w+) is (\w+)\.", text)):
            last = next((f for f in reversed(filed) if f[1] == m[1]), None)
            if last is None or last[2] != m[2]:
                filed.append((i, m[1], m[2]))
    return [(i, t, v, next(((j, w) for j, u, w in filed if u == t and j > i), None)) for i, t, v in filed]


class Loop:
    """One conversation, reply by reply."""

    def __init__(self, conv, s):
        self.conv, self.s, self.turns, self.old, self.staged, self.cut, self.log = conv, s, [], [], [], None, []

    def starts(self, young):
        out, answered = [], False
        for role, _ in young:
            opens = role == "user"
            out.append(opens or role == "assistant" and answered)
            answered = role == "assistant" if opens else answered or role == "assistant"
        return out

    def group(self, first, last):
        spans, size, has = [], 0, False
        for i in range(first, last):
            role, text = self.turns[i]
            a = role == "assistant"
            if not spans or role == "user" or a and has and size + tokens(text) > self.s.max_span_tokens:
                spans.append([])
                size, has = 0, False
            spans[-1].append(i)
            size, has = size + tokens(text), has or a
        return spans

    def levels(self, spans, was, now, upto):
        words = lambda t: re.findall("[a-z0-9]+", t.lower())
        asked = {w for w in words(now) if len(w) > 1 and w not in STOPWORDS and w not in BACK_REFERENCES}
        text = ["\n".join(self.turns[i][1] for i in p) for p in spans]
        df = {w: sum(w in words(t) for t in text) for w in asked}
        weight = {w: math.log(1 + len(spans) / (1 + df[w])) for w in asked}
        facts = facts_of(self.turns, upto)
        out = []
        for p, t, level in zip(spans, text, was, strict=True):
            relevance = sum(weight[w] * words(t).count(w) / (words(t).count(w) + 1) for w in asked) / sum(weight.values()) if asked else 0.0
            score = round(max(math.exp(-0.05 * max(0, len(self.turns) - 1 - p[-1])), relevance), 6)
            own = [f for f in facts if f[0] in p]
            notes = [f"↳ Replaced later (turn {f[3][0]}): {f[1]}: {f[3][1]}, not {f[2]}." for f in own if f[3]]
            kept = "\n".join([f"{recap.QUOTED} (turn {i}, {self.turns[i][0]}) {self.turns[i][1]}" for i in p] + notes)
            where = f"turn {p[0]}" if len(p) == 1 else f"turns {p[0]}–{p[-1]}"
            opening = next((self.turns[i][1] for i in p if self.turns[i][0] == "user"), self.turns[p[0]][1])
            opening = m[0].strip() if (m := re.match(r".*?[.!?](?:\s|$)", opening)) else opening
            opening = opening if len(opening) <= 100 else re.sub(r"\s\S*$", "", opening[:99]) + "…"
            line = " · ".join([f"{recap.ARCHIVED_AT} ({where}) {opening}", *(f"{f[1]}: {f[2]}" for f in own if not f[3])])
            out.append({"score": score, "was": level, 3: tokens(kept), 1: tokens("\n".join([line, *notes])), 0: 0})
        budget, bands = self.s.budget - self.s.header_tokens, self.s.bands
        for o in out:
            to = lambda m: 3 if o["score"] >= bands.keep + m else 2 if o["score"] >= bands.archive + m else 1  # noqa: E731, B023
            up, down = to(bands.margin), to(-bands.margin)
            band = to(0) if o["was"] is None else up if up > o["was"] else down if down < o["was"] else o["was"]
            o["level"] = 1 if band <= 1 and o[1] < o[3] else 3
        total = sum(o[o["level"]] for o in out)
        for o in sorted(out, key=lambda o: o["score"]):
            if total > budget and o["level"] == 3 and o[1] < o[3]:
                total, o["level"] = total - o[3] + o[1], 1
        left, folded = total, False
        for k, o in enumerate(out):
            if not left > budget:
                break
            left, folded = left - o[o["level"]] + (self.s.fold_line_tokens if k == 0 else 0), True
            o["level"] = 0
        return out, folded

    def one_pass(self):
        s, aged = self.s, sum(len(p) for p, _ in self.old)
        young = self.turns[aged:]
        ok = [c for c, start in enumerate(self.starts(young)) if start and c <= len(young) - s.keep_last]
        cut = max(ok, default=0)
        held = aged + sum(len(p) for p, _ in self.staged)
        upto = max(aged + cut, held)
        drafts = self.group(held, upto)
        spans = [p for p, _ in self.old] + [p for p, _ in self.staged] + drafts
        now = "\n".join(t for r, t in self.turns[upto:] if r == "user")
        planned, folded = self.levels(spans, [x for _, x in self.old] + [None] * (len(spans) - len(self.old)), now, upto)
        size = lambda p: sum(tokens(self.turns[i][1]) for i in p)
        new = list(zip(spans, planned, strict=True))[len(self.old) :]
        compactable = sum(size(p) for p, o in new[len(self.staged) :] if o["level"] < 3)
        saving = sum(size(p) - o[o["level"]] for p, o in new) - (0 if self.old or not spans else s.header_tokens)
        status = "not_collected" if not cut else "batch_too_small" if compactable <= 0 or compactable < s.min_cut_tokens else "no_saving" if saving <= 0 else "staged"
        if status == "staged":
            self.staged = [(p, o["level"]) for p, o in new]
            self.next = [o["level"] for o in planned[: len(self.old)]]
            self.cut = (saving, sum(size(p) for p, o in new if o["level"] < 3), sum(o[o["level"]] for o in planned) + s.header_tokens + s.fold_line_tokens * folded)
        reason, switch, tail = None, False, self.turns[aged + sum(len(p) for p, _ in self.staged) :]
        if self.cut and len(tail) >= s.keep_last:
            kept, stale, front = self.cut
            rules = [("no_saving", kept <= 0), ("cache_cold", self.conv % 2 == 1), ("repays_rewrite", kept >= s.min_saving_share * (front + sum(tokens(t) for _, t in tail))), ("stale_weight_at_bound", stale >= s.stale_bound_tokens)]
            reason = next((n for n, holds in rules if holds), "waiting_for_payback")
            switch = reason not in ("no_saving", "waiting_for_payback")
        if switch:
            self.old = [(p, x) for (p, _), x in zip(self.old, self.next, strict=True)] + self.staged
            self.staged, self.cut = [], None
        self.log.append((self.conv, len(self.log), status, cut, compactable, saving, switch, reason))

    def run(self, turns):
        for role, text in turns:
            self.turns.append((role, text))
            if role == "assistant":
                self.one_pass()
        return self

    def state(self):
        return [(self.conv, k, p[0], p[-1], k >= len(self.old), x) for k, (p, x) in enumerate(self.old + self.staged)]


def conversations(n, longest, seed=3):
    rnd = random.Random(seed)
    topics = ["database", "cache", "queue", "region", "colour"]
    out = {}
    for conv in range(n):
        turns = []
        for _ in range(rnd.randint(1, longest)):
            about = rnd.choice(topics)
            turns.append(("user", rnd.choice([f"The {about} is {rnd.choice(['red', 'blue', 'green'])}.", f"Tell me more on {about} and {rnd.choice(topics)} please? " + "words " * rnd.randint(0, 9)])))
            turns += [("assistant", f"Well, the {about} needs " + "care and " * rnd.randint(1, 25) + "time.")] * rnd.choice([1, 1, 1, 2])
        out[conv] = turns
    return out


def as_turns(spark, talks):
    rows = [(conv, i, role, text) for conv, turns in talks.items() for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn_index long, role string, content string")
    user, none = F.col("role") == "user", F.array().cast("array<string>")
    return df.withColumns({"token_count": F.ceil(F.char_length("content") / 4).cast("long"), "opens": user, "said_by_user": user, "person_text": F.col("content"), "speaker": F.col("role"), "tool_use_ids": none, "tool_result_ids": none})


def test_backfill_equals_loop(spark):
    talks = conversations(40, 3)
    state, log = passes.backfill(as_turns(spark, talks), SETTINGS)
    loops = {conv: Loop(conv, SETTINGS).run(turns) for conv, turns in talks.items()}
    got = {(r.conv_id, r.pass_no): tuple(r) for r in log.select("conv_id", "pass_no", "status", "cut", "compactable", "saving", "switch", "reason").collect()}
    want = {(x[0], x[1]): x for loop in loops.values() for x in loop.log}
    assert got == want
    assert {x[2] for x in want.values()} >= {"not_collected", "staged", "batch_too_small"} and {x[7] for x in want.values()} >= {"cache_cold", "repays_rewrite", "stale_weight_at_bound", "waiting_for_payback"}
    spans = sorted((r.conv_id, r.span_no, r.first_turn, r.last_turn, r.staged, r.level) for r in state["spans"].collect())
    assert spans == sorted(x for loop in loops.values() for x in loop.state())
    filed = sorted((r.conv_id, r.message_turn, r.topic_label, r.content, r.knowledge_status == "superseded") for r in state["facts"].filter("filed").collect())
    assert filed == sorted((conv, f[0], f[1], f[2], f[3] is not None) for conv, loop in loops.items() for f in facts_of(loop.turns, sum(len(p) for p, _ in loop.old)))
    assert any(f[4] for f in filed) and {x[4] for x in spans} == {True, False}
