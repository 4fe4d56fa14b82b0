"""Which recorded conversation a request continues (L)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.ingest import REMINDER

# Keys that say how a block is delivered, and the types of blocks that hold thinking.
DELIVERY = frozenset({"cache_control"})
THINKING = frozenset({"thinking", "redacted_thinking"})
_reminder, _blank_lines = re.compile(REMINDER), re.compile(r"\n{3,}")


def without_reminders(text: str) -> str:
    left = _reminder.sub("", text)
    return text if left == text else _blank_lines.sub("\n\n", left).strip()


def canonical(content, role: str | None) -> str:
    """A turn as one JSON text in which nothing counts but what it says.

    Keys stand in order; delivery hints and thinking are gone, the person's turns lose instruction elements, and so are text
    blocks that are left empty; a plain string is its one text block. Content may be nested to any depth: it is walked with a
    stack of its own.
    """
    root: list = []
    open_ = [(root, [{"type": "text", "text": content}] if isinstance(content, str) else content)]
    while open_:  # containers are filled in after they have been put into place
        into, value = open_.pop()
        pairs = [(None, value)] if into is root else list(value.items()) if isinstance(value, dict) else list(enumerate(value))
        for key, item in pairs:
            if isinstance(into, dict) and key in DELIVERY or isinstance(into, list) and into is not root and isinstance(item, dict) and item.get("type") in THINKING:
                continue
            if isinstance(item, str) and role == "user":
                item = without_reminders(item)
            made = {} if isinstance(item, dict) else [] if isinstance(item, list) else item
            if isinstance(into, dict):
                into[key] = made
            else:
                into.append(made)
            if made is not item:
                open_.append((made, item))
    return written_json([role, _without_empty(root[0])])


def _without_empty(value):
    """value without empty text blocks in its lists, at any depth."""
    empty = lambda x: isinstance(x, dict) and x.get("type") == "text" and not x.get("text")
    open_ = [value]
    while open_:
        at = open_.pop()
        if isinstance(at, list):
            at[:] = [x for x in at if not empty(x)]
        if isinstance(at, (list, dict)):
            open_ += at.values() if isinstance(at, dict) else at
    return value


def written_json(value) -> str:
    """value as JSON, keys in order, without blanks, however deep it is."""
    out: list[str] = []
    open_: list = [value]
    close, comma = object(), object()
    while open_:
        at = open_.pop()
        if isinstance(at, tuple) and at[0] is close:
            out.append(at[1])
        elif isinstance(at, tuple) and at[0] is comma:
            out.append(at[1])
        elif isinstance(at, dict):
            out.append("{")
            open_.append((close, "}"))
            for k, key in enumerate(sorted(at, reverse=True)):
                open_ += [at[key], (comma, ("," if k < len(at) - 1 else "") + json.dumps(key, ensure_ascii=False) + ":")]
        elif isinstance(at, list):
            out.append("[")
            open_.append((close, "]"))
            for k, item in enumerate(reversed(at)):
                open_ += [item, (comma, "," if k < len(at) - 1 else "")]
        else:
            out.append(json.dumps(at, ensure_ascii=False))
    return "".join(out)


def said(content: str | None, raw: str | None, role: str | None) -> str:
    """The canonical form of a turn: of its provider content in JSON if there is any that can be read, else of its text."""
    if raw is not None:
        try:
            return canonical(json.loads(raw), role)
        except (ValueError, RecursionError):  # beyond what the reader nests; the text as it is tells turns apart just as well
            return canonical(raw, role)
    return canonical(content or "", role)


def chain_hashes(turns: DataFrame, raw: str | None = None) -> DataFrame:
    """L1: conv_id, turn_index, hash: each hash holds the one before it and what the turn says (see canonical).

    turns: conv_id, turn_index, role, content, and perhaps a column `raw` with the provider's content as JSON (null: content is
    all). A conversation's turns pass through one task in order, each read once and none kept, so a conversation of any length
    takes time in proportion to it.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before = None, ""
        for batch in batches:
            out = []
            ids, roles, contents, raws = (batch.column(c).to_pylist() for c in ("conv_id", "role", "content", "raw"))
            for own, role, content, more in zip(ids, roles, contents, raws, strict=True):
                if own != conv:
                    conv, before = own, ""
                before = hashlib.sha256(f"{before}\0{said(content, more, role)}".encode("utf-8", "surrogatepass")).hexdigest()
                out.append(before)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn_index"), pa.array(out, pa.string())], ["conv_id", "turn_index", "hash"])

    provider = F.col(raw) if raw else F.lit(None)
    rows = turns.select("conv_id", "turn_index", "role", "content", provider.cast("string").alias("raw"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_index", "role", "content", "raw")
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn_index")]
    return ordered.mapInArrow(chain, ", ".join([*kinds, "hash string"]))


def match_conversations(requests: DataFrame, tips: DataFrame) -> DataFrame:
    """L2: request_id, conv_id, agreed: the recorded conversation whose tip is the longest prefix of a request's history.

    requests: request_id, position, hash, one row a turn; tips: conv_id, tip.
    """
    met = requests.join(tips.select(F.col("tip").alias("hash"), "conv_id"), "hash")
    return met.groupBy("request_id").agg(F.max(F.struct("position", "conv_id")).alias("m")).select("request_id", F.col("m.conv_id").alias("conv_id"), (F.col("m.position") + 1).alias("agreed"))


def agreed_length(pairs: DataFrame) -> DataFrame:
    """L3: pairs (a, b: arrays of hashes) with agreed: leading turns that are alike."""
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return pairs.withColumn("agreed", F.when(F.size(same) == 0, 0).when(first == 0, F.size(same)).otherwise(first - 1).cast("long"))


def reconcile_history(known: DataFrame) -> DataFrame:
    """L4: known (recorded, requested, agreed, aged: turns no longer young) with action: seed, continue, rewind or restart."""
    action = F.when(F.col("agreed") == 0, F.when(F.col("recorded") == 0, "seed").otherwise("restart")).when(F.col("agreed") == F.col("recorded"), "continue").when(F.col("agreed") >= F.col("aged"), "rewind").otherwise("restart")
    return known.withColumn("action", action).withColumn("discarded", F.when(F.col("action") == "rewind", F.col("recorded") - F.col("agreed")).otherwise(0))


def thinking_valid_from(requests: DataFrame) -> DataFrame:
    """conv_id, valid_from: the history's length when the newest recap was first sent. requests: seq, carries, history_turns."""
    newest = F.max(F.when(F.col("carries"), F.col("seq")))
    last = requests.groupBy("conv_id").agg(newest.alias("s"))
    return requests.join(last, "conv_id").filter(F.col("seq") >= F.col("s")).groupBy("conv_id").agg(F.min("history_turns").alias("valid_from"))


def session_expiry(sessions: DataFrame, now: Column, idle: str = "24 hours", most: int = 64) -> DataFrame:
    """Sessions (deployment, session, last_ts) with reason idle or beyond_cap, where they are to be closed."""
    live = F.col("last_ts") > now - F.expr(f"interval {idle}")
    rank = F.row_number().over(Window.partitionBy("deployment", live).orderBy(F.desc("last_ts"), "session"))
    reason = F.when(~live, "idle").when(rank > most, "beyond_cap")
    return sessions.withColumn("reason", reason).filter("reason is not null")


def record_turns(recorded: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns to append, token counts filled in, and those rejected because their index doesn't follow what is recorded."""
    fresh = new.join(recorded.select("conv_id", "turn_index"), ["conv_id", "turn_index"], "left_anti")
    n = recorded.groupBy("conv_id").agg((F.max("turn_index") + 1).alias("n"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn_index")) - 1
    both = fresh.join(n, "conv_id", "left").withColumn("ok", F.col("turn_index") == F.coalesce("n", F.lit(0)) + place)
    both = both.withColumn("token_count", F.coalesce("token_count", F.ceil(F.char_length("content") / 4)))
    return both.filter("ok").drop("n", "ok"), both.filter("not ok").drop("n", "ok")
