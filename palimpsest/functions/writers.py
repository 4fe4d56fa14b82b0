"""Who wrote what in a turn."""

from __future__ import annotations

import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that a client writes into a user's turn, and how a relayed report opens.
COMMANDS = ("command-name", "command-message", "command-args")
CAVEAT = "local-command-caveat"
OTHERS = (CAVEAT, "local-command-stdout", "local-command-stderr", "task-notification")
RELAYED = r"^\s*(?:Another Claude session sent a message:\s*)?<agent-message\b"
INTERRUPTED = r"\[Request interrupted by user(?: for tool use)?\]\s*"
SPEAKERS = {"relayed": "subagent report", "client": "client", "tool": "tool results"}
RANGES = "array<struct<s:int,e:int>>"

OPENING = re.compile(rf"^<({'|'.join((*COMMANDS, *OTHERS))})>", re.MULTILINE)
BORDERS = {name: re.compile(rf"<{name}>|</{name}>[ \t]*$", re.MULTILINE) for name in (*COMMANDS, *OTHERS)}


def elements(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the client's elements: opened at a line's beginning, closed at a line's end, not opened again inside."""
    found, at = [], 0
    while opened := OPENING.search(text, at):
        border = BORDERS[opened[1]].search(text, opened.end())
        closed = border is not None and border[0].startswith("</")
        at = border.end() if closed else opened.end()
        if closed:
            found.append((opened.start(), at, opened[1]))
    return found


def written_by_client(text: str) -> list[tuple[int, int]]:
    """Ranges of a user's turn that the client wrote: its elements but for commands, which are the person's, and expansions.

    Elements other than commands cut the turn into sections. A section's text is what its commands expanded to if the section
    begins with a command, and no caveat stands before it; else it is the person's. Ranges that only blanks part are one.
    """
    found = elements(text)
    borders = [(0, 0, ""), *(x for x in found if x[2] not in COMMANDS), (len(text), len(text), "")]
    owned = [(s, e) for s, e, _ in borders[1:-1]]
    for (_, opens, name), (closes, _, _) in pairwise(borders):
        inside = [(s, e) for s, e, n in found if opens <= s < closes and n in COMMANDS]
        if inside and name != CAVEAT and not text[opens : inside[0][0]].strip():
            ends = [s for s, _ in inside[1:]] + [closes]
            owned += [(e, until) for (_, e), until in zip(inside, ends, strict=True) if text[e:until].strip()]
    joined: list[tuple[int, int]] = []
    for s, e in sorted(owned):
        first = joined.pop()[0] if joined and not text[joined[-1][1] : s].strip() else s
        joined.append((first, e))
    return joined


def client_written_ranges(text: Column) -> Column:
    """W1, an Arrow function: elements are found by position, which no built-in function gives."""

    @F.arrow_udf(RANGES)
    def ranges(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        return pa.array([[{"s": s, "e": e} for s, e in written_by_client(t)] if t and "<" in t else [] for t in texts.to_pylist()], kind)

    return ranges(text)


def is_relayed(text: Column) -> Column:
    return F.coalesce(text.rlike(RELAYED), F.lit(False))


def divide_by_writer(blocks: Column) -> Column:
    """struct<text, tool, speaker> of a turn's blocks (type, text), joined by line ends; ranges of tool output and speaker.

    Tool results are the tools'; text after the mark of an interruption is the person's; other text is the client's.
    """
    start = F.struct(F.lit("").alias("text"), F.array().cast(RANGES).alias("tool"), F.array().cast(RANGES).alias("client"), F.array().cast(RANGES).alias("speaker"), F.lit(False).alias("cut"))

    def step(acc: Column, block: Column) -> Column:
        at = F.when(acc.text == "", 0).otherwise(F.char_length(acc.text) + 1)
        end = at + F.char_length(block.text)
        span = F.array(F.struct(at.cast("int").alias("s"), end.cast("int").alias("e")))
        mark = block.text.rlike("^" + INTERRUPTED + "$")
        tool = block.type == "tool_result"
        person = ~tool & acc.cut & ~mark
        joined = F.when(acc.text == "", block.text).otherwise(F.concat(acc.text, F.lit("\n"), block.text))
        add = lambda which, ok: F.when(ok, F.concat(acc[which], span)).otherwise(acc[which])
        return F.struct(joined.alias("text"), add("tool", tool).alias("tool"), add("client", ~tool & ~person).alias("client"), add("speaker", person).alias("speaker"), (acc.cut | (~tool & mark)).alias("cut"))

    return F.aggregate(blocks, start, step)


def parts_by_writer(content: Column, client: Column, tool: Column) -> Column:
    """array<struct<writer,text>>, stripped, blanks dropped; an undivided turn is one part, untouched."""
    mark = lambda ranges, who: F.transform(F.coalesce(ranges, F.array().cast(RANGES)), lambda r: F.struct(r.s.alias("s"), r.e.alias("e"), F.lit(who).alias("writer")))
    marked = F.array_sort(F.concat(mark(client, "client"), mark(tool, "tool")))
    size = F.char_length(content)
    part = lambda who, s, e: F.struct(who.alias("writer"), F.regexp_replace(F.substring(content, s + 1, e - s), r"^\s+|\s+$", "").alias("text"))
    empty = F.array().cast("array<struct<writer:string,text:string>>")

    def step(acc: Column, r: Column) -> Column:
        return F.struct(r.e.alias("at"), F.concat(acc.parts, F.array(part(F.lit("speaker"), acc.at, r.s), part(r.writer, r.s, r.e))).alias("parts"))

    done = F.aggregate(marked, F.struct(F.lit(0).alias("at"), empty.alias("parts")), step, lambda acc: F.concat(acc.parts, F.array(part(F.lit("speaker"), acc.at, size))))
    whole = F.array(F.struct(F.lit("speaker").alias("writer"), content.alias("text")))
    return F.when(F.size(marked) == 0, whole).otherwise(F.filter(done, lambda p: p.text != ""))


def person_text(parts: Column) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: p.writer == "speaker"), lambda p: p.text), "\n\n")


def with_writers(turns: DataFrame) -> DataFrame:
    """turns (role, content, relayed, client_written, tool_output, tool_result_ids) with parts, person_text, said_by_user, opens, speaker, newest_kind: W4 to W9."""
    divided = (F.size(F.coalesce("client_written", F.array().cast(RANGES))) + F.size(F.coalesce("tool_output", F.array().cast(RANGES)))) > 0
    results = F.size(F.coalesce("tool_result_ids", F.array().cast("array<string>"))) > 0
    tools = F.size(F.coalesce("tool_output", F.array().cast(RANGES))) > 0
    out = turns.withColumn("parts", parts_by_writer(F.col("content"), F.col("client_written"), F.col("tool_output"))).withColumn("person_text", person_text(F.col("parts")))
    said = (F.col("role") == "user") & ~F.col("relayed") & (~results | tools) & (~divided | (F.col("person_text") != ""))
    client = F.size(F.coalesce("client_written", F.array().cast(RANGES))) > 0
    speaker = F.when(F.col("relayed"), SPEAKERS["relayed"]).when(said, F.col("role")).when(results, SPEAKERS["tool"]).when(client, SPEAKERS["client"]).otherwise(F.col("role"))
    newest = F.when(said, "typed").when(F.col("relayed"), "relayed").when(results, "tool_results").when(client, "client").otherwise("assistant")
    return out.withColumns({"said_by_user": said, "opens": said & ~results, "speaker": speaker, "newest_kind": newest})


def range_violations(turns: DataFrame) -> DataFrame:
    """Turns whose ranges are unordered, overlapping, outside the text, or on a turn that is not the user's."""
    everything = F.array_sort(F.concat(*(F.coalesce(c, F.array().cast(RANGES)) for c in ("client_written", "tool_output"))))
    tidy = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(everything))), lambda i: F.coalesce((F.try_element_at(everything, i).s < F.try_element_at(everything, i).e) & (F.try_element_at(everything, i).e <= F.char_length("content")) & (F.coalesce(F.try_element_at(everything, i + 1).s, F.lit(1 << 30)) >= F.try_element_at(everything, i).e), F.lit(True)))
    ordered = F.forall(F.array(F.col("client_written"), F.col("tool_output")), lambda r: F.coalesce(F.array_sort(r) == r, F.lit(True)))
    return turns.filter((F.size(everything) > 0) & ~(tidy & ordered & (F.col("role") == "user")))
