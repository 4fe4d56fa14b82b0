"""Request, reply and stream-event logs as rows (I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import Counter, count_tokens

BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string,signature:string,data:string,source:string,cache_control:struct<type:string,ttl:string>>"
REQUEST = f"struct<model:string,system:array<{BLOCK}>,tools:array<struct<name:string,input_schema:string,cache_control:struct<type:string,ttl:string>>>,messages:array<struct<role:string,content:string>>>"
USAGE = "struct<input_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,output_tokens:bigint>"
REPLY = f"struct<type:string,stop_reason:string,usage:{USAGE},content:array<{BLOCK}>,error:struct<type:string,message:string>>"
REMINDER = r"(?ms)^<system-reminder>(?:(?!<system-reminder>).)*?</system-reminder>[ \t]*$"
PROMPT_CHARS = (20, 32_000)
NAME_CHARS, KEY_CHARS, REASON_CHARS = 128, 256, 300
DEFAULT_LIFETIME_S = 300.0


def parsed_requests(log: DataFrame) -> DataFrame:
    """log (request_id, body) with r: the body as a struct; null where it doesn't parse."""
    return log.withColumn("r", F.from_json("body", REQUEST))


def ingest_requests(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (request_id, turn_index, role, content as JSON or text) and rejects (request_id, reason).

    System messages take no index; a request with another role is rejected whole.
    """
    read = parsed_requests(log)
    roles = F.transform("r.messages", lambda m: m.role)
    reason = F.when(F.col("r.messages").isNull(), "unreadable").when(F.exists(roles, lambda x: ~F.coalesce(x.isin("user", "assistant", "system"), F.lit(False))), "role")
    read = read.withColumn("reason", reason)
    rows = read.filter("reason is null").select("request_id", F.posexplode("r.messages").alias("pos", "m")).filter("m.role <> 'system'")
    index = F.row_number().over(Window.partitionBy("request_id").orderBy("pos")) - 1
    return rows.select("request_id", index.cast("long").alias("turn_index"), "m.role", "m.content"), read.filter("reason is not null").select("request_id", "reason")


def blocks_of(content: Column) -> Column:
    """A turn's content as blocks; plain text is one text block."""
    read = F.from_json(content, f"array<{BLOCK}>")
    one = F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))), f"array<{BLOCK}>")
    return F.when(F.startswith(content, F.lit("[{")), F.coalesce(read, one)).otherwise(one)


def block_text(blocks: Column) -> Column:
    """Blocks as text, joined by lines; thinking has none."""
    inner = lambda b: F.coalesce(F.array_join(F.transform(F.from_json(b.content, "array<struct<type:string,text:string>>"), lambda x: F.coalesce(x.text, F.concat(F.lit("["), x.type, F.lit("]")))), "\n"), b.content, F.lit(""))
    text = lambda b: F.when(b.type == "text", b.text).when(b.type.isin("tool_use", "server_tool_use"), F.concat(F.lit("[tool call: "), b["name"], F.lit("] "), F.coalesce(b.input, F.lit("{}")))).when((b.type == "tool_result") & F.coalesce(b.is_error, F.lit(False)), F.concat(F.lit("[tool result, error] "), inner(b))).when(b.type == "tool_result", F.concat(F.lit("[tool result] "), inner(b))).when(b.type.isin("image", "document"), F.concat(F.lit("["), b.type, F.lit("]")))
    return F.array_join(F.filter(F.transform(blocks, text), lambda t: t.isNotNull()), "\n")


def tool_ids(blocks: Column) -> tuple[Column, Column]:
    """Ids of the turn's tool calls and of its tool results."""
    of = lambda kind, field: F.filter(F.transform(F.filter(blocks, lambda b: b.type == kind), lambda b: b[field]), lambda x: x.isNotNull())
    return of("tool_use", "id"), of("tool_result", "tool_use_id")


def lift_instructions(content: Column) -> tuple[Column, Column]:
    """I4: the text without reminder elements that fill whole lines, and these in order."""
    left = F.regexp_replace(F.regexp_replace(content, REMINDER, ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(left, r"^\s+|\s+$", ""), F.transform(F.regexp_extract_all(content, F.lit(REMINDER), F.lit(0)), lambda x: F.rtrim(x))


def _marked(r: str, counter: Counter) -> Column:
    """One row a tool and system block in order: struct<tokens, ttl, marked>."""
    tools = F.transform(F.col(f"{r}.tools"), lambda t: F.struct(counter(F.concat(F.coalesce(t["name"], F.lit("")), F.coalesce(t.input_schema, F.lit("")))).alias("tokens"), t.cache_control.ttl.alias("ttl"), t.cache_control.isNotNull().alias("marked")))
    system = F.transform(F.col(f"{r}.system"), lambda b: F.struct(F.coalesce(counter(b.text), F.lit(0)).alias("tokens"), b.cache_control.ttl.alias("ttl"), b.cache_control.isNotNull().alias("marked")))
    none = F.array().cast("array<struct<tokens:bigint,ttl:string,marked:boolean>>")
    return F.concat(F.coalesce(tools, none), F.coalesce(system, none))


def prompt_figures(log: DataFrame, counter: Counter = count_tokens) -> DataFrame:
    """request_id, fixed_prompt_tokens, uncached_prefix_tokens (after the last marker), cache_lifetime_s."""
    rows = parsed_requests(log).filter("r is not null").withColumn("p", _marked("r", counter))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x.tokens)
    last = F.coalesce(F.array_max(F.transform("p", lambda x, i: F.when(x.marked, i + 1).otherwise(0))), F.lit(0))
    after = F.slice("p", last + 1, F.greatest(F.lit(1), F.size("p")))
    ttl = F.try_element_at(F.filter("p", lambda x: x.marked), F.lit(-1)).getField("ttl")
    unit = F.element_at(F.create_map(F.lit("s"), F.lit(1.0), F.lit("m"), F.lit(60.0), F.lit("h"), F.lit(3600.0)), F.nullif(F.regexp_extract(ttl, r"^(\d+)([smh])$", 2), F.lit("")))
    life = F.coalesce(F.nullif(F.regexp_extract(ttl, r"^(\d{1,9})([smh])$", 1), F.lit("")).cast("double") * unit, F.lit(DEFAULT_LIFETIME_S))
    return rows.select("request_id", total(F.col("p")).alias("fixed_prompt_tokens"), total(after).alias("uncached_prefix_tokens"), life.alias("cache_lifetime_s"))


def rewrite_overhead(figures: DataFrame, instructions: DataFrame, counter: Counter = count_tokens) -> DataFrame:
    """I8: request_id, overhead_tokens: the uncached prefix, and each distinct instruction once. instructions: request_id, content."""
    told = instructions.distinct().groupBy("request_id").agg(F.sum(counter(F.col("content"))).alias("t"))
    return figures.join(told, "request_id", "left").select("request_id", (F.col("uncached_prefix_tokens") + F.coalesce("t", F.lit(0))).alias("overhead_tokens"))


def plain_name(name: Column) -> Column:
    return F.when((F.char_length(name) <= NAME_CHARS) & ~name.rlike(r"[\p{Cntrl}]"), name)


def reply_outlines(log: DataFrame) -> DataFrame:
    """Log (request_id, status, body) with finished, stop_reason, usage, tool_calls, thinking_key, error_type, refusal."""
    out = log.withColumn("r", F.from_json("body", REPLY))
    calls = F.transform(F.filter("r.content", lambda b: b.type.isin("tool_use", "server_tool_use")), lambda b: F.struct(plain_name(b["name"]).alias("name"), plain_name(b.id).alias("call_id")))
    thinking = F.try_element_at(F.filter("r.content", lambda b: b.type.isin("thinking", "redacted_thinking")), F.lit(1))
    key = F.sha2(F.substring(F.coalesce(thinking.signature, thinking.data), 1, KEY_CHARS), 256)
    usage = {n: F.coalesce(F.col(f"r.usage.{n}"), F.lit(0)) for n in ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens")}
    refusal = F.when(F.col("status") >= 400, F.coalesce(F.substring(F.concat("r.error.type", F.lit(": "), "r.error.message"), 1, REASON_CHARS), F.lit("no readable error")))
    return out.select("request_id", "status", (F.col("status") == 200).alias("finished"), plain_name(F.col("r.stop_reason")).alias("stop_reason"), *(c.alias(n) for n, c in usage.items()), calls.alias("tool_calls"), key.alias("thinking_key"), plain_name(F.col("r.error.type")).alias("error_type"), refusal.alias("refusal"))


def assemble_stream_replies(events: DataFrame) -> DataFrame:
    """Events (request_id, seq, json) to request_id, finished, blocks: deltas of each block joined in order; only finished replies."""
    shape = "struct<type:string,index:bigint,content_block:struct<type:string,name:string>,delta:struct<type:string,text:string,partial_json:string>>"
    read = events.withColumn("e", F.from_json("json", shape))
    done = read.groupBy("request_id").agg(F.bool_or(F.col("e.type") == "message_stop").alias("finished")).filter("finished")
    rows = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("e.delta.text", "e.delta.partial_json").alias("t"))))
    parts = read.filter("e.index is not null").groupBy("request_id", F.col("e.index").alias("index")).agg(F.max("e.content_block.type").alias("type"), F.max("e.content_block.name").alias("name"), F.array_join(F.transform(rows, lambda r: r.t), "").alias("text"))
    blocks = F.array_sort(F.collect_list(F.struct("index", "type", "name", "text")))
    return done.join(parts.groupBy("request_id").agg(blocks.alias("blocks")), "request_id")


def thinking_keys(blocks: Column) -> Column:
    """One key for each thinking block."""
    own = F.filter(blocks, lambda b: b.type.isin("thinking", "redacted_thinking"))
    return F.filter(F.transform(own, lambda b: F.sha2(F.substring(F.coalesce(b.signature, b.data), 1, KEY_CHARS), 256)), lambda k: k.isNotNull())


def attachment_keys(blocks: Column) -> Column:
    """For each image or document a key of its kind, length, and both ends of its data."""
    own = F.filter(blocks, lambda b: b.type.isin("image", "document") & b.source.isNotNull())
    return F.transform(own, lambda b: F.sha2(F.concat_ws("|", b.type, F.char_length(b.source).cast("string"), F.substring(b.source, 1, 256), F.substring(b.source, -256, 256)), 256))


def spawn_prompts(calls: DataFrame) -> DataFrame:
    """Calls (call_id, input) that start a subagent, with prompt."""
    prompt = F.get_json_object("input", "$.prompt")
    return calls.withColumn("prompt", prompt).filter(F.char_length("prompt").between(*PROMPT_CHARS))


def client_origin(value: Column) -> Column:
    """The id if it is one, else null."""
    return F.when(value.rlike(r"^[A-Za-z0-9_-]{1,64}$"), value)
