"""Operator 8, secret scans: multipart credential linking.

Base spans stand alone: assignments to secret-like names, AKIA access identifiers and long hexadecimal runs. Weak candidates
(identifiers and keys that look random but have no such context) are reported only when complementary parts begin within
`scope` code points of their beginning: a weak identifier needs a secret, a weak secret needs an identifier or an endpoint. That is an
interval join: parts fall into bins as wide as the scope; a bin keeps the least and the greatest start of each role, so
a part meets at most three rows a role, however many parts a document has.

A text of any length is scanned whole, in time that grows with its length. Null text counts as empty: no spans. Rows may repeat, and ids may be null: parts meet by a hash of the text, so that alike
texts have alike spans. A column named like an output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, each, give_back, row_key

#: The base patterns. [A-Za-z] classes are spelled out so that no other letter folds to them.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
_either = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
ASSIGN = re.compile(r"""(%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join(map(_either, NAMES)))
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret")
#: Words that ASSIGN needs one of, in lower case.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: Long runs of key characters, and endpoints.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ENDPOINT = re.compile(r"(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]*+://[^\s\"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b")
IDENTIFIER, SECRET, SITE = 0, 1, 2
SCOPE = 300
#: Up to so many linked documents (rows of a few hundred bytes) are broadcast; beyond it Spark shuffles.
FEW = 20_000

SPAN = "struct<kind:int,start:int,end:int>"
PART = "struct<role:int,weak:boolean,start:int,end:int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind."""
    spans = []
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def weak_role(run: str) -> int | None:
    """Whether a run of key characters, not a word or a number, looks like an identifier or a secret."""
    digits = sum(c.isdigit() for c in run)
    upper = sum(c.isupper() for c in run)
    lower = sum(c.islower() for c in run)
    if digits >= 2 and upper >= 6 and not lower:
        return IDENTIFIER
    return SECRET if len(run) >= 20 and digits >= 3 and lower >= 3 and upper >= 2 else None


def parts_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, bool, int, int]]:
    """(role, weak, start, end): weak candidates outside base spans, base spans and endpoints; none if nothing can link."""
    weak, k = [], 0
    for m in RUN.finditer(text):
        role = weak_role(m[0])
        if role is None:
            continue
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        if not any(s < m.end() and e > m.start() for _, s, e in spans[max(0, k - 2) : k + 3]):
            weak.append((role, True, m.start(), m.end()))
    if not weak:
        return []
    known = [(IDENTIFIER if kind == 1 else SECRET, False, s, e) for kind, s, e in spans]
    sites = [(SITE, False, m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    found = weak + known + sites
    return found if len({p[0] for p in found}) > 1 else []


def scan(text: Column) -> Column:
    """struct<base: array<span>, parts: array<part>> of a text column."""

    @F.arrow_udf(f"struct<base:array<{SPAN}>,parts:array<{PART}>>")
    def both(texts: pa.Array) -> pa.Array:
        base, parts = [], []
        for t in each(texts):
            base.append(base_spans(t or ""))
            parts.append(parts_of(t or "", base[-1]))
        span = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end")]))
        part = pa.list_(pa.struct([("role", pa.int32()), ("weak", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))
        named = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b] for b in base]
        roles = [[dict(zip(("role", "weak", "start", "end"), p, strict=True)) for p in ps] for ps in parts]
        give_back()
        return pa.StructArray.from_arrays([pa.array(named, span), pa.array(roles, part)], ["base", "parts"])

    # Else Spark would copy the scan into a filter on its result, with workers of its own.
    return both.asNondeterministic()(text)


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """key, linked (spans of the weak candidates whose complement stands within the scope) from key, role, weak, start, end."""
    parts = parts.withColumn("bin", F.floor(F.col("start") / scope))
    bins = parts.groupBy("key", "bin", "role").agg(F.min("start").alias("least"), F.max("start").alias("most"))
    near = bins.select("key", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("role").alias("other"), "least", "most")
    within = (F.col("least") <= F.col("start") + scope) & (F.col("most") >= F.col("start") - scope)
    wanted = F.when(F.col("role") == IDENTIFIER, F.col("other") == SECRET).otherwise(F.col("other").isin(IDENTIFIER, SITE))
    hits = parts.filter("weak").join(near, ["key", "bin"]).filter(wanted & within)
    kind = F.when(F.col("role") == IDENTIFIER, 3).otherwise(4).cast("int")
    return hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end", kind.alias("kind")))).alias("linked"))


def secret_spans(df: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """df with base_spans and spans, arrays of struct<kind,start,end> by start, then kind (numbers into KINDS)."""
    keyed = df.withColumn("__key", row_key(F.col(text))).withColumn("__scan", scan(F.col(text)))
    # Parts are few beside texts: written once, so that texts are scanned for them once.
    parts = cut(keyed.select(F.col("__key").alias("key"), F.explode("__scan.parts").alias("p")).select("key", "p.*").distinct())
    linked = cut(link(parts, scope)).select(F.col("key").alias("__key"), F.col("linked").alias("__linked"))
    if linked.count() <= FEW:
        linked = F.broadcast(linked)
    found = keyed.join(linked, "__key", "left")
    base = F.transform("__scan.base", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    more = F.transform(F.coalesce("__linked", F.array()), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    spans = F.transform(F.array_sort(F.concat(base, more)), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return found.withColumn("base_spans", F.col("__scan.base")).withColumn("spans", spans).drop("__key", "__scan", "__linked")


def written(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark; spans by start, as secret_spans gives them."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        fresh = s.start >= done.at
        out = F.when(fresh, F.concat(done.out, F.substring(text, done.at + 1, s.start - done.at), F.lit(mark))).otherwise(done.out)
        return F.struct(out.alias("out"), F.greatest(done.at, s.end).alias("at"))

    clean = F.aggregate(spans, start, step, lambda done: F.concat(done.out, F.substring(text, done.at + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, clean).otherwise(text)
