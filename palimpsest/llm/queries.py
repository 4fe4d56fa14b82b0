"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe_codec, centroid_clusters, embedding_dedup, html_extract, language_id, lm_score, ngram_join, periodic_runs, quality_rules, secret_scan, source_mixing, token_counts, url_filters
from palimpsest.llm.common import WORD, cut, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.language_id(docs).select("doc_id", "held_out", "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.url_filters(pages, table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", source_mixing.n_words("text").alias("size"), source_mixing.order_key("doc_id", "text").alias("key")))
    return source_mixing.mix(docs, size="size", key="key").select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s.kind == kind)).cast("long")
    base = F.sha2(F.encode(secret_scan.written("base_spans"), "UTF-8"), 256)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), base.alias("base_sha256"), secret_scan.written("spans").alias("spans"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text); by a hash of the id, every tenth text repeats a stretch of its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    found = docs.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("words", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    n, g = F.size("words"), F.col("g")
    found = found.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", F.floor((n - F.col("a")) / (3 + g % 8)).cast("int") + 1)
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    whole = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), n - F.col("a")))
    return found.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.greatest(F.col("runs")))
    best = [F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")]
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, digest(periodic_runs.written(F.col("runs"))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_embedding_dedup, op4_bpe_codec, op5_quality_rules, op6_url_filters, op7_source_mixing, op8_secret_scan, op9_html_extract, op10_ngram_join, op11_centroid_clusters, op12_periodic_runs, op13_lm_score, pipeline)}


def _op3_sql() -> str:
    """Links of every vector by brute force, and components by following links."""
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id,
  coalesce(vec_id = least(vec_id, coalesce(c.b, vec_id)), true) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a"""


def _op6_sql() -> str:
    """The rules in order of length, and the same moments and bounds."""
    rules = sorted(url_filters.RULES, key=lambda r: -len(r[1]))
    fits = lambda rule: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*rule.split("/", 1))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[i]}'" for r in rules) + " END"
    longer = f"regexp_matches(host, '{url_filters.LONG_SUFFIX}')"
    tail = lambda n: f"array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"
    low, high = url_filters.BETWEEN

    def weight(table: str, group: str, parent: str) -> str:
        return f"""SELECT 1 / greatest({low}, least({high}, coalesce(sum(n * pow(k / n - p, 2) - p * (1 - p) * (1 - n / pn)) / nullif(sum(n * (1 - n / pn) * p * (1 - p)), 0), {low}))) - 1 AS w
  FROM (SELECT n, k, sum(n) OVER (PARTITION BY {parent}) AS pn, sum(k) OVER (PARTITION BY {parent}) / sum(n) OVER (PARTITION BY {parent}) AS p FROM {table} WHERE n > 0)"""

    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
o AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
g AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM p),
h AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k, CASE WHEN {longer} THEN {tail(3)} ELSE {tail(2)} END AS domain,
  CASE WHEN {longer} THEN {tail(2)} ELSE {tail(1)} END AS suffix FROM (SELECT DISTINCT page_id, site AS host FROM g) LEFT JOIN o ON page_id = doc_id GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL), s AS (SELECT suffix, '' AS world, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
wh AS ({weight("h", "host", "domain")}), wd AS ({weight("d", "domain", "suffix")}), ws AS ({weight("s", "suffix", "world")}),
ms AS (SELECT suffix, (w * (SELECT sum(k) / nullif(sum(n), 0) FROM s) + k) / (w + n) AS m FROM s, ws),
md AS (SELECT domain, (w * m + k) / (w + n) AS m FROM d JOIN ms USING (suffix), wd),
mh AS (SELECT host, (w * m + k) / (w + n) AS m, w + n AS t FROM h JOIN md USING (domain), wh),
b AS (SELECT host AS site, m + {url_filters.DEVIATIONS} * sqrt(m * (1 - m) / (t + 1)) AS bound FROM mh)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN bound < {url_filters.LEAST_GOOD} THEN 'block' ELSE 'allow' END) AS verdict
FROM g LEFT JOIN b USING (site)"""


def _op7_sql() -> str:
    w = source_mixing.WEIGHTS
    return rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS r FROM d GROUP BY source),
a AS (SELECT *, ([{w[0]}.0, {w[1]}.0, {w[2]}.0]::DOUBLE[])[((r - 1) % 3 + 1)::INT] AS w, ({source_mixing.MOST} * ss)::DOUBLE AS cap, {source_mixing.SHARE} * sum(ss) OVER () AS total FROM s),
l AS (SELECT *, row_number() OVER o AS f, (total::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM a WINDOW o AS (ORDER BY cap / w, r)),
g AS (SELECT source, ss, least(cap, coalesce((SELECT arg_min(level, f) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l),
x AS (SELECT doc_id, size, ss, target, round(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, ss AS source_size, target,
  (CASE WHEN ss > 0 THEN budget // ss ELSE 0 END * size + greatest(0, least(size, budget - CASE WHEN ss > 0 THEN budget // ss ELSE 0 END * ss - start)))::BIGINT AS taken FROM x"""


def _op11_sql() -> str:
    """Rounds one after another; whole numbers in doubles, exact below 2**53."""
    far = "list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c)"
    k = centroid_clusters.K
    out = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({centroid_clusters.SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {centroid_clusters.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e AS c FROM (SELECT *, sha256('{centroid_clusters.SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v) ORDER BY h, e LIMIT {k})"""
    for i in range(centroid_clusters.ROUNDS + 1):
        out += f""",
a{i} AS (SELECT rowid_ AS r, any_value(vec_id) AS vec_id, any_value(e) AS e, min({k} * ({far}) + k)::BIGINT AS m FROM (SELECT *, row_number() OVER () AS rowid_ FROM v), c{i} GROUP BY rowid_)"""
        if i < centroid_clusters.ROUNDS:
            out += f""",
s{i} AS (SELECT m % {k} AS k, j, floor(sum(e[j]) / count(*)) AS x FROM a{i}, range(1, {centroid_clusters.DIMS + 1}) AS t(j) GROUP BY 1, 2),
c{i + 1} AS (SELECT c{i}.k, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT k, list(x ORDER BY j) AS c FROM s{i} GROUP BY k) n USING (k))"""
    last = centroid_clusters.ROUNDS
    return f"""{out}
SELECT vec_id, (m % {k})::INT AS cluster, m // {k} AS distance, sum(m // {k}) OVER (PARTITION BY m % {k})::BIGINT AS cluster_inertia, sum(m // {k}) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON m % {k} = k"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clusters": _op11_sql(), "op3_embedding_dedup": _op3_sql(), "op6_url_filters": _op6_sql(), "op7_source_mixing": _op7_sql()}
