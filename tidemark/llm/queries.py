"""One registered query per operator, over its whole table, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tidemark.llm import chat, conversation_repair, exact_dedup, hard_negatives, html_text, language_model, mixing, packing, personal_data, quality, sharding, simhash, training_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS tie
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, row_number() OVER by_cap AS nth,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (by_cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (by_cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW by_cap AS (ORDER BY 3 * source_size / w, source NULLS LAST)),
t AS (
  SELECT source, source_size, CAST(CASE WHEN level * w <= 3 * source_size
      THEN (SELECT arg_min(level, nth) FROM l WHERE level * w <= 3 * source_size) * w
      ELSE 3 * source_size END AS DOUBLE) AS target,
    CAST('0x' || substr(md5('0:' || coalesce(source, '')), 1, 6) AS BIGINT) AS start
  FROM l),
g AS (
  SELECT *, CASE WHEN source_size > 0
    THEN CAST(least(floor(target / source_size * 16777216), 3 * 16777216) AS BIGINT) ELSE 0 END AS step
  FROM t),
p AS (
  SELECT d.doc_id, d.size, g.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.tie) AS nth,
    d.size * 100 > g.target AS large
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
f AS (
  SELECT source, count(*) AS n, sum(size) AS size,
    sum(size * (((start + nth * step) >> 24) - ((start + (nth - 1) * step) >> 24))) AS taken
  FROM p WHERE large GROUP BY source),
r AS (
  SELECT p.*, coalesce(f.n, 0) AS larges, CASE WHEN p.source_size - coalesce(f.size, 0) > 0
      THEN CAST(greatest(least(floor((p.target - coalesce(f.taken, 0)) / (p.source_size - coalesce(f.size, 0)) * 16777216),
        3 * 16777216), 0) AS BIGINT) ELSE 0 END AS rest
  FROM p LEFT JOIN f ON p.source IS NOT DISTINCT FROM f.source),
c AS (
  SELECT *, ((start + least(nth, larges) * step + greatest(nth - larges, 0) * rest) >> 24)
    - ((start + least(nth - 1, larges) * step + greatest(nth - 1 - larges, 0) * rest) >> 24) AS copies
  FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies AS BIGINT) AS copies,
  CAST(copies * size AS BIGINT) AS taken
FROM c
"""


@query(MIX_SQL)
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf), weights=(1, 2, 3), cap=3, carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "copies", "taken")


@query()
def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = sharding.shard(documents(spark, sf), n_shards=8, carry=["doc_id"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


@query()
def op3_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data.personal_data(documents(spark, sf), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*personal_data.BASE))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in personal_data.BASE]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@query(
    """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""
)
def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf), carry=["doc_id"])


@query()
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf), carry=["doc_id"])


@query()
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf), carry=["doc_id"]).drop("kept")


@query()
def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)"
    )
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    chats = chat.format_chats(turns.unionByName(more))
    read = chats.withColumn("r", chat.read_back("formatted", "loss_spans"))
    return read.select(
        "conv_id", "r.*", F.char_length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens"
    )


@query()
def op8_main_text(spark: SparkSession, sf: str) -> DataFrame:
    found = html_text.main_texts(spark.read.parquet(f"{sf}/pages.parquet"), carry=["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query()
def op9_training_order(spark: SparkSession, sf: str) -> DataFrame:
    return training_order.read_training_order(training_order.write_training_order(documents(spark, sf)))


@query(
    r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
u AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
g AS (
  SELECT rid, pos, word, lead(word, 1) OVER o AS word2, lead(word, 2) OVER o AS word3
  FROM u WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos, word3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, word2, word3) > 1 AS again FROM g),
v AS (
  SELECT rid, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS covered
  FROM r WINDOW o AS (PARTITION BY rid ORDER BY pos)),
n AS (SELECT rid, count(*) FILTER (WHERE covered) AS n_repeat_words FROM v GROUP BY rid),
k AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM k WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (
  SELECT d.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d JOIN w USING (rid) LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
      OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS rule_failed FROM f),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (WHERE rule_failed) AS failed FROM b GROUP BY source),
p AS (
  SELECT sum(docs) AS docs, sum(failed) / sum(docs) AS mean, count(*) AS hosts, sum(failed * failed / docs) AS squares FROM h),
q AS (
  SELECT mean, CASE WHEN mean * (1 - mean) <= 0 THEN 1.0
    WHEN squares / docs - mean * mean - hosts * mean * (1 - mean) / docs <= 0 THEN 1e6
    ELSE greatest(1.0, least(1e6, mean * (1 - mean) / (squares / docs - mean * mean - hosts * mean * (1 - mean) / docs) - 1))
    END AS strength FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT rule_failed AND (h.failed + mean * strength) / (h.docs + strength) <= 0.8 AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source CROSS JOIN q
"""
)
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(documents(spark, sf), carry=["doc_id"], every_rule=True).drop("host_docs", "host_failed", "host_rate")


@query(
    """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.vec_id AS other, b.rid AS rid, a.label = b.label AS same,
    CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other NULLS LAST, rid) <= 5)
SELECT p.anchor_id, p.other AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.other NULLS LAST, s.rid) AS INTEGER) AS rank,
  s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
)
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults planted by the checksum of (conversation, turn)."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


@query()
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    audits, repaired = conversation_repair.repaired(damaged(turns))
    digests = conversation_repair.digests(repaired).select(F.col("conv_id").alias("digested"), "sha256")
    found = audits.join(digests, audits.conv_id.eqNullSafe(F.col("digested")), "left").withColumnRenamed("conv_id", "audited")
    every = turns.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("audited")), "left")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in conversation_repair.NAMES]
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", none).alias("repaired_sha256")
    )


@query()
def op13_language_model(spark: SparkSession, sf: str) -> DataFrame:
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return language_model.scored(documents(spark, sf), part != 1, carry=["doc_id"])
