"""The queries of the training-data operators, as thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embed_dedup, minhash, mixing, pii, quality, secrets, suffix_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _span_digest(found: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Counts, base digest and all spans of ``spans``; the first ``kinds`` are the base."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    at = F.array(*(F.lit(k) for k in pii.KINDS))
    key = lambda s: F.struct(s["start"].alias("start"), F.array_position(at, s["kind"]).alias("at"), s["kind"].alias("kind"), s["end"].alias("end"))
    ordered = lambda spans: F.array_sort(F.transform(spans, key))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(_joined(ordered(F.col("base"))), 256).alias("base_sha256"), _joined(ordered(F.concat("base", "added"))).alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two deliveries; the second scan finds in the ledger what the first one has seen."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).cast("long").alias("version"), "text")
    later = F.xxhash64("path") < 0
    paths, ledger = secrets.scan(docs.where(~later))
    more, ledger = secrets.scan(docs.where(later), ledger)
    found = secrets.findings(paths.unionByName(more), ledger)
    return _span_digest(found.withColumnRenamed("path", "doc_id"), ("assign", "access", "hex"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", "expected_grade", "p_best", (F.col("p_best") >= quality.KEEP).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.count_tokens(table(spark, sf_dir, "documents"), split=token_counts.lines)
    of = lambda name: F.aggregate(F.filter("sections", lambda s: s["name"] == name), F.lit(0.0), lambda a, s: a + s["tokens"]).cast("long").alias(f"{name}_tokens")
    return got.select("doc_id", "n_tokens", "n_crossing", of("head"), of("body"), of("tail"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    chats = chat.format_chats(chat.linear(rows.unionByName(extra)))
    turns = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        F.col("tree").alias("conv_id"),
        F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    length(role) + length(text)
      + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''))
      + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
      + length('### ') + length(':') + 1 + length('</turn>') + 1 AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v
  UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other
), comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM w UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, comp.component_id, w.doc_id = comp.component_id AS kept
FROM w JOIN comp ON comp.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_decontamination": op2_decontamination,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_quality": op5_quality,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_minhash": op8_minhash,
        "op9_chat_format": op9_chat_format,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding_dedup": OP6_SQL, "op8_minhash": OP8_SQL, "op9_chat_format": OP9_SQL}
