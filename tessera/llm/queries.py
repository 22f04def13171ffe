"""The registered queries of the training-data operators: each applies one with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chat import format_conversations, read_back
from tessera.llm.common import Scratch
from tessera.llm.decontaminate import contamination
from tessera.llm.lexical import ranked_search
from tessera.llm.nn_descent import nearest
from tessera.llm.pii import BASE, personal_data
from tessera.llm.quality import quality_scores
from tessera.llm.repeats import repeated_bytes
from tessera.llm.runs import run_digests, with_repeats
from tessera.llm.secrets import secret_findings
from tessera.llm.simhash import simhash_groups
from tessera.llm.token_store import token_store
from tessera.llm.unigram import round_trip
from tessera.llm.warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_findings(table(spark, sf_dir, "documents"))
    spans = F.concat_ws(",", F.transform("secrets", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))))
    return found.select(
        "doc_id", F.size("candidates").cast("long").alias("n_candidates"), F.size("secrets").cast("long").alias("n_secrets"),
        spans.alias("spans"), F.sha2("redacted", 256).alias("redacted_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), least=0)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10, gram=5)
    listed = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bs AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM bs),
ds AS (
  SELECT doc_id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i
  FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(w) >= l.n),
hits AS (
  SELECT s.doc_id, s.i, s.n, bw.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM ds) s JOIN bw ON s.g = bw.g AND s.n = bw.n),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(found.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(found.ids, '')) AS items_sha256,
  coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _of_kind(kind: str):
    return lambda s: s.kind == kind


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op10_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(Scratch(spark, "chat").keep(format_conversations(rows.unionByName(more)), "formatted"))


def op11_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s.end - s.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP12_SQL = r"""
WITH dt AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM dt WHERE len(w) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
q AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
  FROM benchmark),
p AS MATERIALIZED (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
t AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
x AS (
  SELECT r, doc_id, term, t.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS impact
  FROM p JOIN t USING (term) JOIN d USING (r), s),
c AS (SELECT item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 10
"""


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(with_repeats(table(spark, sf_dir, "documents")))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, 4 + length(role) + 2 + length(text) + 8
    + length(regexp_replace(text, '[^\\]', '', 'g'))
    + length(regexp_replace(text, '[^#]', '', 'g')) - len(regexp_extract_all(text, '#+'))
    + len(regexp_extract_all(text, '<[/|]')) AS size FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(p.h, 1 + (5 * i) // 4, 2) AS INTEGER) >> (3 - (5 * i) % 4)) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN m USING (h)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nn_descent, op2_secrets, op3_simhash, op4_warc_zip, op5_winnowing, op6_weak_supervision, op7_discriminant, op8_elias_fano, op9_unigram, op10_typed_parts, op11_suffix_arrays, op12_threshold_search, op13_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_zip": OP4_SQL, "op5_winnowing": OP5_SQL, "op10_typed_parts": OP10_SQL, "op12_threshold_search": OP12_SQL}
