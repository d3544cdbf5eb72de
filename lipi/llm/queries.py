"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (chat, exact_dedup, hilbert, langid, lexical, nndescent, packing, pii, resampling, sentencepiece_hf,
               separator_scan, substring, superminhash)
from .common import read, sha256_text, shuffled, staged

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query(r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS tl,
    CASE WHEN rn > 1 AND before = role THEN length('<|im_turn|>')
         ELSE length('<|im_start|>') + 1 + length('<|im_end|>') + 1
              + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>')) END AS hl
  FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(tl + hl) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op1_chat_format(spark, sf_dir):
    own = "<|im_end|><|im_start|>assistant ok"
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], rows.schema)
    return chat.chat_digest(chat.format_chats(rows.union(extra)))


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


@query()
def op9_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query()
def op5_near_dedup(spark, sf_dir):
    return superminhash.near_groups(read(spark, sf_dir, "documents"))


@query()
def op7_substring_dedup(spark, sf_dir):
    out = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256_text(F.col("kept_text")).alias("kept_sha256"))


@query()
def op3_harmonic_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@query()
def op6_separator_scan(spark, sf_dir):
    return separator_scan.token_counts(read(spark, sf_dir, "documents"))


@query()
def op10_pii_surrogates(spark, sf_dir):
    """Rewritten texts, with what was found and whether any of a document's
    surrogates fails the global collision check."""
    found = staged(pii.replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark)), "surrogates")
    wrong = pii.collision_check(found).select(F.col("surrogate").alias("s"))
    hit = (found.where(F.size("entities") > 0)
           .select("doc_id", F.explode(F.transform("surrogates", lambda s: F.lower(s))).alias("s"))
           .join(wrong, "s", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_collisions")))
    return found.join(shuffled(hit), "doc_id", "left").select(
        "doc_id", "text", F.size("entities").cast("long").alias("n_entities"),
        F.size(F.array_distinct("surrogates")).cast("long").alias("n_distinct"),
        F.coalesce("n_collisions", F.lit(0)).cast("long").alias("n_collisions"))


@query()
def op2_nn_descent(spark, sf_dir):
    return nndescent.near_vectors(read(spark, sf_dir, "embeddings"))


@query()
def op8_sentencepiece(spark, sf_dir):
    ids = sentencepiece_hf.encode(read(spark, sf_dir, "documents"), with_text=True, with_decoded=True)
    return ids.select(
        "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), sha256_text(F.col("decoded")).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "parity")


@query("""
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
""")
def op11_hilbert_neighbours(spark, sf_dir):
    return hilbert.nearest(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query()
def op12_importance_resampling(spark, sf_dir):
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query(r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS row, doc_id, len(t) AS n, t FROM low WHERE len(t) > 0),
s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
i AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
w AS (SELECT DISTINCT term FROM q),
tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, n, unnest(t) AS term FROM d) SEMI JOIN w USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
c AS (
  SELECT row, doc_id, term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
      * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))) AS part
  FROM tf JOIN df USING (term), s),
r AS (
  SELECT item_id, row, doc_id, CAST(sum(qtf * part) AS BIGINT) AS score
  FROM q JOIN c USING (term) WHERE doc_id IS NOT NULL GROUP BY ALL HAVING sum(qtf * part) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20
""")
def op13_lexical_search(spark, sf_dir):
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
