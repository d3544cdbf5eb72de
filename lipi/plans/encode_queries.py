"""Encode / decode / alignment / evaluation queries over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import (DEFAULT_EVAL_LINES, DEFAULT_STATS_LINES, HUE_MOD, LIGHT_BASE,
                      LIGHT_MOD, SAT_BASE, SAT_MOD, UNK_ID)
from ..functions import sql as sql_functions
from ..functions import text as tx
from ..functions.ids import md5_bucket
from ..operators import encode as en
from ..operators import evaluate as ev
from ..session import ensure_checkpoint_dir, first_by_key, first_n, keep_rows, read_table
from ..sources import artefacts
from ..sources import corpus as corpus_src
from . import sqltext as S
from .corpus_queries import ASCII, WIDE, eval_lines_of, raw_sample
from .model_queries import ORACLE_STEPS, merges_df, model_of, train_prefix, vocab_df
from .registry import query

DOC = ["doc_id"]
CONV = ["conv_id", "turn"]


def _enc(tag, src, keys, text):
    return S.encode_full_ctes(src, keys, text, ORACLE_STEPS, tag)


def enc_docs(spark, sf):
    return en.encode(spark, read_table(spark, sf, "documents"), model_of(spark, sf), "doc_id", "text")


def ids_docs(spark, sf, keys=DOC):
    return en.encode_ids(spark, read_table(spark, sf, "documents"), model_of(spark, sf), keys, "text")


def ids_convs(spark, sf):
    return en.encode_ids(spark, read_table(spark, sf, "conversations"), model_of(spark, sf), CONV, "text")


def enc_convs(spark, sf):
    return en.encode(spark, read_table(spark, sf, "conversations"), model_of(spark, sf), CONV, "text")


def _summary_sql(keys, tag=""):
    K = ", ".join(keys)
    return (f"SELECT {K}, array_to_string(ids, ',') AS ids_csv, len(ids)::INT AS token_count, "
            f"(CASE WHEN len(ids) > 0 THEN length(text) / len(ids) ELSE 0.0 END)::DOUBLE AS compression_ratio "
            f"FROM enc{tag}")


def _summary(encoded, keys):
    return en.encode_summary(encoded, keys).select(*keys, "ids_csv", "token_count", "compression_ratio")


@query("encode_documents", f"WITH {train_prefix()},\n{_enc('', 'documents', DOC, 'text')}\n{_summary_sql(DOC)}")
def encode_documents(spark, sf):
    return _summary(ids_docs(spark, sf), DOC)


@query("encode_conversations", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n{_summary_sql(CONV)}")
def encode_conversations(spark, sf):
    return _summary(ids_convs(spark, sf), CONV)


@query("encode_benchmark", f"WITH {train_prefix()},\n{_enc('', 'benchmark', ['item_id'], 'text')}\n{_summary_sql(['item_id'])}")
def encode_benchmark(spark, sf):
    """Held-out items encoded with the vocabulary of the documents."""
    e = en.encode_ids(spark, read_table(spark, sf, "benchmark"), model_of(spark, sf), "item_id", "text")
    return _summary(e, ["item_id"])


@query("encode_dictionary", f"WITH {train_prefix()},\n{_enc('', 'documents', DOC, 'text')}\n"
       "SELECT doc_id, array_to_string(ids, ',') AS ids_csv, len(ids)::INT AS token_count FROM enc")
def encode_dictionary(spark, sf):
    """encode_documents by a dictionary of the corpus's distinct words."""
    e = en.encode_dictionary(spark, read_table(spark, sf, "documents"), model_of(spark, sf), "doc_id", "text")
    return e.select("doc_id", en.ids_csv(F.col("ids")).alias("ids_csv"), F.size("ids").cast("int").alias("token_count"))


@query("encode_saved", f"WITH {train_prefix()},\n{_enc('', 'benchmark', ['item_id'], 'text')}\n{_summary_sql(['item_id'])}")
def encode_saved(spark, sf):
    """Save the model as artefacts in the shared folder, load them, encode."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lipi-model-{uuid.uuid4().hex}"
    artefacts.save_model(vocab_df(spark, sf), merges_df(spark, sf), path)
    model = artefacts.load_model(spark, path)[2]
    return _summary(en.encode_ids(spark, read_table(spark, sf, "benchmark"), model, "item_id", "text"), ["item_id"])


@query("sql_encode", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n"
       "SELECT conv_id, turn, array_to_string(ids, ',') AS ids_csv, array_to_string(tokens, ' ') AS decoded FROM enc")
def sql_encode(spark, sf):
    """Encoding and decoding as functions in SQL text."""
    sql_functions.register(spark, model_of(spark, sf), "lipi")
    return spark.sql("""
        WITH e AS (SELECT conv_id, turn, lipi_encode(lipi_pieces(text)) AS ids FROM {conversations})
        SELECT conv_id, turn, array_join(transform(ids, i -> string(i)), ',') AS ids_csv, lipi_decode(ids) AS decoded FROM e""",
                     conversations=read_table(spark, sf, "conversations"))


@query("sql_tokens", f"WITH {train_prefix()},\n{_enc('', 'benchmark', ['item_id'], 'text')}\n"
       "SELECT item_id, token_idx, token, id, start, \"end\" FROM tk")
def sql_tokens(spark, sf):
    """The table function: one row per token, in SQL text."""
    sql_functions.register(spark, model_of(spark, sf), "lipi")
    return spark.sql("""
        SELECT b.item_id, t.token_idx, t.token, t.id, t.start, t.end
        FROM (SELECT item_id, lipi_pieces(text) AS p FROM {benchmark}) b, LATERAL lipi_tokens(b.p) t""",
                     benchmark=read_table(spark, sf, "benchmark"))


@query("encode_csv", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n"
       "SELECT conv_id, turn, array_to_string(ids, ',') AS ids_csv FROM enc")
def encode_csv(spark, sf):
    return ids_convs(spark, sf).select(*CONV, en.ids_csv(F.col("ids")).alias("ids_csv"))


@query("encode_stats", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n"
       "SELECT conv_id, turn, len(ids)::INT AS token_count, r AS compression_ratio, printf('%.2f', r) AS ratio_text FROM "
       "(SELECT *, (CASE WHEN len(ids) > 0 THEN length(text) / len(ids) ELSE 0.0 END)::DOUBLE AS r FROM enc)")
def encode_stats(spark, sf):
    e = ids_convs(spark, sf)
    r = en.compression_ratio(F.col("text"), F.col("ids"))
    return e.select(*CONV, F.size("ids").cast("int").alias("token_count"), r.alias("compression_ratio"),
                    en.ratio_text(r).alias("ratio_text"))


@query("token_json", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n"
       "SELECT d.conv_id, d.turn, '[' || coalesce(x.j, '') || ']' AS token_json FROM conversations d LEFT JOIN "
       "(SELECT conv_id, turn, string_agg('{\"idx\": ' || token_idx || ', \"token\": ' || "
       + S.json_token("token") + " || ', \"id\": ' || id || '}', ', ' ORDER BY token_idx) AS j FROM tk GROUP BY conv_id, turn) x "
       "USING (conv_id, turn)")
def token_json(spark, sf):
    e = enc_convs(spark, sf)
    return e.select(*CONV, en.token_json(e).alias("token_json"))


@query("tokenize_rows", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n"
       "SELECT conv_id, turn, array_to_string(tokens, ' ') AS tokens, array_to_string(ids, ',') AS ids FROM enc")
def tokenize_rows(spark, sf):
    """The batch tokenize endpoint as a table transform: tokens and ids."""
    e = enc_convs(spark, sf)
    return e.select(*CONV, F.array_join("tokens", " ").alias("tokens"), en.ids_csv(F.col("ids")).alias("ids"))


@query("token_offsets", f"WITH {train_prefix()},\n{_enc('', 'documents', DOC, 'text')}\n"
       "SELECT doc_id, token_idx, token, id, start, \"end\" FROM tk")
def token_offsets(spark, sf):
    return en.token_offsets(enc_docs(spark, sf), DOC)


@query("token_offsets_nfkc", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n"
       "SELECT conv_id, turn, token_idx, token, id, start, \"end\" FROM tk")
def token_offsets_nfkc(spark, sf):
    """Offsets into texts written full width: NFKC brings back the plain text
    character by character, so tokens and spans are those of the plain text."""
    wide = read_table(spark, sf, "conversations").select(*CONV, F.translate("text", ASCII, WIDE).alias("text"))
    return en.token_offsets(en.encode(spark, wide, model_of(spark, sf), CONV, "text"), CONV)


@query("ids_to_tokens", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n"
       "SELECT conv_id, turn, token_idx, id, v.token AS token FROM tk JOIN vocab v USING (id)")
def ids_to_tokens(spark, sf):
    """ids -> tokens with the vocabulary as a lookup (convert_ids_to_tokens)."""
    m = model_of(spark, sf)
    e = enc_convs(spark, sf)
    toks = en.id_tokens(F.col("ids"), m)
    z = F.arrays_zip(F.col("ids").alias("id"), toks.alias("token"))
    return (e.select(*CONV, F.posexplode(z).alias("token_idx", "t"))
            .select(*CONV, F.col("token_idx").cast("int"), F.col("t.id").alias("id"), F.col("t.token").alias("token")))


@query("encode_ids", f"WITH {train_prefix()},\n{_enc('', 'benchmark', ['item_id'], 'text')}\n"
       "SELECT item_id, token_idx, token, id FROM tk")
def encode_ids(spark, sf):
    """tokens -> ids, unknown characters as id 1."""
    e = en.encode(spark, read_table(spark, sf, "benchmark"), model_of(spark, sf), "item_id", "text")
    return en.token_offsets(e, ["item_id"]).select("item_id", "token_idx", "token", "id")


@query("word_positions", f"WITH {S.word_positions_cte('documents', DOC, 'text')} SELECT * FROM wp")
def word_positions(spark, sf):
    return en.word_positions(read_table(spark, sf, "documents"), "doc_id", "text")


_OVERLAP = (f"WITH {train_prefix()},\n{_enc('', 'documents', DOC, 'text')},\n"
            f"{S.word_positions_cte('documents', DOC, 'text')},\n"
            "ov AS MATERIALIZED (SELECT tk.doc_id, tk.token_idx, tk.id, wp.word_idx, wp.word FROM tk JOIN wp "
            "ON tk.doc_id = wp.doc_id AND tk.start < wp.\"end\" AND tk.\"end\" > wp.start)\n")


def _spanned(spark, sf):
    """Encoded documents with their words and per-token word ranges, all
    computed inside each document row (no join, no shuffle)."""
    return en.token_word_spans(enc_docs(spark, sf))


@query("token_word_overlap", _OVERLAP + "SELECT doc_id, token_idx, word_idx FROM ov")
def token_word_overlap(spark, sf):
    return en.overlap_pairs(_spanned(spark, sf), DOC).select("doc_id", "token_idx", "word_idx")


@query("token_word_join", _OVERLAP + "SELECT doc_id, token_idx, word_idx FROM ov")
def token_word_join(spark, sf):
    """The same pairs from two separate tables of spans: token offsets and
    word positions, joined by blocks of text."""
    tokens = token_offsets(spark, sf).select("doc_id", "token_idx", "start", "end")
    words = word_positions(spark, sf).select("doc_id", "word_idx", "start", "end")
    return en.overlap_join(tokens, words, DOC).select("doc_id", "token_idx", "word_idx")


@query("token_word_map", _OVERLAP +
       "SELECT doc_id, token_idx, string_agg(word_idx::VARCHAR, ',' ORDER BY word_idx) AS word_idxs FROM ov GROUP BY 1, 2")
def token_word_map(spark, sf):
    r = en.token_word_ranges(_spanned(spark, sf), DOC).filter(F.col("hi") > F.col("lo"))
    idxs = F.transform(F.sequence("lo", F.col("hi") - 1), lambda x: x.cast("string"))
    return r.select("doc_id", "token_idx", F.array_join(idxs, ",").alias("word_idxs"))


@query("token_labels", _OVERLAP +
       "SELECT tk.doc_id, tk.token_idx, coalesce(array_to_string(lb.ws, ', '), '') AS label FROM tk LEFT JOIN "
       "(SELECT doc_id, token_idx, arg_min(word, word_idx, 2) AS ws FROM ov GROUP BY 1, 2) lb USING (doc_id, token_idx)")
def token_labels(spark, sf):
    r = en.token_word_ranges(_spanned(spark, sf), DOC)
    return r.select("doc_id", "token_idx", en.token_label(F.col("lo"), F.col("hi"), F.col("wt")).alias("label"))


@query("word_first_token", _OVERLAP +
       "SELECT wp.doc_id, wp.word_idx, arg_min(ov.id, ov.token_idx) AS token_id "
       "FROM wp LEFT JOIN ov USING (doc_id, word_idx) GROUP BY 1, 2")
def word_first_token(spark, sf):
    """Every word with the id of its first token (NULL: no token)."""
    w = en.word_token_ranges(_spanned(spark, sf), DOC)
    return w.select("doc_id", "word_idx", F.when(F.col("thi") > F.col("tlo"), F.get("ids", F.col("tlo"))).alias("token_id"))


@query("word_token_lists", _OVERLAP +
       "SELECT wp.doc_id, wp.word_idx, coalesce(string_agg(ov.token_idx::VARCHAR, ',' ORDER BY ov.token_idx), '') AS token_idxs "
       "FROM wp LEFT JOIN ov USING (doc_id, word_idx) GROUP BY 1, 2")
def word_token_lists(spark, sf):
    """Every word with the indices of its tokens (empty: no token)."""
    w = en.word_token_ranges(_spanned(spark, sf), DOC)
    return w.select("doc_id", "word_idx", en.index_list(F.col("tlo"), F.col("thi")).alias("token_idxs"))


def _md5_sql(m):
    return (f"list_reduce(list_transform(string_split(md5(id::VARCHAR), ''), lambda d: "
            f"strpos('0123456789abcdef', d) - 1), lambda a, d: (a * 16 + d) % {m}, 0)")


@query("md5_bucket", f"WITH {train_prefix()} SELECT id, {_md5_sql(HUE_MOD)}::INT AS hue, "
       f"({SAT_BASE} + {_md5_sql(SAT_MOD)})::INT AS saturation, ({LIGHT_BASE} + {_md5_sql(LIGHT_MOD)})::INT AS lightness FROM vocab")
def md5_bucket_q(spark, sf):
    """Colour key of every token id: md5 of the id text as a 128-bit number,
    reduced modulo 360 / 30 / 15."""
    v = vocab_df(spark, sf)
    key = F.col("id").cast("string")
    return v.select("id", md5_bucket(key, HUE_MOD).cast("int").alias("hue"),
                    (F.lit(SAT_BASE) + md5_bucket(key, SAT_MOD)).cast("int").alias("saturation"),
                    (F.lit(LIGHT_BASE) + md5_bucket(key, LIGHT_MOD)).cast("int").alias("lightness"))


@query("decode_documents", f"WITH {train_prefix()},\n{_enc('', 'documents', DOC, 'text')}\n"
       "SELECT doc_id, array_to_string(tokens, ' ') AS text, 'ok' AS status FROM enc")
def decode_documents(spark, sf):
    m = model_of(spark, sf)
    return en.decode(ids_docs(spark, sf), m, "doc_id", "ids").select("doc_id", "text", "status")


# Id lists as users send them: plain, with blank items, with a word, with
# spaces, negative, and with an id past the vocabulary.
_BROKEN = ("CASE conv_id % 6 WHEN 1 THEN s || ',, ,' WHEN 2 THEN s || ',x' WHEN 3 THEN ' ' || replace(s, ',', ' , ') || chr(9) "
           "WHEN 4 THEN '-1,' || s WHEN 5 THEN s || ',99999999' ELSE s END")


def _sent_lists(spark, sf):
    csv = ids_convs(spark, sf).select(*CONV, en.ids_csv(F.col("ids")).alias("s"))
    return csv.select(*CONV, F.expr(_BROKEN).alias("ids_csv"))


@query("decode_rows", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n"
       "SELECT conv_id, turn, CASE WHEN conv_id % 6 IN (2, 4) THEN NULL ELSE array_to_string(tokens, ' ') END AS text, "
       "CASE WHEN conv_id % 6 IN (2, 4) THEN 'invalid_id_list' WHEN conv_id % 6 = 5 THEN 'unknown_id' ELSE 'ok' END AS status FROM enc")
def decode_rows(spark, sf):
    """The decode endpoint over a table of CSV id strings."""
    m = model_of(spark, sf)
    d = en.decode(_sent_lists(spark, sf).withColumn("k", F.struct(*CONV)), m, "k", "ids_csv")
    return d.select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"), "text", "status")


@query("parse_ids", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n"
       "SELECT conv_id, turn, CASE WHEN conv_id % 6 IN (2, 4) THEN NULL ELSE len(ids) + (conv_id % 6 = 5)::INT END::INT AS n_ids, "
       "conv_id % 6 NOT IN (2, 4) AS valid FROM enc")
def parse_ids_q(spark, sf):
    sent = _sent_lists(spark, sf)
    p = en.parse_ids(F.col("ids_csv"))
    return sent.select(*CONV, F.when(p["valid"], F.size(p["ids"])).cast("int").alias("n_ids"), p["valid"].alias("valid"))


@query("round_trip", f"WITH {train_prefix()},\n{_enc('', 'documents', DOC, 'text')}\n"
       "SELECT doc_id, array_to_string(tokens, ' ') = text AS lossless FROM enc")
def round_trip(spark, sf):
    """decode(encode(text)) == text, per document (decode joins by spaces,
    so any text with adjacent pre-tokens is lossy)."""
    m = model_of(spark, sf)
    # The original text rides in the key, so the comparison stays in the row.
    e = ids_docs(spark, sf).withColumn("k", F.struct("doc_id", "text"))
    d = en.decode(e, m, "k", "ids")
    return d.select(F.col("doc_id.doc_id").alias("doc_id"),
                    (F.col("text") == F.col("doc_id.text")).alias("lossless"))


_REALIGN = (f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')},\n"
            "dec AS (SELECT conv_id, turn, array_to_string(tokens, ' ') AS text, ids AS given FROM enc),\n"
            f"{_enc('_b', 'dec', CONV, 'text')},\n{S.word_positions_cte('dec', CONV, 'text', 'wp2')},\n"
            "ov2 AS MATERIALIZED (SELECT tk_b.conv_id, tk_b.turn, tk_b.token_idx, wp2.word_idx, wp2.word FROM tk_b JOIN wp2 "
            "ON tk_b.conv_id = wp2.conv_id AND tk_b.turn = wp2.turn AND tk_b.start < wp2.\"end\" AND tk_b.\"end\" > wp2.start),\n"
            "g AS (SELECT conv_id, turn, unnest(given) AS id, unnest(range(0, len(given))) AS token_idx FROM dec)\n")


def _realigned(spark, sf):
    """Decode given ids, re-encode the decoded text, and find words and
    tokens of the decoded text; the given ids ride along as a key column, so
    everything meets in one row."""
    m = model_of(spark, sf)
    given = enc_convs(spark, sf).select(*CONV, "ids")
    dec = en.decode(given.withColumn("k", F.struct(*CONV)), m, "k", "ids") \
        .select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"), "ids", "text")
    return en.token_word_spans(en.encode(spark, dec.select(*CONV, F.col("ids").alias("given"), "text"), m,
                                         CONV + ["given"], "text"))


@query("decode_align", _REALIGN +
       "SELECT g.conv_id, g.turn, g.token_idx::INT AS token_idx, g.id::INT AS id, "
       "coalesce(array_to_string(lb.ws, ', '), '') AS label FROM g LEFT JOIN "
       "(SELECT conv_id, turn, token_idx, arg_min(word, word_idx, 2) AS ws FROM ov2 GROUP BY 1, 2, 3) lb "
       "USING (conv_id, turn, token_idx)")
def decode_align(spark, sf):
    """Each *given* id labelled, by index, with the words of the decoded text
    that the re-encoded token overlaps."""
    sp = _realigned(spark, sf)
    # Label of re-encoded token i goes to given id i (an index match, as in
    # the original; indices past the re-encoding get no label).
    labels = F.transform("lo", lambda lo, i: en.token_label(lo, F.col("hi")[i], F.col("wt")))
    # Labels are projected once, then the given ids are exploded next to
    # them (labels[i] inside a transform over ids would rebuild the array
    # for every id).
    lab = sp.select(*CONV, "given", labels.alias("labels"))
    return (lab.select(*CONV, "labels", F.posexplode("given").alias("token_idx", "id"))
            .select(*CONV, F.col("token_idx").cast("int"), F.col("id").cast("int"),
                    F.coalesce(F.try_element_at("labels", F.col("token_idx") + 1), F.lit("")).alias("label")))


@query("decode_words", _REALIGN +
       "SELECT w.conv_id, w.turn, w.word_idx, w.word, coalesce(o.idxs, '') AS token_idxs, g.id::INT AS id FROM wp2 w LEFT JOIN "
       "(SELECT conv_id, turn, word_idx, min(token_idx) AS first, string_agg(token_idx::VARCHAR, ',' ORDER BY token_idx) AS idxs "
       "FROM ov2 GROUP BY 1, 2, 3) o USING (conv_id, turn, word_idx) "
       "LEFT JOIN g ON g.conv_id = w.conv_id AND g.turn = w.turn AND g.token_idx = o.first")
def decode_words(spark, sf):
    """The word side: each word of the decoded text with its re-encoded token
    indices and the *given* id at the first of them (NULL when there is no
    token, or the index lies past the given ids)."""
    w = en.word_token_ranges(_realigned(spark, sf), CONV, ids="given")
    has = (F.col("thi") > F.col("tlo")) & (F.col("tlo") < F.size("ids"))
    return w.select(*CONV, "word_idx", "word", en.index_list(F.col("tlo"), F.col("thi")).alias("token_idxs"),
                    F.when(has, F.get("ids", F.col("tlo"))).cast("int").alias("id"))


# ---- evaluation ------------------------------------------------------------------
def _metrics_sql(tag, words_expr="len(list_filter(regexp_split_to_array(text, " + S.q(tx.WS_PY + "+") + "), lambda x: x <> ''))"):
    return (f"SELECT count(*)::BIGINT AS sentences, sum(length(replace(text, ' ', '')))::BIGINT AS chars_no_space, "
            f"sum(len(ids))::BIGINT AS tokens, "
            f"(CASE WHEN count(*) > 0 THEN sum(len(ids)) / count(*) END)::DOUBLE AS tokens_per_sentence, "
            f"(sum(len(ids)) / greatest(1, sum({words_expr})))::DOUBLE AS tokens_per_word, "
            f"(sum(length(replace(text, ' ', ''))) / greatest(1, sum(len(ids))))::DOUBLE AS compression_ratio, "
            f"(sum(len(list_filter(ids, lambda i: i = {UNK_ID}))) / greatest(1, sum(len(ids))))::DOUBLE AS unk_rate FROM enc{tag}")


_SAMPLE_SQL = (f"samp AS (SELECT doc_id, e AS text FROM (SELECT doc_id, {S.eval_clean('clean')} AS e FROM corpus) "
               f"WHERE e <> '' ORDER BY doc_id LIMIT {DEFAULT_EVAL_LINES})")


def _first_lines(docs, n):
    """The first n evaluation lines by doc_id, those without one before all."""
    unnamed = eval_lines_of(docs.where(F.col("doc_id").isNull()))
    named = first_by_key(docs, "doc_id", n, eval_lines_of)
    return first_n(unnamed.unionByName(named), n, "doc_id")


@query("eval_metrics", f"WITH {train_prefix()},\n{_SAMPLE_SQL},\n{_enc('', 'samp', DOC, 'text')}\n{_metrics_sql('')}")
def eval_metrics(spark, sf):
    """The trainer's evaluation: first 1,000 non-empty lines of the corpus.
    Only the documents of the lowest ids are cleaned for it."""
    samp = _first_lines(read_table(spark, sf, "documents"), DEFAULT_EVAL_LINES).withColumnRenamed("line", "text")
    return ev.metrics(en.encode_ids(spark, samp, model_of(spark, sf), "doc_id", "text"))


@query("eval_by_lang", f"""WITH {train_prefix()},
lines AS (SELECT doc_id, lang, (pos - 1)::INT AS line_no, {S.eval_clean('line')} AS text FROM (
  SELECT doc_id, lang, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT doc_id, lang, {S.file_lines('text')} AS l FROM documents))),
src AS (SELECT doc_id, line_no, lang, text FROM lines WHERE text <> ''),
{_enc('', 'src', ['doc_id', 'line_no'], 'text')}
SELECT lang, sentences, chars_no_space, tokens, tokens_per_sentence, tokens_per_word, compression_ratio, unk_rate FROM (
  SELECT s.lang, count(*)::BIGINT AS sentences, sum(length(replace(e.text, ' ', '')))::BIGINT AS chars_no_space,
         sum(len(e.ids))::BIGINT AS tokens, (sum(len(e.ids)) / count(*))::DOUBLE AS tokens_per_sentence,
         (sum(len(e.ids)) / greatest(1, sum(len(list_filter(regexp_split_to_array(e.text, {S.q(tx.WS_PY + '+')}), lambda x: x <> '')))))::DOUBLE AS tokens_per_word,
         (sum(length(replace(e.text, ' ', ''))) / greatest(1, sum(len(e.ids))))::DOUBLE AS compression_ratio,
         (sum(len(list_filter(e.ids, lambda i: i = {UNK_ID}))) / greatest(1, sum(len(e.ids))))::DOUBLE AS unk_rate
  FROM enc e JOIN src s USING (doc_id, line_no) GROUP BY s.lang)""")
def eval_by_lang(spark, sf):
    """Evaluation over every non-empty line of every document, per language
    (the vocabulary knows only the characters the cleaned corpus kept)."""
    lines = corpus_src.document_lines(read_table(spark, sf, "documents"), carry=["lang"])
    rows = keep_rows(lines.select("doc_id", "line_no", "lang", tx.eval_clean(F.col("line")).alias("text")),
                     F.col("text") != "")
    e = en.encode_ids(spark, rows, model_of(spark, sf), ["doc_id", "line_no", "lang"], "text")
    return ev.metrics(e, group=["lang"])


@query("unk_by_lang", f"""WITH {train_prefix()},\n{_enc('', 'documents', DOC, 'text')}
SELECT d.lang, sum(len(e.ids))::BIGINT AS tokens, sum(len(list_filter(e.ids, lambda i: i = {UNK_ID})))::BIGINT AS unk,
       (sum(len(list_filter(e.ids, lambda i: i = {UNK_ID}))) / greatest(1, sum(len(e.ids))))::DOUBLE AS unk_rate
FROM enc e JOIN documents d USING (doc_id) GROUP BY d.lang""")
def unk_by_lang(spark, sf):
    e = ids_docs(spark, sf, ["doc_id", "lang"])
    n = F.size("ids")
    u = F.size(F.filter("ids", lambda i: i == UNK_ID))
    return (e.groupBy("lang").agg(F.sum(n).cast("long").alias("tokens"), F.sum(u).cast("long").alias("unk"))
            .select("lang", "tokens", "unk",
                    (F.col("unk") / F.greatest(F.lit(1), F.col("tokens"))).cast("double").alias("unk_rate")))


@query("eval_metrics_n", f"""WITH {train_prefix()},
raw AS (SELECT doc_id, (pos - 1)::INT AS line_no, line FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT doc_id, {S.file_lines('text')} AS l FROM documents)) WHERE line <> '' ORDER BY doc_id, line_no LIMIT {DEFAULT_STATS_LINES}),
src AS (SELECT doc_id, line_no, c AS text FROM (SELECT doc_id, line_no, {S.rr(S.py_strip('line'), tx.WS_PY + '+')} AS c FROM raw) WHERE c <> ''),
{_enc('', 'src', ['doc_id', 'line_no'], 'text')},
w AS (SELECT text, ids, greatest(1, len(list_filter(regexp_split_to_array(text, {S.q(tx.WS_PY + '+')}), lambda x: x <> ''))) AS nw FROM enc)
SELECT count(*)::BIGINT AS sentences, coalesce(sum(length(replace(text, ' ', ''))), 0)::BIGINT AS chars_no_space,
       coalesce(sum(len(ids)), 0)::BIGINT AS tokens,
       (CASE WHEN count(*) > 0 THEN sum(len(ids)) / count(*) ELSE 0 END)::DOUBLE AS tokens_per_sentence,
       (CASE WHEN sum(nw) > 0 THEN sum(len(ids)) / sum(nw) ELSE 0 END)::DOUBLE AS tokens_per_word,
       (CASE WHEN sum(len(ids)) > 0 THEN sum(length(replace(text, ' ', ''))) / sum(len(ids)) ELSE 0 END)::DOUBLE AS compression_ratio,
       (CASE WHEN sum(len(ids)) > 0 THEN sum(len(list_filter(ids, lambda i: i = {UNK_ID}))) / sum(len(ids)) ELSE 0 END)::DOUBLE AS unk_rate
FROM w""")
def eval_metrics_n(spark, sf):
    """The stats endpoint: first 500 non-empty raw lines, `re` cleaning,
    words counted as max(1, n) per line, zero instead of no value."""
    raw = raw_sample(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    src = keep_rows(raw.select("doc_id", "line_no", tx.collapse_ws(tx.py_strip(F.col("line"))).alias("text")),
                    F.col("text") != "")
    e = en.encode_ids(spark, src, model_of(spark, sf), ["doc_id", "line_no"], "text")
    return ev.metrics(e, words_floor_one=True, zero_when_empty=True)
