"""Corpus build queries: lines, cleaning, filters, samples, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_EVAL_LINES, DEFAULT_STATS_LINES
from ..functions import text as tx
from ..operators import clean as cl
from ..operators import counts as ct
from ..session import first_by_key, keep_rows, read_table
from ..sources import corpus as src
from . import sqltext as S
from .registry import query

HEAD_LINES = 500
TOP_PAIRS = 64


def corpus(spark, sf):
    """The training corpus: cleaned documents kept when > 30 characters."""
    return cl.clean_corpus(read_table(spark, sf, "documents"))


@query("corpus_lines", f"""
SELECT doc_id, (pos - 1)::INT AS line_no, line FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT doc_id, {S.file_lines('text')} AS l FROM documents))""")
def corpus_lines(spark, sf):
    return src.document_lines(read_table(spark, sf, "documents"))


@query("strip_lines", f"""
SELECT doc_id, (pos - 1)::INT AS line_no, {S.py_strip('line')} AS line FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT doc_id, {S.file_lines('text')} AS l FROM documents))""")
def strip_lines(spark, sf):
    return src.strip_lines(corpus_lines(spark, sf))


@query("clean_documents", f"""
SELECT doc_id, c AS clean, length(c)::INT AS n_chars
FROM (SELECT doc_id, {S.clean_line('text')} AS c FROM documents)""")
def clean_documents(spark, sf):
    return cl.clean_texts(read_table(spark, sf, "documents"), "doc_id", "text")


@query("clean_pages", f"""
SELECT page_id AS doc_id, c AS clean, length(c)::INT AS n_chars
FROM (SELECT page_id, {S.clean_line('html')} AS c FROM pages)""")
def clean_pages(spark, sf):
    return cl.clean_texts(read_table(spark, sf, "pages"), "page_id", "html")


@query("clean_corpus", f"WITH {S.corpus_clean_cte()} SELECT * FROM corpus")
def clean_corpus(spark, sf):
    return corpus(spark, sf)


@query("filter_corpus", f"""
WITH {S.corpus_clean_cte()}
SELECT doc_id, s AS clean, n_chars FROM (SELECT doc_id, {S.py_strip('clean')} AS s, n_chars FROM corpus)
WHERE length(s) >= 30""")
def filter_corpus(spark, sf):
    return cl.filter_corpus(corpus(spark, sf))


@query("clean_corpus_stats", f"""
SELECT count(*)::BIGINT AS pages_in, count(*) FILTER (WHERE length(c) > 30)::BIGINT AS pages_kept,
       coalesce(sum(length(c)) FILTER (WHERE length(c) > 30), 0)::BIGINT AS chars_kept
FROM (SELECT {S.clean_line('html')} AS c FROM pages)""")
def clean_corpus_stats(spark, sf):
    return cl.clean_corpus_stats(read_table(spark, sf, "pages"), "page_id", "html")


@query("filter_corpus_stats", f"""
WITH {S.corpus_clean_cte()}
SELECT count(*)::BIGINT AS lines_in, count(*) FILTER (WHERE length({S.py_strip('clean')}) >= 30)::BIGINT AS lines_kept
FROM corpus""")
def filter_corpus_stats(spark, sf):
    return cl.filter_corpus_stats(corpus(spark, sf))


@query("strip_tags", f"SELECT page_id, {S.rr('html', tx.TAG_RE)} AS text FROM pages")
def strip_tags(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


# No table holds wiki markup, so every text gets some, built from its own
# columns: a file link, a nested link, a template, citations, a broken link.
_MARKED = ("'[[File:' || source || '.jpg|' || lang || ']] ' || text || ' {{' || lang || '|' || source || '}} [' || n_chars "
           "|| '] [[File:' || lang || chr(10) || ']] {{' || source || chr(10) || '}} [x] [[' || source || ']]'")


@query("strip_markup", f"""
SELECT doc_id, {S.rr(S.rr(S.rr('t', tx.FILE_LINK_RE), tx.TEMPLATE_RE), tx.CITATION_RE)} AS text
FROM (SELECT doc_id, {_MARKED} AS t FROM documents)""")
def strip_markup(spark, sf):
    marked = read_table(spark, sf, "documents").select("doc_id", F.expr(_MARKED).alias("t"))
    return marked.select("doc_id", tx.strip_markup(F.col("t")).alias("text"))


@query("collapse_ws", f"SELECT doc_id, {S.rr('text', tx.WS_PY + '+')} AS text FROM documents")
def collapse_ws(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", tx.collapse_ws(F.col("text")).alias("text"))


@query("allow_chars", f"SELECT doc_id, {S.rr('text', '[^' + tx.DEFAULT_ALLOWED + ']')} AS text FROM documents")
def allow_chars(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", tx.allow_chars(F.col("text")).alias("text"))


# Every text is NFKC-stable, so its ASCII letters and digits are written full
# width first; NFKC must bring back the text itself.
ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in ASCII)


@query("nfkc_normalize", "SELECT conv_id, turn, text FROM conversations")
def nfkc_normalize(spark, sf):
    wide = read_table(spark, sf, "conversations").select("conv_id", "turn", F.translate("text", ASCII, WIDE).alias("t"))
    return wide.select("conv_id", "turn", tx.nfkc(F.col("t")).alias("text"))


@query("eval_lines", f"""
WITH {S.corpus_clean_cte()}
SELECT doc_id, e AS line FROM (SELECT doc_id, {S.eval_clean('clean')} AS e FROM corpus) WHERE e <> ''""")
def eval_lines(spark, sf):
    return eval_lines_of(read_table(spark, sf, "documents"))


def eval_lines_of(docs):
    c = cl.clean_corpus(docs)
    return keep_rows(c.select("doc_id", tx.eval_clean(F.col("clean")).alias("line")), F.col("line") != "")


@query("pretokenize", f"""
WITH {S.corpus_clean_cte()}
SELECT doc_id, (pos - 1)::INT AS tok_idx, token FROM (
  SELECT doc_id, unnest(l) AS token, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT doc_id, {S.pretokens(S.py_strip('clean'))} AS l FROM corpus))""")
def pretokenize(spark, sf):
    c = corpus(spark, sf)
    return (c.select("doc_id", F.posexplode(ct.training_words(c, "clean")).alias("tok_idx", "token"))
            .select("doc_id", F.col("tok_idx").cast("int"), "token"))


@query("words_per_line", f"""
SELECT doc_id, (pos - 1)::INT AS line_no,
       len(list_filter(regexp_split_to_array(line, {S.q(tx.WS_PY + '+')}), lambda x: x <> ''))::INT AS n_words
FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
      FROM (SELECT doc_id, {S.file_lines('text')} AS l FROM documents))""")
def words_per_line(spark, sf):
    return corpus_lines(spark, sf).select("doc_id", "line_no",
                                          tx.words_per_line(F.col("line")).cast("int").alias("n_words"))


@query("word_counts", f"WITH {S.corpus_clean_cte()}, {S.word_counts_cte()} SELECT word, cnt FROM wc")
def word_counts(spark, sf):
    return ct.word_counts(corpus(spark, sf), "clean")


@query("alphabet", f"""
WITH {S.corpus_clean_cte()}, {S.word_counts_cte()}
SELECT ch, sum(cnt)::BIGINT AS cnt FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS ch, cnt FROM wc) GROUP BY ch""")
def alphabet(spark, sf):
    return ct.alphabet(word_counts(spark, sf))


_PAIRS_SQL = f"""
WITH {S.corpus_clean_cte()}, {S.word_counts_cte()},
ch AS (SELECT regexp_extract_all(word, '(?s).') AS l, cnt FROM wc),
pairs AS (SELECT l[i] AS l, l[i + 1] AS r, sum(cnt)::BIGINT AS n FROM ch, LATERAL (SELECT unnest(range(1, len(l))) AS i) GROUP BY 1, 2)
"""


@query("pair_counts", _PAIRS_SQL + "SELECT l, r, n FROM pairs")
def pair_counts(spark, sf):
    return ct.pair_counts(ct.symbol_table(word_counts(spark, sf)))


@query("top_pairs", _PAIRS_SQL + f"SELECT l, r, n FROM pairs ORDER BY n DESC, l, r LIMIT {TOP_PAIRS}")
def top_pairs(spark, sf):
    return ct.top_pairs(pair_counts(spark, sf), TOP_PAIRS)


@query("corpus_head", f"""
SELECT doc_id, (pos - 1)::INT AS line_no, line FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT doc_id, {S.file_lines('text')} AS l FROM documents))
ORDER BY doc_id, line_no LIMIT {HEAD_LINES}""")
def corpus_head(spark, sf):
    """First N lines in file order: an explicit order key, then a top-k."""
    return corpus_lines(spark, sf).orderBy("doc_id", "line_no").limit(HEAD_LINES)


def _sample_sql(n):
    return f"""
WITH {S.corpus_clean_cte()}
SELECT doc_id, e AS line FROM (SELECT doc_id, {S.eval_clean('clean')} AS e FROM corpus) WHERE e <> ''
ORDER BY doc_id LIMIT {n}"""


def _first_lines(spark, sf, n):
    """Cleans ranges of documents, in key order, until n lines exist."""
    def make(docs):
        # cleaned where it is read: the ranges are small, and their filter must reach the scan
        rows = cl.clean_corpus(docs).select("doc_id", tx.eval_clean(F.col("clean")).alias("line"))
        return keep_rows(rows, F.col("line") != "")
    return first_by_key(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", n, make, "doc_id", "line")


@query("eval_sample", _sample_sql(DEFAULT_EVAL_LINES))
def eval_sample(spark, sf):
    return _first_lines(spark, sf, DEFAULT_EVAL_LINES)


SHORT_SAMPLE = 150       # fewer lines than any corpus has


@query("eval_sample_short", _sample_sql(SHORT_SAMPLE))
def eval_sample_short(spark, sf):
    return _first_lines(spark, sf, SHORT_SAMPLE)


@query("raw_sample", f"""
SELECT doc_id, (pos - 1)::INT AS line_no, line FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT doc_id, {S.file_lines('text')} AS l FROM documents))
WHERE line <> '' ORDER BY doc_id, line_no LIMIT {DEFAULT_STATS_LINES}""")
def raw_sample(spark, sf):
    """First N raw lines that are not empty (whitespace-only lines count)."""
    return (corpus_lines(spark, sf).filter(F.col("line") != "")
            .orderBy("doc_id", "line_no").limit(DEFAULT_STATS_LINES))


# Page assembly over a dump derived from `pages`: every page's HTML lines
# wrapped in marker lines, preceded by its URL (text outside any page) and by
# a page that starts twice, followed by a second page and one never closed.
def _dump_lines(spark, sf):
    pages = read_table(spark, sf, "pages")
    dump = F.concat_ws("\n", F.col("url"), F.lit("<page>"), F.lit("dropped"), F.lit("  <page>"), F.col("html"),
                       F.lit("  </page>"), F.lit("between"), F.lit("<page>"), F.col("url"), F.lit("</page>"),
                       F.lit("<page>"), F.lit("never closed"))
    return src.document_lines(pages.select(F.col("page_id").alias("doc_id"), dump.alias("text")))


@query("page_assembly", f"""
WITH lines AS (
  SELECT doc_id, (pos - 1)::INT AS line_no, line FROM (
    SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
    FROM (SELECT page_id AS doc_id,
                 {S.file_lines("concat_ws(chr(10), url, '<page>', 'dropped', '  <page>', html, '  </page>', 'between', '<page>', url, '</page>', '<page>', 'never closed')")} AS l FROM pages))),
m AS (SELECT *, contains(line, '<page>') AS is_open, contains(line, '</page>') AND NOT contains(line, '<page>') AS is_close FROM lines),
k AS (SELECT *, max(CASE WHEN is_open THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page_start,
             max(CASE WHEN is_close THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_close
      FROM m),
o AS (SELECT * FROM k WHERE page_start IS NOT NULL AND (prev_close IS NULL OR prev_close < page_start))
SELECT c.doc_id, c.page_start, c.line_no AS page_end,
       coalesce((SELECT string_agg(x.line, chr(10) ORDER BY x.line_no) FROM o x
                 WHERE x.doc_id = c.doc_id AND x.page_start = c.page_start AND NOT x.is_open AND NOT x.is_close), '') AS body
FROM o c WHERE c.is_close""")
def page_assembly(spark, sf):
    return src.page_bodies_from_lines(_dump_lines(spark, sf))
