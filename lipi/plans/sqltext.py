"""DuckDB SQL text for the oracle side (RE2 regex dialect).

These strings restate each operator's contract in plain SQL over the
driver's views, so the Spark result can be checked by a second engine.
"""

from __future__ import annotations

from ..config import SPECIAL_TOKENS
from ..functions.text import (CITATION_RE, DEFAULT_ALLOWED, FILE_LINK_RE, TAG_RE,
                              TEMPLATE_RE, WS_PY, WS_UNI)

# RE2 has no (?U): spell the Unicode word class out.
WORD_CLASS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"
PRETOKEN_RE2 = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}{WS_UNI[1:-1]}]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pat: str, rep: str = " ") -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def py_strip(x: str) -> str:
    return rr(x, f"^{WS_PY}+|{WS_PY}+\\z", "")


def clean_line(x: str, allowed: str = DEFAULT_ALLOWED) -> str:
    c = py_strip(x)
    for pat in (TAG_RE, FILE_LINK_RE, TEMPLATE_RE, CITATION_RE):
        c = rr(c, pat)
    c = rr(c, f"{WS_PY}+")
    c = rr(c, f"[^{allowed}]")
    return py_strip(c)


def eval_clean(x: str) -> str:
    return rr(py_strip(x), f"{WS_UNI}+")


def pretokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(PRETOKEN_RE2)})"


def file_lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, {q(chr(13) + chr(10) + '|' + chr(13) + '|' + chr(10))})"
    return (f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] "
            f"ELSE {parts} END)")


def corpus_clean_cte(sf_min: int = 30) -> str:
    return (f"corpus AS (SELECT doc_id, c AS clean, length(c)::INT AS n_chars FROM "
            f"(SELECT doc_id, {clean_line('text')} AS c FROM documents) WHERE length(c) > {sf_min})")


def word_counts_cte(src: str = "corpus", col: str = "clean") -> str:
    return (f"wc AS MATERIALIZED (SELECT w AS word, count(*)::BIGINT AS cnt FROM "
            f"(SELECT unnest({pretokens(py_strip(col))}) AS w FROM {src}) GROUP BY w)")


def specials_values() -> str:
    return ", ".join(f"({i}, {q(t)})" for i, t in enumerate(SPECIAL_TOKENS))


def bpe_ctes(vocab_size: int, min_frequency: int, steps: int) -> str:
    """CTE chain: one merge per step (one-at-a-time reference form).
    Needs `wc(word, cnt)`. Defines m{k} (merge of step k, 0 or 1 row),
    acc (all merges), alpha(ch), vocab(id, token, kind)."""
    T, L = "chr(9)", "chr(10)"
    parts = []
    parts.append(
        "alpha AS MATERIALIZED (SELECT DISTINCT ch FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS ch FROM wc))")
    parts.append(
        f"w0 AS MATERIALIZED (SELECT {T} || array_to_string(regexp_extract_all(word, '(?s).'), {L} || {T}) || {L} AS sym, cnt FROM wc)")
    parts.append(
        f"st0 AS MATERIALIZED (SELECT {len(SPECIAL_TOKENS)} + (SELECT count(*) FROM alpha) AS vcount, true AS active)")
    parts.append("acc0 AS MATERIALIZED (SELECT NULL::INT AS rank, NULL::VARCHAR AS \"left\", NULL::VARCHAR AS \"right\", "
                 "NULL::VARCHAR AS merged, NULL::BIGINT AS n WHERE false)")
    for k in range(1, steps + 1):
        p = k - 1
        parts.append(
            f"p{k} AS MATERIALIZED (SELECT l[i] AS a, l[i + 1] AS b, sum(cnt)::BIGINT AS n FROM "
            f"(SELECT string_split(substr(sym, 2, length(sym) - 2), {L} || {T}) AS l, cnt FROM w{p} "
            f"WHERE (SELECT active FROM st{p}) AND strpos(sym, {L} || {T}) > 0), "
            f"LATERAL (SELECT unnest(range(1, len(l))) AS i) "
            f"GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 1)")
        parts.append(
            f"m{k} AS MATERIALIZED (SELECT {k} AS rank, a AS \"left\", b AS \"right\", a || b AS merged, n, "
            f"NOT EXISTS (SELECT 1 FROM acc{p} WHERE merged = a || b) AS adds FROM p{k} "
            f"WHERE n >= {min_frequency} AND (SELECT vcount FROM st{p}) < {vocab_size})")
        parts.append(
            f"st{k} AS MATERIALIZED (SELECT (SELECT vcount FROM st{p}) + coalesce((SELECT adds::INT FROM m{k}), 0) AS vcount, "
            f"EXISTS (SELECT 1 FROM m{k}) AS active)")
        parts.append(
            f"acc{k} AS MATERIALIZED (SELECT * FROM acc{p} UNION ALL SELECT rank, \"left\", \"right\", merged, n FROM m{k})")
        parts.append(
            f"w{k} AS MATERIALIZED (SELECT coalesce(replace(sym, (SELECT {T} || \"left\" || {L} || {T} || \"right\" || {L} FROM m{k}), "
            f"(SELECT {T} || merged || {L} FROM m{k})), sym) AS sym, cnt FROM w{p} "
            f"WHERE (SELECT active FROM st{k}))")
    parts.append(f"acc AS (SELECT * FROM acc{steps})")
    parts.append(
        "vocab AS MATERIALIZED (SELECT id::INT AS id, token, kind FROM ("
        f"SELECT i AS id, t AS token, 'special' AS kind FROM (VALUES {specials_values()}) s(i, t) "
        f"UNION ALL SELECT {len(SPECIAL_TOKENS) - 1} + row_number() OVER (ORDER BY unicode(ch)), ch, 'char' FROM alpha "
        f"UNION ALL SELECT {len(SPECIAL_TOKENS) - 1} + (SELECT count(*) FROM alpha) + row_number() OVER (ORDER BY rank), merged, 'merge' "
        f"FROM (SELECT merged, min(rank) AS rank FROM acc GROUP BY merged)))")
    return ",\n".join(parts)


SPECIALS_RE2 = "|".join(t.replace("[", "\\[").replace("]", "\\]") for t in SPECIAL_TOKENS)


def cover_re() -> str:
    """Pieces covering a whole text: literal specials, pre-tokens and
    whitespace runs (RE2 has no look-ahead, so a punctuation run glued to
    a special is not split; fixture texts hold specials only between
    spaces)."""
    return f"{SPECIALS_RE2}|{PRETOKEN_RE2}|{WS_UNI}+"


def encode_full_ctes(src: str, keys: list, text: str, steps: int, tag: str = "") -> str:
    """Needs m{k} and vocab from bpe_ctes. Defines, with suffix `tag`:
    pt (keys, w, pi, ps), wti (w, ti, id, token, tlen),
    tk (keys, token_idx, token, id, start, end) and
    enc (keys, text, ids, tokens) in token order."""
    T, L = "chr(9)", "chr(10)"
    K = ", ".join(keys)
    P = lambda n: f"{n}{tag}"
    parts = []
    parts.append(
        f"{P('pc')} AS MATERIALIZED (SELECT {K}, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS k "
        f"FROM (SELECT {K}, regexp_extract_all({text}, {q(cover_re())}) AS l FROM {src}))")
    parts.append(
        f"{P('pt')} AS MATERIALIZED (SELECT {K}, p AS w, row_number() OVER (PARTITION BY {K} ORDER BY k) AS pi, ps FROM "
        f"(SELECT {K}, p, k, sum(length(p)) OVER (PARTITION BY {K} ORDER BY k ROWS UNBOUNDED PRECEDING) - length(p) AS ps "
        f"FROM {P('pc')}) WHERE NOT regexp_matches(p, {q('^' + WS_UNI)}))")
    parts.append(
        f"{P('e0')} AS MATERIALIZED (SELECT w, CASE WHEN w IN ({', '.join(q(t) for t in SPECIAL_TOKENS)}) THEN {T} || w || {L} "
        f"ELSE {T} || array_to_string(regexp_extract_all(w, '(?s).'), {L} || {T}) || {L} END AS sym "
        f"FROM (SELECT DISTINCT w FROM {P('pt')}))")
    for k in range(1, steps + 1):
        parts.append(
            f"{P(f'e{k}')} AS MATERIALIZED (SELECT w, coalesce(replace(sym, (SELECT {T} || \"left\" || {L} || {T} || \"right\" || {L} FROM m{k}), "
            f"(SELECT {T} || merged || {L} FROM m{k})), sym) AS sym FROM {P(f'e{k - 1}')})")
    parts.append(
        f"{P('wt')} AS MATERIALIZED (SELECT w, unnest(s) AS tok, unnest(range(1, len(s) + 1)) AS ti FROM "
        f"(SELECT w, string_split(substr(sym, 2, length(sym) - 2), {L} || {T}) AS s FROM {P(f'e{steps}')}))")
    parts.append(
        f"{P('wti')} AS MATERIALIZED (SELECT x.w, x.ti, coalesce(v.id, 1)::INT AS id, "
        "CASE WHEN v.id IS NULL THEN '[UNK]' ELSE x.tok END AS token, length(x.tok) AS tlen "
        f"FROM {P('wt')} x LEFT JOIN vocab v ON v.token = x.tok)")
    parts.append(
        f"{P('tk')} AS MATERIALIZED (SELECT {K}, (row_number() OVER (PARTITION BY {K} ORDER BY pi, ti) - 1)::INT AS token_idx, "
        f"token, id, start::INT AS start, (start + tlen)::INT AS \"end\" FROM "
        f"(SELECT {', '.join('a.' + k for k in keys)}, a.pi, b.ti, b.id, b.token, b.tlen, "
        f"a.ps + sum(b.tlen) OVER (PARTITION BY {', '.join('a.' + k for k in keys)}, a.pi ORDER BY b.ti ROWS UNBOUNDED PRECEDING) - b.tlen AS start "
        f"FROM {P('pt')} a JOIN {P('wti')} b ON b.w = a.w))")
    parts.append(
        f"{P('enc')} AS MATERIALIZED (SELECT {', '.join('d.' + k for k in keys)}, d.{text} AS text, "
        "coalesce(x.ids, []::INT[]) AS ids, coalesce(x.tokens, []::VARCHAR[]) AS tokens FROM "
        f"{src} d LEFT JOIN (SELECT {K}, list(id ORDER BY token_idx) AS ids, list(token ORDER BY token_idx) AS tokens "
        f"FROM {P('tk')} GROUP BY {K}) x USING ({K}))")
    return ",\n".join(parts)


def word_positions_cte(src: str, keys: list, text: str, name: str = "wp") -> str:
    K = ", ".join(keys)
    cover = f"{WS_PY}+|[^{WS_PY[1:-1]}]+"
    return (f"{name} AS MATERIALIZED (SELECT {K}, (row_number() OVER (PARTITION BY {K} ORDER BY k) - 1)::INT AS word_idx, "
            f"p AS word, ps::INT AS start, (ps + length(p))::INT AS \"end\" FROM "
            f"(SELECT {K}, p, k, sum(length(p)) OVER (PARTITION BY {K} ORDER BY k ROWS UNBOUNDED PRECEDING) - length(p) AS ps FROM "
            f"(SELECT {K}, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS k FROM "
            f"(SELECT {K}, regexp_extract_all({text}, {q(cover)}) AS l FROM {src}))) "
            f"WHERE NOT regexp_matches(p, {q('^' + WS_PY)}))")


def json_token(x: str) -> str:
    """json.dumps of an ASCII string (fixture tokens are ASCII or [UNK])."""
    return "'\"' || replace(replace(" + x + ", '\\', '\\\\'), '\"', '\\\"') || '\"'"
