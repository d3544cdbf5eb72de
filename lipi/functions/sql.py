"""Functions for SQL text: normalising, cutting, encoding and decoding by name.

``register`` makes them known to a session. The tokenizer's functions carry
their model with them (broadcast, bounded by its vocabulary), so models can be
registered side by side under different prefixes:

    <prefix>_nfkc(text)          text in NFKC (Arrow function)
    <prefix>_pieces(text)        array<string>: what the encoder cuts a text into
    <prefix>_encode(pieces)      array<int>: the ids of pieces (Arrow function)
    <prefix>_id_tokens(ids)      array<string>: tokens, null for unknown ids (Arrow function)
    <prefix>_decode(ids)         text: tokens joined by a blank, unknown ids skipped
    <prefix>_tokens(pieces)      table (token_idx, token, id, start, end); offsets are
                                 code points of the NFKC text. Null pieces: no rows.

    SELECT d.doc_id, t.* FROM (SELECT doc_id, lipi_pieces(text) AS p FROM docs) d, LATERAL lipi_tokens(d.p) t
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import SPECIAL_TOKENS, UNK_ID
from ..operators import encode as en
from .text import _nfkc_udf


def _token_table(bc):
    """The table function of one model."""
    specials = {t: i for i, t in enumerate(SPECIAL_TOKENS)}

    class Tokens:
        def eval(self, pieces):
            tok2id, ranks, _ = en._tables(bc.value)
            at = number = 0
            for p in pieces or ():
                if p in specials:
                    got = [(p, specials[p])]
                else:
                    got = [] if not p or p[0] in en._WHITE_SPACE else en.encode_word(p, tok2id, ranks)
                start = at
                for token, i in got:
                    yield number, SPECIAL_TOKENS[UNK_ID] if i == UNK_ID else token, i, start, start + len(token)
                    start += len(token)
                    number += 1
                at += len(p)

    return F.udtf(Tokens, returnType="token_idx INT, token STRING, id INT, start INT, end INT")


def register(spark: SparkSession, model: en.BpeModel, prefix: str = "lipi") -> None:
    from ..session import ship_code
    ship_code(spark)
    bc = spark.sparkContext.broadcast(model)
    spark.udf.register(f"{prefix}_nfkc", _nfkc_udf)
    spark.udf.register(f"{prefix}_encode", en._make_id_encoder(bc))
    spark.udf.register(f"{prefix}_id_tokens", en._token_lookup(spark, model, False))
    spark.udtf.register(f"{prefix}_tokens", _token_table(bc))
    cut = en.PIECES_RE.replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_pieces(t STRING) RETURNS ARRAY<STRING> "
              f"RETURN regexp_extract_all({prefix}_nfkc(t), r'{cut}', 0)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_decode(ids ARRAY<BIGINT>) RETURNS STRING "
              f"RETURN array_join(filter({prefix}_id_tokens(ids), x -> x IS NOT NULL), ' ')")
