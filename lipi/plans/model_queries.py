"""Vocabulary training queries and the shared trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TrainParams
from ..operators.bpe_train import train_bpe
from ..operators.encode import BpeModel
from . import sqltext as S
from .corpus_queries import corpus
from .registry import query

# A query that needs a model trains TrainParams(). Its SQL check, registered as
# <name>_v160, trains a small vocabulary over the same whole corpus, so that the
# one-merge-per-step SQL stays affordable.
QUERY_VOCAB = 160
QUERY_MIN_FREQ = 2
# Oracle steps: enough for every merge when the alphabet has >= 60 symbols
# (69 at sf0.01 after the default allow-list).
ORACLE_STEPS = QUERY_VOCAB - 5 - 60

CHECKED = TrainParams(vocab_size=QUERY_VOCAB, min_frequency=QUERY_MIN_FREQ)

_MODELS: dict = {}
_params = [CHECKED]      # the last one is what trained() trains


def at_full_size(fn):
    """The query ``fn`` with the model of TrainParams()."""
    def run(spark, sf):
        _params.append(TrainParams())
        try:
            return fn(spark, sf)
        finally:
            _params.pop()
    run.__name__ = fn.__name__
    return run


def trained(spark, sf):
    """Train once per application and set of files, and reuse: the result is
    small (bounded by vocab_size) and held as rows."""
    files = tuple(sorted(spark.read.parquet(f"{sf}/documents.parquet").inputFiles()))
    key = (spark.sparkContext.applicationId, files, _params[-1])
    got = _MODELS.get(key)
    if got is None:
        res = train_bpe(spark, corpus(spark, sf), "clean", _params[-1])
        vocab_rows = [tuple(r) for r in res.vocab.collect()]
        merge_rows = [tuple(r) for r in res.merges.collect()]
        model = BpeModel.from_rows([(i, t) for i, t, _ in vocab_rows],
                                   [(r, a, b) for r, a, b, _, _ in merge_rows])
        got = (vocab_rows, merge_rows, model)
        _MODELS[key] = got
    return got


def model_of(spark, sf) -> BpeModel:
    return trained(spark, sf)[2]


def vocab_df(spark, sf):
    from ..operators.bpe_train import VOCAB_SCHEMA
    return spark.createDataFrame(trained(spark, sf)[0], VOCAB_SCHEMA)


def merges_df(spark, sf):
    from ..operators.bpe_train import MERGES_SCHEMA
    return spark.createDataFrame(trained(spark, sf)[1], MERGES_SCHEMA)


def train_prefix() -> str:
    """WITH-list defining corpus, wc, the merge chain, acc and vocab."""
    return (f"{S.corpus_clean_cte()},\n{S.word_counts_cte()},\n"
            f"{S.bpe_ctes(QUERY_VOCAB, QUERY_MIN_FREQ, ORACLE_STEPS)}")


@query("bpe_merges", f"WITH {train_prefix()} SELECT rank::INT AS rank, \"left\", \"right\", merged, n FROM acc")
def bpe_merges(spark, sf):
    return merges_df(spark, sf)


@query("vocab_table", f"WITH {train_prefix()} SELECT id, token, kind FROM vocab")
def vocab_table(spark, sf):
    return vocab_df(spark, sf)


@query("vocab_size", f"WITH {train_prefix()} SELECT count(*)::BIGINT AS vocab_size FROM vocab")
def vocab_size(spark, sf):
    return vocab_df(spark, sf).agg(F.count(F.lit(1)).cast("long").alias("vocab_size"))
