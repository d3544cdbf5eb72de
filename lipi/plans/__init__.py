"""Query registry: importing the query modules fills QUERIES / ORACLES.

A query that needs a model is registered twice: under its name with the whole
vocabulary of TrainParams(), without SQL, and as <name>_v160 with the small
vocabulary that the SQL can afford (see model_queries)."""

from . import corpus_queries, encode_queries, model_queries, source_queries, stream_queries  # noqa: F401
from .model_queries import QUERY_VOCAB, at_full_size, train_prefix
from .registry import ORACLES as _SQL, QUERIES as _ALL

MODEL_QUERIES = {name for name, sql in _SQL.items() if train_prefix() in sql}
QUERIES = {name: at_full_size(fn) if name in MODEL_QUERIES else fn for name, fn in _ALL.items()}
ORACLES = {name: sql for name, sql in _SQL.items() if name not in MODEL_QUERIES}
for _name in sorted(MODEL_QUERIES):
    QUERIES[f"{_name}_v{QUERY_VOCAB}"] = _ALL[_name]
    ORACLES[f"{_name}_v{QUERY_VOCAB}"] = _SQL[_name]

__all__ = ["QUERIES", "ORACLES", "MODEL_QUERIES"]
