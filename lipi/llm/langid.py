"""Language identification by compression.

Per language a zstandard raw-content dictionary is filled with sample text of
that language; a text is cut into blocks, every block is compressed with each
dictionary, and the language that needs the fewest bytes wins. A block counts by
how much it lengthens a context of the language; blocks shorter than a context
are measured behind several of them and averaged, which is one measure for all
lengths. The margin between the best and the second language is the score.

Rejection. One more dictionary holds the same samples with their letters
shuffled: text of no language. Two margins have to be wide: that to the second
language and that to the shuffled letters. How wide, is learned per class of
length (powers of two of bytes) on labelled rows that fill no dictionary, cut to
several lengths, and on their shuffled copies: a limit lies above NOISE of the
shuffled texts' margins, unless that would reject more than MOST of the real
ones, and above LEAST of the real ones.

Fitting reads a bounded sample (``SAMPLE_DOCS`` rows a language for the
dictionaries and ``LIMIT_DOCS`` for the limits, chosen by a hash of their id,
``SAMPLE_CHARS`` of each, ``DICT_BYTES`` a dictionary and ``MODEL_BYTES`` all of
them). Prediction reads whole texts, in blocks.

Defined results: null text, or text with no letter, is ``und`` with score 0;
ties go to the alphabetically first language; rows are never dropped; null
ids and repeated rows are predicted like any other; with one learned language
every text with letters gets it with score 1; with none, every text is
``und``. ``und`` is never accepted. More than MAX_LANGS labels are an error: they
are no languages. Columns of the input that clash with the added names are
replaced.
"""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from .common import parts

UND = "und"
DICT_BYTES, MODEL_BYTES = 112 * 1024, 28 << 20
SAMPLE_DOCS, LIMIT_DOCS = 300, 100
SAMPLE_CHARS = 8192
MAX_LANGS = 4096
BLOCK_BYTES = 4096
LEVEL = 6                # fast levels miss dictionary matches (95.6 against 99.1 % right)
CONTEXTS, CONTEXT_BYTES = 8, 1024
PIECES = (1, 2, 3, 5, 8, 15, 30, 60, 150, 400, 1000)   # words of the texts that limits are learned on
SHORTEST, LONGEST = 4, 12                              # classes: bits of the length in bytes
NOISE, LEAST, ENOUGH = 0.95, 0.002, 20
SHORT_CLASS, MOST_SHORT, MOST = 6, 0.03, 0.004         # under 64 bytes real and shuffled texts are hard to tell apart


class Model(dict):
    """{language: dictionary bytes}, the shuffled dictionary, and the limits
    {length class: (margin to the second language, margin to shuffled text)}."""

    noise = b""
    limits: dict = {}

    def frozen(self) -> tuple:
        return tuple(sorted(self.items())), self.noise, tuple(sorted(self.limits.items()))


def shuffled_letters(text: str, seed: int = 1) -> str:
    """The text with its letters dealt anew; all else stays in place."""
    out = list(text)
    at = [i for i, c in enumerate(out) if c.isalpha()]
    letters = [out[i] for i in at]
    random.Random(seed).shuffle(letters)
    for i, c in zip(at, letters):
        out[i] = c
    return "".join(out)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of rows with a non-null language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return Model()
    wanted = sample_docs + LIMIT_DOCS
    unit = 1 << 30
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(unit))
    # hash limit of a language: about one and a half times the rows wanted
    tops = {r["l"]: unit if r["n"] <= 4 * wanted else int(unit * 1.5 * wanted / r["n"]) for r in counts}
    limit = F.create_map(*[F.lit(x) for pair in tops.items() for x in pair])[F.col(lang_col)]
    picked = (rows.select(F.col(lang_col).alias("l"), h.alias("h"), limit.alias("top"),
                          F.substring(F.col(text_col), 1, SAMPLE_CHARS).alias("t"))
              .where("h < top").select("l", "h", "t").collect())
    texts: dict = {}
    for r in sorted(picked, key=lambda r: (r["l"], r["h"], r["t"])):
        texts.setdefault(r["l"], []).append(r["t"])
    model, apart = Model(), []
    for lang, t in sorted(texts.items()):
        n = min(LIMIT_DOCS, len(t) // 4)          # a quarter of a small sample serves the limits
        apart += t[:n]
        model[lang] = _even(t[n:n + sample_docs])[:max(1024, MODEL_BYTES // len(texts))]
    share = max(1, DICT_BYTES // len(model))
    model.noise = shuffled_letters("".join(d[:share].decode("utf-8", "ignore") for d in model.values())).encode()[:DICT_BYTES]
    model.limits = _limits(labelled.sparkSession, model, apart)
    return model


def _class(n_bytes: int) -> int:
    return min(LONGEST, max(SHORTEST, n_bytes.bit_length()))


def _limits(spark, model: Model, texts: list) -> dict:
    """Limits per class of length; the margins are taken in Spark."""
    import numpy as np
    cut = {" ".join(w[:k]) for w in (t.split() for t in texts) for k in PIECES if len(w) >= k}
    rows = [(t, real) for p in sorted(cut) if any(c.isalpha() for c in p) for t, real in ((p, True), (shuffled_letters(p), False))]
    if len(model) < 2 or not rows:
        return {}
    classify = _classifier(spark, model)
    got = (spark.createDataFrame(rows, "text string, real boolean").repartition(parts(spark))
           .select(F.octet_length(F.lower("text")).alias("n"), "real", classify(F.col("text")).alias("p"))
           .select("n", "real", "p.score", "p.support").collect())
    by: dict = {}
    for r in got:
        by.setdefault(_class(r.n), {True: [], False: []})[r.real].append((r.score, r.support))
    out = {}
    for size, kinds in by.items():
        if min(len(kinds[True]), len(kinds[False])) >= ENOUGH:
            real, noise = np.array(kinds[True]), np.array(kinds[False])
            most = MOST_SHORT if size <= SHORT_CLASS else MOST
            out[size] = tuple(float(min(np.quantile(real[:, j], most), max(np.quantile(real[:, j], LEAST), np.quantile(noise[:, j], NOISE))))
                              for j in (0, 1))
    return out


def _even(texts: list) -> bytes:
    """A dictionary with an equal share of every sample text."""
    share = max(64, DICT_BYTES // max(1, len(texts)))
    return b"\n".join(t.lower().encode("utf-8", "replace")[:share] for t in texts)[:DICT_BYTES]


_COMPRESSORS: dict = {}


def _compressor(raw):
    import zstandard as z
    d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    c = z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    contexts = [raw[len(raw) * i // CONTEXTS:][:CONTEXT_BYTES] for i in range(CONTEXTS)]
    return c, [(x, len(c.compress(x))) for x in contexts]


def _compressors(key, frozen):
    """[(language, compressor, contexts)], the shuffled one last, by model."""
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        languages, noise, _ = frozen
        _COMPRESSORS[key] = [(lang, *_compressor(raw)) for lang, raw in languages] + [(UND, *_compressor(noise))]
    return _COMPRESSORS[key]


def sizes(text: str, compressors) -> list:
    """Bytes that the whole text, case folded, adds under each dictionary."""
    raw = text.lower().encode("utf-8", "replace")
    out = [0.0] * len(compressors)
    for i in range(0, len(raw), BLOCK_BYTES):
        block = raw[i:i + BLOCK_BYTES]
        n = min(CONTEXTS, -(-CONTEXT_BYTES // len(block)))
        for k, (_, c, contexts) in enumerate(compressors):
            out[k] += sum(len(c.compress(x + b" " + block)) - size for x, size in contexts[:n]) / n
    return [max(x, 0.5) for x in out]


def choose(text: str, compressors, limits: dict) -> tuple:
    """(language, score, support, accepted): margins to the second language and
    to shuffled letters."""
    *got, noise = sizes(text, compressors)
    order = sorted(range(len(got)), key=lambda i: (got[i], compressors[i][0]))
    best = got[order[0]]
    score = (got[order[1]] - best) / got[order[1]] if len(got) > 1 else 1.0
    support = (noise - best) / noise
    least = limits.get(_class(len(text.lower().encode("utf-8", "replace"))), (0.0, 0.0))
    return compressors[order[0]][0], score, support, score >= least[0] and support >= least[1]


_CHOICE = "lang_pred string, score double, support double, accepted boolean"


def _classifier(spark, model: Model):
    """Arrow function text -> (lang_pred, score, support, accepted)."""
    small_batches(spark)
    frozen = model.frozen()
    shared = spark.sparkContext.broadcast(frozen)      # MODEL_BYTES and two dictionaries at most
    key = hashlib.sha256(repr(frozen).encode()).hexdigest()   # a worker keeps one model's compressors

    @F.arrow_udf(_CHOICE)
    def classify(texts: pa.Array) -> pa.Array:
        limits = dict(shared.value[2])
        none = (UND, 0.0, 0.0, False)
        made = _compressors(key, shared.value) if shared.value[0] else None
        out = [none if t is None or made is None else choose(t, made, limits) for t in texts.to_pylist()]
        types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        cols = zip(*out) if out else [()] * len(types)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          names=["lang_pred", "score", "support", "accepted"])
    return classify


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and accepted; only the text is read."""
    classify = _classifier(docs.sparkSession, model)
    text: Column = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("_none"))
    made = docs.select(row.alias("r"), classify(text).alias("p"))
    return made.select(*[F.col("r").getField(c).alias(c) for c in keep], "p.lang_pred", "p.score", "p.accepted")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows no model learns from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
