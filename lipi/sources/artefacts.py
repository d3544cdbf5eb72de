"""Tokenizer artefacts: vocabulary and merges as Parquet plus one small JSON
export, in versions; load with a fail-fast check; train only when missing.

Every save writes a folder of its own (versions/<id>) and then swaps the file
CURRENT, which names it, by one atomic rename. A reader sees a whole model or
the one before, never parts of two; a save that is interrupted leaves a folder
that nothing names; of two trainers that save at once the later swap wins.
Folders that are no longer named stay until ``drop_old_versions``, so that
whoever reads them can finish.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import SPECIAL_TOKENS, TrainParams
from ..operators.bpe_train import train_bpe
from ..operators.encode import BpeModel

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _params_text(params: TrainParams) -> str:
    return json.dumps({"vocab_size": params.vocab_size, "min_frequency": params.min_frequency}, sort_keys=True)


def _checked(spark: SparkSession, fs) -> bool:
    kind = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.ChecksumFileSystem")
    return kind.isInstance(fs)


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Swap the pointer: write it aside, rename over the old one. It has no
    checksum file, which could not be swapped in the same step."""
    fs, aside = _fs(spark, f"{path}/{POINTER}-{version}")
    plain = fs.getRawFileSystem() if _checked(spark, fs) else fs
    out = plain.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, hadoop.Path(f"{path}/{POINTER}"), over)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that readers are to use; None when nothing was saved yet."""
    fs, p = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return None
    return f"{path}/versions/{spark.read.text(f'{path}/{POINTER}').first()[0]}"


def save_model(vocab: DataFrame, merges: DataFrame, path: str, params: TrainParams | None = None) -> str:
    """Write vocabulary, merges, JSON and training parameters as a new version
    and make it the current one; returns its folder."""
    spark = vocab.sparkSession
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    vocab.coalesce(1).write.parquet(f"{folder}/vocab")
    merges.coalesce(1).write.parquet(f"{folder}/merges")
    # Small JSON export (bounded by vocab_size) for tools outside Spark.
    doc = {
        "added_tokens": [{"id": i, "content": t, "special": True} for i, t in enumerate(SPECIAL_TOKENS)],
        "model": {
            "type": "BPE", "unk_token": SPECIAL_TOKENS[1],
            "vocab": {r["token"]: r["id"] for r in vocab.orderBy("id").collect()},
            "merges": [[r["left"], r["right"]] for r in merges.orderBy("rank").collect()],
        },
    }
    for name, text in (("tokenizer_json", json.dumps(doc, ensure_ascii=False)), ("params", _params_text(params or TrainParams()))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    _point_to(spark, path, version)
    return folder


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, BpeModel]:
    folder = current_version(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no tokenizer artefacts under {path}")
    vocab = spark.read.parquet(f"{folder}/vocab")
    merges = spark.read.parquet(f"{folder}/merges")
    return vocab, merges, BpeModel.from_frames(vocab, merges)


def train_or_load(spark: SparkSession, lines: DataFrame, path: str, line: str = "line",
                  params: TrainParams = TrainParams(), force: bool = False):
    """Reuse the current artefacts if they were trained with the same
    parameters, unless `force`; otherwise train and save."""
    folder = None if force else current_version(spark, path)
    if folder is not None and spark.read.text(f"{folder}/params").first()[0] == _params_text(params):
        return load_model(spark, path)
    res = train_bpe(spark, lines, line, params)
    save_model(res.vocab, res.merges, path, params)
    return load_model(spark, path)


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete every version but the current one; returns how many."""
    keep = current_version(spark, path)
    fs, root = _fs(spark, f"{path}/versions")
    if keep is None or not fs.exists(root):
        return 0
    old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName() != keep.rsplit("/", 1)[1]]
    for p in old:
        fs.delete(p, True)
    return len(old)
