"""Token counts by scanning flat, unindexed token files for separators.

A file is nothing but ids (unsigned, little-endian, 2 or 4 bytes); every
document ends with the end-of-document id. Files are cut into blocks; a block
is searched with one vectorised comparison and reports the documents that end
in it, the tokens ahead of its first separator and behind its last. A prefix
scan over the block summaries stitches the documents that cross blocks: tokens
before a block, separators before it, and the last separator's place.

``write_flat`` makes such files from a table of texts (and a manifest of file,
place and doc_id in writing order, which the scan does not use). A task writes
under a name of its own attempt and the manifest names what was finished, so a
lost executor leaves no wrong file behind.

Defined results: an empty document counts 0 tokens; tokens behind the last
separator of a file are a last, unterminated document; an empty file or table
gives no rows; null text counts as empty; null ids and repeated rows are
counted like any other. Separator strings inside a text are ordinary text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import parts, staged
from .tokens import text_groups, tokenizer_path, word_tokenizer

BLOCK_TOKENS = 1 << 20
END_OF_TEXT = 50256


def file_system(uri: str):
    """(file system, path) of a Hadoop-style or plain path."""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def write_flat(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
               end_id: int = END_OF_TEXT, width: int = 2) -> DataFrame:
    """Write flat token files below the shared checkpoint folder; returns the
    manifest (file string, place long, doc_id long)."""
    spark = docs.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/flat-{uuid.uuid4().hex}"
    model = path or tokenizer_path()
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    def run(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        name = f"{root}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.bin"
        tok, out, place = word_tokenizer(model, True), None, 0
        try:
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for first, group in text_groups(texts):
                    if out is None:
                        store, where = file_system(name)
                        store.create_dir(where.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(where)
                    for enc in tok.encode(group):
                        out.write(np.frombuffer(enc, "<u4").astype(f"<u{width}").tobytes() + end)
                    n = len(group)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(np.arange(place, place + n)),
                         pa.array(ids[first:first + n], pa.int64())], names=["file", "place", "doc_id"])
                    place += n
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(run, "file string, place long, doc_id long"), "manifest")


def block_summary(ids: np.ndarray, end_id: int) -> tuple:
    """(separators, tokens ahead of the first, lengths between them, place
    behind the last); without one, all tokens are ahead."""
    at = np.flatnonzero(ids == end_id)
    if not len(at):
        return 0, len(ids), np.zeros(0, np.int64), 0
    return len(at), int(at[0]), np.diff(at) - 1, int(at[-1]) + 1


def count_documents(files: DataFrame, end_id: int = END_OF_TEXT, width: int = 2,
                    block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """files (file string) -> file, place, n_tokens: one row per document."""
    def cut(batches):
        for b in batches:
            for f in b.column("file").to_pylist():
                store, where = file_system(f)
                n = store.get_file_info(where).size // width
                blocks = np.arange((n + block_tokens - 1) // block_tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(blocks), pa.string()), pa.array(blocks, pa.int64()),
                     pa.array(np.minimum(block_tokens, n - blocks * block_tokens), pa.int64())],
                    names=["file", "block", "tokens"])

    def scan(batches):
        for b in batches:
            for f, k, n in zip(*(b.column(c).to_pylist() for c in ("file", "block", "tokens"))):
                store, where = file_system(f)
                with store.open_input_file(where) as src:
                    src.seek(k * block_tokens * width)
                    ids = np.frombuffer(src.read(n * width), dtype=f"<u{width}")
                seps, head, inner, last = block_summary(ids, end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f]), pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([seps], pa.int64()),
                     pa.array([head], pa.int64()), pa.array([inner.tolist()], pa.list_(pa.int64())),
                     pa.array([last], pa.int64())],
                    names=["file", "block", "tokens", "seps", "head", "inner", "last"])

    spark = files.sparkSession
    blocks = files.select("file").mapInArrow(cut, "file string, block long, tokens long").repartition(parts(spark))
    found = staged(blocks.mapInArrow(
        scan, "file string, block long, tokens long, seps long, head long, inner array<bigint>, last long"), "blocks")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    summed = found.drop("inner").select(
        "*", F.coalesce(F.sum("tokens").over(before), zero).alias("at"),
        F.coalesce(F.sum("seps").over(before), zero).alias("place"))
    behind = F.when(F.col("seps") > 0, F.col("at") + F.col("last"))
    scanned = summed.select("file", "block", "seps", "head", "at", "place", "tokens",
                            F.coalesce(F.max(behind).over(before), zero).alias("open_from"),
                            F.lead("block").over(order).isNull().alias("is_last"), behind.alias("behind"))
    ended = (found.select("file", "block", "inner").join(
        scanned.where("seps > 0").select("file", "block", "head", "at", "place", "open_from"), ["file", "block"])
        .select("file", "place", F.posexplode(F.concat(
            F.array(F.col("at") + F.col("head") - F.col("open_from")), "inner")).alias("i", "n_tokens"))
        .select("file", (F.col("place") + F.col("i")).alias("place"), "n_tokens"))
    rest = (scanned.where("is_last").select(
        "file", (F.col("place") + F.col("seps")).alias("place"),
        (F.col("at") + F.col("tokens") - F.coalesce("behind", "open_from")).alias("n_tokens")).where("n_tokens > 0"))
    return ended.union(rest)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every row, counted in the flat files."""
    manifest = write_flat(docs, path)
    counted = count_documents(manifest.select("file").distinct())
    return manifest.join(counted, ["file", "place"]).select("doc_id", "n_tokens")
