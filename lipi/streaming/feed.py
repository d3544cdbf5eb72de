"""Structured Streaming: the chunked corpus feed, running word counts and
stream encode.

The feed is a file stream (bounded micro-batches via maxFilesPerTrigger,
drained with Trigger.AvailableNow). Running word counts are a streaming
aggregation: its state (one row per word) lives in RocksDB on the executors'
disks and in the checkpoint folder, so it may outgrow memory, and in update
mode every micro-batch writes only the words it has changed. A feed that was
killed goes on behind its last finished batch. What each batch read and kept
is observed inside the running query and arrives as progress events.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..config import DEFAULT_LOG_INTERVAL
from ..operators import clean as cl
from ..operators import counts as ct
from ..operators import encode as en
from ..session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, directory: str, file_glob: str,
                max_files_per_trigger: int = 1, spread: int | None = None) -> DataFrame:
    """Parquet files of `directory` matching `file_glob` as a stream.
    `spread`: deal each micro-batch over that many tasks (for triggers made
    of few large files); leave None when a trigger already has many splits."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(directory).schema
    df = (spark.readStream.schema(schema)
          .option("maxFilesPerTrigger", max_files_per_trigger)
          .option("pathGlobFilter", file_glob)
          .parquet(directory))
    return df.repartition(spread) if spread else df


def table_stream(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of part files.
    A micro-batch takes as many files as there are cores."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    # a stream's source is a folder: a table of one file is found in its parent
    directory, names = (path, "*") if folder else (str(p.getParent()), p.getName())
    return file_stream(spark, directory, names, max(1, spark.sparkContext.defaultParallelism), spread)


def _work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/lipi-{name}-{uuid.uuid4().hex}"


COUNTS = "word string, cnt long, batch_id long"
PROGRESS = "batch long, input_rows long, lines long"

# Spark setting and value: state stores on local disk instead of the heap.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_feed(df: DataFrame, directory: str, chunk) -> None:
    """df as a feed: one file per value of ``chunk`` (a column), which a file
    stream meets in the order of that value (it goes by the files' times)."""
    df.withColumn("chunk", chunk).repartition("chunk").write.partitionBy("chunk").parquet(directory)
    spark = df.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/chunk=*/*.parquet")
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [f.getPath() for f in fs.globStatus(files)]
    now = int(time.time()) * 1000
    for at, p in enumerate(sorted(paths, key=lambda p: int(p.getParent().getName().split("=")[1]))):
        fs.setTimes(p, now - 1000 * (len(paths) - at), -1)


class BatchProgress(StreamingQueryListener):
    """Writes one row per micro-batch of a query, from the metrics observed in
    it, as a file named by the batch: a batch that runs again overwrites its
    own. Metrics of batches without data (state clean-up) are left out."""

    def __init__(self, spark: SparkSession, name: str, out: str):
        self.spark, self.name, self.out, self.run_id = spark, name, out, None
        self.ended = threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        row = p.observedMetrics.get(f"{self.name}_kept")
        read = p.observedMetrics.get(f"{self.name}_read")
        if row is not None and read is not None and read["rows"]:
            text = json.dumps({"batch": p.batchId, "input_rows": read["rows"], "lines": row["rows"]})
            _write_text(self.spark, f"{self.out}/{p.batchId}.json", text)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.run_id is not None and str(event.runId) == self.run_id:
            self.ended.set()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def running_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "feed") -> DataFrame:
    """The streaming plan: (word, cnt) of all lines so far, with the rows read
    and the lines kept of each micro-batch observed as <name>_read and
    <name>_kept."""
    read = docs.observe(f"{name}_read", F.count(F.lit(1)).alias("rows"))
    lines = cl.clean_corpus(read, key, text).observe(f"{name}_kept", F.count(F.lit(1)).alias("rows"))
    return ct.word_counts(lines, "clean")


def start_word_counts(spark: SparkSession, docs: DataFrame, out: str, key: str = "doc_id", text: str = "text",
                      partitions: int | None = None):
    """Start (or resume) the feed below ``out``; returns (query, listener)."""
    name = "feed"
    listener = BatchProgress(spark, name, f"{out}/progress")
    spark.streams.addListener(listener)

    def write_batch(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/updates/batch_id={batch_id}")

    settings = {STATE_STORE: ROCKSDB}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)    # fixed for the life of the state
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:        # a started query keeps the settings it was started with
        query = (running_counts(docs, key, text, name).writeStream.outputMode("update").foreachBatch(write_batch)
                 .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    listener.run_id = str(query.runId)
    return query, listener


def stream_word_counts(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text",
                       out_dir: str | None = None, partitions: int | None = None):
    """Run the feed to completion; return (final word counts, progress).

    With a fixed ``out_dir`` a restarted feed goes on behind the last finished
    batch: the counts are exact whenever it was killed. A progress row is
    written when its event arrives; if the driver dies between a batch and its
    event, the batch's row is missing, and its counts are not."""
    out = out_dir or _work_dir(spark, "wordcount")
    query, listener = start_word_counts(spark, docs, out, key, text, partitions)
    try:
        query.awaitTermination()
        listener.ended.wait(60)        # the last batch's event comes before this one
    finally:
        spark.streams.removeListener(listener)
    progress = _read(spark, f"{out}/progress/*.json", PROGRESS, "json").orderBy("batch")
    return latest_counts(spark, out), progress


def _read(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """The rows written so far; none when the feed has had no batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(kind).load(path)


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """Every word's last update."""
    parts = _read(spark, f"{out}/updates", COUNTS)
    return parts.groupBy("word").agg(F.max_by("cnt", "batch_id").alias("cnt"))


def log_marks(progress: DataFrame, every: int = DEFAULT_LOG_INTERVAL) -> DataFrame:
    """(batch, mark): each multiple of ``every`` lines, with the batch that
    reached it. Progress has one row per micro-batch."""
    so_far = F.sum("lines").over(Window.orderBy("batch"))
    marks = progress.select("batch", "lines", so_far.cast("long").alias("total"))
    first = F.floor((F.col("total") - F.col("lines")) / every) + 1
    last = F.floor(F.col("total") / every)
    return marks.where(last >= first).select(
        "batch", F.explode(F.sequence(first, last)).alias("k")).select("batch", (F.col("k") * every).alias("mark"))


def stream_encode(spark: SparkSession, src: DataFrame, model: en.BpeModel, keys,
                  text: str = "text", out_dir: str | None = None) -> DataFrame:
    """Stateless encode of every micro-batch with a fixed, broadcast model;
    results land in parquet (one folder per batch id) and are read back."""
    out = out_dir or _work_dir(spark, "encode")
    encoded = en.encode_summary(en.encode_ids(spark, src, model, keys, text), keys)

    def write_batch(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    q = (encoded.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return _read(spark, f"{out}/rows", encoded.schema).drop("batch_id")
