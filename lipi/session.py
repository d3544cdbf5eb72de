"""Session helpers.

The library never picks storage on its own: the training loop cuts lineage
with reliable checkpoints in the folder the cluster names in
``spark.checkpoint.dir``. Only a local session (tests, bench, smoke) may get
a fresh scratch folder when that setting is unset.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lipi")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config(SPREAD, str(cores))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    return spark


_SHIPPED: set = set()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (the Arrow UDFs
    live in it): zip it once per application and add it as a py-file, as
    spark-submit --py-files would."""
    import os
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="lipi-code-"), "lipi.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set a scratch one only for a
    local master when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lipi-ckpt-"))
    return sc.getCheckpointDir()


# Bytes of rows that pass to Python in one Arrow batch. Spark bounds a batch by
# rows first: 10,000 whole texts, as pieces or as tokens, are many times what a
# worker needs, and a task holds them once per Python step on either side.
BATCH_BYTES, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 21


def small_batches(spark: SparkSession) -> None:
    """Plans of this session pass rows to Python in batches of SMALL_BATCH
    bytes; a smaller setting stays. It holds for the session, as a plan reads
    it when it runs, not when it is made."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= SMALL_BATCH:
        spark.conf.set(BATCH_BYTES, str(SMALL_BATCH))


# Session setting: partitions a table is dealt over when it is read. Unset on
# a cluster, where a large source keeps its scan splits and pays no shuffle;
# a local session sets it because its tables are one file with one row group.
SPREAD = "spark.lipi.spread"


def read_table(spark: SparkSession, sf_dir: str, name: str):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.conf.get(SPREAD, None)
    return df.repartition(int(n)) if n else df


def keep_rows(df, cond):
    """Filter on a condition over *computed* columns without letting the
    optimizer push it below the projection: a pushed Filter would carry a
    copy of the (expensive, e.g. regex) expression and evaluate it twice,
    and below a repartition it would run before the work is spread. A
    generator (inline) is not pushed through, so the column is computed
    once."""
    from pyspark.sql import functions as F
    return df.select(F.inline(F.when(cond, F.array(F.struct(*[F.col(c) for c in df.columns])))))


def first_n(df, n, *order):
    """The first n rows in `order` (a top-k, TakeOrderedAndProject), dealt
    over the cores. The repartition also keeps later Python UDFs above the
    limit; otherwise the optimizer moves the projection below it and the
    UDF runs on every row before the cut."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.orderBy(*order).limit(n).repartition(par)


def first_by_key(source, key, n, make, *order):
    """The first n rows, by ``order``, of make(source), where make is narrow
    (row by row, key kept) and ``order`` starts with the key: ranges of keys,
    each twice as long as all before, are made until n rows exist.

    The range limits are exact quantiles of the key column, which is all that
    is read for them; a range is a filter on the key, so Parquet skips the row
    groups outside it. Rows of one key are never split over two ranges; rows
    without a key have no place and are left out."""
    from pyspark.sql import functions as F
    order = list(order) or [key]
    found, after, size, held = None, None, 2 * n, 0
    source = source.where(F.col(key).isNotNull())
    keys = source.select(key)
    total = keys.count()
    while True:
        rows = source if after is None else source.where(F.col(key) > after)
        upto = None
        if size < total:
            # within a thousandth of the wanted place: a range may be a little longer or shorter
            upto = keys.agg(F.percentile_approx(key, min(1.0, size / total), 1000)).first()[0]
            if after is None or upto > after:
                rows = rows.where(F.col(key) <= upto)
            else:
                upto, rows = after, None
        if rows is not None:
            part = make(rows).orderBy(*order).limit(n - held).checkpoint()       # n rows at most
            held += part.count()
            found = part if found is None else found.unionByName(part)
        if held >= n or size >= total:
            return found.orderBy(*order).limit(n)
        after, size = upto, 2 * size
