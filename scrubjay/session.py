"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows (of a few numbers) that one task takes at least in the rounds of iterative operators.
ROWS_A_TASK = 1 << 16


def get_spark(master: str | None = None, app: str = "scrubjay",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    On a cluster, pass master=None and let spark-submit decide; all the
    settings below are plain SQL confs that hold at any scale.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.sql.parquet.aggregatePushdown", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # local mode runs everything in the driver JVM; its default 1g heap is
        # too small for broadcast builds of even mid-size sides
        b = b.config("spark.driver.memory", "8g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, honouring ``spark.checkpoint.dir``.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we read it
    from the session. Only a local-mode session without that setting (tests,
    laptops) gets a fresh private folder; on a cluster a missing setting is an
    error, because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) for iterative operators")
    path = tempfile.mkdtemp(prefix="scrubjay-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder).

    Iterative operators call this every round so that plans stay small and a
    lost executor re-reads the checkpoint instead of replaying all rounds.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_tasks(df: DataFrame, rows: int, a_task: int | None = None) -> DataFrame:
    """``df`` in one partition per ``a_task`` rows (``ROWS_A_TASK``) when ``rows``, its most rows, need no more.

    A round over a small table in as many tasks as a large shuffle has leaves
    that many files and log entries at each exchange; in one partition it needs
    no exchange. Tables with more rows keep their partitions.
    """
    return df.coalesce(max(1, -(-rows // (a_task or ROWS_A_TASK))))


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the number of rows, in ``few_tasks``."""
    out = cut_lineage(df)
    rows = out.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()
    return few_tasks(out, rows), rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition before CPU-heavy per-row work when the input has fewer
    partitions than the cluster has task slots (a small file of long texts
    is one split). On large inputs this is a no-op."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys) if keys else df.repartition(slots)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``scrubjay`` importable in Python workers (pandas UDFs reference it).

    Zips the package once per application and registers it with
    ``addPyFile``, which copies it to every executor, as a deployment would.
    """
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="scrubjay-pkg-"), "scrubjay.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
