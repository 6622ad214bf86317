"""Scans, sinks and sampling.

Path checks go through the Hadoop FileSystem of the session so the same code
works on HDFS, S3 or ABFS, not only on a local disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SUPPORTED = ("parquet", "csv", "json")


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath)) or len(fs.globStatus(hpath) or []) > 0


def detect_format(path: str) -> str:
    """Format from the suffix, case-insensitive (A4)."""
    p = path.rstrip("/").lower()
    for fmt in SUPPORTED:
        if p.endswith("." + fmt) or p.endswith(".jsonl") and fmt == "json":
            return fmt
    raise ValueError(f"Unsupported file format: {path}")


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: StructType | str | None = None, encoding: str = "utf-8",
               multiline: bool | None = None, check_exists: bool = True) -> DataFrame:
    """Read parquet / csv / json by suffix or explicit ``fmt`` (A1-A4).

    CSV is PERMISSIVE: an unparsable cell becomes NULL and the row is kept, as in
    the reference's ``ignore_errors``. JSON accepts an array-of-records document
    (``multiline=True``, the default for ``.json``) or JSON lines (``.jsonl``).
    """
    if check_exists and not _fs_exists(spark, path):
        raise FileNotFoundError(path)
    fmt = (fmt or detect_format(path)).lower()
    if fmt not in SUPPORTED:
        raise ValueError(f"Unsupported file format: {fmt}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "csv":
        r = reader.option("header", True).option("mode", "PERMISSIVE").option("encoding", encoding)
        if schema is None:
            r = r.option("inferSchema", True)
        return r.csv(path)
    if multiline is None:
        multiline = not path.lower().rstrip("/").endswith(".jsonl")
    return reader.option("multiLine", multiline).option("encoding", encoding).json(path)


#: Values keep their blanks, and quotes inside quotes are doubled, as in RFC 4180.
_PLAIN_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CORRUPT = "__corrupt_record"


def read_csv_flagged(spark: SparkSession, path: str, schema: StructType | str, encoding: str = "utf-8", multiline: bool = True) -> DataFrame:
    """CSV of a known schema with its bad rows marked (A2).

    An unparsable cell becomes NULL; its row, and a row with too few or too many cells, stays, is flagged ``csv_parse`` and carries its
    text in ``__corrupt_record`` (else NULL). ``multiline`` reads line breaks inside quotes as part of the value; a file is then one task, so
    large tables should come in many files. Cells are judged whether they are selected or not. An empty cell, quoted or not, is NULL.
    """
    from scrubjay.functions.flags import add_flag

    if not _fs_exists(spark, path):
        raise FileNotFoundError(path)
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    r = (spark.read.options(**_PLAIN_CSV).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
         .option("multiLine", multiline).option("encoding", encoding).schema(StructType([*fields.fields, StructField(CORRUPT, StringType())])))
    # a cell that no expression needs is not parsed, so the flag needs them all, by a condition that always holds
    every = F.pmod(F.hash(*[F.col(f.name) for f in fields.fields]), F.lit(2)) < 2
    return add_flag(r.csv(path), F.col(CORRUPT).isNotNull() & every, "csv_parse")


def write_csv_plain(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV that :func:`read_csv_flagged` reads back unchanged, line breaks and blanks included (empty strings as NULL)."""
    df.write.mode(mode).options(**_PLAIN_CSV).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet (default) or CSV sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"Unsupported output format: {fmt}")


def append_audit_log(entries: DataFrame, path: str) -> None:
    """Append-only audit sink.

    ``entries`` holds ``(timestamp, node, status, detail, job_id)``. Files are
    partitioned by the entry's day, not by job: a directory per job id would
    turn millions of jobs into millions of tiny files. Appends are atomic per
    write through the file committer, so a retried task never leaves a
    half-written log.
    """
    cols = ["timestamp", "node", "status", "detail", "job_id"]
    out = entries.select(*cols, F.to_date("timestamp").alias("log_date"))
    out.write.mode("append").partitionBy("log_date").parquet(path)


def audit_entries(spark: SparkSession, job_id: str, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Build audit-log rows ``(node, status, detail)`` for one job, stamped now."""
    df = spark.createDataFrame(rows, "node string, status string, detail string")
    return df.select(F.current_timestamp().alias("timestamp"), "node", "status", "detail",
                     F.lit(job_id).alias("job_id"))


def sample_first(df: DataFrame, n: int, order_by: list[str | Column]) -> DataFrame:
    """First ``n`` rows in a stated order (A5).

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps
    its own top ``n`` and only those reach the final merge, so this is bounded
    at any table size. A bare ``limit`` would depend on partition timing.
    """
    return df.orderBy(*order_by).limit(n)


def sample_json(df: DataFrame, n: int, order_by: list[str | Column]) -> DataFrame:
    """The first ``n`` rows rendered as one JSON object per row."""
    cols = [c for c in df.columns]
    return (sample_first(df, n, order_by)
            .select(*order_by, F.to_json(F.struct(*cols)).alias("row_json")))


def count_rows(df: DataFrame) -> DataFrame:
    """Row count as a one-row DataFrame (A7); parquet footers answer it when
    aggregate push-down is on."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def repair_utf8(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Replace invalid UTF-8 byte sequences with U+FFFD and flag them.

    ``column`` may be BINARY (raw bytes) or STRING.
    """
    from scrubjay.functions.flags import add_flag

    out = out or column
    raw = F.col(column).cast("binary")
    as_text = raw.cast("string")
    df = df.withColumn("__valid_utf8", F.is_valid_utf8(as_text))
    df = df.withColumn(out, F.make_valid_utf8(as_text))
    df = add_flag(df, ~F.col("__valid_utf8"), f"invalid_utf8:{column}")
    return df.drop("__valid_utf8")
