"""Measured series from Parquet or CSV files without a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IngestError
from ..functions.time import epoch_us


def read_series(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """``us`` and all other columns of a file or folder; ``form``: parquet or csv, by default what the path ends with.

    The clock is the first column of times.  Rows without a time go; of rows of one time the first of the file stays; a folder's files
    follow each other by name.
    """
    form = form or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    df = spark.read.parquet(path) if form == "parquet" else spark.read.options(header="true", inferSchema="true").csv(path)
    clock = next((f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))), None)
    if clock is None:
        raise IngestError(f"{path}: no column of times among {df.columns}")
    rest = [c for c in df.columns if c != clock]
    # Spark deals files out by size: numbers of rows only rise within a file's block
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = df.select(epoch_us(F.col(f"`{clock}`").cast("timestamp_ntz")).alias("us"), F.struct(at.alias("_at"), *(F.col(f"`{c}`") for c in rest)).alias("_row")).where("us is not null")
    first = rows.groupBy("us").agg(F.min_by("_row", F.col("_row._at")).alias("_row"))
    return first.select("us", *(F.col("_row").getField(c).alias(c) for c in rest))
