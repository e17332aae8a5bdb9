"""Delimited text files of a manifest's instrument."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.manifest import CSVLoader, InstrumentConfig
from ..errors import IngestError
from ..functions.time import epoch_us, parse_time
from .paths import crawl, path_field


def read_delimited(spark: SparkSession, base: str, inst: InstrumentConfig) -> DataFrame:
    """Raw columns as text with ``time`` (UTC, no zone), ``us`` and a column for each path field.

    All columns are read as text: extra missing marks become null and numbers are cast where they are used, so a bad cell
    is null and never fails a file.  Comments and blank lines count nowhere.  The rows above a header are told from data by their
    place in their own file, never by what they hold.  Names come from the first file; a file whose header differs, in names or
    in their order, is refused when it is read.  Rows without a time are dropped.
    """
    cfg = inst.loader
    assert isinstance(cfg, CSVLoader)
    files = crawl(spark, base, cfg.path_templates, inst.metadata)
    if not files:
        raise IngestError(f"no file under {base} matches {list(cfg.path_templates)}")
    names = _header(spark, files[0][0], cfg)
    if cfg.time.column not in names:
        raise IngestError(f"{files[0][0]}: no time column {cfg.time.column!r} among {names}")
    lines = spark.read.text([p for p, _ in files]).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    data = lines.mapInArrow(_below_headers(cfg, names), "value string, _path string")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"sep": cfg.delimiter, "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    raw = data.select(F.from_csv("value", schema, options).alias("_r"), "_path")
    cell = lambda n: F.col("_r").getField(n)
    raw = raw.select(*(F.when(~cell(n).isin("", *cfg.na_values), cell(n)).alias(n) for n in names), "_path")
    out = raw.withColumn("time", parse_time(F.col(f"`{cfg.time.column}`"), cfg.time.format, cfg.time.timezone)).where("time is not null")
    for f in cfg.template_fields:
        out = out.withColumn(f, path_field(F.col("_path"), cfg.path_templates, f, inst.metadata))
    return out.withColumn("us", epoch_us(F.col("time"))).drop("_path")


def _names(line: str, delimiter: str) -> list[str]:
    return [x.strip() for x in next(csv.reader([line.removeprefix("\ufeff")], delimiter=delimiter))]


def _header(spark: SparkSession, file: str, cfg: CSVLoader) -> list[str]:
    v = F.col("value")
    rows = spark.read.text(file).where(F.trim(v) != "").where(~v.startswith(cfg.comment) if cfg.comment else F.lit(True)).limit(cfg.header_row + 1).collect()
    if len(rows) <= cfg.header_row:
        raise IngestError(f"{file}: has no row {cfg.header_row}")
    names = _names(rows[cfg.header_row][0], cfg.delimiter)
    if len(set(names)) < len(names):
        raise IngestError(f"{file}: a column name is given twice: {names}")
    return names


def _below_headers(cfg: CSVLoader, names: list[str]):
    """Lines (value, _path, _start) without comments, blank lines, headers and what stands above them.

    A file comes to a task in blocks, each in order and without other files between; the one that starts at 0 has the header.
    """
    comment, delimiter, skip = cfg.comment, cfg.delimiter, cfg.header_row

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, 0  # the block that is read, and how many rows are to come until below its header
        for b in batches:
            value = b.column(0)
            keep = pc.not_equal(pc.utf8_trim_whitespace(value), "")
            if comment:
                keep = pc.and_(keep, pc.invert(pc.starts_with(value, comment)))
            b = b.filter(keep)
            n, path, start = b.num_rows, b.column(1), b.column(2).to_numpy()
            fresh = pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False) | (start[1:] != start[:-1]) if n > 1 else np.empty(0, bool)
            blocks = [0, *(np.flatnonzero(fresh) + 1).tolist(), n] if n else [0]
            kept = np.ones(n, bool)
            for lo, hi in zip(blocks, blocks[1:]):
                if (own := (path[lo].as_py(), int(start[lo]))) != at:
                    at, left = own, skip + 1 if own[1] == 0 else 0
                for i in range(lo, min(lo + left, hi)):
                    left -= 1
                    kept[i] = False
                    if left == 0 and (found := _names(b.column(0)[i].as_py(), delimiter)) != names:
                        raise IngestError(f"{at[0]}: its header {found} is not {names}")
            yield b.select([0, 1]).filter(pa.array(kept))

    return go
