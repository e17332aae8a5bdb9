"""ICARTT files of format 1001: a header that counts its own lines, then comma-separated numbers.

One file is one task's work at a time; a file is a day of one instrument, which bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.manifest import ICARTTLoader, InstrumentConfig
from ..errors import IngestError
from ..functions.time import from_us
from .paths import crawl, latest_revisions, path_field


@dataclass
class Header:
    lines: int
    date: datetime
    names: list[str]
    scale: list[float]
    missing: list[float]


def parse_header(text: list[str]) -> Header:
    """The first line counts the header's lines; 7 is the date, 10 the number of variables, 11 and 12 scales and missing marks."""
    try:
        count, kind = (int(x) for x in text[0].replace(",", " ").split()[:2])
        if kind != 1001:
            raise IngestError(f"format {kind} is not 1001")
        y, m, d = (int(x) for x in text[6].replace(",", " ").split()[:3])
        n = int(text[9].split(",")[0])
        numbers = lambda s: [float(x) for x in s.replace(",", " ").split()]
        names = [text[8].split(",")[0].strip(), *(text[12 + i].split(",")[0].strip() for i in range(n))]
        scale, missing = numbers(text[10]), numbers(text[11])
    except (ValueError, IndexError) as e:
        raise IngestError(f"bad header: {e}") from e
    # archives hold files whose lists are short: what is missing is 1 and no mark
    return Header(count, datetime(y, m, d), names, (scale + [1.0] * n)[:n], (missing + [float("nan")] * n)[:n])


def parse_file(text: str) -> pd.DataFrame:
    """us and a column a variable.  Missing marks and cells that aren't numbers are null; rows cut short or without a time are passed over."""
    rows = text.splitlines()
    h = parse_header(rows)
    start = int((h.date - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    n = len(h.names)
    cells = [c[:n] for c in (line.split(",") for line in rows[h.lines :]) if len(c) >= n]
    df = pd.DataFrame({k: pd.to_numeric(pd.Series([c[i].strip() for c in cells], dtype=object), errors="coerce").astype(float) for i, k in enumerate(h.names)})
    df = df[np.isfinite(df[h.names[0]])].reset_index(drop=True)
    out = pd.DataFrame({"us": (df[h.names[0]] * 1e6).round().astype("int64") + start})
    for name, scale, missing in zip(h.names[1:], h.scale, h.missing):
        x = df[name]
        out[name] = x.where((x != missing) & ~((missing < -900) & (x <= missing))) * scale
    return out


def read_icartt(spark: SparkSession, base: str, inst: InstrumentConfig) -> DataFrame:
    """``time``, ``us`` and the instrument's raw columns (numbers) of its files, ``file``, and a column for each path field; a column a file lacks is null.

    A file that can't be parsed gives one row with its error in ``problem``; ``problem`` is null elsewhere.
    """
    cfg = inst.loader
    assert isinstance(cfg, ICARTTLoader)
    files = [p for p, _ in crawl(spark, base, cfg.path_templates, inst.metadata)]
    if cfg.revision_policy == "latest":
        files = latest_revisions(files)
    if not files:
        raise IngestError(f"no file under {base} matches {list(cfg.path_templates)}")
    wanted = sorted({c for v in inst.variables.values() for c in _columns(v)})

    def go(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    got, problem = parse_file(bytes(content).decode("utf-8", "replace")), None
                except IngestError as e:
                    got, problem = pd.DataFrame({"us": [None]}), str(e)
                yield pd.DataFrame({"file": path, "problem": problem, "us": got["us"].astype("Int64"), **{c: got[c] if c in got else None for c in wanted}})

    schema = "file string, problem string, us bigint, " + ", ".join(f"`{c}` double" for c in wanted)
    raw = spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(go, schema)
    for f in cfg.template_fields:
        raw = raw.withColumn(f, path_field(F.col("file"), cfg.path_templates, f, inst.metadata))
    return raw.withColumn("time", from_us(F.col("us")))


def _columns(v) -> set[str]:
    out = {v.column} | {r.flag_column for r in v.qaqc if hasattr(r, "flag_column")}
    for c in (v.uncertainty.random, v.uncertainty.systematic) if v.uncertainty else ():
        if c is not None and hasattr(c, "column"):
            out.add(c.column)
    return out
