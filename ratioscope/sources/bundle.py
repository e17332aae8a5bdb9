"""A dataset on disk: ``bundle.json``, ``config.yaml``, the catalog and one Parquet table a stream."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..config.spec import Spec
from ..config.synthetic import TRUTH, SyntheticConfig
from ..errors import BundleError

VERSION = 1
_N, _Y = False, True
#: The catalog's columns, in their order.
CATALOG = T.StructType(
    [T.StructField("event_id", T.StringType(), _N), T.StructField("parent_event_id", T.StringType(), _Y)]
    + [T.StructField(c, T.StringType(), _N) for c in ("source_name", "species", "instrument", "reference_species")]
    + [T.StructField(c, T.TimestampNTZType(), _N) for c in ("start_time", "peak_time", "end_time")]
    + [T.StructField("true_amplitude", T.DoubleType(), _N), T.StructField("sampled_peak_amplitude", T.DoubleType(), _Y)]
    + [T.StructField(c, T.DoubleType(), _N) for c in ("true_baseline_at_peak", "true_ratio_to_reference")]
    + [T.StructField(c, T.DoubleType(), _Y) for c in ("latitude", "longitude")]
)


@dataclass
class Dataset:
    """Lazy streams by instrument, the catalog of true events, and what made them."""

    streams: dict[str, DataFrame]
    catalog: DataFrame
    config: Spec | None = None
    attributes: dict[str, Any] = field(default_factory=dict)

    def observable(self, instrument: str) -> DataFrame:
        """A stream without its answer key."""
        if instrument not in self.streams:
            raise KeyError(f"no stream {instrument!r}; there are {sorted(self.streams)}")
        df = self.streams[instrument]
        return df.select(*[c for c in df.columns if not c.startswith(TRUTH)])

    def save(self, spark: SparkSession, path: str) -> None:
        save_bundle(spark, self, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dataset:
        return load_bundle(spark, path)


def conform_catalog(df: DataFrame) -> DataFrame:
    """The catalog's columns, order and types; a missing column is an error."""
    if lacking := [f.name for f in CATALOG if f.name not in df.columns]:
        raise BundleError(f"the catalog lacks {lacking}")
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in CATALOG))


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _get(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise BundleError(f"{path} is missing")
    src = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(src, "UTF-8")
    finally:
        src.close()


def save_bundle(spark: SparkSession, ds: Dataset, path: str) -> None:
    """Write or overwrite; the manifest comes last, so that a folder without one is unfinished."""
    fs, p = _fs(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        raise BundleError(f"{path} is a file")
    conform_catalog(ds.catalog).write.mode("overwrite").parquet(f"{path}/ground_truth.parquet")
    for name, df in ds.streams.items():
        df.write.mode("overwrite").parquet(f"{path}/streams/{name}")
    if ds.config is not None:
        import yaml

        _put(spark, f"{path}/config.yaml", yaml.safe_dump(ds.config.plain(), sort_keys=False))
    _put(spark, f"{path}/bundle.json", json.dumps({"format_version": VERSION, "streams": sorted(ds.streams), "has_config": ds.config is not None, "attributes": ds.attributes}, indent=1))


def load_bundle(spark: SparkSession, path: str) -> Dataset:
    """Check the folder's parts and open them lazily."""
    fs, p = _fs(spark, path)
    if not fs.exists(p) or fs.getFileStatus(p).isFile():
        raise BundleError(f"{path} is not a folder")
    try:
        about = json.loads(_get(spark, f"{path}/bundle.json"))
    except json.JSONDecodeError as e:
        raise BundleError(f"{path}/bundle.json: {e}") from e
    if about.get("format_version") != VERSION:
        raise BundleError(f"{path}: format {about.get('format_version')!r} is not {VERSION}")
    config = None
    if about.get("has_config"):
        import yaml

        config = SyntheticConfig.read(yaml.safe_load(_get(spark, f"{path}/config.yaml")))
    for part in ["ground_truth.parquet", *(f"streams/{s}" for s in about["streams"])]:
        sub_fs, sub_p = _fs(spark, f"{path}/{part}")
        if not sub_fs.exists(sub_p):
            raise BundleError(f"{path}/{part} is missing")
    catalog = conform_catalog(spark.read.parquet(f"{path}/ground_truth.parquet"))
    return Dataset({s: spark.read.parquet(f"{path}/streams/{s}") for s in about["streams"]}, catalog, config, about.get("attributes", {}))
