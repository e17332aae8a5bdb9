"""Reading a catalog of true events: its order, its species, its events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config.synthetic import SyntheticConfig


def for_species(catalog: DataFrame, species: str) -> DataFrame:
    """The rows of one species."""
    return catalog.where(F.col("species") == species)


def in_order(catalog: DataFrame, cfg: SyntheticConfig) -> DataFrame:
    """Rows with instrument_no, species_no and event_order, sorted by them: instruments and species as the configuration lists
    them, a species' rows by peak, then id.  Tables have no order of their own, these columns keep it."""
    places = {(i, s): (a, b) for a, (i, spec) in enumerate(cfg.instruments.items()) for b, s in enumerate(spec.species)}
    known = catalog.sparkSession.createDataFrame([(*k, *v) for k, v in places.items()], "instrument string, species string, instrument_no int, species_no int")
    out = catalog.join(F.broadcast(known), ["instrument", "species"], "left").select(*catalog.columns, "instrument_no", "species_no")  # a row a species of the configuration
    order = ["instrument_no", "species_no", "peak_time", "event_id"]
    return out.withColumn("event_order", F.struct(*order)).orderBy("event_order")


def event_ids(ordered: DataFrame) -> DataFrame:
    """event_id of every event once, sorted by where it appears first in ``in_order``'s rows."""
    return ordered.groupBy("event_id").agg(F.min("event_order").alias("first")).orderBy("first").select("event_id")


def counts(catalog: DataFrame) -> DataFrame:
    """One row: n_rows, n_events, n_children (events with a parent), n_species."""
    child = F.col("parent_event_id").isNotNull()
    return catalog.agg(F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_events"), F.count_distinct(F.when(child, F.col("event_id"))).alias("n_children"), F.count_distinct("species").alias("n_species"))
