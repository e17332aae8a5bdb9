"""Quality rules: a masked value is null, its row stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config.manifest import FlagRule, RangeRule, SpikeRule, VariableConfig
from ..config.spec import micros
from ..functions.scalar import MAD_SCALE, convert, known
from .ordered import DAY
from .windowed import rolling_order


def range_mask(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Strictly below ``low`` or above ``high`` is masked."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (x < low)
    if high is not None:
        bad = bad | (x > high)
    return F.when(~bad, x)


def flag_mask(x: Column, flag: Column, good: tuple | None = None, bad: tuple | None = None) -> Column:
    """Kept where the flag is good, or isn't bad.  A missing flag is neither: it fails a good list and passes a bad one."""

    def of(values: tuple) -> Column:
        texts = [str(v) for v in values]
        nums = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        hit = flag.cast("string").isin(texts)
        return F.coalesce(hit | flag.try_cast("double").isin(nums) if nums else hit, F.lit(False))

    return F.when(of(good) if good is not None else ~of(bad or ()), x)


def spike_mask(df: DataFrame, keys: list[str], us: str, value: str, window_us: int, n_mad: float = 6.0, *, name: str | None = None, chunk_us: int = DAY) -> DataFrame:
    """Masks values further from the rolling median than ``n_mad`` scaled median deviations of the same window."""

    def go(window, x: float) -> tuple:
        m, d = window.mad()
        return (bool(abs(x - m) > n_mad * MAD_SCALE * d),)  # an unknown value is no spike

    out = rolling_order(df, keys, us, value, window_us, {"_spike": "boolean"}, go, chunk_us=chunk_us)
    return out.withColumn(name or value, F.when(~F.col("_spike"), F.col(value))).drop("_spike")


def ingest_variable(df: DataFrame, keys: list[str], us: str, name: str, cfg: VariableConfig, *, chunk_us: int = DAY) -> DataFrame:
    """Column ``name`` from a raw one: number, unit, then the rules in their order; bounds are in the converted unit."""
    x = known(F.col(cfg.column).try_cast("double"))
    df = df.withColumn(name, convert(x, cfg.convert.scale, cfg.convert.offset) if cfg.convert else x)
    for rule in cfg.qaqc:
        if isinstance(rule, RangeRule):
            df = df.withColumn(name, range_mask(F.col(name), rule.min, rule.max))
        elif isinstance(rule, FlagRule):
            df = df.withColumn(name, flag_mask(F.col(name), F.col(rule.flag_column), rule.good_values, rule.bad_values))
        elif isinstance(rule, SpikeRule):
            df = spike_mask(df, keys, us, name, micros(rule.window), rule.n_mad, chunk_us=chunk_us)
    return df
