"""Gap segments and events of streaming tables.

Event time must be a TIMESTAMP (with zone); rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gap_segments(df: DataFrame, keys: list[str], ts: str, gap: str, *, late: str = "10 minutes") -> DataFrame:
    """keys, start, end, n of each run of rows less than ``gap`` apart; closed when the watermark passes its end.

    ``end`` is the last row's time plus the gap, as session windows have it.
    """
    w = F.session_window(ts, gap)
    return df.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def events(df: DataFrame, key: str, us: str, delta: str, sigma: str, *, enter: float, leave: float, max_gap_us: int, min_duration_us: int) -> DataFrame:
    """Events of a key's samples, which must arrive in time order: key, start_us, peak_us, end_us, amplitude, n.

    State is one open event a key.  An event is given out when a sample inside an event comes more than ``max_gap_us``
    after its last one, or when a sample beyond the gap shows that it can't go on.
    """

    def go(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, start, peak, end, top, n = state.get if state.exists else (0, None, None, None, None, 0)
        out = []

        def close() -> None:
            nonlocal start, n
            if start is not None and end - start >= min_duration_us:
                out.append((k[0], start, peak, end, top, n))
            start, n = None, 0

        for pdf in batches:
            pdf = pdf.sort_values(us, kind="stable")
            for t, d, s in zip(pdf[us].tolist(), pdf[delta].tolist(), pdf[sigma].tolist()):
                if d is not None and d == d:
                    inside = 1 if d > enter * s else 0 if d < leave * s else inside
                if start is not None and t - end > max_gap_us:
                    close()
                if inside:
                    if start is None:
                        start, peak, top = t, t, d
                    end, n = t, n + 1
                    if d is not None and d == d and d > top:
                        peak, top = t, d
        state.update((inside, start, peak, end, top, n))
        if out:
            yield pd.DataFrame(out, columns=[key, "start_us", "peak_us", "end_us", "amplitude", "n"])

    kind = dict(df.dtypes)[key]
    return df.select(key, us, delta, sigma).groupBy(key).applyInPandasWithState(go, f"`{key}` {kind}, start_us bigint, peak_us bigint, end_us bigint, amplitude double, n bigint", "inside int, start bigint, peak bigint, last bigint, top double, n bigint", "append", GroupStateTimeout.NoTimeout)
