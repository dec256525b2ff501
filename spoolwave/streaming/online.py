"""Digital lines and gap sections on unbounded input; an extension, with the rules of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def line_periods(changes: DataFrame, key: str, at: str, rising: str) -> DataFrame:
    """(key, onset, offset) of a stream of line changes: a period comes out when it closes.

    State per line: whether it is high and since when. Changes of a line must come in order across batches; inside a batch
    they are sorted by time. Repeats and leading falls are ignored, as in high_periods.
    """
    kind = dict(changes.dtypes)[key]

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        out = []
        for t, up in pd.concat(batches).sort_values(at, kind="stable")[[at, rising]].itertuples(index=False):
            if up and since is None:
                since = int(t)
            elif not up and since is not None:
                out.append((keys[0], since, int(t)))
                since = None
        state.update((since,))
        yield pd.DataFrame(out, columns=[key, "onset", "offset"])

    return changes.select(key, F.col(at).cast("bigint").alias(at), rising).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, onset bigint, offset bigint", "since bigint", "append", GroupStateTimeout.NoTimeout)


def gap_sections(records: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, records) of runs without a pause longer than `gap`, closed by the watermark (`late`)."""
    w = F.session_window(time, gap)
    return records.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("records")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "records")


def envelopes(samples: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(channel, start, lo, hi): min and max per channel and fixed window of a live signal (A01); NaN is skipped."""
    rows = samples.withWatermark(time, late).where(~F.isnan("value"))
    return rows.groupBy("channel", F.window(time, width).alias("w")).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select("channel", F.col("w.start").alias("start"), "lo", "hi")
