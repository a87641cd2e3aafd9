"""Online mode: prior counts by key over a stream of events, kept in state.

Events of a micro-batch are put in order of (time, seq) inside each key; state survives restarts through the checkpoint. Rows later than the watermark are
dropped by Spark before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "seq bigint, {key} {kind}, clicks bigint, impressions bigint"


def prior_counts_stream(events: DataFrame, key: str, *, time: str = "time", delay: str = "10 minutes") -> DataFrame:
    """For each event of a stream (seq, *key*, clicked 0/1, update 0/1, *time* timestamp): clicks and impressions of the key before it.

    Events with update = 0 look but don't change the state.
    """
    kind = dict(events.dtypes)[key]

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clicks, shown = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["time_", "seq"], kind="stable")
        clicked = (rows["clicked"] * rows["update"]).cumsum()
        updates = rows["update"].cumsum()
        out = pd.DataFrame({"seq": rows["seq"], key: keys[0], "clicks": clicks + clicked - rows["clicked"] * rows["update"], "impressions": shown + updates - rows["update"]})
        state.update((int(clicks + clicked.iloc[-1]), int(shown + updates.iloc[-1])))
        yield out

    ready = events.withWatermark(time, delay).select("seq", key, F.col("clicked").cast("bigint"), F.col("update").cast("bigint"), F.col(time).alias("time_"))
    return ready.groupBy(key).applyInPandasWithState(run, OUT.format(key=key, kind=kind), "clicks bigint, shown bigint", "append", GroupStateTimeout.NoTimeout)
