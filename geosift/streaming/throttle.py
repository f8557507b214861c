"""The last-seen throttle as a stream with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: How long a key's last accepted time is kept after it was set.
KEPT_SECONDS = 7 * 24 * 3600
#: Keyed state needs the RocksDB store; and without data there is nothing to do, whereas a state with a life would have batches run without end.
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def throttled_stream(events: DataFrame, key: str = "user_id", ident: str = "event_id", at: str = "ts", seconds: int = 300, kept_seconds: int = KEPT_SECONDS) -> DataFrame:
    """(key, ident, t) of the events at least ``seconds`` after the last accepted one of their key; t in microseconds.

    The state of a key is one number in the state store.  It goes
    ``kept_seconds`` of the clock after it was last set, so the store holds only
    the keys that were accepted lately; an event that comes later than that, yet
    within ``seconds`` of its key's forgotten one, is accepted anew.  A
    micro-batch hands a key over in chunks of any order, so its times and ids (16
    bytes an event) are gathered and ordered before they are folded: bound a
    micro-batch by the source's own options.  Events without a time are left out.
    """
    micros, kind = seconds * 1_000_000, events.schema[key].dataType.simpleString()

    class LastSeen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "t long", kept_seconds * 1000)

        def handleInputRows(self, k: tuple, chunks: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            t, ids = (np.concatenate(c) for c in zip(*[(pdf["t"].to_numpy(np.int64), pdf[ident].to_numpy(np.int64)) for pdf in chunks]))
            order = np.lexsort((ids, t))
            t, ids = t[order], ids[order]
            last = self.last.get()[0] if self.last.exists() else None
            took, i = [], 0 if last is None else int(np.searchsorted(t, last + micros))
            while i < len(t):  # straight from one accepted event to the next
                took.append(i)
                i = int(np.searchsorted(t, t[i] + micros))
            if took:
                self.last.update((int(t[took[-1]]),))
                yield pd.DataFrame({key: [k[0]] * len(took), ident: ids[took], "t": t[took]})

        def close(self) -> None:
            pass

    timed = events.select(key, F.col(ident).cast("long").alias(ident), F.unix_micros(at).alias("t")).where("t is not null")
    return timed.groupBy(key).transformWithStateInPandas(LastSeen(), f"`{key}` {kind}, `{ident}` long, t long", "Append", "ProcessingTime")


def throttle_query(events: DataFrame, path: str, checkpoint: str, key: str = "user_id", seconds: int = 300, available_now: bool = True, kept_seconds: int = KEPT_SECONDS) -> StreamingQuery:
    """Append (key, event_id, t) of the accepted events to Parquet files under ``path``.

    The sink's log and the state store's versions move together, so a restart
    neither repeats nor loses an event.  The settings that keyed state needs hold
    for this query only.
    """
    conf = events.sparkSession.conf
    before = {k: conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        conf.set(k, v)
    try:
        writer = throttled_stream(events, key, seconds=seconds, kept_seconds=kept_seconds).writeStream.format("parquet").outputMode("append")
        writer = writer.option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)
