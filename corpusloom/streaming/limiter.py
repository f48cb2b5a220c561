"""A request limiter as a stateful stream, and its trailing count as a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT, SECONDS = 30, 60
#: Seconds after its last arrival at which a key that was not asked leaves the state.
IDLE = 600
#: State of this kind needs it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Limiter(StatefulProcessor):
    """Of each key the times of its allowed requests that still count, and the latest time at which it was asked. A timer takes
    both out when the key has been idle."""

    def __init__(self, key: str, limit: int, span: int, idle: int):
        self.key, self.limit, self.span, self.idle = key, limit, span, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times, self.last = handle.getListState("times", "at long"), handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, arrived = [], 0
        for r in rows:  # two numbers of each request of a micro-batch
            parts.append(r[["at", "event_id"]].to_numpy(np.int64))
            arrived = max(arrived, int(r["arrived_ms"].max()))
        asked = np.concatenate(parts)
        asked = asked[np.lexsort((asked[:, 1], asked[:, 0]))]
        clock = self.last.get()[0] if self.last.exists() else int(asked[0, 0])
        times = [t[0] for t in self.times.get()] if self.times.exists() else []
        allowed = np.zeros(len(asked), bool)
        for n, at in enumerate(asked[:, 0].tolist()):
            clock = max(clock, at)
            times = [t for t in times if t > clock - self.span]
            if len(times) < self.limit:
                allowed[n] = True
                times.append(clock)
        self.last.update((clock,))
        if times:
            self.times.put([(t,) for t in times])
        else:
            self.times.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(arrived + self.idle * 1000)
        yield pd.DataFrame({self.key: key[0], "event_id": asked[:, 1], "at": asked[:, 0], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        self.last.clear()
        yield pd.DataFrame({self.key: pd.Series([], dtype="int64"), "event_id": pd.Series([], dtype="int64"), "at": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def limited(requests: DataFrame, key: str = "user_id", limit: int = LIMIT, seconds: int = SECONDS, idle: int = IDLE, prefix: str | None = None) -> DataFrame:
    """requests (streaming): key, event_id, at (long, microseconds), and path where a prefix is given. Every request with whether it
    is allowed: no more than limit allowed ones in the seconds before it; rejected ones do not count. Requests whose path does not
    begin with the prefix are allowed and do not count.

    The clock of a key never goes back: a request is judged at its own time or, if that is later, at the latest one that its key was
    asked at in an earlier micro-batch, however late it comes. The state holds at most limit times of each key, and of keys that were
    asked in the last idle seconds (by arrival) only: idle has to be longer than what may lie between micro-batches whose
    requests count together. Times of a key in a micro-batch are put in order first; a trigger's limits on files or bytes bound how
    many are held."""
    asked = requests if prefix is None else requests.where(F.startswith("path", F.lit(prefix)))
    schema = f"{key} long, event_id long, at long, allowed boolean"
    # timers follow the time of arrival: no request is late by it, and a run over all that is there ends
    arriving = asked.select(key, "event_id", "at", F.current_timestamp().alias("arrived")).withWatermark("arrived", "0 seconds").withColumn("arrived_ms", F.unix_millis("arrived"))
    judged = arriving.groupBy(key).transformWithStateInPandas(Limiter(key, limit, seconds * 1_000_000, idle), schema, "append", "eventTime")
    if prefix is None:
        return judged
    free = requests.where(~F.coalesce(F.startswith("path", F.lit(prefix)), F.lit(False)))
    return judged.union(free.select(F.col(key).cast("long"), F.col("event_id").cast("long"), F.col("at").cast("long"), F.lit(True)))


def requests_of(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def run_to_table(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there (and was not there in an earlier run), into a table, and read that."""
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def trailing_count(events: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """Requests of a user up to seconds before each one, itself included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = W.partitionBy("user_id").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.select("event_id", "user_id", F.count("*").over(span).alias("recent"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark, batch or streaming."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def folded_replies(lines: DataFrame) -> DataFrame:
    """lines: reply_id, body (newline-delimited JSON of a model). The contents of all messages in order; lines that are no
    JSON are passed over."""
    parts = lines.select("reply_id", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    content = parts.select("reply_id", "n", F.coalesce(F.get_json_object("line", "$.message.content"), F.get_json_object("line", "$.response")).alias("content"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("n", "content"))))
    return content.groupBy("reply_id").agg(F.array_join(F.transform(ordered, lambda p: p["content"]), "").alias("reply"))
