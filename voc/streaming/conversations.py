"""The last messages of every conversation, kept as its turns come in.

Each conversation's state holds its ``k`` newest turns, whatever order they arrive in, and is given up when nothing was
written to it for ``idle``. Every micro-batch puts out the turns of the conversations that it changed; the row with the largest
``version`` of a conversation and place is the valid one (``latest``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE_MS = 30 * 24 * 3600 * 1000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = "conv_id bigint, turn bigint, role string, text string, back bigint, version bigint"


class _Newest(StatefulProcessor):
    def __init__(self, k: int, idle_ms: int):
        self.k, self.idle_ms = k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        turn = T.StructType([T.StructField("turn", T.LongType())])
        message = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
        seen = T.StructType([T.StructField("batches", T.LongType())])
        self.turns = handle.getMapState("turns", turn, message, self.idle_ms)
        self.version = handle.getValueState("version", seen, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        changed = False
        held = {k[0]: tuple(v) for k, v in self.turns.iterator()}
        before = dict(held)
        for some in rows:
            for turn, role, text in zip(some["turn"], some["role"], some["text"]):
                if len(held) < self.k or turn >= min(held):
                    held[int(turn)] = (role, text)
                    held = dict(sorted(held.items(), reverse=True)[: self.k])
        for turn in before.keys() - held.keys():
            self.turns.removeKey((turn,))
        for turn, message in held.items():
            if before.get(turn) != message:
                self.turns.updateValue((turn,), message)
                changed = True
        if not changed:
            return
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        order = sorted(held, reverse=True)
        yield pd.DataFrame({
            "conv_id": [key[0]] * len(order), "turn": order, "role": [held[t][0] for t in order], "text": [held[t][1] for t in order],
            "back": range(1, len(order) + 1), "version": version,
        })

    def close(self) -> None:
        pass


def last_messages_stream(messages: DataFrame, k: int = 5, idle_ms: int = IDLE_MS) -> DataFrame:
    """``conv_id, turn, role, text, back, version`` of a stream of messages; ``k=1`` follows the last query.

    Of two messages with one turn the later one counts. Needs the state store that keeps several states a key
    (``spark.sql.streaming.stateStore.providerClass`` = ``STORE``). Since states run out by the clock, Spark would go on with
    batches without data: a run that is to end with its input sets ``spark.sql.streaming.noDataMicroBatches.enabled`` to
    false. Messages without conversation or turn are left out.
    """
    known = messages.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    return known.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=_Newest(k, idle_ms), outputStructType=_ROWS, outputMode="Update", timeMode="ProcessingTime"
    )


def latest(updates: DataFrame) -> DataFrame:
    """The valid rows of a sink's updates; equal rows of repeated batches count once."""
    newest = F.max("version").over(Window.partitionBy("conv_id"))
    return updates.distinct().withColumn("newest", newest).where("version = newest").drop("version", "newest")
