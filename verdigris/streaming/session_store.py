"""What a session remembers from turn to turn: its last stated facts and its recent messages, over a stream or a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

#: Messages that a session keeps, and those of them that a turn sees.
KEPT, SEEN = 16, 8
#: A session that says nothing for so long is forgotten.
TTL_MS = 24 * 3600 * 1000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def context_schema(turns: DataFrame, key: str, turn: str, fields: list[str]) -> T.StructType:
    return T.StructType([turns.schema[key], turns.schema[turn], *[T.StructField(f, T.StringType()) for f in fields], T.StructField("recent", T.ArrayType(T.StringType())), T.StructField("seen", T.LongType())])


class SessionProcessor(StatefulProcessor):
    """Each session's last value of every field, how many turns it has had, and its last KEPT messages, both with a time to live."""

    def __init__(self, key: str, turn: str, text: str, fields: list[str], ttl_ms: int = TTL_MS):
        self.key, self.turn, self.text, self.fields, self.ttl_ms = key, turn, text, fields, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        facts = T.StructType([*[T.StructField(f, T.StringType()) for f in self.fields], T.StructField("turns", T.LongType())])
        self.facts = handle.getValueState("facts", facts, self.ttl_ms)
        self.messages = handle.getListState("messages", T.StructType([T.StructField("text", T.StringType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values([self.turn, self.text], kind="stable", na_position="first")
        held = list(self.facts.get()) if self.facts.exists() else [None] * len(self.fields) + [0]
        recent = [m[0] for m in self.messages.get()] if self.messages.exists() else []
        out = []
        for row in new[[self.turn, self.text, *self.fields]].itertuples(index=False, name=None):
            held[:-1] = [old if x is None or x != x else x for x, old in zip(row[2:], held[:-1], strict=True)]
            held[-1] += 1
            recent = [*recent, row[1] or ""][-KEPT:]
            out.append((key[0], row[0], *held[:-1], recent[-SEEN:], held[-1]))
        self.facts.update(tuple(held))
        self.messages.put([(m,) for m in recent])
        yield pd.DataFrame(out, columns=[self.key, self.turn, *self.fields, "recent", "seen"])

    def close(self) -> None:
        """Nothing is held beyond the states."""


def stream_contexts(turns: DataFrame, key: str, turn: str, text: str, fields: list[str], *, ttl_ms: int = TTL_MS) -> DataFrame:
    """Every turn of a stream with the fields as last stated in its session, its last SEEN messages, itself among them, and the number of turns so far.

    Turns of one session must arrive in order from batch to batch; within a batch
    they are sorted. The session's state store must be STATE_STORE. Null texts count as empty.
    """
    ship(turns.sparkSession)
    columns = turns.select(key, turn, text, *[F.col(f).cast("string").alias(f) for f in fields])
    processor = SessionProcessor(key, turn, text, fields, ttl_ms)
    return columns.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=context_schema(turns, key, turn, fields), outputMode="Append", timeMode="ProcessingTime")


def batch_contexts(turns: DataFrame, key: str, turn: str, text: str, fields: list[str]) -> DataFrame:
    """The same over a table, by windows."""
    upto = Window.partitionBy(key).orderBy(turn, text).rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(key).orderBy(turn, text).rowsBetween(-(SEEN - 1), 0)
    stated = [F.last(F.col(f).cast("string"), ignorenulls=True).over(upto).alias(f) for f in fields]
    return turns.select(key, turn, *stated, F.collect_list(F.coalesce(text, F.lit(""))).over(last).alias("recent"), F.count(F.lit(1)).over(upto).alias("seen"))
