"""Saved history as a stream: each conversation's last messages, held as keyed state.

State is what a key keeps between micro-batches: its newest messages, at most as many as history has.
A batch writes the conversations that it has changed to a folder of its own number, so a repeated
batch replaces what it wrote before and changes nothing else; reading takes each one's newest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.history import LIMIT, normalize_messages

MESSAGE = "struct<turn:bigint,role:string,content:string>"


def save_history(messages: DataFrame, out: str, checkpoint: str, key: str = "conv_id", limit: int = LIMIT, trigger: dict | None = None) -> StreamingQuery:
    """Keep the last ``limit`` messages (key, turn, role, content) of each key of a stream in the folder ``out``.

    Messages of users and assistants with text count, by (turn, role, content); those with a null key
    or turn don't. They may come in any order: what is kept is the newest of all that came.
    """
    kind = dict(messages.dtypes)[key]

    def keep(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held = heapq.nlargest(limit, [*held, *zip(f["turn"].tolist(), f["role"].tolist(), f["content"].tolist(), strict=True)])
        state.update(tuple(map(list, zip(*held, strict=True))))
        yield pd.DataFrame({key: [name[0]], "messages": [[{"turn": t, "role": r, "content": c} for t, r, c in held]]})

    rows = normalize_messages(messages).filter(F.col(key).isNotNull() & F.col("turn").isNotNull()).select(key, F.col("turn").cast("long").alias("turn"), "role", "content")
    held = rows.groupBy(key).applyInPandasWithState(keep, f"`{key}` {kind}, messages array<{MESSAGE}>", "turn array<bigint>, role array<string>, content array<string>", "update", "NoTimeout")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return held.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def saved_history(spark: SparkSession, out: str, key: str = "conv_id", kind: str = "bigint") -> DataFrame:
    """(key, turn, role, content, n) of the newest state of each key, n from the end; empty before the first batch."""
    rows = spark.read.schema(f"`{key}` {kind}, messages array<{MESSAGE}>, batch bigint").parquet(out)
    newest = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch")))).filter("_n = 1")
    return newest.select(key, F.posexplode("messages").alias("n", "m")).select(key, "m.*", (F.col("n") + 1).alias("n"))
