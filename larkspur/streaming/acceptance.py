"""Acceptance over streams: first arrivals with their repeats on record, and caps that last.

Both keep state of their own beyond what Spark's built-in operators hold. A restarted stream
goes on from its checkpoint, so a second run knows what the first one took.

Rows without an id have no state: they are never repeats. Within a batch rows count in the
order of their arrival number; an earlier batch comes before a later one, whatever its numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructType

from ..operators.collect import has_id

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Ids are dealt to so many buckets: a thousand ids to a call at four million ids a batch.
BUCKETS = 4096
ID, BUCKET = "__id", "__bucket"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started in here keep their state in a store that arbitrary state asks for."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class FirstWins(StatefulProcessor):
    """Of each id of a bucket the arrival that was taken: its number and its page; and how often it has come.

    A call costs more than an id does, so a call has a bucket of ids. It holds the batch's rows of its bucket.
    """

    def __init__(self, seq: str, page: str, columns: list[str], expiry_ms: int | None):
        self.seq, self.page, self.columns, self.expiry_ms = seq, page, columns, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "id string", "seq long, page long, arrivals long", self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        made = Row(*self.columns, "is_repeat", "first_seq", "first_page", "arrival")
        held, out = {}, []
        for row in sorted(rows, key=lambda r: (r[self.seq] is None, r[self.seq])):
            name = row[ID]
            if name not in held:
                held[name] = self.first.getValue((name,)) or (row[self.seq], row[self.page], 0)
            seq, page, arrivals = held[name]
            held[name] = (seq, page, arrivals + 1)
            out.append(made(*[row[c] for c in self.columns], arrivals > 0, seq, page, arrivals + 1))
        for name, value in held.items():
            self.first.updateValue((name,), value)
        yield from out

    def close(self) -> None:
        pass


def recorded(schema: StructType) -> StructType:
    out = StructType(list(schema.fields))
    for name, kind in (("is_repeat", BooleanType()), ("first_seq", LongType()), ("first_page", LongType()), ("arrival", LongType())):
        out = out.add(name, kind)
    return out


def with_repeats(stream: DataFrame, key: list[str], seq: str = "seq", page: str = "page", expiry_ms: int | None = None) -> DataFrame:
    """Every row, told to be the first of its id or a repeat of it, and where the first one came from.

    ``arrival`` counts an id's rows. After ``expiry_ms`` without an arrival an id is forgotten,
    and comes as new again; without it state grows with the ids. State that expires keeps a
    query awake: ``start`` it and stop it, ``run`` would not end.
    """
    schema = recorded(stream.schema)
    mode = "ProcessingTime" if expiry_ms else "None"
    name = F.to_json(F.struct(*key), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})  # one text for all parts of a key
    named = stream.where(has_id(key[-1])).withColumn(ID, name).withColumn(BUCKET, F.pmod(F.xxhash64(ID), F.lit(BUCKETS)))
    known = named.groupBy(BUCKET).transformWithState(FirstWins(seq, page, stream.columns, expiry_ms), schema, "Append", mode)
    alone = stream.where(~has_id(key[-1])).select("*", F.lit(False).alias("is_repeat"), F.col(seq).cast("long").alias("first_seq"), F.col(page).cast("long").alias("first_page"), F.lit(1).cast("long").alias("arrival"))
    return known.unionByName(alone)


class Capped(StatefulProcessor):
    """How many rows a target has taken. What a batch may add is kept in a heap, so a large target needs no more memory than its cap."""

    def __init__(self, cap: int, seq: str, columns: list[str]):
        self.cap, self.seq, self.columns = cap, seq, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = (self.taken.get() or (0,))[0]
        room, kept = self.cap - had, pd.DataFrame(columns=self.columns)
        best: list[tuple] = []
        for frame in rows:
            if room <= 0:
                continue
            for at, seq in enumerate(frame[self.seq].tolist()):
                heapq.heappush(best, (-seq, len(kept) + at))
                if len(best) > room:
                    heapq.heappop(best)
            kept = pd.concat([kept, frame[self.columns]], ignore_index=True) if len(kept) else frame[self.columns].reset_index(drop=True)
            chosen = sorted((at, s) for s, at in best)
            kept = kept.iloc[[at for at, _ in chosen]].reset_index(drop=True)
            best = [(s, i) for i, (_, s) in enumerate(chosen)]
            heapq.heapify(best)
        if len(kept):
            self.taken.update((had + len(kept),))
            yield kept.sort_values(self.seq, kind="stable")

    def close(self) -> None:
        pass


def within_caps(stream: DataFrame, by: list[str], cap: int, seq: str = "seq") -> DataFrame:
    """The first ``cap`` rows of each target over all batches: a later run adds what a target still lacks."""
    return stream.groupBy(*by).transformWithStateInPandas(Capped(cap, seq, stream.columns), stream.schema, "Append", "None")


def start(stream: DataFrame, out: str, checkpoint: str, partition: list[str] | None = None, **trigger):
    """A query that appends Parquet to ``out`` until it is stopped, or as ``trigger`` says."""
    with keyed_state(stream.sparkSession):
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer = writer.partitionBy(*partition) if partition else writer
        return writer.outputMode("append").trigger(**trigger or {"processingTime": "1 second"}).start()


def run(stream: DataFrame, out: str, checkpoint: str, partition: list[str] | None = None):
    """Runs over what is there now and appends Parquet to ``out``; call again for what comes later."""
    query = start(stream, out, checkpoint, partition, availableNow=True)
    query.awaitTermination()
    return query
