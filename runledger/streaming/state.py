"""Stream jobs with keyed state: first arrivals by id, tool calls by run and tool.

State lies in RocksDB, an ordered store on the executors' disks with a Bloom filter per file and compaction in
the background; what a batch changes goes to the checkpoint folder as a change log. So a batch reads and writes the keys it
touches, whatever was stored before. Neither job uses time to forget: an event may come at any moment and
still finds the keys it belongs to.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from runledger.functions.payload import fields
from runledger.operators.timeline import LAST_SEQUENCE
from runledger.schemas import TOOL_TYPES

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = 512  # tool events of one key that are read and written together


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """For streams started after this."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


BUCKETS = 512  # groups of ids a batch is sorted in


def _first_rows(rows: pa.Table) -> pa.Table:
    """Of each id the row that was received first, missing times and numbers before others."""
    order = [("id", "ascending"), ("received_at", "ascending"), ("ingestion_order", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
    codes = rows["id"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return rows.filter(pa.array(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]])))


def _first_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _first_rows(pa.Table.from_batches([batch])).to_batches()


def first_arrivals(events: DataFrame) -> DataFrame:
    """Of a stream of events, the first row of each id: by batch, in a batch by time of receipt and arrival number.

    Only ids are state. A batch is cut down to one row an id before, first in the pieces it comes in, so that many
    copies of one id do not meet in one group.
    """
    keep_state_in_rocksdb(events.sparkSession)
    few = events.mapInArrow(_first_in_pieces, events.schema)
    once = few.groupBy(F.pmod(F.xxhash64("id"), F.lit(BUCKETS))).applyInArrow(_first_rows, events.schema)
    return once.dropDuplicates(["id"])


CALLS_DDL = ("run_id STRING, tool_key STRING, start_id STRING, timestamp TIMESTAMP, end_id STRING, duration_ms BIGINT, "
             "state STRING, newest TIMESTAMP")
START = "tool.call.start"


class ToolEvents:
    """The tool events of one run and tool in timeline order, as chunks of a state store.

    An event is [micros, sequence, arrival, is_start, id]. Up to CHUNK of them lie in one value; beyond that the
    value holds where each chunk starts, and the chunks and ids lie in maps, so an event touches its neighbours alone.
    """

    def __init__(self, whole, chunks, ids):
        self.whole, self.chunks, self.ids = whole, chunks, ids
        stored = json.loads(whole.get()[0]) if whole.exists() else {}
        self.cuts = stored.get("cuts")  # [first event's order, number of the chunk]
        self.loaded = {} if self.cuts else {0: stored.get("events", [])}
        self.changed = set()

    def _chunk(self, at: int) -> list:
        number = self.cuts[at][1] if self.cuts else 0
        if number not in self.loaded:
            self.loaded[number] = json.loads(self.chunks.getValue((number,))[0])
        return self.loaded[number]

    def add(self, event: list) -> bool:
        """Whether the event is new; it takes its place."""
        if self.cuts:
            if self.ids.containsKey((event[4],)):
                return False
            self.ids.updateValue((event[4],), (True,))
        elif any(e[4] == event[4] for e in self.loaded[0]):
            return False
        at = self._place(event)
        insort(self._chunk(at), event)
        self.changed.add(self.cuts[at][1] if self.cuts else 0)
        if len(self._chunk(at)) > CHUNK:
            self._split(at)
        return True

    def _place(self, event: list) -> int:
        return max(0, bisect_right(self.cuts, [event, sys.maxsize]) - 1) if self.cuts else 0

    def _split(self, at: int) -> None:
        if not self.cuts:
            self.cuts = [[self.loaded[0][0], 0]]
            for e in self.loaded[0]:
                self.ids.updateValue((e[4],), (True,))
        events, number = self._chunk(at), max(n for _, n in self.cuts) + 1
        half = len(events) // 2
        self.loaded[self.cuts[at][1]], self.loaded[number] = events[:half], events[half:]
        self.cuts.insert(at + 1, [events[half], number])
        self.changed |= {self.cuts[at][1], number}

    def around(self, event: list) -> tuple[list | None, list, list | None]:
        """The event before, the event, the event after."""
        at = self._place(event)
        own = self._chunk(at)
        k = own.index(event)
        before = own[k - 1] if k else self._chunk(at - 1)[-1] if self.cuts and at else None
        after = own[k + 1] if k + 1 < len(own) else self._chunk(at + 1)[0] if self.cuts and at + 1 < len(self.cuts) else None
        return before, event, after

    def save(self) -> None:
        if not self.cuts:
            self.whole.update((json.dumps({"events": self.loaded[0]}),))
            return
        self.whole.update((json.dumps({"cuts": self.cuts}),))
        for number in self.changed:
            self.chunks.updateValue((number,), (json.dumps(self.loaded[number]),))


class OpenTools(StatefulProcessor):
    """Pairs each start with the event that follows it in its run and tool, and gives what changed."""

    def __init__(self, remind_ms: int | None):
        self.remind_ms = remind_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.whole = handle.getValueState("whole", "events string")
        self.chunks = handle.getMapState("chunks", "number int", "events string")
        self.ids = handle.getMapState("ids", "id string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        events, touched, newest = ToolEvents(self.whole, self.chunks, self.ids), [], None
        for r in sorted(rows, key=lambda r: r["arrival"]):
            newest = r["micros"] if newest is None else max(newest, r["micros"])
            event = [r["micros"], r["sequence"], r["arrival"], r["is_start"], r["id"]]
            if events.add(event):
                touched.append(event)
        starts = {}
        for event in touched:
            before, _, after = events.around(event)
            for one, nxt in ((before, event), (event, after)):
                if one and one[3]:
                    starts[one[4]] = (one, nxt)
        if touched:
            events.save()
        still_open = False
        for one, _ in list(starts.values()):
            _, _, nxt = events.around(one)
            state = "open" if nxt is None else "none" if nxt[3] else "closed"
            still_open |= state == "open"
            yield self._row(key, one[4], one[0], nxt[4] if state == "closed" else None, nxt[0] // 1000 - one[0] // 1000 if state == "closed" else None, state, newest)
        if not starts:
            yield self._row(key, None, None, None, None, "none", newest)
        if still_open and self.remind_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.remind_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """A start still open when its time is over."""
        events = ToolEvents(self.whole, self.chunks, self.ids)
        last = events._chunk(len(events.cuts) - 1 if events.cuts else 0)[-1]
        if last[3]:
            yield self._row(key, last[4], last[0], None, None, "unclosed", last[0])

    @staticmethod
    def _row(key, start_id, micros, end_id, duration, state, newest) -> Row:
        return Row(run_id=key[0], tool_key=key[1], start_id=start_id, micros=micros, end_id=end_id, duration_ms=duration, state=state, newest=newest)

    def close(self) -> None:
        pass


def tool_call_changes(events: DataFrame, remind_ms: int | None = None) -> DataFrame:
    """Of a stream of events, the tool calls whose pairing changes, in `CALLS_DDL`.

    State is `closed`, `open`, or `none` for a start that another start follows; an event repeated under its id
    changes nothing. With `remind_ms`, a start still open after that long on the clock comes again as `unclosed`.
    """
    keep_state_in_rocksdb(events.sparkSession)
    p = fields("payload", toolId="string", toolName="string")
    tools = events.where(F.col("type").isin(TOOL_TYPES)).select(
        "run_id", F.coalesce(p["toolId"], p["toolName"], F.lit("")).alias("tool_key"), F.unix_micros("timestamp").alias("micros"),
        F.coalesce("sequence", F.lit(LAST_SEQUENCE)).alias("sequence"), F.coalesce("ingestion_order", F.lit(0)).alias("arrival"), (F.col("type") == START).alias("is_start"), "id")
    raw = StructType.fromDDL("run_id STRING, tool_key STRING, start_id STRING, micros BIGINT, end_id STRING, duration_ms BIGINT, state STRING, newest BIGINT")
    out = tools.groupBy("run_id", "tool_key").transformWithState(
        statefulProcessor=OpenTools(remind_ms), outputStructType=raw, outputMode="update", timeMode="None" if remind_ms is None else "ProcessingTime")
    return out.select("run_id", "tool_key", "start_id", F.timestamp_micros("micros").alias("timestamp"), "end_id", "duration_ms", "state", F.timestamp_micros("newest").alias("newest"))
