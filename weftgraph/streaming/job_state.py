"""Job snapshots kept in keyed state: each job's stages, last events and expiry, emitted when they change.

Events are combined for each job and stage within a task before they are shuffled, so a job with a third of all events sends a
few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state of this kind needs; set it before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_PART = "job_id string, stage string, n long, first_us long, last_us long, last_seq long, seqs array<long>"
_SNAPSHOT = "job_id string, current_stage string, updated_us long, n_events long, stages array<struct<stage:string,n:long,first_us:long,last_us:long>>, last_events array<long>"


def _partial(last: int):
    """Events of a batch by job and stage: counts, times and the last ``last`` sequence numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PART.split(", ")]
        for b in batches:
            rows = pa.Table.from_batches([b]).group_by(["job_id", "stage"]).aggregate([("seq", "count"), ("us", "min"), ("us", "max"), ("seq", "max"), ("seq", "list")])
            rows = rows.select(["job_id", "stage", "seq_count", "us_min", "us_max", "seq_max", "seq_list"]).combine_chunks()
            seqs = pa.array([sorted(x, reverse=True)[:last] for x in rows.column("seq_list").to_pylist()], pa.list_(pa.int64()))
            for part in rows.set_column(6, "seqs", seqs).rename_columns(names).to_batches():
                yield part.set_column(2, "n", pc.cast(part.column(2), pa.int64()))

    return run


class JobState(StatefulProcessor):
    """Map state: each stage's count and times. List state: the last sequence numbers. Value state: what was emitted. Timer: expiry."""

    def __init__(self, last: int, keep_ms: int) -> None:
        self.last, self.keep_ms = last, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "stage string", "n long, first_us long, last_us long, last_seq long")
        self.events = handle.getListState("events", "seq long")
        self.emitted = handle.getValueState("emitted", "current_stage string, n_events long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        # each call on state is a round trip; what was emitted is set whenever anything is held, so a new job needs no reads
        emitted = tuple(self.emitted.get()) if self.emitted.exists() else None
        held = {} if emitted is None else {k[0]: tuple(v) for k, v in self.stages.iterator()}
        fresh: dict[str, tuple] = {}
        seqs = [] if emitted is None else [s for (s,) in self.events.get()]
        for frame in rows:
            for r in frame.itertuples(index=False):
                n, first, at, seq = fresh.get(r.stage, (0, r.first_us, r.last_us, r.last_seq))
                fresh[r.stage] = (n + int(r.n), min(first, int(r.first_us)), max(at, int(r.last_us)), max(seq, int(r.last_seq)))
                seqs = sorted([*seqs, *map(int, r.seqs)], reverse=True)[: self.last]
        for stage, (n, first, at, seq) in fresh.items():
            if stage in held:
                old = held[stage]
                n, first, at, seq = old[0] + n, min(old[1], first), max(old[2], at), max(old[3], seq)
            held[stage] = (int(n), int(first), int(at), int(seq))
            self.stages.updateValue((stage,), held[stage])
        self.events.put([(s,) for s in seqs])
        current = max(held, key=lambda s: held[s][3])
        updated, total = max(v[2] for v in held.values()), sum(v[0] for v in held.values())
        if emitted is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(updated // 1000 + self.keep_ms)
        if emitted == (current, total):
            return
        self.emitted.update((current, total))
        said = [{"stage": s, "n": v[0], "first_us": v[1], "last_us": v[2]} for s, v in sorted(held.items())]
        yield pd.DataFrame({"job_id": [key[0]], "current_stage": [current], "updated_us": [updated], "n_events": [total], "stages": [said], "last_events": [seqs]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.stages.clear()
        self.events.clear()
        self.emitted.clear()
        yield from ()

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame, last: int = 200, keep_hours: int = 24, lateness: str = "1 day") -> DataFrame:
    """Snapshots of jobs from a stream of events (job_id, seq, ts, stage), one row whenever a job's state has changed.

    Columns are those of ``job_snapshots``, without status and progress, which follow from them; job_id is text. A job's state goes when
    the watermark has passed its last event by ``keep_hours``. Events with a null job or stage are left out, and so
    are those that come later than ``lateness`` after the newest one.
    """
    rows = events.where("job_id is not null and stage is not null").select(
        F.col("job_id").cast("string").alias("job_id"), F.col("stage").cast("string").alias("stage"), F.col("seq").cast("long").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )
    parts = rows.mapInArrow(_partial(last), _PART).withColumn("at", F.timestamp_micros("last_us")).withWatermark("at", lateness)
    found = parts.groupBy("job_id").transformWithStateInPandas(JobState(last, keep_hours * 3_600_000), _SNAPSHOT, "Update", "EventTime")
    each = F.transform("stages", lambda s: F.struct(s["stage"], F.struct(s["n"].alias("n"), F.timestamp_micros(s["first_us"]).alias("first_at"), F.timestamp_micros(s["last_us"]).alias("last_at"))))
    return found.select("job_id", "current_stage", F.map_from_entries(each).alias("stages"), F.timestamp_micros("updated_us").alias("updated_at"), "n_events", "last_events")
