"""Job logs, incremental intake and curation, as batch tables and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.core import job_progress
from ..operators.curate import apply_curation, audit_records, validate_events
from ..operators.resolve import upsert_entities, upsert_relationships
from ..store import BucketStore
from .job_state import STATE_STORE, job_state_stream

#: Parts of a job's events, each cut to the last ones before they meet.
SALTS = 16

#: Stages that end a job, and the status they give it; a job with a cancel request counts as cancelled.
ENDS = {"completed": "completed", "failed": "failed", "cancel": "cancelled"}


def _status(stage: Column) -> Column:
    found = F.lit("running")
    for end, status in ENDS.items():
        found = F.when(stage == end, status).otherwise(found)
    return found


def _progress() -> Column:
    return F.round(job_progress(F.map_keys("stages"), F.col("current_stage"), F.lit(1.0)), 6)


def job_snapshots(events: DataFrame, last: int = 200) -> DataFrame:
    """State of each job from its events (job_id, seq, ts, stage): status, latest stage, stages, counts, the last events' ids, progress.

    ``stages`` maps each stage to its number of events and its first and last time.
    """
    salted = Window.partitionBy("job_id", F.pmod(F.xxhash64("seq"), F.lit(SALTS))).orderBy(F.desc("seq"))
    whole = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    some = events.select("job_id", "seq").withColumn("n", F.row_number().over(salted)).where(F.col("n") <= last)
    some = some.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= last)
    held = some.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "seq"))), lambda x: x["seq"]).alias("last_events"))
    by_stage = events.groupBy("job_id", "stage").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max("seq").alias("last_seq"),
    )
    rows = by_stage.groupBy("job_id").agg(
        F.max_by("stage", "last_seq").alias("current_stage"), F.max("last_at").alias("updated_at"), F.sum("n").alias("n_events"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct("n", "first_at", "last_at"))))).alias("stages"),
    )
    return rows.join(held, "job_id").select(
        "job_id", _status(F.col("current_stage")).alias("status"), "current_stage", "stages", "updated_at", "n_events", "last_events",
        _progress().alias("progress"),
    )


def changed_snapshots(before: DataFrame, now: DataFrame) -> DataFrame:
    """Snapshots that differ from those of the same job before."""
    state = ["job_id", "status", "current_stage", "n_events"]
    return now.join(before.select(*state), state, "left_anti")


def stream_snapshots(events: DataFrame, target: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Status, stage and counts of jobs as a stream in update mode; a batch's changed jobs are written to ``target``/batch=n.

    State is dropped after a day without events. A repeated batch writes the same folder again.
    """
    rows = (
        events.withWatermark("ts", lateness)
        .groupBy("job_id")
        .agg(F.max_by("stage", "seq").alias("current_stage"), F.max("ts").alias("updated_at"), F.count("*").alias("n_events"))
    )

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("status", _status(F.col("current_stage"))).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).start()


def stream_job_states(events: DataFrame, target: str, checkpoint: str, last: int = 200, keep_hours: int = 24, lateness: str = "1 day", once: bool = False) -> StreamingQuery:
    """Whole snapshots of jobs as a stream: those that a batch has changed are written to ``target``/batch=n.

    The latest row of each job equals its row of ``job_snapshots`` over all events so far, after a restart from the checkpoint too. State is kept for
    ``keep_hours`` after a job's last event. With ``once`` the stream ends when it has read all there is.
    """
    spark = events.sparkSession
    rows = job_state_stream(events, last, keep_hours, lateness)
    rows = rows.select("job_id", _status(F.col("current_stage")).alias("status"), "current_stage", "stages", "updated_at", "n_events", "last_events", _progress().alias("progress"))

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        writer = rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE[0])
        else:
            spark.conf.set(STATE_STORE[0], before)


def append_progress(spark: SparkSession, path: str, job_id: str, seq: int, stage: str, message: str = "", level: str = "info", data: dict[str, str] | None = None) -> None:
    """One progress row at the end of the job log; what a callback of a long run would be told."""
    kind = "job_id string, seq long, stage string, level string, message string, data map<string,string>"
    row = spark.createDataFrame([(job_id, seq, stage, level, message, data or {})], kind).withColumn("ts", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(path)


def apply_cancellations(events: DataFrame) -> DataFrame:
    """Events up to each job's first cancel request; jobs with one are marked cancelled."""
    asked = events.where("stage = 'cancel'").groupBy("job_id").agg(F.min("seq").alias("cancel_seq"))
    rows = events.join(asked, "job_id", "left").where("cancel_seq is null or seq <= cancel_seq")
    return rows.withColumn("cancelled", F.col("cancel_seq").isNotNull()).drop("cancel_seq")


Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def graph_stores(spark: SparkSession, path: str, buckets: int = 64) -> tuple[BucketStore, BucketStore]:
    """The stored graph below ``path``: entities by (name, type), relationships by (source, target, type)."""
    return (
        BucketStore(spark, f"{path}/entities", ["name", "entity_type"], buckets),
        BucketStore(spark, f"{path}/relationships", ["source_entity_id", "target_entity_id", "relationship_type"], buckets),
    )


def upsert_graph(spark: SparkSession, path: str, n: int, entities: DataFrame, edges: DataFrame, buckets: int = 64) -> tuple[int, int]:
    """Batch ``n`` of new entities and edges into the stored graph: only buckets that the batch's keys fall into are written.

    Edges come with the ids that extraction gave their ends; those of entities that are stored already become the stored ids. Edges whose
    ends the graph lacks go. A batch that is stored already changes nothing. Gives the numbers of buckets written.
    """
    nodes, links = graph_stores(spark, path, buckets)
    first = nodes.upsert(n, entities, upsert_entities)
    keys = entities.select("name", "entity_type").distinct()
    final = (
        entities.select(F.col("entity_id").alias("was"), "name", "entity_type")
        .distinct()
        .join(nodes.read(nodes.touched(keys)).select("name", "entity_type", "entity_id"), ["name", "entity_type"])
        .select("was", "entity_id")
    )
    for end in ("source", "target"):
        c = f"{end}_entity_id"
        edges = edges.join(final.withColumnsRenamed({"was": c, "entity_id": "final"}), c, "left").withColumn(c, F.coalesce("final", c)).drop("final")
    known = nodes.read().select("entity_id")
    return first, links.upsert(n, edges, lambda stored, new: upsert_relationships(stored, new, known))


def stream_documents(spark: SparkSession, source: str, target: str, checkpoint: str, size: int = 512, overlap: int = 50, extract: Extractor | None = None) -> StreamingQuery:
    """New Parquet files of documents (doc_id, text) become chunks and, with ``extract``, a graph.

    ``extract(chunks)`` gives entities (entity_id, name, entity_type, seq, …) and edges (relationship_id, source_entity_id,
    target_entity_id, relationship_type, seq, …). Chunks go to ``target``/batch=n, the graph to ``target``-graph
    (``graph_stores``). Ids come from content and batches have numbers, so a repeated batch adds nothing.
    """
    from ..operators.chunking import chunk_fixed, chunk_identity

    schema = "doc_id long, text string"

    def take(batch: DataFrame, n: int) -> None:
        chunks = chunk_identity(chunk_fixed(batch.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content")), size, overlap))
        chunks.write.mode("overwrite").parquet(f"{target}/batch={n}")
        if extract:
            upsert_graph(spark, f"{target}-graph", n, *extract(spark.read.parquet(f"{target}/batch={n}")))

    return (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_curation(spark: SparkSession, source: str, apply, checkpoint: str) -> StreamingQuery:
    """JSON curation events by batches to ``apply(events, batch number)``, which must be idempotent by the number."""
    schema = "seq long, action string, target_id string, curator string, reason string, corrections map<string,string>"
    return (
        spark.readStream.schema(schema)
        .json(source)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def curate_stored(spark: SparkSession, path: str, n: int, events: DataFrame, buckets: int = 64) -> DataFrame:
    """Batch ``n`` of curation events into the stored graph; gives an audit record for each event.

    Only buckets with targets of the batch (and those that renamed ones move to) are written. The records of a batch that was stored before say the same.
    """
    kinds = (("entity", ("name", "description")), ("relationship", ("relationship_type", "description", "strength")))
    errors = None
    for (kind, fields), store in zip(kinds, graph_stores(spark, path, buckets), strict=True):
        id_col = f"{kind}_id"
        wanted = events.where(F.col("action").endswith(kind)).select(F.col("target_id").alias(id_col)).distinct()

        def curated(stored: DataFrame, kind=kind, fields=fields, id_col=id_col) -> tuple[DataFrame, DataFrame]:
            return apply_curation(stored, events, id_col, kind, tuple(f for f in fields if f in stored.columns))

        store.rewrite(n, wanted, lambda stored, curated=curated: curated(stored)[0])
        now = store.read()
        now = spark.createDataFrame([], f"{id_col} string") if now is None else now
        wrong = curated(now)[1]
        errors = wrong if errors is None else errors.unionByName(wrong)
    return audit_records(events, errors.unionByName(validate_events(events)))


def stream_curated_graph(spark: SparkSession, source: str, path: str, audit: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """JSON curation events by batches into the stored graph below ``path``, with an audit record for each below ``audit``/batch=n."""

    def take(batch: DataFrame, n: int) -> None:
        curate_stored(spark, path, n, batch, buckets).write.mode("overwrite").json(f"{audit}/batch={n}")

    return stream_curation(spark, source, take, checkpoint)
