"""K: event logs, live budgets and incremental enrichment as Structured Streaming."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState

from evidencelake.operators.lexical import chunk_fixed
from evidencelake.operators.vectors import hashing_embedder
from evidencelake.scratch import drop_table, materialize, remove

#: Steps of an import job that may follow each other (fixed values).
TRANSITIONS = {"created": ("queued", "cancelled"), "queued": ("running", "cancelled"), "running": ("completed", "failed", "cancelled"), "failed": ("queued",)}


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Files that appear below a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def live_budget(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """K-3: tokens of each user, day and one-day window ``w``, updated as events come; rows later than the watermark are dropped.

    Days are those of the session's time zone; outside UTC a day is the sum of two windows.
    """
    dated = events.withColumn("day", F.to_date("ts")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    total = dated.groupBy("user_id", "day", F.window("ts", "1 day")).agg(F.sum("tokens").alias("tokens"))  # by the window itself, which alone lets old days leave the state
    return total.select("user_id", "day", F.col("window.start").alias("w"), "tokens")


def spread(batch: DataFrame) -> DataFrame:
    """``user_id, event_id, ts`` of a batch with the ``part`` that each row lies in: parts are ranges of user, time and id, so a user with many rows has several."""
    order = [F.asc_nulls_last(c) for c in ("user_id", "ts", "event_id")]
    return materialize(batch.select("user_id", "event_id", "ts").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "event-parts")


def number_events(rows: DataFrame, last: DataFrame) -> DataFrame:
    """``user_id, event_id, seq`` of the rows of ``spread`` in order of time and id, going on from ``last(user_id, last_seq)``.

    Rows are numbered within each part and user; a user's parts add the counts of those before, so
    no task holds a whole user.
    """
    counts = rows.groupBy("user_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("user_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    start = counts.select(F.col("user_id").alias("u"), F.col("part").alias("p"), before.alias("start"))
    seen = last.select(F.col("user_id").alias("v"), "last_seq")
    start = start.join(seen, F.col("u").eqNullSafe(F.col("v")), "left").select("u", "p", (F.col("start") + F.coalesce("last_seq", F.lit(0))).alias("start"))
    own = F.row_number().over(Window.partitionBy("user_id", "part").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")))
    numbered = rows.withColumn("own", own).join(start, F.col("user_id").eqNullSafe(F.col("u")) & (F.col("part") == F.col("p")))
    return numbered.select("user_id", "event_id", (F.col("start") + F.col("own")).cast("long").alias("seq"))


def event_log(out: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """K-1: a sink that writes ``user_id, event_id, seq`` below ``out/rows``: a number for each event that grows within its session across micro-batches.

    The last number of each session lies in one of ``buckets`` by a hash of the session; a micro-batch reads and writes only the buckets of its own sessions, so
    its cost does not grow with the number of batches. ``out/current`` tells which batch wrote each bucket last. A repeated batch reads what the
    one before it left and overwrites its own folders; what a batch replaced is removed by the next one, when it cannot be repeated any more.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    kinds = "bucket int, written int, replaced int"

    def write(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, spread(batch)
        before = {r.bucket: r for r in spark.read.schema(kinds).parquet(f"{out}/current/b={number - 1}").collect()} if number else {}  # one row a bucket
        touched = sorted(r.k for r in rows.select(bucket("user_id").alias("k")).distinct().collect())
        folders = [f"{out}/last/b={before[k].written}/bucket={k}" for k in touched if k in before]
        last = spark.read.schema("user_id long, last_seq long").parquet(*folders) if folders else spark.createDataFrame([], "user_id long, last_seq long")
        number_events(rows, last).write.mode("overwrite").parquet(f"{out}/rows/b={number}")
        new = spark.read.schema("user_id long, event_id long, seq long").parquet(f"{out}/rows/b={number}").select("user_id", F.col("seq").alias("last_seq"))
        merged = new.unionByName(last).groupBy("user_id").agg(F.max("last_seq").alias("last_seq")).withColumn("bucket", bucket("user_id"))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/last/b={number}")
        now = [(k, number if k in touched else before[k].written, before[k].written if k in touched and k in before else None) for k in sorted({*touched, *before})]
        spark.createDataFrame(now, kinds).coalesce(1).write.mode("overwrite").parquet(f"{out}/current/b={number}")
        for k, r in before.items():
            if r.replaced is not None:
                remove(spark, f"{out}/last/b={r.replaced}/bucket={k}")
        if number > 1:
            remove(spark, f"{out}/current/b={number - 2}")
        drop_table(rows)

    return write


def replay(log: DataFrame, after: DataFrame) -> DataFrame:
    """K-2: events of each session after ``after(user_id, last_event_id)``; an unknown id gives everything."""
    seen = log.select("user_id", F.col("event_id").alias("last_event_id"), F.col("seq").alias("from_seq"))
    start = after.join(seen, ["user_id", "last_event_id"], "left").select("user_id", F.coalesce("from_seq", F.lit(0)).alias("from_seq"))
    return log.join(start, "user_id").where("seq > from_seq").drop("from_seq")


def evict(log: DataFrame, key: str, now: str, capacity: int = 100, ttl: int = 3600) -> DataFrame:
    """K-4, K-6: the newest ``capacity`` rows of each key that are not older than ``ttl`` seconds."""
    fresh = log.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl)))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))
    return fresh.withColumn("__n", n).where(F.col("__n") <= capacity).drop("__n")


def check_transitions(events: DataFrame) -> DataFrame:
    """K-5 (batch form): each status change of a job and whether the step is allowed; the first is, from ``created``."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs])
    before = F.coalesce(F.lag("status").over(Window.partitionBy("job_id").orderBy("ts", "event_id")), F.lit("created"))
    return events.select("job_id", "event_id", before.alias("before"), "status", F.array_contains(allowed, F.concat_ws(">", before, "status")).alias("legal"))


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _expire(state: GroupState, newest_ms: int, seconds: int) -> None:
    """The key's state goes when the watermark is ``seconds`` past its newest event."""
    state.setTimeoutTimestamp(max(newest_ms + 1000 * seconds, state.getCurrentWatermarkMs() + 1))


def live_transitions(events: DataFrame, late: str = "1 hour", finished: int = 86_400, idle: int = 30 * 86_400) -> DataFrame:
    """K-5: each status change ``job_id, event_id, ts, status`` of a stream with the status before it and whether the step is allowed.

    The state of a job is its last status. A micro-batch's events of a job are taken in order of time and id; those that come in a
    later micro-batch follow, whatever their time; rows later than the watermark are dropped. A job's state goes ``finished`` seconds of event time after a step
    that none may follow, and ``idle`` seconds after any other; an event after that begins the job anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one job's events: a handful
        before = [state.get[0] if state.exists else "created", *now["status"].tolist()[:-1]]
        last = now["status"].iloc[-1]
        state.update((last,))
        newest = now["ts"].max()
        _expire(state, state.getCurrentWatermarkMs() if pd.isna(newest) else _millis(newest), idle if TRANSITIONS.get(last) else finished)
        legal = [s in TRANSITIONS.get(b, ()) for b, s in zip(before, now["status"])]
        yield pd.DataFrame({"job_id": key[0], "event_id": now["event_id"], "before": before, "status": now["status"], "legal": legal})

    kind = f"job_id {dict(events.dtypes)['job_id']}, event_id long, before string, status string, legal boolean"
    return _timed(events.select("job_id", "event_id", "ts", "status"), late).groupBy("job_id").applyInPandasWithState(step, kind, "last string", "append", "EventTimeTimeout")


def _millis(t: pd.Timestamp) -> int:
    return int(t.tz_localize("UTC").timestamp() * 1000) if t.tzinfo is None else int(t.timestamp() * 1000)


def live_buffer(events: DataFrame, capacity: int = 100, ttl: int = 3600, late: str = "1 hour") -> DataFrame:
    """K-4: of a stream ``user_id, event_id, ts`` each session's buffer after a micro-batch: the newest ``capacity`` events not more than ``ttl`` seconds older than its newest.

    The state of a session is its buffer, so a session with most of the events holds ``capacity`` of them and no more; it goes when
    the watermark is ``ttl`` seconds past its newest event. Rows later than the watermark are dropped, and so are those without a time.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for pdf in batches:  # a hot session comes in several parts
            seconds = pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6
            held = sorted([*held, *zip(seconds, pdf["event_id"])], reverse=True)[:capacity]
        held = [x for x in held if x[0] >= held[0][0] - ttl]
        state.update(([float(x[0]) for x in held], [int(x[1]) for x in held]))
        _expire(state, int(held[0][0] * 1000), ttl)
        yield pd.DataFrame({"user_id": key[0], "event_id": [int(x[1]) for x in held]})

    kind = f"user_id {dict(events.dtypes)['user_id']}, event_id long"
    known = _timed(events.where("ts is not null").select("user_id", "event_id", "ts"), late)
    return known.groupBy("user_id").applyInPandasWithState(keep, kind, "seconds array<double>, ids array<long>", "update", "EventTimeTimeout")


def embedded(chunks: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, embedding`` by the offline embedder."""
    return chunks.select("chunk_id", "doc_id", hashing_embedder()("content").alias("embedding"))


def enrich_new_documents(stream: DataFrame, out: str, checkpoint: str, stages: dict[str, Callable[[DataFrame], DataFrame]] | None = None, event_time: str | None = None, within: str = "30 days") -> StreamingQuery:
    """K-7: chunks of new documents written once each below ``out``, and what ``stages`` make of the chunks below ``out-<name>`` (embeddings by default).

    The ids seen are keyed state on disk: a micro-batch looks up its own ids only, so its cost does not grow with those before it. Without ``event_time`` an id counts as
    seen for ever; with it, repeats within ``within`` of each other are left out and older ids leave the state. A repeated batch
    overwrites its own folders. Rows without an id are left out.
    """
    known = stream.where("doc_id is not null")
    new = known.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["doc_id"]) if event_time else known.dropDuplicates(["doc_id"])

    def write(batch: DataFrame, number: int) -> None:
        chunk_fixed(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        chunks = batch.sparkSession.read.schema("doc_id long, chunk_id string, start int, content string").parquet(f"{out}/batch={number}")
        for name, stage in (stages if stages is not None else {"embeddings": embedded}).items():
            stage(chunks).write.mode("overwrite").parquet(f"{out}-{name}/batch={number}")

    with state_on_disk(stream.sparkSession):
        return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whose cost for a batch is that of the keys it touches."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class StreamCounts(StreamingQueryListener):
    """K-3: by query id, the rows later than the watermark that were dropped so far (after they were summed up within a task) and the rows now in state. Register it with ``spark.streams.addListener``."""

    def __init__(self):
        self.late, self.in_state = Counter(), {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        found = event.progress.stateOperators
        self.late[str(event.progress.id)] += sum(x.numRowsDroppedByWatermark for x in found)
        self.in_state[str(event.progress.id)] = sum(x.numRowsTotal for x in found)

    def onQueryTerminated(self, event) -> None: ...


def run_to_end(df: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs a stream over all that is there and waits; gives the ended query with its progress."""
    with state_on_disk(df.sparkSession):
        query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
