"""Form revisions from run to run: as a batch against a table with one row for each name, and as a stream with state for each name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def latest(listing: DataFrame) -> DataFrame:
    """The last row of each name by time, then by file."""
    o = W.partitionBy("name").orderBy(F.desc("modified_time"), F.desc("file_id"))
    return listing.withColumn("rn", F.row_number().over(o)).where("rn = 1").drop("rn")


def changes(listing: DataFrame, state: DataFrame) -> DataFrame:
    """SM1: new, changed (another time, be it older), same or disappeared, for every name of either side."""
    now = latest(listing).select("name", F.col("modified_time").alias("now"))
    then = state.select("name", F.col("modified_time").alias("then"))
    status = F.when(F.col("now").isNull(), "disappeared").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed").otherwise("same")
    return now.join(then, "name", "full_outer").select("name", status.alias("status"))


def regressions(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """SM2: forms that were structured and aren't now, or that declare less than before."""
    b = baseline.select("name", F.col("classification").alias("was"), F.col("declarations").alias("had"))
    lost = (F.col("was") == "structured") & (F.col("classification") != "structured")
    fewer = (F.col("had") > 0) & (F.col("declarations") < F.col("had"))
    return run.join(b, "name").where(lost | fewer).select("name", F.when(lost, "no longer structured").otherwise("fewer declarations").alias("finding"))


def confirmed_state(state: DataFrame, succeeded: DataFrame) -> DataFrame:
    """SNK3: the next state: rows of forms that succeeded replace those of their name, the rest stays."""
    return succeeded.unionByName(state.join(succeeded, "name", "left_anti"))


def rerun_set(found: DataFrame, force: bool = False) -> DataFrame:
    """SM1: what has to run again: nothing if nothing changed (and force is off), else every present name, with the new and changed ones flagged."""
    changed = F.col("status").isin("new", "changed") | F.lit(force)
    moved = found.agg(F.coalesce(F.bool_or(changed), F.lit(False))).scalar()
    return found.where((F.col("status") != "disappeared") & moved).select("name", changed.alias("changed"))


#: What ``follow`` reads: ``kind`` is listed (a source listing has the name) or confirmed (its revision was taken over).
EVENTS = "name string, kind string, at timestamp, file_id string, modified_time string, classification string, declarations long"
#: The store that keyed state needs; ``followed`` sets it for the stream that it starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_SEEN = "at long, file_id string, modified_time string"
_DONE = "at long, modified_time string, classification string, declarations long"
_STATUS = "name string, status string, at long, modified_time string, confirmed_time string, classification string, declarations long"


class _Revisions(StatefulProcessor):
    """For each name the last listing, the last confirmation, and a timer that runs out when no listing has the name for a while.

    Both are the latest by their own time, so neither the order of batches nor a repeated batch changes what is held.
    """

    def __init__(self, patience_ms: int):
        self._patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen, self._done = handle.getValueState("seen", _SEEN), handle.getValueState("done", _DONE)

    def _wait(self, at: int) -> None:
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        self._handle.registerTimer(at // 1000 + self._patience_ms)

    def _status(self, name: str) -> Row:
        seen = self._seen.get() if self._seen.exists() else None
        done = self._done.get() if self._done.exists() else None
        if seen is None:
            status = "disappeared"
        elif done is None:
            status = "new"
        else:
            status = "same" if seen[2] == done[1] else "changed"
        at = max(x[0] for x in (seen, done, (0,)) if x is not None)
        return Row(name=name, status=status, at=at, modified_time=seen and seen[2], confirmed_time=done and done[1], classification=done and done[2], declarations=done and done[3])

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        r = initialState
        self._done.update((r.at, r.modified_time, r.classification, r.declarations))
        self._wait(r.at)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        seen = self._seen.get() if self._seen.exists() else None
        done = self._done.get() if self._done.exists() else None
        last = seen
        for r in rows:
            if r.kind == "listed":
                seen = max(filter(None, (seen, (r.us, r.file_id or "", r.modified_time))), key=lambda x: (x[0], x[2] or "", x[1]))
            elif done is None or (r.us, r.modified_time or "") >= (done[0], done[1] or ""):
                done = (r.us, r.modified_time, r.classification, r.declarations)
        if seen is not None and seen is not last:
            self._seen.update(tuple(seen))
            self._wait(seen[0])
        if done is not None:
            self._done.update(tuple(done))
        yield self._status(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        self._seen.clear()
        yield self._status(key[0])

    def close(self) -> None:
        pass


def follow(events: DataFrame, state: DataFrame | None = None, patience_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """SM1 and SNK3 as a stream with state for each name: events as in EVENTS to (name, status, at, modified_time and what is confirmed).

    A name has a row for each batch that tells of it; its last row says what ``changes`` would say of all listings
    so far against all confirmations so far. ``disappeared`` comes from an event-time timer: no listing had the name for
    ``patience_ms`` after the last that had it, by the stream's watermark (the latest ``at`` less ``late``). Rows behind
    the watermark are late and don't count. state (name, at, modified_time, classification, declarations) is what was confirmed before the stream.
    """
    keyed = events.withWatermark("at", late).withColumn("us", F.unix_micros("at")).groupBy("name")
    before = state.select("name", F.unix_micros("at").alias("at"), "modified_time", "classification", "declarations").groupBy("name") if state is not None else None
    out = keyed.transformWithState(_Revisions(patience_ms), _STATUS, "Update", "EventTime", before)
    return out.withColumn("at", F.timestamp_micros("at"))


def followed(statuses: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Start the stream over what is there now: each batch is written to a folder of its own in ``log``, replaced if the batch is repeated."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    conf = statuses.sparkSession.conf
    before = conf.get(STORE[0])
    conf.set(*STORE)
    try:
        return statuses.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(STORE[0], before)


def standing(spark: SparkSession, log: str) -> DataFrame:
    """The last row of each name that the stream has written."""
    rows = spark.read.parquet(log)
    columns = [c for c in rows.columns if c not in ("name", "batch")]
    return rows.groupBy("name").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("name", "r.*")
