"""The append logs as Structured Streaming jobs; each equals its batch operator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from postmill.operators import quality
from postmill.operators.bucketed import read_store, write_store
from postmill.operators.run import refresh
from postmill.operators.settle import settle
from postmill.operators.skew import first_per_key, top_n_per_key
from postmill.operators.throttle import DAY, MINUTE, with_policy
from postmill.params import Thresholds

# ---- event counters ---------------------------------------------------------------------------


def live_event_counters(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per hour, event and channel; late rows count until the watermark passes."""
    return (
        events.withWatermark("occurred_at", lateness)
        .groupBy(F.window("occurred_at", width), "event", "channel")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("hour"), "event", "channel", "n")
    )


# ---- captures that are sent or recorded again ---------------------------------------------------

CAPTURE = ["source_id", "captured_at"]


def latest_captures(captures: DataFrame, lateness: str = "1 hour", recorded: str = "recorded_at") -> DataFrame:
    """Captures with ``version`` and ``op``: a capture recorded again replaces the earlier record.

    The state of a (source_id, captured_at) holds the last version and its content's hash until the watermark passes
    it. The first record comes out as ``insert``; one with other content as ``replace`` with the next version, in order
    of ``recorded`` within a batch; one with the same content, a replay, not at all. A record older than the last
    one seen changes nothing. ``current_captures`` reads the result.
    """
    timed = captures.withWatermark("captured_at", lateness)
    payload = [c for c in captures.columns if c not in (*CAPTURE, recorded)]
    hashed = timed.withColumns({"_hash": F.xxhash64(*payload), "_seen": F.unix_micros(recorded), "_at": F.unix_micros("captured_at")})
    schema = StructType([*captures.schema.fields, StructField("version", LongType()), StructField("op", StringType())])

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        version, held, seen = state.get if state.exists else (0, 0, np.iinfo(np.int64).min)
        rows = pd.concat(list(batches)).sort_values(["_seen", "_hash"], kind="stable")
        out = []
        for i, (h, at) in enumerate(zip(rows["_hash"], rows["_seen"])):
            if at >= seen and (not version or h != held):
                version, held = version + 1, int(h)
                out.append((i, version, "insert" if version == 1 else "replace"))
            seen = max(seen, int(at))
        state.update((version, held, seen))
        # The state is kept for as long as a record of this capture is not late.
        state.setTimeoutTimestamp(max(int(rows["_at"].iloc[0]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            picked = rows.iloc[[i for i, _, _ in out]].drop(columns=["_hash", "_seen", "_at"])
            yield picked.assign(version=[v for _, v, _ in out], op=[o for _, _, o in out])[schema.fieldNames()]

    return hashed.groupBy(*CAPTURE).applyInPandasWithState(
        step, schema, "version bigint, held bigint, seen bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def current_captures(versions: DataFrame) -> DataFrame:
    """The last version of every capture, from the rows that ``latest_captures`` has written."""
    return first_per_key(versions, CAPTURE, -F.col("version"))


# ---- throttle -----------------------------------------------------------------------------------

AUDIT_DDL = (
    "event_id bigint, source_id string, at bigint, reason string, next_eligible bigint, events_today bigint"
)
HELD = ["at", "event_id", "outcome", "cooldown", "min_interval", "daily_cap"]
STATE_DDL = (
    "last_live bigint, cooldown_until bigint, day bigint, n bigint, last_at bigint, "
    "at array<bigint>, event_id array<bigint>, outcome array<string>, cooldown array<bigint>, min_interval array<bigint>, daily_cap array<bigint>"
)
NEVER = np.iinfo(np.int64).min


def _judged(rows: pd.DataFrame, live0: int, cool0: int, day0: int, n0: int) -> tuple[pd.DataFrame, tuple[int, int, int, int]]:
    """Verdicts of one source's events in order, from and to a state: running maxima and day counts as array operations."""
    at = rows["at"].to_numpy()
    ok = np.where(rows["outcome"] == "success", at, NEVER)
    cool = np.where(rows["outcome"] == "challenge", at + rows["cooldown"].to_numpy() * MINUTE, NEVER)
    live_all = np.maximum.accumulate(np.concatenate([[live0], ok]))
    cool_all = np.maximum.accumulate(np.concatenate([[cool0], cool]))
    live, until = live_all[:-1], cool_all[:-1]
    day = at // DAY
    today = rows.groupby(day).cumcount().to_numpy() + np.where(day == day0, n0, 0)
    opens = np.where(live == NEVER, NEVER, live + rows["min_interval"].to_numpy() * MINUTE)
    cooling, capped = until > at, today >= rows["daily_cap"].to_numpy()
    waiting = opens > at
    reason = np.select([cooling, capped, waiting], ["cooldown", "daily_cap", "min_interval"], "eligible")
    nxt = np.select([cooling, capped, waiting], [until, (day + 1) * DAY, opens], NEVER)
    verdicts = pd.DataFrame({
        "event_id": rows["event_id"].to_numpy(), "at": at, "reason": reason,
        "next_eligible": pd.array([None if v == NEVER else int(v) for v in nxt], dtype="Int64"), "events_today": today.astype("int64"),
    })
    return verdicts, (int(live_all[-1]), int(cool_all[-1]), int(day[-1]), int(today[-1]) + 1)


def throttle_stream(events: DataFrame, profile: str = "safe", lateness: str = "10 minutes", idle_days: int = 2) -> DataFrame:
    """Audit of every event against the state kept per source, in event time.

    Events wait in the source's state until the watermark has passed them, then they are judged in the order of
    (at, event_id), so batches may arrive in any order within ``lateness``; what is later than that is dropped. A timer at
    the first waiting event wakes a source that gets no more events; one that has been quiet for ``idle_days`` (longer
    than any interval, cooldown or day) has no state that could change a verdict, and loses it.
    """
    p = with_policy(events.withWatermark("at", lateness), profile).select(
        "event_id", "source_id", "at", F.unix_micros("at").alias("micros"), "outcome",
        F.col("cooldown").cast("bigint").alias("cooldown"),
        F.col("min_interval").cast("bigint").alias("min_interval"),
        F.col("daily_cap").cast("bigint").alias("daily_cap"),
    )

    def step(key, batches, state: GroupState):
        held = state.get if state.exists else (NEVER, NEVER, -1, 0, 0, *([] for _ in HELD))
        waiting = pd.DataFrame(dict(zip(HELD, (list(x or []) for x in held[5:]))))
        if not state.hasTimedOut:
            fresh = pd.concat(list(batches)).drop(columns="at").rename(columns={"micros": "at"})[HELD]
            waiting = pd.concat([waiting, fresh], ignore_index=True) if len(waiting) else fresh
        passed = state.getCurrentWatermarkMs() * 1000
        waiting = waiting.sort_values(["at", "event_id"], kind="stable", ignore_index=True)
        due = waiting[waiting["at"] <= passed] if len(waiting) else waiting
        rest = waiting.iloc[len(due):]
        known, last_at = held[:4], held[4]
        if len(due):
            verdicts, known = _judged(due, *known)
            last_at = int(due["at"].iloc[-1])
            verdicts.insert(1, "source_id", key[0])
            yield verdicts
        until = int(rest["at"].iloc[0]) if len(rest) else last_at + idle_days * DAY
        if not len(rest) and until <= passed:
            state.remove()
            return
        state.update((*known, last_at, *(rest[c].tolist() for c in HELD)))
        state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return p.groupBy("source_id").applyInPandasWithState(step, AUDIT_DDL, STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout)


# ---- ingest ---------------------------------------------------------------------------------------

def _committed(spark, log: str) -> DataFrame:
    """Versions of the store that are whole: checkpoint, number, version."""
    empty = spark.createDataFrame([], "checkpoint string, number bigint, version bigint")
    try:
        return spark.read.schema(empty.schema).parquet(f"{log}/versions")
    except AnalysisException:  # nothing written so far
        return empty


def ingest_batches(
    spark, stream: DataFrame, store: str, log: str, applications: DataFrame, as_of: Column, checkpoint: str,
    thresholds: Thresholds | None = None, on_bad_record: str = "reject_source",
):
    """Run ``refresh`` for each micro-batch of captured rows; every batch makes one version of the store.

    The store is kept in hash buckets, and a version writes those alone that the batch has changed
    (``bucketed``); ``read_store`` reads it. A version is committed by a row that is written last. A batch that is replayed finds its own number and
    makes the same version again from the same base; a new checkpoint goes on from the latest version. A run is judged
    on the rows of one batch, so a capture (one row with its array in the stream of captures) is the unit to send.
    """
    def step(batch: DataFrame, number: int) -> None:
        known = {(r["checkpoint"], r["number"]): r["version"] for r in _committed(spark, log).collect()}
        version = known.get((checkpoint, number), max(known.values(), default=-1) + 1)
        base = read_store(spark, store, version - 1) if version else None
        done = refresh(base, applications, batch, as_of, thresholds=thresholds, on_bad_record=on_bad_record)
        write_store(settle(done.postings, "ingest"), store, version, version - 1 if version else None)
        done.log.write.mode("overwrite").parquet(f"{log}/runs/v={version}")
        done.deleted.write.mode("overwrite").parquet(f"{log}/deleted/v={version}")
        if (checkpoint, number) not in known:
            row = spark.createDataFrame([(checkpoint, number, version)], "checkpoint string, number bigint, version bigint")
            row.coalesce(1).write.mode("append").parquet(f"{log}/versions")

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def health_batches(
    spark, runs: DataFrame, sources: DataFrame, history: str, report: str, as_of: Column, checkpoint: str, keep: int = 80
):
    """Rate all sources after each micro-batch of run outcomes.

    The history is one table of the newest ``keep`` runs per source; a run that is recorded again replaces
    the earlier record. Each batch writes the next version of the history from the one before and commits it by a row
    that is written last; a new checkpoint goes on from the latest version.
    """
    def step(batch: DataFrame, number: int) -> None:
        known = {(r["checkpoint"], r["number"]): r["version"] for r in _committed(spark, history).collect()}
        version = known.get((checkpoint, number), max(known.values(), default=-1) + 1)
        fresh = batch.withColumn("_v", F.lit(version))
        if version:
            fresh = fresh.unionByName(spark.read.parquet(f"{history}/v={version - 1}").withColumn("_v", F.lit(version - 1)))
        latest = first_per_key(fresh, ["source_id", "run_id"], -F.col("_v")).drop("_v")
        newest = top_n_per_key(latest, ["source_id"], [F.col("captured_at").desc(), F.col("run_id")], keep).select(*batch.columns)
        newest.write.mode("overwrite").parquet(f"{history}/v={version}")
        rated = quality.source_health(spark.read.parquet(f"{history}/v={version}"), sources, as_of)
        rated.write.mode("overwrite").parquet(f"{report}/v={version}")
        if (checkpoint, number) not in known:
            row = spark.createDataFrame([(checkpoint, number, version)], "checkpoint string, number bigint, version bigint")
            row.coalesce(1).write.mode("append").parquet(f"{history}/versions")

    return (
        runs.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def file_stream(spark, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )
