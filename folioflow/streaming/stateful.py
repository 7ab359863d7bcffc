"""Keyed rules over event streams. Each has a batch twin over sorted events; the streaming form keeps the same small state per key and
judges events in event-time order within a micro-batch. An event that arrives in a later micro-batch is judged on arrival. State
ends by timers, joins and counts by watermarks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OTP_LIFE, OTP_LOCK, TOKEN_LIFE, MOST_TRIES = 600, 1800, 900, 5
# How long an expired code or token is still known as expired; after that it is as if it had never been.
KNOWN_EXPIRED = 86_400


def rate_step(state: tuple, at: float, n: int, window: float) -> tuple[tuple, bool]:
    """State (reset instant, accepted). A window starts at an accepted event; only strictly after its end a new one does."""
    reset, used = state
    if reset is None or reset < at:
        return (at + window, 1), True
    return ((reset, used + 1), True) if used < n else ((reset, used), False)


def throttle_step(state: tuple, at: float, gap: float) -> tuple[tuple, bool]:
    """State (last accepted instant,). Exactly `gap` seconds later is accepted."""
    last = state[0]
    return ((at,), True) if last is None or at - last >= gap else ((last,), False)


def otp_step(state: tuple, at: float, action: str, reset_flow: bool) -> tuple[tuple, str]:
    """State (sent, tries, locked until, verified). Checks in order: no record, locked, expired, wrong code, right code."""
    sent, tries, locked, verified = state
    if sent is not None and at > sent + OTP_LIFE + KNOWN_EXPIRED:
        state = sent, tries, locked, verified = (None, 0, None, False)
    if action == "send":
        if locked is not None and at < locked:
            return state, "locked"
        return (at, 0, None, False), "sent"
    if action not in ("right", "wrong"):
        return state, "ignored"
    if sent is None:
        return state, "none"
    if locked is not None and at < locked:
        return state, "locked"
    if at > sent + OTP_LIFE:
        return (None, 0, None, False), "expired"
    if action == "wrong":
        tries += 1
        return (sent, tries, at + OTP_LOCK if tries >= MOST_TRIES else None, verified), "locked now" if tries >= MOST_TRIES else "wrong"
    return ((sent, tries, None, True), "token") if reset_flow else ((None, 0, None, False), "verified")


def session_step(state: tuple, at: float, action: str) -> tuple[tuple, str]:
    """State (token issued,). A reset needs an unexpired token and uses it up."""
    issued = state[0]
    if issued is not None and at > issued + TOKEN_LIFE + KNOWN_EXPIRED:
        state, issued = (None,), None
    if action == "issue":
        return (at,), "issued"
    if issued is None:
        return state, "invalid"
    return (None,), "reset" if at <= issued + TOKEN_LIFE else "expired"


EMPTY = {"rate": (None, 0), "throttle": (None,), "otp": (None, 0, None, False), "session": (None,)}
STATE = {"rate": "reset double, used long", "throttle": "last double", "otp": "sent double, tries long, locked double, verified boolean", "session": "issued double"}


# The last instant at which a state matters, or None if it says no more than the empty one.
ENDS = {
    "rate": lambda s: s[0],
    "throttle": lambda s, gap=30.0: None if s[0] is None else s[0] + gap,
    "otp": lambda s: None if s[0] is None and s[2] is None else max((s[0] or 0) + OTP_LIFE + KNOWN_EXPIRED, s[2] or 0),
    "session": lambda s: None if s[0] is None else s[0] + TOKEN_LIFE + KNOWN_EXPIRED,
}


def _fold(rows: pd.DataFrame, state: tuple, step, with_action: bool) -> tuple[list, tuple]:
    out = []
    for r in rows.sort_values(["at", "event_id"]).itertuples():
        state, verdict = step(state, r.at, r.action) if with_action else step(state, r.at)
        out.append(str(verdict).lower() if isinstance(verdict, bool) else verdict)
    return out, state


def _verdicts(events: DataFrame, start: tuple, step, with_action: bool, schema: str) -> DataFrame:
    """event_id, key and verdict of each event. A task reads its keys' events in order, batch by batch, and carries nothing but
    the state of the present key from one batch to the next, so a key may have any number of events."""
    columns = ["key", "at", "event_id", *(["action"] if with_action else [])]
    as_text = schema.endswith("string")

    def run(batches):
        present, state = object(), start
        for batch in batches:
            out = []
            keys, instants, ids, *rest = (c.to_pylist() for c in batch.columns)
            for i, key in enumerate(keys):
                if key != present:
                    present, state = key, start
                state, verdict = step(state, instants[i], rest[0][i]) if with_action else step(state, instants[i])
                out.append(str(verdict).lower() if as_text and isinstance(verdict, bool) else verdict)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(out, pa.string() if as_text else pa.bool_())], names=["event_id", "key", "verdict"])

    placed = events.select(*columns).repartition("key").sortWithinPartitions("key", "at", "event_id")
    return placed.mapInArrow(run, schema)


def batch_rule(events: DataFrame, rule: str, step, with_action: bool = False) -> DataFrame:
    """Verdict of each event (key, event_id, at, action), by a fold over each key's events in order."""
    return _verdicts(events, EMPTY[rule], step, with_action, "event_id long, key string, verdict string")


class KeyedRule(StatefulProcessor):
    """A rule's state for each key, as one value, and one timer at the instant from which it does not matter any more: the end of a rate window, the
    gap of a throttle, the life of a code, a lock or a token. The timer clears the state when the watermark passes it; as events behind the
    watermark do not come any more, no verdict changes by that."""

    def __init__(self, rule: str, step, with_action: bool, ahead: float = 0.0):
        self.rule, self.step, self.with_action, self.ahead = rule, step, with_action, ahead

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", STATE[self.rule])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(None if pd.isna(v) else v for v in self.state.get()) if self.state.exists() else EMPTY[self.rule]
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])  # one key's part of a micro-batch
        verdicts, now = _fold(events, now, self.step, self.with_action)
        for instant in list(self.handle.listTimers()):
            self.handle.deleteTimer(instant)
        end = ENDS[self.rule](now)
        if end is None:
            self.state.clear()
        else:
            self.state.update(now)
            self.handle.registerTimer(max(int((end + self.ahead) * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield events.assign(verdict=verdicts)[["event_id", "key", "verdict"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([pd.DataFrame({"event_id": pd.Series([], dtype="int64"), "key": pd.Series([], dtype="object"), "verdict": pd.Series([], dtype="object")})])

    def close(self) -> None:
        pass


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream_rule(events: DataFrame, rule: str, step, with_action: bool = False, ahead: float = 0.0) -> DataFrame:
    """The same over a stream of (key, event_id, at, ts[, action]) with a watermark on `ts`, where `at` is `ts` in seconds, less `ahead` (KeyedRule). The
    session that starts the query needs STATE_STORE, for a store that can hold several values and timers a key."""
    return events.groupBy("key").transformWithStateInPandas(
        KeyedRule(rule, step, with_action, ahead), outputStructType="event_id long, key string, verdict string", outputMode="append", timeMode="eventTime"
    )


rate_limit = partial(rate_step, n=3, window=3600.0)
throttle = partial(throttle_step, gap=30.0)
otp_signup = partial(otp_step, reset_flow=False)
otp_reset = partial(otp_step, reset_flow=True)


def rate_limit_native(events: DataFrame, n: int, window: int) -> DataFrame:
    """Whether the rate rule accepts each event, by the same fold."""
    step = partial(rate_step, n=n, window=float(window))
    return _verdicts(events, EMPTY["rate"], step, False, "event_id long, key string, verdict boolean").select("key", "event_id", F.col("verdict").alias("accepted"))


def usage_counts(events: DataFrame, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by tool and window, tumbling or sliding; batch or stream. A stream in append mode gives a window once, when the watermark has
    passed its end, and forgets it; events later than `late` behind the newest are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_use(events: DataFrame, pattern: str, late: str = "1 hour") -> DataFrame:
    """The first matching action of each session and page: by arrival in a stream (within the watermark), by time in a batch."""
    hits = events.where(F.col("event_type").rlike(pattern))
    if events.isStreaming:
        return hits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "page"])
    return hits.groupBy("session", "page").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("session", "page", F.col("f.event_id").alias("event_id"))


VERSION_LIFE = "30 days"


def accept_results(results: DataFrame, versions: DataFrame, late: str = "10 minutes", life: str = VERSION_LIFE) -> DataFrame:
    """Late results (event_id, id, version, status, ts), a stream, with a verdict: applied if the item has that version still, else stale; failed ones
    need review.

    versions (id, version, ts) is a stream of the versions that items got, each valid for `life`; of an item and version it has one row, or rows
    farther apart than `life`. Both have watermarks: a result waits until both have passed its instant, as long as no version meets it, and leaves as stale then; versions leave the state
    when their life has passed."""
    r = results.withWatermark("ts", late)
    v = versions.select(F.col("id").alias("item"), F.col("version").alias("current"), F.col("ts").alias("since")).withWatermark("since", late)
    known = (r["id"] == v["item"]) & (r["version"] == v["current"]) & (v["since"] <= r["ts"]) & (v["since"] >= r["ts"] - F.expr(f"interval {life}"))
    verdict = F.when(F.col("current").isNull(), "stale").when(F.col("status") == "failed", "review").otherwise("applied")
    return r.join(v, known, "leftOuter").select(*[r[c] for c in results.columns], verdict.alias("verdict"))


def settle(judged: DataFrame, path: str) -> object:
    """A writer of judged results into path: applied ones under sink=results, the others under sink=audit, each epoch in a folder of its own, which a
    repeated epoch replaces."""

    def put(batch: DataFrame, epoch: int) -> None:
        sink = F.when(F.col("verdict") == "applied", "results").otherwise("audit")
        batch.withColumn("sink", sink).write.mode("overwrite").partitionBy("sink").parquet(f"{path}/epoch={epoch}")

    return judged.writeStream.foreachBatch(put)


def live_ratings(stream: DataFrame, upsert) -> object:
    """Latest-wins votes of a stream: each micro-batch's latest vote per tool and voter goes to `upsert(batch, epoch)`."""

    def apply(batch: DataFrame, epoch: int) -> None:
        latest = batch.where(F.col("score").between(1, 5)).groupBy("tool", "voter").agg(F.max_by(F.struct("score", "ts", "event_id"), F.struct("ts", "event_id")).alias("v"))
        upsert(latest.select("tool", "voter", "v.*"), epoch)

    return stream.writeStream.foreachBatch(apply)


class VoteStore:
    """The latest vote of each tool and voter, as a table in a shared folder with a version for each epoch. A batch is merged with the
    version before into its epoch's version, so that a batch that comes again writes the same; older versions are deleted."""

    def __init__(self, path: str):
        self.path, self.at, self.before = path, None, None

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        again = epoch == self.at
        earlier = self.before if again else self.at
        rows = batch if earlier is None else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{self.path}/v{earlier}"))
        latest = rows.groupBy("tool", "voter").agg(F.max_by(F.struct("score", "ts", "event_id"), F.struct("ts", "event_id")).alias("v"))
        latest.select("tool", "voter", "v.*").write.mode("overwrite").parquet(f"{self.path}/v{epoch}")
        if again:
            return
        if self.before is not None:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{self.before}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        self.at, self.before = epoch, self.at

    def votes(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v{self.at}")


def progress(results: DataFrame) -> DataFrame:
    return results.groupBy("batch", "status").agg(F.count("*").alias("n"))
