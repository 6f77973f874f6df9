"""Sessions over streams: logon pairs by keyed state, and activity sessions by gaps."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from daywatch.params import Params

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Session settings of keyed state and of sessions merged before the shuffle.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time a stream starts."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def pair_groups(on_group: np.ndarray, logon: np.ndarray, off_group: np.ndarray, logoff: np.ndarray,
                cap_minutes: float) -> tuple[np.ndarray, np.ndarray]:
    """(group, minutes) of the sessions of many groups: i-th logon with i-th logoff, by time."""
    n = int(max(on_group.max(initial=-1), off_group.max(initial=-1))) + 1
    counts = [np.bincount(g, minlength=n) for g in (on_group, off_group)]
    pairs, sides = np.minimum(*counts), []
    for group, at, count in zip((on_group, off_group), (logon, logoff), counts):
        order = np.lexsort((at, group))
        group, at = group[order], at[order]
        nth = np.arange(len(at)) - (np.cumsum(count) - count)[group]
        met = nth < pairs[group]
        sides.append((group[met], at[met]))
    (group, start), (_, end) = sides
    minutes = np.maximum(0.0, (end - start) / 60_000_000.0)
    kept = minutes < cap_minutes
    return group[kept], minutes[kept]


def pair_lengths(logon: np.ndarray, logoff: np.ndarray, cap_minutes: float) -> np.ndarray:
    """Minutes of the sessions of one (user, day): i-th logon with i-th logoff, by time."""
    one = [np.zeros(len(side), np.int64) for side in (logon, logoff)]
    return pair_groups(one[0], logon, one[1], logoff, cap_minutes)[1]


def pack(part: pd.DataFrame) -> bytes:
    """Users, stamps and kinds of events as one block: 12 bytes an event, a user's name once."""
    users = pa.array(part["user"], pa.string(), from_pandas=True).dictionary_encode()
    block = pa.record_batch({
        "user": users, "at": pa.array(part["at"].to_numpy(np.int64)),
        "is_logoff": pa.array(part["is_logoff"].to_numpy(bool))})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, block.schema) as writer:
        writer.write_batch(block)
    return out.getvalue().to_pybytes()


def unpack(blocks: list[bytes]) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    """(position of the user, users, at, is_logoff) of the events in all blocks."""
    whole = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks]) \
        .unify_dictionaries().combine_chunks()
    users = whole["user"].chunk(0)
    names = [*users.dictionary.to_pylist(), None]        # null is a user of its own
    return (users.indices.fill_null(len(names) - 1).to_numpy(), names, whole["at"].to_numpy(),
            whole["is_logoff"].to_numpy())


class _Pairing(StatefulProcessor):
    """State of a day's slot of users: their events, a packed block per chunk of input.

    A timer closes the day when the watermark passes its end; until then any later
    micro-batch may add events between those that are there.
    """

    def __init__(self, cap_minutes: float):
        self.cap = cap_minutes

    def init(self, handle):
        self.handle = handle
        self.events = handle.getListState("events", "block binary")

    def handleInputRows(self, key, rows, timerValues):
        end = None
        for part in rows:
            self.events.appendValue((pack(part),))
            end = part["day_end"].iloc[0]
        if end is not None:
            self.handle.registerTimer(int(end.value // 1_000_000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        user, names, at, off = unpack([r[0] for r in self.events.get()])
        self.events.clear()
        group, minutes = pair_groups(user[~off], at[~off], user[off], at[off], self.cap)
        count = np.bincount(group, minlength=len(names))
        total = np.bincount(group, weights=minutes, minlength=len(names))
        found = np.flatnonzero(count)
        if len(found):
            yield pd.DataFrame({"user": [names[i] for i in found], "day": [key[0]] * len(found),
                                "session_duration_total": total[found],
                                "session_count": count[found]})

    def close(self):
        pass


def stream_sessions(clean: DataFrame, lateness: str = "1 day", p: Params = Params(),
                    slots: int = 256) -> DataFrame:
    """`daily_sessions` of a cleaned logon stream, one row per (user, day) once it is closed.

    The watermark follows the ends of days, so an event is late only when its day is
    closed, whatever its hour; late events are dropped by Spark and counted in the
    progress.  Users are hashed to `slots`, and a slot of a day is one state and one call
    into Python, however many users it holds: a call per (user, day) costs far more than
    its few events.  A state is the slot's share of the day's events, 12 bytes each and a
    name per user and chunk of input.  The number of slots belongs to the checkpoint.
    """
    kind = F.lower("activity")
    events = clean.filter(kind.isin("logon", "logoff")).select(
        "user", "day", F.unix_micros("date").alias("at"), (kind == "logoff").alias("is_logoff"),
        F.date_add("day", 1).cast("timestamp").alias("day_end"),
        F.pmod(F.xxhash64("user"), F.lit(slots)).cast("int").alias("slot"))
    return events.withWatermark("day_end", lateness).groupBy("day", "slot").transformWithStateInPandas(
        _Pairing(p.session_cap_minutes),
        "user string, day date, session_duration_total double, session_count bigint",
        "append", "eventTime")


def keyed_state(spark: SparkSession):
    """Start streams with keyed state inside this context."""
    return setting(spark, PROVIDER, ROCKS)


# ---- inactivity gaps ------------------------------------------------------------

def gap_sessions(events: DataFrame, gap: str = "30 minutes", user: str = "user", at: str = "date"
                 ) -> DataFrame:
    """(user, start, last, events): activity without a pause longer than `gap`.

    Events of one user within a slot of the gap's length belong together anyway, so they
    are counted per slot before the shuffle: a user with a third of all events sends a
    row per slot.  `session_window` then merges the slots; each lasts from its first to
    its last event plus the gap.
    """
    micros = _micros(gap)
    slots = (events.select(F.col(user).alias("user"), F.col(at).alias("_at"))
             .dropna().groupBy("user", F.floor(F.unix_micros("_at") / micros).alias("slot"))
             .agg(F.min("_at").alias("first"), F.max("_at").alias("last"),
                  F.count(F.lit(1)).alias("events")))
    width = F.unix_micros("last") - F.unix_micros("first") + F.lit(micros)
    window = F.session_window("first", F.concat(width.cast("string"), F.lit(" microseconds")))
    return slots.groupBy("user", window).agg(
        F.min("first").alias("start"), F.max("last").alias("last"),
        F.sum("events").alias("events")).select("user", "start", "last", "events")


def stream_gap_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day",
                        user: str = "user", at: str = "date") -> DataFrame:
    """`gap_sessions` of a stream: a session is emitted when the watermark passes its end.

    State is one partial aggregate per open session.
    """
    timed = events.select(F.col(user).alias("user"), F.col(at).alias("_at")).dropna()
    return (timed.withWatermark("_at", lateness)
            .groupBy("user", F.session_window("_at", gap))
            .agg(F.min("_at").alias("start"), F.max("_at").alias("last"),
                 F.count(F.lit(1)).alias("events")).select("user", "start", "last", "events"))


def merged_before_shuffle(spark: SparkSession):
    """Start session streams inside this context: partitions merge their sessions first."""
    return setting(spark, LOCAL_MERGE, "true")


def _micros(gap: str) -> int:
    return pd.Timedelta(gap) // dt.timedelta(microseconds=1)
