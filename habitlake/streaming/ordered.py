"""Event-time order for keyed stream processors (``applyInPandasWithState``).

Files and partitions deliver rows in any order; a rule that depends on order
must not see them so. :class:`InOrder` holds a key's events in state until the
watermark has passed them and then applies them by (time, kind, id). Events
that arrive behind what was applied are late and ignored; they change nothing
else.

A call into Python costs far more than a rule, so keys are dealt to groups by
their hash, and a group's keys share one state row, one call a micro-batch and
one event-time timeout, at the earliest thing that waits in it (an event, or
what the processor itself asks for). A group holds the open keys that fell to
it, and nothing of the closed ones.

Live streams are driven by later events of any key. A replay ends with a
heartbeat row (:func:`with_heartbeat`), which moves the watermark past the
last event and is itself ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEARTBEAT = -1  # kind of a row that only carries time
NEVER = 1 << 62
GROUPS = 256    # groups that keys are dealt to; part of a query's checkpoint
GROUP_STATE = T.StructType([T.StructField("kept", T.BinaryType())])


def group_of(*keys) -> F.Column:
    """The group of a key."""
    return F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int")


def load(state: GroupState):
    """What :func:`save` kept for a group, or None."""
    return pickle.loads(bytes(state.get[0])) if state.exists else None


def save(state: GroupState, kept) -> None:
    state.update((pickle.dumps(kept, pickle.HIGHEST_PROTOCOL),))


class InOrder:
    """Applies each key's events in order. Input columns: ``keys``, then ``at_us``, ``kind``, ``id`` and ``payload``
    columns, all NOT NULL. Subclasses give:

    * ``keys`` and ``payload``: names of these columns; ``fresh``: the state of a new key; ``out``: the output's schema;
    * ``apply(key, state, event, out)``: applies one event (a tuple at_us, kind, id, *payload), returns the state;
    * ``until(key, state, us, out)``: what happens by itself before ``us``, returns the state;
    * ``wake(key, state)``: when something happens by itself next (``NEVER`` if nothing);
    * ``over(key, state, us)``: whether the key can be forgotten at ``us``.
    """

    keys: tuple = ()
    payload: tuple = ()
    fresh: tuple = ()
    out: T.StructType = T.StructType()

    def run(self, events: DataFrame) -> DataFrame:
        return (events.withColumn("_group", group_of(*self.keys)).groupBy("_group")
                .applyInPandasWithState(self._call, self.out, GROUP_STATE, "append", GroupStateTimeout.EventTimeTimeout))

    def _call(self, _, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        states, pending = load(state) or ({}, {})  # per key: its state, its events that wait
        if not state.hasTimedOut:
            n = len(self.keys)
            names = [*self.keys, "at_us", "kind", "id", *self.payload]
            for pdf in rows:
                for row in zip(*[pdf[c].tolist() for c in names]):
                    if row[n + 1] != HEARTBEAT:
                        pending.setdefault(row[:n], []).append(row[n:])
        out, now_ms = [], state.getCurrentWatermarkMs()
        if now_ms > 0:
            self._advance(states, pending, now_ms * 1000, out)
        if states or pending:
            save(state, (states, pending))
            first = min([min(e)[0] for e in pending.values()] + [self.wake(k, s) for k, s in states.items()])
            if first < NEVER:
                state.setTimeoutTimestamp(max(-(-first // 1000), now_ms + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=self.out.names, dtype=object)

    def _advance(self, states: dict, pending: dict, us: int, out: list) -> None:
        """Applies everything up to ``us``."""
        for key in [*pending, *[k for k in states if k not in pending]]:
            state = states.get(key, self.fresh)
            events = sorted(pending.get(key, ()))
            due = [e for e in events if e[0] <= us]
            if not due and self.wake(key, state) > us:
                continue
            for e in due:
                state = self.until(key, state, e[0], out)
                state = self.apply(key, state, e, out)
            state = self.until(key, state, us, out)
            pending.pop(key, None)
            states.pop(key, None)
            if len(due) < len(events):
                pending[key] = events[len(due):]
            elif self.over(key, state, us):
                continue
            states[key] = state


def with_heartbeat(events: DataFrame, at: str, days: int = 2) -> DataFrame:
    """``events`` and one row ``days`` after the last (kind ``HEARTBEAT``; every other column NULL): the end of a replay."""
    last = events.agg((F.max(at) + F.expr(f"INTERVAL {days} DAYS")).alias(at)).where(F.col(at).isNotNull())
    row = last.select(*[F.col(at) if c == at else F.lit(HEARTBEAT if c == "kind" else None).cast(events.schema[c].dataType).alias(c)
                        for c in events.columns])
    return events.unionByName(row)
