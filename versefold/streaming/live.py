"""Structured Streaming over the event log: progress by chapter, and the concurrency controller with state by key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.controller import State
from ..operators.eventlog import progress
from ..schema import SAMPLE, START

TRACE = "key string, seq long, target int, reason string"
_STATE = "target int, streak int, baseline double, recent array<double>"


def live_progress(events: DataFrame) -> DataFrame:
    """progress() of a stream, for output modes update and complete."""
    return progress(events)


def _advance(rows: pd.DataFrame, state: State) -> list[tuple]:
    out = []
    for seq, latency, error in rows.sort_values("seq")[["seq", "latency_s", "error"]].itertuples(index=False):
        reason = state.step(None if pd.isna(latency) else float(latency), error if isinstance(error, str) else None)
        out.append((int(seq), state.target, reason))
    return out


def _state(saved: tuple | None, start: int, ramp_up: bool) -> State:
    state = State(start=start, ramp_up=ramp_up, target=start)
    if saved is not None:
        state.target, state.streak, state.baseline = int(saved[0]), int(saved[1]), None if saved[2] is None or pd.isna(saved[2]) else float(saved[2])
        state.recent.extend(float(x) for x in saved[3])
    return state


def live_trace(outcomes: DataFrame, start: int = START, ramp_up: bool = False) -> DataFrame:
    """The controller over a stream of outcomes (key, seq, latency_s, error): target and reason after each, as they come.

    A micro-batch's rows are taken in order of seq; the state of a key is its target, streak, baseline and last latencies.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = _state(group.get if group.exists else None, start, ramp_up)
        made = _advance(pd.concat(list(frames)), state)
        group.update((state.target, state.streak, state.baseline, list(state.recent)))
        yield pd.DataFrame([(key[0], *m) for m in made], columns=["key", "seq", "target", "reason"])

    return outcomes.groupBy("key").applyInPandasWithState(step, TRACE, _STATE, "append", GroupStateTimeout.NoTimeout)


class ControllerProcessor(StatefulProcessor):
    """The same controller for transformWithStateInPandas."""

    def __init__(self, start: int = START, ramp_up: bool = False):
        self.start, self.ramp_up = start, ramp_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("controller", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = _state(tuple(self.saved.get()) if self.saved.exists() else None, self.start, self.ramp_up)
        made = _advance(pd.concat(list(rows)), state)
        self.saved.update((state.target, state.streak, state.baseline, list(state.recent)[-SAMPLE:]))
        yield pd.DataFrame([(key[0], *m) for m in made], columns=["key", "seq", "target", "reason"])

    def close(self) -> None:
        pass
