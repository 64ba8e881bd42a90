"""Calls of a slow, limited service from within a task: pacing, a time limit, retries, and a concurrency that adapts.

One task holds one pool of threads, so that one controller sees every outcome of its service. The main thread submits
jobs while fewer run than the controller allows; what a lower target leaves over waits, and nothing that runs is stopped.
"""

from __future__ import annotations

import queue
import re
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from ..schema import ATTEMPTS, BACKOFF_S, COURTESY_S, START, TIMEOUT_S
from .controller import State


class CallTimeoutError(Exception):
    """A call took longer than its limit."""


@dataclass
class Limits:
    """How a service may be called. retry waits are the answer's own (an error's retry_after), else BACKOFF_S."""

    start: int = START
    ramp_up: bool = False
    attempts: int = ATTEMPTS
    timeout_s: float = TIMEOUT_S
    delay_s: float = COURTESY_S
    sleep: Callable[[float], None] = time.sleep


@dataclass
class Outcome:
    """What came of a job. changes: the controller's steps (from, to, reason) since the outcome before."""

    index: int
    value: Any
    error: str | None
    attempts: int
    latency_s: float
    concurrency: int
    changes: list[tuple[int, int, str]] = field(default_factory=list)


def kind_of(error: BaseException) -> str:
    """timeout, or by the status code in the message as functions.text.error_class."""
    if isinstance(error, CallTimeoutError):
        return "timeout"
    found = re.search(r"\(([45][0-9][0-9])\)", str(error))
    code = found[1] if found else ""
    return "rate_limit" if code == "429" else "server" if code.startswith("5") else "other"


def within(fn: Callable[[], Any], limit_s: float) -> Any:
    """fn()'s result; a thread that outlives the limit is left to itself."""
    got: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            got.put((fn(), None))
        except BaseException as error:  # noqa: BLE001  it is raised again in the caller
            got.put((None, error))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = got.get(timeout=limit_s)
    except queue.Empty:
        raise CallTimeoutError(f"timed out after {limit_s}s") from None
    if error is not None:
        raise error
    return value


class Caller:
    """Jobs through one service, with the controller's state."""

    def __init__(self, fn: Callable[[Any], Any], limits: Limits):
        self.fn, self.limits = fn, limits
        self.state = State(start=limits.start, ramp_up=limits.ramp_up, target=limits.start)
        self.changes: list[tuple[int, int, str]] = []
        self.lock, self.gate, self.last = threading.Lock(), threading.Lock(), None

    def turn(self) -> None:
        """Wait until the courtesy delay since the last call's start is over."""
        with self.gate:
            wait = 0.0 if self.last is None else self.limits.delay_s - (time.monotonic() - self.last)
            if wait > 0:
                self.limits.sleep(wait)
            self.last = time.monotonic()

    def note(self, latency_s: float, error: str | None) -> None:
        with self.lock:
            before = self.state.target
            reason = self.state.step(latency_s, error)
            if self.state.target != before:
                self.changes.append((before, self.state.target, reason or ""))

    def job(self, index: int, payload: Any) -> Outcome:
        error: BaseException | None = None
        took = 0.0
        for attempt in range(self.limits.attempts):
            if error is not None:
                asked = getattr(error, "retry_after", None)
                self.limits.sleep(BACKOFF_S[min(attempt - 1, len(BACKOFF_S) - 1)] if asked is None else float(asked))
            self.turn()
            began = time.monotonic()
            try:
                value = within(lambda: self.fn(payload), self.limits.timeout_s)
            except Exception as failed:  # noqa: BLE001  any failure is the job's
                error, took = failed, time.monotonic() - began
                self.note(took, kind_of(failed))
                continue
            took = time.monotonic() - began
            self.note(took, None)
            return self.outcome(index, value, None, attempt + 1, took)
        return self.outcome(index, None, str(error), self.limits.attempts, took)

    def outcome(self, index: int, value: Any, error: str | None, attempts: int, took: float) -> Outcome:
        with self.lock:
            changes, self.changes = self.changes, []
            return Outcome(index, value, error, attempts, took, self.state.target, changes)

    def run(self, payloads: Iterable[Any]) -> Iterator[Outcome]:
        """Outcomes as they come. No more jobs wait than run."""
        ended: queue.Queue = queue.Queue()
        waiting, running = enumerate(payloads), 0
        more = True
        while more or running:
            while more and running < self.state.target:
                item = next(waiting, None)
                if item is None:
                    more = False
                    break
                running += 1
                threading.Thread(target=lambda i, p: ended.put(self.job(i, p)), args=item, daemon=True).start()
            if running:
                yield ended.get()
                running -= 1


def call_all(fn: Callable[[Any], Any], payloads: Iterable[Any], limits: Limits | None = None) -> Iterator[Outcome]:
    return Caller(fn, limits or Limits()).run(payloads)
