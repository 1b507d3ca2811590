"""Retries with back-off and jitter, and a circuit breaker, for driver-side work such as sinks."""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_checkpoints


def exponential(first: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Callable[[int], float]:
    """Delay before attempt n = 1, 2, ...: first, first*factor, ..."""
    return lambda n: min(most, first * factor ** (n - 1))


def linear(first: float = 1.0, step: float = 1.0, most: float = 60.0) -> Callable[[int], float]:
    return lambda n: min(most, first + step * (n - 1))


def fixed(delay: float = 1.0) -> Callable[[int], float]:
    return lambda n: delay


class Jitter:
    """Spreads delays: none, full (0..d), equal (d/2..d), decorrelated (first..3 x the delay before)."""

    def __init__(self, kind: str = "none", most: float = 60.0, seed: int | None = None):
        if kind not in ("none", "full", "equal", "decorrelated"):
            raise ValueError(f"unknown jitter {kind}")
        self.kind, self.most, self.random, self.last = kind, most, random.Random(seed), None

    def __call__(self, delay: float) -> float:
        if self.kind == "full":
            return self.random.uniform(0, delay)
        if self.kind == "equal":
            return delay / 2 + self.random.uniform(0, delay / 2)
        if self.kind == "decorrelated":
            self.last = min(self.most, self.random.uniform(delay, 3 * (self.last or delay)) if (self.last or delay) * 3 > delay else delay)
            return self.last
        return delay


def retry(work: Callable[[], object], retries: int = 3, backoff: Callable[[int], float] = exponential(), jitter: Callable[[float], float] = Jitter(), only: type[Exception] = Exception, sleep: Callable[[float], None] = time.sleep, on_retry: Callable[[Exception], object] | None = None):
    """Runs work, again up to `retries` times after failures of kind `only`; the last failure is raised."""
    for n in range(retries + 1):
        try:
            return work()
        except only as e:
            if n == retries:
                raise
            if on_retry:
                on_retry(e)
            sleep(jitter(backoff(n + 1)))


class CircuitOpen(RuntimeError):
    pass


@dataclass
class CircuitBreaker:
    """Refuses work after too many failures, for `open_s`; then one trial decides.

    mode: consecutive failures; count of failures in the sampling window; their rate (with at
    least `minimum` calls); or hybrid, whichever comes first.
    """

    mode: str = "consecutive"
    failures: int = 5
    rate: float = 0.5
    minimum: int = 10
    open_s: float = 60.0
    sampling_s: float = 300.0
    clock: Callable[[], float] = time.monotonic
    state: str = "closed"
    _run: int = 0
    _since: float = 0.0
    _calls: deque = field(default_factory=deque)

    def call(self, work: Callable[[], object]):
        now = self.clock()
        if self.state == "open":
            if now - self._since < self.open_s:
                raise CircuitOpen("the circuit is open")
            self.state = "half-open"
        try:
            out = work()
        except Exception:
            self._note(False)
            raise
        self._note(True)
        return out

    def _note(self, ok: bool) -> None:
        now = self.clock()
        if self.state == "half-open":
            self.state, self._since, self._run = ("closed", 0.0, 0) if ok else ("open", now, self._run)
            self._calls.clear()
            return
        self._run = 0 if ok else self._run + 1
        self._calls.append((now, ok))
        while self._calls and now - self._calls[0][0] > self.sampling_s:
            self._calls.popleft()
        bad = sum(not k for _, k in self._calls)
        hit = {
            "consecutive": self._run >= self.failures,
            "count": bad >= self.failures,
            "rate": len(self._calls) >= self.minimum and bad / len(self._calls) >= self.rate,
        }
        if any(hit.values()) if self.mode == "hybrid" else hit[self.mode]:
            self.state, self._since = "open", now


def guard_reject_rate(accepted: DataFrame, rejected: DataFrame, most: float) -> None:
    """Stops a pipeline whose share of rejected rows is too high: one pass over each dataset."""
    bad = rejected.agg(F.count(F.lit(1))).first()[0]
    good = accepted.agg(F.count(F.lit(1))).first()[0]
    if bad and bad / (bad + good) > most:
        raise CircuitOpen(f"{bad} of {bad + good} rows were rejected; at most {most:.0%} may be")


def settled(work: Callable[[], DataFrame]) -> DataFrame:
    """The dataset, computed and written to the checkpoint folder: what fails, fails here and not in a later action."""
    made = work()
    with_checkpoints(made.sparkSession)
    return made.checkpoint()


def restarted(work: Callable[[], DataFrame], restarts: int = 3, backoff: Callable[[int], float] = fixed(0.0), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The dataset of a node that is built and computed again, up to `restarts` times, if it fails; nothing of a failed run is kept."""
    return retry(lambda: settled(work), restarts, backoff, sleep=sleep)


def or_empty(work: Callable[[], DataFrame], schema, spark) -> DataFrame:
    """The dataset, or an empty one of the given schema if it cannot be built or computed: go on without a node."""
    try:
        return settled(work)
    except Exception:  # the caller asked to continue without this node
        return spark.createDataFrame([], schema)
