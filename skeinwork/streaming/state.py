"""Leases, gates and watched files as streams: state for each key, with timers that go off when no event comes."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.journal import LEASE_SECONDS
from ..operators.matching import longest_prefix

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Start queries of this module within it: they need the RocksDB state store, and keep it when the session has its own back."""
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER[0], before) if before else spark.conf.unset(_PROVIDER[0])


def _batch(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable")


class _Leases(StatefulProcessor):
    """The holder of one worktree and when its lease ends; a timer tells when it has."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.lease = handle, handle.getValueState("lease", "holder string, expires long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        holder, expires, _ = self.lease.get() if self.lease.exists() else (None, None, None)
        ended, out = expires, []
        for r in _batch(rows, "seq").itertuples(index=False):
            at, who = int(r.at_s), r.who if isinstance(r.who, str) else None
            ok = who is not None and (holder == who if r.op != "acquire" else holder in (None, who) or expires <= at)
            if ok:
                holder, expires = (None, None) if r.op == "release" else (who, at + self.ttl)
            out.append((key[0], int(r.seq), "granted" if ok else "refused", holder, expires))
        if expires != ended:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if expires is not None:
                self.handle.registerTimer(expires * 1000)
        self.lease.update((holder, expires, out[-1][1]))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        holder, expires, seq = self.lease.get()
        # who held it may still renew or give it back, so it stays; that it has ended is told once
        yield _frame([(key[0], seq, "expired", holder, expires)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["worktree", "seq", "outcome", "holder", "expires"])
    return out.astype({"worktree": "object", "seq": "int64", "holder": "object", "expires": "Int64"})


def leases(requests: DataFrame, ttl: int = LEASE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """(worktree, seq, outcome, holder, expires): granted or refused for each request, as journal.lease_log() judges them, and expired
    when a lease has ended: the stream's time has passed its end and no request has renewed it or given it back.

    requests: worktree, seq, at (timestamp), who, op. A worktree's requests come in order of seq, also over batches. State is a
    holder and two numbers for each worktree.
    """
    rows = requests.filter("worktree is not null").withWatermark("at", late).select("worktree", "seq", "at", F.unix_timestamp("at").alias("at_s"), "who", "op")
    return rows.groupBy("worktree").transformWithStateInPandas(_Leases(ttl), "worktree string, seq long, outcome string, holder string, expires long", "Append", "EventTime")


#: Decisions of a gate (fixed values).
PENDING, APPROVED, REJECTED, EXPIRED = "pending", "approved", "rejected", "expired"


def gate_step(state: tuple | None, op: str, at: int, by: str | None, timeout: int) -> tuple[tuple | None, str]:
    """(state, outcome) of one event of a gate; state is (decision, deadline, opened, by), null before it is first asked for.

    ask opens a gate, or gives the answer that it has (`approved`, `rejected`; `waiting` while it is open) up to its deadline, after
    which it opens anew. approve and reject decide an open gate and are refused otherwise. An open gate is expired from its
    deadline on, whatever comes.
    """
    decision, deadline = (state[0], state[1]) if state else (None, 0)
    over = state is not None and timeout > 0 and at > deadline
    if over and decision == PENDING:
        state, decision = (EXPIRED, deadline, state[2], "system"), EXPIRED
    if op == "ask":
        if decision == PENDING:
            return state, "waiting"
        if decision in (APPROVED, REJECTED) and not over:
            return state, decision
        return (PENDING, at + timeout, at, None), "opened"
    if decision != PENDING:
        return state, "refused"
    answer = APPROVED if op == "approve" else REJECTED
    return (answer, deadline, state[2], by), answer


class _Gates(StatefulProcessor):
    """One gate's decision and deadline; a timer lets it expire when nobody answers."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.gate = handle, handle.getValueState("gate", "decision string, deadline long, opened long, by string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = tuple(self.gate.get()) if self.gate.exists() else None, []
        for r in _batch(rows, "seq").itertuples(index=False):
            before, by = state, r.by if isinstance(r.by, str) else None
            state, outcome = gate_step(state, r.op, int(r.at_s), by, self.timeout)
            if before and before[0] == PENDING and self.timeout > 0 and int(r.at_s) > before[1]:
                out.append((key[0], int(r.seq), EXPIRED, before[1]))  # it was over before this came
            out.append((key[0], int(r.seq), outcome, state[1] if state else None))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if state:
            self.gate.update(state)
            if state[0] == PENDING and self.timeout > 0:
                self.handle.registerTimer(state[1] * 1000 + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        decision, deadline, opened, _ = self.gate.get()
        if decision == PENDING:
            self.gate.update((EXPIRED, deadline, opened, "system"))
            yield self._frame([(key[0], None, EXPIRED, deadline)])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["gate", "seq", "outcome", "deadline"]).astype({"gate": "object", "seq": "Int64", "deadline": "Int64"})

    def close(self) -> None:
        pass


def gates(events: DataFrame, timeout: int, late: str = "0 seconds") -> DataFrame:
    """(gate, seq, outcome, deadline) of each event by gate_step(), and expired, with a null seq, when nobody has answered in time.

    events: task, kind, candidate, seq, at (timestamp), op (ask, approve or reject), by. A gate is of one task, kind and candidate; one
    without a candidate is for its seq alone, as nothing says what an answer would be about.
    """
    name = F.concat_ws("|", "task", "kind", F.when(F.coalesce("candidate", F.lit("")) == "", F.concat(F.lit("#"), "seq")).otherwise(F.col("candidate")))
    rows = events.withWatermark("at", late).select(name.alias("gate"), "seq", "at", F.unix_timestamp("at").alias("at_s"), "op", "by")
    return rows.groupBy("gate").transformWithStateInPandas(_Gates(timeout), "gate string, seq long, outcome string, deadline long", "Append", "EventTime")


class _Watch(StatefulProcessor):
    """The distinct paths of one root since its burst began; a timer ends it."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.paths = handle, handle.getMapState("paths", "path string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        quiet = not self.paths.exists()
        for batch in rows:
            for path, n in batch["path"].value_counts().items():
                before = self.paths.getValue((path,))[0] if self.paths.containsKey((path,)) else 0
                self.paths.updateValue((path,), (before + int(n),))
        if quiet:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay_ms)
        yield pd.DataFrame({"root": pd.Series(dtype="object"), "path": pd.Series(dtype="object"), "n": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [(k[0], v[0]) for k, v in self.paths.iterator()]
        self.paths.clear()
        yield pd.DataFrame({"root": [key[0]] * len(found), "path": [p for p, _ in found], "n": [n for _, n in found]})

    def close(self) -> None:
        pass


def bursts(events: DataFrame, delay_ms: int = 250) -> DataFrame:
    """(root, path, n): the distinct paths of a root's events, each once, `delay_ms` after the first of them; later ones do not push that back.

    events: root, path. State is a map of paths, so a path that is written a thousand times is one entry.
    """
    rows = events.filter("root is not null and path is not null").select(F.col("root").cast("string"), F.col("path").cast("string"))
    return rows.groupBy("root").transformWithStateInPandas(_Watch(delay_ms), "root string, path string, n long", "Append", "ProcessingTime")


def mark_dirty(found: DataFrame, repositories: DataFrame, mark: Callable[[DataFrame, str], object], checkpoint: str, name: str, trigger: dict) -> StreamingQuery:
    """Mark the repositories that a burst's paths lie in, each once a batch: by its longest root that is the path or above it.

    found: path, from bursts(); repositories: repository, root. mark is called with (repository) and a name that is the batch's own,
    so one that a restart repeats changes nothing where mark keeps names, as Table.upsert() does.
    """

    def each(batch: DataFrame, number: int) -> None:
        at = longest_prefix(batch.select("path"), repositories).filter("root is not null").select("root").distinct()
        mark(at.join(repositories, "root").select("repository").distinct(), f"{name}-{number}")

    with keyed_state(found.sparkSession):
        return found.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
