"""The life of a case: commands from an append-only event log (`event_log`), folded into states, in batch and as a stream.

Commands per case, in order of seq: case_submitted (v1, processing), checks_completed (processing -> outcome),
processing_interrupted (processing -> in_review), review_decided (in_review -> approved or rejected, if the expected
version is the current one). A command that doesn't fit is refused and changes nothing: the first of several wins.

With a patience, commands have a time too, and stand by it first: a case that is still in processing when its patience
has run out is interrupted then. In a stream a timer of the case does that once the watermark has passed; a later
command of the case, if it comes first, does it before its own turn. In batch, `until` takes the watermark's place. Times
are of milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COMMANDS = "seq long, case_id string, event string, to_status string, expected_version int"
RESULTS = "case_id string, seq long, event string, from_status string, to_status string, version int, refusal string"
_STATE = "status string, version int"
TIMED_COMMANDS, TIMED_RESULTS = f"{COMMANDS}, at timestamp", f"{RESULTS}, at timestamp"


def step(state: tuple[str, int] | None, event: str, to_status: str | None, expected: int | None) -> tuple[tuple[str, int] | None, str | None]:
    """(the next state, why the command is refused)."""
    if event == "case_submitted":
        return (("processing", 1), None) if state is None else (state, "already_exists")
    if state is None:
        return None, "not_found"
    status, version = state
    if event in ("checks_completed", "processing_interrupted"):
        if status != "processing":
            return state, "not_found"
        return ((to_status if event == "checks_completed" else "in_review"), version + 1), None
    if event == "review_decided":
        if status != "in_review":
            return state, "not_in_review"
        if expected != version:
            return state, "version_mismatch"
        return (to_status, version + 1), None
    return state, "unknown_event"


def _apply(state: tuple[str, int] | None, case_id: str, rows: pd.DataFrame) -> tuple[tuple[str, int] | None, list[tuple]]:
    """The state after a case's rows, which stand in order, and their RESULTS."""
    out = []
    for r in rows.itertuples():
        expected = None if pd.isna(r.expected_version) else int(r.expected_version)
        new, refusal = step(state, r.event, r.to_status, expected)
        out.append((case_id, r.seq, r.event, state[0] if state else None, new[0] if new else None, new[1] if new else None, refusal))
        state = new
    return state, out


_NAMES = [x.split()[0] for x in RESULTS.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"version": "Int32"})


def fold(commands: DataFrame) -> DataFrame:
    """RESULTS of every command. Partitioned by case and sorted, commands pass one by one beside the state of the case at
    hand, so that a case of any length needs no memory of its own."""

    def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, state = None, None
        for batch in batches:
            out = []
            for case_id, rows in batch.groupby("case_id", sort=False, dropna=False):
                state, done = _apply(state if case_id == case else None, case_id, rows)
                case, out = case_id, out + done
            yield _frame(out)

    columns = [x.split()[0] for x in COMMANDS.split(", ")]
    known = commands.select(*columns).where("case_id is not null")
    return known.repartition("case_id").sortWithinPartitions("case_id", "seq").mapInPandas(pass_by, RESULTS)


class CaseProcessor(StatefulProcessor):
    """fold as a stream: the state of a case is its status and version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("case", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get() if self.state.exists() else None
        ordered = pd.concat(list(rows)).sort_values("seq", kind="stable")  # of one trigger
        now, out = _apply(tuple(state) if state else None, key[0], ordered)
        if now is not None:
            self.state.update(now)
        yield _frame(out)

    def close(self) -> None:
        pass


def fold_stream(commands: DataFrame) -> DataFrame:
    return commands.groupBy("case_id").transformWithStateInPandas(CaseProcessor(), outputStructType=RESULTS, outputMode="append", timeMode="none")


# --- with a patience -----------------------------------------------------------------------------------------------

_TIMED_STATE = "status string, version int, deadline long"
_TIMED_ROWS = f"{RESULTS}, at_ms long"
Timed = tuple[str, int, int | None]


def _run_out(case_id: str, state: Timed | None, now: int | None) -> tuple[Timed | None, list[tuple]]:
    """The state after the patience with it, if it has run out by now; the interruption as a row without seq."""
    if state is None or now is None or state[0] != "processing" or state[2] > now:
        return state, []
    status, version, deadline = state
    return ("in_review", version + 1, None), [(case_id, None, "processing_interrupted", status, "in_review", version + 1, None, deadline)]


def _apply_timed(state: Timed | None, case_id: str, rows: pd.DataFrame, patience: int) -> tuple[Timed | None, list[tuple]]:
    out = []
    for r in rows.itertuples():
        at = None if pd.isna(r.at_ms) else int(r.at_ms)
        state, gone = _run_out(case_id, state, at)
        out += gone
        expected = None if pd.isna(r.expected_version) else int(r.expected_version)
        new, refusal = step(state[:2] if state else None, r.event, r.to_status, expected)
        out.append((case_id, r.seq, r.event, state[0] if state else None, new[0] if new else None, new[1] if new else None, refusal, at))
        if new is not None:
            begun = state is None and at is not None
            state = (*new, (at + patience if begun else state[2] if state else None) if new[0] == "processing" else None)
            if state[0] == "processing" and state[2] is None:  # a submission without a time waits for ever
                state = (*new, 1 << 62)
    return state, out


def _timed_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*_NAMES, "at_ms"]).astype({"version": "Int32", "seq": "Int64", "at_ms": "Int64"})


def _with_time(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.timestamp_millis("at_ms").alias("at")).drop("at_ms")


def fold_with_patience(commands: DataFrame, patience: int, until: int | None = None) -> DataFrame:
    """TIMED_RESULTS of TIMED_COMMANDS and of the interruptions up to `until`; patience and until are in milliseconds."""

    def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, state = None, None
        for batch in batches:
            out = []
            for case_id, rows in batch.groupby("case_id", sort=False, dropna=False):
                if case_id != case:
                    out += _run_out(case, state, until)[1]
                    case, state = case_id, None
                state, done = _apply_timed(state, case_id, rows, patience)
                out += done
            yield _timed_frame(out)
        yield _timed_frame(_run_out(case, state, until)[1])

    columns = [x.split()[0] for x in COMMANDS.split(", ")]
    known = commands.where("case_id is not null").select(*columns, F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"))
    return _with_time(known.repartition("case_id").sortWithinPartitions("case_id", "at_ms", "seq").mapInPandas(pass_by, _TIMED_ROWS))


class PatientProcessor(StatefulProcessor):
    """fold_with_patience as a stream. A case in processing has one timer, at its deadline."""

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("case", _TIMED_STATE)

    def _state(self) -> Timed | None:
        found = self.state.get() if self.state.exists() else None
        return None if found is None else (found[0], found[1], found[2])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._state()
        ordered = pd.concat(list(rows)).sort_values(["at_ms", "seq"], kind="stable", na_position="first")  # of one trigger
        now, out = _apply_timed(before, key[0], ordered, self.patience)
        if now is not None:
            self.state.update(now)
        was, wanted = (s[2] if s and s[0] == "processing" else None for s in (before, now))
        if was != wanted:
            if was is not None:
                self.handle.deleteTimer(was)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        yield _timed_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = _run_out(key[0], self._state(), expiredTimerInfo.getExpiryTimeInMs())
        if out:
            self.state.update(now)
        yield _timed_frame(out)

    def close(self) -> None:
        pass


def fold_stream_with_patience(commands: DataFrame, patience: int, delay: str) -> DataFrame:
    """A stream of TIMED_COMMANDS. Commands may come later than others by `delay`; later ones are not read. Needs the RocksDB
    state store."""
    columns = [x.split()[0] for x in COMMANDS.split(", ")]
    timed = commands.where("case_id is not null").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    keyed = timed.select(*columns, "at", F.unix_millis("at").alias("at_ms")).groupBy("case_id")
    return _with_time(keyed.transformWithStateInPandas(PatientProcessor(patience), outputStructType=_TIMED_ROWS, outputMode="append", timeMode="eventTime"))


# --- states --------------------------------------------------------------------------------------------------------


def latest(events: DataFrame, key: str = "case_id", order: str = "seq") -> DataFrame:
    """The current state per case: the last event of the log, without a window."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def orphans(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Events of cases that don't exist."""
    return events.join(cases.select("case_id"), "case_id", "left_anti")


def interrupted(states: DataFrame) -> DataFrame:
    """Cases left in processing by a stopped run, as commands that send them to review."""
    return states.where("status = 'processing'").select("case_id", F.lit("processing_interrupted").alias("event"), F.lit("in_review").alias("to_status"))
