"""Cue, start and end events to task segments; quality ledger of trials.

`segments` and `violations` are relational: each event looks at its relevant neighbours in its file. `walk` follows one
ordered list by a table of moves, for streams and grouped use, and tells what is out of order instead of stopping.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Event codes, what they announce, and the label they carry.
CODES = {769: ("cue", 0), 770: ("cue", 1), 7691: ("start", 0), 7701: ("start", 1), 7692: ("end", None), 7693: ("end", None), 7702: ("end", None), 7703: ("end", None), 1000: ("trial", None)}
#: Where an event leads from each phase; what has no entry is out of order.
MOVES = {("free", "trial"): "free", ("free", "cue"): "cued", ("free", "end"): "free", ("cued", "start"): "busy", ("cued", "end"): "cued", ("busy", "end"): "free"}
REASONS = {"trial": "a trial begins before the last task ended", "cue": "a cue before the last task ended", "start": "a start without a cue of its own"}


class State(NamedTuple):
    """One file so far: its phase, and the label, cue and start of the task at hand."""

    phase: str = "free"
    label: int | None = None
    cue: int | None = None
    start: int | None = None


class Found(NamedTuple):
    """A whole task, or, with a reason, an event out of order (then `start` is where it stands)."""

    start: int
    end: int | None
    label: int | None
    cue: int | None
    code: int | None
    reason: str | None = None


def follow(state: State, at: int, code: int, codes: dict[int, tuple[str, int | None]] = CODES) -> tuple[State, Found | None]:
    """The state after one event, and what it completes or breaks; a break starts the file's state anew."""
    kind, label = codes.get(code, (None, None))
    if kind is None:
        return state, None
    to = MOVES.get((state.phase, kind))
    broken = None if to else REASONS[kind]
    if to == "busy" and (label != state.label or at <= state.cue):
        broken = REASONS["start"]
    if state.phase == "busy" and to == "free" and at <= state.start:
        broken = "a task without duration"
    if broken:
        return State(), Found(at, None, None, None, code, broken)
    if kind == "cue":
        return State("cued", label, at), None
    if kind == "start":
        return state._replace(phase="busy", start=at), None
    if state.phase == "busy":
        return State(), Found(state.start, at, state.label, state.cue, code)
    return state, None


def walk(events: Iterable[tuple[int, int]], codes: dict[int, tuple[str, int | None]] = CODES) -> Iterator[Found]:
    """All tasks and breaks of one file's (sample, code) events, in order; a task or cue left open at the end is a break."""
    state, at = State(), 0
    for at, code in events:
        state, found = follow(state, int(at), int(code), codes)
        if found:
            yield found
    if state.phase != "free":
        yield Found(int(at), None, None, None, None, "the file ends within a task or after an unused cue")


def tasks(events: Iterable[tuple[int, int]], codes: dict[int, tuple[str, int | None]] = CODES) -> list[Found]:
    """The tasks of one file; ValueError at the first break."""
    out = []
    for found in walk(events, codes):
        if found.reason:
            raise ValueError(f"sample {found.start}: {found.reason}")
        out.append(found)
    return out


def segments(events: DataFrame, file: str, at: str, kind: str, cue: str, start: str, end: str) -> DataFrame:
    """(file, cue_at, start_at, end_at) of each start whose last relevant event before is a cue and next one an end; by windows over one file."""
    e = events.where(F.col(kind).isin(cue, start, end)).select(file, at, kind)
    w = Window.partitionBy(file).orderBy(at)
    e = e.withColumns({"_pk": F.lag(kind).over(w), "_pa": F.lag(at).over(w), "_nk": F.lead(kind).over(w), "_na": F.lead(at).over(w)})
    return e.where((F.col(kind) == start) & (F.col("_pk") == cue) & (F.col("_nk") == end)).select(file, F.col("_pa").alias("cue_at"), F.col(at).alias("start_at"), F.col("_na").alias("end_at"))


def violations(events: DataFrame, file: str, at: str, kind: str, cue: str, start: str, end: str, label: str | None = None) -> DataFrame:
    """(file, at, reason): events out of order, kept as rows instead of stopping at the first (V11). With `label`, a start must carry its cue's; with equal places, a task has no duration."""
    e = events.where(F.col(kind).isin(cue, start, end)).select(file, at, kind, (F.col(label) if label else F.lit(0)).alias("_l"))
    w = Window.partitionBy(file).orderBy(at)
    e = e.withColumns({"_pk": F.lag(kind).over(w), "_pl": F.lag("_l").over(w), "_pa": F.lag(at).over(w), "_nk": F.lead(kind).over(w)})
    k, before = F.col(kind), F.col("_pk")
    reason = (
        F.when((k == cue) & before.isin(cue, start), "cue before the last task ended")
        .when((k == start) & ~F.coalesce(before == cue, F.lit(False)), "start without a cue")
        .when((k == start) & ((F.col("_pl") != F.col("_l")) | (F.col("_pa") >= F.col(at))), "start of another cue")
        .when((k == end) & (before == start) & (F.col("_pa") >= F.col(at)), "no duration")
        .when(k.isin(cue, start) & F.col("_nk").isNull(), "unterminated")
    )
    return e.withColumn("reason", reason).where("reason is not null").select(file, at, "reason")


def quality_ledger(segments_: DataFrame, duration: str, least: float, bounds: Column | None = None, artifact: Column | None = None) -> DataFrame:
    """Each segment with its exclusion reason, null if kept (X4, P11): too short, else outside its recording (`bounds` false or null), else an artifact."""
    reason = F.when(F.col(duration).isNull() | (F.col(duration) < least), "short")
    if bounds is not None:
        reason = reason.when(~F.coalesce(bounds, F.lit(False)), "bounds")
    if artifact is not None:
        reason = reason.when(F.coalesce(artifact, F.lit(False)), "artifact")
    return segments_.withColumn("exclusion_reason", reason)


def session_inventory(ledger: DataFrame, by: list[str], duration: str, label: str | None = None, classes: tuple = ()) -> DataFrame:
    """(by, total, retained, min_duration, n_<class> …) (X5); guard it with validate.minimum."""
    kept = F.col("exclusion_reason").isNull()
    counts = [F.count_if(kept & (F.col(label) == c)).alias(f"n_{c}") for c in classes]
    return ledger.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(kept).alias("retained"), F.min(F.when(kept, F.col(duration))).alias("min_duration"), *counts)
