"""Structured Streaming forms of the event operators.

Where an operator has no state it is the batch operator on a stream. Where it has, the state of a key is a few numbers;
each micro-batch's rows of a key come in chunks, are put in order of time, and update it. Watermarks bound what joins and
timeouts keep. Given in order of time, the streams end with what the batch operators give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docflow.operators import search as S
from docflow.operators.activity import COALESCE_MS, THROTTLE_MS

HIGHLIGHT_MS = 2000


def _sorted(chunks: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(chunks)).sort_values(order, kind="stable")


def pairs(starts: DataFrame, ends: DataFrame, key: str, time: str, within: str = "1 hour") -> DataFrame:
    """Starts with their ends (stream-stream inner join). An end later than `within` after its start finds it forgotten."""
    left = starts.withWatermark(time, within)
    right = ends.select(F.col(key).alias("__key"), F.col(time).alias("end_time"), *(c for c in ends.columns if c not in (key, time))).withWatermark("end_time", within)
    joined = left.join(right, (F.col(key) == F.col("__key")) & (F.col("end_time") >= F.col(time)) & (F.col("end_time") <= F.col(time) + F.expr(f"interval {within}")))
    return joined.drop("__key")


def _stateful(stream: DataFrame, key: str, out: T.StructType, state: T.StructType, update: Callable) -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(update, out, state, "append", GroupStateTimeout.NoTimeout)


def coalesced_edits(edits: DataFrame, key: str, page: str, ms: str, within: int = COALESCE_MS) -> DataFrame:
    """For each edit the entry (from 1) of its key's undo stack that it starts or joins."""
    kept = {f.name: f.dataType for f in edits.schema}
    out = T.StructType([T.StructField(key, kept[key]), T.StructField("entry", T.LongType()), T.StructField(page, T.LongType()), T.StructField(ms, T.LongType())])
    held = T.StructType([T.StructField(n, T.LongType()) for n in ("entry", "page", "ms")])

    def update(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry, last_page, last_ms = state.get if state.exists else (0, -1, 0)
        rows = []
        for p, t in _sorted(chunks, [ms])[[page, ms]].itertuples(index=False):
            if entry == 0 or p != last_page or t - last_ms >= within:
                entry += 1
            last_page, last_ms = int(p), int(t)
            rows.append((keys[0], entry, last_page, last_ms))
        state.update((entry, last_page, last_ms))
        yield pd.DataFrame(rows, columns=[f.name for f in out])

    return _stateful(edits, key, out, held, update)


def throttled(events: DataFrame, key: str, ms: str, every: int = THROTTLE_MS) -> DataFrame:
    """The events that pass: one, then none until `every` ms have gone."""
    out = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField(ms, T.LongType())])
    held = T.StructType([T.StructField("ms", T.LongType())])

    def update(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for t in _sorted(chunks, [ms])[ms]:
            if last is None or t - last >= every:
                last = int(t)
                rows.append((keys[0], last))
        state.update((last,))
        yield pd.DataFrame(rows, columns=[key, ms])

    return _stateful(events, key, out, held, update)


def changes(events: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Only the events whose payload (text) differs from the one before."""
    out = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField(order, T.LongType()), T.StructField(payload, T.StringType())])
    held = T.StructType([T.StructField("payload", T.StringType())])

    def update(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        known, rows = state.exists, []
        for at, now in _sorted(chunks, [order])[[order, payload]].itertuples(index=False):
            if not known or now != last:
                rows.append((keys[0], int(at), now))
            known, last = True, now
        state.update((last,))
        yield pd.DataFrame(rows, columns=[f.name for f in out])

    return _stateful(events, key, out, held, update)


def highlights(events: DataFrame, key: str, name: str, ttl_ms: int = HIGHLIGHT_MS) -> DataFrame:
    """key, name, action: a highlight is set by an event and cleared when none has come for ttl_ms (processing time)."""
    out = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("name", T.StringType()), T.StructField("action", T.StringType())])
    held = T.StructType([T.StructField("name", T.StringType())])

    def update(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(keys[0], last, "clear")], columns=[f.name for f in out])
            return
        names = [str(n) for chunk in chunks for n in chunk[name]]
        state.update((names[-1],))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(keys[0], n, "set") for n in names], columns=[f.name for f in out])

    return events.groupBy(key).applyInPandasWithState(update, out, held, "append", GroupStateTimeout.ProcessingTimeTimeout)


def search(pages: DataFrame, query: str, **options) -> DataFrame:
    """Matches as pages arrive; search keeps no state."""
    return S.search(pages, query, **options)


def summary(ends: DataFrame, kind: str, duration: str) -> DataFrame:
    """The timing summary so far (update or complete mode); the state is a row for each kind."""
    d = F.col(duration)
    return ends.where(d.isNotNull()).groupBy(kind).agg(F.count("*").alias("count"), F.sum(d).alias("total"), F.min(d).alias("min"), F.max(d).alias("max"))


def latest_state(events: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(state, order).alias(state))


def notify(actions: DataFrame, order: str, before: str, after: str, listener: Callable[[object, object], None]):
    """A stream writer that tells listener, once for each micro-batch, the state before its first action and after its last."""

    def tell(batch: DataFrame, _: int) -> None:
        row = batch.agg(F.count("*").alias("n"), F.min_by(before, order).alias("a"), F.max_by(after, order).alias("b")).first()
        if row["n"]:
            listener(row["a"], row["b"])

    return actions.writeStream.foreachBatch(tell)
