"""Folds and aggregates over streams.

A fold keeps each key's state as JSON between micro-batches and uses the same steps as docmill.operators.ordered; rows
of one micro-batch are taken in order, so a stream whose files come in order gives what the batch gives. Aggregates have
watermarks: what comes later than they allow is not counted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from docmill.operators import ledger


def folded_stream(rows: DataFrame, key: str, order: list[str], step: Callable, start: Callable, fields: str) -> DataFrame:
    """rows of a stream with what step(state, row) says of each; see ordered.folded. A state of tuples comes back as lists."""
    added = StructType.fromDDL(fields)

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else start()
        every = pd.concat(list(batches)).sort_values(order, kind="stable")  # a key's rows of one micro-batch
        said = []
        for row in every.to_dict("records"):
            held, values = step(held, row)
            said.append(values)
        state.update((json.dumps(held),))
        for k, name in enumerate(added.names):
            every[name] = [v[k] for v in said]
        yield every

    return rows.groupBy(key).applyInPandasWithState(run, StructType(rows.schema.fields + added.fields), "state string", "append", GroupStateTimeout.NoTimeout)


def usage_windows(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Usage of each translation in windows of time."""
    timed = ledger.of_translations(events).withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", window), "translation_id").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("total_cost_usd"), 6).alias("total_cost_usd"))


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Usage of each day."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day")).agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("total_tokens")).select(F.col("window.start").cast("date").alias("day"), "calls", "total_tokens")


def recorded_stream(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls of a stream as they go into the ledger: a join with a static table of prices."""
    return ledger.recorded(calls, prices)


def latest_cells(updates: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The last update of each cell in each day, as updates come (update or complete mode)."""
    rest = [c for c in updates.columns if c not in keys and c != at]
    return updates.withWatermark(at, late).groupBy(*keys, F.window(at, "1 day")).agg(F.max_by(F.struct(at, *rest), at).alias("r")).select(*keys, "r.*")


def phase_step(state, row):
    """Starts and ends of one phase of a job: when it started, and what it took."""
    if row["status"] == "started":
        return row["at"], (None,)
    return None, (None if state is None else max(0.0, row["at"] - state),)


def phase_stream(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events (key of job and phase, status, at) with the seconds that a phase took, on the row that ends it."""
    return folded_stream(events, key, order, phase_step, lambda: None, "seconds double")


def stalled_stream(activity: DataFrame, key: str, at: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """Keys that have shown nothing for more than some seconds, once the watermark says so: their sessions, closed. At a gap
    of exactly that, a session goes on."""
    gap = F.session_window(at, f"{seconds} seconds")
    return activity.withWatermark(at, late).groupBy(gap.alias("session"), key).agg(F.max(at).alias("last_activity"), F.count("*").alias("events"))


def limited(updates: DataFrame, condition: Column) -> DataFrame:
    """A stream's rows that a condition lets pass; nothing is kept of the others."""
    return updates.where(condition)
