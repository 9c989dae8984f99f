"""Event rules that hold in batch, and their Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounce(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """key, started, ended, n: bursts of events of a key, apart by more than the gap."""
    w = Window.partitionBy(key).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.when(seconds - F.lag(seconds).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1)
    marked = events.withColumn("__new", new).withColumn("__burst", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "__burst").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n")).drop("__burst")


def debounce_stream(events: DataFrame, key: str, at: str, gap: str, late: str, value: str) -> DataFrame:
    """The streaming form: one row for each closed session, with its latest value."""
    stream = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stream.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"), F.max_by(value, at).alias("latest")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n", "latest")


def rate_limit(events: DataFrame, key: str, at: str, seconds: int, most: int) -> DataFrame:
    """Each event with ``used``, the events of its key in the window that ends with it, and whether it is allowed.

    The window is open on its early side; refused events count too.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("used", F.count("*").over(w)).withColumn("allowed", F.col("used") <= most)


def take_token(state: tuple[float, float] | None, at: float, rate: float, burst: float, cost: float) -> tuple[bool, tuple[float, float]]:
    """A token bucket's answer to one request and its new state (tokens, time)."""
    tokens, then = state if state else (burst, at)
    tokens = min(burst, tokens + max(0.0, at - then) * rate)
    if tokens >= cost:
        return True, (tokens - cost, max(at, then))
    return False, (tokens, max(at, then))


def token_bucket(events: DataFrame, key: str, at: str, rate: float, burst: float, cost: float = 1.0) -> DataFrame:
    """key, at, allowed in batch: rows arrive by key and time, and a task carries the bucket of the key it is at."""
    kinds = dict(events.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in frames:
            out = []
            for k, seconds in zip(pdf[key], pdf["__s"]):
                if now is None or k != now:
                    now, state = k, None
                ok, state = take_token(state, seconds, rate, burst, cost)
                out.append(ok)
            yield pdf[[key, at]].assign(allowed=out)

    rows = events.select(key, at, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("__s"))
    return rows.repartition(key).sortWithinPartitions(key, "__s").mapInPandas(run, f"{key} {kinds[key]}, {at} {kinds[at]}, allowed boolean")


def token_bucket_stream(events: DataFrame, key: str, at: str, rate: float, burst: float, cost: float = 1.0) -> DataFrame:
    """The streaming form: (key, at, allowed), the bucket being the key's state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(events.dtypes)

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        for pdf in frames:
            out = []
            for t in pdf.sort_values("__s")["__s"]:
                ok, held = take_token(held, float(t), rate, burst, cost)
                out.append(ok)
            yield pd.DataFrame({key: name[0], "at": pdf.sort_values("__s")["__s"].to_numpy(), "allowed": out})
        state.update(held)

    rows = events.select(key, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("__s"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, at double, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, at: str, width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    stream = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        stream = stream.withWatermark(at, late)
    return stream.groupBy(F.window(at, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("started"), *by, "n")


def incremental(apply: Callable[[DataFrame], None]):
    """A foreachBatch function that hands on, of each path, its latest event only."""

    def run(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "at").alias("r")).select("r.*")
        apply(latest)

    return run
