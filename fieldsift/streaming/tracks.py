"""GPS tracks as streams: sampling with state per trip, sessions, fresh deliveries and fan-out, with batch twins.

A fix is (trip, seq, micros, lon, lat, accuracy). Sampling keeps a trip's first point, then points that moved far enough
or drifted a little after a while; fixes of poor accuracy are refused and a full trip takes no more. State per trip is
one point and a count, so a trip may be of any length. Fixes without trip or place take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The sampling rule in metres and microseconds, and the most points of a trip.
MIN_MOVE_M, MIN_DRIFT_M, MIN_INTERVAL, MAX_ACCURACY_M, MAX_POINTS = 100.0, 25.0, 15_000_000, 250.0, 5000
EARTH_M = 6_371_000.0
DECISIONS = "trip long, seq long, micros long, lon double, lat double, reason string"
_STATE = "lon double, lat double, micros long, n long"


def metres(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return float(2 * EARTH_M * np.arcsin(min(1.0, np.sqrt(h))))


def decide(last: tuple | None, lon: float, lat: float, micros: int, accuracy: float | None) -> tuple[tuple | None, str]:
    """The state after one fix and what became of the fix. State: lon, lat and time of the last kept point, points kept."""
    if accuracy is not None and accuracy == accuracy and accuracy > MAX_ACCURACY_M:
        return last, "poor-accuracy"
    if last is None:
        return (lon, lat, micros, 1), "first"
    if last[3] >= MAX_POINTS:
        return last, "full"
    moved = metres(last[0], last[1], lon, lat)
    if moved >= MIN_MOVE_M:
        return (lon, lat, micros, last[3] + 1), "moved"
    if moved >= MIN_DRIFT_M and micros - last[2] >= MIN_INTERVAL:
        return (lon, lat, micros, last[3] + 1), "interval"
    return last, "unchanged"


def _told(rows: pd.DataFrame, reasons: list[str]) -> pd.DataFrame:
    return rows[["trip", "seq", "micros", "lon", "lat"]].assign(reason=reasons)


def _usable(fixes: DataFrame) -> DataFrame:
    return fixes.where("trip is not null and micros is not null and abs(lat) <= 90 and abs(lon) <= 180")


def sample_tracks(fixes: DataFrame) -> DataFrame:
    """What becomes of each fix. Trips are folded in time order over Arrow batches; no trip is ever held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trip, last = None, None
        for rows in batches:
            reasons = []
            for t, lon, lat, micros, accuracy in rows[["trip", "lon", "lat", "micros", "accuracy"]].itertuples(index=False, name=None):
                if t != trip:
                    trip, last = t, None
                last, reason = decide(last, lon, lat, micros, accuracy)
                reasons.append(reason)
            yield _told(rows, reasons)

    return _usable(fixes).repartition("trip").sortWithinPartitions("trip", "micros", "seq").mapInPandas(run, DECISIONS)


def sample_stream(fixes: DataFrame) -> DataFrame:
    """sample_tracks over a stream. Fixes of one micro-batch are taken in time order, micro-batches as they come."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["micros", "seq"])  # one trip's fixes of one micro-batch
        last = tuple(state.get) if state.exists else None
        reasons = []
        for lon, lat, micros, accuracy in rows[["lon", "lat", "micros", "accuracy"]].itertuples(index=False, name=None):
            last, reason = decide(last, lon, lat, int(micros), accuracy)
            reasons.append(reason)
        if last is not None:
            state.update((float(last[0]), float(last[1]), int(last[2]), int(last[3])))
        yield _told(rows, reasons)

    return _usable(fixes).groupBy("trip").applyInPandasWithState(run, DECISIONS, _STATE, "append", GroupStateTimeout.NoTimeout)


def sessions(fixes: DataFrame, time: str, gap: str, late: str | None = None) -> DataFrame:
    """A trip's recordings, ended by silence of gap; the finish is the last fix. late sets a watermark (streams need it)."""
    rows = fixes.withWatermark(time, late) if late else fixes
    return rows.groupBy("trip", F.session_window(time, gap).alias("session")).agg(F.min(time).alias("began"), F.max(time).alias("finished"), F.count("*").alias("n"))


def fresh_deliveries(rows: DataFrame, keys: list[str], time: str, fresh: str = "15 minutes") -> DataFrame:
    """A stream without what is delivered again inside the freshness window."""
    return rows.withWatermark(time, fresh).dropDuplicatesWithinWatermark(keys)


def fan_out(stream: DataFrame, consumers: list[Callable[[DataFrame, int], None]]) -> DataStreamWriter:
    """One source for several consumers: each micro-batch is read once and handed to all."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for consumer in consumers:
                consumer(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each)
