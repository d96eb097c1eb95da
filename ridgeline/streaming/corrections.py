"""The log of corrections as a stream: the state of each site after every batch (an extension of survey AG10).

State is one small row for each site that was ever corrected, partitioned by
database_line. Within a batch events are folded by seq; an event of a later batch
is taken as later, so a late one must be held back by the source.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "database_line long, status string, d_lon double, d_lat double, d_alt double"
STATE = "status string, d_lon double, d_lat double, d_alt double"
_NONE = (None, 0.0, 0.0, 0.0)


def fold_event(state: tuple, action: str, d_lon: float | None, d_lat: float | None, d_alt: float | None) -> tuple:
    """(status, d_lon, d_lat, d_alt) after one event; see ``operators.corrections`` for the actions."""
    status, lon, lat, alt = state
    if action == "bad":
        return "bad", 0.0, 0.0, 0.0
    if action == "reset":
        return _NONE
    if action == "move" and status == "bad":
        return state
    if action in ("changed", "move"):
        lon, lat = lon if d_lon is None else d_lon, lat if d_lat is None else d_lat
    if action in ("changed", "altitude") and d_alt is not None:
        alt += d_alt
    return "changed", lon, lat, alt


def _none(value):
    return None if value is None or value != value else value


def _fold(key: tuple, frames: Iterable[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
    state = held.get if held.exists else _NONE
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    for r in rows.itertuples():
        state = fold_event(state, r.action, _none(r.d_lon), _none(r.d_lat), _none(r.d_alt))
    held.update(state)
    changed = state[0] == "changed"
    yield pd.DataFrame({"database_line": [key[0]], "status": [state[0]], **{c: [v if changed else None] for c, v in zip(("d_lon", "d_lat", "d_alt"), state[1:])}})


def fold_stream(log: DataFrame) -> DataFrame:
    """Updates of a streaming log (seq, database_line, action, d_lon, d_lat, d_alt): the state of each site a batch touched.

    A null status means that a reset left the site without a correction.
    """
    return log.groupBy("database_line").applyInPandasWithState(_fold, SCHEMA, STATE, "update", "NoTimeout")
