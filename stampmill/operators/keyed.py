"""Picking rows of a large table by key without moving the large side when the keys are few."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# A key row is a handful of numbers, so this many are a few tens of MB on each executor.
BROADCAST_KEYS = 500_000


def sendable(keys: DataFrame) -> DataFrame:
    """The keys, marked to be sent to every executor when a count shows they are few; else as they are."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def fetch(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the table whose key is listed, with the key row's other columns."""
    return table.join(sendable(keys), list(on))


def keep(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the table whose key is listed."""
    return table.join(sendable(keys.select(*on)), list(on), "left_semi")
