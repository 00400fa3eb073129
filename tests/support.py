"""Shared helpers of the tests."""

from __future__ import annotations

import math

import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NaT:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    """Rows as plain tuples, columns by name, in a fixed order."""
    names = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in row) for row in frame[names].itertuples(index=False, name=None)]
    return sorted(rows, key=repr)
