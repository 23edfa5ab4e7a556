"""Deltas within a block in record order, plain and per identifier, with their inverses. Values are not null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def backward(v: str | Column, keys: list[str], order: list[str]) -> Column:
    """Value less the one before; the first is itself. Per identifier: add it to the keys."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(v - F.lag(v).over(window(keys, order)), v)


def forward(v: str | Column, keys: list[str], order: list[str]) -> Column:
    """The next value less this one; the last is itself."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.lead(v).over(window(keys, order)) - v, v)


def undo_backward(d: str, keys: list[str], order: list[str]) -> Column:
    return F.sum(d).over(window(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow))


def undo_forward(u: str, keys: list[str], order: list[str]) -> Column:
    """Twice the last less the sum from here on: v = v_last - (u_i + .. + u_(n-2)), u_(n-1) = v_last."""
    rest = window(keys, order).rowsBetween(W.currentRow, W.unboundedFollowing)
    return 2 * F.last(u).over(rest) - F.sum(u).over(rest)

