"""A6 by counted ranges: how a large JDBC table is cut into partitions of about equal rows.

Equal strides between a lower and an upper bound, which a reader takes by default, put a skewed column's rows into few
tasks. Here the database counts its own rows per range; ranges that hold too many are cut again until every one holds at
most half the mean of a partition, and neighbours are joined up to the mean. So no partition passes one and a half
times the mean, unless a single value does (a range cannot cut it). Only counts of ranges reach the driver, about
``CUTS`` a round, and a round narrows what it cuts, whatever the table's size. Rows without a value are a partition of
their own. The outer partitions are open, so a row that comes in after the counting is read as well.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame

from tessera.errors import ConfigError

CUTS = 1000  # ranges counted by one query
DEFAULT_PARTITIONS = 8
_EPOCH = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)

Ask = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Range:
    """Values from ``low`` to ``high``, both included, as numbers; ``rows`` as counted."""

    low: int
    high: int
    rows: int


def _number(value) -> int:
    """A value's place on the integers: itself, a day's number, a time's microseconds."""
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            raise ConfigError("a partition column with a time zone cannot be planned; name lower and upper bounds")
        return (value - _EPOCH) // _MICRO
    if isinstance(value, date):
        return value.toordinal()
    if isinstance(value, int) or (isinstance(value, Decimal) and value == value.to_integral_value()):
        return int(value)
    raise ConfigError(f"a partition column must hold integers, dates or timestamps, got {value!r}")


def _literal(number: int, like) -> str:
    if isinstance(like, datetime):
        return f"TIMESTAMP '{_EPOCH + number * _MICRO:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(like, date):
        return f"DATE '{date.fromordinal(number)}'"
    return str(number)


def _cut(r: Range, pieces: int) -> list[tuple[int, int]]:
    """``r`` in at most ``pieces`` ranges of about equal width."""
    step = -(-(r.high - r.low + 1) // pieces)
    return [(low, min(low + step - 1, r.high)) for low in range(r.low, r.high + 1, step)]


def _count(ask: Ask, table: str, column: str, spans: list[tuple[int, int]], like) -> list[Range]:
    """Rows of ascending, disjoint spans by one grouped query; values between spans are not asked for."""
    cases, at = [], None
    for i, (low, high) in enumerate(spans):
        if at is not None and low > at + 1:
            cases.append(f"WHEN {column} < {_literal(low, like)} THEN -1")
        # The last moment of a span holds whatever lies before the next number.
        cases.append(f"WHEN {column} <= {_literal(high, like)} THEN {i}")
        at = high
    inside = f"{column} >= {_literal(spans[0][0], like)} AND {column} <= {_literal(spans[-1][1], like)}"
    rows = ask(
        f"SELECT span, COUNT(*) AS n FROM (SELECT CASE {' '.join(cases)} ELSE -1 END AS span FROM {table} WHERE {inside}) counted GROUP BY span"
    ).collect()  # at most CUTS + 1 rows
    found = {int(r[0]): int(r[1]) for r in rows}
    return [Range(low, high, found.get(i, 0)) for i, (low, high) in enumerate(spans)]


def plan(ask: Ask, table: str, column: str, partitions: int | None = None) -> list[str]:
    """One predicate per partition; together they hold every row once."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", column):
        raise ConfigError(f"partition column {column!r} is not a plain column name")
    partitions = int(partitions or DEFAULT_PARTITIONS)
    if partitions < 1:
        raise ConfigError(f"`partitions` must be at least 1, got {partitions}")
    none = f"{column} IS NULL"
    head = ask(f"SELECT COUNT({column}) AS present, MIN({column}) AS least, MAX({column}) AS most FROM {table}").first()
    present, least, most = int(head[0]), head[1], head[2]
    if present == 0 or partitions == 1:
        return [none, f"{column} IS NOT NULL"]
    mean = -(-present // partitions)
    bound = max(1, mean // 2)
    ranges = [Range(_number(least), _number(most), present)]
    while full := [r for r in ranges if r.rows > bound and r.high > r.low]:
        pieces = max(2, CUTS // len(full))
        spans = [s for r in full for s in _cut(r, pieces)]
        counted = []
        for at in range(0, len(spans), CUTS):
            counted += _count(ask, table, column, spans[at : at + CUTS], least)
        ranges = sorted([r for r in ranges if r not in set(full)] + counted, key=lambda r: r.low)
    ends, held = [], 0
    for r in ranges:
        if held and held + r.rows > mean + bound:
            ends.append(r.low - 1)
            held = 0
        held += r.rows
        if held >= mean and r.high < ranges[-1].high:
            ends.append(r.high)
            held = 0
    return [none, *_between(column, ends, least)]


def _between(column: str, ends: list[int], like) -> list[str]:
    if not ends:
        return [f"{column} IS NOT NULL"]
    at = [_literal(e, like) for e in ends]
    middle = [f"{column} > {a} AND {column} <= {b}" for a, b in zip(at, at[1:], strict=False)]
    return [f"{column} <= {at[0]}", *middle, f"{column} > {at[-1]}"]
