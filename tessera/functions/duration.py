"""Duration grammar for ``lookback``: ``<digits><s|m|h|d>``.

Three failures are kept apart because each has its own remedy: a bare number
(no unit), anything else that does not fit the grammar, and zero.
"""

from __future__ import annotations

import re
from datetime import timedelta

from tessera.errors import ConfigError

# The accepted unit suffixes and their length in seconds.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

_GRAMMAR = re.compile(r"(\d+)([a-zA-Z]+)")


def parse_duration(text: str) -> timedelta:
    s = "" if text is None else str(text)
    if s.isdigit():
        raise ConfigError(f"lookback {s!r} has no unit; add one of s, m, h, d (for example '2h')")
    m = _GRAMMAR.fullmatch(s)
    if not m or m.group(2) not in UNIT_SECONDS:
        raise ConfigError(f"lookback {s!r} is not a duration; write an integer followed by s, m, h or d")
    n = int(m.group(1))
    if n == 0:
        raise ConfigError(f"lookback {s!r} is zero; drop lookback or give a positive window")
    return timedelta(seconds=n * UNIT_SECONDS[m.group(2)])
