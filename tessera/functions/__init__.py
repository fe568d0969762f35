"""Small helpers: driver-side grammars and JVM-side column expressions."""

from tessera.functions.columns import format_age, key_display
from tessera.functions.duration import parse_duration
from tessera.functions.env import expand, expand_connection

__all__ = ["expand", "expand_connection", "format_age", "key_display", "parse_duration"]
