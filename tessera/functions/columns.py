"""JVM-side column expressions shared by the operators (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_display(cols: Sequence[str]) -> Column:
    """Human-readable key: values as strings joined by ' | ' (NULL parts are skipped)."""
    return F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols])


def format_age(seconds: Column) -> Column:
    """Compact age text: the two largest non-zero units ('1d 3h', '2h 5m', '4m', 'just now')."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    days = F.floor(s / 86400)
    hours = F.floor((s % 86400) / 3600)
    mins = F.floor((s % 3600) / 60)
    return (
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d "), hours.cast("string"), F.lit("h")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), mins.cast("string"), F.lit("m")))
        .when(mins > 0, F.concat(mins.cast("string"), F.lit("m")))
        .otherwise(F.lit("just now"))
    )
