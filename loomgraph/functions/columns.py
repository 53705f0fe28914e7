"""Column helpers that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def epoch_seconds(ts: str) -> Column:
    return epoch_micros(ts) / 1e6


def local_time(seconds: str, timezone: str) -> Column:
    """Wall-clock timestamp in ``timezone`` of seconds since 1970."""
    utc = F.expr(f"timestampadd(MICROSECOND, cast(round({seconds} * 1000000) as bigint), timestamp_ntz'1970-01-01 00:00:00')")
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc)


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each lengthened by underscores until no column has it (case does not tell names apart)."""
    seen, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by their literal names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]
