"""Zone transition tables, versioned by the release of the IANA time zone database."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache

import numpy as np

#: Offsets of the zone abbreviations that name one offset only, in minutes east of UTC.
ABBREVIATIONS = {
    "utc": 0,
    "gmt": 0,
    "z": 0,
    "awst": 480,
    "acwst": 525,
    "acst": 570,
    "acdt": 630,
    "aest": 600,
    "aedt": 660,
    "nzst": 720,
    "nzdt": 780,
}

FIRST_YEAR, LAST_YEAR = 1900, 2100


def tz_version() -> str:
    """Release of the time zone database on this machine, or ``unknown``."""
    for root in zoneinfo.TZPATH:
        try:
            with open(f"{root}/tzdata.zi") as f:
                return f.readline().strip().removeprefix("# version ")
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1)
def _names() -> dict[str, str]:
    return {n.lower(): n for n in sorted(zoneinfo.available_timezones())}


@lru_cache(maxsize=4096)
def zone_name(text: str | None) -> str | None:
    """The IANA name meant by ``text``, whatever its letter case and outer blanks; None if there is none."""
    return _names().get(text.strip().lower()) if text else None


@lru_cache(maxsize=1024)
def transitions(zone: str, version: str) -> tuple[np.ndarray, np.ndarray]:
    """(instants of change, offsets): offsets[k] seconds hold from instants[k - 1] up to instants[k].

    Raises if this machine has another release than ``version``, so that no row is converted by
    another table than its neighbours on other executors.
    """
    if version != tz_version():
        raise RuntimeError(f"time zone tables of {tz_version()}, not of {version}")
    info = zoneinfo.ZoneInfo(zone)

    def at(t: int) -> int:
        moment = dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=t)
        return int(moment.astimezone(info).utcoffset().total_seconds())

    start = int(dt.datetime(FIRST_YEAR, 1, 2, tzinfo=dt.UTC).timestamp())
    end = int(dt.datetime(LAST_YEAR, 1, 2, tzinfo=dt.UTC).timestamp())
    # no zone has changed twice within two days
    step = 2 * 86400
    cuts, offsets, t, now = [], [at(start)], start, at(start)
    while t < end:
        if at(t + step) != now:
            low, high = t, t + step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if at(middle) == now else (low, middle)
            cuts.append(high)
            now = at(high)
            offsets.append(now)
            t = high
        else:
            t += step
    return np.array(cuts, dtype=np.int64), np.array(offsets, dtype=np.int64)


def wall_to_epoch(wall_s: np.ndarray, zone: str, version: str) -> tuple[np.ndarray, np.ndarray]:
    """(epoch seconds, number of instants that show this wall time: 0, 1 or 2). The seconds hold
    only where the number is 1."""
    cuts, offsets = transitions(zone, version)

    def at(t: np.ndarray) -> np.ndarray:
        return offsets[np.searchsorted(cuts, t, side="right")]

    early, late = at(wall_s - 86400), at(wall_s + 86400)
    fits_early, fits_late = at(wall_s - early) == early, at(wall_s - late) == late
    count = fits_early.astype(np.int8) + (fits_late & (late != early)).astype(np.int8)
    return np.where(fits_early, wall_s - early, wall_s - late), count
