"""Which season a caller means, and what the warehouse states about it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.plans.warehouse import COMPETITIONS, VALUE_SINCE, Warehouse, coverage, match_inventory

# Seasons of one year that need a key of their own, by competition code and year.
KEYED = {("AFLW", "2022"): ("2022-S6", "2022-S7")}


@dataclass
class SeasonError(ValueError):
    """A season that cannot be told: code is AMBIGUOUS_SEASON, INVALID_SEASON or SEASON_NOT_FOUND."""

    code: str
    message: str
    selectors: tuple[str, ...] = field(default=())

    def __str__(self) -> str:
        return self.message


def season_key(competition: str, selector: int | str) -> str:
    """The key of a season by its year or key."""
    key = str(selector)
    if competition not in COMPETITIONS.values():
        raise SeasonError("INVALID_SEASON", f"No competition {competition!r}; there are {', '.join(COMPETITIONS.values())}")
    if choices := KEYED.get((competition, key)):
        raise SeasonError("AMBIGUOUS_SEASON", f"{competition} {key} may be any of {', '.join(choices)}", choices)
    if not re.fullmatch(r"\d{4}", key) and key not in {k for (c, _), keys in KEYED.items() if c == competition for k in keys}:
        raise SeasonError("INVALID_SEASON", f"{key!r} selects no {competition} season")
    return key


def season_id(w: Warehouse, competition: str, selector: int | str) -> int:
    """The id of the one stored season that a competition and selector mean."""
    key = season_key(competition, selector)
    number = next(k for k, v in COMPETITIONS.items() if v == competition)
    wanted = number * 10000 + int(key[:4])
    if w.table("matches").where(F.col("season_id") == wanted).isEmpty():
        raise SeasonError("SEASON_NOT_FOUND", f"No {competition} season {key} is stored")
    return wanted


def check_valued(competition: str, selector: int | str) -> None:
    """Raises unless player values exist for the season at all."""
    key = season_key(competition, selector)
    number = next(k for k, v in COMPETITIONS.items() if v == competition)
    since = VALUE_SINCE.get(number)
    if since is None or int(key[:4]) < since:
        raise SeasonError("INVALID_SEASON", f"Player values are not known for {competition} {key}" + (f"; they begin in {since}" if since else ""))


def describe(w: Warehouse, competition: str | None = None, season: int | str | None = None, observed: bool = False) -> dict[str, DataFrame | list]:
    """The tables with their columns, and with ``observed`` the measured coverage: of everything, of one
    competition's season, or of all of them. A season needs its competition, and the other way round;
    both need ``observed``. Any other call is refused before anything is read."""
    if (competition is None) != (season is None):
        raise ValueError("competition and season go together")
    if competition is not None and not observed:
        raise ValueError("a season is described by what is observed: pass observed=True")
    if competition is not None:
        wanted = season_id(w, competition, season)
        only = (F.col("code") == competition) & (F.col("year") == wanted % 10000)
    else:
        only = F.lit(True)
    out: dict[str, DataFrame | list] = {"tables": [(t, c, k) for t in ("matches", "players", "player_match_stats", "match_lineups", "match_weather", "venues", "teams") for c, k in w.table(t).dtypes]}
    if observed:
        out |= {"coverage": coverage(w).where(only), "inventory": match_inventory(w).where(only)}
    return out
