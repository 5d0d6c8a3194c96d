"""Names of teams and venues as providers spell them, placeholders, and bounded error texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provider spellings and the names they stand for.
TEAM_NAMES = {
    "Greater Western Sydney": "GWS Giants", "GWS": "GWS Giants", "GWS GIANTS": "GWS Giants", "Brisbane Bears": "Brisbane Lions", "Brisbane": "Brisbane Lions", "Footscray": "Western Bulldogs", "Sydney Swans": "Sydney", "Geelong Cats": "Geelong",
    "Adelaide Crows": "Adelaide", "West Coast Eagles": "West Coast", "Gold Coast SUNS": "Gold Coast", "Gold Coast Suns": "Gold Coast", "Kuwarna": "Adelaide", "Walyalup": "Fremantle", "Narrm": "Melbourne", "Yartapuulti": "Port Adelaide", "Euro-Yroke": "St Kilda", "Waalitj Marawar": "West Coast",
}
# Provider spellings of venues.
VENUE_NAMES = {
    "Windsor Park Oval": "Windsor Park", "M.C.G.": "MCG", "S.C.G.": "SCG", "Docklands": "Marvel Stadium", "Etihad Stadium": "Marvel Stadium", "GMHBA Stadium": "Kardinia Park", "Corroboree Group Oval Manuka": "Manuka Oval", "Bellerive Oval": "Blundstone Arena",
    "ENGIE Stadium": "Sydney Showground", "GIANTS Stadium": "Sydney Showground", "Stadium Australia": "Accor Stadium", "ANZ Stadium": "Accor Stadium", "Cazaly's Stadium": "Cazalys Stadium", "Marrara Oval": "TIO Stadium", "TIO Traeger Park": "Traeger Park", "Ikon Park": "Princes Park",
    "Eureka Stadium": "Mars Stadium", "People First Stadium": "Carrara", "Heritage Bank Stadium": "Carrara", "Metricon Stadium": "Carrara", "Optus Stadium": "Perth Stadium", "The Gabba": "Gabba", "York Park": "UTAS Stadium", "University of Tasmania Stadium": "UTAS Stadium",
}
# Team names that stand for an undecided fixture.
PLACEHOLDERS = (r"^\d{1,2}(st|nd|rd|th)$", r"^(winner|loser) of\b", r"-ranked\b.*\b(winner|loser)$", r"^(tbc|tba|to be confirmed)$")


def _mapped(name: Column, names: dict[str, str]) -> Column:
    trimmed = F.trim(name)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[trimmed], trimmed)


def team_name(name: Column, competition: Column | None = None, season: Column | None = None) -> Column:
    """The canonical team name; a club of the AFLM up to 1996 keeps its name of then."""
    mapped = _mapped(name, TEAM_NAMES)
    if competition is None or season is None:
        return mapped
    then = (competition == "AFLM") & (season <= 1996) & F.trim(name).isin("Brisbane Bears", "Brisbane Lions", "Brisbane")
    return F.when(then, F.lit("Brisbane Bears")).otherwise(mapped)


def venue_name(name: Column) -> Column:
    return _mapped(name, VENUE_NAMES)


def is_placeholder(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(f"(?:{p})" for p in PLACEHOLDERS))


def error_text(text: Column, most: int = 500) -> Column:
    """The first line, without the query part of any address, of at most ``most`` characters."""
    return F.substring(F.regexp_replace(F.substring_index(text, "\n", 1), r"(https?://[^\s?]+)\?\S*", "$1"), 1, most)
