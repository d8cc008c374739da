"""Room names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (room vocabulary).
ALIASES = {
    "out": "Out",
    "outside": "Out",
    "away": "Out",
    "living room": "Living",
    "bed room": "Bedroom",
}
# Searched inside the text, first hit wins.
ROOM_NAMES = ("Bedroom", "Living", "Dining", "Kitchen", "Bathroom", "Toilet", "Office")
# Texts that mean no room.
UNKNOWN_NAMES = ("?", "unknown", "nan", "none", "unmapped")


def normalise_room(value) -> Column:
    """Free-text location to a room name; ``Unknown`` when nothing is said."""
    text = F.regexp_replace((F.col(value) if isinstance(value, str) else value).cast("string"), r"^\s+|\s+$", "")
    low = F.lower(text)
    out = F.when(text.isNull() | (text == ""), F.lit("Unknown"))
    for alias, room in ALIASES.items():
        out = out.when(low == alias, F.lit(room))
    for room in ROOM_NAMES:
        out = out.when(low.contains(room.lower()), F.lit(room))
    out = out.when(low.isin(*UNKNOWN_NAMES), F.lit("Unknown"))
    return out.otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2))))
