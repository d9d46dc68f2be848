"""White space as the Unicode property White_Space, written out because Java's ``\\s`` is ASCII only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the property White_Space.
WHITE_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WHITE_SPACE}]"
NOT_WS = f"[^{WHITE_SPACE}]"


def collapse_spaces(text: Column) -> Column:
    """Each run of white space becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def trim_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")
