"""Column functions on white space and keys, alike in Java regular expressions and in the SQL checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points with the Unicode property White_Space, plus the byte order mark and the zero width space.
SPACE_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
EDGES = f"^{SPACE_CLASS}+|{SPACE_CLASS}+$"


def strip_space(c: Column) -> Column:
    """Removes surrounding white space of any kind."""
    return F.regexp_replace(c, EDGES, "")


def one_space(c: Column) -> Column:
    """Removes surrounding white space and makes each inner run of it one blank."""
    return F.regexp_replace(strip_space(c), f"{SPACE_CLASS}+", " ")


def fold_key(c: Column) -> Column:
    """An id reduced to what decides equality: no surrounding white space, lower case; null if nothing is left."""
    key = F.lower(strip_space(c))
    return F.when(key != "", key)
