"""String expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(text: str) -> str:
    """A regular expression that matches the text itself."""
    return "".join(c if c.isalnum() or c.isspace() or ord(c) > 127 or c == "_" else "\\" + c for c in text)


def take_parts(text: Column, positions: Sequence[int], separator: str = "_") -> Column:
    """Split on the separator and join the chosen parts with it again.

    A missing part makes the result null, so malformed keys can be counted.
    """
    parts = F.split(text, _literal(separator))
    chosen = [F.get(parts, F.lit(p)) for p in positions]
    return reduce(lambda a, b: F.concat(a, F.lit(separator), b), chosen)


def strip_prefix(text: Column, prefix: str) -> Column:
    """Remove a leading prefix once."""
    return F.regexp_replace(text, "^" + _literal(prefix), "")


def join_text(*parts: Column | str) -> Column:
    """Concatenate; null if any part is null. Plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
