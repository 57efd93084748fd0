"""Range predicates over keys with inclusive, exclusive or open ends."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """One end: a value, and whether it belongs to the range; None: unbounded."""

    value: Any = None
    inclusive: bool = True


@dataclass(frozen=True)
class KeyRange:
    lower: Bound = Bound()
    upper: Bound = Bound()

    def contains(self, key: Column) -> Column:
        out = F.lit(True)
        if self.lower.value is not None:
            out = out & (key >= F.lit(self.lower.value) if self.lower.inclusive else key > F.lit(self.lower.value))
        if self.upper.value is not None:
            out = out & (key <= F.lit(self.upper.value) if self.upper.inclusive else key < F.lit(self.upper.value))
        return out

    @staticmethod
    def prefix(key: Column, prefix) -> Column:
        """Keys that begin with a string or binary prefix; an empty one takes all."""
        return F.substring(key, 1, len(prefix)) == F.lit(bytes(prefix)) if isinstance(prefix, (bytes, bytearray)) else key.startswith(prefix)
