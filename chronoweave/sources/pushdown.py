"""What pushed filters say of whole-number columns: readers leave out what can't match, Spark still checks each row."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

SETTING = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Bounds:
    """Smallest and largest wanted value of a column (both included, None: open), and the values themselves if listed."""

    low: int | None = None
    high: int | None = None
    listed: set[int] | None = None

    def narrow(self, low: int | None = None, high: int | None = None) -> None:
        self.low = low if self.low is None else self.low if low is None else max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)

    def wants(self, first: int, last: int) -> bool:
        """Whether a value from ``first`` to ``last`` may be wanted."""
        if (self.low is not None and last < self.low) or (self.high is not None and first > self.high):
            return False
        return self.listed is None or any(first <= v <= last for v in self.listed)

    def among(self, values: list[int]) -> list[int]:
        return [v for v in values if self.wants(v, v)]


@dataclass
class Wanted:
    columns: dict[str, Bounds] = field(default_factory=dict)

    def take(self, filters: Iterable[Filter]) -> None:
        """Notes the filters that compare a known column with whole numbers."""
        for f in filters:
            path = getattr(f, "attribute", ())
            bounds = self.columns.get(path[0]) if len(path) == 1 else None
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            whole = bool(values) and all(isinstance(v, int | np.integer) and not isinstance(v, bool) for v in values)
            if bounds is None or not whole:
                continue
            if isinstance(f, EqualTo | In):
                bounds.listed = set(values) if bounds.listed is None else bounds.listed & set(values)
                bounds.narrow(min(values), max(values))
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                bounds.narrow(low=values[0] + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                bounds.narrow(high=values[0] - isinstance(f, LessThan))


def enable(spark: SparkSession) -> None:
    """Readers written in Python only get filters where the session allows it."""
    spark.conf.set(SETTING, "true")
