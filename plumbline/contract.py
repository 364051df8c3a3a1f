"""What a table means: plain declarations, held on the driver, never a scan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from .errors import Refused

AGGREGATES = ("sum", "mean", "median", "min", "max", "count", "count_distinct", "none", "ratio", "weighted_mean", "level")
ADDITIVE = ("sum", "count")


def as_date(value) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


@dataclass(frozen=True)
class Measure:
    """A named number and the way it combines across rows.

    ``column`` aliases a source column; ``numerator``/``denominator`` make a ratio of sums (a term
    may start with ``-``); ``compare`` is ``(left, op, right)`` with a column name or a number on
    the right; ``per`` says the value belongs to a unit wider than the row. ``weight`` names the weights of a weighted_mean.
    A ``level`` (a balance, a stock) is the last value of its ``per`` unit over time, and adds up over units.
    """

    name: str
    agg: str | None = None
    column: str | None = None
    numerator: tuple[str, ...] = ()
    denominator: tuple[str, ...] = ()
    scale: float = 1.0
    compare: tuple | None = None
    per: tuple[str, ...] = ()
    unit: str | None = None
    weight: str | None = None

    def __post_init__(self):
        if self.agg is not None and self.agg not in AGGREGATES:
            raise Refused("UNKNOWN_AGGREGATE", f"{self.name} declares agg={self.agg!r}")
        if self.agg == "ratio" and not (self.numerator and self.denominator):
            raise Refused("RATIO_PARTS", f"{self.name} needs a numerator and a denominator")
        if self.agg == "weighted_mean" and not self.weight:
            raise Refused("NO_WEIGHT", f"{self.name} needs a weight")
        if self.agg == "level" and not self.per:
            raise Refused("NO_UNIT", f"{self.name} needs the unit whose level it is")

    @property
    def of_sums(self) -> bool:
        """Whether it is one sum divided by another."""
        return self.agg in ("ratio", "weighted_mean")


@dataclass(frozen=True)
class Window:
    start: dt.date
    end: dt.date

    def __post_init__(self):
        object.__setattr__(self, "start", as_date(self.start))
        object.__setattr__(self, "end", as_date(self.end))
        if self.end < self.start:
            raise Refused("WINDOW", "the window ends before it starts")


@dataclass(frozen=True)
class Exclusion:
    rule: str
    reason: str = ""


@dataclass(frozen=True)
class Expectation:
    rule: str
    name: str = ""


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Contract:
    name: str
    key: tuple[str, ...] = ()
    date_column: str | None = None
    window: Window | None = None
    exclusions: tuple[Exclusion, ...] = ()
    measures: tuple[Measure, ...] = ()
    dimensions: tuple[str, ...] = ()
    domains: dict = field(default_factory=dict)
    missing_values: dict = field(default_factory=dict)
    excluded_columns: tuple[str, ...] = ()
    expectations: tuple[Expectation, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    row_count: int | None = None

    def measure(self, name: str) -> Measure:
        for m in self.measures:
            if m.name == name:
                return m
        raise Refused("UNDECLARED_MEASURE", f"{name} is not a measure of {self.name}")

    def dimension(self, name: str) -> str:
        if name not in self.dimensions:
            raise Refused("UNDECLARED_DIMENSION", f"{name} is not a dimension of {self.name}")
        return name

    def require_date(self) -> str:
        if not self.date_column:
            raise Refused("NO_DATE_COLUMN", f"{self.name} names no date column")
        return self.date_column
