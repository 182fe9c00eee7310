"""Typed parameters with a checked domain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parameter:
    """A scalar a view depends on; ``allowed`` lists its values, or a range bounds them."""

    name: str
    default: Any = None
    allowed: Sequence[Any] | None = None
    low: Any = None
    high: Any = None
    step: float | None = None

    def check(self, value: Any) -> Any:
        if self.allowed is not None and value not in self.allowed:
            raise ValueError(f"{self.name}: {value!r} is not one of the allowed values")
        if self.low is not None and value < self.low:
            raise ValueError(f"{self.name}: {value!r} is below {self.low!r}")
        if self.high is not None and value > self.high:
            raise ValueError(f"{self.name}: {value!r} is above {self.high!r}")
        if self.step is not None:
            steps = (value - (self.low or 0)) / self.step
            if abs(steps - round(steps)) > 1e-9:
                raise ValueError(f"{self.name}: {value!r} is not on a step of {self.step!r}")
        return value

    def column(self, value: Any = None) -> Column:
        return F.lit(self.check(self.default if value is None else value))


def arguments(parameters: Sequence[Parameter], values: dict[str, Any]) -> dict[str, Any]:
    """Named arguments for ``custom_query``: given values, else defaults, all checked."""
    return {p.name: p.check(values.get(p.name, p.default)) for p in parameters}
