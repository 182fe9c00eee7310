"""Metric views: a fact, its lookups, named dimensions and named measures."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from viewgrain.operators.filters import filter_rows
from viewgrain.operators.joins import lookup_join


@dataclass(frozen=True)
class Lookup:
    """A many-to-one table, with the lookup it hangs on if not on the fact itself."""

    table: DataFrame
    keys: Mapping[str, str]
    after: str | None = None


@dataclass(frozen=True)
class Dimension:
    expr: Column
    lookup: str | None = None


@dataclass
class MetricView:
    source: DataFrame
    dimensions: Mapping[str, Dimension]
    measures: Mapping[str, Column]
    lookups: Mapping[str, Lookup] = field(default_factory=dict)
    #: Whether a lookup whose key is not unique is refused; it would multiply measures.
    checked: bool = True

    def rows(self, dims: Iterable[str]) -> DataFrame:
        """The source joined to the lookups that the named dimensions need, and no others."""
        needed: list[str] = []
        for d in dims:
            chain, name = [], self.dimensions[d].lookup
            while name is not None:
                chain.insert(0, name)
                name = self.lookups[name].after
            needed += [n for n in chain if n not in needed]
        rows = self.source
        for name in needed:
            rows = lookup_join(rows, self.lookups[name].table, self.lookups[name].keys, self.checked)
        return rows

    def query(
        self,
        dims: Sequence[str],
        measures: Sequence[str],
        filters: Sequence[tuple[str, object]] = (),
        where: Sequence[Column] = (),
    ) -> DataFrame:
        """Each measure evaluated at the grain of ``dims``.

        ``filters`` are (dimension, function from Column to predicate); ``where`` holds
        predicates on source columns, applied before any join.
        """
        rows = filter_rows(self.source, where)
        view = MetricView(rows, self.dimensions, self.measures, self.lookups, self.checked)
        joined = view.rows([*dims, *[d for d, _ in filters]])
        joined = filter_rows(joined, [keep(self.dimensions[d].expr) for d, keep in filters])
        keys = [self.dimensions[d].expr.alias(d) for d in dims]
        values = [self.measures[m].alias(m) for m in measures]
        return joined.groupBy(*keys).agg(*values) if keys else joined.agg(*values)

    def counter(self, measure: str, where: Sequence[Column] = ()) -> DataFrame:
        return self.query([], [measure], where=where)

