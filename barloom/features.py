"""Named feature columns and the projection that adds them to a panel.

A feature is a name, a group and a function that writes its expression. The
expression asks an ``Inputs`` object for every column it reads, so the columns
it depends on are known, and all features of the same depth land in one
``select``. Catalyst then plans one ``Window`` node per depth over a single
shuffle and sort by symbol, and prunes whatever the caller does not keep.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.schema import KEY, TIME

_AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}

# A frame re-reads all its rows for every output row, so its cost grows with its
# length, while looking one row up at a fixed distance is cheap. Long sums and
# extremes are therefore put together from lagged short ones: n -> (size, pieces).
_PIECES = {
    10: (5, 2),
    12: (4, 3),
    14: (7, 2),
    15: (5, 3),
    20: (5, 4),
    21: (7, 3),
    26: (13, 2),
    28: (7, 4),
    30: (5, 6),
    50: (5, 10),
    52: (13, 4),
    55: (5, 11),
    60: (5, 12),
    63: (7, 9),
    100: (50, 2),
    200: (50, 4),
    252: (63, 4),
}


# Finished columns are packed once there are this many of them.
_PACK = 16


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    build: Callable[["Inputs"], Column]


class Inputs:
    """Hands columns to a feature expression and remembers which it read."""

    def __init__(self, helpers: dict[str, Feature]):
        self.needs: set[str] = set()
        self._helpers = helpers

    def __call__(self, name: str) -> Column:
        self.needs.add(name)
        return F.col(name)

    def helper(self, name: str, build: Callable[["Inputs"], Column]) -> Column:
        """A named intermediate column, shared by all features that ask for it."""
        if name not in self._helpers:
            self._helpers[name] = Feature(name, "helper", build)
        return self(name)

    def lag(self, x: str, k: int) -> Column:
        if k == 0:
            return self(x)
        return self.helper(f"_lag_{x}_{k}", lambda c: F.lag(c(x), k).over(W.by_symbol()))

    def back(self, x: str, k: int) -> Column:
        """Like ``lag``, inside the caller's own expression."""
        return F.lag(self(x), k).over(W.by_symbol()) if k else self(x)

    def recent(self, x: str, n: int) -> Column:
        """The newest ``n`` values as an array, newest first."""
        return self.helper(f"_recent_{x}_{n}", lambda c: F.array(*[c.back(x, k) for k in range(n)]))

    def pct(self, x: str, k: int = 1) -> Column:
        return W.pct_change(self(x), k)

    def partial(self, fn: str, x: str, n: int) -> Column:
        """Aggregate over the newest ``n`` rows; meaningful once all are known."""
        if fn == "n":
            return self._known(x, n)
        if fn == "avg":
            return self.partial("sum", x, n) / F.lit(float(n))
        if n in _PIECES:
            size, pieces = _PIECES[n]
            self.partial(fn, x, size)

            def joined(c):
                parts = [c.back(f"_{fn}_{x}_{size}", i * size) for i in range(pieces)]
                if fn == "min":
                    return F.least(*parts)
                if fn == "max":
                    return F.greatest(*parts)
                return reduce(add, parts)

            return self.helper(f"_{fn}_{x}_{n}", joined)
        aggregate = _AGGREGATES[fn]
        return self.helper(f"_{fn}_{x}_{n}", lambda c: aggregate(c(x)).over(W.trailing(n)))

    def _known(self, x: str, n: int) -> Column:
        """How many of the newest ``n`` rows hold a value.

        The difference of two running counts, so it costs the same for any ``n``.
        """
        so_far = f"_known_{x}"
        self.helper(so_far, lambda c: F.count(c(x)).over(W.since_start()))
        return self.helper(
            f"_n_{x}_{n}",
            lambda c: c(so_far) - F.coalesce(F.lag(c(so_far), n).over(W.by_symbol()), F.lit(0)),
        )

    def full(self, fn: str, x: str, n: int) -> Column:
        """Aggregate over ``n`` known values, NULL while fewer are there."""
        return F.when(self._known(x, n) == n, self.partial(fn, x, n))

    def full_sd_price(self, x: str, n: int, sample: bool = False) -> Column:
        """Standard deviation of a series far from zero.

        Deviations of five-row blocks are merged around the common mean, which
        loses no digits when the level is large against the spread.
        """
        size = 5
        blocks = n // size
        self.helper(f"_sqdev_{x}_{size}", lambda c: F.var_pop(c(x)).over(W.trailing(size)) * size)
        self.partial("sum", x, size)
        self.partial("sum", x, n)

        def merged(c):
            mean = c(f"_sum_{x}_{n}") / float(n)
            within = [c.back(f"_sqdev_{x}_{size}", i * size) for i in range(blocks)]
            gaps = [c.back(f"_sum_{x}_{size}", i * size) / size - mean for i in range(blocks)]
            return reduce(add, within) + size * reduce(add, [g * g for g in gaps])

        total = self.helper(f"_sqdev_{x}_{n}", merged) if blocks > 1 else self(f"_sqdev_{x}_{size}")
        return F.when(self._known(x, n) == n, F.sqrt(total / (n - 1 if sample else n)))

    # Moments of return-like series (mean small against the spread) come from
    # sliding power sums: several statistics share them, and a plain sum is the
    # cheapest thing a frame can hold. Prices use merged blocks.

    def _power_sum(self, factors: tuple[str, ...], n: int) -> Column:
        if len(factors) == 1:
            return self.partial("sum", factors[0], n)
        name = "_x_" + "_".join(factors)

        def product(c):
            value = c(factors[0])
            for f in factors[1:]:
                value = value * c(f)
            return value

        self.helper(name, product)
        return self.partial("sum", name, n)

    def _variation(self, x: str, n: int) -> Column:
        """Sum of squared deviations, exactly 0 when only rounding is left."""
        squares = self._power_sum((x, x), n)
        value = squares - self._power_sum((x,), n) * self._power_sum((x,), n) / n
        return F.when(value <= squares * 1e-14, F.lit(0.0)).otherwise(value)

    def full_var(self, x: str, n: int) -> Column:
        return F.when(self._known(x, n) == n, self._variation(x, n) / (n - 1))

    def full_sd(self, x: str, n: int) -> Column:
        return F.sqrt(self.full_var(x, n))

    def full_skew(self, x: str, n: int) -> Column:
        """Bias-corrected skewness; 0 for a window that does not vary."""
        mean = self._power_sum((x,), n) / n
        m2 = self._variation(x, n) / n
        m3 = self._power_sum((x, x, x), n) / n - 3 * mean * self._power_sum((x, x), n) / n + 2 * mean * mean * mean
        factor = math.sqrt(n * (n - 1)) / (n - 2)
        value = F.when(m2 == 0, F.lit(0.0)).otherwise(factor * W.ratio(m3, m2 * F.sqrt(m2)))
        return F.when(self._known(x, n) == n, value)

    def _both(self, x: str, y: str, n: int) -> Column:
        name = f"_both_{x}_{y}"
        self.helper(name, lambda c: F.when(c(x).isNotNull() & c(y).isNotNull(), F.lit(1)))
        return self._known(name, n) == n

    def full_cov(self, x: str, y: str, n: int) -> Column:
        products = self._power_sum((x, y), n)
        crossed = products - self._power_sum((x,), n) * self._power_sum((y,), n) / n
        return F.when(self._both(x, y, n), crossed / (n - 1))

    def full_corr(self, x: str, y: str, n: int) -> Column:
        """Pearson correlation; NULL when either side does not vary."""
        spread = F.sqrt(self._variation(x, n)) * F.sqrt(self._variation(y, n)) / (n - 1)
        return W.ratio(self.full_cov(x, y, n), spread)


class Catalog:
    """All features by name, in declaration order."""

    def __init__(self):
        self._features: dict[str, Feature] = {}
        self._helpers: dict[str, Feature] = {}
        self._reads: dict[str, frozenset[str]] = {}
        self._built: dict[str, Column] = {}

    def add(self, group: str, name: str, build: Callable[[Inputs], Column]) -> None:
        self._features[name] = Feature(name, group, build)

    def group(self, *groups: str) -> list[str]:
        return [f.name for f in self._features.values() if f.group in groups]

    def groups(self) -> list[str]:
        return list(dict.fromkeys(f.group for f in self._features.values()))

    def expression(self, name: str) -> Column | None:
        """The named column's expression; None for a plain input column."""
        feature = self._features.get(name) or self._helpers.get(name)
        if feature is None:
            return None
        if name not in self._built:
            inputs = Inputs(self._helpers)
            self._built[name] = feature.build(inputs).alias(name)
            self._reads[name] = frozenset(inputs.needs)
        return self._built[name]

    def reads(self, name: str) -> frozenset[str]:
        """Columns the named one is written in; empty for an input column."""
        if name not in self._reads:
            self.expression(name)
        return self._reads.get(name, frozenset())

    def closure(self, names: Iterable[str]) -> set[str]:
        """The named columns and all they read, directly or not."""
        seen: set[str] = set()
        waiting = list(names)
        while waiting:
            name = waiting.pop()
            if name not in seen:
                seen.add(name)
                waiting.extend(self.reads(name))
        return seen

    def __contains__(self, name: str) -> bool:
        return name in self._features

    def __getitem__(self, name: str) -> Feature:
        return self._features[name]


def add_features(df: DataFrame, names: Iterable[str], catalog: Catalog) -> DataFrame:
    """``df`` plus the named features, helpers removed."""
    names = [n for n in dict.fromkeys(names) if n not in df.columns]
    given = list(df.columns)
    depth: dict[str, int] = dict.fromkeys(given, 0)
    layers: dict[int, list[str]] = {}

    def place(name: str) -> int:
        if name not in depth:
            if catalog.expression(name) is None:
                raise KeyError(f"no column or feature named {name!r}")
            depth[name] = 1 + max((place(n) for n in sorted(catalog.reads(name))), default=0)
            layers.setdefault(depth[name], []).append(name)
        return depth[name]

    for name in names:
        place(name)

    later: dict[int, set[str]] = {}
    pending: set[str] = set()
    for level in sorted(layers, reverse=True):
        later[level] = set(pending)
        for n in layers[level]:
            pending |= catalog.reads(n)

    wanted = set(given) | set(names)
    live, packed = list(given), {}
    for level in sorted(layers):
        df = df.select(*live, *packed, *[catalog.expression(n) for n in layers[level]])
        live += layers[level]
        done = [n for n in live if n in wanted and n not in later[level] and n not in (KEY, TIME)]
        live = [n for n in live if n in wanted or n in later[level]]
        if len(done) >= _PACK and level != max(layers):
            # a finished column costs a field copy at every further depth; a
            # struct of them is one block of bytes
            name = f"_done_{level}"
            live = [n for n in live if n not in set(done)]
            df = df.select(*live, *packed, F.struct(*done).alias(name))
            packed[name] = done
    place_of = {n: F.col(pack)[n].alias(n) for pack, fields in packed.items() for n in fields}
    return df.select(*[place_of.get(n, F.col(n)) for n in given + names])
