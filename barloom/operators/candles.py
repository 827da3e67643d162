"""Candlestick flags: +100, -100 (80 for a touching edge) or 0, never NULL.

Average sizes come from the bars before the one judged, so every rule is a
fixed look-back of at most 14 bars.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from barloom.features import Catalog
from barloom.functions import windows as W

# Rule -> (bars averaged, share of the average).
_LONG = ("_body", 10, 1.0)
_SHORT = ("_body", 10, 1.0)
_DOJI = ("_span", 10, 0.1)
_TINY_SHADOW = ("_span", 10, 0.1)
_NEAR = ("_span", 5, 0.2)
_FAR = ("_span", 5, 0.6)
_STAR_DEPTH = 0.3


def _shape(c) -> None:
    c.helper("_body", lambda d: F.abs(d("Close") - d("Open")))
    c.helper("_span", lambda d: d("High") - d("Low"))
    c.helper("_colour", lambda d: F.when(d("Close") >= d("Open"), 1).when(d("Close") < d("Open"), -1))
    c.helper("_upper", lambda d: d("High") - F.greatest(d("Open"), d("Close")))
    c.helper("_lower", lambda d: F.least(d("Open"), d("Close")) - d("Low"))
    c.helper("_top", lambda d: F.greatest(d("Open"), d("Close")))
    c.helper("_bottom", lambda d: F.least(d("Open"), d("Close")))


def _usual(c, rule, back: int = 0):
    """Share of the average size of the bars before bar ``t - back``."""
    column, n, share = rule
    name = f"_usual{column}_{n}"

    def average(d):
        frame = W.preceding(n)
        return F.when(F.count(d(column)).over(frame) == n, F.avg(d(column)).over(frame))

    c.helper(name, average)
    return share * c.lag(name, back)


def _enough(c, bars: int):
    """At least ``bars`` bars came before this one."""
    return c.helper("_earlier_bars", lambda d: F.row_number().over(W.by_symbol()) - 1) >= bars


def register(cat: Catalog) -> None:
    def add(name, lookback, rule):
        """``rule`` gives ``(condition, value)`` pairs; the first that holds wins."""

        def build(c):
            _shape(c)
            pairs = rule(c)
            enough = _enough(c, lookback)
            result = None
            for condition, value in pairs:
                value = F.lit(value) if isinstance(value, int) else value
                hit = enough & condition
                result = F.when(hit, value) if result is None else result.when(hit, value)
            return F.coalesce(result, F.lit(0)).cast("int")

        cat.add("candle", name, build)

    all_of = lambda *parts: reduce(lambda a, b: a & b, parts)
    at = lambda c, name, k: c.lag(name, k)

    def doji(c):
        return c("_body") <= _usual(c, _DOJI)

    add("CDLDOJI", 10, lambda c: [(doji(c), 100)])

    def hammer_shape(c):
        return all_of(
            c("_body") < _usual(c, _SHORT),
            c("_lower") > c("_body"),
            c("_upper") < _usual(c, _TINY_SHADOW),
        )

    add(
        "CDLHAMMER",
        11,
        lambda c: [(hammer_shape(c) & (c("_bottom") <= at(c, "Low", 1) + _usual(c, _NEAR, 1)), 100)],
    )

    def engulfing(c):
        o, k, o1, k1 = c("Open"), c("Close"), at(c, "Open", 1), at(c, "Close", 1)
        up = all_of(c("_colour") == 1, at(c, "_colour", 1) == -1)
        down = all_of(c("_colour") == -1, at(c, "_colour", 1) == 1)
        up &= ((k >= o1) & (o < k1)) | ((k > o1) & (o <= k1))
        down &= ((o >= k1) & (k < o1)) | ((o > k1) & (k <= o1))
        size = F.when((o != k1) & (k != o1), F.lit(100)).otherwise(F.lit(80))
        return [(up, size), (down, -size)]

    add("CDLENGULFING", 2, engulfing)

    def star(c, morning):
        first, last = (-1, 1) if morning else (1, -1)
        gap = (
            at(c, "_top", 1) < at(c, "_bottom", 2) if morning else at(c, "_bottom", 1) > at(c, "_top", 2)
        )
        depth = at(c, "_body", 2) * _STAR_DEPTH
        into = (
            c("Close") > at(c, "Close", 2) + depth if morning else c("Close") < at(c, "Close", 2) - depth
        )
        return all_of(
            at(c, "_body", 2) > _usual(c, _LONG, 2),
            at(c, "_colour", 2) == first,
            at(c, "_body", 1) <= _usual(c, _SHORT, 1),
            gap,
            c("_body") > _usual(c, _SHORT),
            c("_colour") == last,
            into,
        )

    add("CDLMORNINGSTAR", 12, lambda c: [(star(c, True), 100)])
    add("CDLEVENINGSTAR", 12, lambda c: [(star(c, False), -100)])

    def harami(c):
        sizes = all_of(at(c, "_body", 1) > _usual(c, _LONG, 1), c("_body") <= _usual(c, _SHORT))
        inside = (c("_top") < at(c, "_top", 1)) & (c("_bottom") > at(c, "_bottom", 1))
        touching = (c("_top") <= at(c, "_top", 1)) & (c("_bottom") >= at(c, "_bottom", 1))
        return [
            (sizes & inside, -100 * at(c, "_colour", 1)),
            (sizes & touching, -80 * at(c, "_colour", 1)),
        ]

    add("CDLHARAMI", 11, harami)
    add(
        "CDLSHOOTINGSTAR",
        11,
        lambda c: [
            (
                all_of(
                    c("_body") < _usual(c, _SHORT),
                    c("_upper") > c("_body"),
                    c("_lower") < _usual(c, _TINY_SHADOW),
                    c("_bottom") > at(c, "_top", 1),
                ),
                -100,
            )
        ],
    )
    add(
        "CDLMARUBOZU",
        10,
        lambda c: [
            (
                all_of(
                    c("_body") > _usual(c, _LONG),
                    c("_upper") < _usual(c, _TINY_SHADOW),
                    c("_lower") < _usual(c, _TINY_SHADOW),
                ),
                100 * c("_colour"),
            )
        ],
    )

    def soldiers(c):
        bars = [
            all_of(at(c, "_colour", k) == 1, at(c, "_upper", k) < _usual(c, _TINY_SHADOW, k)) for k in range(3)
        ]
        rising = [at(c, "Close", k) > at(c, "Close", k + 1) for k in range(2)]
        opens = [
            all_of(
                at(c, "Open", k) > at(c, "Open", k + 1),
                at(c, "Open", k) <= at(c, "Close", k + 1) + _usual(c, _NEAR, k + 1),
                at(c, "_body", k) > at(c, "_body", k + 1) - _usual(c, _FAR, k + 1),
            )
            for k in range(2)
        ]
        return [(all_of(*bars, *rising, *opens, c("_body") > _usual(c, _SHORT)), 100)]

    add("CDL3WHITESOLDIERS", 12, soldiers)

    def crows(c):
        bars = [
            all_of(at(c, "_colour", k) == -1, at(c, "_lower", k) < _usual(c, _TINY_SHADOW, k)) for k in range(3)
        ]
        opens = [
            all_of(at(c, "Open", k) < at(c, "Open", k + 1), at(c, "Open", k) > at(c, "Close", k + 1))
            for k in range(2)
        ]
        falling = [at(c, "Close", k) < at(c, "Close", k + 1) for k in range(2)]
        before = all_of(at(c, "_colour", 3) == 1, at(c, "High", 3) > at(c, "Close", 2))
        return [(all_of(*bars, *opens, *falling, before), -100)]

    add("CDL3BLACKCROWS", 13, crows)
    add(
        "CDLDRAGONFLYDOJI",
        10,
        lambda c: [
            (all_of(doji(c), c("_upper") < _usual(c, _TINY_SHADOW), c("_lower") > _usual(c, _TINY_SHADOW)), 100)
        ],
    )
    add(
        "CDLGRAVESTONEDOJI",
        10,
        lambda c: [
            (all_of(doji(c), c("_lower") < _usual(c, _TINY_SHADOW), c("_upper") > _usual(c, _TINY_SHADOW)), 100)
        ],
    )
    add(
        "CDLSPINNINGTOP",
        10,
        lambda c: [
            (
                all_of(c("_body") < _usual(c, _SHORT), c("_upper") > c("_body"), c("_lower") > c("_body")),
                100 * c("_colour"),
            )
        ],
    )
    add(
        "CDLHANGINGMAN",
        11,
        lambda c: [(hammer_shape(c) & (c("_bottom") >= at(c, "High", 1) - _usual(c, _NEAR, 1)), -100)],
    )
