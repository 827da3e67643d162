"""Return, moving-average, oscillator, channel, volume and volatility features.

Everything here has a fixed look-back (or is a plain running sum) and is a
built-in window expression.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.features import Catalog
from barloom.functions import windows as W
from barloom.schema import ANNUAL_DAYS, HORIZONS

_YEAR = math.sqrt(ANNUAL_DAYS)


def register(cat: Catalog) -> None:
    _returns(cat)
    _targets(cat)
    _averages(cat)
    _oscillators(cat)
    _channels(cat)
    _volume(cat)
    _volatility(cat)
    _trend(cat)
    _lags(cat)
    _statistics(cat)


def _previous(c, x):
    """Last known value before this row."""
    return W.padded(c(x), 1)


def _returns(cat):
    cat.add("returns", "Return", lambda c: c.pct("Close"))
    cat.add("returns", "Log_Return", lambda c: F.ln(W.ratio(c("Close"), F.lag(c("Close"), 1).over(W.by_symbol()))))
    cat.add("returns", "Volume_Change", lambda c: c.pct("Volume"))
    cat.add("returns", "Price_Range", lambda c: c("High") - c("Low"))
    cat.add("returns", "Price_Range_Pct", lambda c: W.ratio(c("High") - c("Low"), c("Open")))


def forward_return(c, h):
    """Relative change of the close over the next ``h`` bars."""
    ahead = F.lead(F.lit(1), h).over(W.by_symbol())
    later = F.last(c("Close"), ignorenulls=True).over(W.since_start(h))
    return F.when(ahead.isNotNull(), W.ratio(later, W.padded(c("Close"))) - 1)


def _targets(cat):
    for h in HORIZONS:
        cat.add("targets", f"Target_Return_{h}d", lambda c, h=h: forward_return(c, h))
        cat.add("targets", f"Target_Direction_{h}d", lambda c, h=h: W.flag(c(f"Target_Return_{h}d") > 0))
    cat.add("targets", "Target_Next_Day_Return", lambda c: c("Target_Return_1d"))
    cat.add("targets", "Target_Next_Day_Direction", lambda c: c("Target_Direction_1d"))


def _averages(cat):
    for w in (5, 10, 20, 50, 100, 200):
        cat.add("moving_average", f"MA_{w}", lambda c, w=w: c.full("avg", "Close", w))
        cat.add("moving_average", f"Close_to_MA_{w}", lambda c, w=w: W.ratio(c("Close"), c(f"MA_{w}")) - 1)
        cat.add("moving_average", f"MA_{w}_Slope", lambda c, w=w: c.pct(f"MA_{w}", 5))

    def weighted(c):
        newest = 20
        total = c("Close") * float(newest)
        for k in range(1, newest):
            total = total + F.lag(c("Close"), k).over(W.by_symbol()) * float(newest - k)
        return total / float(newest * (newest + 1) // 2)

    cat.add("moving_average", "WMA_20", weighted)


def _range_position(c, n):
    """Close within the high-low range of ``n`` bars, 0..100; 0 for a flat range."""
    high, low = c.full("max", "High", n), c.full("min", "Low", n)
    return F.when(high == low, F.lit(0.0)).otherwise(100 * W.ratio(c("Close") - low, high - low))


def _oscillators(cat):
    add = lambda name, build: cat.add("oscillator", name, build)

    raw_k = lambda c: c.helper("_stoch", lambda d: _range_position(d, 5))

    def slow_k(c):
        raw_k(c)
        return c.helper("_slow_k", lambda d: d.full("avg", "_stoch", 3))

    def slow_d(c):
        slow_k(c)
        return c.full("avg", "_slow_k", 3)

    add("Stochastic_D", slow_d)
    add("Stochastic_K", lambda c: F.when(c("Stochastic_D").isNotNull(), slow_k(c)))
    add("Stochastic_KD", lambda c: c("Stochastic_K") - c("Stochastic_D"))

    def fast_d(c):
        raw_k(c)
        return c.full("avg", "_stoch", 3)

    add("StochF_D", fast_d)
    add("StochF_K", lambda c: F.when(c("StochF_D").isNotNull(), raw_k(c)))

    def typical(c):
        return c.helper("_typical", lambda d: (d("High") + d("Low") + d("Close")) / 3)

    def cci(c):
        typical(c)
        mean = c.full("avg", "_typical", 14)
        gap = c("_typical") - mean
        spread = F.abs(gap)
        for k in range(1, 14):
            spread = spread + F.abs(c.lag("_typical", k) - mean)
        return F.when((gap == 0) | (spread == 0), F.lit(0.0)).otherwise(gap / (0.015 * (spread / 14)))

    add("CCI", cci)

    def williams(c):
        high, low = c.full("max", "High", 14), c.full("min", "Low", 14)
        return F.when(high == low, F.lit(0.0)).otherwise(-100 * W.ratio(high - c("Close"), high - low))

    add("Williams_R", williams)
    add("MOM_10", lambda c: c("Close") - c.lag("Close", 10))
    for k in (10, 20):
        add(
            f"ROC_{k}",
            lambda c, k=k: F.when(c.lag("Close", k) == 0, F.lit(0.0)).otherwise(
                100 * (W.ratio(c("Close"), c.lag("Close", k)) - 1)
            ),
        )
    add("DPO_20", lambda c: c("Close") - c.lag("Close", 11))

    def fast_minus_slow(c):
        return c.full("avg", "Close", 12) - c.full("avg", "Close", 26)

    def ppo(c):
        slow = c.full("avg", "Close", 26)
        return F.when(slow == 0, F.lit(0.0)).otherwise(100 * W.ratio(fast_minus_slow(c), slow))

    add("PPO", ppo)
    add("APO", fast_minus_slow)

    def aroon(column, extreme):
        # the first hit in a newest-first array is the most recent one
        def build(c):
            best = c.full(extreme, column, 15)
            since = F.array_position(c.recent(column, 15), best) - 1
            return 100.0 * (14 - since) / 14

        return build

    add("Aroon_Up", aroon("High", "max"))
    add("Aroon_Down", aroon("Low", "min"))
    add("Aroon_Osc", lambda c: c("Aroon_Up") - c("Aroon_Down"))

    def pressure(c):
        def floor(d):
            before = _previous(d, "Close")
            return F.when(before.isNotNull() & d("Low").isNotNull(), F.least(d("Low"), before))

        def top(d):
            before = _previous(d, "Close")
            return F.when(before.isNotNull() & d("High").isNotNull(), F.greatest(d("High"), before))

        c.helper("_true_low", floor)
        c.helper("_true_high", top)
        c.helper("_buying", lambda d: d("Close") - d("_true_low"))
        c.helper("_true_range", lambda d: d("_true_high") - d("_true_low"))

    def ultimate(c):
        pressure(c)
        parts = None
        for weight, n in ((4, 7), (2, 14), (1, 28)):
            share = W.ratio(c.partial("sum", "_buying", n), c.partial("sum", "_true_range", n))
            part = weight * F.coalesce(share, F.lit(0.0))
            parts = part if parts is None else parts + part
        c.helper("_both_moves", lambda d: F.when((d("_buying") + d("_true_range")).isNotNull(), F.lit(1)))
        return F.when(c.partial("n", "_both_moves", 28) == 28, 100 * parts / 7)

    add("ULTOSC", ultimate)

    for n in (10, 20):

        def fisher(c, n=n):
            high, low = c.full("max", "High", n), c.full("min", "Low", n)
            v = W.bounded(2 * W.ratio(c("Close") - low, high - low) - 1, -0.999, 0.999)
            return 0.5 * F.ln((1 + v) / (1 - v))

        add(f"Fisher_{n}", fisher)


def _channels(cat):
    add = lambda name, build: cat.add("channel", name, build)
    for w in (5, 20):
        add(f"BB_Middle_{w}", lambda c, w=w: c.full("avg", "Close", w))
        add(f"BB_Upper_{w}", lambda c, w=w: c.full("avg", "Close", w) + 2 * c.full_sd_price("Close", w))
        add(f"BB_Lower_{w}", lambda c, w=w: c.full("avg", "Close", w) - 2 * c.full_sd_price("Close", w))
        add(
            f"BB_Width_{w}",
            lambda c, w=w: W.ratio(c(f"BB_Upper_{w}") - c(f"BB_Lower_{w}"), c(f"BB_Middle_{w}")),
        )
        add(
            f"BB_Position_{w}",
            lambda c, w=w: W.ratio(c("Close") - c(f"BB_Lower_{w}"), c(f"BB_Upper_{w}") - c(f"BB_Lower_{w}")),
        )

    def middle(n):
        return lambda c: (c.full("max", "High", n) + c.full("min", "Low", n)) / 2

    add("Ichimoku_Tenkan", middle(9))
    add("Ichimoku_Kijun", middle(26))
    add(
        "Ichimoku_SpanA",
        lambda c: F.lag((c("Ichimoku_Tenkan") + c("Ichimoku_Kijun")) / 2, 26).over(W.by_symbol()),
    )

    def span_b(c):
        c.helper("_middle_52", middle(52))
        return c.lag("_middle_52", 26)

    add("Ichimoku_SpanB", span_b)
    add("Ichimoku_Chikou", lambda c: c.lag("Close", 26))
    add("Above_Cloud", lambda c: W.flag(c("Close") > F.greatest(c("Ichimoku_SpanA"), c("Ichimoku_SpanB"))))
    add("Cloud_Width", lambda c: F.abs(c("Ichimoku_SpanA") - c("Ichimoku_SpanB")))
    add("TK_Cross", lambda c: W.flag(c("Ichimoku_Tenkan") > c("Ichimoku_Kijun"), otherwise=-1))

    def vwap(c):
        c.helper("_typical", lambda d: (d("High") + d("Low") + d("Close")) / 3)
        c.helper("_typical_volume", lambda d: d("_typical") * d("Volume"))
        return W.ratio(c.full("sum", "_typical_volume", 20), c.full("sum", "Volume", 20))

    add("VWAP", vwap)
    add("Price_to_VWAP", lambda c: W.ratio(c("Close"), c("VWAP")) - 1)

    for w in (20, 55):
        add(f"Donchian_High_{w}", lambda c, w=w: c.full("max", "High", w))
        add(f"Donchian_Low_{w}", lambda c, w=w: c.full("min", "Low", w))
        add(f"Donchian_Mid_{w}", lambda c, w=w: (c(f"Donchian_High_{w}") + c(f"Donchian_Low_{w}")) / 2)
        add(
            f"Donchian_Pos_{w}",
            lambda c, w=w: W.ratio(
                c("Close") - c(f"Donchian_Low_{w}"), c(f"Donchian_High_{w}") - c(f"Donchian_Low_{w}")
            ),
        )


def _volume(cat):
    add = lambda name, build: cat.add("volume", name, build)

    def signed_volume(c):
        before = _previous(c, "Close")
        known = c("Close").isNotNull() & c("Volume").isNotNull()
        return F.when(
            known,
            F.when(before.isNull() | (c("Close") > before), c("Volume"))
            .when(c("Close") < before, -c("Volume"))
            .otherwise(F.lit(0.0)),
        )

    def obv(c):
        flow = c.helper("_signed_volume", signed_volume)
        return F.when(flow.isNotNull(), F.sum(flow).over(W.since_start()))

    add("OBV", obv)
    add("OBV_Change", lambda c: c.pct("OBV"))

    def money_flow(c):
        c.helper("_typical", lambda d: (d("High") + d("Low") + d("Close")) / 3)
        c.helper("_typical_before", lambda d: _previous(d, "_typical"))

        def part(rises):
            def build(d):
                now, before = d("_typical"), d("_typical_before")
                hit = now > before if rises else now < before
                flow = F.when(hit, now * d("Volume")).otherwise(F.lit(0.0))
                return F.when((now * d("Volume") * before).isNotNull(), flow)

            return build

        c.helper("_flow_in", part(True))
        c.helper("_flow_out", part(False))
        gain, loss = c.full("sum", "_flow_in", 14), c.full("sum", "_flow_out", 14)
        return F.when(gain + loss < 1, F.lit(0.0)).otherwise(100 * W.ratio(gain, gain + loss))

    add("MFI_14", money_flow)

    def multiplier(d):
        span = d("High") - d("Low")
        return W.ratio((d("Close") - d("Low")) - (d("High") - d("Close")), span)

    def accumulation(c):
        def step(d):
            rises = d("High") > d("Low")
            known = (d("High") + d("Low") + d("Close") + d("Volume")).isNotNull()
            return F.when(known, F.when(rises, multiplier(d) * d("Volume")).otherwise(F.lit(0.0)))

        moved = c.helper("_accumulated", step)
        return F.when(moved.isNotNull(), F.sum(moved).over(W.since_start()))

    add("AD", accumulation)

    def chaikin(c):
        c.helper("_money_flow_volume", lambda d: multiplier(d) * d("Volume"))
        return W.ratio(c.full("sum", "_money_flow_volume", 20), c.full("sum", "Volume", 20))

    add("CMF_20", chaikin)
    add("Volume_Ratio_20", lambda c: W.ratio(c("Volume"), c.full("avg", "Volume", 20)))
    add("Volume_Surge", lambda c: W.flag(c("Volume_Ratio_20") > 2.0))


def _volatility(cat):
    add = lambda name, build: cat.add("volatility", name, build)
    for w in (5, 10, 20, 30, 60):
        add(f"Volatility_{w}", lambda c, w=w: c.full_sd("Log_Return", w) * _YEAR)

    def parkinson(c):
        c.helper("_log_range", lambda d: F.ln(W.ratio(d("High"), d("Low"))))
        c.helper("_log_range_sq", lambda d: d("_log_range") * d("_log_range"))
        return F.sqrt(c.full("avg", "_log_range_sq", 20) / (4 * math.log(2))) * _YEAR

    add("Parkinson_Vol_20", parkinson)

    def yang_zhang(c):
        n = 20
        k = 0.34 / (1.34 + (n + 1) / (n - 1))

        def within(d):
            up = F.ln(W.ratio(d("High"), d("Open")))
            down = F.ln(W.ratio(d("Low"), d("Open")))
            end = F.ln(W.ratio(d("Close"), d("Open")))
            return up * (up - end) + down * (down - end)

        c.helper("_rogers_satchell", within)
        c.helper("_log_open_close", lambda d: F.ln(W.ratio(d("Close"), d("Open"))))
        c.helper(
            "_log_overnight",
            lambda d: F.ln(W.ratio(d("Open"), F.lag(d("Close"), 1).over(W.by_symbol()))),
        )
        total = (
            c.full_var("_log_overnight", n)
            + k * c.full_var("_log_open_close", n)
            + (1 - k) * c.full("avg", "_rogers_satchell", n)
        )
        return F.sqrt(F.when(total < 0, F.lit(0.0)).otherwise(total)) * _YEAR

    add("YZ_Volatility_20", yang_zhang)
    add("Vol_Regime", lambda c: W.flag(c("Volatility_20") > c.full("avg", "Volatility_20", 60)))


def _trend(cat):
    add = lambda name, build: cat.add("trend", name, build)
    add("Bull_Market", lambda c: W.flag(c("Close") > c("MA_200")))
    add("Market_Momentum", lambda c: W.flag(c.full("sum", "Return", 10) > 0))
    add("Price_52w_High", lambda c: W.ratio(c("Close"), c.full("max", "High", 252)) - 1)
    add("Price_52w_Low", lambda c: W.ratio(c("Close"), c.full("min", "Low", 252)) - 1)
    cat.add("gap", "Gap_Up", lambda c: W.flag(c("Open") > c.lag("Close", 1)))
    cat.add("gap", "Gap_Down", lambda c: W.flag(c("Open") < c.lag("Close", 1)))
    cat.add("gap", "Gap_Size", lambda c: W.ratio(c("Open"), c.lag("Close", 1)) - 1)


def _lags(cat):
    for x in ("Return", "Log_Return", "Volume_Change"):
        for k in (1, 2, 3, 5, 10, 21, 63):
            cat.add("lag", f"{x}_Lag_{k}", lambda c, x=x, k=k: c.lag(x, k))


def _statistics(cat):
    add = lambda name, build: cat.add("statistics", name, build)

    for w in (5, 10, 21, 63):
        add(f"Return_Mean_{w}", lambda c, w=w: c.full("avg", "Return", w))
        add(f"Return_Std_{w}", lambda c, w=w: c.full_sd("Return", w))
        add(f"Return_Min_{w}", lambda c, w=w: c.full("min", "Return", w))
        add(f"Return_Max_{w}", lambda c, w=w: c.full("max", "Return", w))
        add(f"Return_Skew_{w}", lambda c, w=w: c.full_skew("Return", w))
        add(f"PV_Corr_{w}", lambda c, w=w: c.full_corr("Return", "Volume_Change", w))
    for w in (20, 60):
        add(
            f"Price_ZScore_{w}",
            lambda c, w=w: W.ratio(
                c("Close") - c.full("avg", "Close", w), c.full_sd_price("Close", w, sample=True)
            ),
        )
