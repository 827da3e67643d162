"""Checks of the per-symbol feature groups."""

from __future__ import annotations


from barloom.operators import recurrence
from barloom.plans import panel
from checks import market
from checks.catalog import KEY_COLUMNS, check, full, layer
from checks.market import SUPPLIER_BARS, TYPE_BARS, with_bars

YEAR = "sqrt(252.0)"


# Also run over the supplier universe: sparse histories, many one-trade bars.
ON_SUPPLIERS = {
    "adaptive_average",
    "average_true_range",
    "candlesticks",
    "cci",
    "directional_movement",
    "hurst_exponent",
    "macd",
    "parabolic_sar",
    "relative_strength",
    "skew_and_correlation",
    "stochastic",
    "stochastic_rsi",
    "volume_flow",
}


def feature_check(name, spec, layers, final, source="type", recursive=False):
    """Compare features added to the bars with SQL over the same bars."""
    if source == "type" and name in ON_SUPPLIERS:
        feature_check(f"{name}_suppliers", spec, layers, final, "supplier", recursive)
    bars_sql = TYPE_BARS if source == "type" else SUPPLIER_BARS
    bars = market.type_bars if source == "type" else market.supplier_bars
    columns = {**KEY_COLUMNS, **spec}
    sql = with_bars(f"SELECT {', '.join(columns)} FROM {final}", bars_sql, ",\n".join(layers), recursive)

    @check(name, columns, sql)
    def run(spark, sf_dir):
        return panel.with_features(bars(spark, sf_dir), list(spec))

    return run


def shifted(x, k):
    return f"lag({x}, {k}) OVER w"


RETURNS = {
    "Return": f"Close / nullif({shifted('Close', 1)}, 0) - 1",
    "Log_Return": f"ln(Close / nullif({shifted('Close', 1)}, 0))",
    "Volume_Change": f"Volume / nullif({shifted('Volume', 1)}, 0) - 1",
    "Price_Range": "High - Low",
    "Price_Range_Pct": "(High - Low) / nullif(Open, 0)",
}
RETURN_LAYER = layer("r", "bars", RETURNS)

for _source in ("type", "supplier"):
    _end = "" if _source == "type" else "_suppliers"
    feature_check(f"returns{_end}", {c: 6 if c == "Price_Range" else 5 for c in RETURNS}, [RETURN_LAYER], "r", _source)

    _targets, _spec = {}, {}
    for h in (1, 5, 10, 21):
        ahead = f"lead(Close, {h}) OVER w / nullif(Close, 0) - 1"
        _targets[f"Target_Return_{h}d"] = ahead
        _targets[f"Target_Direction_{h}d"] = f"CASE WHEN {ahead} > 0 THEN 1 ELSE 0 END"
        _spec |= {f"Target_Return_{h}d": 5, f"Target_Direction_{h}d": "i"}
    _legacy = {
        "Target_Next_Day_Return": "Target_Return_1d",
        "Target_Next_Day_Direction": "Target_Direction_1d",
    }
    feature_check(
        f"targets{_end}",
        {**_spec, "Target_Next_Day_Return": 5, "Target_Next_Day_Direction": "i"},
        [layer("t", "bars", _targets), layer("u", "t", _legacy)],
        "u",
        _source,
    )

    _ma, _slope, _spec = {}, {}, {}
    for w in (5, 10, 20, 50, 100, 200):
        _ma[f"MA_{w}"] = full("avg", "Close", w)
        _slope[f"Close_to_MA_{w}"] = f"Close / nullif(MA_{w}, 0) - 1"
        _slope[f"MA_{w}_Slope"] = f"MA_{w} / nullif({shifted(f'MA_{w}', 5)}, 0) - 1"
        _spec |= {f"MA_{w}": 4, f"Close_to_MA_{w}": 6, f"MA_{w}_Slope": 6}
    feature_check(
        f"moving_averages{_end}", _spec, [layer("m", "bars", _ma), layer("s", "m", _slope)], "s", _source
    )

    _spec, _stats = {}, {}
    for w in (5, 10, 21, 63):
        _stats |= {
            f"Return_Mean_{w}": full("avg", "Return", w),
            f"Return_Std_{w}": full("stddev_samp", "Return", w),
            f"Return_Min_{w}": full("min", "Return", w),
            f"Return_Max_{w}": full("max", "Return", w),
        }
        _spec |= {f"Return_{s}_{w}": 5 for s in ("Mean", "Std", "Min", "Max")}
    feature_check(f"return_statistics{_end}", _spec, [RETURN_LAYER, layer("s", "r", _stats)], "s", _source)

    feature_check(
        f"volatility{_end}",
        {f"Volatility_{w}": 5 for w in (5, 10, 20, 30, 60)} | {"Vol_Regime": "i"},
        [
            RETURN_LAYER,
            layer(
                "v",
                "r",
                {f"Volatility_{w}": f"({full('stddev_samp', 'Log_Return', w)}) * {YEAR}" for w in (5, 10, 20, 30, 60)},
            ),
            layer(
                "g",
                "v",
                {"Vol_Regime": f"CASE WHEN Volatility_20 > ({full('avg', 'Volatility_20', 60)}) THEN 1 ELSE 0 END"},
            ),
        ],
        "g",
        _source,
    )

feature_check(
    "weighted_average",
    {"WMA_20": 3},
    [layer("m", "bars", {"WMA_20": "(" + " + ".join(f"{20 - k} * lag(Close, {k}) OVER w" for k in range(20)) + ") / 210.0"})],
    "m",
)


def flat_zero(top, bottom, scale):
    return f"CASE WHEN ({bottom}) = 0 THEN 0.0 ELSE {scale} * ({top}) / nullif({bottom}, 0) END"


def extremes(n):
    return {f"hh{n}": full("max", "High", n), f"ll{n}": full("min", "Low", n)}


feature_check(
    "stochastic",
    {c: 5 for c in ("Stochastic_K", "Stochastic_D", "Stochastic_KD", "StochF_K", "StochF_D")},
    [
        layer("a", "bars", extremes(5)),
        layer("b", "a", {"raw": flat_zero("Close - ll5", "hh5 - ll5", "100")}),
        layer("c", "b", {"slow": full("avg", "raw", 3)}),
        layer("d", "c", {"Stochastic_D": full("avg", "slow", 3), "StochF_D": full("avg", "raw", 3)}),
        layer(
            "e",
            "d",
            {
                "Stochastic_K": "CASE WHEN Stochastic_D IS NOT NULL THEN slow END",
                "Stochastic_KD": "slow - Stochastic_D",
                "StochF_K": "CASE WHEN StochF_D IS NOT NULL THEN raw END",
            },
        ),
    ],
    "e",
)

feature_check(
    "cci",
    {"CCI": 4},
    [
        layer("a", "bars", {"tp": "(High + Low + Close) / 3"}),
        layer("b", "a", {"m": full("avg", "tp", 14), "l": "list(tp) OVER w14"}),
        layer("c", "b", {"dev": "list_aggregate([abs(x - m) FOR x IN l], 'avg')"}),
        layer("d", "c", {"CCI": "CASE WHEN m IS NOT NULL THEN CASE WHEN dev = 0 OR tp = m THEN 0 ELSE (tp - m) / (0.015 * nullif(dev, 0)) END END"}),
    ],
    "d",
)

feature_check(
    "momentum",
    {"Williams_R": 5, "MOM_10": 6, "ROC_10": 4, "ROC_20": 4, "DPO_20": 6, "PPO": 4, "APO": 3},
    [
        layer("a", "bars", extremes(14) | {"fast": full("avg", "Close", 12), "slow": full("avg", "Close", 26)}),
        layer(
            "b",
            "a",
            {
                "Williams_R": flat_zero("hh14 - Close", "hh14 - ll14", "-100"),
                "MOM_10": f"Close - {shifted('Close', 10)}",
                "ROC_10": f"100 * (Close / nullif({shifted('Close', 10)}, 0) - 1)",
                "ROC_20": f"100 * (Close / nullif({shifted('Close', 20)}, 0) - 1)",
                "DPO_20": f"Close - {shifted('Close', 11)}",
                "PPO": flat_zero("fast - slow", "slow", "100"),
                "APO": "fast - slow",
            },
        ),
    ],
    "b",
)

feature_check(
    "aroon",
    {"Aroon_Up": 6, "Aroon_Down": 6, "Aroon_Osc": 6},
    [
        layer("a", "bars", {"pos": "row_number() OVER w"}),
        layer(
            "b",
            "a",
            {
                "hp": "arg_max(pos, {'a': High, 'b': pos}) OVER w15",
                "lp": "arg_max(pos, {'a': -Low, 'b': pos}) OVER w15",
                "n": "count(High + Low) OVER w15",
            },
        ),
        layer(
            "c",
            "b",
            {
                "Aroon_Up": "CASE WHEN n = 15 THEN 100.0 * (14 - (pos - hp)) / 14 END",
                "Aroon_Down": "CASE WHEN n = 15 THEN 100.0 * (14 - (pos - lp)) / 14 END",
                "Aroon_Osc": "CASE WHEN n = 15 THEN 100.0 * (hp - lp) / 14 END",
            },
        ),
    ],
    "c",
)

feature_check(
    "ultimate_oscillator",
    {"ULTOSC": 5},
    [
        layer("a", "bars", {"pc": shifted("Close", 1)}),
        layer(
            "b",
            "a",
            {
                "bp": "CASE WHEN pc IS NOT NULL THEN Close - least(Low, pc) END",
                "tr": "CASE WHEN pc IS NOT NULL THEN greatest(High, pc) - least(Low, pc) END",
            },
        ),
        layer(
            "c",
            "b",
            {
                "ULTOSC": "CASE WHEN count(tr) OVER w28 = 28 THEN 100 * ("
                + " + ".join(
                    f"{k} * coalesce(sum(bp) OVER w{n} / nullif(sum(tr) OVER w{n}, 0), 0)" for k, n in ((4, 7), (2, 14), (1, 28))
                )
                + ") / 7 END"
            },
        ),
    ],
    "c",
)

feature_check(
    "fisher",
    {"Fisher_10": 5, "Fisher_20": 5},
    [
        layer("a", "bars", extremes(10) | extremes(20)),
        layer(
            "b",
            "a",
            {f"v{n}": f"2 * (Close - ll{n}) / nullif(hh{n} - ll{n}, 0) - 1" for n in (10, 20)},
        ),
        layer("b2", "b", {f"c{n}": f"CASE WHEN v{n} IS NOT NULL THEN least(greatest(v{n}, -0.999), 0.999) END" for n in (10, 20)}),
        layer("c", "b2", {f"Fisher_{n}": f"0.5 * ln((1 + c{n}) / (1 - c{n}))" for n in (10, 20)}),
    ],
    "c",
)

_bb = {}
for w in (5, 20):
    _bb |= {f"m{w}": full("avg", "Close", w), f"s{w}": full("stddev_pop", "Close", w)}
_bands, _bspec = {}, {}
for w in (5, 20):
    _bands |= {
        f"BB_Upper_{w}": f"m{w} + 2 * s{w}",
        f"BB_Middle_{w}": f"m{w}",
        f"BB_Lower_{w}": f"m{w} - 2 * s{w}",
        f"BB_Width_{w}": f"4 * s{w} / nullif(m{w}, 0)",
        f"BB_Position_{w}": f"(Close - m{w} + 2 * s{w}) / nullif(4 * s{w}, 0)",
    }
    _bspec |= {f"BB_{c}_{w}": 4 for c in ("Upper", "Middle", "Lower")} | {f"BB_Width_{w}": 6, f"BB_Position_{w}": 6}
feature_check("bollinger", _bspec, [layer("a", "bars", _bb), layer("b", "a", _bands)], "b")

feature_check(
    "ichimoku",
    {f"Ichimoku_{c}": 6 for c in ("Tenkan", "Kijun", "SpanA", "SpanB", "Chikou")}
    | {"Above_Cloud": "i", "Cloud_Width": 6, "TK_Cross": "i"},
    [
        layer("a", "bars", extremes(9) | extremes(26) | extremes(52)),
        layer("b", "a", {"Ichimoku_Tenkan": "(hh9 + ll9) / 2", "Ichimoku_Kijun": "(hh26 + ll26) / 2", "mid": "(hh52 + ll52) / 2"}),
        layer(
            "c",
            "b",
            {
                "Ichimoku_SpanA": "lag((Ichimoku_Tenkan + Ichimoku_Kijun) / 2, 26) OVER w",
                "Ichimoku_SpanB": "lag(mid, 26) OVER w",
                "Ichimoku_Chikou": "lag(Close, 26) OVER w",
                "TK_Cross": "CASE WHEN Ichimoku_Tenkan > Ichimoku_Kijun THEN 1 ELSE -1 END",
            },
        ),
        layer(
            "d",
            "c",
            {
                "Above_Cloud": "CASE WHEN Close > greatest(Ichimoku_SpanA, Ichimoku_SpanB) THEN 1 ELSE 0 END",
                "Cloud_Width": "abs(Ichimoku_SpanA - Ichimoku_SpanB)",
            },
        ),
    ],
    "d",
)

feature_check(
    "vwap",
    {"VWAP": 3, "Price_to_VWAP": 6},
    [
        layer("a", "bars", {"tv": "(High + Low + Close) / 3 * Volume"}),
        layer("b", "a", {"VWAP": f"({full('sum', 'tv', 20)}) / nullif({full('sum', 'Volume', 20)}, 0)"}),
        layer("c", "b", {"Price_to_VWAP": "Close / nullif(VWAP, 0) - 1"}),
    ],
    "c",
)

_don, _dspec = {}, {}
for w in (20, 55):
    _don |= {
        f"Donchian_High_{w}": f"hh{w}",
        f"Donchian_Low_{w}": f"ll{w}",
        f"Donchian_Mid_{w}": f"(hh{w} + ll{w}) / 2",
        f"Donchian_Pos_{w}": f"(Close - ll{w}) / nullif(hh{w} - ll{w}, 0)",
    }
    _dspec |= {f"Donchian_{c}_{w}": 6 for c in ("High", "Low", "Mid")} | {f"Donchian_Pos_{w}": 6}
feature_check("donchian", _dspec, [layer("a", "bars", extremes(20) | extremes(55)), layer("b", "a", _don)], "b")

feature_check(
    "volume_flow",
    {"OBV": 3, "OBV_Change": 5, "MFI_14": 5, "AD": 2, "CMF_20": 6, "Volume_Ratio_20": 5, "Volume_Surge": "i"},
    [
        layer("a", "bars", {"pc": shifted("Close", 1), "tp": "(High + Low + Close) / 3"}),
        layer(
            "b",
            "a",
            {
                "sv": "CASE WHEN pc IS NULL OR Close > pc THEN Volume WHEN Close < pc THEN -Volume ELSE 0 END",
                "ptp": shifted("tp", 1),
                "adv": "CASE WHEN High > Low THEN ((Close - Low) - (High - Close)) / (High - Low) * Volume ELSE 0 END",
                "mfv": "((Close - Low) - (High - Close)) / nullif(High - Low, 0) * Volume",
            },
        ),
        layer(
            "c",
            "b",
            {
                "OBV": "sum(sv) OVER history",
                "AD": "sum(adv) OVER history",
                "fin": "CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp > ptp THEN tp * Volume ELSE 0 END END",
                "fout": "CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp < ptp THEN tp * Volume ELSE 0 END END",
                "CMF_20": f"({full('sum', 'mfv', 20)}) / nullif({full('sum', 'Volume', 20)}, 0)",
                "Volume_Ratio_20": f"Volume / nullif({full('avg', 'Volume', 20)}, 0)",
            },
        ),
        layer("d", "c", {"gi": full("sum", "fin", 14), "go": full("sum", "fout", 14)}),
        layer(
            "e",
            "d",
            {
                "OBV_Change": "OBV / nullif(lag(OBV) OVER w, 0) - 1",
                "MFI_14": "CASE WHEN gi + go < 1 THEN 0 ELSE 100 * gi / (gi + go) END",
                "Volume_Surge": "CASE WHEN Volume_Ratio_20 > 2 THEN 1 ELSE 0 END",
            },
        ),
    ],
    "e",
)

_k = 0.34 / (1.34 + 21 / 19)
feature_check(
    "range_volatility",
    {"Parkinson_Vol_20": 5, "YZ_Volatility_20": 5},
    [
        layer(
            "a",
            "bars",
            {
                "hl2": "pow(ln(High / Low), 2)",
                "ho": "ln(High / Open)",
                "lo": "ln(Low / Open)",
                "co": "ln(Close / Open)",
                "oc": f"ln(Open / {shifted('Close', 1)})",
            },
        ),
        layer("b", "a", {"rs": "ho * (ho - co) + lo * (lo - co)"}),
        layer(
            "c",
            "b",
            {
                "Parkinson_Vol_20": f"sqrt(({full('avg', 'hl2', 20)}) / (4 * ln(2))) * {YEAR}",
                "YZ_Volatility_20": f"sqrt(greatest(({full('var_samp', 'oc', 20)}) + {_k!r} * ({full('var_samp', 'co', 20)})"
                f" + {1 - _k!r} * ({full('avg', 'rs', 20)}), CASE WHEN count(oc) OVER w20 = 20 THEN 0.0 END)) * {YEAR}",
            },
        ),
        layer("d", "c", {"ok": "count(oc) OVER w20"}),
        layer("e", "d", {"p": "Parkinson_Vol_20", "y": "CASE WHEN ok = 20 THEN YZ_Volatility_20 END"}, "Symbol, Date"),
        layer("f", "e", {"Parkinson_Vol_20": "p", "YZ_Volatility_20": "y"}, "Symbol, Date"),
    ],
    "f",
)

feature_check(
    "trend_and_gaps",
    {
        "Bull_Market": "i",
        "Market_Momentum": "i",
        "Price_52w_High": 6,
        "Price_52w_Low": 6,
        "Gap_Up": "i",
        "Gap_Down": "i",
        "Gap_Size": 6,
    },
    [
        RETURN_LAYER,
        layer(
            "a",
            "r",
            {
                "Bull_Market": f"CASE WHEN Close > ({full('avg', 'Close', 200)}) THEN 1 ELSE 0 END",
                "Market_Momentum": f"CASE WHEN ({full('sum', 'Return', 10)}) > 0 THEN 1 ELSE 0 END",
                "Price_52w_High": f"Close / ({full('max', 'High', 252)}) - 1",
                "Price_52w_Low": f"Close / ({full('min', 'Low', 252)}) - 1",
                "Gap_Up": f"CASE WHEN Open > {shifted('Close', 1)} THEN 1 ELSE 0 END",
                "Gap_Down": f"CASE WHEN Open < {shifted('Close', 1)} THEN 1 ELSE 0 END",
                "Gap_Size": f"Open / nullif({shifted('Close', 1)}, 0) - 1",
            },
        ),
    ],
    "a",
)

_lagged = {
    f"{x}_Lag_{k}": shifted(x, k) for x in ("Return", "Log_Return", "Volume_Change") for k in (1, 2, 3, 5, 10, 21, 63)
}
feature_check("lagged_changes", {c: 5 for c in _lagged}, [RETURN_LAYER, layer("l", "r", _lagged)], "l")

_shape = {}
for w in (5, 10, 21, 63):
    _shape[f"Return_Skew_{w}"] = full("skewness", "Return", w)
    _shape[f"PV_Corr_{w}"] = (
        f"CASE WHEN count(Return + Volume_Change) OVER w{w} = {w} THEN covar_samp(Return, Volume_Change) OVER w{w}"
        f" / nullif(stddev_samp(Return) OVER w{w} * stddev_samp(Volume_Change) OVER w{w}, 0) END"
    )
feature_check("skew_and_correlation", {c: 5 for c in _shape}, [RETURN_LAYER, layer("l", "r", _shape)], "l")

feature_check(
    "price_zscore",
    {"Price_ZScore_20": 6, "Price_ZScore_60": 6},
    [
        layer(
            "a",
            "bars",
            {
                f"Price_ZScore_{w}": f"(Close - ({full('avg', 'Close', w)})) / nullif({full('stddev_samp', 'Close', w)}, 0)"
                for w in (20, 60)
            },
        )
    ],
    "a",
)

# --- calendar -------------------------------------------------------------------

_cal = {
    "Day_of_Week": "isodow(Date) - 1",
    "Month": "month(Date)",
    "Year": "year(Date)",
    "Quarter": "quarter(Date)",
    "Week_of_Year": "weekofyear(Date)",
    "Is_Month_End": "CAST(Date = last_day(Date) AS INT)",
    "Is_Quarter_End": "CAST(Date = last_day(Date) AND month(Date) IN (3, 6, 9, 12) AS INT)",
}
_cal |= {f"Day_{i}": f"CAST(isodow(Date) = {i + 1} AS INT)" for i in range(5)}
_cal |= {f"Month_{i}": f"CAST(month(Date) = {i} AS INT)" for i in range(1, 13)}
feature_check("calendar_columns", {c: "i" for c in _cal}, [layer("c", "bars", _cal)], "c")

# --- candlesticks ---------------------------------------------------------------

_usual = {"long_": ("body", 10, 1.0), "doji_": ("span", 10, 0.1), "near_": ("span", 5, 0.2), "far_": ("span", 5, 0.6)}
_shapes = {
    "body": "abs(Close - Open)",
    "span": "High - Low",
    "colour": "CASE WHEN Close >= Open THEN 1 ELSE -1 END",
    "up": "High - greatest(Open, Close)",
    "dn": "least(Open, Close) - Low",
    "top": "greatest(Open, Close)",
    "bot": "least(Open, Close)",
    "earlier": "row_number() OVER w - 1",
}
_averages = {
    k: f"{f} * (CASE WHEN count({x}) OVER before{n} = {n} THEN avg({x}) OVER before{n} END)" for k, (x, n, f) in _usual.items()
}
_past = {}
for c in ("Open", "High", "Low", "Close", "body", "colour", "up", "dn", "top", "bot", "long_", "doji_", "near_", "far_"):
    for k in (1, 2, 3):
        _past[f"{c}{k}"] = shifted(c, k)


def _rule(lookback, *cases):
    body = " ".join(f"WHEN earlier >= {lookback} AND {when} THEN {then}" for when, then in cases)
    return f"CASE {body} ELSE 0 END"


_small_hammer = "body < long_ AND dn > body AND up < doji_"
_candle_sql = {
    "CDLDOJI": _rule(10, ("body <= doji_", "100")),
    "CDLHAMMER": _rule(11, (f"{_small_hammer} AND bot <= Low1 + near_1", "100")),
    "CDLENGULFING": _rule(
        2,
        ("colour = 1 AND colour1 = -1 AND Close > Open1 AND Open < Close1", "100"),
        ("colour = 1 AND colour1 = -1 AND ((Close >= Open1 AND Open < Close1) OR (Close > Open1 AND Open <= Close1))", "80"),
        ("colour = -1 AND colour1 = 1 AND Open > Close1 AND Close < Open1", "-100"),
        ("colour = -1 AND colour1 = 1 AND ((Open >= Close1 AND Close < Open1) OR (Open > Close1 AND Close <= Open1))", "-80"),
    ),
    "CDLMORNINGSTAR": _rule(
        12,
        (
            "body2 > long_2 AND colour2 = -1 AND body1 <= long_1 AND top1 < bot2 AND body > long_ AND colour = 1"
            " AND Close > Close2 + 0.3 * body2",
            "100",
        ),
    ),
    "CDLEVENINGSTAR": _rule(
        12,
        (
            "body2 > long_2 AND colour2 = 1 AND body1 <= long_1 AND bot1 > top2 AND body > long_ AND colour = -1"
            " AND Close < Close2 - 0.3 * body2",
            "-100",
        ),
    ),
    "CDLHARAMI": _rule(
        11,
        ("body1 > long_1 AND body <= long_ AND top < top1 AND bot > bot1", "-100 * colour1"),
        ("body1 > long_1 AND body <= long_ AND top <= top1 AND bot >= bot1", "-80 * colour1"),
    ),
    "CDLSHOOTINGSTAR": _rule(11, ("body < long_ AND up > body AND dn < doji_ AND bot > top1", "-100")),
    "CDLMARUBOZU": _rule(10, ("body > long_ AND up < doji_ AND dn < doji_", "100 * colour")),
    "CDL3WHITESOLDIERS": _rule(
        12,
        (
            "colour2 = 1 AND up2 < doji_2 AND colour1 = 1 AND up1 < doji_1 AND colour = 1 AND up < doji_"
            " AND Close > Close1 AND Close1 > Close2 AND Open1 > Open2 AND Open1 <= Close2 + near_2"
            " AND Open > Open1 AND Open <= Close1 + near_1 AND body1 > body2 - far_2 AND body > body1 - far_1 AND body > long_",
            "100",
        ),
    ),
    "CDL3BLACKCROWS": _rule(
        13,
        (
            "colour3 = 1 AND colour2 = -1 AND dn2 < doji_2 AND colour1 = -1 AND dn1 < doji_1 AND colour = -1 AND dn < doji_"
            " AND Open1 < Open2 AND Open1 > Close2 AND Open < Open1 AND Open > Close1 AND High3 > Close2"
            " AND Close2 > Close1 AND Close1 > Close",
            "-100",
        ),
    ),
    "CDLDRAGONFLYDOJI": _rule(10, ("body <= doji_ AND up < doji_ AND dn > doji_", "100")),
    "CDLGRAVESTONEDOJI": _rule(10, ("body <= doji_ AND dn < doji_ AND up > doji_", "100")),
    "CDLSPINNINGTOP": _rule(10, ("body < long_ AND up > body AND dn > body", "100 * colour")),
    "CDLHANGINGMAN": _rule(11, (f"{_small_hammer} AND bot >= High1 - near_1", "-100")),
}
feature_check(
    "candlesticks",
    {c: "i" for c in _candle_sql},
    [layer("a", "bars", _shapes), layer("b", "a", _averages), layer("c", "b", _past), layer("d", "c", _candle_sql)],
    "d",
)

# --- recurrences ----------------------------------------------------------------


def recurrence_layers(seeds: dict[str, tuple[int, float]], source="bars", x="Close", name="e"):
    """Averages started from the mean of the first n, one recursive walk for all.

    ``seeds``: column -> (n, weight of the new value).
    """
    starts = ", ".join(f"avg({x}) FILTER (rn <= {n}) OVER (PARTITION BY Symbol) AS seed_{c}" for c, (n, _) in seeds.items())
    first = ", ".join(f"CASE WHEN {n} = 1 THEN seed_{c} END AS {c}" for c, (n, _) in seeds.items())
    step = ", ".join(
        f"CASE WHEN s.rn < {n} THEN NULL WHEN s.rn = {n} THEN s.seed_{c} ELSE {a!r} * s.{x} + (1 - {a!r}) * t.{c} END"
        for c, (n, a) in seeds.items()
    )
    return [
        f"{name}_n AS (SELECT Symbol, Date, {x}, row_number() OVER (PARTITION BY Symbol ORDER BY Date) AS rn FROM {source} WHERE {x} IS NOT NULL)",
        f"{name}_s AS MATERIALIZED (SELECT Symbol, Date, rn, {x}, {starts} FROM {name}_n)",
        f"{name} AS (SELECT Symbol, Date, rn, {x}, {first} FROM {name}_s WHERE rn = 1 UNION ALL "
        f"SELECT s.Symbol, s.Date, s.rn, s.{x}, {step} FROM {name} t JOIN {name}_s s ON s.Symbol = t.Symbol AND s.rn = t.rn + 1)",
    ]


for _source in ("type", "supplier"):
    feature_check(
        "exponential_averages" + ("" if _source == "type" else "_suppliers"),
        {f"EMA_{n}": 3 for n in recurrence.EMA_SPANS},
        recurrence_layers({f"EMA_{n}": (n, 2 / (n + 1)) for n in recurrence.EMA_SPANS}),
        "e",
        _source,
        recursive=True,
    )

_step = layer(
    "d", "bars", {"up": f"greatest(Close - {shifted('Close', 1)}, 0)", "down": f"greatest({shifted('Close', 1)} - Close, 0)",
                  "first_bar": "row_number() OVER w"}
)
_step += ",\nd2 AS (SELECT Symbol, Date, CASE WHEN first_bar > 1 THEN up END AS up, CASE WHEN first_bar > 1 THEN down END AS down FROM d)"


def wilder_rsi(n):
    return f"CASE WHEN g{n} + l{n} = 0 THEN 0 ELSE 100 * g{n} / (g{n} + l{n}) END"


_rsi_layers = [
    _step,
    *recurrence_layers({f"g{n}": (n, 1 / n) for n in (7, 14, 21)}, "d2", "up", "g"),
    *recurrence_layers({f"l{n}": (n, 1 / n) for n in (7, 14, 21)}, "d2", "down", "l"),
    "rs AS (SELECT bars.Symbol, bars.Date, " + ", ".join(f"{wilder_rsi(n)} AS RSI_{n}" for n in (7, 14, 21))
    + " FROM bars LEFT JOIN g USING (Symbol, Date) LEFT JOIN l USING (Symbol, Date))",
]
feature_check("relative_strength", {f"RSI_{n}": 5 for n in (7, 14, 21)}, _rsi_layers, "rs", recursive=True)

feature_check(
    "stochastic_rsi",
    {"StochRSI_K": 4, "StochRSI_D": 4},
    [
        *_rsi_layers,
        layer("sa", "rs", {"hh": full("max", "RSI_14", 5), "ll": full("min", "RSI_14", 5)}),
        layer("sb", "sa", {"k": flat_zero("RSI_14 - ll", "hh - ll", "100")}),
        layer("sc", "sb", {"StochRSI_D": full("avg", "k", 3)}),
        layer("sd", "sc", {"StochRSI_K": "CASE WHEN StochRSI_D IS NOT NULL THEN k END"}),
    ],
    "sd",
    recursive=True,
)

feature_check(
    "macd",
    {"MACD": 4, "MACD_Signal": 4, "MACD_Hist": 4, "MACD_Cross": "i"},
    [
        # the fast average starts from rows 15..26 so that both start on row 26
        "bb AS (SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Date) AS bar FROM bars)",
        "late AS (SELECT * FROM bb WHERE bar > 14)",
        *recurrence_layers({"fast": (12, 2 / 13)}, "late", "Close", "f"),
        *recurrence_layers({"slow": (26, 2 / 27)}, "bars", "Close", "s"),
        "line AS (SELECT Symbol, Date, f.fast - s.slow AS m FROM s JOIN f USING (Symbol, Date))",
        *recurrence_layers({"sig": (9, 2 / 10)}, "line", "m", "g"),
        "mm AS (SELECT bars.Symbol, bars.Date, CASE WHEN sig IS NOT NULL THEN m END AS MACD, sig AS MACD_Signal, m - sig AS MACD_Hist,"
        " CASE WHEN m > sig THEN 1 ELSE -1 END AS MACD_Cross FROM bars LEFT JOIN g USING (Symbol, Date))",
    ],
    "mm",
    recursive=True,
)

_tr = layer("p", "bars", {"pc": shifted("Close", 1)}) + (
    ",\ntr AS (SELECT Symbol, Date, High, Low, Close, CASE WHEN pc IS NOT NULL THEN greatest(High, pc) - least(Low, pc) END AS tr FROM p)"
)
feature_check(
    "average_true_range",
    {"ATR": 4, "ATR_21": 4, "NATR": 5, "KC_Upper": 3, "KC_Lower": 3, "KC_Pos": 5, "Elder_Bull_Power": 3, "Elder_Bear_Power": 3},
    [
        _tr,
        *recurrence_layers({"a14": (14, 1 / 14), "a21": (21, 1 / 21)}, "tr", "tr", "a"),
        *recurrence_layers({"e20": (20, 2 / 21), "e13": (13, 2 / 14)}, "bars", "Close", "e"),
        "k AS (SELECT bars.Symbol, bars.Date, a14 AS ATR, a21 AS ATR_21, 100 * a14 / nullif(bars.Close, 0) AS NATR,"
        " e20 + 2 * a14 AS KC_Upper, e20 - 2 * a14 AS KC_Lower, (bars.Close - e20 + 2 * a14) / nullif(4 * a14, 0) AS KC_Pos,"
        " High - e13 AS Elder_Bull_Power, Low - e13 AS Elder_Bear_Power"
        " FROM bars LEFT JOIN a USING (Symbol, Date) LEFT JOIN e USING (Symbol, Date))",
    ],
    "k",
    recursive=True,
)


def _ema_of(source, x, n, name):
    return recurrence_layers({name + "v": (n, 2 / (n + 1))}, source, x, name)


feature_check(
    "double_and_triple_averages",
    {"DEMA_20": 3, "TEMA_20": 3, "TRIX_14": 4},
    [
        *_ema_of("bars", "Close", 20, "a"),
        *_ema_of("a", "av", 20, "b"),
        *_ema_of("b", "bv", 20, "c"),
        *_ema_of("bars", "Close", 14, "x"),
        *_ema_of("x", "xv", 14, "y"),
        *_ema_of("y", "yv", 14, "z"),
        "tx AS (SELECT Symbol, Date, 100 * (zv / lag(zv) OVER (PARTITION BY Symbol ORDER BY Date) - 1) AS TRIX_14 FROM z)",
        "dt AS (SELECT bars.Symbol, bars.Date, 2 * a.av - b.bv AS DEMA_20, 3 * a.av - 3 * b.bv + c.cv AS TEMA_20, TRIX_14"
        " FROM bars LEFT JOIN a USING (Symbol, Date) LEFT JOIN b USING (Symbol, Date) LEFT JOIN c USING (Symbol, Date)"
        " LEFT JOIN tx USING (Symbol, Date))",
    ],
    "dt",
    recursive=True,
)

_hull = []
for n, half, root in ((20, 10, 4), (50, 25, 7)):
    _hull += [
        *recurrence_layers({f"h{n}": (1, 2 / (half + 1)), f"f{n}": (1, 2 / (n + 1))}, "bars", "Close", f"u{n}"),
        f"raw{n} AS (SELECT Symbol, Date, 2 * h{n} - f{n} AS x{n} FROM u{n})",
        *recurrence_layers({f"HMA_{n}": (1, 2 / (root + 1))}, f"raw{n}", f"x{n}", f"v{n}"),
    ]
feature_check(
    "hull_averages",
    {"HMA_20": 3, "HMA_50": 3},
    _hull + ["hm AS (SELECT Symbol, Date, HMA_20, HMA_50 FROM v20 JOIN v50 USING (Symbol, Date))"],
    "hm",
    recursive=True,
)

feature_check(
    "adaptive_average",
    {"KAMA_20": 3},
    [
        layer("a", "bars", {"step": f"abs(Close - {shifted('Close', 1)})", "moved": f"abs(Close - {shifted('Close', 20)})",
                            "rn": "row_number() OVER w"}),
        layer("b", "a", {"path": "sum(step) OVER w20"}),
        "c AS MATERIALIZED (SELECT Symbol, Date, rn, Close, pow(CASE WHEN path = 0 OR path <= moved THEN 1 ELSE moved / path END"
        " * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS k FROM b)",
        "kk AS (SELECT Symbol, Date, rn, Close, CAST(NULL AS DOUBLE) AS KAMA_20 FROM c WHERE rn = 1 UNION ALL"
        " SELECT c.Symbol, c.Date, c.rn, c.Close, CASE WHEN c.rn <= 20 THEN NULL WHEN c.rn = 21 THEN kk.Close + c.k * (c.Close - kk.Close)"
        " ELSE kk.KAMA_20 + c.k * (c.Close - kk.KAMA_20) END FROM kk JOIN c ON c.Symbol = kk.Symbol AND c.rn = kk.rn + 1)",
    ],
    "kk",
    recursive=True,
)

feature_check(
    "chaikin_oscillator",
    {"ADOSC": 2},
    [
        layer("a", "bars", {"adv": "CASE WHEN High > Low THEN ((Close - Low) - (High - Close)) / (High - Low) * Volume ELSE 0 END"}),
        layer("b", "a", {"ad": "sum(adv) OVER history"}),
        *recurrence_layers({"q": (1, 2 / 4), "z": (1, 2 / 11)}, "b", "ad", "e"),
        "o AS (SELECT Symbol, Date, CASE WHEN rn >= 10 THEN q - z END AS ADOSC FROM e)",
    ],
    "o",
    recursive=True,
)

feature_check(
    "directional_movement",
    {"ADX": 4, "PLUS_DI": 4, "MINUS_DI": 4, "DI_Diff": 4, "ADX_Trend": "i"},
    [
        layer("a", "bars", {"rn": "row_number() OVER w", "u": f"High - {shifted('High', 1)}", "d": f"{shifted('Low', 1)} - Low",
                            "pc": shifted("Close", 1)}),
        "b AS MATERIALIZED (SELECT Symbol, Date, rn, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS p,"
        " CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS m, CASE WHEN rn > 1 THEN greatest(High, pc) - least(Low, pc) ELSE 0 END AS t FROM a)",
        "s AS (SELECT Symbol, Date, rn, p AS sp, m AS sm, t AS st FROM b WHERE rn = 1 UNION ALL"
        " SELECT b.Symbol, b.Date, b.rn, CASE WHEN b.rn <= 14 THEN s.sp + b.p ELSE s.sp - s.sp / 14 + b.p END,"
        " CASE WHEN b.rn <= 14 THEN s.sm + b.m ELSE s.sm - s.sm / 14 + b.m END,"
        " CASE WHEN b.rn <= 14 THEN s.st + b.t ELSE s.st - s.st / 14 + b.t END"
        " FROM s JOIN b ON b.Symbol = s.Symbol AND b.rn = s.rn + 1)",
        "di AS (SELECT Symbol, Date, rn, CASE WHEN rn > 14 THEN coalesce(100 * sp / nullif(st, 0), 0) END AS PLUS_DI,"
        " CASE WHEN rn > 14 THEN coalesce(100 * sm / nullif(st, 0), 0) END AS MINUS_DI FROM s)",
        "dx AS MATERIALIZED (SELECT *, 100 * abs(PLUS_DI - MINUS_DI) / nullif(PLUS_DI + MINUS_DI, 0) AS x FROM di)",
        "ax AS (SELECT Symbol, Date, rn, PLUS_DI, MINUS_DI, CAST(0 AS DOUBLE) AS acc FROM dx WHERE rn = 1 UNION ALL"
        " SELECT dx.Symbol, dx.Date, dx.rn, dx.PLUS_DI, dx.MINUS_DI, CASE WHEN dx.rn <= 14 THEN 0"
        " WHEN dx.rn <= 28 THEN ax.acc + coalesce(dx.x, 0) / 14 WHEN dx.x IS NULL THEN ax.acc ELSE (ax.acc * 13 + dx.x) / 14 END"
        " FROM ax JOIN dx ON dx.Symbol = ax.Symbol AND dx.rn = ax.rn + 1)",
        "ad AS (SELECT Symbol, Date, CASE WHEN rn >= 28 THEN acc END AS ADX, PLUS_DI, MINUS_DI, PLUS_DI - MINUS_DI AS DI_Diff,"
        " CASE WHEN rn >= 28 AND acc > 25 THEN 1 ELSE 0 END AS ADX_Trend FROM ax)",
    ],
    "ad",
    recursive=True,
)

feature_check(
    "parabolic_sar",
    {"SAR": 6, "SAR_Signal": "i"},
    [
        layer("a", "bars", {"rn": "row_number() OVER w", "h1": shifted("High", 1), "l1": shifted("Low", 1)}),
        "b AS MATERIALIZED (SELECT Symbol, Date, rn, High, Low, Close, CASE WHEN rn = 2 THEN High ELSE h1 END AS ph,"
        " CASE WHEN rn = 2 THEN Low ELSE l1 END AS pl, CASE WHEN l1 - Low > 0 AND l1 - Low > High - h1 THEN -1 ELSE 1 END AS dir, h1, l1 FROM a)",
        # state after bar rn: direction, next stop, extreme, pace
        "z AS (SELECT Symbol, rn, dir, CASE WHEN dir = 1 THEN l1 ELSE h1 END AS stop, CASE WHEN dir = 1 THEN High ELSE Low END AS ep,"
        " CAST(0.02 AS DOUBLE) AS af, CAST(NULL AS DATE) AS Date, CAST(NULL AS DOUBLE) AS Close, CAST(NULL AS DOUBLE) AS SAR,"
        " CAST(1 AS BIGINT) AS upto FROM b WHERE rn = 2 UNION ALL"
        " SELECT Symbol, rn, CASE WHEN crossed THEN -dir ELSE dir END,"
        " CASE WHEN crossed AND dir = 1 THEN greatest(flip + 0.02 * (Low - flip), ph, High)"
        "      WHEN crossed THEN least(flip + 0.02 * (High - flip), pl, Low)"
        "      WHEN dir = 1 THEN least(stop + naf * (nep - stop), pl, Low) ELSE greatest(stop + naf * (nep - stop), ph, High) END,"
        " CASE WHEN crossed AND dir = 1 THEN Low WHEN crossed THEN High ELSE nep END,"
        " CASE WHEN crossed THEN 0.02 ELSE naf END, Date, Close, CASE WHEN crossed THEN flip ELSE stop END, rn FROM ("
        "  SELECT b.Symbol, b.rn, b.Date, b.Close, b.High, b.Low, b.ph, b.pl, z.dir, z.stop,"
        "   CASE WHEN z.dir = 1 THEN b.Low <= z.stop ELSE b.High >= z.stop END AS crossed,"
        "   CASE WHEN z.dir = 1 THEN greatest(z.ep, b.ph, b.High) ELSE least(z.ep, b.pl, b.Low) END AS flip,"
        "   CASE WHEN z.dir = 1 THEN greatest(z.ep, b.High) ELSE least(z.ep, b.Low) END AS nep,"
        "   CASE WHEN (z.dir = 1 AND b.High > z.ep) OR (z.dir = -1 AND b.Low < z.ep) THEN least(z.af + 0.02, 0.2) ELSE z.af END AS naf"
        "  FROM z JOIN b ON b.Symbol = z.Symbol AND b.rn = z.upto + 1))",
        "sar AS (SELECT bars.Symbol, bars.Date, SAR, CASE WHEN bars.Close > SAR THEN 1 ELSE -1 END AS SAR_Signal"
        " FROM bars LEFT JOIN (SELECT Symbol, Date, SAR FROM z WHERE Date IS NOT NULL) q USING (Symbol, Date))",
    ],
    "sar",
    recursive=True,
)


_HURST = {63: 15, 126: 20}
_LAGS = range(2, 20)


def _chunk_sql(lag):
    """Rescaled range of the ``lag`` returns from each bar on: running totals of the bars ahead, side by side."""
    frame = f"(PARTITION BY Symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND {lag - 1} FOLLOWING)"
    path = ", ".join(f"t{j} - before - {j + 1} * m" for j in range(lag))
    return (
        f"SELECT Symbol, rn AS first, {lag} AS lag, f63, f126, CASE WHEN known = {lag} AND s > 0 THEN (greatest({path}) - least({path})) / s END AS rs FROM"
        f" (SELECT *, avg(Log_Return) OVER q AS m, stddev_pop(Log_Return) OVER q AS s, count(Log_Return) OVER q AS known FROM ahead WINDOW q AS {frame})"
    )


def _hurst_sql(w):
    """Chunks of one lag stand ``lag`` bars apart: rows of one remainder, so a frame of rows holds those of a window."""
    parts = " UNION ALL ".join(
        f"SELECT Symbol, first, lag, avg(rs) OVER (PARTITION BY Symbol, first % {lag} ORDER BY first ROWS BETWEEN CURRENT ROW AND {len(range(0, w - lag, lag)) - 1} FOLLOWING) AS m, f{w}"
        f" FROM chunk WHERE lag = {lag}"
        for lag in range(2, _HURST[w])
    )
    return (
        f"h_{w} AS (SELECT Symbol, first + {w - 1} AS rn, CASE WHEN count(m) < 2 THEN 0.5 ELSE least(greatest(regr_slope(ln(m), ln(lag)), 0), 1) END AS Hurst_{w}"
        f" FROM ({parts}) WHERE f{w} = {w} GROUP BY 1, 2)"
    )


_hurst_layers = [
    RETURN_LAYER,
    layer("n", "r", {"rn": "row_number() OVER w", "total": "sum(coalesce(Log_Return, 0)) OVER history", "c63": "count(Log_Return) OVER w63", "c126": "count(Log_Return) OVER w126"}),
    layer(
        "ahead",
        "n",
        {"before": "total - coalesce(Log_Return, 0)", "f63": "lead(c63, 62) OVER w", "f126": "lead(c126, 125) OVER w"} | {f"t{j}": f"lead(total, {j}) OVER w" for j in range(max(_LAGS))},
        "Symbol, Date, rn, Log_Return",
    ),
    "chunk AS MATERIALIZED (" + " UNION ALL ".join(_chunk_sql(lag) for lag in _LAGS) + ")",
    _hurst_sql(63),
    _hurst_sql(126),
    "hh AS (SELECT n.Symbol, n.Date, Hurst_63, Hurst_126, CASE WHEN Hurst_63 < 0.45 THEN 1 ELSE 0 END AS MeanRev_Regime"
    " FROM n LEFT JOIN h_63 USING (Symbol, rn) LEFT JOIN h_126 USING (Symbol, rn))",
]
feature_check("hurst_exponent", {"Hurst_63": 6, "Hurst_126": 6, "MeanRev_Regime": "i"}, _hurst_layers, "hh")
