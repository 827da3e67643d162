"""Checks of sources, joins, splits, scaling, metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cleaning, context, metrics, scaling, sequences, splits, timeframe
from barloom.plans import least_squares, panel, scoring, training
from barloom.schema import HORIZONS, SECTOR_ETF, SECTORS
from barloom.sources import bars as B
from barloom.sources import context as context_source
from barloom.sources import universe
from checks import market
from checks.catalog import KEY_COLUMNS, check, full, layer
from checks import models_sql as M
from checks.features import RETURN_LAYER, YEAR, recurrence_layers
from checks.market import CONTEXT, SUPPLIER_BARS, TYPE_BARS, with_bars

BAR_COLUMNS = {**KEY_COLUMNS, "Open": 6, "High": 6, "Low": 6, "Close": 6, "Volume": 3}


# --- flagship and sources ---------------------------------------------------------


@check(
    "flagship",
    {**KEY_COLUMNS, "Close": 6, "Return": 5, "MA_20": 4, "Volatility_20": 5, "Target_Return_1d": 5, "Target_Direction_1d": "i"},
    with_bars(
        "SELECT *, CASE WHEN Target_Return_1d > 0 THEN 1 ELSE 0 END AS Target_Direction_1d FROM b"
        " WHERE MA_20 IS NOT NULL AND Volatility_20 IS NOT NULL AND Target_Return_1d IS NOT NULL",
        SUPPLIER_BARS,
        RETURN_LAYER
        + ",\n"
        + layer(
            "b",
            "r",
            {
                "MA_20": full("avg", "Close", 20),
                "Volatility_20": f"({full('stddev_samp', 'Log_Return', 20)}) * {YEAR}",
                "Target_Return_1d": "lead(Close) OVER w / nullif(Close, 0) - 1",
            },
        ),
    ),
)
def flagship(spark, sf_dir):
    names = ["Return", "MA_20", "Volatility_20", "Target_Return_1d", "Target_Direction_1d"]
    out = panel.with_features(market.supplier_bars(spark, sf_dir), names)
    return out.dropna(subset=["MA_20", "Volatility_20", "Target_Return_1d"])


@check("bars_from_ticks", BAR_COLUMNS, with_bars("SELECT * FROM bars"))
def bars_from_ticks(spark, sf_dir):
    return market.type_bars(spark, sf_dir)


@check("bars_from_ticks_suppliers", BAR_COLUMNS, with_bars("SELECT * FROM bars", SUPPLIER_BARS))
def bars_from_ticks_suppliers(spark, sf_dir):
    return market.supplier_bars(spark, sf_dir)


@check(
    "bars_in_range",
    BAR_COLUMNS,
    with_bars("SELECT * FROM bars WHERE Date >= DATE '1997-01-01' AND Date < DATE '1998-07-01'", SUPPLIER_BARS),
)
def bars_in_range(spark, sf_dir):
    return B.between(market.supplier_bars(spark, sf_dir), "1997-01-01", "1998-07-01")


@check(
    "normalized_bars",
    {**BAR_COLUMNS, "Adj_Close": 6},
    with_bars(
        "SELECT Symbol, Date, Open, High, TRY_CAST(CASE WHEN Low < 1000 THEN 'n/a' ELSE CAST(Low AS VARCHAR) END AS DOUBLE) AS Low,"
        " Close, Volume, Close * 0.5 AS Adj_Close FROM bars"
    ),
)
def normalized_bars(spark, sf_dir):
    raw = market.type_bars(spark, sf_dir)
    text = F.when(F.col("Low") < 1000, "n/a").otherwise(F.col("Low").cast("string"))
    raw = raw.withColumn("Low", text).withColumn("Adj_Close", F.col("Close") * 0.5)
    return B.normalize_bars(raw.withColumnRenamed("Adj_Close", "Adj Close"))


@check("wide_to_bars", BAR_COLUMNS, with_bars("SELECT * FROM bars"))
def wide_to_bars(spark, sf_dir):
    bars = market.type_bars(spark, sf_dir)
    symbols = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    fields = ["Open", "High", "Low", "Close", "Volume"]
    cells = [F.max(F.when(F.col("Symbol") == s, F.col(f))).alias(f"{f}|{s}") for s in symbols for f in fields]
    return B.wide_to_bars(bars.groupBy("Date").agg(*cells), symbols)


@check(
    "universe_filter",
    BAR_COLUMNS,
    with_bars("SELECT * FROM bars WHERE Symbol IN ('S1', 'S3', 'S5', 'S7')", SUPPLIER_BARS),
)
def universe_filter(spark, sf_dir):
    wanted = universe.symbols_from_text(spark, " s5, S3,,s1 ,S5,s7 ")
    return B.keep_symbols(market.supplier_bars(spark, sf_dir), wanted)


@check(
    "first_mention",
    {"Symbol": "s", "pos": "i"},
    "SELECT upper(trim(c_mktsegment)) AS Symbol, min(c_custkey) AS pos FROM customer GROUP BY 1",
)
def first_mention(spark, sf_dir):
    rows = market.table(spark, sf_dir, "customer")
    rows = rows.select(F.upper(F.trim("c_mktsegment")).alias("Symbol"), F.col("c_custkey").alias("pos"))
    return universe.first_mention(rows)


@check(
    "enough_history",
    {"Symbol": "s", "rows": "i", "total": "i"},
    with_bars(
        "SELECT Symbol, count(*) AS rows, sum(count(*)) OVER () AS total FROM bars GROUP BY Symbol HAVING count(*) >= 535",
        SUPPLIER_BARS,
    ),
)
def enough_history(spark, sf_dir):
    return cleaning.row_counts(panel.enough_history(market.supplier_bars(spark, sf_dir), 535))


_READY = layer(
    "m",
    "r",
    {
        "ma": full("avg", "Close", 200),
        "kijun": full("max", "High", 26),
        "n": "row_number() OVER w",
        "ahead": "lead(Close) OVER w / nullif(Close, 0) - 1",
    },
)


@check(
    "labelled_rows",
    {"Symbol": "s", "rows": "i", "first_day": "d", "last_day": "d"},
    with_bars(
        "SELECT Symbol, count(*) AS rows, min(Date) AS first_day, max(Date) AS last_day FROM m"
        " WHERE ma IS NOT NULL AND n > 14 AND kijun IS NOT NULL AND ahead IS NOT NULL GROUP BY Symbol HAVING count(*) >= 335",
        SUPPLIER_BARS,
        RETURN_LAYER + ",\n" + _READY,
    ),
)
def labelled_rows(spark, sf_dir):
    made = panel.feature_panel(market.supplier_bars(spark, sf_dir), features=["Return"], min_rows=335)
    return made.groupBy("Symbol").agg(
        F.count("*").alias("rows"), F.min("Date").alias("first_day"), F.max("Date").alias("last_day")
    )


@check("full_panel_suppliers", {**KEY_COLUMNS, "Close": 6, "MA_200": 4, "EMA_200": 4, "Hurst_126": 6, "W_RSI14": 5, "Sector": "s"})
def full_panel_suppliers(spark, sf_dir):
    bars = market.supplier_bars(spark, sf_dir)
    return panel.feature_panel(bars, market.context_bars(spark, sf_dir))


# --- resampling and joins back ------------------------------------------------------

WEEKS = """weeks0 AS (SELECT Symbol, Date + CAST(7 - isodow(Date) AS INTEGER) AS label, first(Open ORDER BY Date) AS Open, max(High) AS High,
  min(Low) AS Low, last(Close ORDER BY Date) AS Close, sum(Volume) AS Volume FROM bars GROUP BY 1, 2),
weeks AS (SELECT s.Symbol, CAST(s.label AS DATE) AS label, Open, High, Low, Close, coalesce(Volume, 0) AS Volume
  FROM (SELECT Symbol, unnest(generate_series(min(label), max(label), INTERVAL 7 DAY)) AS label FROM weeks0 GROUP BY Symbol) s
  LEFT JOIN weeks0 w ON w.Symbol = s.Symbol AND w.label = CAST(s.label AS DATE))"""
MONTHS = """months0 AS (SELECT Symbol, last_day(Date) AS label, first(Open ORDER BY Date) AS Open, max(High) AS High,
  min(Low) AS Low, last(Close ORDER BY Date) AS Close, sum(Volume) AS Volume FROM bars GROUP BY 1, 2),
months AS (SELECT s.Symbol, last_day(CAST(s.m AS DATE)) AS label, Open, High, Low, Close, coalesce(Volume, 0) AS Volume
  FROM (SELECT Symbol, unnest(generate_series(date_trunc('month', min(label)), date_trunc('month', max(label)), INTERVAL 1 MONTH)) AS m
        FROM months0 GROUP BY Symbol) s
  LEFT JOIN months0 w ON w.Symbol = s.Symbol AND w.label = last_day(CAST(s.m AS DATE)))"""
_PERIOD = {"Symbol": "s", "label": "d", "Open": 6, "High": 6, "Low": 6, "Close": 6, "Volume": 3}


@check("weekly_bars", _PERIOD, with_bars("SELECT * FROM weeks", SUPPLIER_BARS, WEEKS))
def weekly_bars(spark, sf_dir):
    return timeframe.resample(market.supplier_bars(spark, sf_dir), "week")


@check("monthly_bars", _PERIOD, with_bars("SELECT * FROM months", SUPPLIER_BARS, MONTHS))
def monthly_bars(spark, sf_dir):
    return timeframe.resample(market.supplier_bars(spark, sf_dir), "month")


def _rolling(agg, x, n):
    frame = f"(PARTITION BY Symbol ORDER BY label ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END"


def _period_sql(source, prefix, vol, short, mom):
    order = "(PARTITION BY Symbol ORDER BY label)"
    return f"""{source}p AS (SELECT *, last_value(Close IGNORE NULLS) OVER (PARTITION BY Symbol ORDER BY label ROWS UNBOUNDED PRECEDING) AS p FROM {source}),
{source}r AS (SELECT *, p / nullif(lag(p) OVER {order}, 0) - 1 AS {prefix}_Return, p / nullif(lag(p, {mom}) OVER {order}, 0) - 1 AS {prefix}_Mom{mom},
  (High - Low) / nullif(Open, 0) AS {prefix}_Range, {_rolling('avg', 'Close', short)} AS {prefix}_MA{short}, {_rolling('avg', 'Close', 12)} AS {prefix}_MA12 FROM {source}p),
{source}f AS (SELECT *, {_rolling('stddev_samp', f'{prefix}_Return', vol)} AS {prefix}_Vol FROM {source}r)"""


_W = [c for c in timeframe.WEEKLY if c != "W_RSI14"]
_DIGITS = {c: 4 if "_MA" in c else 5 for c in timeframe.WEEKLY + timeframe.MONTHLY}


def _carried(source, bars, columns, label):
    return f"SELECT bars.Symbol, bars.Date, {', '.join(columns)} FROM bars LEFT JOIN {source}f f ON f.Symbol = bars.Symbol AND f.label = {label}"


_LAST_WEEK = "CASE WHEN isodow(bars.Date) = 7 THEN bars.Date ELSE bars.Date - CAST(isodow(bars.Date) AS INTEGER) END"
_LAST_MONTH = "CASE WHEN bars.Date = last_day(bars.Date) THEN bars.Date ELSE last_day(CAST(bars.Date - INTERVAL 1 MONTH AS DATE)) END"

for _end, _bars, _sql in (("", market.type_bars, TYPE_BARS), ("_suppliers", market.supplier_bars, SUPPLIER_BARS)):

    @check(
        f"weekly_features{_end}",
        {**KEY_COLUMNS, **{c: _DIGITS[c] for c in _W}},
        with_bars(
            _carried("weeks", _sql, _W, _LAST_WEEK), _sql, WEEKS + ",\n" + _period_sql("weeks", "W", 4, 4, 4)
        ),
    )
    def weekly_features(spark, sf_dir, bars=_bars):
        return timeframe.with_timeframes(bars(spark, sf_dir), _W)

    @check(
        f"monthly_features{_end}",
        {**KEY_COLUMNS, **{c: _DIGITS[c] for c in timeframe.MONTHLY}},
        with_bars(
            _carried("months", _sql, timeframe.MONTHLY, _LAST_MONTH),
            _sql,
            MONTHS + ",\n" + _period_sql("months", "M", 3, 3, 3),
        ),
    )
    def monthly_features(spark, sf_dir, bars=_bars):
        return timeframe.with_timeframes(bars(spark, sf_dir), timeframe.MONTHLY)


@check(
    "weekly_strength_suppliers",
    {**KEY_COLUMNS, "W_RSI14": 5},
    with_bars(
        f"SELECT bars.Symbol, bars.Date, CASE WHEN gv + lv = 0 THEN 0 ELSE 100 * gv / (gv + lv) END AS W_RSI14 FROM bars"
        f" LEFT JOIN g ON g.Symbol = bars.Symbol AND g.Date = {_LAST_WEEK} LEFT JOIN l ON l.Symbol = bars.Symbol AND l.Date = {_LAST_WEEK}",
        SUPPLIER_BARS,
        ",\n".join(
            [
                WEEKS,
                "known AS (SELECT Symbol, label AS Date, Close - lag(Close) OVER (PARTITION BY Symbol ORDER BY label) AS step"
                " FROM weeks WHERE Close IS NOT NULL)",
                "moves AS (SELECT Symbol, Date, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS up,"
                " CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END AS down FROM known)",
                *recurrence_layers({"gv": (14, 1 / 14)}, "moves", "up", "g"),
                *recurrence_layers({"lv": (14, 1 / 14)}, "moves", "down", "l"),
            ]
        ),
        recursive=True,
    ),
)
def weekly_strength_suppliers(spark, sf_dir):
    return timeframe.with_timeframes(market.supplier_bars(spark, sf_dir), ["W_RSI14"])


@check(
    "timeframes_together",
    {**KEY_COLUMNS, "Close": 6, **{c: _DIGITS[c] for c in _W + timeframe.MONTHLY}},
    with_bars(
        f"SELECT bars.Symbol, bars.Date, bars.Close, {', '.join(f'w.{c}' for c in _W)}, {', '.join(f'm.{c}' for c in timeframe.MONTHLY)} FROM bars"
        f" LEFT JOIN weeksf w ON w.Symbol = bars.Symbol AND w.label = {_LAST_WEEK} LEFT JOIN monthsf m ON m.Symbol = bars.Symbol AND m.label = {_LAST_MONTH}",
        SUPPLIER_BARS,
        ",\n".join([WEEKS, _period_sql("weeks", "W", 4, 4, 4), MONTHS, _period_sql("months", "M", 3, 3, 3)]),
    ),
)
def timeframes_together(spark, sf_dir):
    """Daily, weekly and monthly columns side by side, and the joins that give the same."""
    bars = market.supplier_bars(spark, sf_dir)
    streamed = panel.with_features(bars, _W + timeframe.MONTHLY)
    return streamed.select("Symbol", "Date", "Close", *_W, *timeframe.MONTHLY)


@check(
    "timeframes_joined",
    {**KEY_COLUMNS, **{c: _DIGITS[c] for c in ("W_MA4", "W_Mom4", "M_MA3", "M_Return")}},
    with_bars(
        "SELECT bars.Symbol, bars.Date, w.W_MA4, w.W_Mom4, m.M_MA3, m.M_Return FROM bars"
        f" LEFT JOIN weeksf w ON w.Symbol = bars.Symbol AND w.label = {_LAST_WEEK} LEFT JOIN monthsf m ON m.Symbol = bars.Symbol AND m.label = {_LAST_MONTH}",
        SUPPLIER_BARS,
        ",\n".join([WEEKS, _period_sql("weeks", "W", 4, 4, 4), MONTHS, _period_sql("months", "M", 3, 3, 3)]),
    ),
)
def timeframes_joined(spark, sf_dir):
    """The as-of join of separate weekly and monthly tables."""
    bars = market.supplier_bars(spark, sf_dir)
    return timeframe.carry_back(bars, timeframe.weekly_features(bars, ["W_MA4", "W_Mom4"]), timeframe.monthly_features(bars, ["M_MA3", "M_Return"]))


# --- market context -----------------------------------------------------------------

_CTX = f"""ctx AS MATERIALIZED ({CONTEXT}),
cr AS (SELECT *, Close / nullif(lag(Close) OVER c, 0) - 1 AS Ret FROM ctx WINDOW c AS (PARTITION BY ctx_symbol ORDER BY Date)),
cv AS (SELECT *, CASE WHEN count(Ret) OVER f = 20 THEN stddev_samp(Ret) OVER f * {YEAR} END AS Vol20 FROM cr
  WINDOW f AS (PARTITION BY ctx_symbol ORDER BY Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
_SERIES = ["SPY", "QQQ", "IWM", *SECTOR_ETF.values()]


@check(
    "context_frame",
    {"Date": "d", "VIX": 6, **{f"{s}_{k}": 6 for s in _SERIES for k in ("Ret", "Vol20")}},
    f"WITH {_CTX} SELECT Date, max(Close) FILTER (ctx_symbol = 'VIX') AS VIX, "
    + ", ".join(
        f"max(Ret) FILTER (ctx_symbol = '{s}') AS {s}_Ret, max(Vol20) FILTER (ctx_symbol = '{s}') AS {s}_Vol20" for s in _SERIES
    )
    + " FROM cv GROUP BY Date",
)
def context_frame(spark, sf_dir):
    return context.context_frame(market.context_bars(spark, sf_dir))


def _pairs(x, n):
    return f"CASE WHEN count(Return + {x}) OVER w{n} = {n} THEN covar_samp(Return, {x}) OVER w{n}"


_CONTEXT_LAYERS = ",\n".join(
    [
        _CTX,
        RETURN_LAYER,
        f"sectors(sym, Sector) AS (VALUES {market.SECTOR_VALUES})",
        "etfs(Sector, etf) AS (VALUES " + ", ".join(f"('{s}', '{e}')" for s, e in SECTOR_ETF.items()) + ")",
        "vix AS (SELECT Date, max(Close) FILTER (ctx_symbol = 'VIX') AS VIX FROM ctx GROUP BY Date)",
        """j AS MATERIALIZED (SELECT r.*, spy.Ret AS spy, vix.VIX, coalesce(s.Sector, 'Other') AS Sector, fund.Ret AS fund FROM r
  LEFT JOIN sectors s ON s.sym = r.Symbol LEFT JOIN etfs e ON e.Sector = s.Sector
  LEFT JOIN cr spy ON spy.ctx_symbol = 'SPY' AND spy.Date = r.Date
  LEFT JOIN cr fund ON fund.ctx_symbol = e.etf AND fund.Date = r.Date
  ASOF LEFT JOIN vix ON r.Date >= vix.Date)""",
        layer(
            "k",
            "j",
            {
                "SPY_Corr_20": f"{_pairs('spy', 20)} / nullif(stddev_samp(Return) OVER w20 * stddev_samp(spy) OVER w20, 0) END",
                "Beta_SPY_60": f"{_pairs('spy', 60)} / nullif(var_samp(spy) OVER w60, 0) END",
                "SectorETF_Corr_20": f"{_pairs('fund', 20)} / nullif(stddev_samp(Return) OVER w20 * stddev_samp(fund) OVER w20, 0) END",
                "vp": "last_value(VIX IGNORE NULLS) OVER history",
            },
        ),
        layer(
            "l",
            "k",
            {
                "Alpha_SPY_20": "Return - Beta_SPY_60 * spy",
                "VIX_Change": "vp / nullif(lag(vp) OVER w, 0) - 1",
                "High_VIX": "CASE WHEN VIX > 25 THEN 1 ELSE 0 END",
                "Crisis_VIX": "CASE WHEN VIX > 40 THEN 1 ELSE 0 END",
                "Excess_Ret_Sector": "Return - fund",
            },
        ),
    ]
)
_CONTEXT_COLUMNS = {
    "VIX": 6,
    "VIX_Change": 6,
    "High_VIX": "i",
    "Crisis_VIX": "i",
    "SPY_Corr_20": 6,
    "Beta_SPY_60": 6,
    "Alpha_SPY_20": 5,
    "SectorETF_Corr_20": 6,
    "Excess_Ret_Sector": 5,
}


@check(
    "context_features",
    {**KEY_COLUMNS, **_CONTEXT_COLUMNS},
    with_bars("SELECT * FROM l", TYPE_BARS, _CONTEXT_LAYERS),
)
def context_features(spark, sf_dir):
    bars = market.type_bars(spark, sf_dir)
    return panel.with_features(
        bars, list(_CONTEXT_COLUMNS), market.context_bars(spark, sf_dir), market.type_sectors(spark)
    )


@check(
    "sector_columns",
    {**KEY_COLUMNS, "Sector": "s", **{f"Sector_{s}": "i" for s in SECTORS}},
    with_bars(
        "SELECT Symbol, Date, Sector, " + ", ".join(f"CAST(Sector = '{s}' AS INT) AS Sector_{s}" for s in SECTORS)
        + f" FROM (SELECT bars.*, coalesce(s.Sector, 'Other') AS Sector FROM bars LEFT JOIN (VALUES {market.SECTOR_VALUES}) s(sym, Sector) ON sym = Symbol)"
    ),
)
def sector_columns(spark, sf_dir):
    names = ["Sector"] + [f"Sector_{s}" for s in SECTORS]
    return panel.with_features(market.type_bars(spark, sf_dir), names, sectors=market.type_sectors(spark))


_FUND = {c: 6 for c in ("PE_Ratio", "PB_Ratio", "Market_Cap_B", "Beta", "Dividend_Yield", "Profit_Margin", "Revenue_Growth")}


@check(
    "fundamentals",
    {**KEY_COLUMNS, **_FUND},
    with_bars(
        """SELECT bars.Symbol, Date, f.* FROM bars LEFT JOIN (
  SELECT p_type AS sym, avg(p_size) AS PE_Ratio, CASE WHEN p_type <> 'PROMO' THEN avg(p_retailprice) / 1000 END AS PB_Ratio,
    CASE WHEN p_type <> 'SMALL' THEN sum(p_retailprice) / 1e9 ELSE 0 END AS Market_Cap_B, 1.1 AS Beta,
    CASE WHEN p_type <> 'LARGE' THEN min(p_size) / 100.0 ELSE 0 END AS Dividend_Yield, max(p_size) / 500.0 AS Profit_Margin,
    CASE WHEN p_type <> 'LARGE' THEN 0.05 END AS Revenue_Growth FROM part GROUP BY p_type) f ON sym = bars.Symbol"""
    ),
)
def fundamentals(spark, sf_dir):
    known = universe.normalize_fundamentals(market.type_fundamentals(spark, sf_dir))
    return panel.with_features(market.type_bars(spark, sf_dir), list(_FUND), fundamentals=known)


# --- splits ---------------------------------------------------------------------------

_RANKED = "o AS (SELECT *, row_number() OVER (ORDER BY Date, Symbol) - 1 AS rank, count(*) OVER () AS n FROM bars)"


@check(
    "chronological_split",
    {**KEY_COLUMNS, "split": "s"},
    with_bars(
        "SELECT Symbol, Date, CASE WHEN rank < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM o", SUPPLIER_BARS, _RANKED
    ),
)
def chronological_split(spark, sf_dir):
    return splits.split_train_test(market.supplier_bars(spark, sf_dir), 0.2)


@check(
    "split_by_date",
    {**KEY_COLUMNS, "split": "s"},
    with_bars(
        "SELECT Symbol, Date, CASE WHEN Date < (SELECT Date FROM o WHERE rank = floor(n * 0.8)) THEN 'train' ELSE 'test' END AS split FROM o",
        SUPPLIER_BARS,
        _RANKED,
    ),
)
def split_by_date(spark, sf_dir):
    return splits.split_train_test(market.supplier_bars(spark, sf_dir), 0.2, by_date=True)


@check(
    "split_with_embargo",
    {**KEY_COLUMNS, "split": "s"},
    with_bars(
        "SELECT Symbol, Date, CASE WHEN rank < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM"
        " (SELECT *, lead(Date, 5) OVER (PARTITION BY Symbol ORDER BY Date) AS ends FROM o)"
        " WHERE rank >= floor(n * 0.8) OR ends IS NULL OR ends < (SELECT Date FROM o WHERE rank = floor(n * 0.8))",
        SUPPLIER_BARS,
        _RANKED,
    ),
)
def split_with_embargo(spark, sf_dir):
    return splits.split_train_test(market.supplier_bars(spark, sf_dir), 0.2, embargo=5)


@check(
    "random_split_sizes",
    {"split": "s", "rows": "i"},
    with_bars(
        "SELECT 'test' AS split, CAST(ceil(count(*) * 0.2) AS BIGINT) AS rows FROM bars UNION ALL"
        " SELECT 'train', count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM bars",
        SUPPLIER_BARS,
    ),
)
def random_split_sizes(spark, sf_dir):
    parts = splits.split_train_test(market.supplier_bars(spark, sf_dir), 0.2, time_based=False)
    return parts.groupBy("split").agg(F.count("*").alias("rows"))


@check(
    "walk_forward_folds",
    {**KEY_COLUMNS, "fold": "i", "role": "s"},
    with_bars(
        "SELECT Symbol, Date, k + 1 AS fold, CASE WHEN rank < a THEN 'train' ELSE 'test' END AS role FROM"
        " (SELECT o.*, k, n - 5 * floor(n * 0.1) + k * floor(n * 0.1) AS a, floor(n * 0.1) AS f FROM o, (SELECT unnest(range(0, 5)) AS k))"
        " WHERE rank < a + f",
        SUPPLIER_BARS,
        _RANKED,
    ),
)
def walk_forward_folds(spark, sf_dir):
    return splits.walk_forward_splits(market.supplier_bars(spark, sf_dir), 5, 0.1)


@check(
    "global_rank",
    {**KEY_COLUMNS, "rank": "i", "batch_id": "i"},
    with_bars("SELECT Symbol, Date, rank, rank // 64 AS batch_id FROM o", SUPPLIER_BARS, _RANKED),
)
def global_rank(spark, sf_dir):
    return sequences.with_batches(splits.with_rank(market.supplier_bars(spark, sf_dir)), 64)


@check(
    "latest_rows",
    BAR_COLUMNS,
    with_bars(
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Date DESC) AS age, count(*) OVER (PARTITION BY Symbol) AS n"
        " FROM bars) WHERE age <= 30 AND n >= 530",
        SUPPLIER_BARS,
    ),
)
def latest_rows(spark, sf_dir):
    return splits.latest_rows(market.supplier_bars(spark, sf_dir), 30, 500)


@check(
    "largest_volumes",
    {"Symbol": "s", "Volume": 3, "place": "i"},
    with_bars(
        "SELECT Symbol, v AS Volume, row_number() OVER (ORDER BY v DESC, Symbol) AS place FROM"
        " (SELECT Symbol, sum(Volume) AS v FROM bars GROUP BY 1) ORDER BY v DESC, Symbol LIMIT 25",
        SUPPLIER_BARS,
    ),
)
def largest_volumes(spark, sf_dir):
    totals = market.supplier_bars(spark, sf_dir).groupBy("Symbol").agg(F.sum("Volume").alias("Volume"))
    return splits.top_rows(totals, "Volume", 25, "Symbol")


# --- scaling --------------------------------------------------------------------------

_SCALED = ["Close", "Volume", "Return"]


def _scaled_sql(rows, kind):
    parts = []
    for c in _SCALED:
        if kind == "minmax":
            parts.append(
                f"coalesce(({c} - (SELECT min({c}) FROM {rows})) / (SELECT coalesce(nullif(max({c}) - min({c}), 0), 1) FROM {rows}), 0.5) AS {c}"
            )
        else:
            q = f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"
            parts.append(
                f"coalesce(({c} - (SELECT quantile_cont({c}, 0.5) FROM {rows})) / (SELECT coalesce(nullif({q}, 0), 1) FROM {rows}), 0) AS {c}"
            )
    return ", ".join(parts)


def _returns(spark, sf_dir):
    return panel.with_features(market.supplier_bars(spark, sf_dir), ["Return"]).select("Symbol", "Date", *_SCALED)


for _kind in ("minmax", "robust"):

    @check(
        f"scaled_{_kind}",
        {**KEY_COLUMNS, **{c: 6 for c in _SCALED}},
        with_bars(f"SELECT Symbol, Date, {_scaled_sql('r', _kind)} FROM r", SUPPLIER_BARS, RETURN_LAYER),
    )
    def scaled(spark, sf_dir, kind=_kind):
        return scaling.normalize_features(_returns(spark, sf_dir), kind=kind)

    @check(
        f"scaled_by_train_{_kind}",
        {**KEY_COLUMNS, **{c: 6 for c in _SCALED}},
        with_bars(
            f"SELECT Symbol, Date, {_scaled_sql('t', _kind)} FROM o",
            SUPPLIER_BARS,
            RETURN_LAYER
            + ",\no AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY Date, Symbol) - 1 AS rank, count(*) OVER () AS n FROM r),"
            + "\nt AS (SELECT * FROM o WHERE rank < floor(n * 0.8))",
        ),
    )
    def scaled_by_train(spark, sf_dir, kind=_kind):
        parts = splits.split_train_test(_returns(spark, sf_dir), 0.2)
        return scaling.normalize_split(parts, _SCALED, kind)


@check(
    "column_quantiles",
    {"column": "s", "p": 2, "n": "i", "value": 6},
    with_bars(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {p} AS p, count({c}) AS n, quantile_cont({c}, {p}) AS value FROM r"
            for c in _SCALED
            for p in (0.25, 0.5, 0.75)
        ),
        SUPPLIER_BARS,
        RETURN_LAYER,
    ),
)
def column_quantiles(spark, sf_dir):
    return scaling.column_quantiles(_returns(spark, sf_dir), _SCALED, [0.25, 0.5, 0.75])


@check(
    "degenerate_scaling",
    {**KEY_COLUMNS, "flat": 6, "unknown": 6, "rare": 6, "flat_m": 6, "unknown_m": 6},
    with_bars(
        "SELECT Symbol, Date, 0.0 AS flat, 0.0 AS unknown, CASE WHEN Volume > 49 THEN Volume ELSE 0 END - (SELECT quantile_cont(CASE WHEN Volume > 49 THEN Volume ELSE 0 END, 0.5) FROM bars) AS rare,"
        " 0.0 AS flat_m, 0.5 AS unknown_m FROM bars",
        SUPPLIER_BARS,
    ),
)
def degenerate_scaling(spark, sf_dir):
    """Columns that do not vary, are unknown throughout, or vary outside their quartiles only."""
    bars = market.supplier_bars(spark, sf_dir)
    rare = F.when(F.col("Volume") > 49, F.col("Volume")).otherwise(0.0).alias("rare")
    rows = bars.select("Symbol", "Date", F.lit(3.0).alias("flat"), F.lit(None).cast("double").alias("unknown"), rare)
    rows = scaling.fit_scaler(rows, ["flat", "unknown", "rare"]).transform(rows)
    more = rows.select("*", F.lit(3.0).alias("flat_m"), F.lit(None).cast("double").alias("unknown_m"))
    return scaling.fit_scaler(more, ["flat_m", "unknown_m"], "minmax").transform(more)


@check(
    "cleaned_and_filled",
    {**KEY_COLUMNS, "Volume": 6, "PB": 6, "Missing": 6},
    with_bars(
        "SELECT Symbol, Date, coalesce(v, avg(v) OVER (PARTITION BY Symbol), 0) AS Volume,"
        " 0.0 AS PB, 0.0 AS Missing FROM (SELECT *, CASE WHEN Volume < 40 THEN Volume END AS v FROM bars)",
        SUPPLIER_BARS,
    ),
)
def cleaned_and_filled(spark, sf_dir):
    bars = market.supplier_bars(spark, sf_dir)
    infinite = F.when(F.col("Volume") < 40, F.col("Volume")).otherwise(F.lit(float("inf")))
    bars = bars.select("Symbol", "Date", infinite.alias("Volume"), F.lit(float("nan")).alias("PB"))
    bars = cleaning.finite_or_null(bars, ["Volume", "PB"])
    aligned = cleaning.align_features(bars, ["PB", "Volume", "Missing"], keep=["Symbol", "Date"])
    return cleaning.fill_with_mean(aligned, ["Volume", "PB", "Missing"])


# --- sequences --------------------------------------------------------------------------


@check(
    "sequence_windows",
    {**KEY_COLUMNS, "label": "i", "rows": "i", "oldest": 4, "newest": 4, "total": 3},
    with_bars(
        "SELECT Symbol, Date, CASE WHEN ahead > 0 THEN 1 ELSE 0 END AS label, 30 AS rows, oldest, newest, total FROM s WHERE n = 30",
        SUPPLIER_BARS,
        layer(
            "s",
            "bars",
            {
                "ahead": "lead(Close) OVER w / nullif(Close, 0) - 1",
                "n": "count(*) OVER before30",
                "oldest": "lag(CAST(Volume AS FLOAT), 30) OVER w",
                "newest": "lag(CAST(Volume AS FLOAT), 1) OVER w",
                "total": "sum(CAST(Volume AS FLOAT)) OVER before30",
            },
        ),
    ),
)
def sequence_windows(spark, sf_dir):
    rows = panel.with_features(market.supplier_bars(spark, sf_dir), ["Target_Direction_1d"])
    seqs = sequences.sequences(rows, ["Volume", "Close"], "Target_Direction_1d", 30)
    first = F.transform("sequence", lambda v: v[0].cast("double"))
    return seqs.select(
        "Symbol",
        "Date",
        "label",
        F.size("sequence").alias("rows"),
        first[0].alias("oldest"),
        first[29].alias("newest"),
        F.aggregate(first, F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@check(
    "multi_horizon_sequences",
    {**KEY_COLUMNS, **{f"h{h}": "i" for h in HORIZONS}},
    with_bars(
        "SELECT * FROM s WHERE n = 30",
        SUPPLIER_BARS,
        layer(
            "s",
            "bars",
            {f"h{h}": f"CASE WHEN lead(Close, {h}) OVER w / nullif(Close, 0) - 1 > 0 THEN 1 ELSE 0 END" for h in HORIZONS}
            | {"n": "count(*) OVER before30"},
        ),
    ),
)
def multi_horizon_sequences(spark, sf_dir):
    names = [f"Target_Direction_{h}d" for h in HORIZONS]
    rows = panel.with_features(market.supplier_bars(spark, sf_dir), names)
    seqs = sequences.multi_target_sequences(rows, ["Close"], 30)
    return seqs.select("Symbol", "Date", *[F.col("labels")[f"h{h}"].alias(f"h{h}") for h in HORIZONS])


def _draw_sql(state, counter):
    """The generator of ``sequences.draw`` in SQL."""
    x = f"(({state} + ({counter}) * 2654435769) % 4294967296 * 747796405 + 2891336453) % 4294967296"
    x = f"(xor({x}, ({x}) >> 16) * 668265263 % 4294967296)"
    return f"((xor({x}, {x} >> 15) + 1) / 4294967296.0::DOUBLE)"


def _state_sql(use):
    return f"('0x' || substr(md5('42|{use}|' || Symbol || '|' || strftime(Date, '%Y-%m-%d')), 1, 8))::BIGINT"


@check(
    "augmented_sequences",
    {**KEY_COLUMNS, "label": "i", "total": 4},
    with_bars(
        "SELECT s.Symbol, s.Date, any_value(label) AS label, sum(CASE WHEN u > 0.05 THEN CAST(CAST(x + 0.02 * sqrt(-2 * ln(a)) * cos(2 * pi() * b) AS FLOAT) AS DOUBLE) ELSE 0 END"
        " ORDER BY step, j) AS total FROM (SELECT s.Symbol, s.Date, s.label, v.j, o.rn - s.rn + 30 AS step, CASE v.j WHEN 0 THEN CAST(o.Volume AS FLOAT) ELSE CAST(o.Close AS FLOAT) END AS x,"
        f" {_draw_sql('s.masks', 'v.j')} AS u, {_draw_sql('s.noise', '((o.rn - s.rn + 30) * 2 + v.j) * 2')} AS a, {_draw_sql('s.noise', '((o.rn - s.rn + 30) * 2 + v.j) * 2 + 1')} AS b"
        " FROM s JOIN s o ON o.Symbol = s.Symbol AND o.rn BETWEEN s.rn - 30 AND s.rn - 1, (VALUES (0), (1)) v(j) WHERE s.rn > 30) s GROUP BY 1, 2",
        SUPPLIER_BARS,
        "s AS MATERIALIZED (SELECT *, row_number() OVER w AS rn, CASE WHEN lead(Close) OVER w / nullif(Close, 0) - 1 > 0 THEN 1 ELSE 0 END AS label,"
        f" {_state_sql('noise')} AS noise, {_state_sql('mask')} AS masks FROM bars WINDOW w AS (PARTITION BY Symbol ORDER BY Date))",
    ),
)
def augmented_sequences(spark, sf_dir):
    rows = panel.with_features(market.supplier_bars(spark, sf_dir), ["Target_Direction_1d"])
    seqs = sequences.sequences(rows, ["Volume", "Close"], "Target_Direction_1d", 30)
    noisy = sequences.mask_features(sequences.add_noise(seqs))
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return noisy.select("Symbol", "Date", "label", total.alias("total"))


# --- metrics ------------------------------------------------------------------------------

_SCORED_SQL = layer(
    "a",
    "bars",
    {
        "ma": full("avg", "Close", 20),
        "y": "lead(Close) OVER w / nullif(Close, 0) - 1",
    },
) + (
    ",\nscored AS MATERIALIZED (SELECT Symbol, Date, CASE WHEN y > 0 THEN 1 ELSE 0 END AS label, y,"
    " round(20 * (Close / nullif(ma, 0) - 1), 3) AS score, year(Date) AS fold FROM a WHERE ma IS NOT NULL AND y IS NOT NULL)"
)


def scored_rows(spark, sf_dir):
    rows = panel.with_features(
        market.supplier_bars(spark, sf_dir), ["Close_to_MA_20", "Target_Direction_1d", "Target_Return_1d"]
    ).dropna(subset=["Close_to_MA_20", "Target_Return_1d"])
    return rows.select(
        "Symbol",
        "Date",
        F.col("Target_Direction_1d").alias("label"),
        F.col("Target_Return_1d").alias("y"),
        F.round(20 * F.col("Close_to_MA_20"), 3).alias("score"),
        F.year("Date").alias("fold"),
    )


def metric_check(name, columns, body):
    return check(name, columns, with_bars(body, SUPPLIER_BARS, _SCORED_SQL))


_SOFT = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_BCE = f"({{w}} * {{y}} * {_SOFT.format(x='(-score)')} + (1 - {{y}}) * {_SOFT.format(x='score')})"


def _bce(y="label", w="1"):
    return _BCE.format(y=y, w=w)


@metric_check(
    "classification_metrics",
    {"fold": "i", "rows": "i", "accuracy": 8, "precision": 8, "recall": 8, "f1": 8},
    "SELECT fold, n AS rows, (n - fp - fn) * 1.0 / n AS accuracy, coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) AS precision,"
    " coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM"
    " (SELECT fold, count(*) AS n, count(*) FILTER (score > 0 AND label = 1) AS tp, count(*) FILTER (score > 0 AND label = 0) AS fp,"
    " count(*) FILTER (score <= 0 AND label = 1) AS fn FROM scored GROUP BY fold)",
)
def classification_metrics(spark, sf_dir):
    return metrics.classification_metrics(scored_rows(spark, sf_dir), ["fold"])


_AUC = (
    "SELECT {keep} (sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2.0) / (p * (n - p) * 1.0) AS roc_auc FROM"
    " (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS r,"
    " sum(label) OVER (PARTITION BY {by}) AS p, count(*) OVER (PARTITION BY {by}) AS n FROM scored) GROUP BY {group} p, n"
)


@metric_check("roc_auc", {"roc_auc": 8}, _AUC.format(keep="", by="1", group=""))
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored_rows(spark, sf_dir))


@metric_check("roc_auc_by_fold", {"fold": "i", "roc_auc": 8}, _AUC.format(keep="fold,", by="fold", group="fold,"))
def roc_auc_by_fold(spark, sf_dir):
    return metrics.roc_auc(scored_rows(spark, sf_dir), ["fold"])


@metric_check(
    "regression_metrics",
    {"rows": "i", "mse": 5, "rmse": 6, "r2": 8},
    "SELECT count(*) AS rows, avg((y - score) * (y - score)) AS mse, sqrt(avg((y - score) * (y - score))) AS rmse,"
    " 1 - avg((y - score) * (y - score)) / var_pop(y) AS r2 FROM scored",
)
def regression_metrics(spark, sf_dir):
    return metrics.regression_metrics(scored_rows(spark, sf_dir))


@metric_check(
    "losses",
    {"kind": "s", "loss": 7},
    f"SELECT 'bce' AS kind, avg({_bce()}) AS loss FROM scored UNION ALL"
    f" SELECT 'weighted', avg({_bce(w='(SELECT count(*) FILTER (label = 0) * 1.0 / count(*) FILTER (label = 1) FROM scored)')}) FROM scored UNION ALL"
    f" SELECT 'focal', avg(0.25 * pow(1 - exp(-{_bce()}), 2) * {_bce()}) FROM scored UNION ALL"
    f" SELECT 'smoothed', avg({_bce('(label * 0.9 + 0.05)')}) FROM scored UNION ALL"
    " SELECT 'mse', avg((y - score) * (y - score)) FROM scored",
)
def losses(spark, sf_dir):
    rows = scored_rows(spark, sf_dir)
    weight = metrics.positive_weight(rows).scalar()
    weighted = rows.withColumn("w", weight)
    parts = {
        "bce": metrics.loss(rows),
        "weighted": metrics.loss(weighted, "bce", pos_weight=F.col("w")),
        "focal": metrics.loss(rows, "focal"),
        "smoothed": metrics.loss(rows, "smoothed", amount=0.1),
        "mse": metrics.loss(rows, "mse"),
    }
    out = None
    for kind, table in parts.items():
        row = table.select(F.lit(kind).alias("kind"), "loss")
        out = row if out is None else out.unionByName(row)
    return out


@metric_check(
    "batch_mean_loss",
    {"batches": "i", "loss": 7},
    f"SELECT count(*) AS batches, avg(l) AS loss FROM (SELECT rank // 64 AS b, avg({_bce()}) AS l FROM"
    " (SELECT *, row_number() OVER (ORDER BY Date, Symbol) - 1 AS rank FROM scored) GROUP BY 1)",
)
def batch_mean_loss(spark, sf_dir):
    return metrics.batch_mean_loss(sequences.with_batches(scored_rows(spark, sf_dir), 64))


@metric_check(
    "class_balance",
    {"fold": "i", "pos_weight": 8},
    "SELECT fold, count(*) FILTER (label = 0) * 1.0 / nullif(count(*) FILTER (label = 1), 0) AS pos_weight FROM scored GROUP BY fold",
)
def class_balance(spark, sf_dir):
    return metrics.positive_weight(scored_rows(spark, sf_dir), by=["fold"])


@metric_check(
    "fold_summary",
    {"folds": "i", "mean": 7, "std": 7},
    "SELECT count(*) AS folds, avg(f) AS mean, stddev_pop(f) AS std FROM"
    " (SELECT fold, sqrt(avg((y - score) * (y - score))) AS f FROM scored GROUP BY fold)",
)
def fold_summary(spark, sf_dir):
    return metrics.fold_summary(metrics.regression_metrics(scored_rows(spark, sf_dir), ["fold"]), "rmse")


@metric_check(
    "best_epoch",
    {"epoch": "i", "rmse": 6},
    "SELECT fold AS epoch, f AS rmse FROM (SELECT fold, sqrt(avg((y - score) * (y - score))) AS f FROM scored GROUP BY fold)"
    " ORDER BY f, fold LIMIT 1",
)
def best_epoch(spark, sf_dir):
    folds = metrics.regression_metrics(scored_rows(spark, sf_dir), ["fold"]).withColumnRenamed("fold", "epoch")
    return metrics.best_epoch(folds, "rmse", larger_is_better=False)


@metric_check(
    "last_epochs",
    {"epoch": "i", "rmse": 6},
    "SELECT fold AS epoch, sqrt(avg((y - score) * (y - score))) AS rmse FROM scored GROUP BY fold ORDER BY fold DESC LIMIT 3",
)
def last_epochs(spark, sf_dir):
    folds = metrics.regression_metrics(scored_rows(spark, sf_dir), ["fold"]).withColumnRenamed("fold", "epoch")
    return metrics.last_epochs(folds, 3)


@check(
    "multi_horizon_loss",
    {"loss": 7},
    with_bars(
        "SELECT avg(l) AS loss FROM (SELECT h, avg(" + _bce() + ") AS l FROM q GROUP BY h)",
        SUPPLIER_BARS,
        layer("a", "bars", {"ma": full("avg", "Close", 20)} | {f"y{h}": f"lead(Close, {h}) OVER w / nullif(Close, 0) - 1" for h in HORIZONS})
        + ",\nq AS (SELECT h, CASE WHEN h = 1 THEN (y1 > 0) WHEN h = 5 THEN (y5 > 0) WHEN h = 10 THEN (y10 > 0) ELSE (y21 > 0) END AS up,"
        " CASE WHEN up THEN 1 ELSE 0 END AS label, round(20 * (Close / nullif(ma, 0) - 1), 3) AS score"
        " FROM a, (VALUES (1), (5), (10), (21)) v(h) WHERE ma IS NOT NULL)",
    ),
)
def multi_horizon_loss(spark, sf_dir):
    rows = panel.with_features(
        market.supplier_bars(spark, sf_dir), ["Close_to_MA_20"] + [f"Target_Direction_{h}d" for h in HORIZONS]
    ).dropna(subset=["Close_to_MA_20"])
    score = F.round(20 * F.col("Close_to_MA_20"), 3)
    heads = [F.col(f"Target_Direction_{h}d").alias(f"label_{h}") for h in HORIZONS]
    return metrics.multi_horizon_loss(rows.select(*heads, *[score.alias(f"score_{h}") for h in HORIZONS]), HORIZONS)


# --- scoring and models ---------------------------------------------------------------------


@metric_check(
    "prediction_table",
    {"Symbol": "s", "Date": "s", "Horizon_Days": "i", "Pred_Prob": 4, "Direction": "s", "Confidence": 4, "Band": "s", "Bar": "i"},
    "SELECT Symbol, strftime(Date, '%Y-%m-%d') AS Date, 5 AS Horizon_Days, round(p, 4) AS Pred_Prob,"
    " CASE WHEN p > 0.5 THEN 'UP ▲' ELSE 'DOWN ▼' END AS Direction, round(abs(p - 0.5) * 2, 4) AS Confidence,"
    " CASE WHEN round(p, 4) > 0.55 THEN 'up' WHEN round(p, 4) < 0.45 THEN 'down' ELSE 'flat' END AS Band,"
    " CAST(floor(round(abs(p - 0.5) * 2, 4) * 18) AS INT) AS Bar FROM (SELECT *, 1 / (1 + exp(-score)) AS p FROM scored)",
)
def prediction_table(spark, sf_dir):
    rows = scored_rows(spark, sf_dir).withColumn("Close", F.lit(1.0))
    return scoring.by_probability(scoring.with_bands(scoring.predictions(rows, 5)))


@check(
    "latest_windows",
    {**KEY_COLUMNS, "Close": 6, "rows": "i", "first_volume": 4, "last_volume": 4},
    with_bars(
        "SELECT Symbol, max(Date) AS Date, max(Close) FILTER (age = 1) AS Close, 30 AS rows,"
        " max(Volume) FILTER (age = 30) AS first_volume, max(Volume) FILTER (age = 1) AS last_volume FROM"
        " (SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Date DESC) AS age FROM bars) WHERE age <= 30 GROUP BY Symbol",
        SUPPLIER_BARS,
    ),
)
def latest_windows(spark, sf_dir):
    newest = scoring.latest_windows(market.supplier_bars(spark, sf_dir), ["Volume", "Close"], 30)
    at = lambda i: F.element_at("sequence", i)[0]
    return newest.select(
        "Symbol", "Date", "Close", F.size("sequence").alias("rows"), at(1).alias("first_volume"), at(-1).alias("last_volume")
    )


MODEL_FEATURES = ["Return", "Close_to_MA_20", "Volatility_20", "Return_Mean_5", "Price_ZScore_20"]


def _model_rows(spark, sf_dir, keep=None):
    names = MODEL_FEATURES + ["Target_Return_1d"] + [f"Target_Direction_{h}d" for h in HORIZONS]
    rows = panel.with_features(market.supplier_bars(spark, sf_dir), names)
    rows = rows.select("Symbol", "Date", "Close", *names).dropna(subset=MODEL_FEATURES + ["Target_Return_1d"])
    # several passes read these rows; a real job would read a stored panel
    return (rows if keep is None else rows.select("Symbol", "Date", *keep)).persist()


def model_check(name, columns, body, *layers):
    """A check over the rows that models are fitted on."""
    return check(name, columns, with_bars(body, SUPPLIER_BARS, ",\n".join([M.MODEL_ROWS, *layers])))


_TESTED = M.QUALITY.format(rows="NOT tr")


@model_check(
    "direction_model",
    {"rows": "i", "accuracy": 6, "precision": 6, "recall": 6, "f1": 6, "roc_auc": 6, "loss": 6},
    "SELECT * FROM quality",
    M.single(0.8, "d1"),
    M.logistic(),
    _TESTED,
)
def direction_model(spark, sf_dir):
    parts = splits.split_train_test(_model_rows(spark, sf_dir), 0.2)
    ready = scaling.normalize_split(parts, MODEL_FEATURES).persist()
    model = training.fit(ready.filter("split = 'train'"), MODEL_FEATURES, "Target_Direction_1d")
    scored = training.apply(model, ready.filter("split = 'test'")).persist()
    return training.evaluate(scored, "Target_Direction_1d")


@model_check("return_model", {"rows": "i", "mse": 5, "rmse": 6, "r2": 6}, M.ERRORS, M.single(0.8, "y"), M.least_squares())
def return_model(spark, sf_dir):
    parts = splits.split_train_test(_model_rows(spark, sf_dir), 0.2)
    ready = scaling.normalize_split(parts, MODEL_FEATURES).persist()
    model = training.fit(ready.filter("split = 'train'"), MODEL_FEATURES, "Target_Return_1d", regression=True)
    return training.evaluate(training.apply(model, ready.filter("split = 'test'")), "Target_Return_1d", True)


@model_check(
    "horizon_models",
    {"horizon": "i", "rows": "i", "roc_auc": 6},
    "SELECT fold AS horizon, rows, roc_auc FROM quality",
    f"q AS MATERIALIZED (SELECT h AS fold, true AS tr, {', '.join(M.X)}, CASE h WHEN 1 THEN d1 WHEN 5 THEN d5 WHEN 10 THEN d10 ELSE d21 END AS label FROM o, (VALUES (1), (5), (10), (21)) v(h))",
    M.logistic(),
    M.QUALITY.format(rows="true"),
)
def horizon_models(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    scaled = scaling.fit_scaler(rows, MODEL_FEATURES).transform(rows)
    models = training.fit_horizons(scaled, MODEL_FEATURES)
    scored = training.apply_horizons(models, scaled)
    label = F.create_map(*[x for h in HORIZONS for x in (F.lit(h), F.col(f"Target_Direction_{h}d"))])[F.col("horizon")]
    scored = scored.withColumn("label", label.cast("double"))
    counts = scored.groupBy("horizon").agg(F.count("*").alias("rows"))
    return counts.join(metrics.roc_auc(scored, ["horizon"]), "horizon")


@model_check(
    "walk_forward_validation",
    {"fold": "i", "rows": "i", "accuracy": 6, "roc_auc": 6, "loss": 6},
    "SELECT * FROM quality",
    M.folds(3, 0.1, "d1"),
    M.logistic(),
    _TESTED,
)
def walk_forward_validation(spark, sf_dir):
    return training.walk_forward_validate(_model_rows(spark, sf_dir), MODEL_FEATURES, n_splits=3)


def _searched(ridge, fit, quality, metric):
    """The mean and deviation of a metric over folds for one penalty, a query of its own."""
    train = "b AS MATERIALIZED (SELECT * REPLACE (floor(n * 0.8) AS n) FROM o WHERE rank < floor(n * 0.8))"
    target = "d1" if fit is M.logistic else "y"
    parts = ",\n".join(x for x in (train, M.folds(2, 0.1, target, "b"), fit(ridge), quality) if x)
    table = "quality" if quality else f"({M.ERRORS})"
    return f"SELECT '{{\"regParam\": {ridge}}}' AS options, avg({metric}) AS mean, stddev_pop({metric}) AS std FROM (WITH {parts}\nSELECT * FROM {table})"


@check(
    "model_search",
    {"options": "s", "mean": 6, "std": 6},
    with_bars(" UNION ALL ".join(_searched(r, M.logistic, _TESTED, "roc_auc") for r in (0.0, 0.1)), SUPPLIER_BARS, M.MODEL_ROWS),
)
def model_search(spark, sf_dir):
    rows = splits.split_train_test(_model_rows(spark, sf_dir), 0.2).filter("split = 'train'").drop("split").persist()
    return training.search(rows, MODEL_FEATURES, {"regParam": [0.0, 0.1]}, n_splits=2)[1]


@model_check("least_squares_folds", {"fold": "i", "ridge": 1, "rows": "i", "mse": 5, "rmse": 6, "r2": 6}, f"SELECT *, 0.0 AS ridge FROM ({M.ERRORS})", M.folds(5, 0.1, "y"), M.least_squares())
def least_squares_folds(spark, sf_dir):
    return least_squares.validate(_model_rows(spark, sf_dir), MODEL_FEATURES)


@check(
    "regression_search",
    {"options": "s", "mean": 6, "std": 6},
    with_bars(" UNION ALL ".join(_searched(r, M.least_squares, "", "rmse") for r in (0.0, 0.1)), SUPPLIER_BARS, M.MODEL_ROWS),
)
def regression_search(spark, sf_dir):
    rows = splits.split_train_test(_model_rows(spark, sf_dir), 0.2).filter("split = 'train'").drop("split")
    return least_squares.search(rows, MODEL_FEATURES, [0.0, 0.1], n_splits=2)[1]


_SPANS = " ".join(f"WHEN {j} THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)" for j, c in enumerate(M.X, 1))


@model_check(
    "feature_importance",
    {"Feature": "s", "Importance": 5, "place": "i", "share": 5},
    "SELECT *, row_number() OVER (ORDER BY Importance DESC, Feature) AS place, Importance / max(Importance) OVER () AS share FROM"
    f" (SELECT list_extract({MODEL_FEATURES}, j) AS Feature, abs(slope * span) AS Importance FROM slopes JOIN"
    f" (SELECT v.j, CASE v.j {_SPANS} END AS span FROM o, (VALUES (1), (2), (3), (4), (5)) v(j) GROUP BY v.j) USING (j))",
    "q AS MATERIALIZED (SELECT 1 AS fold, true AS tr, " + ", ".join(M.X) + ", d1 AS label FROM o)",
    M.logistic(),
    M.coefficients(),
)
def feature_importance(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    scaled = scaling.fit_scaler(rows, MODEL_FEATURES).transform(rows)
    return training.feature_importance(training.fit(scaled, MODEL_FEATURES, "Target_Direction_1d"), 25)


_PREDICTED = {"Symbol": "s", "Date": "s", "Close": 2, "Pred_Prob": 4, "Direction": "s", "Confidence": 4}
_CARRIED = "Symbol, Date, Close"


@model_check("latest_predictions", _PREDICTED, M.PREDICTED, M.NEWEST, M.logistic(carry=_CARRIED))
def latest_predictions(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    scaler = scaling.fit_scaler(rows, MODEL_FEATURES)
    model = training.fit(scaler.transform(rows), MODEL_FEATURES, "Target_Direction_1d")
    newest = panel.with_features(market.supplier_bars(spark, sf_dir), MODEL_FEATURES)
    return scoring.predict(newest, model, scaler, MODEL_FEATURES)




@check(
    "lookback_predictions",
    _PREDICTED,
    with_bars(
        M.PREDICTED,
        f"SELECT * FROM ({SUPPLIER_BARS}) WHERE Date >= DATE '1998-06-30' - 900 AND Date <= DATE '1998-06-30'",
        ",\n".join([M.MODEL_ROWS, M.NEWEST, M.logistic(carry=_CARRIED)]),
    ),
)
def lookback_predictions(spark, sf_dir):
    bars = market.supplier_bars(spark, sf_dir)
    recent = B.between(bars, *[F.lit(d).cast("date") for d in ("1996-01-12", "1998-07-01")])
    names = MODEL_FEATURES + ["Target_Return_1d", "Target_Direction_1d"]
    rows = panel.with_features(recent, names).select("Symbol", "Date", *names).dropna(subset=MODEL_FEATURES + ["Target_Return_1d"])
    scaler = scaling.fit_scaler(rows, MODEL_FEATURES)
    model = training.fit(scaler.transform(rows), MODEL_FEATURES, "Target_Direction_1d")
    return scoring.predict_newest(bars, model, scaler, MODEL_FEATURES, today="1998-06-30", lookback=900)


_FIXED_SCORE = {"Return": 3.0, "Close_to_MA_20": 20.0, "Volatility_20": -0.5, "Return_Mean_5": 10.0, "Price_ZScore_20": 0.2}


@model_check(
    "permutation_importance",
    {"Feature": "s", "roc_auc": 8, "Importance": 8, "place": "i"},
    "SELECT *, row_number() OVER (ORDER BY Importance DESC, Feature) AS place FROM (SELECT Feature, roc_auc, max(roc_auc) FILTER (Feature = '') OVER () - roc_auc AS Importance FROM"
    " (SELECT Feature, (sum(r) FILTER (d1 = 1) - sum(d1) * (sum(d1) + 1) / 2.0) / (sum(d1) * (count(*) - sum(d1)) * 1.0) AS roc_auc FROM"
    " (SELECT *, rank() OVER (PARTITION BY Feature ORDER BY score) + (count(*) OVER (PARTITION BY Feature, score) - 1) / 2.0 AS r FROM e) GROUP BY 1)) WHERE Feature <> ''",
    "h AS (SELECT " + ", ".join(f"{c} AS h{c}" for c in M.X) + ", row_number() OVER (ORDER BY md5('42|' || Symbol || '|' || strftime(Date, '%Y-%m-%d')), Symbol, Date) - 1 AS rank FROM o)",
    "e AS (SELECT Feature, d1, "
    + " + ".join(f"{w} * CASE WHEN Feature = '{name}' THEN h{c} ELSE {c} END" for c, (name, w) in zip(M.X, _FIXED_SCORE.items()))
    + " AS score FROM o JOIN h USING (rank), (VALUES (''), " + ", ".join(f"('{n}')" for n in _FIXED_SCORE) + ") v(Feature))",
)
def permutation_importance(spark, sf_dir):
    def score(rows):
        made = None
        for name, w in _FIXED_SCORE.items():
            part = F.lit(w) * F.col(name)
            made = part if made is None else made + part
        return rows.withColumn("score", made)

    rows = _model_rows(spark, sf_dir, MODEL_FEATURES + ["Target_Direction_1d"])
    return training.permutation_importance(rows, MODEL_FEATURES, score, "Target_Direction_1d")


@check(
    "context_reader",
    {"ctx_symbol": "s", "Date": "d", "Close": 6},
    f"SELECT ctx_symbol, Date, Close FROM ({CONTEXT}) WHERE ctx_symbol IN ('SPY', 'VIX', 'XLK') AND Date >= DATE '1996-02-01' AND Date < DATE '1999-01-01'",
)
def context_reader(spark, sf_dir):
    """The context with the vendor's caret before the index."""
    raw = market.context_bars(spark, sf_dir)
    raw = raw.withColumn("ctx_symbol", F.when(F.col("ctx_symbol") == "VIX", "^VIX").otherwise(F.col("ctx_symbol")))
    return context_source.normalize_context(raw, "1996-02-01", "1999-01-01", ["SPY", "^VIX", "XLK"])
