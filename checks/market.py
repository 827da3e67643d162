"""Market data derived from the provided tables, in Spark and in SQL.

``type`` bars use the part type as symbol (6 liquid symbols), ``supplier`` bars
use the supplier (a universe that grows with the data, sparse histories).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources import bars as B
from barloom.sources import universe

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(ticks, symbol):
    return B.bars_from_ticks(
        ticks,
        symbol=symbol,
        date=F.col("l_shipdate"),
        price=F.col("l_extendedprice") / F.col("l_quantity"),
        size=F.col("l_quantity"),
        order=[F.col(c) for c in _ORDER],
    )


def type_bars(spark, sf_dir):
    ticks = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return _bars(ticks, F.col("p_type"))


def supplier_bars(spark, sf_dir):
    symbol = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    return _bars(table(spark, sf_dir, "lineitem"), symbol)


def context_bars(spark, sf_dir):
    """Long context closes: the broad market, the volatility index, sector funds."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    priced = lines.select(
        F.col("p_type").alias("Symbol"),
        F.col("l_shipdate").cast("date").alias("Date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
    )
    # per-day sums first, so each series is a re-aggregation of a small table
    daily = priced.groupBy("Symbol", "Date").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    market = daily.groupBy("Date").agg((F.sum("s") / F.sum("n")).alias("Close"))
    funds = (
        daily.join(F.broadcast(type_sectors(spark)), "Symbol")
        .join(F.broadcast(universe.sector_etf_table(spark)), "Sector")
        .groupBy("ETF", "Date")
        .agg((F.sum("s") / F.sum("n")).alias("Close"))
    )
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("Date")).agg(
        F.avg("o_totalprice").alias("a")
    )
    top = orders.agg(F.max("a").alias("m"))
    index = orders.select("Date", (15 + 30 * F.col("a") / top.scalar()).alias("Close"))
    return (
        market.select(F.lit("SPY").alias("ctx_symbol"), "Date", "Close")
        .unionByName(index.select(F.lit("VIX").alias("ctx_symbol"), "Date", "Close"))
        .unionByName(funds.select(F.col("ETF").alias("ctx_symbol"), "Date", "Close"))
    )


TYPE_SECTORS = [
    ("ECONOMY", "Technology"),
    ("LARGE", "Finance"),
    ("MEDIUM", "Healthcare"),
    ("SMALL", "Energy"),
    ("STANDARD", "Utilities"),
]


def type_sectors(spark):
    """PROMO is left out on purpose: it falls to the default sector."""
    return spark.createDataFrame(TYPE_SECTORS, "Symbol string, Sector string")


def type_fundamentals(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.groupBy(F.col("p_type").alias("Symbol")).agg(
        F.avg("p_size").alias("PE_Ratio"),
        F.when(F.col("p_type") != "PROMO", F.avg("p_retailprice") / 1000).alias("PB_Ratio"),
        F.when(F.col("p_type") != "SMALL", F.sum("p_retailprice")).alias("marketCap"),
        F.lit(1.1).alias("Beta"),
        F.when(F.col("p_type") != "LARGE", F.min("p_size") / 100).alias("Dividend_Yield"),
        (F.max("p_size") / 500).alias("Profit_Margin"),
        F.when(F.col("p_type") != "LARGE", F.lit(0.05)).alias("Revenue_Growth"),
    )


# --- the same inputs as SQL ---------------------------------------------------

_KEY_SQL = ", ".join(_ORDER)


def _bars_sql(symbol, source):
    return f"""
    SELECT {symbol} AS Symbol, CAST(l_shipdate AS DATE) AS Date,
           first(l_extendedprice / l_quantity ORDER BY {_KEY_SQL}) AS Open,
           max(l_extendedprice / l_quantity) AS High,
           min(l_extendedprice / l_quantity) AS Low,
           last(l_extendedprice / l_quantity ORDER BY {_KEY_SQL}) AS Close,
           sum(l_quantity) AS Volume
    FROM {source} GROUP BY 1, 2"""


TYPE_BARS = _bars_sql("p_type", "lineitem JOIN part ON l_partkey = p_partkey")
SUPPLIER_BARS = _bars_sql("'S' || CAST(l_suppkey AS VARCHAR)", "lineitem")

SECTOR_VALUES = ", ".join(f"('{s}', '{x}')" for s, x in TYPE_SECTORS)
CONTEXT = f"""
    SELECT 'SPY' AS ctx_symbol, CAST(l_shipdate AS DATE) AS Date, avg(l_extendedprice / l_quantity) AS Close
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 2
    UNION ALL
    SELECT 'VIX', Date, 15 + 30 * a / max(a) OVER ()
    FROM (SELECT CAST(o_orderdate AS DATE) AS Date, avg(o_totalprice) AS a FROM orders GROUP BY 1)
    UNION ALL
    SELECT etf, CAST(l_shipdate AS DATE), avg(l_extendedprice / l_quantity)
    FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN (VALUES ('ECONOMY', 'XLK'), ('LARGE', 'XLF'), ('MEDIUM', 'XLV'), ('SMALL', 'XLE'), ('STANDARD', 'XLU')) m(sym, etf)
      ON sym = p_type
    GROUP BY 1, 2"""


def with_bars(body: str, bars: str = TYPE_BARS, extra: str = "", recursive: bool = False) -> str:
    """``WITH bars AS (...)`` in front of ``body``; ``extra`` holds further CTEs."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    more = f",\n{extra}" if extra else ""
    return f"{head} bars AS MATERIALIZED ({bars}){more}\n{body}"
