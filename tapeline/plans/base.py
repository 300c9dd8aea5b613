"""Table access, shared inputs and SQL fragments for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeline.operators import candles


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A driver table; zone-less stamps are taken as session time (UTC)."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps}) if stamps else df


def trades(spark, directory) -> DataFrame:
    return candles.trades_of_events(table(spark, directory, "events"))


def brand_trades(spark, directory) -> DataFrame:
    return candles.trades_of_lineitem(table(spark, directory, "lineitem"), table(spark, directory, "part"))


def hourly(spark, directory) -> DataFrame:
    return candles.bars_of_trades(trades(spark, directory), "1h")


def daily(spark, directory) -> DataFrame:
    return candles.bars_of_trades(brand_trades(spark, directory), "1d")


def r(value: Column | str, places: int = 6) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), places) + F.lit(0.0)


def show(df: DataFrame, *columns: str, **rounded: int) -> DataFrame:
    """Key columns as they are, the others rounded; places by keyword, else six."""
    out = []
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        out.append(r(c, rounded.get(c, 6)).alias(c) if kind in ("double", "float") else F.col(c))
    return df.select(*out)


def R(expr: str, places: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {places}) + 0.0)"


def rows(n: int, upto: int = 0, part: str = "symbol", order: str = "ts") -> str:
    """OVER clause of a trailing frame of n rows that ends -upto rows back."""
    edge = "CURRENT ROW" if upto == 0 else f"{-upto} PRECEDING"
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1 - upto} PRECEDING AND {edge})"


def roll(agg: str, value: str, n: int, upto: int = 0, least: int | None = None) -> str:
    """SQL of a full trailing frame; agg holds {} for the value."""
    over = rows(n, upto)
    return f"CASE WHEN count({value}) {over} >= {least or n} THEN {agg.format(value)} {over} END"


W = "OVER (PARTITION BY symbol ORDER BY ts)"
RUN = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"

TRADES_SQL = """tr AS (SELECT event_type AS symbol, ts, event_id AS id, "value" AS px,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS sz FROM events)"""


def bars_sql(name: str, minutes: int, source: str = "tr", order: str = "id") -> str:
    return f"""{name} AS (SELECT symbol, to_timestamp(floor(epoch(ts) / {minutes * 60}) * {minutes * 60})::TIMESTAMP AS ts,
  arg_min(px, row(ts, {order})) AS open, max(px) AS high, min(px) AS low, arg_max(px, row(ts, {order})) AS close,
  sum(sz) AS volume, sum(px * sz) AS amount, count(*) AS ticks FROM {source} GROUP BY 1, 2)"""


HOURLY_SQL = f"{TRADES_SQL}, {bars_sql('c', 60)}"
BRAND_TRADES_SQL = """tr AS (SELECT p_brand AS symbol, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS id,
  l_extendedprice / l_quantity AS px, l_quantity AS sz FROM lineitem JOIN part ON l_partkey = p_partkey)"""
DAILY_SQL = f"{BRAND_TRADES_SQL}, {bars_sql('c', 1440)}"


def ewm_sql(out: str, source: str, col: str, alpha: str, keys: str = "symbol, ts") -> str:
    """CTE of an exponential mean by its definition: weights over all earlier rows of the series."""
    return f"""{out} AS (
  SELECT a.symbol, a.ts, sum(CASE WHEN b.i = 0 THEN 1.0 ELSE {alpha} END * pow(1 - {alpha}, a.i - b.i) * b.x) AS {out}
  FROM (SELECT symbol, ts, {col} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM {source} WHERE {col} IS NOT NULL) a
  JOIN (SELECT symbol, {col} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM {source} WHERE {col} IS NOT NULL) b
    ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2)"""
