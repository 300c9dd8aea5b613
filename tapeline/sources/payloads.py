"""Landed provider payloads to typed tables.  Files are read with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeline.functions.series import ratio
from tapeline.operators.news import identity, plain, published, readable

NUM = "double"


def _bars(symbol: Column, interval: Column, ts: Column, parts: dict[str, Column]) -> list[Column]:
    return [symbol.alias("symbol"), interval.alias("interval"), ts.alias("ts"), *[v.try_cast(NUM).alias(k) for k, v in parts.items()]]


def text_klines(spark: SparkSession, path: str) -> DataFrame:
    """``{"symbol", "interval", "data": {"klines": ["ts,open,close,high,low,volume,amount"]}}`` (close before high)."""
    raw = spark.read.schema("symbol string, interval string, data struct<klines: array<string>>").json(path)
    row = raw.select("symbol", "interval", F.explode("data.klines").alias("_k")).withColumn("_p", F.split("_k", ","))
    at = lambda i: F.get("_p", F.lit(i))
    return row.select(*_bars(F.col("symbol"), F.col("interval"), at(0).try_cast("timestamp"), {"open": at(1), "high": at(3), "low": at(4), "close": at(2), "volume": at(5), "amount": at(6)}))


def columnar_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Parallel arrays of stamps (epoch s) and prices; bars with any missing price are dropped."""
    q = "open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"
    raw = spark.read.schema(f"symbol string, interval string, timestamp array<bigint>, quote struct<{','.join(x.strip().replace(' ', ':', 1) for x in q.split(','))}>").json(path)
    row = raw.select("symbol", "interval", F.inline(F.arrays_zip(F.col("timestamp").alias("t"), F.col("quote.open").alias("open"), F.col("quote.high").alias("high"), F.col("quote.low").alias("low"),
                                                                F.col("quote.close").alias("close"), F.col("quote.volume").alias("volume"))))
    row = row.dropna(subset=["open", "high", "low", "close"])
    return row.select("symbol", "interval", F.timestamp_seconds("t").alias("ts"), "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), (F.coalesce("volume", F.lit(0.0)) * F.col("close")).alias("amount"))


# Column positions per provider layout: (ts, open, high, low, close, volume, amount candidates).
LAYOUTS = {"open_first": (0, 1, 2, 3, 4, 5, (7, 6)), "low_first": (0, 3, 2, 1, 4, 5, ()), "vwap_inside": (0, 1, 2, 3, 4, 6, ())}


def array_klines(spark: SparkSession, path: str, layout: str = "open_first", millis: bool = True) -> DataFrame:
    """``{"symbol", "interval", "data": [[...], ...]}``; without an amount it is volume times close; the last row of a stamp wins."""
    t, o, h, lo, c, v, amounts = LAYOUTS[layout]
    raw = spark.read.schema("symbol string, interval string, data array<array<string>>").json(path)
    row = raw.select("symbol", "interval", F.posexplode("data").alias("_i", "_p"))
    at = lambda i: F.get("_p", F.lit(i))
    ts = F.timestamp_millis(at(t).try_cast("long")) if millis else F.timestamp_seconds(at(t).try_cast("long"))
    amount = F.coalesce(*[at(i).try_cast(NUM) for i in amounts], at(v).try_cast(NUM) * at(c).try_cast(NUM))
    bars = row.select("_i", *_bars(F.col("symbol"), F.col("interval"), ts, {"open": at(o), "high": at(h), "low": at(lo), "close": at(c), "volume": at(v)}), amount.alias("amount"))
    rank = F.row_number().over(Window.partitionBy("symbol", "interval", "ts").orderBy(F.desc("_i")))
    return bars.withColumn("_r", rank).filter("_r = 1").drop("_r", "_i")


def wrapped_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSONP files: the outermost ``[...]`` is the row list; the symbol is the file name."""
    raw = spark.read.text(path, wholetext=True).withColumn("_f", F.input_file_name())
    body = F.regexp_extract("value", r"(?s)(\[.*\])", 1)
    rows = raw.select(F.regexp_extract("_f", r"([^/]+?)\.[^./]*$", 1).alias("symbol"),
                      F.explode(F.from_json(body, "array<struct<day:string,open:string,high:string,low:string,close:string,volume:string>>")).alias("r"))
    return rows.select("symbol", F.col("r.day").try_cast("timestamp").alias("ts"), *[F.col(f"r.{x}").try_cast(NUM).alias(x) for x in ("open", "high", "low", "close", "volume")]).withColumn("amount", F.lit(0.0))


def spaced_rows(rows: DataFrame, column: str = "line") -> DataFrame:
    """``date open close high low volume``; rows with fewer than six fields are skipped."""
    p = F.split(F.trim(column), r"\s+")
    at = lambda i: F.get("_p", F.lit(i))
    return (rows.withColumn("_p", p).filter(F.size("_p") >= 6)
            .select("symbol", at(0).try_cast("timestamp").alias("ts"), *[at(i).try_cast(NUM).alias(n) for n, i in (("open", 1), ("high", 3), ("low", 4), ("close", 2), ("volume", 5))], F.lit(0.0).alias("amount")))


def quotes(rows: DataFrame) -> DataFrame:
    """Price, change and percent change; needs symbol, price, prev_close."""
    c = F.col
    return rows.select("symbol", "price", (c("price") - c("prev_close")).alias("change"), ((ratio(c("price"), c("prev_close")) - 1) * 100).alias("change_percent"))


def first_available(rows: DataFrame, order: list[str], keys: list[str] = ("symbol", "interval")) -> DataFrame:
    """Rows of the first provider, in ``order``, that has any for a key."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("provider"))
    best = rows.filter(place > 0).groupBy(*keys).agg(F.min_by("provider", place).alias("_best"))
    return rows.join(best, list(keys)).filter("provider = _best").drop("_best")


def rss(spark: SparkSession, path: str, provider: str, market: str) -> DataFrame:
    raw = spark.read.schema("title string, link string, description string, pubDate string, source string").option("rowTag", "item").xml(path)
    title, url = plain(F.col("title")), F.trim("link")
    return raw.filter(readable(title) & (url != "")).select(
        identity(title, url).alias("id"), title.alias("title"), F.coalesce(F.nullif(plain(F.col("description")), F.lit("")), title).alias("summary"), url.alias("url"),
        F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit(provider)).alias("source"), F.lit(provider).alias("provider"), F.lit(market).alias("market"), published(F.col("pubDate")).alias("published_at"))


def announcements(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("data struct<list: array<struct<title: string, art_code: string, notice_date: string, codes: array<struct<stock_code: string>>>>>").json(path)
    row = raw.select(F.explode("data.list").alias("r"))
    title = plain(F.col("r.title"))
    codes = F.filter(F.transform("r.codes", lambda x: x["stock_code"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return row.filter(readable(title)).select(identity(title, F.coalesce("r.art_code", F.lit(""))).alias("id"), title.alias("title"), codes.alias("symbols"), published(F.col("r.notice_date")).alias("published_at"))


def calendar_risk(spark: SparkSession, path: str, now) -> DataFrame:
    """HIGH if a high-impact event lies within 36 h, MEDIUM if any within 72 h, else LOW."""
    raw = spark.read.schema("title string, country string, impact string, date string").json(path)
    hours = (F.unix_seconds(F.col("date").try_cast("timestamp")) - F.unix_seconds(F.lit(now).cast("timestamp"))) / 3600
    near = raw.withColumn("_h", hours).filter(F.col("impact").isin("High", "Medium") & F.col("_h").between(0, 72))
    high = F.count(F.when((F.col("impact") == "High") & (F.col("_h") <= 36), 1))
    return near.agg(high.alias("_x"), F.count(F.lit(1)).alias("events")).select("events", F.when(F.col("_x") > 0, "HIGH").when(F.col("events") > 0, "MEDIUM").otherwise("LOW").alias("risk"))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Financial statements; rows without a period or an announcement date cannot be placed in time and go."""
    raw = spark.read.schema("symbol string, period string, announcement_date string, revenue double, net_profit double, eps double, roe double").json(path)
    return raw.withColumns({"period": F.col("period").try_cast("date"), "announcement_date": F.col("announcement_date").try_cast("date")}).dropna(subset=["period", "announcement_date"])


def macro_series(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("label string, timestamp array<bigint>, close array<double>").json(path)
    return raw.select("label", F.inline(F.arrays_zip("timestamp", "close"))).filter("close is not null").select("label", F.timestamp_seconds("timestamp").alias("ts"), "close")


def symbol_list(spark: SparkSession, path: str, source: str, asset_type: str) -> DataFrame:
    """Registry rows: coins quoted in USDT, or six-digit stock codes with the exchange by prefix."""
    raw = spark.read.schema("code string, name string, base string, quote string, status string").json(path)
    c = F.col
    if asset_type == "crypto":
        return raw.filter("quote = 'USDT'").select(c("base").alias("symbol"), F.coalesce("name", "base").alias("name"), F.lit("crypto").alias("asset_type"), F.lit("CRYPTO").alias("market"), F.lit("OKX").alias("exchange"),
                                                   F.lower(F.coalesce("status", F.lit("live"))).alias("status"), F.lit(source).alias("source"))
    sh = c("code").rlike("^[569]")
    return raw.filter(c("code").rlike("^[0-9]{6}$")).select(F.concat("code", F.when(sh, ".SH").otherwise(".SZ")).alias("symbol"), "name", F.lit("stock").alias("asset_type"), F.lit("CN").alias("market"),
                                                            F.when(sh, "SSE").otherwise("SZSE").alias("exchange"), F.coalesce("status", F.lit("TRADING")).alias("status"), F.lit(source).alias("source"))


def derivatives(interest: DataFrame, funding: DataFrame) -> DataFrame:
    """Open-interest change newest over previous, and the share of funding rates not above the newest; both need symbol, ts."""
    c = F.col
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    two = interest.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").groupBy("symbol").agg(F.max(F.when(c("_r") == 1, c("open_interest"))).alias("open_interest"), F.max(F.when(c("_r") == 2, c("open_interest"))).alias("_old"))
    last = funding.groupBy("symbol").agg(F.max_by("funding_rate", "ts").alias("_now"))
    rank = funding.join(last, "symbol").groupBy("symbol").agg(F.first("_now").alias("funding_rate"), F.avg((c("funding_rate") <= c("_now")).cast("double")).alias("funding_percentile"))
    return two.join(rank, "symbol", "full").select("symbol", "open_interest", (ratio(c("open_interest"), c("_old")) - 1).alias("open_interest_change"), "funding_rate", "funding_percentile")


# Positions of the ~-delimited fundamentals record.
FUNDAMENTALS = {"name": 1, "price": 3, "turnover_rate": 38, "pe": 39, "float_cap": 44, "total_cap": 45, "pb": 46}


def fundamentals(rows: DataFrame, column: str = "line") -> DataFrame:
    p = rows.withColumn("_p", F.split(column, "~"))
    return p.select("symbol", *[(F.get("_p", F.lit(i)) if n == "name" else F.get("_p", F.lit(i)).try_cast(NUM)).alias(n) for n, i in FUNDAMENTALS.items()])


# The on-chain statistics that are kept.
ONCHAIN = ("n_tx", "hash_rate", "difficulty", "trade_volume_usd", "miners_revenue_usd", "minutes_between_blocks", "estimated_transaction_volume_usd")


def onchain(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("timestamp bigint, " + ", ".join(f"{n} double" for n in ONCHAIN)).json(path)
    return raw.withColumn("ts", F.timestamp_millis("timestamp")).unpivot(["ts"], list(ONCHAIN), "metric", "value").dropna(subset=["value"])


def point_in_time(bars: DataFrame, reports: DataFrame, columns: list[str]) -> DataFrame:
    """The last report announced by each bar's date (backward as-of); both need symbol."""
    from tapeline.functions.series import as_of
    known = reports.withColumn("ts", F.col("announcement_date").cast("timestamp"))
    return as_of(bars.withColumn("event_ts", F.col("ts")), known, columns, strict=False, forward=False).drop("event_ts").withColumnRenamed("bar_ts", "announced_at")
