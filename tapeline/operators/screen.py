"""Screener scores, dashboard tables, alerts and operations summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions import ranks
from tapeline.functions.series import KEYS, change, clip, latest, ratio


def points(value: Column) -> Column:
    """0-100 whole points, half-even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def component_scores(end: DataFrame, news: DataFrame | None = None) -> DataFrame:
    """Trend, technical, news, momentum, volume and risk points of the newest bar and their blend.

    Needs close, ma20, ma60, macd, macd_signal, rsi, volume_ratio, atr and score (indicator score);
    ``news`` holds (symbol, news_points).
    """
    c = F.col
    zero = F.lit(0.0)
    above = lambda m: (c(m) != 0) & (c("close") > c(m))
    yes = lambda cond, a, b: F.when(F.coalesce(cond, F.lit(False)), a).otherwise(b)
    df = end.join(news, "symbol", "left") if news is not None else end.withColumn("news_points", F.lit(None).cast("double"))
    rsi = c("rsi")
    wobble = F.coalesce(ratio(c("atr"), c("close")) * 100, zero)
    df = df.withColumns({
        "trend": points(50.0 + yes(above("ma20"), 18, -18) + yes(above("ma60"), 10, -10)),
        "technical": points(c("score").cast("double")),
        "news": F.coalesce("news_points", F.lit(50.0)),
        "momentum": points(50.0 + F.when(c("macd").isNotNull() & c("macd_signal").isNotNull(), yes(c("macd") > c("macd_signal"), 18, -18)).otherwise(0)
                           + F.when(rsi.between(45, 65), 10).when(rsi >= 75, -12).when(rsi <= 30, -6).otherwise(0)),
        "volume_points": points(F.coalesce(50 + (c("volume_ratio") - 1) * 30, F.lit(50.0))),
        "risk": points(28 + F.least(F.lit(42.0), wobble * 8) + F.when((rsi >= 75) | (rsi <= 25), 18.0).otherwise(0.0))})
    blend = (0.28 * c("trend") + 0.24 * c("technical") + 0.16 * c("news") + 0.17 * c("momentum") + 0.15 * c("volume_points")
             - F.greatest(zero, c("risk") - 50) * 0.12)
    df = df.withColumn("ai_score", points(blend))
    return df.withColumn("verdict", F.when(c("ai_score") >= 60, "BULLISH").when(c("ai_score") <= 40, "BEARISH").otherwise("NEUTRAL"))


def with_change(bars: DataFrame) -> DataFrame:
    return bars.withColumn("change_percent", change(F.col("close"), 1) * 100)


def screen(scored: DataFrame, *, min_score: float = 0, min_volume_ratio: float = 0, max_risk: float = 100, movement: str = "all", top: int | None = None) -> DataFrame:
    """Typed filters, then best score and strongest change first."""
    c = F.col
    df = scored.filter((c("ai_score") >= min_score) & (F.coalesce("volume_ratio", F.lit(0.0)) >= min_volume_ratio) & (c("risk") <= max_risk))
    if movement != "all":
        df = df.filter(c("change_percent") > 0 if movement == "up" else c("change_percent") < 0)
    order = [F.desc("ai_score"), F.desc_nulls_last("change_percent"), F.asc("symbol")]
    return df.orderBy(*order).limit(top) if top else df.orderBy(*order)


def pulse(scored: DataFrame) -> DataFrame:
    """Market-wide means of the components and their weighted pulse."""
    c = F.col
    means = scored.agg(*[points(F.avg(x)).alias(x) for x in ("trend", "news", "volume_points", "risk")], F.count(F.lit(1)).alias("assets"))
    score = points(0.30 * c("trend") + 0.20 * c("news") + 0.18 * c("volume_points") + 0.17 * c("news") + 0.15 * (100 - c("risk")))
    return means.withColumn("pulse", score).withColumn("stance", F.when(c("pulse") >= 60, "BULLISH").when(c("pulse") <= 40, "BEARISH").otherwise("NEUTRAL"))


def movers(scored: DataFrame, top: int = 5) -> DataFrame:
    """Five leader boards in one table."""
    boards = {"gainers": F.desc_nulls_last("change_percent"), "losers": F.asc_nulls_last("change_percent"), "volume": F.desc_nulls_last("volume_ratio"),
              "opportunities": F.desc("ai_score"), "risk_watch": F.desc("risk")}
    out = None
    for name, order in boards.items():
        part = (scored.orderBy(order, "symbol").limit(top)
                .select(F.lit(name).alias("board"), "symbol", "change_percent", "volume_ratio", "ai_score", "risk"))
        out = part if out is None else out.unionByName(part)
    return out


def fused_verdict(df: DataFrame) -> DataFrame:
    """Blend strategy score, terminal score and news; needs technical_score, ai_score, news_score, entry, stop_loss."""
    c = F.col
    terminal = (c("ai_score") - 50) * 2
    raw = F.when(c("news_score").isNull(), 0.7 * c("technical_score") + 0.3 * terminal).otherwise(0.55 * c("technical_score") + 0.25 * terminal + 0.20 * c("news_score"))
    df = df.withColumn("combined", F.round(clip(raw, -100.0, 100.0), 2))
    df = df.withColumn("verdict", F.when(c("combined") >= 15, "BULLISH").when(c("combined") <= -15, "BEARISH").otherwise("NEUTRAL"))
    mirrored = c("entry") + F.abs(c("entry") - c("stop_loss"))
    return df.withColumn("exit_line", F.when((c("verdict") == "BEARISH") & (c("stop_loss") < c("entry")), mirrored).otherwise(c("stop_loss")))


def decision_gate(df: DataFrame) -> DataFrame:
    """Gate, priority and blockers; needs price, exit_line, verdict, age_hours, asset_type, samples, news_count, top_impact."""
    c = F.col
    bull, bear = c("verdict") == "BULLISH", c("verdict") == "BEARISH"
    breached = (bull & (c("price") <= c("exit_line"))) | (bear & (c("price") >= c("exit_line")))
    stale = c("age_hours").isNull() | (c("age_hours") > F.when(c("asset_type") == "crypto", 2).otherwise(96))
    df = df.withColumns({"breached": F.coalesce(breached, F.lit(False)), "stale": stale, "important": F.coalesce(c("top_impact") >= 80, F.lit(False))})
    blockers = F.filter(F.array(F.lit("NO_EDGE"), F.when(c("samples") < 100, "FEW_SAMPLES"), F.when(c("stale"), "STALE_DATA"), F.when(c("news_count") == 0, "NO_NEWS"), F.when(c("breached"), "EXIT_LINE_BREACH")),
                        lambda x: x.isNotNull())
    return df.withColumns({
        "gate": F.when(c("breached"), "RISK_REVIEW").when(c("stale"), "NO_ACTION").when(c("important"), "RISK_REVIEW").when(bull | bear, "WATCH_ONLY").otherwise("NO_ACTION"),
        "priority": F.when(c("breached"), 100).when(c("important"), 80).when(c("stale"), 70).when(bull | bear, 45).otherwise(20),
        "evidence_grade": F.when((c("samples") >= 100) & ~c("stale"), "C").otherwise("D"), "blockers": F.array_join(blockers, "|")})


def alerts(items: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Alert rows of gated items, with a state-change alert against the previous snapshot.  Needs cutoff."""
    c = F.col
    stamp = F.coalesce(c("cutoff").cast("string"), F.lit("unknown"))
    kinds = F.array(F.when(c("breached"), F.struct(F.lit("EXIT_LINE_BREACH").alias("alert_type"), F.lit("CRITICAL").alias("severity"), F.concat_ws(":", F.lit("exit"), "asset_type", "symbol", stamp).alias("fingerprint"))),
                    F.when(c("stale"), F.struct(F.lit("STALE_DATA").alias("alert_type"), F.lit("WARNING").alias("severity"), F.concat_ws(":", F.lit("stale"), "asset_type", "symbol", stamp).alias("fingerprint"))),
                    F.when(c("important"), F.struct(F.lit("HIGH_IMPACT_NEWS").alias("alert_type"), F.lit("WARNING").alias("severity"), F.concat_ws(":", F.lit("news"), "symbol", stamp).alias("fingerprint"))))
    out = items.select("symbol", "asset_type", F.inline(F.filter(kinds, lambda x: x.isNotNull())))
    if previous is None:
        return out
    old = previous.select("symbol", "asset_type", c("gate").alias("_g"), c("verdict").alias("_v"))
    moved = items.join(old, ["symbol", "asset_type"]).filter((c("gate") != c("_g")) | (c("verdict") != c("_v")))
    return out.unionByName(moved.select("symbol", "asset_type", F.lit("STATE_CHANGE").alias("alert_type"), F.lit("INFO").alias("severity"),
                                        F.concat_ws(":", F.lit("state"), "asset_type", "symbol", stamp, "gate", "verdict").alias("fingerprint")))


def new_alerts(found: DataFrame, stored: DataFrame) -> DataFrame:
    return found.dropDuplicates(["fingerprint"]).join(stored.select("fingerprint"), "fingerprint", "left_anti")


def open_alerts(stored: DataFrame, fresh: DataFrame, top: int = 100) -> DataFrame:
    """Unacknowledged alerts, newest first; a stale-data alert closes once its asset is fresh again."""
    closed = fresh.select("symbol", "asset_type").withColumn("alert_type", F.lit("STALE_DATA")).distinct()
    return stored.filter("not acknowledged").join(closed, ["symbol", "asset_type", "alert_type"], "left_anti").orderBy(F.desc("created_at"), "fingerprint").limit(top)


def compare(scored: DataFrame, left: str, right: str) -> DataFrame:
    """Two assets side by side, one row per measure."""
    names = ["trend", "technical", "news", "momentum", "volume_points", "risk", "ai_score"]
    long = scored.filter(F.col("symbol").isin(left, right)).select("symbol", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["symbol"], names, "measure", "value")
    return (long.groupBy("measure").pivot("symbol", [left, right]).agg(F.max("value"))
            .select("measure", F.col(left).alias("left"), F.col(right).alias("right"), (F.col(left) - F.col(right)).alias("difference")))


def provider_health(events: DataFrame, as_of, stale_after: int = 3600) -> DataFrame:
    """Newest state, error share of the last 20 checks, freshness and last success per provider.

    Needs provider, id, checked_at, status.  ``row_number <= 20`` lets Spark keep only 20 rows per
    provider and map task before the shuffle (window group limit).
    """
    c = F.col
    rank = F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("id")))
    recent = events.select("provider", "id", "status", "checked_at").withColumn("_r", rank).filter(c("_r") <= 20).groupBy("provider").agg(
        F.max_by("status", "id").alias("_s"), F.max_by("checked_at", "id").alias("_t"), F.avg((c("status") != "CONNECTED").cast("double")).alias("_e"))
    good = events.filter("status = 'CONNECTED'").groupBy("provider").agg(F.max("checked_at").alias("last_success"))
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("_t")
    return recent.join(good, "provider", "left").select(
        "provider", F.when((c("_s") == "CONNECTED") & (age > stale_after), "STALE").otherwise(c("_s")).alias("status"), F.round("_e", 4).alias("error_rate"),
        F.greatest(F.lit(0), age).alias("freshness_seconds"), "last_success")


def carry_last_success(events: DataFrame) -> DataFrame:
    """Each check with the newest success up to it, per provider and day (plus the days before)."""
    c = F.col
    ok = F.when(c("status") == "CONNECTED", c("checked_at"))
    df = events.withColumn("_d", F.to_date("checked_at"))
    days = df.groupBy("provider", "_d").agg(F.max(ok).alias("_m"))
    days = days.withColumn("_base", F.max("_m").over(Window.partitionBy("provider").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("provider", "_d").orderBy("checked_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return df.join(days.select("provider", "_d", "_base"), ["provider", "_d"]).select("provider", "id", "checked_at", "status", F.coalesce(F.max(ok).over(inside), c("_base")).alias("last_success"))


def latency_summary(calls: DataFrame) -> DataFrame:
    """Count, mean, p95 and maximum per path; p95 is the value at place floor(0.95 n).

    Equal durations are counted first and placed by range partitions, so a path may hold any number of calls.
    """
    c = F.col
    tally = ranks.ranked_values(calls, ["path"], "duration_ms")
    place = F.least(c("total") - 1, F.floor(c("total") * 0.95))
    return tally.groupBy("path").agg(F.max("total").alias("calls"), (F.sum(c("duration_ms") * c("n")) / F.max("total")).alias("average_ms"),
                                     F.min(F.when(c("before") + c("n") > place, c("duration_ms"))).alias("p95_ms"), F.max("duration_ms").alias("max_ms")).orderBy(F.desc("max_ms"), "path")


def news_dimension(news: DataFrame, keep: int = 50, show: int = 5) -> DataFrame:
    """Points and label from a symbol's newest ``keep`` items, and its ``show`` newest ids."""
    c = F.col
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("published_at"), "id"))
    few = news.withColumn("_r", rank).filter(c("_r") <= keep)
    out = few.groupBy("symbol").agg(points(50 + F.avg("sentiment") / 2).alias("news_points"),
                                    F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(c("_r") <= show, F.struct("_r", "id")))), lambda x: x["id"].cast("string"))).alias("top_ids"))
    return out.withColumn("label", F.when(c("news_points") >= 60, "POSITIVE").when(c("news_points") <= 40, "NEGATIVE").otherwise("NEUTRAL"))


def upsert_watchlist(current: DataFrame, updates: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Latest row per symbol wins; the first creation time stays; removed symbols leave."""
    both = current.withColumn("_v", F.lit(0)).unionByName(updates.withColumn("_v", F.lit(1)))
    out = both.groupBy("symbol").agg(F.max_by("name", F.struct("_v", "created_at")).alias("name"), F.max_by("asset_type", F.struct("_v", "created_at")).alias("asset_type"), F.min("created_at").alias("created_at"))
    if removed is not None:
        out = out.join(removed.select("symbol"), "symbol", "left_anti")
    return out.orderBy("created_at", "symbol")


def quote_table(requested: DataFrame, quotes: DataFrame) -> DataFrame:
    """Requested symbols in their order with price and availability; needs position, symbol."""
    first = requested.groupBy("symbol").agg(F.min("position").alias("position"))
    return (first.join(quotes.select("symbol", "price", "prev_price"), "symbol", "left")
            .select("position", "symbol", "price", (F.col("price") - F.col("prev_price")).alias("change"), ((ratio(F.col("price"), F.col("prev_price")) - 1) * 100).alias("change_percent"),
                    F.col("price").isNotNull().alias("available")))
