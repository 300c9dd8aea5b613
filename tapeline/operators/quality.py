"""Validation, audits, fingerprints, versioned universes and governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions import ranks

from tapeline.functions.series import KEYS, by_time, finite, ratio, whole
from tapeline.schema import FEATURES, INTERVAL_MINUTES

PRICES = ("open", "high", "low", "close")
ARRIVAL_BLOCK = 1 << 16


def bad_ohlc() -> Column:
    c = F.col
    return ((F.least(*PRICES) <= 0) | (c("high") < F.greatest("open", "close")) | (c("low") > F.least("open", "close")) | (c("high") < c("low")))


def validate(rows: DataFrame) -> DataFrame:
    """Give each raw row its first failing code, in arrival order (``seq`` per series), or NULL.

    An accepted row is later than every sound row before it, so "newest accepted
    so far" is the running maximum over sound rows.  Arrivals are unbounded, so
    that maximum is taken in two levels: per block of 65,536 arrivals, then inside
    the block.
    """
    c = F.col
    number = ("open", "high", "low", "close", "volume")
    rows = rows.withColumns({f"_{x}": c(x).try_cast("double") for x in number}).withColumn("_ts", c("ts").try_cast("timestamp"))
    present = c("ts").isNotNull()
    typed = c("_ts").isNotNull()
    for x in number:
        present, typed = present & c(x).isNotNull(), typed & c(f"_{x}").isNotNull()
    o, h, l, k = (c(f"_{x}") for x in PRICES)
    bad = (F.least(o, h, l, k) <= 0) | (h < F.greatest(o, k)) | (l > F.least(o, k)) | (h < l)
    rows = rows.withColumns({"_present": present, "_typed": typed, "_bad": F.coalesce(bad, F.lit(True)), "_neg": F.coalesce(c("_volume") < 0, F.lit(False)),
                             "_blk": F.floor(c("seq") / ARRIVAL_BLOCK)})
    rows = rows.withColumn("_sound", c("_present") & c("_typed") & ~c("_bad") & ~c("_neg"))
    tops = rows.groupBy(*KEYS, "_blk").agg(F.max(F.when(c("_sound"), c("_ts"))).alias("_top"))
    earlier = Window.partitionBy(*KEYS).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*KEYS, "_blk", F.max("_top").over(earlier).alias("_base"))
    inside = Window.partitionBy(*KEYS, "_blk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(tops, [*KEYS, "_blk"]).withColumn("_newest", F.greatest(c("_base"), F.max(F.when(c("_sound"), c("_ts"))).over(inside)))
    rows = rows.withColumn("_accepted", c("_sound") & (c("_newest").isNull() | (c("_ts") > c("_newest"))))
    same = Window.partitionBy(*KEYS, "_ts").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_twin", F.coalesce(F.max(c("_accepted").cast("int")).over(same), F.lit(0)) == 1)
    code = (F.when(~c("_present"), "MISSING_FIELDS").when(~c("_typed"), "INVALID_TYPE").when(c("_twin"), "DUPLICATE_TIMESTAMP")
            .when(c("_ts") <= c("_newest"), "OUT_OF_ORDER").when(c("_bad"), "BAD_OHLC").when(c("_neg"), "NEGATIVE_VOLUME"))
    drop = [x for x in rows.columns if x.startswith("_")]
    return rows.withColumn("code", code).drop(*drop)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.filter("code is null").drop("code"), validated.filter("code is not null")


def dataset_audit(rows: DataFrame, market: str, interval: str, now) -> DataFrame:
    """Per-symbol faults of raw bars: missing values, duplicates, bad OHLC, negative volume, future rows, gaps."""
    c = F.col
    nulls = F.lit(0)
    for x in (*PRICES, "volume"):
        nulls = nulls + c(x).isNull().cast("int")
    late = c("ts") > F.lit(now).cast("timestamp") + F.expr("interval 5 minutes")
    # One row per stamp first: gaps are then read from a calendar-bounded series.
    stamps = rows.groupBy(*KEYS, "ts").agg(
        F.count(F.lit(1)).alias("_k"), F.sum(nulls).alias("_m"), F.sum(F.coalesce(bad_ohlc(), F.lit(False)).cast("int")).alias("_b"),
        F.sum(F.coalesce(c("volume") < 0, F.lit(False)).cast("int")).alias("_v"), F.sum(late.cast("int")).alias("_f"))
    seconds = F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(by_time()))
    if interval == "1d":
        gap = F.floor(seconds / 86400) > (4 if market in ("CN", "US") else 2)
    else:
        gap = seconds > INTERVAL_MINUTES[interval] * 60 * 2.1
    out = stamps.withColumn("_g", F.coalesce(gap, F.lit(False)).cast("int")).groupBy(*KEYS).agg(
        F.sum("_k").alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("_m").alias("missing_values"),
        F.sum(c("_k") - 1).alias("duplicate_timestamps"), F.sum("_b").alias("ohlc_invalid"), F.sum("_v").alias("negative_volume"),
        F.sum("_f").alias("future_rows"), F.sum("_g").alias("gap_rows"))
    faults = c("missing_values") + c("duplicate_timestamps") + c("ohlc_invalid") + c("negative_volume") + c("future_rows")
    return out.withColumn("status", F.when(faults == 0, "PASSED").otherwise("FAILED"))


def audit_totals(audit: DataFrame) -> DataFrame:
    names = ("rows", "missing_values", "duplicate_timestamps", "ohlc_invalid", "negative_volume", "future_rows", "gap_rows")
    return audit.agg(*[F.sum(n).alias(n) for n in names], F.min(F.col("status") == "PASSED").alias("passed"))


#: Nodes of a digest tree that make one of the next level.
DIGEST_FAN = 64


def digest_rows(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Digest and number of rows: SHA-256 of every row written as text, then of runs of DIGEST_FAN digests by ``order``.

    At least one run is taken, and runs of runs until one digest is left, so no buffer holds more than DIGEST_FAN
    of them and the digest does not depend on how rows lie in partitions. Without rows: one row, digest NULL, 0 members.
    """
    line = F.concat_ws(",", *[F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in columns])
    rows = df.select(*[F.col(x).alias(f"_o{i}") for i, x in enumerate(order)], F.sha2(line, 256).alias("_h"))
    level = ranks.numbered(rows, [], [*[F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))], F.col("_h")], "_at", "_n").select("_at", "_h")
    members = left = level.count()
    while True:
        held = F.array_sort(F.collect_list(F.struct("_at", "_h")))
        runs = level.groupBy(F.floor(F.col("_at") / DIGEST_FAN).alias("_run"))
        level = runs.agg(F.sha2(F.array_join(F.transform(held, lambda x: x["_h"]), ""), 256).alias("_h")).withColumnRenamed("_run", "_at")
        left = -(-left // DIGEST_FAN)
        if left <= 1:
            break
    return level.agg(F.max("_h").alias("digest"), F.lit(members).cast("long").alias("members"))


def dataset_version(audit: DataFrame, market: str, interval: str) -> DataFrame:
    counts = ["symbol", "rows", "missing_values", "duplicate_timestamps", "ohlc_invalid", "negative_volume", "future_rows", "gap_rows"]
    return digest_rows(audit, counts, ["symbol"]).withColumn("version", F.concat(F.lit(f"{market}-{interval}-"), F.substring("digest", 1, 16)))


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("market", "symbol", "interval").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def coverage_hash(bars: DataFrame) -> DataFrame:
    """One digest for what a candle table holds."""
    spans = coverage(bars).withColumns({"first": F.unix_seconds("start"), "final": F.unix_seconds("end")})
    return digest_rows(spans, ["market", "symbol", "interval", "rows", "first", "final"], ["market", "symbol", "interval"])


def coverage_matrix(bars: DataFrame, predictions: DataFrame) -> DataFrame:
    """Candle and prediction counts by (market, symbol), either side may be missing."""
    left = bars.groupBy("market", "symbol").agg(F.count(F.lit(1)).alias("candles"), F.count_distinct("interval").alias("intervals"))
    right = (predictions.groupBy("market", "symbol", "horizon").agg(F.count(F.lit(1)).alias("k"))
             .groupBy("market", "symbol").agg(F.sum("k").alias("predictions"), F.sort_array(F.collect_list(F.concat_ws(":", "horizon", "k"))).alias("by_horizon")))
    return left.join(right, ["market", "symbol"], "full").select(
        "market", "symbol", F.coalesce("candles", F.lit(0)).alias("candles"), F.coalesce("intervals", F.lit(0)).alias("intervals"),
        F.coalesce("predictions", F.lit(0)).alias("predictions"), F.array_join(F.coalesce("by_horizon", F.array().cast("array<string>")), "|").alias("by_horizon"))


def leakage_audit(panel: DataFrame, now) -> DataFrame:
    """Rows whose feature time is not before their label time, in the future, or repeated."""
    c = F.col
    late = c("ts") > F.lit(now).cast("timestamp") + F.expr("interval 5 minutes")
    keyed = panel.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("_k"), F.sum((c("ts") >= c("target_time")).cast("int")).alias("_o"), F.sum(late.cast("int")).alias("_f"))
    out = keyed.agg(F.sum("_o").alias("invalid_feature_label_order"), F.sum("_f").alias("future_feature_rows"), F.sum(c("_k") - 1).alias("duplicate_asset_timestamps"))
    return out.withColumn("status", F.when(c("invalid_feature_label_order") + c("future_feature_rows") + c("duplicate_asset_timestamps") == 0, "PASSED").otherwise("FAILED"))


def strategy_quality(bars: DataFrame, as_of) -> DataFrame:
    """0-100 score of completeness, order, continuity, OHLC validity and freshness per series."""
    c = F.col
    nulls = F.lit(0.0)
    for x in (*PRICES, "volume"):
        nulls = nulls + c(x).isNull().cast("double")
    df = bars.withColumn("_g", (F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(by_time()))).cast("double"))
    df = df.withColumn("_m", F.percentile("_g", F.lit(0.5)).over(whole()))
    sound = (c("high") >= F.greatest("open", "close")) & (c("low") <= F.least("open", "close")) & (c("volume") >= 0)
    out = df.groupBy(*KEYS).agg((1 - F.avg(nulls / 5)).alias("completeness"), F.coalesce(F.avg((c("_g") <= c("_m") * 3).cast("double")), F.lit(0.0)).alias("continuity"),
                                F.avg(F.coalesce(sound, F.lit(False)).cast("double")).alias("validity"), F.max("ts").alias("_end"), F.coalesce(F.max("_m"), F.lit(3600.0)).alias("_m"))
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("_end")
    out = out.withColumn("freshness", F.greatest(F.lit(0.0), 1 - age / F.greatest(c("_m") * 20, F.lit(1.0))))
    score = F.bround(100 * (0.3 * c("completeness") + 0.2 + 0.2 * c("continuity") + 0.2 * c("validity") + 0.1 * c("freshness")))
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    return out.withColumn("status", F.when(c("score") >= 60, "AVAILABLE").otherwise("LOW_QUALITY")).drop("_end", "_m")


def research_quality(frame: DataFrame, external: DataFrame, as_of, columns: list[str] = FEATURES) -> DataFrame:
    """Weighted observed-data quality per series; ``external`` holds (symbol, status, source, conflicts)."""
    c = F.col
    share = lambda names: sum((c(n).isNotNull().cast("double") for n in names[1:]), c(names[0]).isNotNull().cast("double")) / len(names)
    base = frame.groupBy(*KEYS).agg(F.avg(share([*PRICES, "volume"])).alias("completeness"), F.avg(share(columns)).alias("feature_alignment"), F.max("ts").alias("_end"))
    counts = external.filter("status not in ('NOT_APPLICABLE', 'NOT_APPLICABLE_OR_NO_DATA')").groupBy("symbol").agg(
        F.avg(c("status").isin("AVAILABLE", "PARTIAL_DATA").cast("double")).alias("external_coverage"), (F.count_distinct("source") + 1).alias("source_count"),
        F.sum("conflicts").alias("conflict_count"))
    df = base.join(counts, "symbol", "left").fillna({"external_coverage": 0.0, "source_count": 1, "conflict_count": 0})
    hours = F.greatest(F.lit(0.0), (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("_end")) / 3600)
    score = 100 * (0.28 * c("completeness") + 0.22 * c("feature_alignment") + 0.18 * c("external_coverage") + 0.12 * F.least(F.lit(1.0), c("source_count") / 4)
                   + 0.12 * F.greatest(F.lit(0.0), 1 - hours / 72) + 0.08 * F.greatest(F.lit(0.0), 1 - c("conflict_count") * 0.2))
    df = df.withColumn("score", score)
    return df.withColumn("grade", F.when(c("score") >= 85, "HIGH").when(c("score") >= 65, "MEDIUM").otherwise("LOW")).drop("_end")


def prediction_completeness(frame: DataFrame, columns: list[str], crypto: bool = True) -> DataFrame:
    c = F.col
    filled = sum((c(n).isNotNull().cast("double") for n in columns[1:]), c(columns[0]).isNotNull().cast("double")) / len(columns)
    minutes = F.create_map(*[F.lit(x) for k, m in INTERVAL_MINUTES.items() for x in (k, m)])[c("interval")]
    gap = F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(by_time()))
    df = frame.withColumns({"_f": filled, "_ok": (gap <= minutes * 66).cast("double")})
    times = F.coalesce(F.avg("_ok"), F.lit(1.0)) if crypto else F.lit(1.0)
    return df.groupBy(*KEYS).agg((0.65 * F.avg("_f") + 0.35 * times).alias("completeness"))


def reconcile_quotes(quotes: DataFrame, limit: float = 0.005) -> DataFrame:
    """Spread between sources' prices of one symbol; a conflict above ``limit``."""
    c = F.col
    out = quotes.groupBy("symbol").agg(F.count("price").alias("sources"), F.max("price").alias("_x"), F.min("price").alias("_n"), F.avg("price").alias("_m"))
    spread = (c("_x") - c("_n")) / F.greatest(c("_m"), F.lit(1e-12))
    enough = c("sources") >= 2
    return out.select("symbol", "sources", F.when(enough, "AVAILABLE").when(c("sources") > 0, "PARTIAL_DATA").otherwise("NO_DATA").alias("status"),
                      F.when(enough, spread * 100).alias("spread_percent"), (enough & (spread > limit)).alias("conflict"))


def universe_version(members: DataFrame, market: str, as_of: str) -> DataFrame:
    """Content-addressed member list; needs symbol, active, effective_from, effective_to."""
    out = digest_rows(members, ["symbol", "active", "effective_from", "effective_to"], ["symbol"])
    return out.withColumns({"market": F.lit(market), "as_of": F.lit(as_of), "version": F.concat(F.lit(f"{market}-{as_of}-"), F.substring("digest", 1, 16))})


def select_universe(tickers: DataFrame, top: int, minimum: int, suffix: str = "-USDT") -> DataFrame:
    """The ``top`` instruments by quote volume and whether they meet the required count."""
    ranked = (tickers.filter(F.col("instrument").endswith(suffix) & F.col("quote_volume").isNotNull())
              .select(F.expr(f"left(instrument, length(instrument) - {len(suffix)})").alias("symbol"), "quote_volume")
              .orderBy(F.desc("quote_volume"), F.desc("symbol")).limit(top))
    return ranked.withColumn("meets_minimum", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) >= minimum)


def news_eligibility(news: DataFrame) -> DataFrame:
    """Whether an item may inform a prediction; needs published_raw, prediction_ts, sentiment."""
    c = F.col
    when = F.coalesce(c("published_raw").try_cast("timestamp"))
    reason = (F.when(c("published_raw").isNull() | (c("published_raw") == ""), "UNKNOWN_PUBLISHED_AT").when(when.isNull(), "INVALID_TIMESTAMP")
              .when(when > c("prediction_ts"), "FUTURE_NEWS").otherwise("POINT_IN_TIME"))
    return news.withColumn("reason", reason).withColumns({"eligible": c("reason") == "POINT_IN_TIME", "value": F.when(c("reason") == "POINT_IN_TIME", c("sentiment"))})


# The gates a model must pass, all of them.
GATES = ("oos_valid", "walk_forward_stable", "beats_baseline", "positive_ic", "positive_rank_ic", "stable_icir", "positive_after_cost",
         "acceptable_sharpe", "acceptable_max_drawdown", "multi_window_stable", "no_leakage", "data_quality_pass", "calibrated", "multi_asset")


def production_gate(evidence: DataFrame) -> DataFrame:
    """Fail closed: a gate that is not exactly TRUE fails."""
    gates = F.array(*[F.struct(F.lit(g).alias("gate"), (F.col(g) if g in evidence.columns else F.lit(None).cast("boolean")).alias("passed")) for g in GATES])
    failed = F.transform(F.filter(gates, lambda g: ~g["passed"].eqNullSafe(F.lit(True))), lambda g: g["gate"])
    out = evidence.withColumn("failed_gates", failed)
    return out.withColumns({"qualified": F.size("failed_gates") == 0, "decision": F.when(F.size("failed_gates") == 0, "MANUAL_REVIEW_REQUIRED").otherwise("NO_EDGE")})


def availability(frame: DataFrame, groups: dict[str, list[str]], absent: int = 0) -> DataFrame:
    """Which information groups hold data per series; ``absent`` counts applicable groups without a source."""
    c = F.col
    flags = {g: F.max(sum((c(n).isNotNull().cast("int") for n in cols[1:]), c(cols[0]).isNotNull().cast("int"))) == len(cols) for g, cols in groups.items()}
    out = frame.groupBy(*KEYS).agg(*[v.alias(f"{g}_available") for g, v in flags.items()])
    have = sum((c(f"{g}_available").cast("int") for g in list(groups)[1:]), c(f"{list(groups)[0]}_available").cast("int"))
    share = have / (len(groups) + absent)
    return out.withColumn("coverage", share).withColumn("data_status", F.when(c("coverage") >= 0.85, "AVAILABLE").when(c("coverage") > 0, "PARTIAL_DATA").otherwise("NO_DATA"))


def model_fingerprint(bars: DataFrame, horizon: str, profile: str, version: str) -> DataFrame:
    """Cache key of a trained model per series: stable within one refresh period of its newest bar."""
    c = F.col
    seconds = F.when(c("interval").isin("1m", "5m"), 3600).when(c("interval") == "1d", 86400).otherwise(14400)
    end = bars.groupBy(*KEYS).agg(F.max("ts").alias("ts"))
    bucket = F.floor(F.unix_seconds("ts") / seconds) * seconds
    return end.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.lit(version), F.lit(profile), "interval", F.lit(horizon), bucket.cast("string")), 256))
