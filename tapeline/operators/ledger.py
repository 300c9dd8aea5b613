"""Prediction ledger: settlement, scoring and account marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions.series import KEYS, as_of, corr, numbered, ratio
from tapeline.schema import INTERVAL_MINUTES, SETTLEMENT_MINUTES, SETTLEMENT_STEPS


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), key)


#: Bars of a block whose extremes are taken whole.
PATH_BLOCK = 64


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_sk", F.concat_ws("|", "symbol", "interval"))


def settlement_bars(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Add first_n (first bar after the prediction), end_n (settlement bar) and reason where there is none.

    Stocks and daily series count observed bars; intraday coins use the clock and
    reject a bar more than 1.1 bars late.
    """
    c = F.col
    bars = _keyed(numbered(bars).select(*KEYS, "n", "ts", "close"))
    have = bars.groupBy("_sk").agg(F.max("n").alias("_last_n"))
    stock = c("market").isin("CN", "US") | (c("interval") == "1d")
    steps, minutes = _lookup(SETTLEMENT_STEPS, c("horizon")), _lookup(SETTLEMENT_MINUTES, c("horizon"))
    asked = _keyed(predictions).withColumns({"event_ts": c("prediction_time"), "_steps": F.when(stock, steps), "_min": F.when(~stock, minutes), "_stock": stock})
    asked = as_of(asked, bars, ["n"], strict=True, key="_sk").withColumnRenamed("n", "first_n").drop("bar_ts")
    asked = asked.withColumn("event_ts", F.timestamp_micros(F.unix_micros("prediction_time") + F.coalesce(c("_min"), F.lit(0)).cast("long") * 60000000))
    asked = as_of(asked, bars, ["n"], strict=False, key="_sk").withColumnRenamed("n", "_clock_n")
    asked = asked.join(have, "_sk", "left")
    slack = F.greatest(F.lit(1), _lookup(INTERVAL_MINUTES, c("interval"))) * 66
    late = (F.unix_seconds("bar_ts") - F.unix_seconds("event_ts")) > slack
    end = F.when(c("_stock"), c("first_n") + c("_steps") - 1).otherwise(c("_clock_n"))
    reason = (F.when(c("_last_n").isNull(), "MISSING_CANDLES").when(F.coalesce("_steps", "_min").isNull(), "UNSUPPORTED_HORIZON")
              .when(end.isNull() | (end > c("_last_n")), "TARGET_NOT_OBSERVED").when(~c("_stock") & late, "CANDLE_GAP_AT_TARGET"))
    return asked.withColumns({"reason": reason, "end_n": F.when(reason.isNull(), end)}).select(*predictions.columns, "first_n", "end_n", "reason")


def path_extremes(spans: DataFrame, bars: DataFrame, key: str = "id") -> DataFrame:
    """Least low, greatest high and last close over bar numbers first_n..end_n of each row.

    A span is spelled out as the bars of its two edges and the whole blocks of PATH_BLOCK bars between them, which
    meet their own least and greatest values: horizon / PATH_BLOCK rows, no range join, and a hot symbol still
    spreads over its bars.
    """
    c = F.col
    bars = numbered(bars).select(*KEYS, "n", c("ts").alias("end_ts"), "high", "low", "close")
    spans = spans.filter("end_n is not null and first_n <= end_n")
    head, tail = (F.floor(c(x) / PATH_BLOCK) for x in ("first_n", "end_n"))
    edges = F.when(head == tail, F.sequence("first_n", "end_n")).otherwise(F.concat(F.sequence(c("first_n"), (head + 1) * PATH_BLOCK - 1), F.sequence(tail * PATH_BLOCK, c("end_n"))))
    single = spans.select(key, *KEYS, F.explode(edges).alias("n")).join(bars, [*KEYS, "n"]).drop("n")
    blocks = bars.groupBy(*KEYS, F.floor(c("n") / PATH_BLOCK).alias("_b")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    inner = spans.filter(tail - head > 1).select(key, *KEYS, F.explode(F.sequence(head + 1, tail - 1)).alias("_b")).join(blocks, [*KEYS, "_b"]).drop("_b")
    met = single.unionByName(inner, allowMissingColumns=True)
    return met.groupBy(key).agg(F.min("low").alias("path_low"), F.max("high").alias("path_high"), F.max_by("close", "end_ts").alias("end_close"), F.max("end_ts").alias("end_ts"))


def settle(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcome of every prediction: status, return, class, stop and target touches, realised R."""
    c = F.col
    spans = settlement_bars(predictions, bars)
    df = spans.join(path_extremes(spans, bars), "id", "left")
    change = ratio(c("end_close"), c("entry_price")) - 1
    side = F.when(c("prediction") == "UP", "LONG").when(c("prediction") == "DOWN", "SHORT").otherwise("FLAT")
    df = df.withColumns({"actual_return": change, "side": side})
    long, short = c("side") == "LONG", c("side") == "SHORT"
    no = F.lit(False)
    done = c("reason").isNull()
    risk = F.abs(c("entry_price") - c("stop_loss"))
    signed = F.when(long, c("actual_return")).when(short, -c("actual_return")).otherwise(0.0)
    return df.withColumns({
        "status": F.when(done, "SETTLED").when(c("reason") == "TARGET_NOT_OBSERVED", "PENDING").otherwise("UNAVAILABLE"),
        "actual": F.when(done, F.when(c("actual_return") > c("threshold"), "UP").when(c("actual_return") < -c("threshold"), "DOWN").otherwise("FLAT")),
        "stop_hit": F.when(done, F.coalesce(F.when(long, c("path_low") <= c("stop_loss")).when(short, c("path_high") >= c("stop_loss")), no)),
        "target_hit": F.when(done, F.coalesce(F.when(long, c("path_high") >= c("tp1")).when(short, c("path_low") <= c("tp1")), no)),
        "realized_r": F.when(done, F.coalesce(ratio(signed * c("entry_price"), risk), F.lit(0.0))),
    }).withColumn("correct", F.when(done, c("actual") == c("prediction"))).drop("first_n", "end_n", "path_low", "path_high")


def pending(predictions: DataFrame, settlements: DataFrame) -> DataFrame:
    return predictions.join(settlements.select("id"), "id", "left_anti")


def settle_new(predictions: DataFrame, settlements: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows to append: settled now and not before.  Running it twice appends nothing more."""
    return settle(pending(predictions, settlements), bars).filter("status = 'SETTLED'")


def settle_assets(predictions: DataFrame, settlements: DataFrame, bars: DataFrame, assets: DataFrame) -> DataFrame:
    """``settle_new`` for the series of ``assets`` (symbol, interval) only: other predictions and bars are not looked at."""
    keys = assets.select(*KEYS).distinct()
    return settle_new(predictions.join(keys, [*KEYS], "left_semi"), settlements, bars.join(keys, [*KEYS], "left_semi"))


def settlement_summary(settled: DataFrame) -> DataFrame:
    """Counts per market, symbol and horizon, with subtotals."""
    return settled.rollup("market", "symbol", "horizon").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("status") == "SETTLED", 1)).alias("settled"),
        F.count(F.when(F.col("status") == "PENDING", 1)).alias("pending"))


def resolve(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcome against a stored target time, with excursions and a failure class for wrong calls."""
    c = F.col
    frame = _keyed(numbered(bars).select(*KEYS, "n", "ts", "close"))
    asked = _keyed(predictions).withColumn("event_ts", c("target_time"))
    asked = as_of(asked, frame, ["n"], strict=False, key="_sk").withColumnRenamed("n", "end_n").drop("bar_ts").filter("end_n is not null")
    asked = as_of(asked.withColumn("event_ts", c("prediction_time")), frame, ["n"], strict=False, key="_sk").withColumnRenamed("n", "_start").drop("bar_ts")
    asked = asked.withColumn("first_n", F.least(c("_start") + 1, c("end_n")))
    df = asked.join(path_extremes(asked, bars), "id")
    change = ratio(c("end_close"), c("entry_price")) - 1
    long, short = c("prediction") == "UP", c("prediction") == "DOWN"
    df = df.withColumn("actual_return", change)
    df = df.withColumn("actual", F.when(change > c("threshold"), "UP").when(change < -c("threshold"), "DOWN").otherwise("FLAT"))
    gain = (c("end_close") - c("entry_price")) * F.when(long, 1).otherwise(-1)
    confidence = F.greatest("prob_down", "prob_flat", "prob_up")
    failure = (F.when(c("data_quality") < 0.6, "DATA_QUALITY").when(confidence >= 0.65, "OVERCONFIDENCE").when(c("prediction") == "FLAT", "MAGNITUDE_ERROR")
               .when(F.abs("actual_return") > F.greatest(c("threshold") * 2, F.lit(0.02)), "VOLATILITY_SPIKE").otherwise("WRONG_DIRECTION"))
    return df.withColumns({
        "stop_hit": F.when(long, c("path_low") <= c("stop_loss")).when(short, c("path_high") >= c("stop_loss")).otherwise(False),
        "target_hit": F.when(long, c("path_high") >= c("tp1")).when(short, c("path_low") <= c("tp1")).otherwise(False),
        "realized_r": F.when(long | short, gain / F.greatest(F.abs(c("entry_price") - c("stop_loss")), F.lit(1e-12))).otherwise(0.0),
        "mae": F.when(short, ratio(c("entry_price"), c("path_high")) - 1).otherwise(ratio(c("path_low"), c("entry_price")) - 1),
        "mfe": F.when(short, ratio(c("entry_price"), c("path_low")) - 1).otherwise(ratio(c("path_high"), c("entry_price")) - 1),
        "correct": c("actual") == c("prediction"), "failure": F.when(c("actual") != c("prediction"), failure)}).drop("_sk", "event_ts", "_start", "first_n", "end_n", "path_low", "path_high")


CLASSES = ("DOWN", "FLAT", "UP")


def _scores() -> dict[str, Column]:
    """Aggregates that together give every class metric; all partial-aggregate on the map side."""
    c = F.col
    out = {"samples": F.count(F.lit(1)), "accuracy": F.avg((c("prediction") == c("actual")).cast("double"))}
    brier = F.lit(0.0)
    for k in CLASSES:
        p = c(f"prob_{k.lower()}")
        brier = brier + F.pow(p - (c("actual") == k).cast("double"), 2)
        out[f"_tp_{k}"] = F.sum(((c("prediction") == k) & (c("actual") == k)).cast("double"))
        out[f"_pp_{k}"] = F.sum((c("prediction") == k).cast("double"))
        out[f"_ap_{k}"] = F.sum((c("actual") == k).cast("double"))
    mine = F.when(c("actual") == "DOWN", c("prob_down")).when(c("actual") == "FLAT", c("prob_flat")).otherwise(c("prob_up"))
    sure = F.greatest("prob_down", "prob_flat", "prob_up")
    out["brier_score"] = F.avg(brier)
    out["log_loss"] = -F.avg(F.ln(F.least(F.lit(1.0), F.greatest(mine, F.lit(1e-12)))))
    out["calibration_gap"] = F.avg(F.abs(sure - (c("prediction") == c("actual")).cast("double")))
    return out


def _macro(df: DataFrame) -> DataFrame:
    c = F.col
    one = F.lit(1.0)
    p = {k: c(f"_tp_{k}") / F.greatest(c(f"_pp_{k}"), one) for k in CLASSES}
    r = {k: c(f"_tp_{k}") / F.greatest(c(f"_ap_{k}"), one) for k in CLASSES}
    mean = lambda v: (v["DOWN"] + v["FLAT"] + v["UP"]) / 3
    f1 = {k: 2 * p[k] * r[k] / F.greatest(p[k] + r[k], F.lit(1e-12)) for k in CLASSES}
    return df.withColumns({"precision_macro": mean(p), "recall_macro": mean(r), "f1_macro": mean(f1), "baseline": F.greatest(*[f"_ap_{k}" for k in CLASSES]) / c("samples")})


def statistics(resolved: DataFrame) -> DataFrame:
    """Scores overall, by horizon and by regime in one pass (grouping sets)."""
    c = F.col
    r = c("realized_r")
    extra = {"stop_hit_rate": F.avg(c("stop_hit").cast("double")), "tp_hit_rate": F.avg(c("target_hit").cast("double")), "average_r": F.avg(r),
             "_g": F.sum(F.when(r > 0, r).otherwise(0.0)), "_l": F.sum(F.when(r < 0, -r).otherwise(0.0)), "_rs": F.stddev_samp(r),
             "ic": corr(c("prob_up") - c("prob_down"), c("actual_return"))}
    sets = resolved.groupingSets([[], ["horizon"], ["regime"]], "horizon", "regime").agg(
        F.grouping_id().alias("gid"), *[v.alias(k) for k, v in {**_scores(), **extra}.items()])
    out = _macro(sets).withColumns({"profit_factor": ratio(c("_g"), c("_l")), "sharpe": F.sqrt(F.lit(252.0)) * ratio(c("average_r"), c("_rs"))})
    return out.withColumn("level", F.when(c("gid") == 3, "overall").when(c("gid") == 1, "horizon").otherwise("regime")).withColumn(
        "key", F.coalesce("horizon", "regime", F.lit("all"))).drop(*[x for x in out.columns if x.startswith("_")], "gid", "horizon", "regime")


def reliability(resolved: DataFrame) -> DataFrame:
    """Ten confidence bins and the expected calibration error they add up to."""
    c = F.col
    df = resolved.withColumns({"_c": F.greatest("prob_down", "prob_flat", "prob_up"), "_k": (c("prediction") == c("actual")).cast("double")})
    bins = df.groupBy(F.least(F.lit(9), F.floor(F.round(c("_c") * 10, 9))).alias("bin")).agg(F.count(F.lit(1)).alias("samples"), F.avg("_c").alias("predicted"), F.avg("_k").alias("observed"))
    total = Window.partitionBy(F.lit(1))
    return bins.withColumn("ece", F.sum(c("samples") * F.abs(c("predicted") - c("observed"))).over(total) / F.sum("samples").over(total))


def track_record(resolved: DataFrame) -> DataFrame:
    """Edge over the majority class overall and by horizon, asset and market."""
    c = F.col
    sets = resolved.groupingSets([[], ["horizon"], ["symbol"], ["market"]], "horizon", "symbol", "market").agg(
        F.grouping_id().alias("gid"), *[v.alias(k) for k, v in _scores().items()])
    out = _macro(sets).withColumn("edge", c("accuracy") - c("baseline"))
    out = out.withColumns({"level": F.when(c("gid") == 7, "overall").when(c("gid") == 3, "horizon").when(c("gid") == 5, "asset").otherwise("market"),
                           "key": F.coalesce("horizon", "symbol", "market", F.lit("all")),
                           "status": F.when(c("samples") < 30, "INSUFFICIENT_EVIDENCE").when(c("edge") >= 0.03, "USEFUL").otherwise("NO_EDGE")})
    return out.drop(*[x for x in out.columns if x.startswith("_")], "gid", "horizon", "symbol", "market")


def model_lab(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.abs("actual_return")).alias("mean_move"))


def snapshot_changes(snapshots: DataFrame, least: float = 3.0) -> DataFrame:
    """Per symbol and horizon, whether the newest snapshot turned or moved P(up) by ``least`` points."""
    c = F.col
    w = Window.partitionBy("symbol", "horizon").orderBy("generated_at")
    df = snapshots.withColumns({"_d": F.lag("direction").over(w), "_u": F.lag("up").over(w), "_r": F.row_number().over(Window.partitionBy("symbol", "horizon").orderBy(F.desc("generated_at")))})
    df = df.filter("_r = 1 and _d is not null")
    return df.filter((c("_d") != c("direction")) | (F.abs(c("up") - c("_u")) >= least)).select(
        "symbol", "horizon", c("_d").alias("from"), c("direction").alias("to"), (c("up") - c("_u")).alias("up_delta"))


def latest_group(predictions: DataFrame) -> DataFrame:
    """All horizons of each symbol's newest prediction time."""
    newest = F.max("prediction_time").over(Window.partitionBy("symbol"))
    return predictions.withColumn("_t", newest).filter("prediction_time = _t").drop("_t")


def newest(predictions: DataFrame, top: int) -> DataFrame:
    return predictions.orderBy(F.desc("id")).limit(top)


def change_log(scores: DataFrame, key: str = "symbol", value: str = "score", order: str = "ts") -> DataFrame:
    """Only the rows where a value differs from the one before."""
    prior = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return scores.withColumn("previous", prior).filter(F.col("previous").isNull() | (F.col("previous") != F.col(value))).withColumn("delta", F.col(value) - F.col("previous"))


def mark_to_market(positions: DataFrame, quotes: DataFrame, cash: DataFrame) -> DataFrame:
    """Value, unrealised profit and equity per currency; an unquoted position stays at cost."""
    c = F.col
    df = positions.join(quotes.select("symbol", "price"), "symbol", "left").withColumn("_p", F.coalesce("price", "average_cost"))
    held = df.groupBy("currency").agg(F.sum(c("quantity") * c("_p")).alias("value"), F.sum(c("quantity") * (c("_p") - c("average_cost"))).alias("unrealized"))
    return cash.join(held, "currency", "left").select("currency", "cash", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("unrealized", F.lit(0.0)).alias("unrealized"),
                                                      (c("cash") + F.coalesce("value", F.lit(0.0))).alias("equity"))


def daily_pnl(marks: DataFrame) -> DataFrame:
    """Latest equity of each day and currency against the first of that day."""
    return marks.groupBy(F.to_date("ts").alias("trading_date"), "currency").agg((F.max_by("equity", "ts") - F.min_by("equity", "ts")).alias("pnl"))


def evidence_level(score: Column, samples: Column) -> Column:
    return F.when(score.isNull(), "D").when((samples >= 250) & (score >= 70), "A").when((samples >= 120) & (score >= 55), "B").otherwise("C")


def intelligence_snapshot(predictions: DataFrame, factors: DataFrame, news: DataFrame) -> DataFrame:
    """One row per symbol and horizon with evidence grade, signed factor shares and the news evidence score.

    ``predictions`` needs symbol, horizon, prediction, prob_*, confidence, samples; ``factors`` needs symbol,
    feature, importance, positive; ``news`` needs symbol, sentiment, impact.
    """
    c = F.col
    parts = factors.groupBy("symbol").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-c("importance")).alias("o"), "feature", F.when(c("positive"), c("importance")).otherwise(-c("importance")).alias("s")))),
                                                                     lambda x: F.concat_ws(":", x["feature"], F.format_string("%.4f", x["s"] * 100))), "|").alias("contributions"))
    score = news.groupBy("symbol").agg(F.avg(c("sentiment") * c("impact") / 100).alias("news_score"), F.count(F.lit(1)).alias("news_count"))
    return (predictions.join(parts, "symbol", "left").join(score, "symbol", "left")
            .withColumns({"evidence": evidence_level(c("confidence"), c("samples")), "news_score": F.coalesce("news_score", F.lit(0.0)), "news_count": F.coalesce("news_count", F.lit(0))}))
