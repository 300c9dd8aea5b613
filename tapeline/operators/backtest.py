"""Back-tests and path statistics as set-oriented jobs over all series at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions import ranks
from tapeline.functions.series import KEYS, ahead, back, by_time, clip, numbered, ratio, whole
from tapeline.operators import signals as sg
from tapeline.operators.barriers import first_passage, spaced_entries
from tapeline.schema import INTERVAL_MINUTES
from tapeline.session import cut

RUN_KEYS = (*KEYS, "strategy")


def _run(*order: str):
    return Window.partitionBy(*RUN_KEYS).orderBy(*(order or ("ts",)))


def classic_signals(charted: DataFrame, with_model: bool = False) -> DataFrame:
    """Long-flat signals of the classic rules, one row per bar and rule; NULL keeps the position.

    Needs ma5, ma20, macd, macd_signal and rsi; with a model also ai_up.
    """
    c = F.col
    no = F.lit(False)
    table = {"ma": F.coalesce(c("ma5") > c("ma20"), no), "macd": F.coalesce(c("macd") > c("macd_signal"), no),
             "rsi": F.when(c("rsi") < 35, True).when(c("rsi") > 65, False)}
    if with_model:
        table["ai"] = c("ai_up") > 0.55
        table["ai_technical"] = F.when(c("ai_up").isNotNull(), F.coalesce((c("ai_up") > 0.55) & (c("macd") > c("macd_signal")) & (c("close") > c("ma20")), no))
    pairs = F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("active")) for k, v in table.items()])
    return charted.select(*KEYS, "ts", "open", "high", "low", "close", F.inline(pairs))


def equity_curve(signals: DataFrame, cash: float, fee: float, slippage: float) -> DataFrame:
    """All-in long or flat, acting at the next bar's open.

    A bar multiplies equity by a factor that depends only on its position and the
    one before, so the curve is a running product and needs no loop.
    """
    c = F.col
    w = _run()
    hold = F.coalesce(F.last("active", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    df = signals.withColumn("held", hold)
    df = df.withColumns({"was": F.coalesce(F.lag("held").over(w), F.lit(False)), "_pc": F.lag("close").over(w)})
    enter, leave = c("held") & ~c("was"), ~c("held") & c("was")
    growth = (F.when(enter, ratio(c("close"), c("open") * (1 + slippage) * (1 + fee)))
              .when(leave, ratio(c("open") * (1 - slippage) * (1 - fee), c("_pc")))
              .when(c("held"), ratio(c("close"), c("_pc"))).otherwise(1.0))
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"enter": enter, "leave": leave,
                         "equity": cash * F.product(growth).over(up_to),
                         "last": F.max("ts").over(Window.partitionBy(*RUN_KEYS)) == c("ts")})
    first = F.first("close").over(up_to)
    df = df.withColumns({"peak": F.greatest(F.lit(cash), F.max("equity").over(up_to)), "benchmark": ratio(cash * c("close"), first),
                         "trade": F.sum(enter.cast("long")).over(up_to),
                         "closing": F.when(c("last") & c("held"), c("equity") * (1 - slippage) * (1 - fee)).otherwise(c("equity"))})
    return df.withColumns({"drawdown": (c("peak") - c("equity")) / c("peak"), "published": F.round("closing", 2)}).drop("_pc", "was")


def trades(curve: DataFrame, cash: float) -> DataFrame:
    """Closed round trips with their cash result; an open one closes at the last bar."""
    c = F.col
    w = _run()
    df = curve.withColumn("_before", F.coalesce(F.lag("equity").over(w), F.lit(cash)))
    done = c("leave") | (c("last") & c("held"))
    return (df.groupBy(*RUN_KEYS, "trade").agg(
        F.min(F.when(c("enter"), c("ts"))).alias("entry_ts"), F.min(F.when(done, c("ts"))).alias("exit_ts"),
        F.max(F.when(c("enter"), c("_before"))).alias("paid"), F.max(F.when(done, c("closing"))).alias("got"))
        .filter("trade > 0").withColumn("pnl", c("got") - c("paid")))


def metrics(curve: DataFrame, closed: DataFrame, cash: float, crypto: bool = True) -> DataFrame:
    """Return, risk and trade statistics of each run."""
    c = F.col
    w = _run()
    days_a_year = 365.0 if crypto else 252.0
    per_day = F.create_map(*[F.lit(x) for k, m in INTERVAL_MINUTES.items() for x in (k, 1440.0 / m)])
    df = curve.withColumn("_r", (c("published") - F.lag("published").over(w)) / F.greatest(F.lag("published").over(w), F.lit(1e-12)))
    runs = df.groupBy(*RUN_KEYS).agg(
        F.max_by("closing", "ts").alias("final_cash"), F.max("drawdown").alias("dd"), F.max_by("benchmark", "ts").alias("bench"),
        F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"), F.stddev_samp(F.when(c("_r") < 0, c("_r"))).alias("_d"),
        F.min("ts").alias("data_start"), F.max("ts").alias("data_end"))
    book = closed.groupBy(*RUN_KEYS).agg(
        F.count(F.lit(1)).alias("trade_count"), F.count(F.when(c("pnl") > 0, 1)).alias("winning_trades"),
        F.sum(F.when(c("pnl") > 0, c("pnl")).otherwise(0.0)).alias("_gain"), F.sum(F.when(c("pnl") <= 0, -c("pnl")).otherwise(0.0)).alias("_loss"))
    df = runs.join(book, list(RUN_KEYS), "left").fillna(0, ["trade_count", "winning_trades", "_gain", "_loss"])
    periods = F.sqrt(per_day[c("interval")] * days_a_year)
    days = F.greatest(F.lit(1), F.floor((F.unix_seconds("data_end") - F.unix_seconds("data_start")) / 86400))
    years = F.greatest(days / (365.0 if crypto else 365.25), F.lit(1 / 365.25))
    gain = c("final_cash") / cash
    return df.select(
        *RUN_KEYS, F.round("final_cash", 2).alias("final_cash"), F.round((gain - 1) * 100, 2).alias("return_percent"),
        F.round(F.when(gain > 0, (F.pow(gain, 1 / years) - 1) * 100).otherwise(-100.0), 2).alias("annualized_return_percent"),
        F.round(c("dd") * 100, 2).alias("max_drawdown_percent"), F.round((c("bench") / cash - 1) * 100, 2).alias("benchmark_return_percent"),
        F.round(F.coalesce(ratio(c("_m"), c("_s")) * periods, F.lit(0.0)), 3).alias("sharpe_ratio"),
        F.round(F.coalesce(ratio(c("_m"), c("_d")) * periods, F.lit(0.0)), 3).alias("sortino_ratio"),
        "trade_count", "winning_trades", (c("trade_count") - c("winning_trades")).alias("losing_trades"),
        F.round(F.coalesce(ratio(c("winning_trades").cast("double"), c("trade_count").cast("double")) * 100, F.lit(0.0)), 2).alias("win_rate_percent"),
        F.round(F.when(c("_loss") > 0, c("_gain") / c("_loss")).when(c("_gain") > 0, 999.0), 3).alias("profit_factor"))


def threshold_and_hold(charted: DataFrame, threshold: float = 30.0, hold: int = 5) -> DataFrame:
    """Signals of "enter after RSI below threshold, leave after ``hold`` bars" for ``equity_curve``.

    An entry at bar e blocks entries until its exit at e + hold; that bar itself
    cannot re-enter, so kept entries are hold + 1 apart.
    """
    c = F.col
    df = numbered(charted).select(*KEYS, "n", "ts", "open", "high", "low", "close", "rsi").withColumn("strategy", F.lit("rsi_hold"))
    entries = spaced_entries(df.filter(c("rsi") < threshold), RUN_KEYS, hold + 1)
    marks = (entries.select(*RUN_KEYS, "n", F.lit(True).alias("active"))
             .unionByName(entries.select(*RUN_KEYS, (c("n") + hold).alias("n"), F.lit(False).alias("active"))))
    return df.join(marks, [*RUN_KEYS, "n"], "left").drop("n", "rsi")


# --- barrier back-tests of the strategy rules ---------------------------------------


def barrier_trades(ctx: DataFrame, keys: list[str], *, fee: float = 0.001, slippage: float = 0.0005, horizon: int = 8,
                   first_bar: int | Column = 80, threshold: float | str = 24.0, group: tuple[str, ...] = RUN_KEYS,
                   spread: Callable[[DataFrame], DataFrame] | None = None, only: str | None = None) -> DataFrame:
    """Signal at close, entry at the next open, exit at stop, target or after ``horizon`` bars.

    Stop first when one bar touches both.  Trades of a run never overlap: after a
    trade the next ``horizon`` bars are skipped.  ``spread`` may tag or multiply the
    decision bars (folds, parameters) and may read ``bars``, the length of their series; its columns go into ``group``.  ``only`` names a column with the strategies a tagged bar may run.
    """
    c = F.col
    paths = ctx.select(*KEYS, "n", "ts", "high", "low", "close")
    ctx = ctx.withColumns({"bars": F.max("n").over(whole()) + 1, "next_open": F.lead("open").over(by_time()), "next_ts": F.lead("ts").over(by_time())})
    ctx = ctx.filter((c("n") >= first_bar) & (c("n") < c("bars") - horizon - 1))
    found = sg.signals(spread(ctx) if spread else ctx, keys, threshold)
    found = found.filter("status = 'AVAILABLE' and signal <> 'HOLD'")
    if only:
        found = found.filter(F.array_contains(only, c("strategy")))
    side = F.when(c("signal") == "BUY", 1).otherwise(-1)
    entry = c("next_open") * (1 + side * slippage)
    anchor = F.coalesce(F.when(side > 0, c("l1_price")).otherwise(c("h1_price")), entry - side * 1.5 * c("unit"))
    found = cut(found.select(*group, "n", "ts", c("next_ts").alias("execution_ts"), "signal", side.alias("side"), entry.alias("entry"), anchor.alias("anchor"), "unit"))
    stop = F.when(c("side") > 0, F.least(c("anchor") - 0.2 * c("unit"), c("entry") - 0.75 * c("unit"))).otherwise(
        F.greatest(c("anchor") + 0.2 * c("unit"), c("entry") + 0.75 * c("unit")))
    found = found.join(spaced_entries(found, group, horizon), [*group, "n"], "left_semi").withColumn("stop", stop)
    found = found.withColumn("target", c("entry") + c("side") * F.abs(c("entry") - c("stop")) * 1.75)
    found = first_passage(found, paths, horizon)
    return found.select(
        *group, "n", "ts", "execution_ts", "signal", "side", "entry", "stop", "target", "exit", "outcome",
        (c("side") * (c("exit") / c("entry") - 1) - 2 * fee - slippage).alias("ret"),
        F.when(c("side") > 0, c("bottom") / c("entry") - 1).otherwise(1 - c("top") / c("entry")).alias("mae"),
        F.when(c("side") > 0, c("top") / c("entry") - 1).otherwise(1 - c("bottom") / c("entry")).alias("mfe"))


def trade_curve(trade_list: DataFrame, cash: float, group: tuple[str, ...] = RUN_KEYS) -> DataFrame:
    """Compounded equity over a run's trades."""
    w = Window.partitionBy(*group).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = trade_list.withColumn("growth", F.product(1 + F.col("ret")).over(w))
    df = df.withColumn("peak", F.greatest(F.lit(1.0), F.max("growth").over(w)))
    return df.withColumns({"equity": F.round(cash * F.col("growth"), 2), "drawdown": 1 - F.col("growth") / F.col("peak")})


def trade_metrics(trade_list: DataFrame, group: tuple[str, ...] = RUN_KEYS) -> DataFrame:
    c = F.col
    df = trade_curve(trade_list, 1.0, group)
    r = c("ret")
    out = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("number_of_trades"), F.avg((r > 0).cast("double")).alias("win_rate"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_g"), F.sum(F.when(r <= 0, -r).otherwise(0.0)).alias("_l"),
        F.avg(r).alias("expectancy"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("average_win"),
        F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("average_loss"), F.max("drawdown").alias("max_drawdown"),
        F.stddev_samp(r).alias("_s"), F.stddev_samp(F.when(r < 0, r)).alias("_d"), F.avg("mae").alias("mae"), F.avg("mfe").alias("mfe"),
        F.max_by("growth", "n").alias("growth"))
    root = F.sqrt(c("number_of_trades").cast("double"))
    return out.select(
        *group, "number_of_trades", "win_rate", ratio(c("_g"), c("_l")).alias("profit_factor"), "expectancy", "average_win", "average_loss",
        "max_drawdown", F.coalesce(ratio(c("expectancy"), c("_s")) * root, F.lit(0.0)).alias("sharpe"),
        F.coalesce(ratio(c("expectancy"), c("_d")) * root, F.lit(0.0)).alias("sortino"),
        ratio(c("expectancy"), c("max_drawdown")).alias("calmar"), "mae", "mfe", ((c("growth") - 1) * 100).alias("return_percent"))


def walk_forward(ctx: DataFrame, keys: list[str], folds: int = 4, least: int = 120, embargo: int = 8) -> DataFrame:
    """Expanding folds: signals after each fold's embargo whose path ends inside its test span."""
    c = F.col

    def tag(df: DataFrame) -> DataFrame:
        edge = lambda i: F.floor(least + (c("bars") - least) * i / folds)
        fold = F.lit(None).cast("int")
        for i in range(folds):
            fold = F.when((c("n") >= edge(i) + embargo) & (c("n") < edge(i + 1) - 9), i + 1).otherwise(fold)
        return df.filter(c("bars") >= least + 80).withColumn("fold", fold).filter("fold is not null")

    group = (*RUN_KEYS, "fold")
    return trade_metrics(barrier_trades(ctx, keys, first_bar=0, group=group, spread=tag), group)


def parameter_grid(bars: DataFrame, keys: list[str], swings: tuple[int, ...] = (2, 3, 4), thresholds: tuple[float, ...] = (20.0, 28.0, 36.0), embargo: int = 12) -> DataFrame:
    """Swing width and signal threshold by segment: screened on train, chosen on validation, judged out of sample.

    Returns every combination's train and validation metrics with its selection score, and the out-of-sample metrics
    of the locked combination alone: the others are never run on those bars.
    """
    c = F.col
    group = (*RUN_KEYS, "swing", "threshold", "segment")
    widths = {width: cut(sg.context(bars, swing=width)).withColumn("swing", F.lit(width)) for width in swings}

    def chosen_on(df: DataFrame) -> DataFrame:
        train, valid = F.floor(c("bars") * 0.55), F.floor(c("bars") * 0.75)
        part = F.when((c("n") >= 80) & (c("n") < train - 9), "train").when((c("n") >= train + embargo) & (c("n") < valid - 9), "validation")
        df = df.filter(c("bars") >= 360).withColumn("segment", part).filter("segment is not null")
        return df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))

    def trades(spread: Callable[[DataFrame], DataFrame], only: str | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, [barrier_trades(ctx, keys, first_bar=0, threshold="threshold", group=group, spread=spread, only=only) for ctx in widths.values()])

    m = cut(trade_metrics(trades(chosen_on), group))
    at = lambda seg, name: F.max(F.when(c("segment") == seg, c(name)))
    score = at("validation", "expectancy") + 0.05 * at("validation", "sharpe") - 0.1 * at("validation", "max_drawdown")
    able = (at("train", "number_of_trades") >= 2) & (at("validation", "number_of_trades") >= 2)
    combos = m.groupBy(*RUN_KEYS, "swing", "threshold").agg(F.when(able, score).alias("selection_score"))
    best = F.max(F.struct("selection_score", -c("swing"), -c("threshold"))).over(Window.partitionBy(*RUN_KEYS))
    locked = c("selection_score").isNotNull() & (F.struct("selection_score", -c("swing"), -c("threshold")) == best)
    combos = cut(combos.withColumn("locked", locked))
    winners = combos.filter("locked").groupBy(*KEYS, "swing", "threshold").agg(F.collect_set("strategy").alias("allowed"))

    def held_out(df: DataFrame) -> DataFrame:
        df = df.filter((c("bars") >= 360) & (c("n") >= F.floor(c("bars") * 0.75) + embargo))
        return df.withColumn("segment", F.lit("out_of_sample")).join(winners, [*KEYS, "swing"])

    judged = trade_metrics(trades(held_out, "allowed"), group)
    return m.unionByName(judged).join(combos, [*RUN_KEYS, "swing", "threshold"])


def incremental(metrics_table: DataFrame, variants: tuple[str, ...], baseline: str) -> DataFrame:
    """What each variant adds to a baseline, per series; judged only with five trades on both sides. No trades count as zeros."""
    c, zero = F.col, F.lit(0.0)
    names = ("win_rate", "expectancy", "sharpe", "max_drawdown")
    side = lambda mark, *keys: metrics_table.select(*KEYS, *keys, c("number_of_trades").alias(f"{mark}trades"), *[c(n).alias(f"{mark}{n}") for n in names])
    told = metrics_table.filter(c("strategy").isin(*variants, baseline)).select(*KEYS).distinct()
    told = told.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    j = (told.join(side("_a_", c("strategy").alias("variant")), [*KEYS, "variant"], "left")
         .join(side("_b_", "strategy").filter(c("strategy") == baseline).drop("strategy"), list(KEYS), "left"))
    enough = (F.coalesce("_a_trades", F.lit(0)) >= 5) & (F.coalesce("_b_trades", F.lit(0)) >= 5)
    return j.select(*KEYS, "variant", *[(F.coalesce(f"_a_{n}", zero) - F.coalesce(f"_b_{n}", zero)).alias(n) for n in names],
                    F.when(enough, "VALIDATED").otherwise("NOT_VALIDATED").alias("status"))


def leaderboard(runs: DataFrame) -> DataFrame:
    """Newest run per series and strategy, best expectancy first."""
    newest = F.row_number().over(Window.partitionBy(*RUN_KEYS).orderBy(F.desc("created_at"), F.desc("run_id")))
    top = runs.withColumn("_r", newest).filter("_r = 1").drop("_r")
    order = [F.desc_nulls_last("expectancy"), F.desc_nulls_last("sharpe"), *[F.asc(x) for x in RUN_KEYS]]
    return ranks.numbered(top, [], order, "_place", "_all").withColumn("rank", (F.col("_place") + 1).cast("int")).drop("_place", "_all")


# --- paths, stops and portfolios ----------------------------------------------------


def path_risk(bars: DataFrame, steps: int, side: str = "LONG", stop_share: float = 0.02, target_share: float = 0.03) -> DataFrame:
    """Distribution of the worst and best excursion over the next ``steps`` bars."""
    c = F.col
    w = ahead(1, steps)
    df = bars.withColumns({"_end": F.lead("close", steps).over(by_time()), "_lo": F.min("low").over(w), "_hi": F.max("high").over(w)}).filter("_end is not null")
    long = side == "LONG"
    df = df.select(*KEYS, (ratio(c("_lo"), c("close")) - 1 if long else ratio(c("close"), c("_hi")) - 1).alias("mae"),
                   (ratio(c("_hi"), c("close")) - 1 if long else ratio(c("close"), c("_lo")) - 1).alias("mfe"),
                   ((ratio(c("_end"), c("close")) - 1) * (1 if long else -1)).alias("ret"))
    q = lambda name, p: F.percentile(name, F.lit(p))
    return df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("samples"), q("mae", 0.5).alias("mae_median"), q("mae", 0.1).alias("mae_p10"),
        F.percentile(F.when(c("ret") > 0, c("mae")), F.lit(0.5)).alias("mae_winning_median"),
        q("mfe", 0.5).alias("mfe_median"), q("mfe", 0.75).alias("mfe_p75"),
        F.avg((c("mae") <= -stop_share).cast("double")).alias("stop_hit"), F.avg((c("mfe") >= target_share).cast("double")).alias("target_hit"),
        F.avg("ret").alias("expected_return")).filter("samples >= 60")


def excursions(bars: DataFrame, steps: int, side: str = "LONG") -> DataFrame:
    """Per bar in ATR units: adverse, favourable and terminal move of the next ``steps`` bars (needs atr)."""
    c = F.col
    w = ahead(1, steps)
    df = numbered(bars.filter("atr is not null").drop("n"))
    df = df.withColumns({"_lo": F.min("low").over(w), "_hi": F.max("high").over(w), "_end": F.lead("close", steps).over(by_time())})
    df = df.filter((c("n") >= 20) & c("_end").isNotNull() & (c("atr") > 0))
    down, up = c("close") - c("_lo"), c("_hi") - c("close")
    bad, good = (down, up) if side == "LONG" else (up, down)
    end = (c("_end") - c("close")) * (1 if side == "LONG" else -1)
    zero = F.lit(0.0)
    return df.select(*KEYS, "n", "ts", F.greatest(zero, bad / c("atr")).alias("adverse"), F.greatest(zero, good / c("atr")).alias("favorable"),
                     (end / c("atr")).alias("terminal"))


def stop_grid(bars: DataFrame, steps: int, side: str = "LONG", low: float = 0.8, high: float = 3.6, reward: float = 1.5) -> DataFrame:
    """Score every ATR stop multiple on the first 70 % of a series' observations; ``best`` marks the winner."""
    c = F.col
    obs = excursions(bars, steps, side)
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("n"))
    size = F.count(F.lit(1)).over(whole())
    train = obs.withColumns({"_i": place, "_n": size}).filter(c("_i") <= F.greatest(F.lit(30), F.floor(c("_n") * 0.7)))
    count = int(round((high - low) / 0.1)) + 1
    grid = train.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("multiplier", F.round(low + c("k") * 0.1, 1))
    m = c("multiplier")
    grid = grid.withColumn("outcome", F.when(c("adverse") >= m, -1.0).when(c("favorable") >= m * reward, reward).otherwise(c("terminal") / m))
    w = Window.partitionBy(*KEYS, "multiplier").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("_sum", F.sum("outcome").over(w)).withColumn("_peak", F.greatest(F.lit(0.0), F.max("_sum").over(w)))
    out = grid.groupBy(*KEYS, "multiplier").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("outcome").alias("mean_r"), F.max(c("_peak") - c("_sum")).alias("max_dd"),
        F.avg((c("adverse") >= m).cast("double")).alias("stop_hit_rate"))
    out = out.withColumn("score", c("mean_r") - 0.0025 * c("max_dd"))
    return out.withColumn("best", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("score"), "multiplier")) == 1)


def validate_plan(bars: DataFrame, steps: int, multiplier: float, reward: float, side: str = "LONG") -> DataFrame:
    """Outcome of a stop/target plan over the last 30 % of each series, stop first (needs atr)."""
    c = F.col
    w = ahead(1, steps)
    df = numbered(bars.filter("atr is not null").drop("n"))
    df = df.withColumns({"_lo": F.min("low").over(w), "_hi": F.max("high").over(w), "_end": F.lead("close", steps).over(by_time()),
                         "_size": F.count(F.lit(1)).over(whole())})
    df = df.filter((c("n") >= F.greatest(F.lit(30), F.floor(c("_size") * 0.7))) & c("_end").isNotNull() & (c("atr") > 0))
    unit = c("atr") * multiplier
    way = 1 if side == "LONG" else -1
    stop, goal = c("close") - way * unit, c("close") + way * unit * reward
    stopped = c("_lo") <= stop if way > 0 else c("_hi") >= stop
    reached = c("_hi") >= goal if way > 0 else c("_lo") <= goal
    df = df.select(*KEYS, "n", F.when(stopped, -1.0).when(reached, reward).otherwise((c("_end") - c("close")) / unit * way).alias("r"),
                   stopped.cast("double").alias("_s"), (~stopped & reached).cast("double").alias("_t"))
    run = Window.partitionBy(*KEYS).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_sum", F.sum("r").over(run)).withColumn("_peak", F.greatest(F.lit(0.0), F.max("_sum").over(run)))
    return df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("_s").alias("stop_hit_rate"), F.avg("_t").alias("tp_hit_rate"), F.avg("r").alias("average_r"),
        F.max(c("_peak") - c("_sum")).alias("max_drawdown_r"),
        ratio(F.sum(F.when(c("r") > 0, c("r")).otherwise(0.0)), F.sum(F.when(c("r") < 0, -c("r")).otherwise(0.0))).alias("profit_factor"))


def long_short(scored: DataFrame, every: int, share: float) -> DataFrame:
    """Top-minus-bottom return and turnover on every ``every``-th session; needs session_date, symbol, score, future_return."""
    c = F.col
    sessions = scored.select("session_date").distinct()
    pick = Window.orderBy("session_date")
    chosen = sessions.withColumn("_i", F.row_number().over(pick) - 1).filter(c("_i") % every == 0).select("session_date")
    x = Window.partitionBy("session_date")
    df = scored.join(chosen, "session_date").withColumns({
        "_r": F.row_number().over(x.orderBy("score", "symbol")), "_n": F.count(F.lit(1)).over(x)})
    df = df.withColumn("_k", F.greatest(F.lit(1), F.ceil(c("_n") * share)))
    top, bottom = c("_r") > c("_n") - c("_k"), c("_r") <= c("_k")
    per = df.groupBy("session_date").agg(
        F.avg(F.when(top, c("future_return"))).alias("_up"), F.avg(F.when(bottom, c("future_return"))).alias("_dn"), F.max("_k").alias("_k"),
        F.sort_array(F.collect_list(F.when(top, c("symbol")))).alias("_long"), F.sort_array(F.collect_list(F.when(bottom, c("symbol")))).alias("_short"))
    empty = F.array().cast("array<string>")
    moved = lambda a: (F.size(F.array_except(c(a), c(f"{a}0"))) + F.size(F.array_except(c(f"{a}0"), c(a))))
    per = per.withColumns({"_long0": F.coalesce(F.lag("_long").over(pick), empty), "_short0": F.coalesce(F.lag("_short").over(pick), empty)})
    return per.select("session_date", (c("_up") - c("_dn")).alias("gross"), ((moved("_long") + moved("_short")) / (2 * c("_k"))).alias("turnover"))


def portfolio_metrics(returns: DataFrame, periods: int, cost: float, group: tuple[str, ...] = ()) -> DataFrame:
    """Net performance of per-session gross returns after turnover cost."""
    c = F.col
    keyed = returns if group else returns.withColumn("_all", F.lit(1))
    keys = group or ("_all",)
    run = Window.partitionBy(*keys).orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    df = keyed.withColumn("net", c("gross") - c("turnover") * cost)
    df = df.withColumn("_eq", F.product(1 + F.coalesce("net", F.lit(0.0))).over(run))
    df = df.withColumn("_dd", c("_eq") / F.greatest(F.max("_eq").over(run), F.lit(1e-12)) - 1)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), (F.max_by("_eq", "session_date") - 1).alias("total_return"), F.avg("net").alias("_m"),
        F.stddev_samp("net").alias("_s"), F.stddev_samp(F.when(c("net") < 0, c("net"))).alias("_d"), F.min("_dd").alias("maximum_drawdown"),
        F.sum("turnover").alias("turnover"), F.sum(c("turnover") * cost).alias("transaction_cost"))
    years = F.greatest(c("observations") / periods, F.lit(1 / periods))
    out = out.withColumn("annualized_return", F.when(c("total_return") > -1, F.pow(1 + c("total_return"), 1 / years) - 1).otherwise(-1.0))
    root = periods ** 0.5
    return out.select(*group, "observations", "total_return", "annualized_return", (c("_s") * root).alias("volatility"),
                      (ratio(c("_m"), c("_s")) * root).alias("sharpe"), (ratio(c("_m"), c("_d")) * root).alias("sortino"), "maximum_drawdown",
                      F.when(c("maximum_drawdown") < 0, c("annualized_return") / F.abs("maximum_drawdown")).alias("calmar"), "turnover", "transaction_cost")
