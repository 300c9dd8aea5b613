"""Capital flow, regimes, price zones, anomalies and cross-asset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions import ranks
from tapeline.functions.series import KEYS, back, by_time, change, clip, corr, latest, max_n, numbered, ratio, std_n, trail, whole
from tapeline.operators import candles
from tapeline.operators.comoments import pair_correlation
from tapeline.session import cut

REVERSED = ("symbol", "interval")


def _from_end():
    return Window.partitionBy(*KEYS).orderBy(F.desc("ts"))


def turnover() -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.when(F.col("amount") > 0, F.col("amount")).otherwise(typical * F.col("volume"))


def capital_flow(bars: DataFrame, derivatives: DataFrame | None = None) -> DataFrame:
    """Signed turnover of the newest window against the one before it, per series.

    ``derivatives`` (symbol, open_interest_change) adds the price/open-interest quadrant.
    """
    c = F.col
    size = F.least(F.lit(32), F.greatest(F.lit(8), F.floor(F.count(F.lit(1)).over(whole()) / 20)))
    df = bars.withColumns({"_t": turnover(), "_s": F.coalesce(F.signum(c("close") - back("close")), F.lit(0.0)), "_w": size,
                           "_r": F.row_number().over(_from_end())})
    df = df.filter(c("_r") <= 2 * c("_w")).withColumn("_f", c("_s") * c("_t"))
    recent, prior = c("_r") <= c("_w"), c("_r") > c("_w")
    df = df.withColumn("_net", F.sum(F.when(recent, c("_f"))).over(whole()))
    out = df.groupBy(*KEYS).agg(
        F.max("_net").alias("net"), F.sum(F.when(recent, F.abs("_t"))).alias("gross"), F.sum(F.when(prior, c("_f"))).alias("_pn"),
        F.sum(F.when(prior, F.abs("_t"))).alias("_pg"), F.avg(F.when(recent, (F.signum("_f") == F.signum("_net")).cast("double"))).alias("_p"),
        F.max_by("close", "ts").alias("_c1"), F.min_by(F.when(recent, c("close")), F.when(recent, c("ts"))).alias("_c0"),
        F.sum(F.when(recent & (c("_f") > 0), c("_f")).otherwise(0.0)).alias("active_buy"),
        F.sum(F.when(recent & (c("_f") < 0), -c("_f")).otherwise(0.0)).alias("active_sell"))
    zero = F.lit(0.0)
    share, before = F.coalesce(ratio(c("net"), c("gross")), zero), F.coalesce(ratio(c("_pn"), c("_pg")), zero)
    out = out.withColumns({"flow_ratio": share, "_before": before, "momentum": ratio(c("_c1"), c("_c0")) - 1,
                           "persistence": F.when(c("net") != 0, c("_p")).otherwise(0.5)})
    flow, move = c("flow_ratio"), c("momentum")
    out = out.select(*KEYS, "net", "gross", "flow_ratio", (flow - c("_before") / 2).alias("flow_momentum"), (flow - c("_before")).alias("flow_acceleration"),
                     "persistence", "momentum", "active_buy", "active_sell",
                     F.when((move > 0) & (flow < 0), "BEARISH_DIVERGENCE").when((move < 0) & (flow > 0), "BULLISH_DIVERGENCE").otherwise("CONFIRMED").alias("relation"),
                     F.when(flow > 0.02, "INFLOW").when(flow < -0.02, "OUTFLOW").otherwise("NEUTRAL").alias("direction"))
    if derivatives is None:
        return out
    oi = c("open_interest_change")
    return out.join(derivatives.select("symbol", "open_interest_change"), "symbol", "left").withColumn(
        "price_oi_relation", F.when(oi.isNotNull(), F.when((move > 0) & (oi > 0), "PRICE_UP_OI_UP").when(move > 0, "PRICE_UP_OI_DOWN")
                                    .when(oi > 0, "PRICE_DOWN_OI_UP").otherwise("PRICE_DOWN_OI_DOWN"))).drop("open_interest_change")


def market_regime(bars: DataFrame, flow: DataFrame, macro: DataFrame | None = None, news: DataFrame | None = None) -> DataFrame:
    """Regime, risk mode and liquidity at each series' last bar.

    ``macro`` (symbol, macro_signal) and ``news`` (symbol, news_score) tilt the risk mode.
    """
    c = F.col
    df = bars.withColumns({"_ret": change(c("close"), 1), "_ret5": change(c("close"), 5), "_ma20": F.avg("close").over(trail(20)),
                           "_ma60": F.avg("close").over(trail(60)), "_v20": F.avg("volume").over(trail(20)), "_v60": F.avg("volume").over(trail(60, -20))})
    df = df.withColumns({"_vol": std_n(c("_ret"), 20), "_slope": change(c("_ma20"), 5), "_end": F.max("ts").over(whole())})
    end = df.filter("ts = _end").select(*KEYS, "ts", "close", "_vol", "_slope", "_ret5", "_ma60", "_v20", "_v60")
    rank = (df.filter("ts < _end and _vol is not null").select(*KEYS, c("_vol").alias("_past"))
            .join(end.select(*KEYS, c("_vol").alias("_now")), list(KEYS))
            .groupBy(*KEYS).agg(F.avg((c("_past") <= c("_now")).cast("double")).alias("_rank")))
    df = end.join(rank, list(KEYS), "left").join(flow.select(*KEYS, "flow_ratio"), list(KEYS), "left")
    df = df.join(macro, "symbol", "left") if macro is not None else df.withColumn("macro_signal", F.lit(None).cast("string"))
    df = df.join(news, "symbol", "left") if news is not None else df.withColumn("news_score", F.lit(None).cast("double"))
    calm = F.greatest(c("_vol"), F.lit(1e-6))
    df = df.withColumns({"volatility_percentile": F.coalesce("_rank", F.lit(0.5)),
                         "trend_score": F.tanh(c("_slope") / calm) * 0.6 + F.signum(c("close") - c("_ma60")) * 0.4,
                         "volume_ratio": c("_v20") / F.greatest(c("_v60"), F.lit(1e-12))})
    v, t = c("volatility_percentile"), c("trend_score")
    combined = (t + 0.25 * F.signum("flow_ratio") + F.when(c("macro_signal") == "POSITIVE", 0.15).when(c("macro_signal") == "NEGATIVE", -0.15).otherwise(0.0)
                + F.coalesce(clip(c("news_score"), -1.0, 1.0), F.lit(0.0)) * 0.08)
    df = df.withColumn("combined", combined)
    return df.select(
        *KEYS, "ts",
        F.when((v >= 0.9) & (c("_ret5") < -2 * calm), "PANIC").when((v >= 0.9) & (c("_ret5") > 2 * calm), "EUPHORIA").when(v >= 0.8, "HIGH_VOLATILITY")
        .when(v <= 0.2, "LOW_VOLATILITY").when(t > 0.45, "BULL_TREND").when(t < -0.45, "BEAR_TREND").when(F.abs(t) < 0.18, "SIDEWAYS").otherwise("TRANSITION").alias("regime"),
        F.when(c("combined") > 0.25, "RISK_ON").when(c("combined") < -0.25, "RISK_OFF").otherwise("NEUTRAL").alias("risk_mode"),
        F.when(c("volume_ratio") > 1.15, "IMPROVING").when(c("volume_ratio") < 0.8, "TIGHTENING").otherwise("NEUTRAL").alias("liquidity"),
        F.when(t > 0.2, "UP").when(t < -0.2, "DOWN").otherwise("SIDEWAYS").alias("trend"),
        F.when(v > 0.75, "HIGH").when(v < 0.25, "LOW").otherwise("MEDIUM").alias("volatility"), "volatility_percentile", "trend_score", "volume_ratio", "combined")


def snapshot_structure(charted: DataFrame) -> DataFrame:
    """Structure class of each series' last bar.  Pivots are centred (they look ahead),
    so this describes the present only and is not a historical feature.  Needs atr and obv."""
    c = F.col
    centred = by_time().rowsBetween(-3, 3)
    df = charted.withColumn("_r", F.row_number().over(_from_end())).filter("_r <= 160")
    complete = F.count("high").over(centred) == 7
    point = lambda name, agg: F.when(complete & (c(name) == agg(name).over(centred)), c(name))
    df = df.withColumns({"_ph": point("high", F.max), "_pl": point("low", F.min), "_do": c("obv") - back("obv"), "_dc": change(c("close"), 1)})
    tail = F.max("_r").over(whole())
    last2 = lambda name: F.slice(F.sort_array(F.collect_list(F.when(c(name).isNotNull(), F.struct("ts", c(name).alias("p"))))), -2, 2)
    in_last = lambda n, skip=0: (c("_r") > skip) & (c("_r") <= n + skip)
    when = lambda cond, name: F.when(cond, c(name))
    out = df.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.when(c("_ph").isNotNull(), F.struct("ts", c("_ph").alias("p"))))).alias("_hs"),
        F.sort_array(F.collect_list(F.when(c("_pl").isNotNull(), F.struct("ts", c("_pl").alias("p"))))).alias("_ls"),
        F.max_by("close", "ts").alias("current"), F.max_by("atr", "ts").alias("_atr"), F.max_by("volume", "ts").alias("_v"),
        F.max(when(in_last(40, 1), "high")).alias("prior_high"), F.min(when(in_last(40, 1), "low")).alias("prior_low"),
        F.percentile(when(in_last(30), "volume"), F.lit(0.5)).alias("_mv"), F.max(when(in_last(8), "high")).alias("_h8"), F.min(when(in_last(8), "low")).alias("_l8"),
        F.avg(when(in_last(20), "_do")).alias("_os"), F.avg(when(in_last(20), "_dc")).alias("_ps"))
    newer = lambda a, up: (F.size(a) >= 2) & ((F.element_at(a, -1)["p"] > F.element_at(a, -2)["p"]) if up else F.lit(False))
    safe = lambda name: F.when(F.size(name) >= 2, F.element_at(name, -1)["p"] > F.try_element_at(name, F.lit(-2))["p"]).otherwise(False)
    atr = F.greatest(c("_atr"), c("current") * 0.001)
    out = out.withColumns({"high_pattern": F.when(safe("_hs"), "HIGHER_HIGH").otherwise("LOWER_HIGH"), "low_pattern": F.when(safe("_ls"), "HIGHER_LOW").otherwise("LOWER_LOW"),
                           "volume_confirmed": c("_v") > c("_mv") * 1.25, "range_width": (c("prior_high") - c("prior_low")) / F.greatest(c("current"), F.lit(1e-12))})
    cur, ph, pl = c("current"), c("prior_high"), c("prior_low")
    retest_high = (F.abs(cur - ph) <= 0.35 * atr) & (c("_h8") > ph)
    retest_low = (F.abs(cur - pl) <= 0.35 * atr) & (c("_l8") < pl)
    tight = c("range_width") < 0.06
    kind = (F.when(cur > ph, F.when(c("volume_confirmed"), "BREAKOUT").otherwise("FAKE_BREAKOUT_RISK"))
            .when(cur < pl, F.when(c("volume_confirmed"), "BREAKDOWN").otherwise("LIQUIDITY_SWEEP_RISK"))
            .when(retest_high, "RETEST_OF_BREAKOUT").when(retest_low, "RETEST_OF_BREAKDOWN")
            .when(tight & (c("_os") > 0) & (c("_ps") <= 0), "ACCUMULATION").when(tight & (c("_os") < 0) & (c("_ps") >= 0), "DISTRIBUTION")
            .when((c("high_pattern") == "HIGHER_HIGH") & (c("low_pattern") == "HIGHER_LOW"), "UPTREND_STRUCTURE")
            .when((c("high_pattern") == "LOWER_HIGH") & (c("low_pattern") == "LOWER_LOW"), "DOWNTREND_STRUCTURE").otherwise("RANGE_OR_TRANSITION"))
    return out.select(*KEYS, kind.alias("structure"), "high_pattern", "low_pattern", "prior_high", "prior_low", "volume_confirmed",
                      (retest_high | retest_low).alias("retest"), "range_width")


def zones(charted: DataFrame, keep: int = 3) -> DataFrame:
    """Support and resistance zones at each series' last bar (needs atr, ma*, boll_*).

    Candidate levels are a small table per series (at most some sixty rows); bars
    meet them in one equi-join on the series, reduced to counts before anything
    is gathered.
    """
    c = F.col
    df = charted.withColumn("_r", F.row_number().over(_from_end())).filter("_r <= 500")
    centred = by_time().rowsBetween(-4, 4)
    nine = F.count("high").over(centred) == 9
    typical = (c("high") + c("low") + c("close")) / 3
    df = df.withColumns({"_sh": F.when(nine & (c("high") == F.max("high").over(centred)), c("high")), "_sl": F.when(nine & (c("low") == F.min("low").over(centred)), c("low")),
                         "_ph": back("high"), "_pl": back("low"), "_tp": typical})
    df = df.withColumn("_gap", F.when(c("low") > c("_ph"), (c("low") + c("_ph")) / 2).when(c("high") < c("_pl"), (c("high") + c("_pl")) / 2))
    df = cut(df)  # at most 500 rows per series, read nine times below
    ends = df.groupBy(*KEYS).agg(
        F.max_by("close", "ts").alias("current"), F.max_by("atr", "ts").alias("atr"), F.max("high").alias("top"), F.min("low").alias("bottom"),
        F.min_by("ts", F.struct("low", "ts")).alias("low_at"), F.max_by("ts", F.struct("high", -F.unix_micros("ts"))).alias("high_at"),
        *[F.max_by(x, "ts").alias(x) for x in ("ma5", "ma10", "ma20", "ma60", "boll_lower", "boll_upper")])
    ends = ends.withColumn("width", F.greatest(c("atr") * 0.35, c("current") * 0.001))
    flows = (df.join(ends.select(*KEYS, "low_at", "high_at"), list(KEYS)).groupBy(*KEYS).agg(
        *[(F.sum(F.when(cond, c("_tp") * c("volume"))) / F.greatest(F.sum(F.when(cond, c("volume"))), F.lit(1e-12))).alias(name)
          for name, cond in (("vwap", F.lit(True)), ("anchored_vwap_low", c("ts") >= c("low_at")), ("anchored_vwap_high", c("ts") >= c("high_at")))]))
    wide = ends.join(flows, list(KEYS))
    span = c("top") - c("bottom")
    fixed = [(c("vwap"), "vwap"), (c("anchored_vwap_low"), "anchored_vwap_low"), (c("anchored_vwap_high"), "anchored_vwap_high"),
             *[(c("bottom") + span * x, "fibonacci") for x in (0.236, 0.382, 0.5, 0.618, 0.786)],
             *[(c(x), x) for x in ("ma5", "ma10", "ma20", "ma60", "boll_lower", "boll_upper")], (c("top"), "prior_high"), (c("bottom"), "prior_low")]
    levels = wide.select(*KEYS, F.inline(F.array(*[F.struct(v.alias("price"), F.lit(n).alias("source")) for v, n in fixed]))).filter("price is not null")
    profile = candles.volume_profile(df.select(*KEYS, "ts", "high", "low", "close", "volume", "amount"))
    levels = levels.unionByName(profile.select(*KEYS, "price", F.lit("volume_profile_dense_node").alias("source")))
    for col, name, n in (("_sh", "swing", 12), ("_sl", "swing", 12), ("_gap", "gap", 8)):
        some = df.filter(c(col).isNotNull()).withColumn("_k", F.row_number().over(_from_end())).filter(c("_k") <= n)
        levels = levels.unionByName(some.select(*KEYS, c(col).alias("price"), F.lit(name).alias("source")))
    frame = wide.select(*KEYS, "current", "width")
    order = F.row_number().over(Window.partitionBy(*KEYS).orderBy("price", "source"))
    levels = levels.withColumn("id", order).join(frame, list(KEYS))
    near = (levels.select(*KEYS, "id", "price", "width").join(df.select(*KEYS, "high", "low", "close"), list(KEYS)).groupBy(*KEYS, "id").agg(
        F.count(F.when((c("low") <= c("price") + c("width")) & (c("high") >= c("price") - c("width")), 1)).alias("touches"),
        F.count(F.when(F.abs(c("close") - c("price")) <= c("width"), 1)).alias("residence")))
    peak = profile.groupBy(*KEYS).agg(F.max("weight").alias("_peak"), F.collect_list(F.struct("rank", "price", "weight")).alias("_nodes"))
    every = levels.groupBy(*KEYS).agg(F.collect_list("price").alias("_all"))
    levels = levels.join(near, [*KEYS, "id"]).join(peak, list(KEYS)).join(every, list(KEYS))
    node = F.element_at(F.reverse(F.sort_array(F.filter("_nodes", lambda x: F.abs(x["price"] - c("price")) <= c("width")))), 1)
    hits = F.filter("_nodes", lambda x: F.abs(x["price"] - c("price")) <= c("width"))
    volume_score = F.when(F.size(hits) > 0, node["weight"] / F.greatest(c("_peak"), F.lit(1.0))).otherwise(0.0)
    levels = levels.withColumns({"confluence": F.size(F.filter("_all", lambda x: F.abs(x - c("price")) <= c("width"))),
                                 "volume_score": volume_score, "side": F.when(c("price") < c("current"), "support").when(c("price") > c("current"), "resistance")})
    strength = F.least(F.lit(100.0), F.bround(10 * F.least(c("touches"), F.lit(5)) + 8 * F.least(c("confluence"), F.lit(4)) + 8 * c("volume_score") + 2 * F.least(c("residence"), F.lit(5))))
    item = F.struct(F.abs(c("price") - c("current")).alias("distance"), c("price"), "source", strength.alias("strength"), "touches", "residence", "confluence", "width")
    sides = levels.filter("side is not null").groupBy(*KEYS, "side").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    # Nearest first; a candidate joins unless it lies within one width of a kept one.
    fold = F.expr(f"""aggregate(_items, cast(array() as array<struct<distance:double,price:double,source:string,strength:double,touches:bigint,residence:bigint,confluence:int,width:double>>),
        (kept, x) -> if(size(kept) >= {keep} or exists(kept, k -> abs(k.price - x.price) <= x.width), kept, concat(kept, array(x))))""")
    return (sides.select(*KEYS, "side", F.posexplode(fold).alias("rank", "z"))
            .select(*KEYS, "side", (c("rank") + 1).alias("rank"), c("z.price").alias("center"), (c("z.price") - c("z.width")).alias("lower"),
                    (c("z.price") + c("z.width")).alias("upper"), "z.strength", "z.touches", "z.residence", "z.confluence", c("z.source").alias("primary_source")))


def rotation(bars: DataFrame, window: int = 40) -> DataFrame:
    """Return and flow share over each symbol's newest bars, strongest first."""
    c = F.col
    df = bars.withColumn("_r", F.row_number().over(_from_end())).filter(c("_r") <= window)
    df = df.withColumns({"_p": back("close"), "_t": F.when(c("amount") != 0, c("amount")).otherwise(c("close") * c("volume"))})
    out = df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("bars"), (ratio(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1).alias("ret"),
        F.sum(F.when(c("_p").isNotNull(), c("_t") * F.signum(c("close") - c("_p")))).alias("_s"), F.sum(F.when(c("_p").isNotNull(), F.abs("_t"))).alias("_g"))
    flow = c("_s") / F.greatest(c("_g"), F.lit(1e-12))
    out = out.filter("bars >= 8").select(*KEYS, "ret", flow.alias("flow_ratio"), (c("ret") * 4 + flow).alias("rotation_score"))
    placed = ranks.numbered(out, [], [F.desc("rotation_score"), F.asc("symbol")], "_place", "_all")
    return placed.withColumn("rank", (F.col("_place") + 1).cast("int")).drop("_place", "_all")


def returns_of(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "interval", "ts", (change(F.col("close"), 1)).alias("ret")).filter("ret is not null")


def cross_correlation(bars: DataFrame, target: str, window: int = 120, least: int = 30) -> DataFrame:
    """Correlation of one target with every peer over their newest shared stamps.

    One target against the others is linear in the data: each peer row meets at
    most one target row.
    """
    rets = returns_of(bars)
    mine = rets.filter(F.col("symbol") == target).select("ts", F.col("ret").alias("_mine"))
    pairs = rets.filter(F.col("symbol") != target).join(mine, "ts")
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    size = F.least(F.lit(window), F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    pairs = pairs.withColumns({"_r": newest, "_k": size}).filter(F.col("_r") <= F.col("_k"))
    return (pairs.groupBy("symbol").agg(corr("_mine", "ret").alias("correlation"), F.count(F.lit(1)).alias("samples"))
            .filter(F.col("samples") >= least).withColumn("target", F.lit(target)))


def momentum_environment(bars: DataFrame, target: str, least: int = 30, newest: int = 24) -> DataFrame:
    """Momentum of a target and of its peers (those with ``least`` shared stamps) over the newest stamps, and what both say.

    The target's counts its own newest returns, the peers' is the mean of each of the newest stamps of all, summed.  One
    row; none without ``least`` returns of the target.
    """
    c = F.col
    rets = returns_of(bars).filter("ret is not null")
    mine = rets.filter(c("symbol") == target)
    usable = (rets.filter(c("symbol") != target).join(mine.select("ts"), "ts").groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") >= least).select("symbol"))
    stamps = rets.select("ts").distinct().orderBy(F.desc("ts")).limit(newest)
    own = mine.orderBy(F.desc("ts")).limit(newest).agg(F.sum("ret").alias("target_momentum"))
    peers = rets.join(usable, "symbol").join(stamps, "ts").groupBy("ts").agg(F.avg("ret").alias("_m")).agg(F.coalesce(F.sum("_m"), F.lit(0.0)).alias("peer_momentum"))
    samples = mine.agg(F.count(F.lit(1)).alias("samples")).filter(c("samples") >= least)
    both = samples.crossJoin(own).crossJoin(peers)
    side = (F.when((c("target_momentum") > 0) & (c("peer_momentum") > 0), "FAVORABLE").when((c("target_momentum") < 0) & (c("peer_momentum") < 0), "UNFAVORABLE").otherwise("NEUTRAL"))
    return both.select(F.lit(target).alias("target"), "samples", "target_momentum", "peer_momentum", side.alias("environment"))


def portfolio_correlation(bars: DataFrame, weights: DataFrame, least: int = 60, width: int = 64) -> DataFrame:
    """Correlation of every pair of holdings over the stamps that all holdings share; none with fewer than ``least``."""
    held = weights.select("symbol").distinct()
    rets = returns_of(bars).join(held, "symbol")
    shared = rets.groupBy("ts").agg(F.count(F.lit(1)).alias("_k")).crossJoin(held.agg(F.count(F.lit(1)).alias("_n"))).filter("_k = _n").select("ts")
    return pair_correlation(rets.join(shared, "ts", "left_semi"), least=least, width=width)


def anomalies(charted: DataFrame) -> DataFrame:
    """Last value of volume, absolute return and volatility against its newest 120 (needs return_1, volatility)."""
    df = latest_window(charted, {"volume_spike": F.col("volume"), "price_spike": F.abs("return_1"), "volatility_spike": F.col("volatility")}, 120)
    names = ("volume_spike", "price_spike", "volatility_spike")
    return (df.unpivot(list(KEYS), [f"z_{n}" for n in names], "check", "z_score").withColumn("check", F.expr("substring(check, 3)"))
            .withColumn("active", F.abs("z_score") >= 2))


def latest_window(bars: DataFrame, values: dict[str, Column], n: int, least: int = 20) -> DataFrame:
    """z-score of each measure's last known value within its newest ``n`` known values."""
    c = F.col
    long = bars.select(*KEYS, "ts", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in values.items()]))).filter("value is not null")
    long = long.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS, "name").orderBy(F.desc("ts")))).filter(c("_r") <= n)
    stat = long.groupBy(*KEYS, "name").agg(F.max_by("value", "ts").alias("_v"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count("value").alias("_k"))
    z = F.when((c("_k") >= least) & (c("_s") != 0), (c("_v") - c("_m")) / c("_s")).otherwise(0.0)
    wide = stat.withColumn("z", z).groupBy(*KEYS).agg(*[F.max(F.when(c("name") == k, c("z"))).alias(f"z_{k}") for k in values])
    return wide.fillna(0.0)


def macro_signal(series: DataFrame) -> DataFrame:
    """Risk signal from dollar, yield and equity drift over 25 rows; needs label, ts, close."""
    c = F.col
    w = Window.partitionBy("label").orderBy("ts")
    end = Window.partitionBy("label").orderBy(F.desc("ts"))
    df = series.withColumns({"_old": F.lag("close", 24).over(w), "_r": F.row_number().over(end)}).filter("_r = 1")
    drift = F.signum(c("close") - c("_old"))
    side = F.when(c("label") == "SPX", 1).when(c("label").isin("DXY", "US10Y"), -1).otherwise(0)
    out = df.agg(F.sum(F.coalesce(drift, F.lit(0.0)) * side).alias("score"), F.count(F.lit(1)).alias("labels"))
    return out.withColumn("macro_signal", F.when(c("score") > 0, "POSITIVE").when(c("score") < 0, "NEGATIVE").otherwise("NEUTRAL"))


def notionals(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Position value at the last close; needs symbol, quantity."""
    last = latest(bars).select("symbol", F.col("close").alias("last_close"))
    return positions.join(last, "symbol").withColumn("notional", F.col("quantity") * F.col("last_close"))


def portfolio_risk(bars: DataFrame, weights: DataFrame, least: int = 60) -> DataFrame:
    """VaR, CVaR, volatility, drawdown and concentration over the stamps all holdings share."""
    c = F.col
    held = weights.groupBy("symbol").agg(F.sum("weight").alias("weight"))
    total = held.agg(F.sum("weight").alias("_t"), F.count(F.lit(1)).alias("_n"), F.sum(c("weight") * c("weight")).alias("_q"))
    joined = returns_of(bars).join(held, "symbol").crossJoin(F.broadcast(total))
    per = (joined.groupBy("ts").agg(F.sum(c("weight") / c("_t") * c("ret")).alias("r"), F.count(F.lit(1)).alias("k"), F.first("_n").alias("_n"),
                                    (F.first("_q") / F.pow(F.first("_t"), 2)).alias("hhi")).filter("k = _n"))
    run = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"_eq": F.product(1 + c("r")).over(run), "_all": F.lit(1)})
    per = per.withColumns({"_dd": 1 - c("_eq") / F.max("_eq").over(run), "_cut": F.percentile("r", F.lit(0.05)).over(Window.partitionBy("_all"))})
    return per.agg(F.count(F.lit(1)).alias("samples"), (-F.max("_cut")).alias("var_95"), (-F.avg(F.when(c("r") <= c("_cut"), c("r")))).alias("cvar_95"),
                   F.stddev_samp("r").alias("volatility"), F.max("_dd").alias("max_drawdown"), F.max("hhi").alias("concentration")).filter(c("samples") >= least)


def position_size(plans: DataFrame, account: float, risk: float, fee: float, slippage: float, leverage: float, contract: float, lot: float) -> DataFrame:
    """Units that keep the loss at the stop, with costs, within the risk budget; needs entry and stop."""
    c = F.col
    unit = F.abs(c("entry") - c("stop")) + c("entry") * (2 * fee + 2 * slippage)
    raw = account * risk / F.greatest(unit * contract, F.lit(1e-12))
    cap = account * leverage / F.greatest(c("entry") * contract, F.lit(1e-12))
    quantity = F.greatest(F.lit(0.0), F.floor(F.least(raw, cap) / lot) * lot)
    return plans.withColumns({"unit_risk": unit, "quantity": quantity}).withColumn("notional", c("quantity") * c("entry") * contract)


def take_profits(plans: DataFrame) -> DataFrame:
    """Three targets: structural levels joined with risk, ATR and typical-move multiples.

    Needs entry, stop, side (+1/-1), atr, typical_move and levels (array).
    """
    c = F.col
    risk = F.abs(c("entry") - c("stop"))
    made = F.array(*[c("entry") + c("side") * F.greatest(risk * x, c("atr") * x, c("typical_move") * x / 3) for x in (1.0, 1.75, 2.5)])
    pool = F.array_distinct(F.filter(F.concat("levels", made), lambda p: (p - c("entry")) * c("side") > 0))
    ordered = F.slice(F.when(c("side") > 0, F.sort_array(pool)).otherwise(F.sort_array(pool, asc=False)), 1, 3)
    return plans.withColumn("_tp", ordered).select("*", F.posexplode("_tp").alias("_i", "price")).select(
        *[x for x in plans.columns if x != "levels"], (c("_i") + 1).alias("target"), "price", (F.abs(c("price") - c("entry")) / F.greatest(risk, F.lit(1e-12))).alias("risk_reward"))


def dynamic_stop(plans: DataFrame) -> DataFrame:
    """Nearest valid stop among ATR multiple, recent swing and zone edge.

    Needs entry, atr, side, multiplier, volatility_percentile, swing and zone_edge.
    """
    c = F.col
    long = c("side") > 0
    buffer = c("atr") * (0.12 + 0.18 * c("volatility_percentile"))
    by_atr = c("entry") - c("side") * c("atr") * c("multiplier")
    pool = F.array(by_atr, c("swing") - c("side") * buffer, F.coalesce(c("zone_edge") - c("side") * buffer, by_atr))
    valid = F.filter(pool, lambda v: (c("entry") - v) * c("side") > 0)
    stop = F.coalesce(F.when(long, F.array_max(valid)).otherwise(F.array_min(valid)), by_atr)
    out = plans.withColumns({"buffer": buffer, "stop": stop}).withColumn("atr_distance", F.abs(c("entry") - c("stop")) / F.greatest(c("atr"), F.lit(1e-12)))
    return out.withColumn("reasonableness", F.when(c("atr_distance").between(0.65, 3.5), "NORMAL").when(c("atr_distance") < 0.65, "TOO_CLOSE_NOISE_RISK")
                          .otherwise("TOO_FAR_RISK_REWARD_RISK"))


def breakout_odds(df: DataFrame) -> DataFrame:
    """Breakout, fake-out and continuation scores; needs up, flow_ratio, trend_score, volume_confirmed, persistence."""
    c = F.col
    zero = F.lit(0.0)
    p = clip(0.45 * c("up") + 0.2 * F.greatest(zero, c("flow_ratio") * 4) + 0.2 * F.greatest(zero, c("trend_score")) + 0.15 * c("volume_confirmed").cast("double"), 0.0, 1.0)
    out = df.withColumn("breakout_probability", p)
    return out.withColumns({"fake_breakout_risk": clip((1 - c("breakout_probability")) * F.when(c("volume_confirmed"), 0.35).otherwise(0.65), 0.0, 1.0),
                            "continuation_probability": clip(c("breakout_probability") * (0.55 + 0.45 * c("persistence")), 0.0, 1.0)})


def opportunity(df: DataFrame) -> DataFrame:
    """Weighted opportunity score, risk level and the decision cascade.

    Needs prediction, up, flat, down, consensus, coverage, flow_ratio, flow_acceleration, trend_score,
    volatility_percentile, risk_reward, reward, stop_distance, entry, costs, event_risk and reasonableness.
    """
    c = F.col
    long = c("prediction") != "DOWN"
    win, lose = F.when(long, c("up")).otherwise(c("down")), F.when(long, c("down")).otherwise(c("up"))
    df = df.withColumns({"expected_value": win * c("reward") - lose * c("stop_distance") - c("costs"), "strength": F.greatest("up", "flat", "down")})
    stop_share = F.greatest(c("stop_distance") / c("entry"), F.lit(1e-6))
    parts = {"model": c("strength") * 0.18, "consensus": c("consensus") * 0.12, "flow": F.least(F.lit(1.0), F.abs("flow_ratio") * 8) * 0.12,
             "trend": F.least(F.lit(1.0), F.abs("trend_score")) * 0.12, "rr": clip(c("risk_reward") / 3, 0.0, 1.0) * 0.16,
             "ev": clip(0.5 + c("expected_value") / c("entry") / stop_share / 4, 0.0, 1.0) * 0.16, "coverage": c("coverage") * 0.09,
             "volatility": (1 - F.abs(c("volatility_percentile") - 0.55)) * 0.05}
    total = F.lit(0.0)
    for part in parts.values():
        total = total + part
    event = c("event_risk")
    risk = (0.3 * c("volatility_percentile") + 0.22 * (1 - c("strength")) + 0.18 * (1 - c("coverage")) + 0.18 * F.least(F.lit(1.0), F.abs("flow_acceleration") * 5)
            + F.when(event == "HIGH", 0.12).when(event == "MEDIUM", 0.06).otherwise(0.0))
    return df.withColumns({
        "opportunity": F.bround(100 * total), "risk_score": risk,
        "risk_level": F.when(risk >= 0.8, "EXTREME").when(risk >= 0.6, "HIGH").when(risk >= 0.35, "MEDIUM").otherwise("LOW"),
        "decision": F.when(c("coverage") < 0.4, "NO_TRADE").when(c("expected_value") <= 0, "NO_TRADE").when(event == "HIGH", "WAIT").when(c("prediction") == "FLAT", "HOLD")
        .when((c("strength") < 0.45) | (c("consensus") < 0.55), "WAIT").when(c("reasonableness") != "NORMAL", "WAIT").when(long, "BUY").otherwise("SELL")})


def context_snapshot(flow: DataFrame, regime: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row per series with flow, regime and rotation, and an alert on abrupt change."""
    joined = flow.join(regime, list(KEYS)).join(ranks.select(*KEYS, "rotation_score", "rank"), list(KEYS), "left")
    alert = (F.abs("flow_acceleration") > 0.08) | (F.col("volatility_percentile") > 0.9)
    return joined.select(*KEYS, "ts", "direction", "regime", "risk_mode", "liquidity", "volatility", "rotation_score", "rank", alert.alias("regime_change_risk"))


def timeframe_matrix(bars: DataFrame, source_minutes: int, targets: dict[str, int]) -> DataFrame:
    """Trend, flow, volatility and range of each series on several coarser frames at once."""
    c = F.col
    usable = {k: m for k, m in targets.items() if m >= source_minutes and m % source_minutes == 0}
    seconds = F.create_map(*[F.lit(x) for k, m in usable.items() for x in (k, m * 60)])
    df = bars.drop("interval").withColumn("interval", F.explode(F.array(*[F.lit(k) for k in usable])))
    step = seconds[c("interval")]
    df = (df.groupBy("symbol", "interval", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / step) * step).alias("_b"))
          .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
               F.sum("volume").alias("volume")).withColumnRenamed("_b", "ts"))
    prev = back("close")
    df = df.withColumns({"_ret": change(c("close"), 1), "_tr": F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev)),
                         "_r": F.row_number().over(_from_end()), "_n": F.count(F.lit(1)).over(whole()), "_mom": change(c("close"), 5)})
    cut = lambda n, v: F.when(c("_r") <= n, v)
    out = df.groupBy(*KEYS).agg(
        F.max("_n").alias("bars"), (ratio(F.max_by("close", "ts"), F.avg(cut(20, c("close")))) - 1).alias("trend_gap"),
        (F.sum(cut(10, F.coalesce(F.signum("_ret"), F.lit(0.0)) * c("volume"))) / F.greatest(F.sum(cut(10, c("volume"))), F.lit(1e-12))).alias("flow"),
        F.stddev_samp(cut(20, c("_ret"))).alias("volatility"), ratio(F.avg(cut(14, c("_tr"))), F.max_by("close", "ts")).alias("atr_share"),
        F.min(cut(40, c("low"))).alias("support"), F.max(cut(40, c("high"))).alias("resistance"), F.max_by("_mom", "ts").alias("momentum"))
    t, f = c("trend_gap"), c("flow")
    missing = [k for k in targets if k not in usable]
    if missing:  # frames that the source cannot make are reported, not left out
        out = out.unionByName(bars.select("symbol").distinct().withColumn("interval", F.explode(F.array(*[F.lit(k) for k in missing]))).withColumn("bars", F.lit(0).cast("long")), allowMissingColumns=True)
    return out.select(*KEYS, "bars", F.when(c("bars") == 0, "NO_DATA").when(c("bars") < 20, "INSUFFICIENT_DATA").otherwise("AVAILABLE").alias("status"),
                      F.when(c("bars") >= 20, F.when(t > 0.002, "UP").when(t < -0.002, "DOWN").otherwise("FLAT")).alias("trend"),
                      F.when(c("bars") >= 20, F.when(f > 0.03, "UP").when(f < -0.03, "DOWN").otherwise("FLAT")).alias("flow"),
                      "momentum", "volatility", "support", "resistance", "atr_share")
