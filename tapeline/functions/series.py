"""Building blocks for ordered bar series.

A series is all bars of one ``(symbol, interval)``.  Bars are unique per
calendar bucket, so a series has at most ``span / interval`` rows however many
trades fell into it: one window partition per series is bounded by the calendar
and not by the volume of raw data.  Everything below uses that one
partitioning, so a chain of indicators costs a single exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ("symbol", "interval")
BLOCK = 512


def by_time(*keys: str):
    return Window.partitionBy(*(keys or KEYS)).orderBy("ts")


def trail(n: int, upto: int = 0):
    """The ``n`` bars that end ``-upto`` bars before the current one."""
    return by_time().rowsBetween(upto - n + 1, upto)


def ahead(first: int, last: int):
    return by_time().rowsBetween(first, last)


def upto_now():
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def before_now():
    return by_time().rowsBetween(Window.unboundedPreceding, -1)


def whole():
    return Window.partitionBy(*KEYS)


def full(agg: Column, value: Column, n: int, upto: int = 0, least: int | None = None) -> Column:
    """``agg`` over a trailing frame, NULL until it holds ``least`` (default ``n``) values."""
    frame = trail(n, upto)
    return F.when(F.count(value).over(frame) >= (least or n), agg.over(frame))


def avg_n(value: Column, n: int, **kw) -> Column:
    return full(F.avg(value), value, n, **kw)


def std_n(value: Column, n: int, **kw) -> Column:
    return full(F.stddev_samp(value), value, n, **kw)


def sum_n(value: Column, n: int, **kw) -> Column:
    return full(F.sum(value), value, n, **kw)


def max_n(value: Column, n: int, **kw) -> Column:
    return full(F.max(value), value, n, **kw)


def min_n(value: Column, n: int, **kw) -> Column:
    return full(F.min(value), value, n, **kw)


def quantile_n(value: Column, n: int, q: float, **kw) -> Column:
    return full(F.percentile(value, F.lit(q)), value, n, **kw)


def back(value: Column | str, n: int = 1) -> Column:
    return F.lag(value, n).over(by_time())


def ratio(a: Column, b: Column) -> Column:
    """Division that yields NULL for a zero or missing divisor."""
    return F.when(b != 0, a / b)


def corr(a: Column | str, b: Column | str, over=None) -> Column:
    """Pearson correlation of complete pairs; NULL without spread (the built-in fails there in ANSI mode)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    parts = (F.covar_pop(a, b), F.stddev_pop(F.when(b.isNotNull(), a)), F.stddev_pop(F.when(a.isNotNull(), b)))
    both, left, right = (p.over(over) for p in parts) if over is not None else parts
    return ratio(both, left * right)


def change(value: Column, n: int) -> Column:
    return ratio(value, back(value, n)) - 1


def crossed_up(a: Column, b: Column) -> Column:
    return (F.coalesce(back(a), F.lit(0.0)) <= F.coalesce(back(b), F.lit(0.0))) & (F.coalesce(a, F.lit(0.0)) > F.coalesce(b, F.lit(0.0)))


def crossed_down(a: Column, b: Column) -> Column:
    return (F.coalesce(back(a), F.lit(0.0)) >= F.coalesce(back(b), F.lit(0.0))) & (F.coalesce(a, F.lit(0.0)) < F.coalesce(b, F.lit(0.0)))


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp; NULL stays NULL (GREATEST and LEAST alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def numbered(bars: DataFrame) -> DataFrame:
    if "n" in bars.columns:
        return bars
    return bars.withColumn("n", (F.row_number().over(by_time()) - 1).cast("long"))


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


class Ewm(dict):
    """A step of exponential means: output -> (input, alpha) or (input, alpha, place of the first value).

    The place defaults to 0; None finds it per series.
    """


def compose(bars: DataFrame, *specs: list[dict]) -> DataFrame:
    """Apply several step lists together, step by step.

    Steps at the same position share one projection (or one pass of exponential
    means), so many indicators cost few plan layers.  Columns that start with an
    underscore are scratch and dropped at the end.
    """
    for depth in range(max(len(s) for s in specs)):
        plain, means = {}, Ewm()
        for spec in specs:
            step = spec[depth] if depth < len(spec) else {}
            (means if isinstance(step, Ewm) else plain).update(step)
        if plain:
            bars = bars.withColumns(plain)
        if means:
            bars = ewm(bars, means)
    return bars.drop(*[c for c in bars.columns if c.startswith("_")])


def ewm(bars: DataFrame, outputs: dict[str, tuple]) -> DataFrame:
    """Recursive exponential means ``y = (1-a)*y_prev + a*x``, first value as start.

    No fold and no UDF: inside blocks of 512 bars the recursion is a running sum
    of ``x * d^-p`` (d = 1-a, p = place in block), which cannot overflow at that
    length.  The value at a block end is the block's own sum plus the ends of the
    preceding blocks scaled by ``d^512`` each; as many blocks are added as count
    at double precision.  All windows share the series' partitioning and one
    sort.  NULLs are allowed before the first value only: from a later one on the
    series' result is NULL, as the recursion has no value to go on with.
    """
    bars = numbered(bars)
    kept = bars.columns
    n, p = F.col("n"), F.col("_p")
    start = {out: F.col(f"_s_{out}") if len(spec) > 2 and spec[2] is None else F.lit(spec[2] if len(spec) > 2 else 0)
             for out, spec in outputs.items()}
    bars = bars.withColumns({"_b": F.floor(n / BLOCK), "_p": n % BLOCK, **{
        f"_s_{out}": F.min(F.when(F.col(spec[0]).isNotNull(), n)).over(whole())
        for out, spec in outputs.items() if len(spec) > 2 and spec[2] is None}})
    within = Window.partitionBy(*KEYS, "_b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    series = Window.partitionBy(*KEYS).orderBy("_b", "ts")  # time order, spelled so that the sort is shared
    local, ends, result = {}, {}, {}
    for out, (col, alpha, *_) in outputs.items():
        decay = 1.0 - alpha
        weight = F.when(n == start[out], 1.0).otherwise(alpha)
        term = F.coalesce(F.col(col) * weight, F.lit(0.0)) * F.pow(F.lit(decay), -p)
        local[f"_l_{out}"] = F.sum(term).over(within) * F.pow(F.lit(decay), p)
        per_block = math.log(decay) * BLOCK
        total = F.col(f"_l_{out}")
        for k in range(1, max(1, math.ceil(math.log(1e-20) / per_block)) + 1):
            total = total + F.coalesce(F.lag(f"_l_{out}", BLOCK * k).over(series), F.lit(0.0)) * math.exp(per_block * k)
        ends[f"_e_{out}"] = F.when(p == BLOCK - 1, total)
        carry = F.last(f"_e_{out}", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
        value = F.col(f"_l_{out}") + F.coalesce(carry, F.lit(0.0)) * F.pow(F.lit(decay), p + 1)
        gap = F.max((F.col(col).isNull() & (n >= start[out])).cast("int")).over(series.rowsBetween(Window.unboundedPreceding, 0))
        result[out] = F.when((n >= start[out]) & (gap == 0), value)
    bars = bars.withColumns(local).withColumns(ends)
    return bars.select(*[c for c in kept if c not in result], *[v.alias(k) for k, v in result.items()])


def latest(bars: DataFrame) -> DataFrame:
    """The last bar of every series."""
    return (bars.withColumn("_last", F.max("ts").over(whole()))
            .filter(F.col("ts") == F.col("_last")).drop("_last"))


def as_of(events: DataFrame, bars: DataFrame, payload: list[str], *, strict: bool, forward: bool = True,
          key: str = "symbol", event_ts: str = "event_ts") -> DataFrame:
    """Attach to each event the first bar at or after it (``strict``: after it), or
    the last bar at or before it with ``forward=False`` (``strict``: before it).

    Union and one window over ``key`` in time order instead of a range join.  Keys
    with far more events than bars are split by day first: an event meets the bars
    of its own day in the window, and only the day's remainder looks up the next
    (previous) day that has bars, from a table of one row per key and day.
    """
    day = F.to_date
    sign = 1 if forward else -1
    bar_side = bars.select(key, F.col("ts").alias("_t"), F.struct("ts", *payload).alias("_bar"))
    event_cols = F.struct(*[F.col(c) for c in events.columns]).alias("_ev")
    # Tie order at equal time decides strictness.
    bar_first = (strict and forward) or (not strict and not forward)
    union = (bar_side.select(key, "_t", F.lit(0 if bar_first else 1).alias("_o"), "_bar",
                             F.lit(None).cast(_struct_type(events)).alias("_ev"))
             .unionByName(events.select(key, F.col(event_ts).alias("_t"), F.lit(1 if bar_first else 0).alias("_o"),
                                        F.lit(None).cast(bar_side.schema["_bar"].dataType).alias("_bar"), event_cols)))
    union = union.withColumn("_d", day("_t"))
    w = Window.partitionBy(key, "_d").orderBy("_t", "_o")
    near = (F.first("_bar", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward
            else F.last("_bar", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = union.withColumn("_near", near).filter(F.col("_ev").isNotNull()).select(key, "_d", "_ev", "_near")
    # One row per key and day: its edge bar, and the edge bar of the next day that has one.
    pick = F.min_by if forward else F.max_by
    days = (bar_side.groupBy(key, day("_t").alias("_d")).agg(pick("_bar", "_t").alias("_edge"))
            .unionByName(events.select(key, day(event_ts).alias("_d")).distinct()
                         .withColumn("_edge", F.lit(None).cast(bar_side.schema["_bar"].dataType)))
            .groupBy(key, "_d").agg(F.first("_edge", ignorenulls=True).alias("_edge")))
    dw = Window.partitionBy(key).orderBy(F.col("_d"))
    far = (F.first("_edge", ignorenulls=True).over(dw.rowsBetween(1, Window.unboundedFollowing)) if forward
           else F.last("_edge", ignorenulls=True).over(dw.rowsBetween(Window.unboundedPreceding, -1)))
    days = days.withColumn("_far", far).select(key, "_d", "_far")
    joined = found.join(days, [key, "_d"], "left")
    hit = F.coalesce(F.col("_near"), F.col("_far"))
    return joined.select("_ev.*", hit.getField("ts").alias("bar_ts"),
                         *[hit.getField(c).alias(c if c not in events.columns else f"bar_{c}") for c in payload])


def _struct_type(df: DataFrame):
    from pyspark.sql import types as T
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
