"""First passages and spaced entries of whole series, as joins and folds inside the JVM.

Extremes of 2^j bars are kept per bar, so the first bar that meets a stop or a target is found by descent: one equi-join
on (series, bar) per power of two up to the horizon, whatever the number of bars in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeline.functions.series import KEYS, by_time
from tapeline.session import cut

BLOCK = 512


def extremes(bars: DataFrame, horizon: int) -> DataFrame:
    """Per bar: ``lows``/``highs`` (item j: over 2^j bars from this one on), the extremes and last close of ``horizon`` bars.

    Needs n, high, low, close.  Each level is the one before joined with its shifted self, so a bar costs one lag a level.
    Past the end of a series the extremes cover what there is and ``last_close`` is NULL.
    """
    c = F.col
    top = horizon.bit_length() - 1
    later = lambda name, k: F.lead(name, k).over(by_time())
    df = bars.select(*KEYS, "n", "ts", "close", c("low").alias("_l0"), c("high").alias("_h0"))
    for j in range(top):
        df = df.withColumns({f"_l{j + 1}": F.least(c(f"_l{j}"), later(f"_l{j}", 1 << j)), f"_h{j + 1}": F.greatest(c(f"_h{j}"), later(f"_h{j}", 1 << j))})
    rest = horizon - (1 << top)
    return df.select(*KEYS, "n", F.array(*[f"_l{j}" for j in range(top + 1)]).alias("lows"), F.array(*[f"_h{j}" for j in range(top + 1)]).alias("highs"),
                     F.least(c(f"_l{top}"), later(f"_l{top}", rest)).alias("worst_low"), F.greatest(c(f"_h{top}"), later(f"_h{top}", rest)).alias("best_high"),
                     later("close", horizon - 1).alias("last_close"))


def first_passage(entries: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Adds outcome, exit_n, exit, bottom and top of the ``horizon`` bars after bar n; needs n, side, stop, target.

    SL or TP at the first bar that touches the barrier, SL where one bar touches both, TIME at the last close; NULL where
    the series ends before.  A NULL barrier is never met.  Every entry keeps its row, equal ones too.
    """
    c = F.col
    table = cut(extremes(bars, horizon))
    up = c("side") > 0

    def meets(low, high):
        stopped = F.when(up, low <= c("stop")).otherwise(high >= c("stop"))
        reached = F.when(up, high >= c("target")).otherwise(low <= c("target"))
        return F.coalesce(stopped, F.lit(False)), F.coalesce(reached, F.lit(False))

    def at(df: DataFrame, *wanted: str) -> DataFrame:
        return df.join(table.select(*KEYS, c("n").alias("_p"), *wanted), [*KEYS, "_p"], "left")

    df = entries.withColumns({"_p": c("n") + 1, "_done": F.lit(0)})
    for j in reversed(range(horizon.bit_length())):
        first = 1 << (horizon.bit_length() - 1) == 1 << j
        df = at(df, "lows", "highs", *(("worst_low", "best_high", "last_close") if first else ()))
        stopped, reached = meets(c("lows")[j], c("highs")[j])
        step = F.when(~stopped & ~reached & (c("_done") + (1 << j) <= horizon), 1 << j).otherwise(0)
        df = df.withColumn("_step", step).withColumns({"_p": c("_p") + c("_step"), "_done": c("_done") + c("_step")}).drop("lows", "highs", "_step")
    df = at(df, "lows", "highs")
    stopped, reached = meets(c("lows")[0], c("highs")[0])
    over = c("_done") >= horizon
    outcome = F.when(~over & stopped, "SL").when(~over & reached, "TP").when(over & c("last_close").isNotNull(), "TIME")
    price = F.when(c("outcome") == "SL", c("stop")).when(c("outcome") == "TP", c("target")).when(c("outcome") == "TIME", c("last_close"))
    df = df.withColumn("outcome", outcome).withColumns({
        "exit_n": F.when(c("outcome") == "TIME", c("_p") - 1).when(c("outcome").isNotNull(), c("_p")), "exit": price})
    return (df.withColumnsRenamed({"worst_low": "bottom", "best_high": "top"})
            .drop("_p", "_done", "lows", "highs", "last_close"))


def spaced_entries(rows: DataFrame, keys: tuple[str, ...], gap: int, position: str = "n") -> DataFrame:
    """Positions that a greedy pass keeps, one row each: after one is taken, those less than ``gap`` after it are left out.

    How much of a gap is still open is one of ``gap`` states.  Every block of positions maps the state at its start to the
    state at its end on its own; only these maps are folded along a run, so no task sees more than a block of positions or
    a run's maps (its bars / 512).  Rows without a position take no part.
    """
    c = F.col
    size = max(BLOCK, gap)
    step = lambda free, p: F.when(p >= free, p + gap).otherwise(free)
    start = c("_block") * size
    leave = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(gap - 1).cast("long")),
                        lambda open_for: F.greatest(F.lit(0).cast("long"), F.aggregate("_at", start + open_for, step) - start - size))
    cells = (rows.filter(c(position).isNotNull()).select(*keys, c(position).cast("long").alias("_n"))
             .groupBy(*keys, F.floor(c("_n") / size).alias("_block")).agg(F.array_sort(F.collect_set("_n")).alias("_at")))
    chain = cells.select(*keys, "_block", leave.alias("_leave")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_leave"))).alias("_chain"))
    none = F.array().cast("array<struct<_block:bigint,_open:bigint>>")
    begin = F.struct(F.lit(None).cast("long").alias("block"), F.lit(0).cast("long").alias("left"), none.alias("seen"))

    def follow(acc, cell):
        opened = F.when(acc["block"] + 1 == cell["_block"], acc["left"]).otherwise(F.lit(0).cast("long"))
        return F.struct(cell["_block"].alias("block"), F.element_at(cell["_leave"], opened.cast("int") + 1).alias("left"),
                        F.concat(acc["seen"], F.array(F.struct(cell["_block"].alias("_block"), opened.alias("_open")))).alias("seen"))

    opened = chain.select(*keys, F.inline(F.aggregate("_chain", begin, follow, lambda acc: acc["seen"])))
    taken = F.struct((start + c("_open")).alias("free"), F.array().cast("array<bigint>").alias("kept"))
    keep = lambda acc, p: F.when(p >= acc["free"], F.struct((p + gap).alias("free"), F.concat(acc["kept"], F.array(p)).alias("kept"))).otherwise(acc)
    return cells.join(opened, [*keys, "_block"]).select(*keys, F.explode(F.aggregate("_at", taken, keep, lambda acc: acc["kept"])).alias(position))
